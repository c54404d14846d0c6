import gzip
import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge.llm import warc
from tests.llm.helpers import CLASHING

PLAIN, PACKED = (lambda x: x), warc.member


def write(folder, rows, **extra):
    columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.string()))]
    made = pa.table(dict(zip(("page_id", "url", "html"), columns)))
    for name, value in extra.items():
        made = made.append_column(name, pa.array([value] * len(rows)))
    pq.write_table(made, f"{folder}/pages.parquet")
    return str(folder)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        again = len(data) >= 1000 and equal and max(equal) != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(equal) if again else None))
    return sorted(out, key=repr)


def test_pages_come_back(spark, tmp_path):
    long, other = "<p>é" * 400, "x" * 1000
    rows = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (3, "http://c/é", long), (4, "u", other), (5, "u", other[1:]), (6, "u", other[1:]), (7, "u", None), (8, "u", "")]
    rows += [(None, "n", long), (None, "n", "z" * 2000), (9, "u", other), (9, "u", other), (10, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 50), (11, "u", "\0\r\n" * 10)]
    rows += [(20, "u", "long " * 200_000), (4, "v", other)]
    folder = write(tmp_path, rows, **CLASHING)
    assert rows_of(warc.op13_warc_salvage(spark, folder)) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    assert sorted(con.execute(warc.ORACLE_SQL).fetchall(), key=repr) == brute(rows)


@pytest.mark.parametrize("compressed", [True, False])
def test_files_are_archives(spark, tmp_path, compressed):
    rows = [(i, f"http://a/{i}", f"<p>page {i}</p>" * (i * 7)) for i in range(60)]
    pages = spark.read.parquet(write(tmp_path, rows) + "/pages.parquet")
    folder = f"{tmp_path}/out"
    warc.write_archives(warc.with_revisits(pages), folder, compressed)
    names = list((tmp_path / "out").glob("part-*"))
    data = b"".join(x.read_bytes() for x in names)
    content = gzip.decompress(data) if compressed else data  # any gzip reader takes them
    assert content.count(warc.VERSION) == 60 and content.endswith(b"\r\n\r\n")
    read = warc.read_archives(spark, folder).collect()
    assert {int(r.headers["page-id"]): bytes(r.payload).decode() for r in read} == {i: h for i, _, h in rows}
    assert not [r for r in read if r.reason] and sum(r.length for r in read) == len(data)


def test_empty_table(spark, tmp_path):
    assert rows_of(warc.op13_warc_salvage(spark, write(tmp_path, []))) == []


def archive(pack, n=20):
    parts = [pack(warc.record(i, f"http://a/{i}", f"<p>text of page {i}, {i * i}</p>".encode() * (i % 5 * 40 + 1), None)) for i in range(n)]
    return parts, b"".join(parts)


def checked(data):
    """Records by page and gaps; together they cover the file once."""
    found = list(warc.salvaged(data))
    at = 0
    for x in sorted((x for x in found if x.length), key=lambda x: x.offset):
        assert x.offset == at
        at += x.length
    assert at == len(data)
    return {int(x.headers["page-id"]): x.payload for x in found if x.reason is None and x.headers}, [x for x in found if x.reason]


@pytest.mark.parametrize("pack", [PLAIN, PACKED])
def test_damage_costs_only_the_records_it_touches(pack):
    parts, data = archive(pack)
    whole, gaps = checked(data)
    assert len(whole) == 20 and not gaps
    rng = random.Random(1)
    starts = [sum(map(len, parts[:i])) for i in range(21)]
    for _ in range(60):
        broken = bytearray(data)
        at, n = rng.randrange(len(data)), rng.randrange(1, 400)
        kind = rng.choice(["flip", "cut", "insert", "zero"])
        n = min(n, len(data) - at)
        if kind == "flip":
            n = 1
            broken[at] ^= 1 << rng.randrange(8)
        elif kind == "cut":
            del broken[at : at + n]
        elif kind == "insert":
            broken[at:at] = rng.randbytes(n)
            n = 1
        else:
            broken[at : at + n] = bytes(n)
        found, gaps = checked(bytes(broken))
        untouched = [i for i in range(20) if starts[i + 1] <= at or starts[i] >= at + n]
        assert all(found.get(i) == whole[i] for i in untouched)
        assert all(found[i] == whole[i] for i in found)  # nothing that is damaged passes for a record
        assert len(gaps) <= 2


def test_faults_are_named_and_the_rest_recovered():
    one, two, three = (warc.record(i, "u", b"payload %d" % i, None) for i in (1, 2, 3))
    cases = {
        "no version line": b"\0junk" * 9,
        "no empty line behind the block": two[:-30] + b"\r\n\r\n",
        "the block is not what its digest says": two.replace(b"payload 2", b"payload X"),
        "the header is not what its digest says": two.replace(b"Page-Id: 2", b"Page-Id: 9"),
        "no content length": b"WARC/1.0\r\nWARC-Type: x\r\n\r\nabc\r\n\r\n",
        "a header line has no name": b"WARC/1.0\r\nnothing\r\n\r\n\r\n\r\n",
    }
    for reason, middle in cases.items():
        found, gaps = checked(one + middle + three)
        assert sorted(found) == [1, 3] and [(g.reason, g.offset, g.length) for g in gaps] == [(reason, len(one), len(middle))]
    cut_off = warc.member(two)[:-9]
    found, gaps = checked(warc.member(one) + cut_off)
    assert sorted(found) == [1, 2] and gaps[0].reason == "the member is cut off"  # the record is whole, its member is not
    found, gaps = checked(b"WARC/1.0\r\nA: b\r\n c\r\nContent-Length: 2\r\nPage-Id: 7\r\n\r\nhi\r\n\r\n" + one)
    assert found[7] == b"hi" and not gaps


def test_a_whole_file_in_one_member_is_read_as_far_as_it_goes():
    parts, data = archive(PLAIN)
    found, gaps = checked(warc.member(data))
    assert len(found) == 20 and not gaps
    broken = bytearray(warc.member(data))
    broken[len(broken) // 2] ^= 0xFF
    found, gaps = checked(bytes(broken) + warc.member(warc.record(99, "u", b"after", None)))
    assert 99 in found and 0 in found and 0 < len(found) < 21 and len(gaps) == 1
    inner = bytearray(data)
    inner[len(parts[0]) + 200] ^= 1
    found, gaps = checked(warc.member(bytes(inner)))
    assert sorted(found) == [0, *range(2, 20)] and len(gaps) == 1


def test_members_end_in_zero():
    for n in (0, 1, 255, 1 << 24):
        data = warc.member(bytes(n))
        data = data if data[-1:] == b"\0" else data + warc.EMPTY_MEMBER
        assert data[-1] == 0 and len(gzip.decompress(data)) == n
    assert zlib.decompress(warc.EMPTY_MEMBER, 31) == b""


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    parts, data = archive(PACKED)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(data[: len(parts[0])] + b"?" * 50 + data[len(parts[0]) :])
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"")
    rows = warc.read_archives(spark, f"{tmp_path}/in").collect()
    assert len([r for r in rows if r.reason is None]) == 20
    gap = [r for r in rows if r.reason]
    assert [(g.offset, g.length, g.payload) for g in gap] == [(len(parts[0]), 50, None)]
