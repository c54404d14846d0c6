import datetime
import hashlib

import pytest
import regex

from tallyforge.llm import pii
from tests.llm.helpers import clashing, write_documents

KEY = "k"


def digest(kind, i, other, m):
    return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{other}".encode()).hexdigest()[:15], 16) % m


def feistel(kind, left, right, ml, mr, back=False):
    for i in range(pii.ROUNDS, 0, -1) if back else range(1, pii.ROUNDS + 1):
        sign = -1 if back else 1
        if i % 2:
            left = (left + sign * digest(kind, i, right, ml)) % ml
        else:
            right = (right + sign * digest(kind, i, left, mr)) % mr
    return left, right


def permuted(kind, d, back=False):
    a = len(d) // 2
    left, right = feistel(kind, int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a), back)
    return f"{left:0{a}d}{right:0{len(d) - a}d}"


def luhn(body):
    total = 0
    for k, c in enumerate(reversed(body)):
        x = int(c) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def spread(value, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in value)


def brute(m):
    """The same rules in plain Python, for all kinds but mail names and IBANs."""
    d = regex.sub("[^0-9]", "", m)
    if regex.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        left, right = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if regex.match(r"\+", m) and 8 <= len(d) <= 15:
        c = 1 if d[0] in "17" else 2
        return spread(m, d[:c] + permuted("phone", d[c:]))
    if regex.fullmatch(r"[2-6][0-9 \-]*", m) and 13 <= len(d) <= 19 and luhn(d[:-1]) == d[-1]:
        body = d[0] + permuted("card", d[1:-1])
        return spread(m, body + luhn(body))
    return m


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.pseudonymise(df, KEY, count_col="n").collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)], [r.n for r in sorted(rows, key=lambda r: r.doc_id)]


def test_values_match_brute_force_and_stay_linked(spark):
    values = ["4845168114407329", "4845 1681 1440 7329", "+1 (017) 555-7713", "+10175557713", "97.51.17.173", "300.1.1.1", "9807915762804491", "4845168114407328"]
    texts = [f"before {v} after, {v}." for v in values]
    got, counts = run(spark, texts)
    assert got == [f"before {brute(v)} after, {brute(v)}." for v in values]
    assert counts == [2, 2, 2, 2, 2, 0, 0, 0]
    digits = [regex.sub("[^0-9]", "", t.split("after")[0]) for t in got]
    assert digits[0] == digits[1] != regex.sub("[^0-9]", "", values[0]) and digits[2] == digits[3]


def test_permutation_is_invertible():
    for d in ("12", "000000", "98765432101", "1234567890123456789012345678901"):
        assert permuted("x", permuted("x", d), back=True) == d


def test_dates_stay_dates_of_their_format(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(d) for d in range(0, 73049, 37)]
    texts = [f"{d:%Y-%m-%d}" for d in days] + ["31/12/1999", "12/31/1999", "31.12.1999", "2001-02-30", "1850-01-01"]
    got, counts = run(spark, texts)
    out = [datetime.date.fromisoformat(t) for t in got[: len(days)]]
    assert len(set(out)) == len(days) and out != days
    assert got[-2:] == texts[-2:] and counts[-2:] == [0, 0]
    day = datetime.datetime.strptime(got[-5], "%d/%m/%Y")
    assert datetime.datetime.strptime(got[-4], "%m/%d/%Y") == day == datetime.datetime.strptime(got[-3], "%d.%m.%Y")


def test_other_kinds(spark):
    texts = ["536-90-4399", "666-12-1234", "DE89 3704 0044 0532 0130 00", "DE88370400440532013000", "Jo.Bl0ggs+x@mail.example.com", "(212) 555-0199", "a@b.co"]
    got, _ = run(spark, texts)
    assert regex.fullmatch(r"\d{3}-\d{2}-\d{4}", got[0]) and got[0] != texts[0] and got[1] == texts[1]
    flat = got[2].replace(" ", "")
    number = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
    assert int(number) % 97 == 1 and got[2] != texts[2] and len(got[2]) == len(texts[2]) and got[3] == texts[3]
    assert regex.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]\d[a-z]{3}\+[a-z]@mail\.example\.com", got[4]) and got[4] != texts[4]
    assert regex.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", got[5]) and got[5] != texts[5]
    assert regex.fullmatch(r"[a-z]@b\.co", got[6])
    assert len(set(run(spark, [f"{x}@b.co" for x in "abcdefghijklmnopqrstuvwxyz"])[0])) == 26


def test_edge_rows(spark, tmp_path):
    texts = [None, "", "no value", "7" * 400_000, "x" * 400_000 + " 97.51.17.173", "97.51.17.173", "97.51.17.173"]
    ids = [1, 2, 3, 4, 5, None, None]
    rows = pii.op5_feistel_pii(spark, write_documents(tmp_path, texts, ids, **clashing(7))).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and [by_id[i].text for i in (1, 2, 3, 4)] == texts[:4]
    assert by_id[5].n_replaced == 1 and by_id[5].text.startswith("x" * 400_000 + " ")
    assert len({r.text for r in rows if r.doc_id is None}) == 1
    empty = tmp_path / "empty"
    empty.mkdir()
    assert pii.op5_feistel_pii(spark, write_documents(empty, [])).collect() == []


def test_key_is_checked():
    with pytest.raises(ValueError):
        pii.pseudonym_sql("a'b")


def test_values_next_to_others_are_all_replaced(spark):
    phone, ibans = "+1 (826) 555-4081", ["ES9121000418450200051332", "BE68539007547034", "DE89370400440532013000", "NO9386011117947"]
    cases = [(phone, x) for x in ("190.137.223.204", "170.106.47.218", "5551234", "2020-01-31", "536-90-4399", "4845 1681 1440 7329", "212-555-0199")]
    cases += [("+1 (843) 555-7672", "170.106.47.218")]
    got, counts = run(spark, [f"{a} {b}" for a, b in cases])
    for (a, b), text, n in zip(cases, got, counts):
        first, second = text[: len(a)], text[len(a) + 1 :]
        assert first == brute(a) != a and n == (1 if b == "5551234" else 2), text
        assert (second == b) == (b == "5551234"), text
    got, counts = run(spark, [f"{x} BIC CAIXESBB" for x in ibans] + ["ID12 4845 1681 1440 7329"])
    assert counts == [1] * 5
    for x, text in zip(ibans, got):
        assert text.endswith(" BIC CAIXESBB") and text[: len(x)] != x
        flat = text[: len(x)]
        assert int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    assert got[-1] == "ID12 " + brute("4845 1681 1440 7329")
