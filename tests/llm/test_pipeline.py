import pytest
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline as cp
from tallyforge.llm import decontaminate, langid, near_copies
from tests.llm.helpers import clashing, write_documents
from tests.llm.test_near_copies import brute_kept

ITEM = "alpha beta gamma delta epsilon zeta eta theta"


@pytest.fixture
def small(tmp_path):
    english = ["the cat and the dog of the house", "that is what the man said to them", "with this and that he went on there"]
    french = ["le chat est sur la table avec nous", "que les hommes et les femmes sont là", "dans la maison de la ville il y a"]
    texts = [*english, *french, *english, None, "", "1234 --", "the THE cat and the dog of the house", f"words before {ITEM} and after", "mail jo@a.example or 97.51.17.173 to the man", "clean and long " * 3000]
    ids = [*range(len(texts) - 1), None]
    langs = ["en"] * 3 + ["fr"] * 3 + ["en"] * 3 + [None] * 3 + ["en"] * 4
    path = write_documents(tmp_path, texts, ids, langs, **clashing(len(texts)), text_crc32=[1] * len(texts))
    pq.write_table(pa.table({"item_id": [1, 2], "text": [ITEM, None]}), f"{path}/benchmark.parquet")
    return path


def test_each_stage_against_its_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    model = langid.train(docs)
    before = [r.asDict() for r in docs.collect()]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == columns
        after = [r.asDict() for r in out.collect()]
        if name == "language":
            want = [r for r in before if langid.predict(model, r["text"])[0] != "und" and langid.predict(model, r["text"])[1] >= cp.LEAST_SCORE]
        elif name == "near_copies":
            ordered = sorted(before, key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
            want = [ordered[i] for i in brute_kept([r["text"] for r in ordered])]
        elif name == "benchmark_leaks":
            want = [r for r in before if ITEM not in (r["text"] or "")]
            assert len(want) == len(before) - 1
        else:
            want = [r for r in before if "@" not in r["text"]]
            masked = [r for r in after if "@" in r["text"]]
            assert len(masked) == 1 and "97.51.17.173" not in masked[0]["text"] and masked[0]["n_chars"] == len(masked[0]["text"])
            after = [r for r in after if "@" not in r["text"]]
        key = lambda r: (str(r["doc_id"]), r["text"])
        assert sorted(after, key=key) == sorted(want, key=key)
        path = f"{small}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        before = [r.asDict() for r in docs.collect()]
    packed = cp.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {r["doc_id"] for r in before}
    whole = cp.run(spark, small).collect()
    assert sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in whole) == sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in packed)


def test_empty_documents(spark, tmp_path):
    path = write_documents(tmp_path, [])
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), f"{path}/benchmark.parquet")
    assert cp.run(spark, path).collect() == []


def test_repeated_rows_leave_one(spark, tmp_path):
    path = write_documents(tmp_path, ["a b c d"] * 3 + ["e f g h"] * 2, [4, 4, 9, None, None])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = near_copies.one_of_each_class(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["4", "None"]


def test_rows_of_one_id_and_text_leave_a_defined_one(spark):
    rows = [(4, "a b c d", x) for x in ("u", "v", "w")] + [(5, "A B c d", "x"), (6, "other words here", None)]
    kept = [near_copies.one_of_each_class(spark.createDataFrame(part, "doc_id long, text string, source string")).collect() for part in (rows, rows[::-1])]
    assert sorted(map(tuple, kept[0])) == sorted(map(tuple, kept[1])) and sorted(r.doc_id for r in kept[0]) == [4, 6]


def test_leak_flag_is_what_leaks_finds(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    flagged = {r.doc_id for r in decontaminate.with_leak(docs, bench).where("leaked").collect()}
    assert flagged == {r.id for r in decontaminate.leaks(docs, bench).collect()} and flagged
