import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import packing
from tests.llm.helpers import clashing, write_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("ab'sẞİé́ \t\n\x1c\x85\xa0　½9%_ǅ") + ["<|endoftext|>", "don't", "Thé,", "I\u0307", "x.'s", "%%%", "<|ENDOFTEXT|>", "σΣ"]), max_size=25))
def test_word_ids_are_the_tokenizers_ids(parts):
    text = "".join(parts)
    got = np.frombuffer(packing.WordIds.of(PATH).bytes_of(text.encode()), "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def check(rows, texts, ids, tokens=2048):
    want = defaultdict(list)
    for key, text in zip(ids, texts):
        whole = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        for p, first in enumerate(range(0, len(whole), tokens)):
            part = np.array(whole[first : first + tokens], "<u4")
            want[key].append((p, first, len(part), zlib.crc32(part.tobytes())))
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= tokens
    return len(sequences)


def test_query_on_edge_rows(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n", *[" ".join(rng.choice(["the", "Ab,", "naïve"]) for _ in range(rng.randrange(900))) for _ in range(60)]]
    texts += ["tie"] * 5 + ["long " * 30_000]
    ids = [*range(len(texts) - 2), 4, None]
    found = packing.op10_best_fit(spark, write_documents(tmp_path, texts, ids, **clashing(len(texts)))).collect()
    used = check(found, texts, ids)
    total = sum(r.length for r in found)
    assert used <= -(-total // 2048) + 1


def test_empty_table(spark, tmp_path):
    assert packing.op10_best_fit(spark, write_documents(tmp_path, [])).collect() == []


def test_every_capacity_holds():
    capacities = packing.Capacities(tokens=100, documents=3, attention=5000)
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 71, 2000)
    bins, offsets = packing.best_fit(lengths, capacities)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 5000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([80]), capacities)


def test_best_fit_takes_the_smallest_residual():
    bins, _ = packing.best_fit(np.array([60, 50, 50, 40]), packing.Capacities(100, 10, 10**6, (1.0, 0.0, 0.0)))
    assert bins[0] == bins[3] and bins[1] == bins[2]


def test_words_remembered_are_bounded_within_a_text_too(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 1000)
    monkeypatch.setattr(packing, "MET", 100, raising=False)
    words = packing.WordIds(PATH)
    text = " ".join(f"w{i % 7000}x~" if i % 9 == 0 else f"{i % 7000}." for i in range(20_000))
    got = np.frombuffer(words.bytes_of(text.encode()), "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert sum(len(x) for x in vars(words).values() if isinstance(x, dict)) <= 1000 + 2 * 100


def test_texts_reach_workers_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 100000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    spark.conf.unset(name)
    packing.packed_documents(texts, PATH)
    largest = texts.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
    assert largest <= (4 << 20) + 600_000
    spark.conf.set(name, "1m")
    packing.token_pieces(texts, "doc_id", "text", PATH, 2048, 0)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)
