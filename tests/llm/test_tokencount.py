import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import tokencount
from tests.llm.helpers import clashing, write_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        shift += 7
        if byte < 128:
            return value, at


def fields(data):
    """(number, wire type, whole field, payload) of each field of a protocol buffer."""
    at = 0
    while at < len(data):
        start = at
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            _, end = varint(data, at)
            body = data[at:end]
        elif kind == 2:
            size, at = varint(data, at)
            end = at + size
            body = data[at:end]
        else:
            end = at + {1: 8, 5: 4}[kind]
            body = data[at:end]
        yield tag >> 3, kind, data[start:end], body
        at = end


def number(x):
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def as_unigram():
    """The tokenizer library on the same pieces, scores and rules, but told that the model is a unigram."""
    data = open(PATH, "rb").read()
    out = b""
    for n, _, whole, body in fields(data):
        if n == 2:  # trainer_spec; its field 3 is the model type, 1 stands for unigram
            body = b"".join(w for m, _, w, _ in fields(body) if m != 3) + b"\x18\x01"
            whole = b"\x12" + number(len(body)) + body
        out += whole
    return sentencepiece.SentencePieceProcessor(model_proto=out)


UNIGRAM = as_unigram()
COUNTER = tokencount.UnigramCounter(PATH)


PIECES = {UNIGRAM.id_to_piece(i): UNIGRAM.get_score(i) for i in range(3, UNIGRAM.vocab_size()) if not UNIGRAM.is_byte(i)}
LONGEST, UNKNOWN = max(map(len, PIECES)), min(PIECES.values()) - 10


def brute_count(text):
    """The tokenizer's table over a whole text: filled by starts, an entry replaced only by a better score."""
    s = UNIGRAM.normalize(text) if text else ""
    best = [(0.0, 0)] + [None] * len(s)
    for start in range(len(s)):
        score, n = best[start]
        for end in range(start + 1, min(len(s), start + LONGEST) + 1):
            own = PIECES.get(s[start:end])
            if own is not None and (best[end] is None or score + own > best[end][0]):
                best[end] = (score + own, n + 1)
        if s[start] not in PIECES and (best[start + 1] is None or score + UNKNOWN > best[start + 1][0]):
            best[start + 1] = (score + UNKNOWN, n + len(s[start].encode()))
    return best[len(s)][1]


def score_of(path):
    return sum(PIECES.get(p, UNKNOWN) for p in path)


def best_score(text):
    """The best sum of scores over all ways to cut the text, as a plain table."""
    s = UNIGRAM.normalize(text)
    best = [0.0] + [None] * len(s)
    for end in range(1, len(s) + 1):
        ways = [best[a] + PIECES.get(s[a:end], UNKNOWN if end == a + 1 else -1e18) for a in range(max(0, end - LONGEST), end)]
        best[end] = max(ways)
    return best[-1]


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aabcdeehinorst .é"), max_size=60))
def test_counts_are_the_librarys_where_single_precision_is_exact(text):
    """Word by word the library's count, unless its default search missed a path of a better score."""
    for word in text.split():
        found = UNIGRAM.encode(word, out_type=str)
        assert COUNTER.count(word) == len(found) or score_of(found) < best_score(word)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aabcdeehinorst  \n▁.é漢字🙂\t\x00"), max_size=40))
def test_counts_match_brute_force(text):
    assert COUNTER.count(text) == brute_count(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabcdeehinorst|"), min_size=1, max_size=7))
def test_counts_are_those_of_the_librarys_own_best_paths(word):
    """Every path that its n-best search ranks first by score has the count given here among those of equal score."""
    paths = UNIGRAM.nbest_encode(word, nbest_size=20, out_type=str)
    best = max(map(score_of, paths))
    assert best == best_score(word) and COUNTER.count(word) in {len(p) for p in paths if score_of(p) == best}


def test_a_word_on_which_the_default_search_is_not_best():
    assert UNIGRAM.encode("the", out_type=str) == ["▁the"] and UNIGRAM.nbest_encode("the", nbest_size=2, out_type=str)[0] == ["▁t", "he"]
    assert COUNTER.count("the") == 2 and PIECES["▁t"] + PIECES["he"] > PIECES["▁the"]


def test_whole_documents_match_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = tokencount.op9_count_viterbi(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == brute_count(texts[r.doc_id]) and r.n_bytes == len(texts[r.doc_id].encode())


def test_edge_rows(spark, tmp_path):
    rng = random.Random(0)
    texts = [None, "", " ", "\n\n", "same", "same", "a" * 5000, " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(40_000))]
    ids = [0, 1, 2, 3, 4, 4, None, 7]
    rows = tokencount.op9_count_viterbi(spark, write_documents(tmp_path, texts, ids, **clashing(8))).collect()
    want = sorted((-1 if i is None else i, brute_count(t or "")) for i, t in zip(ids, texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in rows) == want
    empty = tmp_path / "empty"
    empty.mkdir()
    assert tokencount.op9_count_viterbi(spark, write_documents(empty, [])).collect() == []
