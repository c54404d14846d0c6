import itertools
import random

import xxhash

from tallyforge.llm import simhash
from tests.llm.helpers import clashing, write_documents


def brute_print(text, k=3):
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(ids, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and best[a] != best[b]:
                best[a] = best[b] = min(best[a], best[b])
                changed = True
    return best


def test_cover_ignores_any_pair_of_bits_in_some_table():
    masks = simhash.cover(2)
    assert len(masks) == 7
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_links_match_brute_force(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(40)})
    rows = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    from tallyforge.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(rows, 2)).collect()}
    want = brute_components({simhash._signed(p): p for p in prints})
    assert {k: got.get(k, k) for k in want} == want


def test_query_matches_brute_force_on_edge_rows(spark, tmp_path):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta Gamma delta eps zeta".split()) for _ in range(30)) for _ in range(4)]
    texts = [None, "", " \t\n", "One", "one", "ONE two", "É A", "é a", *base, *base[:2], base[0].upper(), "w " * 70_000]
    ids = [*range(100, 100 + len(texts) - 1), 3]
    found = simhash.op6_simhash_cover(spark, write_documents(tmp_path, texts, ids, **clashing(len(texts)))).collect()
    prints = {i: brute_print(t) for i, t in zip(ids, texts)}
    want = brute_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_repeated_rows_null_ids_and_empty_table(spark, tmp_path):
    found = simhash.op6_simhash_cover(spark, write_documents(tmp_path, ["a b c", "a b c", None], [5, 5, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, -1), (5, 5), (5, 5)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert simhash.op6_simhash_cover(spark, write_documents(empty, [])).collect() == []
