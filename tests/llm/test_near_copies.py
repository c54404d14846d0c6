import itertools
import random

import corpus_pipeline as cp
from tallyforge.llm import near_copies
from tests.llm.helpers import clashing, write_documents


def brute_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = brute_set(a), brute_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(texts):
    best = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similarity(texts[a], texts[b]) >= 0.8 and best[a] != best[b]:
            low, high = sorted((best[a], best[b]))
            best = [low if x == high else x for x in best]
    return sorted(set(best))


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = "edited"
    return " ".join(words)


def random_text(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def kept(spark, folder, texts):
    path = write_documents(folder, texts, **clashing(len(texts)))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = cp.near_copies(spark, docs, path)
    assert out.columns == docs.columns
    return sorted(r.doc_id for r in out.collect())


def test_edited_copies_chains_and_groups_match_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = []
    for n in (50, 120, 200, 400):
        for edits in (1, 2, 4, 8, 12):
            base = random_text(rng, n)
            texts += [base, edited(rng, base, edits), base.upper()]
    base = random_text(rng, 100)
    texts += [edited(rng, base, 2) for _ in range(60)]  # many pairs fall on either side of 0.8
    for _ in range(5):
        base = edited(rng, base, 2)  # a chain
        texts.append(base)
    texts += [None, "", "a b", "A  b", "a b c", "same line of six words here"]
    rng.shuffle(texts)
    assert kept(spark, tmp_path, texts) == brute_kept(texts)


def test_groups_below_the_least_similarity_all_stay(spark, tmp_path):
    rng = random.Random(2)
    base = random_text(rng, 100)
    texts = [edited(rng, base, 6) for _ in range(40)]
    assert kept(spark, tmp_path, texts) == brute_kept(texts)


def test_bands_recall_at_the_least_similarity():
    rng = random.Random(3)
    missed = total = 0
    while total < 500:
        base = random_text(rng, rng.randint(50, 600))
        other = edited(rng, base, max(1, len(base.split()) // 46))
        if 0.8 <= similarity(base, other) < 0.85:
            total += 1
            a, b = (near_copies.bands(near_copies.shingles(x)) for x in (base, other))
            missed += not (a == b).any()
    assert missed == 0


def test_recall_of_the_whole_stage_at_the_least_similarity(spark, tmp_path):
    rng = random.Random(3)
    texts, pairs = [], []
    while len(pairs) < 600:
        base = random_text(rng, rng.randint(50, 600))
        other = edited(rng, base, max(1, len(base.split()) // 46))
        if 0.8 <= similarity(base, other) < 0.85:
            pairs.append((len(texts), len(texts) + 1))
            texts += [base, other]
    found = set(kept(spark, tmp_path, texts))
    missed = sum(b in found for _, b in pairs)
    assert missed <= 3 and all(a in found for a, _ in pairs)


def test_pages_of_one_template_that_do_not_link(spark, tmp_path):
    """Two thousand texts share bands with one another, few pairs link: one round of comparisons, no list of pairs."""
    rng = random.Random(4)
    base = random_text(rng, 150)
    texts = [edited_apart(rng, base, 6) for _ in range(2000)] + [base]
    sets = [brute_set(t) for t in texts]
    index = {}
    for s in sets:
        for x in s:
            index.setdefault(x, len(index))
    import numpy as np

    member = np.zeros((len(texts), len(index)), np.float32)
    for i, s in enumerate(sets):
        member[i, [index[x] for x in s]] = 1
    both = member @ member.T
    sizes = member.sum(1)
    linked = both * 5 >= (sizes[:, None] + sizes[None, :] - both) * 4
    root = np.arange(len(texts))
    while True:
        new = np.array([root[linked[i]].min() for i in range(len(texts))])
        if (new == root).all():
            break
        root = new
    assert kept(spark, tmp_path, texts) == sorted(set(root.tolist()))


def edited_apart(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = "".join(rng.choices("mnopqrst", k=6))
    return " ".join(words)


def test_a_unit_of_many_blocks_and_buckets_apart(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    base = random_text(rng, 120)
    texts = [edited_apart(rng, base, 3) for _ in range(70)]
    for _ in range(20):
        own = random_text(rng, 80)
        texts += [own, edited(rng, own, 2)]
    want = brute_kept(texts)
    assert kept(spark, tmp_path, texts) == want
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "LISTED", 0)
    assert kept(spark, tmp_path, texts) == want
