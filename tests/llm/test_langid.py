import math
import zlib

import numpy as np
import pytest

from tallyforge.llm import langid
from tests.llm.helpers import clashing, write_documents


def test_term_counts_do_not_depend_on_the_step(monkeypatch):
    text = "Abc déf  ghi\n" * 50
    whole = langid.term_counts(text)
    monkeypatch.setattr(langid, "STEP", 37)
    assert (langid.term_counts(text) == whole).all()
    n = len(" ".join(text.split())) + 2
    assert whole.sum() == n + (n - 1) + (n - 2)


def test_held_out_accuracy_and_query_columns(spark, sf_dir):
    rows = langid.op8_ftrl_language(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark, tmp_path):
    texts = [None, "", "12 % 3", "the cat sat on the mat", "le chat est sur la table", *["the dog and the cat"] * 4, *["le chien et le chat"] * 4, "x " * 300_000]
    langs = [None, "en", "fr", "en", "fr", *["en"] * 4, *["fr"] * 4, None]
    ids = [*range(len(texts) - 1), None]
    found = langid.op8_ftrl_language(spark, write_documents(tmp_path, texts, ids, langs, **clashing(len(texts)))).collect()
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and by_id[0].score == 0
    assert by_id[3].lang_pred == "en" and by_id[4].lang_pred == "fr"
    assert len(found) == len(texts)


def test_no_labels_and_empty_table(spark, tmp_path):
    rows = langid.op8_ftrl_language(spark, write_documents(tmp_path, ["abc", None], langs=[None, None])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)] * 2
    empty = tmp_path / "empty"
    empty.mkdir()
    assert langid.op8_ftrl_language(spark, write_documents(empty, [])).collect() == []


def test_penalties_make_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    frequency = np.ones(langid.FEATURES, np.int64)
    sample = []
    for _ in range(300):
        label = rng.integers(2)
        shown = label if rng.random() < 0.8 else 1 - label
        sample.append(("ab"[label], np.array([shown, *rng.integers(2, 500, 5)], np.int32), np.ones(6, np.int32)))
    used = [(langid.fit(sample, frequency, 300, langid.Settings(l1=l1)).weights != 0).sum() for l1 in (0.0, 0.3, 1.0)]
    assert used[0] > 1.3 * used[1] > 1.3 * used[2] > 0
    logits, labels = rng.normal(size=(2000, 2)), rng.integers(0, 2, 2000)
    assert langid._temperature(logits * 10, labels) > 5


def brute_counts(text):
    clean = " " + " ".join(text.lower().split()) + " "
    out = {}
    for n in langid.ORDERS:
        for i in range(len(clean) - n + 1):
            mixed = 0
            for j in range(n):
                mixed = (mixed * 0x9E3779B1 + ord(clean[i + j]) + j + 1) % 2**32
            code = (mixed * 0x85EBCA6B % 2**32) >> 17
            out[code] = out.get(code, 0) + 1
    return out


def brute_fit(rows, s):
    """FTRL-proximal as published, one coordinate at a time, in plain numbers."""
    languages = sorted({lang for lang, _ in rows})
    counted = [(languages.index(lang), brute_counts(text)) for lang, text in rows]
    frequency = {}
    for _, c in counted:
        for f in c:
            frequency[f] = frequency.get(f, 0) + 1
    idf = {f: math.log((1 + len(rows)) / (1 + n)) + 0.1 for f, n in frequency.items()}
    vectors = []
    for lang, c in counted:
        x = {f: math.log1p(n) * idf[f] for f, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        vectors.append((lang, {f: v / norm for f, v in x.items()} | {"bias": 1.0}))
    met, held, used = {}, [], []
    for x in vectors:
        met[x[0]] = met.get(x[0], 0) + 1
        (used if met[x[0]] % s.calibration_share else held).append(x)
    z, n = {}, {}

    def weight(f, k):
        a = z.get((f, k), 0.0)
        if abs(a) <= s.l1:
            return 0.0
        return -(a - math.copysign(s.l1, a)) / ((s.beta + math.sqrt(n.get((f, k), 0.0))) / s.alpha + s.l2)

    def probabilities(x, t=1.0):
        logits = [sum(v * weight(f, k) for f, v in x.items()) / t for k in range(len(languages))]
        top = max(logits)
        e = [math.exp(v - top) for v in logits]
        return [v / sum(e) for v in e]

    rng = np.random.default_rng(0)
    for _ in range(s.epochs):
        for i in rng.permutation(len(used)):
            label, x = used[i]
            p = probabilities(x)
            steps = []
            for f, v in x.items():
                for k in range(len(languages)):
                    g = v * (p[k] - (k == label))
                    old = n.get((f, k), 0.0)
                    steps.append(((f, k), g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * weight(f, k), g * g))
            for at, dz, dn in steps:
                z[at] = z.get(at, 0.0) + dz
                n[at] = n.get(at, 0.0) + dn
    loss = lambda t: -sum(math.log(max(probabilities(x, t)[label], 1e-12)) for label, x in held) / len(held)
    return languages, weight, probabilities, loss, vectors


def test_training_equals_plain_ftrl():
    rows = [(lang, text) for lang, texts in TINY.items() for text in texts]
    settings = langid.Settings(epochs=3, l1=0.05, calibration_share=2)
    languages, weight, probabilities, loss, vectors = brute_fit(rows, settings)
    sample, frequency = [], np.zeros(langid.FEATURES, np.int64)
    for lang, text in rows:
        c = langid.term_counts(text)
        assert {f: int(c[f]) for f in np.flatnonzero(c)} == brute_counts(text)
        frequency += c > 0
        f = np.flatnonzero(c)
        sample.append((lang, f, c[f]))
    model = langid.fit(sample, frequency, len(rows), settings)
    assert model.languages == languages
    zeros = 0
    for f in np.flatnonzero(frequency).tolist():
        for k in range(len(languages)):
            assert abs(model.weights[f, k] - weight(f, k)) < 1e-9
            zeros += model.weights[f, k] == 0
    assert zeros and all(abs(model.bias[k] - weight("bias", k)) < 1e-9 for k in range(len(languages)))
    t = model.temperature
    assert 0.06 < t < 19 and loss(t) <= min(loss(t * 1.05), loss(t / 1.05))
    for (lang, text), (_, x) in zip(rows, vectors):
        p = probabilities(x, t)
        found, score = langid.predict(model, text)
        assert found == languages[p.index(max(p))] and abs(score - max(p)) < 1e-9


#: With every second row held out, one of those rows is labelled wrongly, so that the temperature has an inner optimum.
TINY = {
    "aa": ["the cat and the dog", "that is what he said", "with this and that", "of the house there", "the man went on", "all of the things"],
    "bb": ["le chat est sur la table", "que les hommes sont", "dans la maison", "that is the dog of the house", "avec nous il y a", "une chose pour vous"],
    "cc": ["der hund und die katze", "das ist was er sagte", "in dem haus dort", "mit dem mann ging", "alle die dinge hier"],
}


def test_a_language_of_one_row_is_learnt():
    rows = [("aa", t) for t in TINY["aa"]] + [("zz", "xyzzy plugh xyzzy")]
    sample, frequency = [], np.zeros(langid.FEATURES, np.int64)
    for lang, text in rows:
        c = langid.term_counts(text)
        frequency += c > 0
        sample.append((lang, np.flatnonzero(c), c[np.flatnonzero(c)]))
    model = langid.fit(sample, frequency, len(rows), langid.Settings())
    assert langid.predict(model, "xyzzy plugh")[0] == "zz"


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(docs, settings=langid.Settings(most_languages=4))
