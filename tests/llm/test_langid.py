import random

import numpy as np

from cadenza.llm import langid

WORDS = {"en": "the of and that this with from have".split(), "fr": "le la des être avec où déjà pour".split(), "de": "der die und über für nicht schön".split()}


def corpus(rnd, n):
    rows = []
    for k in range(n):
        lang = rnd.choice(sorted(WORDS))
        rows.append((k, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(3, 60))), lang))
    return rows


def slow_grams(text):
    """Buckets of a text, one n-gram at a time."""
    chars = [" "] + [c if c.isalpha() else " " for c in text.lower()] + [" ", " "]
    out = []
    for k in range(len(chars) - 2):
        h = np.uint32(0)
        for n, m in enumerate((langid._M1, langid._M2, langid._M3)):
            with np.errstate(over="ignore"):
                c = np.uint32(ord(chars[k + n]))
                h = c * m if n == 0 else (h ^ c) * m
            if any(x.isalpha() for x in chars[k : k + n + 1]):
                out.append(int(h >> np.uint32(32 - langid.BITS)))
    return out


def test_training_and_scores_match_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(langid, "_STEP", 64)
    rnd = random.Random(3)
    rows = corpus(rnd, 60)
    df = spark.createDataFrame([*rows, (900, "unlabelled words", None), (901, None, "en")], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.langs == ("de", "en", "fr")
    counts = np.zeros((langid.BUCKETS, 3))
    for _, t, lang in rows:
        np.add.at(counts[:, model.langs.index(lang)], slow_grams(t), 1)
    want = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * langid.BUCKETS))
    assert np.allclose(model.log_probs[:-1], want)
    texts = [t for _, t, _ in rows[:20]] + ["où est le chat? " * 40, "", None, "123", "É", "ß" * 200]
    langs, scores = langid.score_texts(model, texts)
    for t, lang, s in zip(texts, langs, scores, strict=True):
        if not t or not any(c.isalpha() for c in t):
            assert (lang, s) == ("und", 0)
            continue
        total = model.priors + want[slow_grams(t)].sum(axis=0)
        assert lang == model.langs[int(total.argmax())] and abs(s - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_held_out_accuracy_and_edges(spark):
    rnd = random.Random(5)
    rows = corpus(rnd, 400)
    df = spark.createDataFrame([(k, t, lang, "x") for k, t, lang in rows], "doc_id long, text string, lang string, score string")
    model = langid.train(df.where("doc_id < 200"), max_rows=90)
    got = langid.predict(df.where("doc_id >= 200"), model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert got.where("lang = lang_pred").count() >= 190
    assert langid.predict(df.where("false"), model).count() == 0
    none = langid.train(df.where("lang is null"))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, none).collect()} == {("und", 0.0)}


def test_sample_bound_at_any_size():
    """The share of hashes under the bound stays what was asked for, however many rows there are."""
    for n in (1, 2_500, 2_501, 10**6, 10**10, 10**13):
        taken = (langid.hash_bound(2_500, n) + (1 << 63) + 1) / (1 << 64)
        assert abs(taken * n - min(n, 2_500)) < 1e-3 * min(n, 2_500)
