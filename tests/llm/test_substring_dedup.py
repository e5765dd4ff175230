import random
import re

import pytest
from pyspark.sql import functions as F

from cadenza.llm import substring_dedup as sd

M = (1 << 64) - 1


def mixed(h):
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & M
    return h ^ h >> 32


def word_hash(w):
    lowered = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in w]
    return mixed(sum((c + 1) * pow(sd._STEP, k, 1 << 64) for k, c in enumerate(lowered)) & M)


def plain(text):
    """(start, words) of every sentence, one word after another."""
    out = []
    for m in re.finditer(r"[^.!?\n]+", text):
        words = [(m.start() + w.start(), w[0]) for w in re.finditer(r"\w+", m[0])]
        held = []
        for k, (at, w) in enumerate(words):
            held.append((at, "".join(c.lower() if len(c.lower()) == 1 else c for c in w)))
            if k + 1 == len(words) or (len(words) > sd.LONG and word_hash(w) % 4 == 0):
                out.append((held[0][0], tuple(x for _, x in held)))
                held = []
    return out


def sentence(rnd):
    return " ".join(rnd.choice("abcdefghijkl") * rnd.randint(1, 3) + rnd.choice(["", "", ","]) for _ in range(rnd.choice([1, 4, 9, 30]))) + rnd.choice([". ", "! ", "\n", ".\n"])


def test_sentences():
    rnd = random.Random(1)
    texts = ["".join(sentence(rnd) for _ in range(rnd.randint(0, 9))) + rnd.choice(["", "İ tail", "...", "ΑΣ.Β ΣΑΣ", "漢字 and_so 12,5", "\x00 😀 x\u0301y"]) for _ in range(80)]
    owner, place, h = sd.sentences(texts)
    want = [(k, at, w) for k, t in enumerate(texts) for at, w in plain(t)]
    assert list(zip(owner.tolist(), place.tolist(), strict=True)) == [x[:2] for x in want]
    by = {}
    for x, (_, _, w) in zip(h.tolist(), want, strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    assert len(sd.sentences(["", "..."])[0]) == 0 and len(sd.sentences([])[0]) == 0


def brute(rows):
    """By all pairs of places, without hashing; (sentences removed) of each document."""
    windows = []
    for i, t in rows:
        w = [x for _, x in plain(t or "")]
        windows += [(tuple(w[a : a + sd.RUN]), i, a) for a in range(len(w) - sd.RUN + 1)]
    first, out = {}, {}
    for w, i, a in sorted(windows, key=lambda x: x[1:]):
        first.setdefault(w, (i, a))
    for w, i, a in windows:
        if first[w] != (i, a):
            out.setdefault(i, set()).update(range(a, a + sd.RUN))
    return out


@pytest.mark.parametrize("piece", [1, 200, 1 << 20])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, piece):
    from cadenza.llm import queries

    monkeypatch.setattr(sd, "PIECE", piece)
    rnd = random.Random(7)
    shared = ["".join(sentence(rnd) for _ in range(8)) for _ in range(4)]
    rows = [(900, None), (901, ""), (902, "!!!"), (903, "One. Two."), (904, "Yes. No. Yes."), (905, "Well. YES. no. Yes")]
    for k in range(40):
        own = [sentence(rnd) for _ in range(rnd.randint(0, 6))]
        if rnd.random() < 0.6:
            own.insert(rnd.randint(0, len(own)), rnd.choice(shared))
        if rnd.random() < 0.2:
            own += own
        rows.append((k, "".join(own)))
    want = brute(rows)
    assert want and 905 in want
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    got = queries.op6_substring_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text, gone = texts[r.doc_id], want.get(r.doc_id, set())
        starts = [at for at, _ in plain(text or "")]
        assert (r.n_sentences, r.n_removed) == (len(starts), len(gone))
        if not gone:
            assert r.clean_text == text
        else:
            cuts = [0, *starts[1:], len(text)]
            assert r.clean_text == "".join(text[a:b] for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if k not in gone)


def test_edge_cases(spark):
    passage = " ".join(f"word{k}{'.' if k % 9 == 8 else ''}" for k in range(60))
    rows = [(1, None, "a"), (2, "", "b"), (3, passage, "c"), (4, "Own start. " + passage + " Own end.", "d"), (None, "Short.", "e"), (5, "!!!", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    got = {r.doc_id: r for r in sd.deduplicate(df).collect()}
    assert got[3].clean_text == passage and got[1].clean_text is None and got[2].clean_text == ""
    assert got[4].clean_text.startswith("Own start.") and "word20" not in got[4].clean_text and "word40" not in got[4].clean_text
    assert got[None].n_removed == 0 and got[5].n_sentences == 0 and got[5].clean_text == "!!!"
    assert sd.deduplicate(df.where("false").withColumn("place", F.lit(1))).count() == 0
