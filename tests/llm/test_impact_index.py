import math
import random
import re

import numpy as np
import pytest

from cadenza.llm import common, impact_index as ii


def brute(docs, items, k=10):
    """{item: [(doc, score)]} by scoring every document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parsed = [(i, words(t)) for i, t in docs]
    count, total, asked = sum(bool(w) for _, w in parsed), sum(len(w) for _, w in parsed), {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    df = {x: sum(x in w for _, w in parsed) for t in asked.values() for x in t}
    out = {}
    for i, terms in asked.items():
        rows = []
        for doc, w in parsed:
            m = 10 + 90 * len(w) * count // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (10**9 * w.count(x) // (1000 * w.count(x) + 8 * m)) for x in terms if x in w)
            if score > 0:
                rows.append((doc, score))
        out[i] = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0]))[:k]
    return {i: r for i, r in out.items() if r}


def rows_of(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


def corpus(rnd, n=300):
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünï", "ÉÉ", "A1", "zz", "漢字"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(k, rnd.choice([" ", ", ", "-_"]).join(rnd.choices(vocabulary, weights, k=rnd.choice([1, 3, 8, 40])))) for k in range(n)]


@pytest.mark.parametrize("together,block", [(512, 1 << 13), (2, 64), (1, 7)])
def test_query_matches_brute_force(spark, tmp_path, together, block):
    rnd = random.Random(block)
    docs = [*corpus(rnd), (None, "w3 zz"), (None, None), (900, None), (901, ""), (902, " - "), (5, "w1 w7 É"), (5, "w1 w7 É"), (903, "w2 " * 5000)]
    docs += [(1000 + k, "equal words w9") for k in range(30)]  # ties, more of them than are asked for
    items = [(k, " ".join(rnd.choices(["w1", "W9", "zz", "éé", "ÉÉ", "a1", "w55", "nowhere", "Equal"], k=rnd.randint(1, 6)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (3, "w2"), (None, "w30 w31")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    stats = ii.statistics(a)
    index, _ = common.materialize(ii.build(a, stats, block_docs=block), "impacts")
    assert rows_of(ii.search(index, b, stats, together=together, block_docs=block)) == brute(docs, items)


def test_registered_query(spark, tmp_path):
    from cadenza.llm import queries

    rnd = random.Random(4)
    docs, items = corpus(rnd, 120), [(k, f"w{k} w{k * 3} ünï Ünï") for k in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows_of(queries.op11_impact_search(spark, str(tmp_path))) == brute(docs, items)


def test_slices_add_like_numbers():
    rng = np.random.default_rng(1)
    sums, plain = np.zeros((3, 40, 2), "<u8"), np.zeros((3, 128), np.int64)
    for _ in range(40):
        at = np.sort(rng.choice(128, rng.integers(1, 100), replace=False)).astype("<u2")
        value, w, own = rng.integers(0, 10**6, len(at)), int(rng.integers(0, 9000)), rng.choice(3, rng.integers(1, 4), replace=False)
        ii.add(sums, own, ii.times(ii.spread(at.tobytes(), ii.sliced(value), 2), w))
        for k in own:
            plain[k, at] += value * w
    for k in range(3):
        for top in (1, 5, 64, 500):
            at, score = ii.best(sums[k], top)
            want = [x for x in np.lexsort((np.arange(128), -plain[k]))[:top].tolist() if plain[k, x]]
            assert sorted(at.tolist()) == sorted(want) and (plain[k, at] == score).all()


def test_terms_side_by_side_multiply_and_gather_like_numbers():
    rng = np.random.default_rng(2)
    terms = []
    for n in (1, 63, 64, 65, 128, 5, 100):
        at = np.sort(rng.choice(128, n, replace=False)).astype("<u2")
        terms.append((at, rng.integers(0, 10**6, n), int(rng.integers(1, 9000))))
    for together in (1, 500, 1 << 18):
        sums, carries, room, plain = np.zeros((2, 40, 2), "<u8"), np.zeros((2, 40, 2), "<u8"), np.zeros((40, 128), np.uint8), np.zeros((2, 128), np.int64)
        found = ii.products([ii.sliced(v) for _, v, _ in terms], [w for *_, w in terms], together)
        for k, ((at, value, w), own) in enumerate(zip(terms, found, strict=True)):
            x = ii.placed(at, own, room)
            assert not room.any()
            for s in range(2) if k % 2 else [0]:
                ii.gather(sums[s], carries[s], x)
                plain[s, at] += value * w
        ii.settle(sums, carries)
        for s in range(2):
            at, score = ii.best(sums[s], 128)
            assert sorted(at.tolist()) == np.flatnonzero(plain[s]).tolist() and (plain[s, at] == score).all()


def test_terms_are_counted_outside_the_jvm(spark):
    docs = spark.createDataFrame([("a-b É2\u00a0x  ",), ("",), (None,), ("--",), ("漢 字",)], "text string")
    assert ii.statistics(docs) == (2, 5) and ii.statistics(docs.where("false")) == (0, 0)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, block int"), spark.createDataFrame([("x", "a", 1)], "item_id string, text string, rank int")
    assert [tuple(r)[:3] for r in ii.rank(docs, items).collect()] == [("x", 1, 1)]
    assert ii.rank(docs.where("false"), items).count() == ii.rank(docs, items.where("false")).count() == 0
    assert ii.rank(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
