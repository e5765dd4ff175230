import random
import re

import numpy as np
import pytest

from cadenza.llm import common
from cadenza.llm import jaccard_join as jj


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set()


def brute(rows, percent=85):
    """(doc_id, n_shingles, component_id) of all rows, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        known = [x for x in least[find(k)] if x is not None]
        out.append((i, len(sets[k]), (min(known) if known else None) if sets[k] else i))
    return out


def mutated(rnd, words, share):
    return [rnd.choice("xyz") * rnd.randint(2, 9) if rnd.random() < share else w for w in words]


def corpus(rnd):
    rows, passage = [], [f"p{k}" for k in range(30)]
    for _ in range(12):  # families of near copies at all similarities around the limit, chains among them
        own = [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 400)}" for _ in range(rnd.choice([5, 8, 12, 40, 90, 200]))]
        for _ in range(rnd.choice([1, 2, 5, 14])):
            rows.append(mutated(rnd, own, rnd.choice([0, 0.01, 0.02, 0.04])))
            if rnd.random() < 0.3:
                own = rows[-1]
    rows += [[f"u{rnd.randint(0, 10**6)}" for _ in range(60)] + passage for _ in range(25)]  # a passage that many hold
    rows += [passage, passage[:-1], passage[:-4], ["one"], ["One"], ["one", "two"], ["a"] * 50, ["a"] * 60]
    texts = [rnd.choice([" ", "\n", " \t"]).join(r) for r in rows]
    return [*enumerate(texts), (None, texts[0]), (None, "lonely null words here"), (3, texts[3]), (3, "other words under one id"), (700, None), (701, ""), (702, " \n"), (-5, texts[-6])]


@pytest.mark.parametrize("cell,counters", [(3, 1 << 12)])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, cell, counters):
    monkeypatch.setattr(jj, "COUNTERS", counters)
    rows = corpus(random.Random(cell))
    want = brute(rows)
    assert 20 < sum(i != c for i, _, c in want if c is not None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = common.made()
    got = [tuple(r) for r in jj.classify(df, cell=cell).collect()]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert len(common.made()) == len(before) + 1  # the result alone stays


def test_registered_query(spark, tmp_path):
    from cadenza.llm import queries

    rows = corpus(random.Random(8))[:90]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in queries.op12_jaccard_join(spark, str(tmp_path)).collect()) == sorted(brute(rows))


def test_large_group_of_near_copies(spark):
    rnd = random.Random(3)
    own = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(mutated(rnd, own, rnd.choice([0.0, 0.01, 0.03])))) for k in range(400)]
    dealt = {}
    seen = jj.verified
    jj.verified = lambda pairs, *a: dealt.setdefault(len(dealt), pairs.count()) and None or seen(pairs, *a)
    try:
        got = sorted(tuple(r) for r in jj.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        jj.verified = seen
    assert got == sorted(brute(rows))
    assert sum(dealt.values()) < 400 * 6  # not all of their 79,800 pairs


def test_counts_are_packed_whole():
    rng = np.random.default_rng(4)
    for most, share in ((1, 0.01), (1, 0.9), (300, 0.3), (70_000, 0.001), (255, 0.34), (0, 0)):
        counts = np.where(rng.random(jj.CHUNK) < share, rng.integers(0, most + 1, jj.CHUNK), 0).astype(np.uint32)
        back = np.zeros(jj.CHUNK, np.uint64)
        places, own = jj._unpacked(*jj._packed(counts))
        back[places] += own
        assert (back == counts).all()


def test_filters_lose_no_link():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(6, 400))
        base = rng.permutation(1 << 20)[: 2 * n]
        cut = int(rng.integers(0, max(n // 5, 1)))
        x, y = set(base[:n].tolist()), set(base[cut : n + int(rng.integers(0, n // 5 + 1))].tolist())
        if 100 * len(x & y) < 85 * len(x | y):
            continue
        px, py = (sorted(s)[: jj.prefix_size(len(s), 85)] for s in (x, y))
        common_keys = [k for k in px if k in set(py)]
        assert common_keys
        i, j = px.index(common_keys[0]), py.index(common_keys[0])
        assert min(len(x) - i, len(y) - j) >= jj.least_overlap(np.array(len(x)), np.array(len(y)), 85)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e", "kept")], "doc_id long, text string, node string")
    assert [tuple(r) for r in jj.classify(df).collect()] == [(1, 2, 1)]
    assert jj.classify(df.where("false")).columns == ["doc_id", "n_shingles", "component_id"]
    assert jj.classify(df.where("false")).count() == 0
    assert len(next(jj.sets_of([b"x y z " * 40_000]))) == 3


@pytest.mark.parametrize("block", [1, 7, jj.LINKS])
def test_contracted_links_connect_the_same(spark, block):
    rnd = random.Random(5)
    chain = [(k, k + 1) for k in range(-300, 0)]
    links = chain + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(300)] + [(5, 5), chain[0], (2**62, 2**62 + 1)]
    got = [(r.a, r.b) for r in jj.contracted(spark.createDataFrame(links, "a long, b long").repartition(3), block).collect()]

    def least(pairs):
        root = {x: x for p in links for x in p}
        for _ in root:
            low = {x: r for x, r in root.items()}
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
            if low == root:
                return root
            root = low

    assert least(got) == least(links) and all(b < a for a, b in got) and len(got) <= len(links)
    assert jj.contracted(spark.createDataFrame([], "a long, b long"), block).isEmpty()
