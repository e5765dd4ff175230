import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import simhash_dedup as sd


def plain(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint():
    for t in ["", None, "A b", "a B c", "one two three four\n five é É", "x " * 70000 + "y z"]:
        assert sd.fingerprint(t.encode() if t is not None else None) == plain(t)


def brute(pairs):
    """components of (doc_id, fingerprint)"""
    root = {k: k for k, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(pairs):
        for b, y in pairs[:i]:
            if (x ^ y).bit_count() <= 3 and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: find(k) for k in root}


@pytest.mark.parametrize("cell", [16, 4096])
def test_links_and_components(spark, cell):
    rnd = random.Random(cell)
    prints = [0, 7, (1 << 64) - 1]
    for _ in range(60):
        prints.append(rnd.getrandbits(64))
    base = rnd.getrandbits(64)
    for _ in range(300):  # one dense group and chains
        x = rnd.choice([base, rnd.choice(prints)])
        for b in rnd.sample(range(64), rnd.randint(1, 3)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    want = brute(list(enumerate(prints)))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    n, both = sd.bit_statistics(df)
    assert n == len(prints)
    for plan in (sd.allocate(n, both), sd.allocate(n, both, row_cost=0.01)):
        assert sum(p.threshold + 1 for p in plan) == 4
        edges = sd.links(df, plan, cell=cell)
        found = {(r.a, r.b) for r in edges.collect()}
        unsigned = {(a % (1 << 64), b % (1 << 64)) for a, b in found}
        assert all((a ^ b).bit_count() <= 3 for a, b in unsigned)
        number = {x: k for k, x in enumerate(prints)}
        roots, _ = sd.components(edges)
        got = {r.node: r.root for r in roots.collect()}
        groups = {}
        for x in signed:
            groups.setdefault(got.get(x, x), set()).add(number[x % (1 << 64)])
        assert {min(g): g for g in groups.values()} == {k: {i for i in want if want[i] == k} for k in set(want.values())}


def test_classify_edge_cases(spark):
    rows = [(5, None, "x"), (3, "", "y"), (9, "a b c d e f", "z"), (2, "A b c d e f", None), (2, "A b c d e f", None), (None, "quite other words here", "q"), (7, "one", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in sd.classify(df).collect())
    assert got == [(-1, -1), (2, 2), (2, 2), (3, 3), (5, 3), (7, 7), (9, 2)]
    kept = sd.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 2, 3, 7]
    assert sorted(r.doc_id for r in sd.deduplicate(df.where("doc_id = 2")).collect()) == [2]
    assert sd.classify(df.where("false")).count() == 0
    assert sd.deduplicate(df.where("false")).count() == 0


def test_odds_match_independent_bits():
    rnd = np.random.default_rng(1)
    bits = (rnd.random((4000, 64)) < 0.5).astype(float)
    odds = sd.distance_odds(4000, bits.T @ bits, tuple(range(16)))
    assert abs(odds.sum() - 1) < 1e-9 and abs(odds[8] - 0.196) < 0.02


def linked(texts, least=0.8):
    """The least number of each text's group, by all pairs."""
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if sd.similarity((a or "").encode(), (texts[j] or "").encode()) >= least:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def near_copies(rnd, n, words, changes):
    base = [f"w{rnd.randrange(3000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for at in rnd.sample(range(words), rnd.randint(*changes)):
            w[at] = f"x{rnd.randrange(9000)}"
        out.append(" ".join(w))
    return out


def test_deduplicate_matches_brute_force(spark):
    """Pairs near the threshold, on both sides of it, and one large group of near copies; of links few may be missed."""
    rnd = random.Random(5)
    texts = [t for _ in range(60) for t in near_copies(rnd, 2, 150, (1, 6))] + near_copies(rnd, 250, 100, (0, 2)) + ["", None, " \n"]
    rnd.shuffle(texts)
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(k, texts[k], "again") for k in range(0, 40, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    want = linked(texts)
    got = sorted(r.doc_id for r in sd.deduplicate(df).collect())
    assert len(set(got)) == len(got)
    kept = {k for k, r in enumerate(want) if k == r}
    assert kept <= set(got)  # nothing goes that is not linked to what stays
    assert len(set(got) - kept) <= 0.03 * (len(texts) - len(kept))
    big = [want[k] for k, t in enumerate(texts) if t and len(t.split()) == 100]
    assert len(set(big) & set(got)) == len(set(big)) and sum(texts[k] is not None and len(texts[k].split()) == 100 for k in got) == len(set(big))


def test_stage_drops_near_copies_and_keeps_the_rest(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    rows, want, k = [(900, None, "p"), (901, "", "q")], {900}, 0
    for _ in range(12):
        words = [f"w{rnd.randrange(3000)}" for _ in range(120)]
        near, far = list(words), list(words)
        near[40] = near[90] = "changed"  # 106 of 126 shingles are shared: 0.84
        for at in range(5, 120, 20):
            far[at] = "other"
        rows += [(k, " ".join(words), "x"), (k + 1, " ".join(near), "y"), (k + 2, " ".join(far), "z"), (k + 1, " ".join(words), "w")]
        assert sd.similarity(rows[-4][1].encode(), rows[-3][1].encode()) >= 0.8 > sd.similarity(rows[-4][1].encode(), rows[-2][1].encode())
        want |= {k, k + 2}
        k += 3
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_query(spark, tmp_path):
    """The query's digits and components against plain Python."""
    from cadenza.llm import queries

    rnd = random.Random(3)
    texts = [t for _ in range(15) for t in near_copies(rnd, 2, 300, (0, 3))] + ["", None, "Two words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [(k, plain(t)) for k, t in enumerate(texts)]
    want = brute(prints)
    got = queries.op3_simhash_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(k, f"{x:016x}", want[k]) for k, x in prints}


def test_deduplicate_keeps_every_link_of_crowded_groups(spark):
    """Chains whose links are their texts' ninth likeliest partners and fingerprints that lie far apart: no link is missed."""
    rnd = random.Random(8)
    texts = []
    for _ in range(3):
        base, n = [f"w{rnd.randrange(9000)}" for _ in range(220)], 14
        for step in range(6):  # each step's texts are alike at 0.9 and more, and those of the next are alike to one of them alone at 0.8
            texts += [" ".join(base[:-1] + [f"t{step}x{k}"]) for k in range(n)]
            base = base[11:] + [f"v{rnd.randrange(9000)}" for _ in range(11)]
        short = [f"s{rnd.randrange(9000)}" for _ in range(40)]
        texts += [" ".join(short), " ".join(short + ["u1", "u2", "u3", "u4"])]  # 36 of 40 shingles
    rnd.shuffle(texts)
    want = linked(texts)
    got = sorted(r.doc_id for r in sd.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == sorted(set(want))
