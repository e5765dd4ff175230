import hashlib
import random

import pytest
import xxhash

from cadenza.llm import fingerprints as fp


def plain(text):
    words = (text or "").lower().split()
    terms = [(words[k], words[k + 1]) for k in range(len(words) - 1)] or [(w,) for w in words]
    votes, total = [0] * 64, 0
    for t in terms:
        h = 42
        for w in t:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        size = sum(map(len, t))
        weight = 1 + (size > 6) + (size > 12)
        total += weight
        for b in range(64):
            votes[b] += weight * (h >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > total)


def texts(rnd, n):
    vocab = ["a", "of", "river", "été", "longerword", "Stone", "extraordinarily"]
    return ["".join(rnd.choice(vocab) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.choice([0, 1, 2, 40, 300]))) for _ in range(n)]


def test_fingerprint_matches_plain_python(spark):
    rnd = random.Random(2)
    rows = [(t,) for t in [*texts(rnd, 40), None, "", "  ", "word", "x " * 20000]]
    got = fp.fingerprinted(spark.createDataFrame(rows, "t string"), "t", ["t"]).collect()
    assert len(got) == len(rows) and all(r.fp % (1 << 64) == plain(r.t) for r in got)


def test_edited_and_next(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS", 1)
    monkeypatch.setattr(fp, "KNOTS", 4)
    rnd = random.Random(5)
    rows = list(zip([*rnd.sample(range(1000), 50), 10**12, None], texts(rnd, 52), strict=True))
    got = fp.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    want = {}
    for k, (i, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        own = t[: len(t) - half] + after[:half]
        want[i] = (len(t), hashlib.sha256(own.encode()).hexdigest(), plain(t), plain(own), plain(after))
    assert {r.doc_id: (r.n_chars, r.edited_sha256, *(x % (1 << 64) for x in (r.fp, r.edited_fp, r.next_fp))) for r in got} == want


def test_repeated_rows_stay_and_do_not_depend_on_their_order(spark):
    rows = [(1, "a b c")] * 5 + [(2, "a b c")] * 3 + [(None, "x")] * 2 + [(3, None)]
    kind = "doc_id long, text string"
    once, again = (sorted(map(str, fp.edited(spark.createDataFrame(r, kind)).collect())) for r in (rows, rows[::-1]))
    assert once == again and len(once) == len(rows)
    led = fp.with_next(spark.createDataFrame(rows, kind), ["text"]).where("doc_id = 1").collect()
    assert sorted(r.copy for r in led) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (2, 4), (0, 2)])
def test_block_tables_find_all(spark, radius, blocks):
    rnd = random.Random(radius)
    base = [rnd.getrandbits(64) for _ in range(20)]
    all_of = set(base)
    for x in base * 4:
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            x ^= 1 << b
        all_of.add(x)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(x),) for x in all_of], "fp long")
    got = {(r.query % (1 << 64), r.fp % (1 << 64), r.distance) for r in fp.find_near(df, df, radius, blocks).collect()}
    assert got == {(a, b, (a ^ b).bit_count()) for a in all_of for b in all_of if (a ^ b).bit_count() <= radius}


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "only one text1")], "doc_id long, text string")
    r = fp.edited(df).first()
    assert r.edited_sha256 == hashlib.sha256(b"only on" + b"only on").hexdigest() and r.next_fp == r.fp
    assert fp.edited(df.where("false")).count() == 0
    assert fp.edited(df.union(df)).count() == 2


def test_near_counts(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(63) for _ in range(5)]
    rows = []
    for k in range(120):
        x = rnd.choice(base)
        for b in rnd.sample(range(63), rnd.randint(0, 3)):
            x ^= 1 << b
        rows.append((k, x))
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.fp: r.n_near for r in fp.near_counts(df, df.doc_id % 10 == 0).collect()}
    assert got == {x: sum((x ^ y).bit_count() <= 3 for _, y in rows) for k, x in rows if k % 10 == 0}
