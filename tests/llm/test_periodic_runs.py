import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cadenza.llm import periodic_runs as pr


def brute(w):
    """By every period, keeping runs that no run of a divisor of their period holds."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(12, 2 * q) and not any(a <= s and s + n <= a + m and q % p == 0 for a, m, p in out):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def mixed(rnd):
    n = rnd.randint(0, 70)
    w = [rnd.choice("abcdefgh"[: rnd.choice([1, 2, 2, 3, 8])]) for _ in range(n)]
    if rnd.random() < 0.6:
        unit, at = [rnd.choice("abc") for _ in range(rnd.randint(1, 9))], rnd.randint(0, n)
        w[at:at] = (unit * 9)[: rnd.randint(0, 6 * len(unit))]
    return w


def test_runs_match_brute_force():
    rnd = random.Random(5)
    rows = [mixed(rnd) for _ in range(1500)]
    want = [brute(w) for w in rows]
    assert sum(map(bool, want)) > 300
    for (n, runs, rest), w, r in zip(pr.search([" ".join(w).encode() for w in rows]), rows, want, strict=True):
        gone = {k for s, m, q in r for k in range(s + q, s + m)}
        assert (n, runs, rest.decode()) == (len(w), r, " ".join(x for k, x in enumerate(w) if k not in gone))


def test_words_that_defeat_the_hash():
    bits = [0]
    for _ in range(11):
        bits += [1 - x for x in bits]  # equal sums modulo 2**64 for different halves
    fib = ["a", "ab"]
    for _ in range(12):
        fib.append(fib[-1] + fib[-2])
    for w in (bits, list(fib[-1])):
        assert pr.search([" ".join(map(str, w)).encode()])[0][1] == brute(w)
    wrong = pr._Stretch(np.array([1, 2, 3, 1, 2, 4, 1, 2, 3]))
    wrong._equal = lambda i, j, n: True  # every comparison of hashes lies
    assert (wrong.after(0, 3), wrong.after(0, 6), wrong.before(2, 5), wrong.before(3, 6)) == (2, 3, 2, 0)


def test_long_periodic_texts_take_linear_time():
    rnd = random.Random(2)
    for period in (1, 7, 999, 60_000):
        unit = [str(rnd.random()) for _ in range(period)]
        words = (unit * (120_000 // period + 1))[:120_000]
        (start, length, _), *rest = pr.search([" ".join(words).encode()])[0][1]
        assert (start, length, rest) == (0, 120_000, [])


def plain(doc_id, text):
    """The contract's row, word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    one = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *one, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_matches_brute_force(spark, tmp_path):
    from cadenza.llm import queries

    rnd = random.Random(11)
    rows = [(None, "a b " * 9), (-1, None), (-2, ""), (-3, " \t\n"), (-4, "Ü x y\x0b" * 8), (-5, "a a a a a a a a a a a"), (7, "one two " * 6), (7, "one two " * 6)]
    rows += [(k, rnd.choice([" ", "\n", "  "]).join(mixed(rnd))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [plain(*r) for r in rows]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(400)) > 20
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("text", [None, "", "word " * 40])
def test_edge_cases(spark, text):
    df = spark.createDataFrame([(1, text, "kept")], "doc_id long, text string, runs string")
    (row,) = pr.detect(df).collect()
    assert pr.detect(df).columns == ["doc_id", "text", "n_words", "runs", "collapsed_text"]
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed_text) == ((40, [(0, 40, 1)], "word") if text else (0, [], ""))
    assert pr.detect(df.where("false")).count() == 0
