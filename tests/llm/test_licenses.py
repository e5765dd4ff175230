import random
import re

from cadenza.llm import licenses


def brute(text, least, templates=licenses.TEMPLATES):
    """Every unit against every template."""
    if text is None:
        return []
    pieces = [licenses.plain_words(p) for p in re.sub(r"([.!?:;])[ \t\r\n]+", r"\1\n", text).split("\n")]
    found = []
    for name, t in sorted(templates.items()):
        other, best = set(licenses.plain_bigrams(t)), None
        lo, hi = licenses.bounds(len(other), least)
        for i in range(len(pieces)):
            for j in range(i, len(pieces)):
                w = sum(pieces[i : j + 1], [])
                if not pieces[i] or not pieces[j] or not lo <= len(w) - 1 <= hi:
                    continue
                own = set(zip(w, w[1:], strict=False))
                d = 2 * len(own & {tuple(g.split(" ")) for g in other}) / (len(own) + len(other))
                if best is None or (-d, i, j) < best:
                    best = -d, i, j
        if best and best[0] <= -least:
            found.append((name, -best[0], best[1], best[2]))
    better = lambda m, o: o[1] > m[1] or (o[1] == m[1] and o[0] < m[0])
    return [m for m in found if not any(better(m, o) and o[2] <= m[3] and m[2] <= o[3] for o in found)]


def mutated(rnd, text, n):
    w = text.split()
    for _ in range(n):
        k = rnd.randrange(len(w) + 1)
        w[k : k + rnd.randint(0, 1)] = [rnd.choice(["foo", "the", "License,", "and\n"])] * rnd.randint(0, 1)
    return " ".join(w)


def wrapped(text, width):
    w = text.split()
    return "\n".join(" ".join(w[k : k + width]) for k in range(0, len(w), width))


def test_scan_matches_brute_force(spark):
    rnd = random.Random(4)
    rows = [None, "", "one", "word word word", "Übung é " * 5000, "..", "\n\n"]
    names = list(licenses.TEMPLATES)
    for k in range(90):
        parts = [mutated(rnd, licenses.TEMPLATES[names[(k + x) % len(names)]], rnd.choice([0, 0, 1, 3, 12])) for x in range(rnd.randint(1, 2))]
        parts = [wrapped(p, rnd.choice([7, 11, 500])) for p in parts]
        rows.append(rnd.choice(["", "Intro text here. ", "A line\n"]) + rnd.choice(["\n", " Some words between them; "]).join(parts) + rnd.choice(["", "\nAn end.", " and so on"]))
    df = spark.createDataFrame([(t, "x") for t in rows], "text string, matches string")
    scores = []
    for r in licenses.scan(df, least=0.7).collect():
        got = [(m.license, m.score, m.first, m.last) for m in r.matches]
        want = brute(r.text, 0.7)
        assert [(x[0], x[2], x[3]) for x in got] == [(x[0], x[2], x[3]) for x in want], r.text
        assert all(abs(x[1] - y[1]) < 1e-12 for x, y in zip(got, want, strict=True))
        scores += [x[1] for x in got]
    assert any(s == 1 for s in scores) and any(0.8 < s < 1 for s in scores)
    assert licenses.scan(df.where("false")).count() == 0


def test_whole_licences_are_found(spark):
    """Every template, wrapped and between other text, with a holder and a year before it."""
    rows = [(name, f"Name of the work\nCopyright (c) 2020 Somebody\n\n{wrapped(t, 9)}\n\nOther text follows.") for name, t in licenses.TEMPLATES.items()]
    for r in licenses.scan(spark.createDataFrame(rows, "name string, text string")).collect():
        assert len(r.matches) == 1, r
        m = r.matches[0]
        assert m.license.split("/")[0] == r.name.split("/")[0] and m.score > 0.9


def test_query(spark, tmp_path):
    from cadenza.llm import queries

    rows = [(1, licenses.TEMPLATES["MIT/text"]), (2, "nothing here"), (3, None), (4, "Licensed under the MIT License.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_matches, r.matches.split(":")[0], r.score) for r in queries.op9_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "MIT/text", 1.0), 2: (0, "", None), 3: (0, "", None), 4: (1, "MIT/short", 1.0)}
