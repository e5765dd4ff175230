import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rnd, s, n):
    s = list(s)
    for _ in range(n):
        k, what = rnd.randrange(len(s) + 1), rnd.choice("sid")
        if what == "i" or k == len(s):
            s.insert(k, rnd.choice("abé 漢"))
        elif what == "d":
            del s[k]
        else:
            s[k] = rnd.choice("abé 漢")
    return "".join(s)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_distance(spark, most):
    rnd = random.Random(most)
    pairs = [("", ""), ("", "a"), ("ab", "ba"), ("a" * 70, "a" * 71), ("a" * 70, "b" + "a" * 69)]
    for _ in range(150):
        a = "".join(rnd.choice("abé 漢") for _ in range(rnd.randint(0, 80)))
        pairs.append((a, mutate(rnd, a, rnd.randint(0, most + 2))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ld.edit_distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    for r in got:
        assert r.d == min(distance(r.a, r.b), most + 1), r


def brute(rows, most=3, per_edit=10):
    """By comparing every line with all before it."""
    seen, out = [], []
    for doc_id, text in sorted(rows):
        parts, gone = text.split("\n"), []
        for no, line in enumerate(parts):
            if not line:
                continue
            if any(x == line or (abs(len(x) - len(line)) <= most and distance(x, line) <= min(most, len(x) // per_edit, len(line) // per_edit)) for x in seen):
                gone.append(no)
            seen.append(line)
        out.append((doc_id, len(parts), gone, "\n".join(x for k, x in enumerate(parts) if k not in gone)))
    return out


@pytest.mark.parametrize("most, per_edit", [(1, 10), (2, 7), (3, 10)])
def test_deduplicate_matches_brute_force(spark, most, per_edit):
    """Lines of all lengths, at the borders of the length cells and within a few edits of one another."""
    rnd = random.Random(most)
    sizes = [rnd.randint(1, 40) for _ in range(25)] + [9, 10, 11, 14, 15, 19, 20, 21, 22, 25, 29, 30, 31, 39, 40, 41, 78, 80, 81, 82, 119, 120, 122, 161]
    base = ["".join(rnd.choice("ab cé") for _ in range(n)) for n in sizes]
    rows = []
    for k in range(110):
        lines = [mutate(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3, 4])) for _ in range(rnd.randint(1, 6))] + rnd.choice([[], ["short"], [""]])
        rows.append((k, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("x"))
    got = sorted((r.doc_id, r.n_lines, list(r.removed), r.clean_text) for r in ld.deduplicate(df, threshold=most, per_edit=per_edit).collect())
    assert got == brute(rows, most, per_edit)


def test_edge_cases(spark):
    long = "a line of more than twenty characters"
    rows = [(1, None, "p"), (2, "", "q"), (3, long, "r"), (3, long, "r"), (None, "x\n" + long, "s"), (5, "\n".join([long] * 3), "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = {(r.doc_id, r.n_lines, tuple(r.removed), r.clean_text, r.h1) for r in ld.deduplicate(df).collect()}
    assert got == {(1, 0, (), None, "p"), (2, 1, (), "", "q"), (3, 1, (0,), "", "r"), (None, 2, (), "x\n" + long, "s"), (5, 3, (0, 1, 2), "", "t")}
    assert ld.deduplicate(df).count() == 6
    assert ld.clean(df).columns == df.columns
    assert ld.deduplicate(df.where("false")).count() == 0


def test_a_changed_word_in_the_pipeline(spark):
    import corpus_pipeline

    pair = spark.createDataFrame([(1, "the committee will meet again on Monday"), (2, "the committee will meet again on Sunday")], "doc_id long, text string")
    assert [r.text for r in corpus_pipeline.lines(spark, pair, "").orderBy("doc_id").collect()] == ["the committee will meet again on Monday", ""]


def test_query(spark, tmp_path):
    from cadenza.llm import queries

    rows = [(1, "one\ntwo\none"), (2, "two\n\nthree of them here"), (3, "three or them here"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1, "2", "one\ntwo"), 2: (3, 1, "0", "\nthree of them here"), 3: (1, 1, "0", ""), 4: (0, 0, "", None)}


def test_string_ids_keep_their_order(spark):
    line = "a line that stands in more than one text"
    rows = [("b", line + "!"), ("a", line), ("aaaaaaaaaaaa2", "x\n" + line + "?"), ("aaaaaaaaaaaa1", "one more " + line[:20]), (None, "own")]
    got = {r.doc_id: r.clean_text for r in ld.deduplicate(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": line, "b": "", "aaaaaaaaaaaa2": "x", "aaaaaaaaaaaa1": rows[3][1], None: "own"}


def test_a_family_that_differs_in_a_word_makes_no_pairs(spark):
    """Words of the same letters pass every filter and are further than three edits apart, mostly."""
    rnd = random.Random(4)
    words = {"".join(rnd.sample("etaoinsrhld", 11)) for _ in range(150)}
    rows = [(k, f"a template of many words that all lines share but for {w} and so on to the very end of it") for k, w in enumerate(sorted(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = ld._keyed(docs, "doc_id", "text")
    distinct = ld.classes(keyed, "doc_id", "text", 3, 10).localCheckpoint()
    found = ld.absorbed_lines(keyed, distinct, "doc_id", "text", 3)
    assert found.count() == sum(len(gone) for _, _, gone, _ in brute(rows))
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()  # no list of pairs from which those tried are taken
    assert ld.candidates(distinct, 3, 10).count() <= 16 * len(rows)  # lines at keys; pairs would be 11,175
