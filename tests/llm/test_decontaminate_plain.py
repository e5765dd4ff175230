import hashlib

from cadenza.llm import decontaminate as dec
from cadenza.llm import queries


def hit_words(text, items, window=10):
    own, hit = dec.words(text.encode() if text else None), set()
    for t in items:
        w = dec.words(t.encode() if t else None)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            p = w[at : at + window]
            for i in range(len(own) - len(p) + 1):
                if own[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
    return hit


def test_query_matches_brute_force(spark, tmp_path):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, "x " + item.upper() + " y"), (2, item[6:]), (3, "short item, twice: short ITEM"), (4, None), (5, ""), (6, item + " " + item), (6, item + " " + item), (7, "alpha beta gamma delta epsilon zeta eta theta iota kap")]
    bench = [(10, item), (9, item), (2, "Short item"), (3, None), (4, "?")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in queries.op1_decontaminate(spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        found = sorted(str(k) for k, x in bench if hit_words(t, [x]))
        n = len(hit_words(t, [x for _, x in bench]))
        want.append((i, len(dec.words((t or "").encode())), n, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), n > 0))
    assert got == sorted(want)


def test_empty_benchmark_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "keep", 5)], "doc_id long, text string, items string, other int")
    none = spark.createDataFrame([], "item_id long, text string")
    r = dec.find(docs, none).first()
    assert (r.n_words, r.spans, list(r["items"]), r.clean_text, r.other) == (2, [], [], None, 5)
    assert dec.clean(docs, none).first() == docs.first()
