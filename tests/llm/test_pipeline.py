import random

import pytest
from test_decontaminate_plain import hit_words
from test_line_dedup import brute as deduped_lines
from test_simhash_dedup import linked

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cadenza.llm import common, decontaminate, langid, queries

PROSE = {
    "en": "the quick brown fox jumps over lazy dogs while every happy farmer sings about corn and rain".split(),
    "de": "der schnelle braune fuchs springt über faule hunde während jeder frohe bauer singt vom regen".split(),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    rows = []

    def text(lang):
        return "\n".join(" ".join(rnd.choice(PROSE[lang]) for _ in range(rnd.randint(3, 14))) + "." for _ in range(rnd.randint(1, 6)))

    for k in range(60):
        lang = rnd.choice(list(PROSE))
        rows.append((k, text(lang), lang, f"s{k % 3}", None))
    item = " ".join(rnd.choice(PROSE["en"]) for _ in range(14))
    rows += [(60 + k, rows[k][1], rows[k][2], "s0", 5) for k in range(6)]  # copies
    rows += [(70, None, "en", "s", 0), (71, "12345 !!!", "en", "s", 9), (72, "", None, None, 0), (73, "intro words here " + item.upper() + " closing words", "en", "s", 1), (73, "intro words here " + item.upper() + " closing words", "en", "s", 1)]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows, item


def test_each_stage_against_plain_python(spark, folder):
    where, rows, item = folder
    docs = spark.read.parquet(f"{where}/documents.parquet").withColumns({c: F.lit("own") for c in ("score", "removed", "items", "spans")})
    columns = docs.columns

    kept = pipeline.language(spark, docs, where).cache()
    model = langid.train(docs.where(~queries.held_out(docs.doc_id)), key=docs.doc_id)
    langs, scores = langid.score_texts(model, [r[1] for r in rows])
    want = sorted((r[0], r[1]) for r, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= 0.5)
    assert kept.columns == columns and sorted((r.doc_id, r.text) for r in kept.collect()) == want
    assert not {70, 71, 72} & {i for i, _ in want} and len(want) >= 60

    cut = pipeline.lines(spark, kept, where).cache()
    plain = {i: t for i, _, _, t in deduped_lines(sorted(set(want)))}
    assert cut.columns == columns and sorted((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == sorted((i, plain[i], len(plain[i])) for i, _ in want)

    unique = pipeline.near_duplicates(spark, cut, where).cache()
    ids = sorted(plain)
    stay = {ids[r] for r in linked([plain[i] for i in ids])}
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == sorted(stay)

    clean = pipeline.contamination(spark, unique, where).cache()
    for r in clean.collect():
        hit = hit_words(plain[r.doc_id], [item])
        assert len(decontaminate.words(r.text.encode())) == len(decontaminate.words(plain[r.doc_id].encode())) - len(hit)
        assert hit or r.text == plain[r.doc_id]

    assert clean.columns == columns and clean.where("score = 'own' and removed = 'own' and items = 'own' and spans = 'own'").count() == clean.count()

    pieces = pipeline.packed(spark, clean, where).collect()
    total = {}
    for r in pieces:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert {r.doc_id: r.doc_tokens for r in pieces} == total and set(total) == stay


def test_run_leaves_one_table(spark, folder):
    where, _, _ = folder
    before = common.made()
    got = pipeline.run(spark, where)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
    assert len(common.made()) == len(before) + 1
