"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, fingerprints, impact_index, jaccard_join, langid, licenses, line_dedup, packing, periodic_runs, simhash_dedup, substring_dedup, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """Documents that the language model may not learn from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, _read(spark, sf_dir, "benchmark"))
    pairs = F.transform(F.sequence(F.lit(1), (F.size("spans") / 2).cast("int")), lambda k: F.element_at("spans", k * 2) - F.element_at("spans", k * 2 - 1))
    n_hit = F.when(F.size("spans") > 0, F.aggregate(pairs, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def tokenizer_path() -> str:
    """The vocabulary that packing uses unless it is given another; it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classify(_read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))), key=F.col("doc_id"))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    found = chat.digest(chat.examples(own.unionByName(extra)))
    return found.select(
        "conv_id",
        F.col("n").alias("n_turns"),
        F.sha2("all", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
        F.col("expanded").alias("expanded_chars"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "clean_text")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = common.materialize(fingerprints.edited(_read(spark, sf_dir, "documents")), "fingerprints")
    asked = F.coalesce(F.pmod("doc_id", F.lit(100)) == 0, F.lit(False))
    near = fingerprints.near_counts(rows, asked)
    found = rows.join(near, "fp", "left")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.hexed(F.col("fp")).alias("fingerprint"),
        fingerprints.hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(asked, F.col("n_near") - 1).alias("n_near"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = common.scratch(spark, "warc")
    found = warc.read_back(warc.archive(pages, folder), folder)
    # what a response's payload says of itself counts; a revisit has only what its header says
    return found.select(F.col("page").cast("long").alias("page_id"), F.coalesce("own_size", "size").alias("payload_bytes"), F.coalesce("own_digest", "digest").alias("payload_digest"), "record_type", F.col("refers").cast("long").alias("refers_to"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.transform("matches", lambda m: F.concat_ws(":", m["license"], F.format_string("%.6f", m["score"]), m["first"].cast("string"), m["last"].cast("string")))
    return found.select("doc_id", F.size("matches").alias("n_matches"), F.array_join(listed, ",").alias("matches"), F.round(F.array_max(F.transform("matches", lambda m: m["score"])), 6).alias("score"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"), "clean_text")


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.rank(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classify(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one text in ten, told by its id, repeats a stretch of its words to its end."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    told = docs.select("doc_id", "text", F.when((crc % 10 == 0) & F.col("text").isNotNull(), words).alias("w"), F.floor(crc / 10).alias("g"))
    n = F.size("w").cast("long")
    begin = F.col("g") % n
    period = 1 + F.floor((n - begin) / (3 + F.col("g") % 8))
    placed = told.withColumn("a", F.when(n > 0, begin)).withColumn("p", F.when(n > 0, period))
    repeated = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(with_periods(_read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pack": op2_pack,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_language_id": op4_language_id,
    "op5_chat": op5_chat,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_warc": op8_warc,
    "op9_licenses": op9_licenses,
    "op10_line_dedup": op10_line_dedup,
    "op11_impact_search": op11_impact_search,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Letters outside ASCII in the test texts; DuckDB's levenshtein counts bytes, so each becomes one byte first.
_LETTERS = "ÇÈÉÊÑÓÖÜßäçèéêíñóöüÄÍáúàâôûîùÁ"
_AS_BYTES = " || ".join(f"chr({k + 1})" for k in range(len(_LETTERS)) if k + 1 != 10)


def _values(rows: dict[str, list[str]]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, grams))}], {', '.join(map(str, licenses.bounds(len(grams))))})" for name, grams in rows.items())


ORACLE_SQL: dict[str, str] = {
    "op5_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|<(\||/?s>)|\[/?INST\]|<<?/?SYS>>')) + len(regexp_extract_all(text, '<</?SYS>>')) AS escaped FROM c),
f AS (SELECT *, 12 + length(role) + 1 + escaped + 11 AS chars FROM e),
g AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS expanded_chars
FROM g GROUP BY conv_id
""",
    "op9_licenses": f"""
WITH t(license, grams, lo, hi) AS (VALUES {_values({k: licenses.plain_bigrams(v) for k, v in licenses.TEMPLATES.items()})}),
l AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS no FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?:;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS ps FROM documents)),
w AS (SELECT doc_id, no, list_filter(regexp_split_to_array(lower(piece), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM l),
p AS (SELECT doc_id, no, CAST(len(ws) AS INTEGER) AS size, CAST(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY no) AS INTEGER) AS upto FROM w),
f AS (SELECT doc_id, flatten(list(ws ORDER BY no)) AS flat FROM w GROUP BY doc_id),
g AS (SELECT doc_id, list_transform(range(1, len(flat)), lambda k: flat[k] || ' ' || flat[k + 1]) AS pairs FROM f),
c AS (SELECT doc_id, pairs, license, grams, lo, hi FROM g, t WHERE len(list_intersect(list_distinct(pairs), grams)) >= lo),
u AS (SELECT c.doc_id, license, i.no AS first, j.no AS last, grams, list_distinct(pairs[i.upto - i.size + 1 : j.upto - 1]) AS own
  FROM c JOIN p i ON i.doc_id = c.doc_id JOIN p j ON j.doc_id = c.doc_id WHERE i.size > 0 AND j.size > 0 AND i.no <= j.no AND j.upto - i.upto + i.size - 1 BETWEEN lo AND hi),
s AS (SELECT doc_id, license, first, last, 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS score FROM u),
m AS (SELECT doc_id, license, max(score) AS score, min((-score, first, last)) AS best FROM s GROUP BY doc_id, license HAVING max(score) >= 0.8),
n AS (SELECT doc_id, license, score, CAST(best[2] AS INTEGER) AS first, CAST(best[3] AS INTEGER) AS last FROM m),
k AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n AS o WHERE o.doc_id = n.doc_id AND (o.score > n.score OR (o.score = n.score AND o.license < n.license)) AND o.first <= n.last AND n.first <= o.last))
SELECT documents.doc_id, CAST(count(k.license) AS INTEGER) AS n_matches, coalesce(string_agg(license || ':' || printf('%.6f', k.score) || ':' || first || ':' || last, ',' ORDER BY license), '') AS matches, round(max(k.score), 6) AS score
FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id GROUP BY documents.doc_id
""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM r
""",
    "op10_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
d AS (SELECT line, min({{'i': doc_id, 'n': no}}) AS place, length(line) AS len, translate(line, '{_LETTERS.replace(_LETTERS[9], "")}', {_AS_BYTES}) AS bytes FROM l WHERE line <> '' GROUP BY line),
o AS (SELECT line, place, bytes, len AS own, unnest(range(len - 3, len + 4)) AS len FROM d WHERE len >= 10),
gone AS (SELECT DISTINCT o.line FROM o JOIN d ON d.len = o.len AND d.len >= 10 AND d.place < o.place WHERE levenshtein(d.bytes, o.bytes) <= least(3, least(d.len, o.own) // 10)),
marked AS (SELECT l.doc_id, l.no, l.line, coalesce(l.line <> '' AND (gone.line IS NOT NULL OR d.place < {{'i': l.doc_id, 'n': l.no}}), FALSE) AS out
  FROM l LEFT JOIN d ON d.line = l.line LEFT JOIN gone ON gone.line = l.line)
SELECT documents.doc_id, CAST(count(no) AS INTEGER) AS n_lines, CAST(count(no) FILTER (out) AS INTEGER) AS n_removed,
  coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (out), '') AS removed,
  CASE WHEN count(no) FILTER (out) = 0 THEN any_value(text) ELSE coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT out), '') END AS clean_text
FROM documents LEFT JOIN marked ON marked.doc_id = documents.doc_id GROUP BY documents.doc_id
""",
    "op11_impact_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
e AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
f AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM e GROUP BY row, term),
s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY item_id, row)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
""",
    "op12_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] || ' ' || w[k + 3]))) END AS g FROM t),
n AS MATERIALIZED (SELECT md5(array_to_string(g, chr(10))) AS node, min(doc_id) AS least, any_value(g) AS g, any_value(len(g)) AS n FROM s WHERE len(g) > 0 GROUP BY node),
e AS MATERIALIZED (SELECT node, n, unnest(g) AS x FROM n),
c AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT node, node AS other FROM n UNION SELECT reach.node, c.b FROM reach JOIN c ON c.a = reach.other),
named AS (SELECT reach.node, min(n.least) AS component_id FROM reach JOIN n ON n.node = reach.other GROUP BY reach.node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) > 0 THEN named.component_id ELSE s.doc_id END AS component_id
FROM s LEFT JOIN named ON named.node = md5(array_to_string(s.g, chr(10)))
""",
}
