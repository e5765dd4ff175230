"""The queries of the catalogue engine, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fuzzy, hashing, text
from .functions.text import fold, fold_sql
from .operators import browse, edit, order, rawtags
from .plans.search import parse, search, search_scored
from .plans.tracks import SQL, tracks
from .sources import contents, samples, scan, store
from .streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_WITH = f"WITH {SQL}\n"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _f(c: str) -> str:
    return fold_sql(c)


def _le(n: str) -> list[str]:
    """Bytes of a number, the least significant first."""
    return [f"(({n} >> {8 * k}) & 255)" for k in range(8)]


def _fnv(x: str, more: list[str] = ()) -> str:
    """64-bit FNV-1a of an ASCII text, and of further bytes."""
    codes = f"list_transform(range(1, length({x}) + 1), lambda i: CAST(ord(substr({x}, i, 1)) AS UHUGEINT))"
    codes = f"list_concat({codes}, [{', '.join(f'CAST({b} AS UHUGEINT)' for b in more)}])" if more else codes
    start, step = "CAST(14695981039346656037 AS UHUGEINT)", "(xor(h, x) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)"
    return f"lower(to_hex(CAST(list_reduce(list_prepend({start}, {codes}), lambda h, x: {step}) AS UBIGINT)))"


_COLS = ["path", "title", "artist", "album", "year", "track_no"]
_LIST = ", ".join(_COLS)
_BARE = ["title", "artist", "album_artist", "album", "genre", "composer", "comment"]


def _any(value: str) -> str:
    return "(" + " OR ".join(f"contains({_f(c)}, '{value}')" for c in _BARE) + ")"


#: name: (query in the search language, its condition in SQL)
SEARCHES = {
    "search_all": ("", "TRUE"),
    "search_contains": ("ring", _any("ring")),
    "search_bare": ("supplier#00000000 machinery", f"{_any('supplier#00000000')} AND {_any('machinery')}"),
    "search_field": ('artist:"supplier#00000001"', f"contains({_f('artist')}, 'supplier#00000001')"),
    "search_prefix": ("album:^brand#1", f"starts_with({_f('album')}, 'brand#1')"),
    "search_suffix": ("artist:7$", f"ends_with({_f('artist')}, '7')"),
    "search_exact": ('album:"^brand#12$"', f"{_f('album')} = 'brand#12'"),
    "search_empty": ("composer:", "composer = ''"),
    "search_negate": ("-composer:machinery", f"NOT contains({_f('composer')}, 'machinery')"),
    "search_numeric_eq": ("year:1995", "year = 1995"),
    "search_numeric_lt": ("year:<1994", "year < 1994"),
    "search_numeric_lte": ("track:<=2", "track_no <= 2"),
    "search_numeric_gt": ("year:>1996", "year > 1996"),
    "search_numeric_gte": ("disc:>=2", "disc >= 2"),
    "search_numeric_range": ("year:1994-1996", "year BETWEEN 1994 AND 1996"),
    "search_numeric_none": ("year:", "year = 0"),
    "search_numeric_never": ("year:abc", "FALSE"),
    "search_compilation": ("compilation:1", "compilation"),
    "search_and": ('artist:^supplier year:>1995 -composer:machinery genre:small', f"starts_with({_f('artist')}, 'supplier') AND year > 1995 AND NOT contains({_f('composer')}, 'machinery') AND contains({_f('genre')}, 'small')"),
    "search_anchored_bare": ("^brand#2", "(" + " OR ".join(f"starts_with({_f(c)}, 'brand#2')" for c in _BARE) + ")"),
}
for _name, (_query, _where) in SEARCHES.items():
    _add(_name, lambda s, d, q=_query: search(tracks(s, d), q).select(*_COLS), f"{_WITH}SELECT {_LIST} FROM tracks WHERE {_where}")

_add("sort_multi", lambda s, d: order.page(search(tracks(s, d), "year:>1994"), order.track_keys("-year,artist,track"), 50, 10).items.select(*_COLS),
     f"{_WITH}SELECT {_LIST} FROM tracks WHERE year > 1994 ORDER BY year DESC, {_f('artist')}, disc, track_no, path LIMIT 50 OFFSET 10")
_add("page_offset", lambda s, d: order.page(tracks(s, d), order.track_keys(None), 100, 300).items.select(*_COLS), f"{_WITH}SELECT {_LIST} FROM tracks ORDER BY path LIMIT 100 OFFSET 300")
_add("sort_duration", lambda s, d: order.page(tracks(s, d), order.track_keys("-duration,size"), 40).items.select("path", "duration_ms", "size"), f"{_WITH}SELECT path, duration_ms, size FROM tracks ORDER BY duration_ms DESC, size, path LIMIT 40")

_CREDIT = "CASE WHEN album_artist <> '' THEN album_artist WHEN compilation THEN 'Various Artists' ELSE artist END"
_VOTE = f"""count(*) FILTER (album_artist = '' AND compilation) AS by_flag, count(*) FILTER (album_artist <> '') AS by_aa, count(*) FILTER ({fold_sql('artist')} = {fold_sql('who')}) AS by_artist"""
_FIELD = "CASE WHEN by_flag > 0 AND by_flag >= by_aa AND by_flag >= by_artist THEN 'compilation' WHEN by_aa >= by_artist THEN 'albumartist' ELSE 'artist' END"
_ALBUMS = f"""{_WITH}, c AS (SELECT *, {_CREDIT} AS who FROM tracks),
g AS (SELECT {_f('who')} AS a, {_f('album')} AS b, arg_min(album, path) AS album, arg_min(who, path) AS artist, CAST(coalesce(min(year) FILTER (year > 0), 0) AS INTEGER) AS year,
  count(*) AS tracks, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (has_art) AS with_art, {_VOTE} FROM c GROUP BY 1, 2),
albums AS (SELECT album, artist, year, tracks, duration_ms, with_art,
  CASE WHEN {_FIELD} = 'compilation' THEN 'compilation:1 ' WHEN artist = '' THEN '' ELSE {_FIELD} || ':"' || artist || '" ' END || 'album:"' || album || '"' AS query FROM g)"""
_ALBUM_COLS = ["album", "artist", "year", "tracks", "duration_ms", "with_art", "query"]
_add("albums", lambda s, d: browse.albums(tracks(s, d)).select(*_ALBUM_COLS), f"{_ALBUMS} SELECT * FROM albums")
_add("albums_sorted", lambda s, d: order.page(browse.albums(tracks(s, d)), order.album_keys("-tracks,album,artist"), 30).items.select(*_ALBUM_COLS), f"{_ALBUMS} SELECT * FROM albums ORDER BY tracks DESC, {_f('album')}, {_f('artist')} LIMIT 30")
_add("album_ids", lambda s, d: browse.albums(tracks(s, d)).select("id", "sample_track_id", "album", "artist"),
     f"{_ALBUMS}, i AS (SELECT {_f('who')} AS a, {_f('album')} AS b, arg_min(album, path) AS album, arg_min(who, path) AS artist, min(path) FILTER (has_art) AS sample FROM c GROUP BY 1, 2) SELECT {_fnv('a || chr(0) || b')} AS id, CASE WHEN sample IS NULL THEN '' ELSE {_fnv('sample')} END AS sample_track_id, album, artist FROM i")
_add("artists", lambda s, d: browse.artists(tracks(s, d)).select("name", "albums", "tracks", "duration_ms", "with_art", "query"), f"""{_WITH}, c AS (SELECT *, {_CREDIT} AS who FROM tracks),
g AS (SELECT {_f('who')} AS a, arg_min(who, path) AS name, count(DISTINCT {_f('album')}) FILTER (album <> '') AS albums, count(*) AS tracks, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (has_art) AS with_art, {_VOTE} FROM c GROUP BY 1)
SELECT name, albums, tracks, duration_ms, with_art, CASE WHEN {_FIELD} = 'compilation' THEN 'compilation:1' WHEN name = '' THEN 'artist: albumartist:' ELSE {_FIELD} || ':"^' || name || '$"' END AS query FROM g""")

_FOLDER = ["path", "name", "tracks", "descendants", "bytes", "duration_ms", "with_art", "albums", "artists", "folders", "query"]


def _folders_sql(parent: str | None, root: str) -> str:
    child = f"'{parent}/' || string_split(substr(dir, {len(parent or '') + 2}), '/')[1]" if parent else f"CASE WHEN starts_with(dir, '{root}/') OR dir = '{root}' THEN '{root}' ELSE dir END"
    keep = f"starts_with(dir, '{parent}/')" if parent else "TRUE"
    return f"""{_WITH}, d AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM tracks), c AS (SELECT *, {child} AS child FROM d WHERE {keep})
SELECT child AS path, regexp_extract(child, '([^/]*)$', 1) AS name, count(*) FILTER (dir = child) AS tracks, count(*) AS descendants, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (has_art) AS with_art,
  count(DISTINCT {_f('album')}) FILTER (dir = child AND album <> '') AS albums, count(DISTINCT {_f('artist')}) FILTER (dir = child AND artist <> '') AS artists,
  count(DISTINCT string_split(substr(dir, length(child) + 2), '/')[1]) FILTER (dir <> child) AS folders, 'path:"^' || child || '/"' AS query FROM c GROUP BY child"""


_add("folders_root", lambda s, d: browse.folders(tracks(s, d), roots=("/music",)).select(*_FOLDER), _folders_sql(None, "/music"))
_add("folders_child", lambda s, d: browse.folders(tracks(s, d), "/music").select(*_FOLDER), _folders_sql("/music", ""))
_add("folders_deep", lambda s, d: browse.folders(tracks(s, d), "/music/ASIA").select(*_FOLDER), _folders_sql("/music/ASIA", ""))


def _duplicates_sql(keys: dict[str, str]) -> str:
    names = ", ".join(keys)
    return f"""{_WITH}, k AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in keys.items())} FROM tracks), g AS (SELECT * FROM k WHERE {' AND '.join(f"{n} IS NOT NULL AND {n} <> ''" for n in keys)})
SELECT concat_ws(' — ', {names}) AS key, count(*) AS tracks, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) - max(size) AS BIGINT) AS wasted, array_to_string(list_sort(list(path))[1:20], '|') AS items FROM g GROUP BY {names} HAVING count(*) >= 2"""


def _duplicates(s: SparkSession, d: str, by: str | None, bucket: int = 2) -> DataFrame:
    return browse.duplicates(tracks(s, d, once=True), by, bucket=bucket).select("key", "tracks", "bytes", "wasted", F.array_join("items", "|").alias("items"))


_SECONDS = "CASE WHEN duration_ms > 0 THEN CAST(CAST(duration_ms // 1000 AS BIGINT) // {} AS VARCHAR) END"
_add("duplicates_default", lambda s, d: _duplicates(s, d, None), _duplicates_sql({"k1": _f("artist"), "k2": _f("title")}))
_add("duplicates_size", lambda s, d: _duplicates(s, d, "title,size"), _duplicates_sql({"k1": _f("title"), "k2": "CAST(size AS VARCHAR)"}))
_add("duplicates_duration", lambda s, d: _duplicates(s, d, "artist,duration,year", 60), _duplicates_sql({"k1": _f("artist"), "k2": _SECONDS.format(60), "k3": "CASE WHEN year = 0 THEN '' ELSE CAST(year AS VARCHAR) END"}))
_add("duplicate_totals", lambda s, d: browse.duplicate_totals(browse.duplicate_groups(tracks(s, d))), f"SELECT count(*) AS groups, CAST(sum(tracks) AS BIGINT) AS tracks, CAST(sum(wasted) AS BIGINT) AS wasted FROM ({_duplicates_sql({'k1': _f('artist'), 'k2': _f('title')})})")
_add("duplicates_text", lambda s, d: s.read.parquet(f"{d}/documents.parquet").groupBy(fold(F.col("text")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1").select(F.sha2("k", 256).alias("key"), "n", "first"),
     f"SELECT sha256({_f('text')}) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")

_add("values", lambda s, d: browse.values(tracks(s, d), "genre"), f"{_WITH}SELECT genre AS value, {_f('genre')} AS folded, count(*) AS tracks FROM tracks WHERE genre <> '' GROUP BY genre")
_add("values_year", lambda s, d: browse.values(tracks(s, d), "year").select("value", "tracks"), f"{_WITH}SELECT CAST(year AS VARCHAR) AS value, count(*) AS tracks FROM tracks WHERE year <> 0 GROUP BY year")
_VALUES = f"{_WITH}, v AS (SELECT artist AS value, {_f('artist')} AS folded, count(*) AS tracks FROM tracks WHERE artist <> '' GROUP BY artist)"
_add("complete_prefix", lambda s, d: browse.complete(tracks(s, d), "artist", "Supplier#00000", 10), f"{_VALUES} SELECT value, tracks FROM v WHERE starts_with(folded, 'supplier#00000') ORDER BY tracks DESC, folded, value LIMIT 10")
_add("complete_substring", lambda s, d: browse.complete(tracks(s, d), "artist", "00001", 5), f"{_VALUES}, w AS (SELECT * FROM v WHERE contains(folded, '00001') ORDER BY folded, value LIMIT 20) SELECT value, tracks FROM w ORDER BY tracks DESC, folded, value LIMIT 5")
_DISTINCT = "count(DISTINCT {0}) FILTER ({0} <> '') AS {0}s"
_add("stats", lambda s, d: browse.stats(tracks(s, d)), f"""{_WITH}SELECT count(*) AS tracks, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(*) FILTER (has_art) AS with_art, {', '.join(_DISTINCT.format(c) for c in ('artist', 'album', 'genre'))},
{', '.join(f"count(*) FILTER ({c} = '') AS missing_{c}" for c in ('title', 'artist', 'album', 'album_artist', 'genre', 'composer'))}, count(*) FILTER (year = 0) AS missing_year, count(*) FILTER (track_no = 0) AS missing_track FROM tracks""")
_add("formats", lambda s, d: browse.formats(tracks(s, d)), f"{_WITH}SELECT format, count(*) AS tracks FROM tracks GROUP BY format")
_add("artwork_summary", lambda s, d: browse.artwork_summary(tracks(s, d).withColumn("art", F.when(F.col("has_art"), F.col("album").cast("binary")))).groupBy((F.col("image").isNull()).alias("without")).agg(F.count(F.lit(1)).alias("images"), F.sum("tracks").alias("tracks"), F.sum("bytes").alias("bytes")),
     f"{_WITH}, g AS (SELECT CASE WHEN has_art THEN album END AS image, count(*) AS n FROM tracks GROUP BY 1) SELECT image IS NULL AS without, count(*) AS images, CAST(sum(n) AS BIGINT) AS tracks, CAST(sum(coalesce(strlen(image), 0)) AS BIGINT) AS bytes FROM g GROUP BY 1")

_add("selector_ids", lambda s, d: (lambda t: edit.resolve(t, edit.Selector(ids=edit.with_id(t.where("track_no = 1")))).select("path"))(tracks(s, d)), f"{_WITH}SELECT path FROM tracks WHERE track_no = 1")
_add("selector_exclude", lambda s, d: (lambda t: edit.resolve(t, edit.Selector(query="year:1995", exclude_ids=edit.with_id(t.where("disc = 2")))).select("path"))(tracks(s, d)), f"{_WITH}SELECT path FROM tracks WHERE year = 1995 AND disc <> 2")


def _batch(s: SparkSession, d: str) -> DataFrame:
    return edit.plan_set(search(tracks(s, d), "year:>1996"), {"albumartist": "Various", "comment": None, "track": "3"})


_add("batch_set_plan", lambda s, d: _batch(s, d).select("path", "status", F.coalesce(F.element_at("changes", F.lit("albumartist")), F.lit("-")).alias("to_artist"), F.coalesce(F.element_at("before", F.lit("albumartist")), F.lit("-")).alias("was_artist"), F.coalesce(F.element_at("changes", F.lit("track")), F.lit("-")).alias("to_track")),
     f"{_WITH}SELECT path, 'changed' AS status, 'Various' AS to_artist, CASE WHEN album_artist = '' THEN '-' ELSE album_artist END AS was_artist, CASE WHEN track_no = 3 THEN '-' ELSE '3' END AS to_track FROM tracks WHERE year > 1996")
_add("batch_set_report", lambda s, d: edit.report(edit.plan_set(search(tracks(s, d), "year:>1996"), {"track": "3", "comment": None})).select("matched", "changed", "same"), f"{_WITH}SELECT count(*) AS matched, count(*) FILTER (track_no <> 3) AS changed, count(*) FILTER (track_no = 3) AS same FROM tracks WHERE year > 1996")
_add("batch_set_apply", lambda s, d: (lambda t: edit.apply(t, edit.plan_set(search(t, "year:>1996"), {"albumartist": "Various"})))(tracks(s, d)).groupBy("album_artist").agg(F.count(F.lit(1)).alias("n")), f"{_WITH}SELECT CASE WHEN year > 1996 THEN 'Various' ELSE album_artist END AS album_artist, count(*) AS n FROM tracks GROUP BY 1")


def _restored(s: SparkSession, d: str) -> DataFrame:
    t = tracks(s, d, once=True)
    plan = edit.plan_set(search(t, "year:>1996"), {"albumartist": "Various", "year": "1901"})
    return edit.restore(edit.apply(t, plan), edit.journal(plan))


_add("journal_restore", lambda s, d: _restored(s, d).groupBy("album_artist", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), f"{_WITH}SELECT album_artist, year, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM tracks GROUP BY 1, 2")
_add("split_titles", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", edit.split_title("$artist $title", F.col("p_name")).alias("m")).select("p_partkey", F.element_at("m", F.lit("artist")).alias("artist"), F.element_at("m", F.lit("title")).alias("title")),
     "SELECT p_partkey, nullif(regexp_extract(trim(p_name), '^(.+?) (.+)$', 1), '') AS artist, nullif(regexp_extract(trim(p_name), '^(.+?) (.+)$', 2), '') AS title FROM part")
_NAME = """CASE WHEN album_artist = '' THEN artist ELSE album_artist END || '/' || album || '/' || lpad(CAST(track_no AS VARCHAR), 2, '0') || ' ' || title"""
_RENAME = f"""{_WITH}, r AS (SELECT path, album <> '' AS complete, '/music/' || {_NAME} || '.' || format AS dest FROM tracks),
s AS (SELECT *, CASE WHEN complete AND dest <> path THEN row_number() OVER (PARTITION BY dest, complete AND dest <> path ORDER BY path) END AS claim FROM r),
p AS (SELECT path, CASE WHEN NOT complete THEN 'incomplete' WHEN dest = path THEN 'same' WHEN claim > 1 THEN 'collision' ELSE 'changed' END AS status, dest FROM s)"""


def _rename(s: SparkSession, d: str) -> DataFrame:
    return edit.plan_rename(tracks(s, d), "$albumartist/$album/$track $title", ("/music",))


_add("rename_plan", lambda s, d: _rename(s, d).where("status = 'changed'").select("path", "dest"), f"{_RENAME} SELECT path, dest FROM p WHERE status = 'changed'")
_add("rename_collisions", lambda s, d: _rename(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"{_RENAME} SELECT status, count(*) AS n FROM p GROUP BY status")


def _before(s: SparkSession, d: str) -> DataFrame:
    """The catalogue as it was: a seventh of the files had another size, another seventh was not there."""
    k = F.regexp_extract("path", r" ([0-9]+)-[^ ]*$", 1).cast("long") % 7
    return tracks(s, d).withColumn("__k", k).where("__k <> 3").withColumn("size", F.when(F.col("__k") == 5, F.col("size") + 1).otherwise(F.col("size"))).drop("__k")


_OLD = f"{_WITH}, n AS (SELECT *, CAST(regexp_extract(path, ' ([0-9]+)-[^ ]*$', 1) AS BIGINT) % 7 AS k FROM tracks)"
_add("scan_reused", lambda s, d: scan.unchanged(tracks(s, d), _before(s, d)).select("path", "size"), f"{_OLD} SELECT path, size FROM n WHERE k NOT IN (3, 5)")
_add("scan_changed", lambda s, d: scan.changed(tracks(s, d), _before(s, d)).select("path", "size"), f"{_OLD} SELECT path, size FROM n WHERE k IN (3, 5)")
_add("scan_counters", lambda s, d: scan.counters(tracks(s, d), _before(s, d)), f"{_OLD} SELECT count(*) AS found, count(*) FILTER (k NOT IN (3, 5)) AS reused, count(*) FILTER (k IN (3, 5)) AS parsed, CAST(0 AS BIGINT) AS removed FROM n")
_add("scan_excluded", lambda s, d: tracks(s, d).where(~scan.excluded(F.col("path"), ["*.opus", "/AFRICA/"])).select("path"), f"{_WITH}SELECT path FROM tracks WHERE NOT ends_with(path, '.opus') AND NOT contains(path, '/AFRICA/')")


def _events(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", (F.col("user_id") % 5).cast("string").alias("epoch"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("type"), F.col("event_id").alias("id"))


_EVENTS = "WITH e AS (SELECT event_id, CAST(user_id % 5 AS VARCHAR) AS epoch, epoch_us(ts) AS tick, event_type AS type FROM events), q AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY tick, event_id) AS seq FROM e)"
_add("event_seq", lambda s, d: ev.numbered(_events(s, d)).select("event_id", "epoch", F.col("seq").cast("long").alias("seq")), f"{_EVENTS} SELECT event_id, epoch, seq FROM q")
_KEPT = f"{_EVENTS}, h AS (SELECT * FROM q WHERE seq > (SELECT max(seq) FROM q AS z WHERE z.epoch = q.epoch) - 256)"


def _kept(s: SparkSession, d: str) -> DataFrame:
    return ev.history(ev.numbered(_events(s, d)))


_add("event_history", lambda s, d: _kept(s, d).select("event_id"), f"{_KEPT} SELECT event_id FROM h")


def _replays(s: SparkSession, d: str) -> DataFrame:
    """Epoch by epoch what a subscriber gets that saw all but the last few events, one that is up to date, one of a lost epoch and one of another run."""
    path = f"{store.shared_dir(s)}/kept-{uuid.uuid4().hex}"
    _kept(s, d).write.parquet(path)
    kept = s.read.parquet(path)
    ends = kept.groupBy("epoch").agg(F.max("seq").alias("n")).orderBy("epoch").collect()  # five epochs
    asked = [ev.replay(kept, r.epoch, r.n - 5 - k) for k, r in enumerate(ends)] + [ev.replay(kept, r.epoch, r.n) for r in ends]
    asked += [ev.replay(kept, "2", 10**9), ev.replay(kept, "9", 5), ev.replay(kept, "1", 5, current="3")]
    out = asked[0]
    for more in asked[1:]:
        out = out.unionByName(more)
    return out.select("type", F.when(F.col("type") != "gap", F.col("seq").cast("long")).alias("seq"), F.col("missed").cast("long").alias("missed"))


_add("event_replay", _replays, f"{_KEPT}, n AS (SELECT epoch, max(seq) AS n, row_number() OVER (ORDER BY epoch) - 1 AS k FROM q GROUP BY epoch) SELECT type, seq, CAST(NULL AS BIGINT) AS missed FROM q JOIN n USING (epoch) WHERE seq > n - 5 - k UNION ALL SELECT 'gap', NULL, -1 UNION ALL SELECT 'gap', NULL, -1")
_add("event_gap", lambda s, d: ev.replay(_kept(s, d), "2", 3).select("type", F.col("missed").cast("long").alias("missed")), f"{_KEPT}, e2 AS (SELECT * FROM h WHERE epoch = '2') SELECT 'gap' AS type, CAST(min(seq) - 4 AS BIGINT) AS missed FROM e2 HAVING min(seq) > 4 UNION ALL SELECT type, NULL FROM e2 WHERE seq > 3 AND (SELECT min(seq) FROM e2) <= 4")
_add("rate_window", lambda s, d: ev.in_window(_events(s, d).withColumn("at", F.col("at") / 1e6), "epoch", seconds=3600).select("event_id", "used"), "WITH e AS (SELECT event_id, user_id % 5 AS epoch, epoch_us(ts) AS tick FROM events) SELECT event_id, count(*) OVER (PARTITION BY epoch ORDER BY tick RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS used FROM e")
_add("rate_spaced", lambda s, d: ev.spaced(_events(s, d).withColumn("at", F.col("at") / 1e6), "epoch", gap=30.0).select("epoch", F.round(F.col("slot"), 3).alias("slot")),
     "WITH e AS (SELECT CAST(user_id % 5 AS VARCHAR) AS epoch, epoch_us(ts) / 1e6 AS tick FROM events), n AS (SELECT epoch, tick, row_number() OVER (PARTITION BY epoch ORDER BY tick) AS k FROM e) SELECT epoch, round(max(tick - k * 30.0) OVER (PARTITION BY epoch ORDER BY k) + k * 30.0, 3) AS slot FROM n")
_add("latest_job", lambda s, d: ev.latest_of_kind(_events(s, d).select(F.col("type").alias("kind"), "id", F.col("at").alias("finished"))).select("kind", "id"), "SELECT event_type AS kind, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY event_type")
_add("ttl_cache", lambda s, d: (lambda e: ev.alive(e.join(e.agg(F.max("at").alias("now")), F.lit(True)).withColumn("at", F.col("at") / 1e6).withColumn("now", F.col("now") / 1e6), F.col("now"), 86400).select("event_id"))(_events(s, d)), "SELECT event_id FROM events WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - 86400000000")

_add("fold_text", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(fold(F.col("text")), 256).alias("folded")), f"SELECT doc_id, sha256({_f('text')}) AS folded FROM documents")
_add("parse_year", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", text.parse_year(F.concat_ws(" ", "url", F.concat(F.lit("p"), (F.col("page_id") % 4000).cast("string")), "html")).alias("year")),
     "WITH r AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(concat_ws(' ', url, 'p' || (page_id % 4000), html), '[0-9]+'), lambda x: CASE WHEN length(x) = 4 THEN CAST(x AS INTEGER) END), lambda y: y BETWEEN 1000 AND 3000) AS ys FROM pages) SELECT page_id, coalesce(ys[1], 0) AS year FROM r")
_GENRES = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in text.GENRES) + "]"
_add("normalise_genre", lambda s, d: s.read.parquet(f"{d}/part.parquet").withColumn("no", (F.col("p_partkey") % 160).cast("string")).select("p_partkey", text.normalise_genre(F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("("), "no", F.lit(")"))).when(F.col("p_size") % 4 == 1, F.col("no")).when(F.col("p_size") % 4 == 2, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).otherwise(F.concat(F.lit("("), "no", F.lit(")"), F.col("p_type")))).alias("genre")),
     f"SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN p_type WHEN 2 THEN p_brand ELSE coalesce({_GENRES}[p_partkey % 160 + 1], CAST(p_partkey % 160 AS VARCHAR)) END AS genre FROM part")
#: What raw tags mean, written out apart from the operator's tables: format, then key=tag.
_RAW_TAGS = {
    "mp3": "TIT2=title TPE1=artist TPE2=albumartist TALB=album TRCK=track TPOS=disc TCON=genre TYER=date TDRC=date TDRL=date TDAT=date TRDA=date TCMP=compilation TCOM=composer TSO2=albumartistsort TSOP=artistsort APIC=artwork COMM=comment USLT=lyrics TPUB=publisher TSSE=encoder TENC=encoder GRP1=grouping TPE4=remixer TOPE=originaldate RVA2=replaygain UFID=musicbrainz POPM=rating WXXX=url PRIV=private GEOB=private CHAP=chapters TFLT= ZZZZ= TT2=title TP1=artist TCP=compilation COM=comment PIC=artwork TXT=lyricist tit2= TITLE="
    " COMM:iTunSMPB=gapless COMM:iTunPGAP=gapless COMM:iTunNORM=soundcheck COMM:iTunes_CDDB_IDs=itunes COMM:my_own=comment COMM:ID3v1_Comment=comment COMM:=comment TXXX:iTunMOVI=itunes TXXX:REPLAYGAIN_TRACK_GAIN=replaygain TXXX:replaygain_album_peak=replaygain TXXX:MusicBrainz_Album_Id=musicbrainz TXXX:MusicIP_PUID=musicbrainz TXXX:Acoustid_Id=acoustid TXXX:Mood=mood TXXX:TCMP=compilation TXXX:comment=comment TXXX:ALBUMARTIST=albumartist TXXX:soundcheck=soundcheck TXXX:WORK= TXXX:= TXXX=",
    "flac": "TITLE=title title=title Artist=artist PERFORMER=artist ENSEMBLE=albumartist TRACKTOTAL=track TOTALDISCS=disc DATE=date YEAR=date RELEASEDATE=date METADATA_BLOCK_PICTURE=artwork PICTURE=artwork DESCRIPTION=comment ORGANIZATION=publisher ENCODED-BY=encoder CONTENTGROUP=grouping MIXARTIST=remixer VERSION=subtitle ORIGINALYEAR=originaldate FMPS_RATING=rating WWW=url LICENSE=copyright REPLAYGAIN_TRACK_PEAK=replaygain MUSICBRAINZ_TRACKID=musicbrainz ACOUSTID_FINGERPRINT=acoustid iTunNORM=soundcheck ITUNSMPB=gapless ITUNES_CDDB=itunes TCMP=compilation gapless=gapless DISCID=",
    "mp4": "©nam=title ©ART=artist aART=albumartist ©alb=album trkn=track disk=disc gnre=genre ©gen=genre ©day=date cpil=compilation soco=composersort covr=artwork ©cmt=comment pgap=gapless ©lyr=lyrics tmpo=bpm cprt=copyright ©too=encoder shwm=movement ©st3=subtitle purl=url chpl=chapters stik=itunes apID=itunes xid_=itunes hdvd=itunes ©NAM= wxyz= ----:iTunSMPB=gapless ----:iTunNORM=soundcheck ----:com.apple.iTunes:iTunPGAP=gapless ----:com.apple.iTunes:tool=itunes ----:com.apple.iTunes:Encoding_Params=itunes ----:com.apple.iTunes:MusicBrainz_Artist_Id=musicbrainz ----:com.apple.iTunes:LABEL=publisher ----:org.example.app:LABEL=publisher ----:org.example.app:own= ----:own= ----=",
    "wav": "TIT2= INAM=",
}
_RAW_ROWS = [(f, *x.replace("_", " ").rsplit("=", 1)) if ":" in x or x.startswith("xid_") else (f, *x.rsplit("=", 1)) for f, tags in _RAW_TAGS.items() for x in tags.split()]


def _raw(s: SparkSession, d: str) -> DataFrame:
    """One raw tag for each part, its format and key dealt out over the list."""
    pairs = F.array(*[F.struct(F.lit(f).alias("format"), F.lit(k).alias("key")) for f, k, _ in _RAW_ROWS])
    rows = s.read.parquet(f"{d}/part.parquet").withColumn("k", F.element_at(pairs, (F.col("p_partkey") % len(_RAW_ROWS) + 1).cast("int")))
    return rows.select(F.concat(F.lit("/"), "p_name", F.lit("/"), (F.col("p_partkey") / 3).cast("long").cast("string")).alias("path"), "k.format", "k.key", F.col("p_brand").alias("value"), F.col("p_size").cast("long").alias("bytes"), F.lit(0).alias("n"), "p_partkey")


_KEPT_TAGS = "'title', 'artist', 'album', 'albumartist', 'track', 'disc', 'genre', 'date', 'compilation', 'composer', 'artwork', 'titlesort', 'artistsort', 'albumsort', 'albumartistsort', 'gapless', 'soundcheck', 'itunes'"
_RAW = f"WITH k(n, format, key, field) AS (VALUES {', '.join(f"({n}, '{f}', '{k}', '{t}')" for n, (f, k, t) in enumerate(_RAW_ROWS))}), r AS (SELECT part.*, k.format, k.key, k.field, '/' || p_name || '/' || CAST(p_partkey // 3 AS VARCHAR) AS path FROM part JOIN k ON k.n = p_partkey % {len(_RAW_ROWS)})"
_add("raw_resolve", lambda s, d: rawtags.strip_plan(_raw(s, d)).select("p_partkey", "format", "key", "field", "kept"), f"{_RAW} SELECT p_partkey, format, key, field, field IN ({_KEPT_TAGS}) AS kept FROM r")
_add("strip_report", lambda s, d: rawtags.strip_report(rawtags.strip_plan(_raw(s, d))).select("format", "key", "field", "tracks", "bytes"),
     f"{_RAW} SELECT format, key, field, count(DISTINCT path) AS tracks, CAST(sum(p_size) AS BIGINT) AS bytes FROM r WHERE field NOT IN ({_KEPT_TAGS}) GROUP BY 1, 2, 3")
_GONE = f"{_RAW}, gone AS (SELECT * FROM r WHERE field NOT IN ({_KEPT_TAGS})), g AS (SELECT path, count(*) AS n FROM gone GROUP BY path), top AS (SELECT * FROM g ORDER BY path LIMIT 5), f AS (SELECT format, count(*) AS n FROM gone GROUP BY format)"
_add("backup_detail", lambda s, d: store.backup_detail(rawtags.journal(rawtags.strip_plan(_raw(s, d)))).select("entries", F.array_join("samples", "|").alias("samples"), F.array_join("notes", "|").alias("notes"), F.array_join(F.transform(F.map_entries("formats"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("formats")),
     f"{_GONE} SELECT (SELECT count(*) FROM g) AS entries, (SELECT string_agg(path, '|' ORDER BY path) FROM top) AS samples, (SELECT string_agg(n || ' tags', '|' ORDER BY path) FROM top) AS notes, (SELECT string_agg(format || '=' || n, ',' ORDER BY format) FROM f) AS formats")
_add("backup_groups", lambda s, d: store.backup_groups(rawtags.journal(rawtags.strip_plan(_raw(s, d)))), f"{_GONE} SELECT key, count(*) AS tracks FROM gone GROUP BY key")


def _unstripped(s: SparkSession, d: str) -> DataFrame:
    """Raw tags after a strip and its undoing, counted by key."""
    plan = rawtags.strip_plan(_raw(s, d))
    return rawtags.unstrip(plan.where("kept"), rawtags.journal(plan)).groupBy("format", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


_add("strip_undone", _unstripped, f"{_RAW} SELECT format, key, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes FROM r GROUP BY 1, 2")
_MEANT = ", ".join(f"('{k}', '{v}')" for k, v in rawtags.MEANINGS.items())
_OLDER = ", ".join(f"('{k}', '{v}')" for k, v in rawtags.V22.items())
_add("frame_meaning", lambda s, d: _raw(s, d).select("p_partkey", "key", rawtags.meaning(F.col("key")).alias("meaning")),
     f"{_RAW}, m(id, says) AS (VALUES {_MEANT}), o(id, later) AS (VALUES {_OLDER}) SELECT p_partkey, key, coalesce(m.says, n.says || ' (v2.2)', 'unknown') AS meaning FROM r LEFT JOIN m ON m.id = key LEFT JOIN o ON o.id = key LEFT JOIN m AS n ON n.id = o.later")
_add("dirty_tracks", lambda s, d: (lambda t: edit.dirty(edit.apply(t, edit.plan_set(search(t, "year:>1996"), {"track": "3"})), t).select("path", "track_no"))(tracks(s, d, once=True, dealt=True)),
     f"{_WITH}SELECT path, CAST(3 AS INTEGER) AS track_no FROM tracks WHERE year > 1996 AND track_no <> 3")
_add("split_multi", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", text.join_multi(text.split_multi(F.concat_ws(";", "p_name", F.lit("  "), "p_brand"))).alias("v")), "SELECT p_partkey, trim(p_name) || '; ' || p_brand AS v FROM part")
_MBID = "lpad(to_hex(p_partkey), 8, '0')"
_add("normalise_mbid", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", text.join_mbids(F.concat(F.lpad(F.hex("p_partkey"), 8, "0"), F.lit("-0000-0000-0000-ABCDEF012345 / nonsense"))).alias("v")), f"SELECT p_partkey, lower({_MBID}) || '-0000-0000-0000-abcdef012345' AS v FROM part")
_add("path_parts", lambda s, d: tracks(s, d).select("path", text.dirname(F.col("path")).alias("dir"), text.basename(F.col("path")).alias("name"), text.format_for(F.col("path")).alias("fmt"), text.format_millis(F.col("duration_ms")).alias("length")),
     f"{_WITH}SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, format AS fmt, CAST(duration_ms // 60000 AS VARCHAR) || ':' || lpad(CAST(duration_ms // 1000 % 60 AS VARCHAR), 2, '0') AS length FROM tracks")
_add("track_id", lambda s, d: tracks(s, d).select("path", hashing.track_id(F.col("path")).alias("id"), hashing.track_version(F.col("path"), F.col("size"), F.col("mod_time")).alias("version")),
     f"{_WITH}SELECT path, {_fnv('path')} AS id, {_fnv('path', _le('size') + _le('mod_time'))} AS version FROM tracks")


def _written(s: SparkSession, d: str) -> DataFrame:
    """Versions of all tracks after two edits of some of them."""
    t = tracks(s, d, once=True)
    plans = [edit.plan_set(search(t, "year:>1996"), {"track": "3"}), edit.plan_set(search(t, "disc:>=2"), {"comment": "seen"})]
    first, second = (p.where("status = 'changed'").select("path") for p in plans)
    return edit.with_version(t, first.unionByName(second).withColumn("n", F.lit(1))).select("path", "version")


_add("live_version", _written, f"{_WITH}, v AS MATERIALIZED (SELECT path, {_fnv('path', _le('size') + _le('mod_time'))} AS base, CAST(year > 1996 AND track_no <> 3 AS BIGINT) + CAST(disc >= 2 AND comment <> 'seen' AS BIGINT) AS n FROM tracks) SELECT path, CASE WHEN n > 0 THEN {_fnv('base', _le('n'))} ELSE base END AS version FROM v")


def _on_files(s: SparkSession, d: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An audio file for each part, under names of all kinds, written and scanned; what ask says of the scanned tracks, as a table."""
    folder = f"{store.shared_dir(s)}/files-{uuid.uuid4().hex}"
    k = F.col("p_partkey")
    of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    path = F.concat(F.lit(f"{folder}/music/"), "p_brand", F.lit(" "), of(_ODD), F.lit("/"), k.cast("string"), F.lit(" "), of(_ODD), F.lit("."), of(_ENDINGS))
    art = F.when(k % 3 == 0, F.concat(F.lit(bytearray(b"\x89PNG\r\n\x1a\n")), F.col("p_brand").cast("binary")))
    rows = s.read.parquet(f"{d}/part.parquet").select(path.alias("path"), of(["mp3", "flac", "mp4", "opus"]).alias("format"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"), (1900 + F.col("p_size")).cast("int").alias("year"), (k % 20 + 1).cast("int").alias("track"), F.concat(F.lit("mood "), k.cast("string")).alias("mood"), F.lpad(k.cast("string"), 8, "0").alias("gapless"), art.alias("art"))
    samples.write_files(rows)
    done = scan.run(s, [f"{folder}/music"])
    asked = ask(done.tracks).withColumn("p_partkey", F.regexp_extract("path", "([0-9]+) [^/]*$", 1).cast("long")).drop("path")
    asked.write.parquet(f"{folder}/asked")
    done.close()
    samples.remove_files(rows)  # by tasks; what is left are empty folders
    store.remove(s, f"{folder}/music")
    return s.read.schema(asked.schema).parquet(f"{folder}/asked")


_ODD, _ENDINGS = ["plain", "a b", "ümläut", "#1", "%20", "[x]", "q?", "st*r", "a:b", "quote\'s"], ["mp3", "flac", "m4a", "opus"]
_K4 = "CASE p_partkey % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'flac' WHEN 2 THEN 'mp4' ELSE 'opus' END"
_add("scan_files", lambda s, d: _on_files(s, d, lambda t: t.select("path", "title", "artist", "genre", "year", "track_no", "format", "has_art", F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"))),
     f"SELECT p_partkey, p_name AS title, p_brand AS artist, p_type AS genre, CAST(1900 + p_size AS INTEGER) AS year, CAST(p_partkey % 20 + 1 AS INTEGER) AS track_no, {_K4} AS format, p_partkey % 3 = 0 AS has_art, p_brand || ' ' || ({str(_ODD[:9])[:-1]}, 'quote''s'])[p_partkey % 10 + 1] AS folder FROM part")
_NATIVE = """WITH t(n, title, artist, genre, date, track, mood, gapless, art) AS (VALUES (0, 'TIT2', 'TPE1', 'TCON', 'TYER', 'TRCK', 'TXXX:Mood', 'COMM:iTunSMPB', 'APIC'), (1, 'TITLE', 'ARTIST', 'GENRE', 'DATE', 'TRACKNUMBER', 'MOOD', 'ITUNSMPB', 'PICTURE'),
  (2, '©nam', '©ART', '©gen', '©day', 'trkn', NULL, '----:iTunSMPB', 'covr'), (3, 'TITLE', 'ARTIST', 'GENRE', 'DATE', 'TRACKNUMBER', 'MOOD', 'ITUNSMPB', 'METADATA_BLOCK_PICTURE')),
p AS (SELECT *, p_partkey % 4 AS k, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS pad, 'mood ' || p_partkey AS moody FROM part JOIN t ON t.n = p_partkey % 4),
r AS (SELECT p_partkey, k, title AS key, 'title' AS field, p_name AS text FROM p UNION ALL SELECT p_partkey, k, artist, 'artist', p_brand FROM p UNION ALL SELECT p_partkey, k, genre, 'genre', p_type FROM p UNION ALL SELECT p_partkey, k, date, 'date', CAST(1900 + p_size AS VARCHAR) FROM p
  UNION ALL SELECT p_partkey, k, track, 'track', CASE k WHEN 2 THEN '' ELSE CAST(p_partkey % 20 + 1 AS VARCHAR) END FROM p UNION ALL SELECT p_partkey, k, mood, 'mood', moody FROM p WHERE mood IS NOT NULL UNION ALL SELECT p_partkey, k, gapless, 'gapless', pad FROM p UNION ALL SELECT p_partkey, k, art, 'artwork', CASE k WHEN 3 THEN NULL ELSE '' END FROM p WHERE p_partkey % 3 = 0)"""
_add("raw_files", lambda s, d: _on_files(s, d, lambda t: rawtags.strip_plan(contents.raw(t)).select("path", "key", "field", F.when(F.col("key") != "METADATA_BLOCK_PICTURE", F.col("text")).alias("text"), "kept")), f"{_NATIVE} SELECT p_partkey, key, field, text, field <> 'mood' AS kept FROM r")
_add("picture_files", lambda s, d: _on_files(s, d, lambda t: contents.covers(contents.pictures(t)).select("path", "kind", "mime", F.sha2("data", 256).alias("hash"), "bytes")),
     "SELECT p_partkey, CAST(3 AS INTEGER) AS kind, 'image/png' AS mime, sha256('\\x89PNG\\x0D\\x0A\\x1A\\x0A'::BLOB || encode(p_brand)) AS hash, CAST(8 + octet_length(encode(p_brand)) AS INTEGER) AS bytes FROM part WHERE p_partkey % 3 = 0")

_P, _N = "'ring'", "4"
_add("fuzzy_substring", lambda s, d: tracks(s, d).select("title").distinct().select("title", F.round(fuzzy.substring_score(fold(F.col("title")), "ring"), 6).alias("score")),
     f"""{_WITH}, t AS (SELECT DISTINCT title, {_f('title')} AS f FROM tracks) SELECT title, CASE WHEN contains(f, {_P}) THEN round(least(1.0, 0.75 + 0.15 * {_N} / strlen(f) + CASE WHEN instr(f, {_P}) = 1 THEN 0.10 WHEN regexp_matches(substr(f, instr(f, {_P}) - 1, 1), '[ \\t_/.,()&\\[\\]\\\\-]') THEN 0.05 ELSE 0.0 END), 6)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM t""")


def _fuzzy_sql(pattern: str, columns: list[str]) -> str:
    """CTEs after tracks: sc(f, s), scores of the distinct folded values of the columns for an ASCII pattern: word by word literal, else its letters in order, else the nearest of the text and its words."""
    edge, places, parts, scores = "[ \\t_/.,()&\\[\\]\\\\-]", [], [], []
    for n, word in enumerate(pattern.split()):
        m, q, top = len(word), f"'{word}'", f"p{n}[len(p{n})]"
        most = (1 + (m >= 7) + (m >= 10)) if 4 <= m <= 64 else -1
        codes = ", ".join(f"[{ord(c)}]" for c in word)
        step = "CASE WHEN a[len(a)] < 0 OR instr(substr(f, a[len(a)] + 1), chr(x[1])) = 0 THEN -1 ELSE a[len(a)] + instr(substr(f, a[len(a)] + 1), chr(x[1])) END"
        places.append(f"list_reduce([[0], {codes}], lambda a, x: list_append(a, {step}))[2:] AS p{n}")
        starts = f"list_filter(range(1, {m} + 1), lambda k: k = 1 OR p{n}[k] <> p{n}[k - 1] + 1)"
        parts.append(f"list_transform({starts}, lambda k: p{n}[k]) AS h{n}, {top} AS e{n}")
        parts.append(f"list_min(list_transform(list_prepend(f, list_filter(regexp_split_to_array(f, '{edge}+'), lambda x: x <> '')), lambda x: damerau_levenshtein(x, {q}))) AS d{n}")
        parts.append(f"CASE WHEN contains(f, {q}) THEN least(1.0, 0.75 + 0.15 * {m} / strlen(f) + CASE WHEN instr(f, {q}) = 1 THEN 0.10 WHEN regexp_matches(substr(f, instr(f, {q}) - 1, 1), '{edge}') THEN 0.05 ELSE 0.0 END)::DOUBLE ELSE 0.0::DOUBLE END AS l{n}")
        at_words = f"len(list_filter(h{n}, lambda x: x = 1 OR regexp_matches(substr(f, x - 1, 1), '{edge}')))::DOUBLE"
        spread = f"CASE WHEN e{n} > 0 THEN 0.35::DOUBLE + 0.25::DOUBLE * {f'({m} - len(h{n}))::DOUBLE / {m - 1}' if m > 1 else '1'} + 0.10::DOUBLE * {at_words} / len(h{n}) + 0.05::DOUBLE * {m} / strlen(f) ELSE 0.0 END"
        typo = f"CASE WHEN d{n} <= {most} THEN 0.20::DOUBLE + 0.50::DOUBLE * (1 - d{n}::DOUBLE / {m}) ELSE 0.0 END"
        scores.append(f"{spread} AS r{n}, {typo} AS t{n}, l{n}")
    count = len(scores)
    best = [f"(CASE WHEN f = '' THEN 0.0 WHEN l{n} > 0 THEN l{n} WHEN r{n} >= 0.45 THEN least(r{n}, 0.74) WHEN t{n} >= 0.45 THEN least(t{n}, 0.74) ELSE 0.0 END)" for n in range(count)]
    mean = best[0] if count == 1 else f"CASE WHEN {' AND '.join(f'{w} > 0' for w in best)} THEN least(({' + '.join(best)}) / {count}, 0.74) ELSE 0.0 END"
    values = " UNION ".join(f"SELECT DISTINCT {_f(c)} AS f FROM tracks" for c in columns)
    return f"vs AS MATERIALIZED ({values}), ps AS MATERIALIZED (SELECT f, {', '.join(places)} FROM vs), ws AS MATERIALIZED (SELECT f, {', '.join(parts)} FROM ps), rs AS MATERIALIZED (SELECT f, {', '.join(scores)} FROM ws), sc AS MATERIALIZED (SELECT f, {mean} AS s FROM rs)"


_RANKED = " UNION ALL ".join(f"SELECT path, {_f(c)} AS f FROM tracks WHERE year > 1993" for c in _BARE)
_add("fuzzy_subsequence", lambda s, d: search_scored(tracks(s, d), "title:~gen").groupBy("title", "score").agg(F.count(F.lit(1)).alias("n")), f"{_WITH}, {_fuzzy_sql('gen', ['title'])} SELECT title, round(s, 3)::DOUBLE AS score, count(*) AS n FROM tracks JOIN sc ON sc.f = {_f('title')} WHERE s > 0 GROUP BY 1, 2")
_add("fuzzy_typo", lambda s, d: search_scored(tracks(s, d), "artist:~suplier#000000012").groupBy("artist", "score").agg(F.count(F.lit(1)).alias("n")), f"{_WITH}, {_fuzzy_sql('suplier#000000012', ['artist'])} SELECT artist, round(s, 3)::DOUBLE AS score, count(*) AS n FROM tracks JOIN sc ON sc.f = {_f('artist')} WHERE s > 0 GROUP BY 1, 2")
_add("fuzzy_rank", lambda s, d: order.page(search_scored(tracks(s, d), '~"smal wigdet" year:>1993'), order.track_keys(None, scored=True), 100).items.select("path", "score"),
     f"{_WITH}, {_fuzzy_sql('smal wigdet', _BARE)}, fs AS ({_RANKED}) SELECT path, round(max(s), 3)::DOUBLE AS score FROM fs JOIN sc USING (f) GROUP BY path HAVING max(s) > 0 ORDER BY score DESC, path LIMIT 100")
_add("art_export", lambda s, d: store.art_export(tracks(s, d)), f"{_WITH}SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, min(path) AS path FROM tracks WHERE has_art GROUP BY 1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist, year and genre terms: filtered, sorted by path, one page."""
    query = 'artist:"supplier" year:>1994 -genre:promo'
    assert parse(query)
    return order.page(search(tracks(spark, sf_dir), query), order.track_keys(None), 100).items.select(*_COLS)
