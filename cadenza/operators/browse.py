"""Views over matching tracks: albums, artists, folders, duplicates, values, completion, statistics, artwork.

Filter first, then group: a group is there if any of its tracks matches, and measures only those. What
depends on an order takes path order, by min_by. Every view is partial aggregation and one shuffle of
groups; identifiers are hashed after grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.hashing import fnv, track_id
from ..functions.text import basename, dirname, fold, fold_text
from ..plans.search import search

VARIOUS = "Various Artists"
MAX_ITEMS = 20


def credited() -> Column:
    """The artist that a track is filed under."""
    return F.when(F.col("album_artist") != "", F.col("album_artist")).when(F.col("compilation"), VARIOUS).otherwise(F.col("artist"))


def _parts(df: DataFrame) -> DataFrame:
    """Tracks grouped by their raw names, with folded ones (a: of who they are filed under, b: of the album), measures and votes.

    Names are folded once for each group, not for each track. The votes are for the fields that may select a group again:
    every track with an album artist votes for that, and every track whose own artist bears the group's name
    for the artist, so a track may vote for both.
    """
    raw = df.groupBy("album_artist", "compilation", "artist", "album").agg(F.min("path").alias("__first"), F.min(F.when(F.col("year") > 0, F.col("year"))).alias("year"), *_measures())
    rows = raw.withColumn("__who", credited()).withColumns({"a": fold(F.col("__who")), "b": fold(F.col("album"))})
    n = F.col("tracks")
    flag = (F.col("album_artist") == "") & F.col("compilation")
    return rows.withColumns({"__flag": F.when(flag, n).otherwise(0), "__aa": F.when(F.col("album_artist") != "", n).otherwise(0), "__own": F.when(fold(F.col("artist")) == F.col("a"), n).otherwise(0)})


def _field() -> Column:
    by_flag, by_aa, by_artist = F.sum("__flag"), F.sum("__aa"), F.sum("__own")
    return F.when((by_flag > 0) & (by_flag >= by_aa) & (by_flag >= by_artist), "compilation").when(by_aa >= by_artist, "albumartist").otherwise("artist")


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("tracks"), F.sum(F.col("duration_ms").cast("long")).alias("duration_ms"), F.count_if("has_art").alias("with_art"), F.min(F.when(F.col("has_art"), F.col("path"))).alias("__sample")]


def _summed() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("tracks", "duration_ms", "with_art")], F.min("__sample").alias("__sample")]


def _sample() -> Column:
    return F.coalesce(track_id(F.col("__sample")), F.lit("")).alias("sample_track_id")


def albums(df: DataFrame, query: str = "") -> DataFrame:
    """id, album, artist, year (the least that is known), tracks, duration_ms, with_art, sample_track_id, query."""
    made = _parts(search(df, query)).groupBy("a", "b").agg(
        F.min_by("album", "__first").alias("album"), F.min_by("__who", "__first").alias("artist"), F.coalesce(F.min("year"), F.lit(0)).alias("year"), *_summed(), _field().alias("__field")
    )
    own = F.concat(F.lit('album:"'), _bare(F.col("album")), F.lit('"'))
    who = F.when(F.col("__field") == "compilation", "compilation:1 ").when(F.col("artist") == "", "").otherwise(F.concat("__field", F.lit(':"'), _bare(F.col("artist")), F.lit('" ')))
    return made.select(fnv(F.concat("a", F.lit("\0"), F.col("b"))).alias("id"), "album", "artist", "year", "tracks", "duration_ms", "with_art", _sample(), F.concat(who, own).alias("query"))


def artists(df: DataFrame, query: str = "") -> DataFrame:
    """id, name, albums, tracks, duration_ms, with_art, sample_track_id, query.

    Albums are counted by grouping twice, which keeps the state of a task to sums.
    """
    parts = _parts(search(df, query)).groupBy("a", "b").agg(F.min(F.struct("__first", "__who")).alias("first"), *_summed(), *[F.sum(v).alias(v) for v in ("__flag", "__aa", "__own")])
    made = parts.groupBy("a").agg(F.min("first").alias("first"), F.count_if(F.col("b") != "").alias("albums"), *_summed(), _field().alias("__field"))
    name = F.col("first.__who")
    again = F.when(F.col("__field") == "compilation", "compilation:1").when(name == "", "artist: albumartist:").otherwise(F.concat("__field", F.lit(':"^'), _bare(name), F.lit('$"')))
    return made.select(fnv(F.col("a")).alias("id"), name.alias("name"), "albums", "tracks", "duration_ms", "with_art", _sample(), again.alias("query"))


def _child(directory: Column, parent: str) -> Column:
    """The child of parent that a directory is at or under, else null."""
    inside = directory.startswith(parent + "/")
    return F.when(inside, F.concat(F.lit(parent + "/"), F.substring_index(F.substring(directory, len(parent) + 2, 1 << 30), "/", 1)))


def _top(directory: Column, roots: list[str]) -> Column:
    """The first root, in their order, that a directory is at or under, else the directory."""
    out = directory
    for r in reversed(roots):
        out = F.when((directory == r) | directory.startswith(r + "/"), r).otherwise(out)
    return out


def folders(df: DataFrame, path: str = "", query: str = "", roots: tuple[str, ...] = ()) -> DataFrame:
    """The folders of one level: path, name, tracks (directly in it), descendants, bytes, duration_ms, with_art, albums, artists, folders, sample_track_id, query."""
    parent = path.strip().rstrip("/")
    rows = search(df, query).withColumn("__dir", dirname(F.col("path")))
    child = _child(F.col("__dir"), parent) if parent else _top(F.col("__dir"), [r.rstrip("/") for r in roots])
    rows = rows.withColumn("child", child).where("child is not null")
    direct = F.col("__dir") == F.col("child")
    below = F.when(~direct, F.substring_index(F.expr("substring(__dir, char_length(child) + 2)"), "/", 1))
    who = F.when(F.col("album_artist") != "", F.col("album_artist")).otherwise(F.col("artist"))
    # what is counted once is grouped by first: a direct track by album and artist, another by the folder below
    keys = {"__album": F.when(direct, fold(F.col("album"))), "__who": F.when(direct, fold(who)), "__below": below}
    parts = rows.withColumns(keys).groupBy("child", *keys).agg(
        F.count_if(direct).alias("tracks"), F.count(F.lit(1)).alias("descendants"), F.sum("size").alias("bytes"), F.sum(F.col("duration_ms").cast("long")).alias("duration_ms"), F.count_if("has_art").alias("with_art"), F.min("path").alias("__sample"),
    )
    made = parts.groupBy("child").agg(
        *[F.sum(c).alias(c) for c in ("tracks", "descendants", "bytes", "duration_ms", "with_art")], F.count_distinct(F.nullif("__album", F.lit(""))).alias("albums"), F.count_distinct(F.nullif("__who", F.lit(""))).alias("artists"), F.count("__below").alias("folders"), F.min("__sample").alias("__sample"),
    )
    return made.select(F.col("child").alias("path"), basename(F.col("child")).alias("name"), "tracks", "descendants", "bytes", "duration_ms", "with_art", "albums", "artists", "folders", _sample(), F.concat(F.lit('path:"^'), _bare(F.col("child")), F.lit('/"')).alias("query"))


def duplicate_fields(by: str | None) -> list[str]:
    """Names of a key: fields of text or number, duration, size; unknown ones and repetitions go; artist and title by default."""
    known = lambda n: "duration" if n in ("duration", "time", "length") else "size" if n == "size" else schema.lookup(n)
    found = [known(x.strip().lower()) for x in (by or "").split(",")]
    return list(dict.fromkeys(f for f in found if f and f not in ("path", "compilation"))) or ["artist", "title"]


def _key_part(name: str, bucket: int) -> Column:
    if name == "duration":
        return F.when(F.col("duration_ms") > 0, F.floor(F.floor(F.col("duration_ms") / 1000) / bucket).cast("string"))
    if name == "size":
        return F.when(F.col("size") > 0, F.col("size").cast("string"))
    return F.nullif(fold(schema.rendered(name)), F.lit(""))


def _keyed(df: DataFrame, by: str | None, query: str, bucket: int) -> tuple[DataFrame, list[str], list[str]]:
    """The tracks that have a whole key, the names of its parts, and the columns that hold them."""
    names = duplicate_fields(by)
    keys = [f"__k{k}" for k in range(len(names))]
    return search(df, query).withColumns({k: _key_part(n, bucket) for k, n in zip(keys, names, strict=True)}).dropna(subset=keys), names, keys


def _groups(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("tracks"), F.sum("size").alias("bytes"), (F.sum("size") - F.max("size")).alias("wasted"), F.min(F.struct("path", *[schema.rendered(n).alias(f"__v{k}") if n in schema.FIELDS else F.lit("").alias(f"__v{k}") for k, n in enumerate(names)])).alias("first")).where("tracks >= 2")


def duplicate_groups(df: DataFrame, by: str | None = None, query: str = "", bucket: int = 2) -> DataFrame:
    """tracks, bytes and wasted of the groups of duplicates(), for who does not ask which tracks these are: no path is shuffled."""
    return _groups(*_keyed(df, by, query, bucket)).select("tracks", "bytes", "wasted")


def duplicates(df: DataFrame, by: str | None = None, query: str = "", bucket: int = 2, items: int = MAX_ITEMS) -> DataFrame:
    """Groups of two and more tracks that agree in a key: key, tracks, bytes, wasted (beyond the largest), items (the first by path), query.

    The first few items of a group come from a ranking that Spark prunes in each task before the
    shuffle, so no group is gathered whole. Tracks that are alone are ranked too and go when groups are joined, as to leave them
    out before would shuffle all rows, unpruned.
    """
    rows, names, keys = _keyed(df, by, query, bucket)
    groups = _groups(rows, names, keys)
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).where(F.col("__n") <= items)
    listed = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("path")), lambda p: p).alias("items"))
    again = [F.concat(F.lit(f'{n}:"^'), _bare(F.col(f"first.__v{k}")), F.lit('$"')) for k, n in enumerate(names) if n in schema.FIELDS]
    return groups.join(listed, keys).select(F.concat_ws(" — ", *keys).alias("key"), "tracks", "bytes", "wasted", "items", F.concat_ws(" ", *again).alias("query"))


def duplicate_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("tracks"), F.lit(0)).alias("tracks"), F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"))


def values(df: DataFrame, field: str) -> DataFrame:
    """Distinct values of a field that are not empty: value, folded, tracks."""
    return df.select(schema.rendered(schema.lookup(field)).alias("value")).where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("tracks")).select("value", fold(F.col("value")).alias("folded"), "tracks")


def complete(df: DataFrame, field: str, prefix: str, limit: int = 20) -> DataFrame:
    """The most frequent values that start with prefix; if none do, of the first 4 * limit in the alphabet that hold it."""
    want = fold_text(prefix)
    found = values(df, field)
    best = [F.desc("tracks"), F.asc("folded"), F.asc("value")]
    heads = found.where(F.col("folded").startswith(want)).orderBy(*best).limit(limit)
    inner = found.where(F.col("folded").contains(want)).orderBy("folded", "value").limit(4 * limit)
    either = heads.withColumn("head", F.lit(True)).unionByName(inner.withColumn("head", F.lit(False)))
    told = either.withColumn("any", F.max("head").over(Window.partitionBy()))  # 5 * limit rows at most
    return told.where(F.col("head") == F.col("any")).orderBy(*best).limit(limit).select("value", "tracks")


def stats(df: DataFrame) -> DataFrame:
    """One row: totals, distinct artists, albums and genres, and how many tracks lack each field."""
    distinct = lambda c: F.count_distinct(F.when(F.col(c) != "", F.col(c))).alias(c + "s")
    lacks = {"title": F.col("title") == "", "artist": F.col("artist") == "", "album": F.col("album") == "", "album_artist": F.col("album_artist") == "", "genre": F.col("genre") == "", "composer": F.col("composer") == "", "year": F.col("year") == 0, "track": F.col("track_no") == 0}
    return df.agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("size").alias("bytes"), F.sum(F.col("duration_ms").cast("long")).alias("duration_ms"), F.count_if("has_art").alias("with_art"),
        distinct("artist"), distinct("album"), distinct("genre"), *[F.count_if(c).alias(f"missing_{n}") for n, c in lacks.items()],
    )


def formats(df: DataFrame) -> DataFrame:
    return df.groupBy("format").agg(F.count(F.lit(1)).alias("tracks"))


def artwork_summary(df: DataFrame, art: str = "art") -> DataFrame:
    """Pictures by the hash of their bytes (binary column, null: none): image, tracks, bytes; tracks without one have image null."""
    return df.select(F.when(F.col(art).isNotNull(), fnv(F.col(art))).alias("image"), F.octet_length(art).cast("long").alias("n")).groupBy("image").agg(F.count(F.lit(1)).alias("tracks"), F.coalesce(F.max("n"), F.lit(0)).alias("bytes"))

