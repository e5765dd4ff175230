"""Catalogue snapshots, journals and exports.

A home folder has data folders, which are written once under names of their own and never changed, and a log of small
numbered files. Putting the next number into the log is the only step that commits anything: readers take the highest
number, whoever stops before that has changed nothing, and of two who try the same number one is refused. Small edits write
the rows they change as a delta over the base.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import dirname
from ..plans.search import fold_columns

#: Names of pictures beside the tracks, best first, and their endings.
ART_NAMES = ("cover", "folder", "front", "album", "albumart", "artwork", "art")
ART_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")


class OldSnapshot(ValueError):
    """A snapshot of another version; its roots are still readable."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


ART, PICTURE, REV = "path string, hash string, n int", "hash string, mime string, data binary", "path string, n long"
#: What a commit says. rows: tracks of the base; deltas lie over it, the last on top. seq counts the commits that have an event.
COMMIT = "number long, version int, epoch string, kind string, event string, seq long, at double, job string, journal boolean, roots array<string>, rows long, base string, deltas array<string>, art array<string>, pictures array<string>, revs array<string>"
#: A table is written anew when so many deltas lie over it, or when one would hold more than this share of its rows.
MAX_DELTAS, DELTA_SHARE = 8, 0.1
#: Commits whose data stays for those who still read them.
KEEP_COMMITS = 2


class Raced(RuntimeError):
    """Another commit came first; nothing was changed."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file under its name at once, unless the name is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, _, name = path.rpartition("/")
    fs, part = _fs(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(text.encode())
    out.close()
    where = jvm.org.apache.hadoop.fs.Path(path)
    never = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # without OVERWRITE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), conf).rename(part, where, never)
        return True
    except Py4JJavaError as error:
        fs.delete(part, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass()):
            return False
        raise


def log_of(spark: SparkSession, home: str) -> DataFrame:
    """All commits of a home folder; half-written ones have other names and are not seen."""
    return spark.read.schema(COMMIT).option("pathGlobFilter", "[0-9]*.json").json(f"{home}/log")


def read_commit(spark: SparkSession, home: str, number: int) -> dict:
    fs, where = _fs(spark, f"{home}/log/{number:010d}.json")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def last_commit(spark: SparkSession, home: str) -> dict | None:
    """The commit with the highest number: what readers see."""
    names = [n for n in names_in(spark, f"{home}/log") if re.fullmatch(r"[0-9]{10}\.json", n)]
    return read_commit(spark, home, int(names[-1][:10])) if names else None


def commit(spark: SparkSession, home: str, before: dict | None, **changes) -> dict:
    """Add the commit after `before`: the only step by which anything counts. Raised if another was made since."""
    empty = {"epoch": uuid.uuid4().hex, "version": schema.SCHEMA_VERSION, "number": 0, "seq": 0, "roots": [], "rows": 0, "base": None, "deltas": [], "art": [], "pictures": [], "revs": []}
    made = empty | (before or {}) | {"event": None, "job": None, "journal": False, "at": time.time()} | changes
    made["number"] += 1
    made["seq"] += made["event"] is not None
    if not put_if_absent(spark, f"{home}/log/{made['number']:010d}.json", json.dumps(made)):
        raise Raced(f"commit {made['number']} is there already")
    return made


def write_base(df: DataFrame, home: str, ready: bool = False) -> dict:
    """Write the whole table, sorted by path within ranges and with folded columns, so searches can skip row groups.

    ready: df is a written table, or cheap. Else its rows are written once as they come and sorted from there, as
    sampling their ranges would run the whole plan twice.
    """
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    rows = schema.conform(df)
    if not ready:
        rows.write.parquet(f"{home}/{folder}/rows")
        rows = spark.read.schema(schema.TRACK).parquet(f"{home}/{folder}/rows")
    fold_columns(rows.repartitionByRange("path").sortWithinPartitions("path")).write.parquet(f"{home}/{folder}/tracks")
    if not ready:
        remove(spark, f"{home}/{folder}/rows")
    return {"base": folder, "deltas": [], "rows": spark.read.parquet(f"{home}/{folder}/tracks").count()}


def write_delta(home: str, gone: DataFrame, rows: DataFrame) -> str:
    """Write paths that go and rows that come in their place; returns the folder."""
    folder = f"data/{uuid.uuid4().hex}"
    fold_columns(schema.conform(rows)).write.parquet(f"{home}/{folder}/tracks")
    gone.select("path").write.parquet(f"{home}/{folder}/gone")
    return folder


def table_of(spark: SparkSession, home: str, found: dict) -> DataFrame:
    """The table of a commit. The paths that a delta holds are at most DELTA_SHARE of all, so these joins shuffle the base at worst once each."""
    out = spark.read.parquet(f"{home}/{found['base']}/tracks")
    for d in found["deltas"]:
        out = out.join(spark.read.schema("path string").parquet(f"{home}/{d}/gone"), "path", "left_anti").select(*out.columns).unionByName(spark.read.schema(out.schema).parquet(f"{home}/{d}/tracks"))
    return out


def _folders(found: dict) -> set[str]:
    return {x for x in [found["base"], *found["deltas"], *found["art"], *found["pictures"], *found.get("revs", [])] if x}


def tidy(spark: SparkSession, home: str, hours: float | None = None) -> list[str]:
    """Remove data that the last KEEP_COMMITS commits no longer name; with hours, all that they do not name and is older, as stopped writers leave it too."""
    last = last_commit(spark, home)["number"]
    of = lambda n: _folders(read_commit(spark, home, n)) if n > 0 else set()
    kept, gone = set().union(*(of(n) for n in range(last, last - KEEP_COMMITS, -1))), of(last - KEEP_COMMITS)
    if hours is not None:
        fs, where = _fs(spark, f"{home}/data")
        gone |= {f"data/{x.getPath().getName()}" for x in fs.listStatus(where) if x.getModificationTime() / 1000 < time.time() - hours * 3600}
    for folder in gone - kept:
        remove(spark, f"{home}/{folder}")
    return sorted(gone - kept)


def save(df: DataFrame, path: str, roots: list[str], ready: bool = False) -> None:
    """Write a snapshot and commit it; until then, and if this stops anywhere, readers see the one before."""
    spark = df.sparkSession
    before = last_commit(spark, path)
    commit(spark, path, before, kind="save", roots=list(roots), **write_base(df, path, ready))
    for old in ("meta", "tracks"):  # the layout of earlier releases
        remove(spark, f"{path}/{old}")
    tidy(spark, path)


def _meta(spark: SparkSession, path: str) -> tuple[int, list[str], dict | None]:
    """(version, roots, commit) of a snapshot; one of an earlier release has no commit."""
    found = last_commit(spark, path)
    if exists(spark, f"{path}/meta"):
        old = spark.read.schema("version int, roots array<string>").json(f"{path}/meta").first()
        if found is None or old.version != schema.SCHEMA_VERSION:
            return old.version, old.roots, None
    if found is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return found["version"], found["roots"], found


def roots_of(spark: SparkSession, path: str) -> list[str]:
    return _meta(spark, path)[1]


def load(spark: SparkSession, path: str) -> DataFrame:
    version, roots, found = _meta(spark, path)
    if version != schema.SCHEMA_VERSION:
        raise OldSnapshot(f"version {version}; rescan {roots}")
    return table_of(spark, path, found) if found else spark.read.parquet(f"{path}/tracks")


JOURNAL = "path string, fields map<string,string>, source string"
FRAMES = "array<struct<format:string,key:string,value:string,bytes:bigint>>"
JOURNAL_ART = f"{JOURNAL}, art string, frames {FRAMES}"


def write_journal(entries: DataFrame, folder: str, name: str, kind: str | None, at: int) -> None:
    """Entries as JSON lines, and a sidecar of their kind, time and number."""
    entries.write.json(f"{folder}/entries/name={name}")
    if kind is not None:
        entries.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(kind).alias("kind"), F.lit(at).alias("at"), "entries").coalesce(1).write.json(f"{folder}/sidecars/name={name}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, in order; none if it is not there."""
    fs, where = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="catalogue-")
        atexit.register(shutil.rmtree, local, True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back, for what would else be made anew each time it is asked."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_journal(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(JOURNAL_ART).json(f"{folder}/entries/name={name}")


def backups(names: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Backups (name, at), newest first; one without a sidecar is of a strip."""
    return names.join(sidecars.select("name", "kind", "entries"), "name", "left").select("name", "at", F.coalesce("kind", F.lit("strip")).alias("kind"), F.coalesce("entries", F.lit(0)).alias("entries")).orderBy(F.desc("at"), "name")


def _entries(entries: DataFrame) -> DataFrame:
    """Entries with all columns of a journal, those of older ones too."""
    missing = {"art": "string", "frames": FRAMES}
    return entries.withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items() if c not in entries.columns})


def backup_detail(entries: DataFrame, samples: int = 5, pictures: DataFrame | None = None) -> DataFrame:
    """One row: entries, the fields they change, the first few paths, notes of what is kept for these, and how many tags of each format.

    pictures: hash, mime of the pictures that entries may refer to.
    """
    rows = _entries(entries)
    keys = rows.select(F.explode(F.map_keys("fields")).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("fields"))  # as many as there are fields
    first = rows.orderBy("path").limit(samples)
    first = first.withColumn("mime", F.lit("")) if pictures is None else first.join(pictures.select(F.col("hash").alias("art"), "mime"), "art", "left")
    note = F.when(F.col("source") != "", F.concat(F.lit("moved from "), "source")).when(F.col("art") == "", "had no cover").when(F.col("art").isNotNull(), F.rtrim(F.concat(F.lit("cover "), F.coalesce("mime", F.lit("")))))
    note = note.when(F.size("fields") > 0, F.array_join(F.array_sort(F.map_keys("fields")), ", ")).when(F.size("frames") > 0, F.concat(F.size("frames").cast("string"), F.lit(" tags"))).otherwise("")
    first = first.agg(F.array_sort(F.collect_list(F.struct("path", note.alias("note")))).alias("s")).select(F.col("s.path").alias("samples"), F.col("s.note").alias("notes"))
    formats = rows.select(F.explode("frames").alias("x")).groupBy("x.format").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "n")))).alias("formats"))  # as many as there are formats
    return rows.agg(F.count(F.lit(1)).alias("entries")).join(keys, F.lit(True)).join(first, F.lit(True)).join(formats, F.lit(True))


def backup_groups(entries: DataFrame) -> DataFrame:
    """(key, tracks): how often a backup of a strip holds each native key, the most frequent first."""
    return _entries(entries).select(F.explode("frames").alias("x")).groupBy("x.key").agg(F.count(F.lit(1)).alias("tracks")).orderBy(F.desc("tracks"), "key")


def add_revs(home: str, found: dict, paths: DataFrame) -> list[str]:
    """Count a write to each of these paths; returns the folders of all counts, which become one when they are many."""
    spark, folder, known = paths.sparkSession, f"data/{uuid.uuid4().hex}", found.get("revs", [])
    counts = paths.select("path", F.lit(1).cast("long").alias("n"))
    if len(known) >= MAX_DELTAS:
        counts, known = revs_of(spark, home, found).unionByName(counts).groupBy("path").agg(F.sum("n").alias("n")), []
    counts.write.parquet(f"{home}/{folder}")
    return [*known, folder]


def revs_of(spark: SparkSession, home: str, found: dict) -> DataFrame | None:
    """(path, n): how often tracks were written in the library, if any were. No scan resets this, as a version must not come again."""
    if not found.get("revs"):
        return None
    return spark.read.schema(REV).parquet(*[f"{home}/{r}" for r in found["revs"]]).groupBy("path").agg(F.sum("n").alias("n"))


def export(df: DataFrame, path: str, how: str) -> None:
    """As 'm3u' (paths), 'tsv' or 'json' lines, in path order."""
    rows = df.orderBy("path")
    if how == "m3u":
        rows.select("path").write.text(path)
    elif how == "tsv":
        rows.select("artist", "album", "title", "year", "path").write.csv(path, sep="\t", header=True, quote="")
    elif how == "json":
        rows.write.json(path)
    else:
        raise ValueError(how)


def folder_art(files: DataFrame) -> DataFrame:
    """Of each directory the picture (path) that serves as its cover: dir, art."""
    name = F.lower(F.substring_index("path", "/", -1))
    base, ending = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2)
    bases, endings = F.array(*map(F.lit, ART_NAMES)), F.array(*map(F.lit, ART_ENDINGS))
    rows = files.select("path", dirname(F.col("path")).alias("dir"), F.array_position(bases, base).alias("a"), F.array_position(endings, ending).alias("b")).where("a > 0 and b > 0")
    return rows.groupBy("dir").agg(F.min_by("path", F.struct("a", "b", "path")).alias("art"))


def with_folder_art(tracks: DataFrame, art: DataFrame) -> DataFrame:
    return tracks.withColumn("dir", dirname(F.col("path"))).join(art, "dir", "left")


def art_export(tracks: DataFrame) -> DataFrame:
    """The track of each directory whose picture is exported: the first with one."""
    return tracks.where("has_art").groupBy(dirname(F.col("path")).alias("dir")).agg(F.min("path").alias("path"))


def add_pictures(home: str, found: dict, pictures: DataFrame) -> list[str]:
    """Write pictures (hash, mime, data) that are not there yet; returns the folders of all."""
    spark, folder = pictures.sparkSession, f"data/{uuid.uuid4().hex}"
    known = pictures_of(spark, home, found).select("hash")
    pictures.dropDuplicates(["hash"]).join(known, "hash", "left_anti").select("hash", "mime", "data").write.parquet(f"{home}/{folder}")
    return [*found["pictures"], folder]


def pictures_of(spark: SparkSession, home: str, found: dict) -> DataFrame:
    """hash, mime, data: each picture once, however many tracks have it."""
    rows = spark.createDataFrame([], PICTURE)
    return spark.read.schema(PICTURE).parquet(*[f"{home}/{p}" for p in found["pictures"]]) if found["pictures"] else rows


def art_of(spark: SparkSession, home: str, found: dict) -> DataFrame:
    """(path, hash) of tracks whose picture was set in the library; '' stands for none. The last one of a path counts."""
    rows = spark.createDataFrame([], ART)
    for n, folder in enumerate(found["art"]):
        rows = rows.unionByName(spark.read.schema(ART).parquet(f"{home}/{folder}").withColumn("n", F.lit(n)))
    return rows.groupBy("path").agg(F.max_by("hash", "n").alias("hash"))


def best_candidate(candidates: DataFrame, by: str) -> DataFrame:
    """Of offline lookup candidates (by, ord, complete, ...) the first complete one, else the first."""
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("complete"), "ord"))
    return candidates.withColumn("__n", best).where(F.col("__n") == 1).drop("__n")


def with_masters(candidates: DataFrame, masters: DataFrame) -> DataFrame:
    """Candidates (master_id, image) with what their masters add; those still without an image go."""
    return candidates.join(masters.withColumnRenamed("image", "__image"), "master_id", "left").withColumn("image", F.coalesce(F.nullif("image", F.lit("")), "__image")).where("image is not null and image <> ''").drop("__image")


def generate(spark: SparkSession, n: int) -> DataFrame:
    """A synthetic catalogue of n tracks: eight artists with an album and a genre each."""
    names = ("Nørd Harbour", "Tin Orchard", "Mara Vell", "Café Luna", "The Low Tides", "Ivo Stern", "Glass Pilots", "Oddvar")
    artists = list(names)
    albums = [f"{n.split()[-1]} {k + 1}" for k, n in enumerate(names)]
    genres = [("Folk", "Jazz", "Ambient", "Soul")[k % 4] for k in range(len(names))]
    of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("id") % len(xs) + 1).cast("int"))
    number = F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0")
    return schema.conform(spark.range(n).select(
        F.concat(F.lit("/music/"), of(artists), F.lit("/"), of(albums), F.lit("/"), number, F.lit(" track-"), F.col("id").cast("string"), F.lit(".mp3")).alias("path"), F.concat(F.lit("Piece "), F.col("id").cast("string")).alias("title"),
        of(artists).alias("artist"), of(albums).alias("album"), of(genres).alias("genre"), (F.lit(1970) + F.col("id") % 50).alias("year"), (F.col("id") % 12 + 1).alias("track_no"),
        (F.lit(90000) + F.col("id") * 37 % 240000).alias("duration_ms"), (F.lit(3 << 20) + F.col("id") % 997).alias("size"), F.lit("mp3").alias("format"), (F.col("id") % 3 == 0).alias("has_art"),
    ))
