"""One catalogue with the operations that its clients call, as methods.

A library has a home folder (see sources/store.py). Each scan and each committed edit adds a commit there, and what is
asked afterwards reads that, so nothing depends on the files or on earlier plans any more; what the commit before it named
stays for those who still read it. An edit that stops anywhere before its commit has changed nothing, and one that another
commit has overtaken is refused. Edits keep a journal, from which a later session can undo them, and number an event.
Dry runs return the same plans without committing.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.text import EXTENSIONS, MIME, WRITABLE, writable
from .operators import browse, edit, order, rawtags
from .operators.edit import Conflict, NotFound, Selector
from .operators.order import Page
from .plans.search import is_scored, search, search_scored
from .sources import scan, store, tags
from .streaming import events as ev


@dataclass
class Job:
    id: str
    kind: str
    created: float
    state: str = "done"
    finished: float | None = None
    result: dict = field(default_factory=dict)
    journal: bool = False


class Library:
    def __init__(self, tracks: DataFrame, roots: tuple[str, ...] = (), home: str | None = None) -> None:
        self.spark, self.jobs, self._scanning = tracks.sparkSession, [], threading.Lock()
        self.home = (home or f"{store.shared_dir(self.spark)}/library-{uuid.uuid4().hex}").rstrip("/")
        self._commit_as(store.last_commit(self.spark, self.home), kind="create", roots=list(roots), **store.write_base(tracks, self.home))

    @classmethod
    def open(cls, spark: SparkSession, home: str) -> Library:
        """The library of this folder as its last commit left it."""
        lib = cls.__new__(cls)
        lib.spark, lib.home, lib.jobs, lib._scanning = spark, home.rstrip("/"), [], threading.Lock()
        lib.refresh()
        return lib

    @classmethod
    def load(cls, spark: SparkSession, path: str, home: str | None = None) -> Library:
        return cls(store.load(spark, path), tuple(store.roots_of(spark, path)), home)

    def save(self, path: str) -> None:
        store.save(self.tracks_table, path, list(self.roots), ready=True)

    def refresh(self) -> None:
        """See what others have committed since."""
        found = store.last_commit(self.spark, self.home)
        if found is None:
            raise NotFound(self.home)
        self._use(found)

    def _use(self, found: dict) -> None:
        self.at, self.df, self.roots, self.epoch = found, store.table_of(self.spark, self.home, found), tuple(found["roots"]), found["epoch"]

    def _commit_as(self, before: dict | None, **changes) -> None:
        self._use(store.commit(self.spark, self.home, before, **changes))
        store.tidy(self.spark, self.home)

    def _table(self, gone: DataFrame, rows: DataFrame, changed: int) -> dict:
        """What a commit says of the table after `gone` (path) went and `rows` came: a delta, or a new base where that would be large."""
        if changed > store.DELTA_SHARE * self.at["rows"] or len(self.at["deltas"]) == store.MAX_DELTAS:
            kept = self.tracks_table.join(gone.select("path"), "path", "left_anti")
            return store.write_base(kept.select(*rows.columns).unionByName(rows), self.home)
        return {"deltas": [*self.at["deltas"], store.write_delta(self.home, gone, rows)]}

    @property
    def tracks_table(self) -> DataFrame:
        """The columns of the model, without the folded copies that searches read."""
        return schema.conform(self.df)

    # listings

    def tracks(self, q: str = "", sort: str | None = None, limit: int | None = None, offset: int | None = None) -> Page:
        """A page of matching tracks with id, version, writable and score."""
        found = search_scored(self.df, q)
        keys, revs = order.track_keys(sort, is_scored(q)), self.revs()
        p = order.page(found, keys, limit, offset)
        shown = edit.with_version(edit.with_id(p.items), revs).withColumn("writable", writable(F.col("format")))
        return Page(shown if revs is None else shown.orderBy(*keys), found, p.limit, p.offset)

    def revs(self) -> DataFrame | None:
        """(path, n) of the tracks that were written here, which their versions count."""
        return store.revs_of(self.spark, self.home, self.at)

    def count(self, q: str = "") -> int:
        return search(self.df, q).count()

    def get(self, id: str) -> DataFrame:
        found = edit.with_id(self.df).where(F.col("id") == id)
        if found.isEmpty():
            raise NotFound(id)
        return edit.with_version(found, self.revs())

    def albums(self, q: str = "", sort: str | None = None, limit: int | None = None, offset: int | None = None) -> Page:
        return order.page(browse.albums(self.df, q), order.album_keys(sort), limit, offset)

    def artists(self, q: str = "", sort: str | None = None, limit: int | None = None, offset: int | None = None) -> Page:
        return order.page(browse.artists(self.df, q), order.artist_keys(sort), limit, offset)

    def folders(self, path: str = "", q: str = "", limit: int | None = None, offset: int | None = None) -> Page:
        from .functions.text import fold

        return order.page(browse.folders(self.df, path, q, self.roots), [fold(F.col("path")), F.col("path")], limit, offset)

    def duplicates(self, q: str = "", by: str | None = None, seconds: int = 2, limit: int | None = None, offset: int | None = None) -> Page:
        return order.page(browse.duplicates(self.df, by, q, seconds), [F.desc("wasted"), F.asc("key")], limit, offset)

    def values(self, name: str, prefix: str = "", limit: int = 20) -> DataFrame:
        if not (found := schema.lookup(name)):
            raise edit.BadRequest(f"{name!r} is not a field")
        return browse.complete(self.df, found, prefix, limit)

    def stats(self) -> DataFrame:
        return browse.stats(self.df)

    def artwork_summary(self, art: DataFrame, selector: Selector | None = None) -> DataFrame:
        """art: path, art (binary) of the tracks that have a picture."""
        rows = edit.resolve(self.tracks_table, selector or Selector(all=True)).select("path")
        return browse.artwork_summary(rows.join(art, "path", "left"))

    @staticmethod
    def capabilities() -> dict:
        return {"formats": sorted(set(EXTENSIONS.values())), "mime": MIME, "writable": list(WRITABLE), "fields": list(schema.FIELDS), "editable": list(edit.EDITABLE), "numeric": list(schema.NUMERIC), "limits": {"default": order.DEFAULT_LIMIT, "max": order.MAX_LIMIT}, "keep": list(rawtags.KEEP)}

    # edits: a plan, or its report once committed

    def _commit(self, kind: str, plan: DataFrame, apply, backup: bool) -> Job:
        """Commit a plan; apply(rows, plan) gives the rows after it. The journal is written first and counts once the commit names it."""
        done = edit.report(plan).first().asDict()  # one row
        job = Job(uuid.uuid4().hex, kind, time.time(), finished=time.time(), result=done, journal=backup)
        if backup:
            store.write_journal(edit.journal(plan), f"{self.home}/journals", job.id, kind, int(job.created))
        gone = plan.where("status = 'changed'").select("path")
        now = self._table(gone, apply(self.tracks_table.join(gone, "path", "left_semi").select(*self.tracks_table.columns), plan), done["changed"]) if done["changed"] else {}
        if done["changed"] and kind != "rename":
            now["revs"] = store.add_revs(self.home, self.at, gone)
        self._commit_as(self.at, kind=kind, event=f"{kind}.finished", job=job.id, journal=backup, **now)
        self.jobs.append(job)
        return job

    def batch_set(self, selector: Selector, changes: dict[str, str | None], dry_run: bool = False, backup: bool = True) -> DataFrame | Job:
        plan = edit.plan_set(edit.resolve(self.tracks_table, selector), changes)
        return plan if dry_run else self._commit("set", plan, edit.apply, backup)

    def patch(self, id: str, changes: dict[str, str | None], if_match: str | None = None, backup: bool = True) -> Job:
        plan = edit.patch(self.tracks_table, id, changes, if_match, self.revs())
        return self._commit("set", plan, edit.apply, backup)

    def split(self, selector: Selector, template: str, dry_run: bool = False, backup: bool = True) -> DataFrame | Job:
        plan = edit.plan_split(edit.resolve(self.tracks_table, selector), template)
        return plan if dry_run else self._commit("split", plan, edit.apply, backup)

    def rename(self, selector: Selector, template: str, dry_run: bool = False, backup: bool = True) -> DataFrame | Job:
        plan = edit.plan_rename(edit.resolve(self.tracks_table, selector), template, self.roots, self.tracks_table)
        return plan if dry_run else self._commit("rename", plan, edit.apply_rename, backup)

    def move(self, id: str, dest: str, if_match: str | None = None, backup: bool = True) -> Job:
        """Rename one track, to a path below a root or a name in its own directory."""
        plan = edit.plan_move(self.tracks_table, id, dest, self.roots, if_match, self.revs())
        return self._commit("rename", plan, edit.apply_rename, backup)

    def dirty_count(self, path: str) -> int:
        """How many tracks are not in the snapshot of this path as they are now."""
        return edit.dirty(self.tracks_table, schema.conform(store.load(self.spark, path))).count()

    def delete(self, selector: Selector) -> None:
        gone = edit.resolve(self.tracks_table, selector).select("path")
        self._commit_as(self.at, kind="delete", **self._table(gone, self.tracks_table.limit(0), gone.count()))

    def strip(self, raw: DataFrame, keep: list[str] | None = None, also: list[str] = (), dry_run: bool = True) -> DataFrame:
        """A report of what would go (the default), or the raw tags that stay."""
        plan = rawtags.strip_plan(raw, rawtags.parse_keep(keep) if keep else None, rawtags.parse_keep(list(also)))
        return rawtags.strip_report(plan) if dry_run else plan.where("kept").drop("kept")

    def undo(self, job_id: str) -> None:
        """Take back what a job changed, also one of an earlier session: fields, names and pictures."""
        made = store.log_of(self.spark, self.home).where(F.col("job") == job_id).select("journal").first()
        if made is None:
            raise NotFound(job_id)
        if not made.journal:
            raise Conflict("the job kept no journal")
        entries = store.read_journal(self.spark, f"{self.home}/journals", job_id)
        gone = entries.select("path")
        old = self.tracks_table.join(gone, "path", "left_semi").select(*self.tracks_table.columns)
        rows, art = edit.restore(old, entries), entries.where("art is not null").select("path", F.col("art").alias("hash"))
        now = {}
        if not art.isEmpty():
            rows = rows.join(art, "path", "left").withColumn("has_art", F.coalesce(F.col("hash") != "", F.col("has_art"))).select(*old.columns)
            now["art"] = self._art(art)
        written = entries.where("fields is not null or art is not null").select("path")
        if not written.isEmpty():
            now["revs"] = store.add_revs(self.home, self.at, written)
        self._commit_as(self.at, kind="undo", **now, **self._table(gone, rows, entries.count()))

    def backups(self) -> DataFrame:
        """Journals by which jobs can be undone, newest first: name, kind, at, entries. Those that no commit names are not among them."""
        if not store.exists(self.spark, f"{self.home}/journals/sidecars"):
            return self.spark.createDataFrame([], "name string, kind string, at long, entries long")
        rows = self.spark.read.schema("kind string, at long, entries long, name string").json(f"{self.home}/journals/sidecars")
        named = store.log_of(self.spark, self.home).where("journal").select(F.col("job").alias("name"))
        return rows.join(named, "name", "left_semi").select("name", "kind", "at", "entries").orderBy(F.desc("at"), "name")

    def backup_page(self, limit: int | None = None, offset: int | None = None) -> Page:
        """A page of backups, newest first."""
        return order.page(self.backups(), [F.desc("at"), F.asc("name")], limit, offset)

    def backup(self, job_id: str) -> DataFrame:
        """One row of what a backup holds: entries, the fields they change, the first few paths with a note on each."""
        if self.backups().where(F.col("name") == job_id).isEmpty():
            raise NotFound(job_id)
        return store.backup_detail(store.read_journal(self.spark, f"{self.home}/journals", job_id), pictures=self.pictures())

    # pictures

    def _art(self, changed: DataFrame) -> list[str]:
        folder = f"data/{uuid.uuid4().hex}"
        changed.select("path", "hash").write.parquet(f"{self.home}/{folder}")
        return [*self.at["art"], folder]

    def artwork(self, embedded: DataFrame | None = None) -> DataFrame:
        """(path, hash) of the pictures that tracks have: set here, or else found in their files (embedded: path, hash)."""
        own = store.art_of(self.spark, self.home, self.at)
        if embedded is not None:
            own = embedded.select("path", "hash").join(own.select("path"), "path", "left_anti").unionByName(own)
        return own.where("hash <> ''")

    def pictures(self) -> DataFrame:
        return store.pictures_of(self.spark, self.home, self.at)

    def set_artwork(self, selector: Selector, image: bytes | None, embedded: DataFrame | None = None, dry_run: bool = False, backup: bool = True) -> DataFrame | Job:
        """Give the selected tracks one picture (None: none). Bytes are stored once under their hash, for tracks, journals and undo alike.

        embedded: pictures of the files as tags.pictures gives them (path, mime, data), which undo has to know; without them a
        track that has a picture in its file alone keeps that one's place as unknown, and undo only clears what was set.
        """
        was = None if embedded is None else embedded.select("path", F.sha2("data", 256).alias("hash"), "mime", "data")
        plan = edit.plan_artwork(edit.resolve(self.tracks_table, selector), self.artwork(was).withColumnRenamed("hash", "art"), hashlib.sha256(image).hexdigest() if image is not None else None)
        if dry_run:
            return plan
        done = edit.report(plan).first().asDict()
        job = Job(uuid.uuid4().hex, "artwork", time.time(), finished=time.time(), result=done, journal=backup)
        changed = plan.where("status = 'changed'")
        new = [] if image is None else [(hashlib.sha256(image).hexdigest(), tags.image_kind(image), bytearray(image))]
        pictures = self.spark.createDataFrame(new, store.PICTURE)
        if was is not None:
            pictures = pictures.unionByName(was.join(changed.select("path"), "path", "left_semi").select("hash", "mime", "data"))
        now = {"pictures": store.add_pictures(self.home, self.at, pictures)}
        if backup:
            entries = changed.select("path", F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast("string").alias("source"), F.coalesce("before", F.lit("")).alias("art"))
            store.write_journal(entries, f"{self.home}/journals", job.id, "artwork", int(job.created))
        if done["changed"]:
            now["art"] = self._art(changed.select("path", F.coalesce("art", F.lit("")).alias("hash")))
            rows = self.tracks_table.join(changed.select("path"), "path", "left_semi").withColumn("has_art", F.lit(image is not None)).select(*self.tracks_table.columns)
            now |= self._table(changed.select("path"), rows, done["changed"]) | {"revs": store.add_revs(self.home, self.at, changed)}
        self._commit_as(self.at, kind="artwork", event="artwork.finished", job=job.id, journal=backup, **now)
        self.jobs.append(job)
        return job

    def drop_pictures(self) -> int:
        """Remove pictures that neither a track nor a journal refers to any more; returns how many went."""
        used = self.artwork().select("hash")
        if store.exists(self.spark, f"{self.home}/journals/entries"):
            used = used.unionByName(self.spark.read.schema(store.JOURNAL_ART).json(f"{self.home}/journals/entries").where("art <> ''").select(F.col("art").alias("hash")))
        all_, folder = self.pictures(), f"data/{uuid.uuid4().hex}"
        all_.join(used.distinct(), "hash", "left_semi").write.parquet(f"{self.home}/{folder}")
        before = all_.count()
        self._commit_as(self.at, kind="pictures", pictures=[folder])
        return before - self.pictures().count()

    # ingest and change stream

    def scan(self, roots: list[str] | None = None, exclude: list[str] = (), fresh: bool = False, follow: bool = False) -> dict:
        """Read what has changed below the roots; one scan at a time, another is refused. Returns the counts and the first errors."""
        if not self._scanning.acquire(blocking=False):
            raise Conflict("a scan is running")
        try:
            roots = list(roots or self.roots)
            done = scan.run(self.spark, roots, None if fresh else self.tracks_table, exclude, follow=follow)
            try:
                self._commit_as(self.at, kind="scan", event="catalog.replaced", roots=roots, **store.write_base(done.tracks, self.home, ready=True))
                first = done.errors.orderBy("path").limit(edit.MAX_ERRORS)
                return done.counters().first().asDict() | {"first_errors": [f"{r.path}: {r.error}" for r in first.collect()]}
            finally:
                done.close()
        finally:
            self._scanning.release()

    def events(self, epoch: str | None = None, after: int | None = None) -> DataFrame:
        """What a subscriber gets: nothing of the past without a place to resume from. Events are the commits of finished jobs and scans, in any session."""
        kept = ev.history(store.log_of(self.spark, self.home).where("event is not null").select("epoch", "at", "seq", F.col("event").alias("type")))
        return kept.select("type", "seq", F.lit(None).cast("long").alias("missed")).limit(0) if after is None else ev.replay(kept, epoch or self.epoch, after)
