"""Set-based edits as plans: select tracks, work out what changes, look at it, commit it, undo it.

A plan is a DataFrame with one row for each selected track: id, path, status (changed, same, skipped,
incomplete, collision), changes (field -> new value, null clears) and before (field -> old value). A dry
run counts it; apply() makes the next version of the table from the same plan; journal() keeps what is
needed to undo it.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import schema
from ..functions.hashing import half, live_version, track_id, track_version
from ..functions.text import dirname, int_prefix, is_true, sanitise_segment, tidy_path, trim, trim_column
from ..plans.search import search
from ..sources.store import written

MAX_ERRORS = 25


#: Extensions of pictures beside the tracks.
COVER_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".bmp")


class BadRequest(ValueError):
    """The caller described something that cannot be done."""


class BadTemplate(BadRequest):
    pass


class BadPath(BadRequest):
    """A path that nothing may be written to."""


class NotFound(LookupError):
    pass


class Conflict(RuntimeError):
    """The table is not what the caller took it to be."""


@dataclass(frozen=True)
class Selector:
    """By ids, else by query, else all; minus exclude_ids; refused if the count is not expect_count."""

    ids: tuple[str, ...] | DataFrame = ()
    query: str | None = None
    all: bool = False
    exclude_ids: tuple[str, ...] | DataFrame = ()
    expect_count: int | None = None


def _ids(df: DataFrame, ids: tuple[str, ...] | DataFrame) -> DataFrame:
    return ids.select("id") if isinstance(ids, DataFrame) else df.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def with_id(df: DataFrame) -> DataFrame:
    return df if "id" in df.columns else df.withColumn("id", track_id(F.col("path")))


def resolve(df: DataFrame, selector: Selector) -> DataFrame:
    """The selected tracks, with their ids."""
    rows = with_id(df)
    if isinstance(selector.ids, DataFrame) or selector.ids:
        rows = rows.join(_ids(df, selector.ids), "id", "left_semi")
    elif selector.query is not None:
        rows = search(rows, selector.query)
    elif not selector.all:
        raise BadRequest("the selector names no tracks")
    if isinstance(selector.exclude_ids, DataFrame) or selector.exclude_ids:
        rows = rows.join(_ids(df, selector.exclude_ids), "id", "left_anti")
    if selector.expect_count is not None and (n := rows.count()) != selector.expect_count:
        raise Conflict(f"the selection has {n} tracks, not {selector.expect_count}")
    return rows


#: Fields that an edit may name, with their columns.
EDITABLE = {f: schema.FIELDS[f][0] for f in schema.EDITABLE} | {"tracktotal": "track_total", "disctotal": "disc_total"}


def validate(changes: dict[str, str | None]) -> dict[str, str | None]:
    """Canonical field names to new values (None clears)."""
    out = {}
    for name, value in changes.items():
        field = name.lower() if name.lower() in ("tracktotal", "disctotal") else schema.lookup(name)
        if field not in EDITABLE:
            raise BadRequest(f"{name!r} is not a field that can be written")
        if field in (*schema.NUMERIC, "tracktotal", "disctotal") and field != "compilation" and value and not re.fullmatch(r"\s*[0-9]{1,9}\s*", value):
            raise BadRequest(f"{field} takes a number, not {value!r}")
        if field.startswith("mb") and value:
            parts = [x for x in re.split(r"[\0/;, \t\n\r]+", value) if x]
            if not all(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", x) for x in parts):
                raise BadRequest(f"{field} takes identifiers")
            value = "; ".join(dict.fromkeys(x.lower() for x in parts))
        out[field] = value
    if not out:
        raise BadRequest("no changes")
    return out


def _as_text(field: str) -> Column:
    """The current value of an editable field, empty where absent."""
    c = F.col(EDITABLE[field])
    if field == "compilation":
        return F.when(c, "1").otherwise("")
    return F.when(c == 0, "").otherwise(c.cast("string")) if field in ("tracktotal", "disctotal", *schema.NUMERIC) else c


def _wanted(field: str, value: Column) -> Column:
    """A new value as it will read once written."""
    value = trim_column(F.coalesce(value, F.lit("")))
    if field == "compilation":
        return F.when(is_true(value), "1").otherwise("")
    if field in ("tracktotal", "disctotal", *schema.NUMERIC):
        n = int_prefix(value)
        return F.when(n == 0, "").otherwise(n.cast("string"))
    return value


def plan_map(rows: DataFrame, changes: Column) -> DataFrame:
    """A plan from a map column of changes, null where a row is to be skipped; only real differences stay in it."""
    rows = with_id(rows).withColumn("__c", changes)
    kept, before = [], []
    for field in EDITABLE:
        named = F.map_contains_key("__c", F.lit(field))
        new = _wanted(field, F.element_at("__c", F.lit(field)))
        differs = F.coalesce(named, F.lit(False)) & (new != _as_text(field))
        kept.append(F.when(differs, F.struct(F.lit(field).alias("key"), F.nullif(new, F.lit("")).alias("value"))))
        before.append(F.when(differs, F.struct(F.lit(field).alias("key"), F.nullif(_as_text(field), F.lit("")).alias("value"))))
    made = rows.withColumns({"changes": F.map_from_entries(F.array_compact(F.array(*kept))), "before": F.map_from_entries(F.array_compact(F.array(*before)))})
    status = F.when(F.col("__c").isNull(), "skipped").when(F.size("changes") == 0, "same").otherwise("changed")
    return made.select("id", "path", status.alias("status"), "changes", "before")


def plan_set(rows: DataFrame, changes: dict[str, str | None]) -> DataFrame:
    """The same changes for every row."""
    given = validate(changes)
    return plan_map(rows, F.create_map(*[x for f, v in given.items() for x in (F.lit(f), F.lit(v).cast("string"))]))


_FIELD = re.compile(r"\$(\$|[a-z]*)")


def _template(text: str) -> list[str | tuple[str]]:
    """Literals, and fields as one-tuples; $$ is a dollar."""
    text, out, at = text.strip(), [], 0
    if not text:
        raise BadTemplate("it is empty")
    for m in _FIELD.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[1] == "$":
            out.append("$")
        elif not m[1]:
            raise BadTemplate("a $ without a field name")
        elif not (field := schema.lookup(m[1])):
            raise BadTemplate(f"{m[1]!r} is not a field")
        else:
            out.append((field,))
    out.append(text[at:])
    if not any(isinstance(x, tuple) for x in out):
        raise BadTemplate("it names no fields")
    return [x for x in out if x]


def split_pattern(template: str) -> tuple[str, list[str]]:
    """A regular expression and the fields of its groups; all but the last take as little as they can.

    A field that is named twice, in whatever spelling, is refused.
    """
    parts = _template(template)
    fields = [x[0] for x in parts if isinstance(x, tuple)]
    for f in fields:
        if f not in schema.EDITABLE or f.startswith("mb"):
            raise BadTemplate(f"{f} is not a field that can be written")
    if len(set(fields)) < len(fields):
        raise BadTemplate("a field appears twice")
    if parts == [("title",)]:
        raise BadTemplate("$title alone would only copy the title")
    seen, out = 0, ""
    for x in parts:
        if isinstance(x, tuple):
            seen += 1
            out += r"([^\n]+)" if seen == len(fields) else r"([^\n]+?)"
        else:
            out += "".join(r"\Q" + x + r"\E" if "\\E" not in x else re.escape(x))
    return rf"\A{out}\z", fields


def split_title(template: str, title: Column | None = None) -> Column:
    """The fields that a title holds by this template, as a map, or null."""
    pattern, fields = split_pattern(template)
    title = trim(F.col("title") if title is None else title)
    entries = F.array(*[F.struct(F.lit(f).alias("key"), trim(F.regexp_extract(title, pattern, k + 1)).alias("value")) for k, f in enumerate(fields)])
    found = F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))
    return F.when(title.rlike(pattern) & (F.size(found) > 0), found)


def plan_split(rows: DataFrame, template: str) -> DataFrame:
    return plan_map(rows, split_title(template))


def render(template: str) -> tuple[Column, Column]:
    """(path below the root without its ending, whether every field had a value)."""
    parts = _template(template)
    if template.strip().startswith("/"):
        raise BadTemplate("it is absolute")
    out, complete = [], F.lit(True)
    for x in parts:
        if isinstance(x, str):
            out.append(F.lit(x))
            continue
        if x[0] == "path":
            raise BadTemplate("$path would move nothing")
        v = trim_column(schema.rendered(x[0]))
        if x[0] == "albumartist":
            v = F.when(v == "", trim_column(F.col("artist"))).otherwise(v)
        if x[0] in ("track", "disc"):
            n = schema.column(x[0])
            v = F.when(n > 0, F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))).otherwise("")
        complete = complete & (v != "")
        out.append(sanitise_segment(v))
    return tidy_path(F.concat(*out)), complete


def root_of(path: Column, roots: tuple[str, ...]) -> Column:
    """The first root, in their order, that a path is under, else its directory."""
    out = dirname(path)
    for r in reversed(roots):
        out = F.when(path.startswith(r.rstrip("/") + "/"), r.rstrip("/")).otherwise(out)
    return out


def plan_rename(rows: DataFrame, template: str, roots: tuple[str, ...], existing: DataFrame | None = None) -> DataFrame:
    """A plan with dest: incomplete where a field is empty, same where nothing moves, collision where another track is there or claims it.

    Of the complete tracks that would move to one place the first by path claims it (the selection is in path order).
    """
    name, complete = render(template)
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    own = [c for c in ("id",) if c in rows.columns]  # else hashed at the end, where it is asked for
    named = rows.withColumns({"dest": F.concat(root_of(F.col("path"), roots), F.lit("/"), name, ext), "complete": complete & (name != "")}).select(*own, "path", "dest", "complete")
    made = written(named, "rename")  # names are made once, for the claims and for the plan, however often it is asked
    # rows are dealt out by their places once, for both; a place that is not known is "" on the way, as what is asked of nulls would be asked of one side alone
    made = made.withColumn("dest", F.coalesce("dest", F.lit(""))).repartition("dest")
    claims = F.col("complete") & (F.col("dest") != F.col("path"))
    places = made.groupBy(F.col("dest").alias("__dest")).agg(F.min(F.when(claims, F.col("path"))).alias("__first")).where("__first is not null")
    made = made.join(places, claims & (F.col("dest") == F.col("__dest")), "left")
    if existing is None:
        made = made.withColumn("__there", F.lit(None).cast("string"))
    else:
        made = made.join(existing.select(F.col("path").alias("__there")).distinct(), claims & (F.col("dest") == F.col("__there")), "left")
    made = made.withColumn("dest", F.nullif("dest", F.lit("")))
    status = F.when(~F.col("complete"), "incomplete").when(F.col("dest") == F.col("path"), "same").when((F.col("__first") != F.col("path")) | F.col("__there").isNotNull(), "collision").otherwise("changed")
    return with_id(made.withColumn("status", status)).select("id", "path", "status", "dest", track_id(F.col("dest")).alias("new_id"))


def resolve_dest(current: str, dest: str, roots: tuple[str, ...]) -> str:
    """Where one track is to be moved: a file with the same extension below a root, or below its own directory if there are no roots."""
    dest, own = dest.strip(), posixpath.dirname(current)
    if not dest or dest.endswith("/"):
        raise BadPath("a destination is the name of a file")
    target = "/" + posixpath.normpath(posixpath.join(own, dest)).lstrip("/")
    if posixpath.splitext(target)[1].lower() != posixpath.splitext(current)[1].lower():
        raise BadPath(f"{target!r} has another extension than {current!r}")
    if not any(r not in ("", ".") and target.startswith(posixpath.normpath(r).rstrip("/") + "/") for r in roots or (own,)):
        raise BadPath(f"{target!r} is outside the library")
    return target


def cover_name(name: str) -> str:
    """A name that a picture may be written under in a directory of tracks."""
    ending = posixpath.splitext(name)[1].lower()
    if not name or name.startswith(".") or "/" in name or "\\" in name or (ending and ending not in COVER_ENDINGS):
        raise BadPath(f"{name!r} is not the name of a picture")
    return name


def plan_move(df: DataFrame, id: str, dest: str, roots: tuple[str, ...], if_match: str | None = None, revs: DataFrame | None = None) -> DataFrame:
    """A plan with dest for one track; refused if the place is outside the library or taken, or the track not at if_match."""
    found = _one(df, id, if_match, revs)
    target = resolve_dest(found.path, dest, roots)
    if target != found.path and not df.where(F.col("path") == target).isEmpty():
        raise Conflict(f"{target!r} is there already")
    row = with_id(df).where(F.col("path") == found.path)
    return row.select("id", "path", F.when(F.col("path") == target, "same").otherwise("changed").alias("status"), F.lit(target).alias("dest"), track_id(F.lit(target)).alias("new_id"))


def _by_path(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """(__p1, __p2, columns) of rows: the path as 16 bytes, which is what a table that only says something of paths is shuffled as."""
    return rows.where(F.col("path").isNotNull()).select(half("path", 0).alias("__p1"), half("path", 1).alias("__p2"), *columns)


def _same_path() -> Column:
    """Whether a row of a table and one of _by_path() have one path.

    The second halves are xored, as equal keys would have rows that were dealt out by the first half dealt out anew.
    """
    return (half("path", 0) == F.col("__p1")) & (half("path", 1).bitwiseXOR(F.col("__p2")) == 0)


def dirty(df: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows that are not in the saved table as they are now: edited, moved or new since.

    Rows are compared by 128 bits of hashes of all columns and meet by 64 bits of the path's, so the saved table is shuffled
    as 24 bytes a row. Hashes of rows are xored (see _same_path); the join is an outer one, as Spark else moves it
    below the hashing and shuffles what is hashed.
    """
    others = sorted(c for c in df.columns if c != "path")

    def marked(rows: DataFrame, *names: str) -> DataFrame:
        told = [x for c in ("path", *others) for x in (F.isnull(f"`{c}`"), F.col(f"`{c}`"))]  # hashes pass over nulls
        return rows.withColumns({names[0]: half("path", 0), names[1]: F.xxhash64(F.lit(0), *told), names[2]: F.xxhash64(F.lit(1), *told)})

    kinds = dict(df.dtypes)
    known = saved.where(F.col("path").isNotNull()).select("path", *[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in others])
    known = marked(known, "__s", "__s1", "__s2").select("__s", "__s1", "__s2")
    apart = F.col("__h1").bitwiseXOR(F.col("__s1")).bitwiseOR(F.col("__h2").bitwiseXOR(F.col("__s2")))
    met = marked(df, "__h", "__h1", "__h2").join(known, (F.col("__h") == F.col("__s")) & (apart == 0), "left")
    return met.where("__s is null").select(*[f"`{c}`" for c in df.columns])


def report(plan: DataFrame) -> DataFrame:
    """One row: matched and how many of each status."""
    return plan.agg(F.count(F.lit(1)).alias("matched"), *[F.count_if(F.col("status") == s).alias(s) for s in ("changed", "same", "skipped", "incomplete", "collision")])


def samples(plan: DataFrame, n: int) -> DataFrame:
    return plan.where("status = 'changed'").orderBy("path").limit(n)


def apply(df: DataFrame, plan: DataFrame) -> DataFrame:
    """The table after a plan of field changes."""
    changed = _by_path(plan.where("status = 'changed'"), "changes")
    rows = df.join(changed, _same_path(), "left")
    return _written(rows, dict(df.dtypes), "changes", lambda field, value: (F.coalesce(value, F.lit("")), F.lit(True))).select(*df.columns)


def _written(rows: DataFrame, kinds: dict[str, str], changes: str, wanted: Callable[[str, Column], tuple[Column, Column]]) -> DataFrame:
    """rows with the fields that a map in them names as wanted says of field and value: the text, and whether it is to be written."""
    out = {}
    for field, name in EDITABLE.items():
        named = F.coalesce(F.map_contains_key(changes, F.lit(field)), F.lit(False))
        text, differs = wanted(field, F.element_at(changes, F.lit(field)))
        new = text if kinds[name] == "string" else is_true(text) if kinds[name] == "boolean" else int_prefix(text).cast(kinds[name])
        out[name] = F.when(named & differs, new).otherwise(F.col(name))
    return rows.withColumns(out)


def apply_rename(df: DataFrame, plan: DataFrame) -> DataFrame:
    moved = _by_path(plan.where("status = 'changed'"), "dest")
    return df.join(moved, _same_path(), "left").withColumn("path", F.coalesce("dest", "path")).select(*df.columns)


def delete(df: DataFrame, paths: DataFrame) -> DataFrame:
    return df.join(paths.select("path"), "path", "left_anti").select(*df.columns)


def with_version(df: DataFrame, revs: DataFrame | None = None) -> DataFrame:
    """df with version: of a file's path, size and time of change, and of how often it was written here (revs: path, n; those of one path are added up)."""
    base = track_version(F.col("path"), F.col("size"), F.col("mod_time"))
    if revs is None:
        return df.withColumn("version", base)
    writes = _by_path(revs, "n").groupBy("__p1", "__p2").agg(F.sum("n").alias("__n"))
    met = df.join(writes, (half("path", 0) == F.col("__p1")) & (half("path", 1) == F.col("__p2")), "left")
    return met.withColumn("version", live_version(base, F.coalesce("__n", F.lit(0)))).select(*df.columns, "version")


def _one(df: DataFrame, id: str, if_match: str | None, revs: DataFrame | None = None) -> Row:
    """Path and version of one track; refused if it is not there, or its version is not if_match."""
    row = with_id(df).where(F.col("id") == id).select("path", "size", "mod_time")
    found = with_version(row, revs).select("path", F.col("version").alias("v")).head(1)
    if not found:
        raise NotFound(id)
    if if_match is not None and found[0].v != if_match:
        raise Conflict("the track has changed")
    return found[0]


def patch(df: DataFrame, id: str, changes: dict[str, str | None], if_match: str | None = None, revs: DataFrame | None = None) -> DataFrame:
    """A plan for one track; refused if it is not there, or its version is not if_match."""
    _one(df, id, if_match, revs)
    return plan_set(with_id(df).where(F.col("id") == id), changes)


def journal(plan: DataFrame) -> DataFrame:
    """What undo needs: path (after the change), fields (old values; null clears), source (old path of a rename), art (hash of the old picture)."""
    none = F.lit(None).cast("string")
    done = plan.where("status = 'changed'")
    if "dest" in plan.columns:
        return done.select(F.col("dest").alias("path"), F.lit(None).cast("map<string,string>").alias("fields"), F.col("path").alias("source"), none.alias("art"))
    return done.select("path", F.col("before").alias("fields"), none.alias("source"), none.alias("art"))


def restore(df: DataFrame, entries: DataFrame) -> DataFrame:
    """The table before the changes of a journal: what plan_map() and apply() would make of its fields, in one join."""
    fields = _by_path(entries.where("fields is not null"), F.col("fields").alias("__f"))

    def wanted(field: str, value: Column) -> tuple[Column, Column]:
        new = _wanted(field, value)
        return new, new != _as_text(field)

    rows = _written(df.join(fields, _same_path(), "left"), dict(df.dtypes), "__f", wanted).select(*df.columns)
    back = _by_path(entries.where("source is not null"), "source")
    return rows.join(back, _same_path(), "left").withColumn("path", F.coalesce("source", "path")).select(*df.columns)


def plan_artwork(rows: DataFrame, pictures: DataFrame, image: bytes | str | None) -> DataFrame:
    """A plan to give every row one picture (None removes it); pictures: path, art of the tracks that have one.

    image and art are both bytes, or both hashes of them. Tracks whose picture has the same bytes stay as they are.
    """
    met = with_id(rows).join(pictures.select(F.col("path").alias("__p"), "art"), F.col("path") == F.col("__p"), "left")
    new = F.lit(image) if image is not None else F.lit(None).cast(pictures.schema["art"].dataType)
    return met.select("id", "path", F.when(F.col("art").eqNullSafe(new), "same").otherwise("changed").alias("status"), F.col("art").alias("before"), new.alias("art"))


def refresh(df: DataFrame, decoded: DataFrame) -> DataFrame:
    """The table with the rows of files that were read anew in place of their old ones."""
    return df.join(decoded.select("path"), "path", "left_anti").select(*df.columns).unionByName(decoded.select(*df.columns))
