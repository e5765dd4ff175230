"""The catalogue's data model: tracks, their fields, and how a field renders as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 4

TEXT = ["path", "title", "artist", "album_artist", "album", "genre", "composer", "comment", "title_sort", "artist_sort", "album_sort", "album_artist_sort", "composer_sort", "mb_artist_id", "mb_album_artist_id"]
INTS = ["year", "track_no", "track_total", "disc", "disc_total", "duration_ms", "bitrate", "sample_rate"]

TRACK = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in TEXT]
    + [T.StructField(n, T.LongType(), False) for n in ("size", "mod_time")]
    + [T.StructField(n, T.IntegerType(), False) for n in INTS]
    + [T.StructField("channels", T.ShortType(), False), T.StructField("format", T.StringType(), False), T.StructField("has_art", T.BooleanType(), False), T.StructField("compilation", T.BooleanType(), False)]
)

#: The names by which queries and edits know the fields, with their other spellings, and their columns.
FIELDS = {
    "title": ("title", ["t"]),
    "artist": ("artist", ["a", "ar"]),
    "albumartist": ("album_artist", ["aa", "band"]),
    "album": ("album", ["al", "b"]),
    "genre": ("genre", ["g"]),
    "composer": ("composer", ["c"]),
    "comment": ("comment", []),
    "year": ("year", ["y", "date"]),
    "track": ("track_no", ["trackno", "n"]),
    "disc": ("disc", ["d"]),
    "compilation": ("compilation", ["comp", "va"]),
    "path": ("path", ["p", "file"]),
    "titlesort": ("title_sort", ["ts"]),
    "artistsort": ("artist_sort", ["as"]),
    "albumsort": ("album_sort", ["als"]),
    "albumartistsort": ("album_artist_sort", ["aas"]),
    "composersort": ("composer_sort", ["cs"]),
    "mbartistid": ("mb_artist_id", ["musicbrainz_artistid"]),
    "mbalbumartistid": ("mb_album_artist_id", ["musicbrainz_albumartistid"]),
}
NUMERIC = ("year", "track", "disc", "compilation")
#: What a term without a field looks in.
DISPLAY = ("title", "artist", "albumartist", "album", "genre", "composer", "comment")
EDITABLE = [f for f in FIELDS if f != "path"]
_LOOKUP = {n: f for f, (_, others) in FIELDS.items() for n in (f, *others)}


def lookup(name: str) -> str | None:
    """The field that a name stands for, in any case."""
    return _LOOKUP.get(name.lower())


def column(field: str) -> Column:
    return F.col(FIELDS[field][0])


def rendered(field: str) -> Column:
    """A field as text: numbers in decimal with 0 as '', the compilation flag as '1' or ''."""
    c = column(field)
    if field == "compilation":
        return F.when(c, "1").otherwise("")
    if field in NUMERIC:
        return F.when(c == 0, "").otherwise(c.cast("string"))
    return c


def conform(df: DataFrame) -> DataFrame:
    """df with every column of the model: missing ones empty, nulls replaced, types cast."""
    have = set(df.columns)
    zero = {"string": "", "boolean": False}
    out = []
    for f in TRACK:
        kind = f.dataType.simpleString()
        empty = F.lit(zero.get(kind, 0)).cast(kind)
        out.append((F.coalesce(F.col(f.name).cast(kind), empty) if f.name in have else empty).alias(f.name))
    return df.select(*out)
