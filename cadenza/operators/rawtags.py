"""Raw tags, one row per native key of a file: listing, canonical names, and what a strip would remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_genre, parse_year, trim

#: Canonical tags with their ID3v2 frames, Vorbis comments and MP4 atoms.
VOCABULARY = {
    "title": (["TIT2"], ["TITLE"], ["©nam"]),
    "artist": (["TPE1"], ["ARTIST", "PERFORMER"], ["©ART"]),
    "album": (["TALB"], ["ALBUM"], ["©alb"]),
    "albumartist": (["TPE2"], ["ALBUMARTIST", "ALBUM ARTIST", "ENSEMBLE"], ["aART"]),
    "track": (["TRCK"], ["TRACKNUMBER", "TRACKTOTAL", "TOTALTRACKS"], ["trkn"]),
    "disc": (["TPOS"], ["DISCNUMBER", "DISCTOTAL", "TOTALDISCS"], ["disk"]),
    "genre": (["TCON"], ["GENRE"], ["©gen", "gnre"]),
    "date": (["TDRC", "TYER", "TDRL", "TDAT", "TRDA"], ["DATE", "YEAR", "RELEASEDATE"], ["©day"]),
    "compilation": (["TCMP"], ["COMPILATION"], ["cpil"]),
    "composer": (["TCOM"], ["COMPOSER"], ["©wrt"]),
    "titlesort": (["TSOT"], ["TITLESORT"], ["sonm"]),
    "artistsort": (["TSOP"], ["ARTISTSORT"], ["soar"]),
    "albumsort": (["TSOA"], ["ALBUMSORT"], ["soal"]),
    "albumartistsort": (["TSO2"], ["ALBUMARTISTSORT"], ["soaa"]),
    "composersort": (["TSOC"], ["COMPOSERSORT"], ["soco"]),
    "artwork": (["APIC"], ["METADATA_BLOCK_PICTURE", "COVERART", "COVERARTMIME"], ["covr"]),
    "comment": (["COMM"], ["COMMENT", "DESCRIPTION"], ["©cmt"]),
    "gapless": ([], [], ["pgap"]),
    "soundcheck": ([], [], []),
    "lyrics": (["USLT", "SYLT"], ["LYRICS", "UNSYNCEDLYRICS"], ["©lyr"]),
    "publisher": (["TPUB"], ["PUBLISHER", "LABEL", "ORGANIZATION"], ["©pub"]),
    "isrc": (["TSRC"], ["ISRC"], []),
    "bpm": (["TBPM"], ["BPM"], ["tmpo"]),
    "key": (["TKEY"], ["INITIALKEY", "KEY"], []),
    "mood": (["TMOO"], ["MOOD"], []),
    "language": (["TLAN"], ["LANGUAGE"], []),
    "copyright": (["TCOP"], ["COPYRIGHT", "LICENSE"], ["cprt"]),
    "encoder": (["TENC", "TSSE"], ["ENCODER", "ENCODEDBY", "ENCODED-BY", "ENCODER_OPTIONS"], ["©too", "©enc"]),
    "grouping": (["GRP1", "TIT1"], ["GROUPING", "CONTENTGROUP"], ["©grp"]),
    "movement": ([], ["MOVEMENTNAME", "MOVEMENT", "MOVEMENTTOTAL"], ["©mvn", "©mvi", "©mvc", "shwm"]),
    "conductor": (["TPE3"], ["CONDUCTOR"], ["©con"]),
    "lyricist": (["TEXT"], ["LYRICIST"], []),
    "remixer": (["TPE4"], ["REMIXER", "MIXARTIST"], []),
    "subtitle": (["TIT3"], ["SUBTITLE", "VERSION"], ["©st3"]),
    "originaldate": (["TORY", "TDOR", "TOAL", "TOPE"], ["ORIGINALDATE", "ORIGINALYEAR"], []),
    "mediatype": (["TMED"], ["MEDIA", "MEDIATYPE"], []),
    "replaygain": (["RVA2", "RVAD"], [], []),
    "musicbrainz": (["UFID"], [], []),
    "acoustid": ([], [], []),
    "rating": (["POPM", "PCNT"], ["RATING", "FMPS_RATING"], []),
    "url": (["WXXX", "WOAR", "WOAF", "WOAS", "WCOM", "WCOP", "WPUB", "WORS", "WPAY"], ["WWW", "CONTACT"], ["©url", "purl", "egid"]),
    "private": (["PRIV", "NCON", "GEOB", "MCDI"], [], []),
    "chapters": (["CHAP", "CTOC"], [], ["chpl"]),
    "itunes": ([], [], ["stik", "rtng", "purd", "apID", "ownr", "akID", "flvr", "xid ", "cnID", "atID", "plID", "geID", "sfID", "cmID", "rpdu", "rndu", "tvsh", "tven", "tvnn", "tvsn", "tves", "sosn", "hdvd"]),
}
#: Frames of ID3v2.2 by their names in version 2.3.
V22 = {
    "TT1": "TIT1", "TT2": "TIT2", "TT3": "TIT3", "TP1": "TPE1", "TP2": "TPE2", "TP3": "TPE3", "TP4": "TPE4", "TAL": "TALB", "TCO": "TCON", "TCM": "TCOM", "TXT": "TEXT",
    "TYE": "TYER", "TDA": "TDAT", "TIM": "TIME", "TRD": "TRDA", "TRK": "TRCK", "TPA": "TPOS", "TBP": "TBPM", "TLE": "TLEN", "TKE": "TKEY", "TLA": "TLAN", "TMT": "TMED", "TOA": "TOPE",
    "TOF": "TOFN", "TOL": "TOLY", "TOR": "TORY", "TOT": "TOAL", "TCR": "TCOP", "TPB": "TPUB", "TEN": "TENC", "TSS": "TSSE", "TRC": "TSRC", "TP0": "TPE1", "TST": "TSOT", "TSA": "TSOA",
    "TSP": "TSOP", "TCP": "TCMP", "TS2": "TSO2", "TSC": "TSOC", "COM": "COMM", "ULT": "USLT", "SLT": "SYLT", "WAF": "WOAF", "WAR": "WOAR", "WAS": "WOAS", "WCM": "WCOM",
    "WCP": "WCOP", "WPB": "WPUB", "WXX": "WXXX", "TXX": "TXXX", "UFI": "UFID", "IPL": "IPLS", "MCI": "MCDI", "PIC": "APIC", "GEO": "GEOB", "CNT": "PCNT", "POP": "POPM",
}
#: What ID3v2 frames hold.
MEANINGS = {
    "AENC": "audio encryption", "APIC": "attached picture (cover art)", "ASPI": "audio seek point index", "CHAP": "chapter", "COMM": "comment", "COMR": "commercial", "CTOC": "table of contents",
    "ENCR": "encryption", "EQU2": "equalisation", "ETCO": "event timing", "GEOB": "general encapsulated object", "GRID": "group identification", "GRP1": "grouping (iTunes)",
    "IPLS": "involved people (v2.3)", "LINK": "linked information", "MCDI": "music CD identifier", "MLLT": "MPEG location lookup", "MVIN": "movement number (iTunes)", "MVNM": "movement name (iTunes)",
    "NCON": "MusicMatch binary blob", "OWNE": "ownership", "PCNT": "play counter", "POPM": "popularimeter (rating / play count)", "POSS": "position synchronisation", "PRIV": "private data",
    "RGAD": "replay gain (non-standard)", "RVA2": "relative volume adjustment", "RVAD": "relative volume adjustment (v2.3)", "SEEK": "seek frame", "SYLT": "synchronised lyrics", "SYTC": "synchronised tempo",
    "TALB": "album", "TBPM": "beats per minute", "TCMP": "part of a compilation (iTunes)", "TCOM": "composer", "TCON": "genre", "TCOP": "copyright", "TDAT": "date DDMM (v2.3)", "TDEN": "encoding time",
    "TDLY": "playlist delay", "TDOR": "original release date", "TDRC": "recording date (v2.4)", "TDRL": "release date", "TDTG": "tagging time", "TENC": "encoded by", "TEXT": "lyricist", "TFLT": "file type",
    "TIME": "time (v2.3)", "TIPL": "involved people (v2.4)", "TIT1": "content group", "TIT2": "title", "TIT3": "subtitle", "TKEY": "initial key", "TLAN": "language", "TLEN": "length in ms",
    "TMCL": "musician credits", "TMED": "media type", "TMOO": "mood", "TOAL": "original album", "TOFN": "original filename", "TOLY": "original lyricist", "TOPE": "original artist", "TORY": "original release year",
    "TOWM": "owner", "TOWN": "owner", "TPE1": "artist", "TPE2": "album artist / band", "TPE3": "conductor", "TPE4": "remixer", "TPOS": "disc number", "TPRO": "produced notice", "TPUB": "publisher / label",
    "TRCK": "track number", "TRDA": "recording dates (v2.3)", "TSO2": "album artist sort (iTunes)", "TSOA": "album sort order", "TSOC": "composer sort (iTunes)", "TSOP": "artist sort order", "TSOT": "title sort order",
    "TSRC": "ISRC", "TSSE": "encoder settings", "TSST": "set subtitle", "TXXX": "user-defined text", "TYER": "year (v2.3)", "UFID": "unique file id (MusicBrainz)", "USER": "terms of use", "USLT": "unsynchronised lyrics",
    "WCOM": "commercial info URL", "WCOP": "copyright URL", "WOAF": "file web page", "WOAR": "artist web page", "WOAS": "source web page", "WORS": "radio station URL", "WPAY": "payment URL", "WPUB": "publisher URL",
    "WXXX": "user-defined URL",
}
#: What a strip keeps unless told otherwise.
KEEP = ("title", "artist", "album", "albumartist", "track", "disc", "genre", "date", "compilation", "composer", "artwork", "titlesort", "artistsort", "albumsort", "albumartistsort", "gapless", "soundcheck", "itunes")


#: What tags hold, in words.
SAYS = {
    "title": "song title", "artist": "track artist", "album": "album name", "albumartist": "album artist; keeps compilations together", "track": "track number", "disc": "disc number", "genre": "genre",
    "date": "release year or date", "compilation": "compilation flag; stops Various Artists albums splitting", "composer": "composer", "titlesort": "title sort order", "artistsort": "artist sort order",
    "albumsort": "album sort order", "albumartistsort": "album artist sort order", "composersort": "composer sort order", "artwork": "embedded cover art", "comment": "free-text comment",
    "gapless": "gapless playback data (iTunSMPB); losing it breaks gapless", "soundcheck": "iTunes volume normalisation (iTunNORM)", "lyrics": "lyrics", "publisher": "label or publisher", "isrc": "ISRC recording identifier",
    "bpm": "beats per minute", "key": "musical key", "mood": "mood", "language": "language", "copyright": "copyright notice", "encoder": "encoder name and settings", "grouping": "work or grouping",
    "movement": "movement name and number", "conductor": "conductor", "lyricist": "lyricist", "remixer": "remixer", "subtitle": "subtitle or version", "originaldate": "original release date", "mediatype": "source media",
    "replaygain": "loudness normalisation", "musicbrainz": "MusicBrainz identifiers", "acoustid": "AcoustID fingerprint", "rating": "rating and play count", "url": "web links", "private": "application private data",
    "chapters": "chapter markers", "itunes": "iTunes store, purchase and player fields",
}
#: Descriptions of extensible fields, whole or by how they begin (in this order), in upper case.
DESCRIBED = {"ITUNSMPB": "gapless", "ITUNPGAP": "gapless", "ITUNNORM": "soundcheck"}
DESCRIBED_PREFIX = {"ITUN": "itunes", "REPLAYGAIN": "replaygain", "MUSICBRAINZ": "musicbrainz", "MUSICIP": "musicbrainz", "ACOUSTID": "acoustid"}
#: Vorbis comments that are read and would be written under another name.
ALIASES = ("PERFORMER", "ALBUM ARTIST", "ENSEMBLE", "YEAR", "DESCRIPTION", "ENCODED-BY", "ORGANIZATION", "UNSYNCEDLYRICS", "MIXARTIST", "CONTENTGROUP")
APPLE = "com.apple.iTunes"
FORMATS = {"mp3": "id3", "flac": "vorbis", "ogg": "vorbis", "opus": "vorbis", "mp4": "mp4"}


def _native(kind: int) -> dict[str, str]:
    return {k: f for f, kinds in VOCABULARY.items() for k in kinds[kind]}


def _described() -> dict[str, str]:
    """Tags by a description, in upper case: by the names of Vorbis comments, else of ID3 frames, else of the tags themselves."""
    return {f.upper(): f for f in VOCABULARY} | _native(0) | _native(1)


def vocabulary(spark) -> DataFrame:
    """(vkey, vfield, exact) of native keys and descriptions, each key led by its kind: a dimension of a few hundred rows.

    exact: a tag's own name, which counts as a description only without blanks around it.
    """
    id3, own = _native(0), _native(0).keys() | _native(1).keys()
    rows = [(f"id3 {k}", f, False) for k, f in id3.items()] + [(f"id3 {old}", id3[new], False) for old, new in V22.items() if new in id3]
    rows += [(f"mp4 {k}", f, False) for k, f in _native(2).items()] + [("vorbis PICTURE", "artwork", False)]
    return spark.createDataFrame(rows + [(f"described {k}", f, k not in own) for k, f in _described().items()], "vkey string, vfield string, exact boolean")


def resolve(raw: DataFrame) -> DataFrame:
    """raw (path, format, key, value, bytes, n) with field, the canonical name or ''.

    What a key means depends on the format. Keys of extensible fields bear their description after a colon
    (TXXX:, COMM:, ----:), which decides: by whole name, then by how it begins, then by any vocabulary. A comment
    that no description tells otherwise is a comment. A freeform atom's namespace (column mean, or between two colons) counts last.
    Other formats than MP3, FLAC, Ogg, Opus and MP4 have no raw tags that are known here.
    """
    spark, key, kind = raw.sparkSession, F.col("key"), F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[F.lower("format")]
    tail = F.regexp_extract("key", r"(?s)^[^:]*:(.*)$", 1)
    spaced = F.regexp_extract(tail, r"(?s)^([\w-]+(?:\.[\w-]+)+):(.*)$", 1)
    mean = F.coalesce(F.nullif("mean", F.lit("")), spaced) if "mean" in raw.columns else spaced
    frame = F.substring_index("key", ":", 1)
    freeform, user, comment = (kind == "mp4") & (frame == "----"), (kind == "id3") & frame.isin("TXXX", "TXX"), (kind == "id3") & frame.isin("COMM", "COM")
    about = F.when(kind == "vorbis", key).when(freeform, F.when(spaced != "", F.substr(tail, F.char_length(spaced) + 2)).otherwise(tail)).when(user | comment, tail)
    told = trim(F.upper(about))
    by_rule = F.coalesce(*[F.when(told == k, F.lit(f)) for k, f in DESCRIBED.items()], *[F.when(told.startswith(k), F.lit(f)) for k, f in DESCRIBED_PREFIX.items()])
    looked = F.when((kind == "vorbis") & (key == "PICTURE"), F.lit("vorbis PICTURE")).when(about.isNotNull(), F.concat(F.lit("described "), told)).otherwise(F.concat(kind, F.lit(" "), key))
    rows = raw.withColumns({"__rule": by_rule, "__key": looked, "__about": about, "__else": F.when(comment, "comment").when(freeform & (mean == APPLE), "itunes").otherwise("")})
    dim = F.broadcast(vocabulary(spark))  # fixed size
    found = F.when(~F.col("exact") | (F.col("__about") == trim(F.col("__about"))), F.col("vfield"))
    joined = rows.join(dim, F.col("__key") == F.col("vkey"), "left").withColumn("field", F.coalesce("__rule", found, "__else"))
    return joined.drop("vkey", "vfield", "exact", "__rule", "__key", "__about", "__else")


def meaning(frame: Column) -> Column:
    """What an ID3v2 frame holds, in words; frames of v2.2 are named after their later ones."""
    words = F.create_map(*[F.lit(x) for pair in MEANINGS.items() for x in pair])
    later = F.create_map(*[F.lit(x) for pair in V22.items() for x in pair])
    return F.coalesce(words[frame], F.concat(words[later[frame]], F.lit(" (v2.2)")), F.lit("unknown"))


def tag_meaning(field: Column, frame: Column, format: Column) -> Column:
    """What a raw tag holds: what its canonical tag does, else for an ID3v2 frame what such frames do."""
    words = F.create_map(*[F.lit(x) for pair in SAYS.items() for x in pair])
    return F.coalesce(words[field], F.when(format == "mp3", meaning(frame)), F.lit(""))


def parse_keep(names: list[str]) -> set[str]:
    """Canonical tags of names in any vocabulary (MP4 atoms in their own case); 'default' stands for KEEP."""
    atoms, out = _native(2), set()
    for n in map(str.strip, names):
        if n.lower() == "default":
            out |= set(KEEP)
        elif found := n.lower() if n.lower() in VOCABULARY else _native(0).get(n.upper()) or _native(1).get(n.upper()) or atoms.get(n):
            out.add(found)
        elif n:
            raise ValueError(f"{n!r} is not a tag")
    return out


def strip_plan(raw: DataFrame, keep: set[str] | None = None, also: set[str] = frozenset()) -> DataFrame:
    """raw with kept."""
    kept = sorted((set(KEEP) if keep is None else keep) | also)
    return resolve(raw).withColumn("kept", F.col("field").isin(*kept))


def strip_report(plan: DataFrame, examples: int = 3) -> DataFrame:
    """What would go, by format and key: tracks, bytes, the first examples."""
    gone = plan.where(~F.col("kept"))
    groups = gone.groupBy("format", "key", "field").agg(F.count_distinct("path").alias("tracks"), F.sum("bytes").alias("bytes"))
    some = gone.withColumn("__n", F.row_number().over(Window.partitionBy("format", "key", "field").orderBy("path", "value"))).where(F.col("__n") <= examples)
    listed = some.groupBy("format", "key", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "value"))), lambda x: F.substring(x["value"], 1, 80)).alias("examples"))
    return groups.join(listed, ["format", "key", "field"])


def journal(plan: DataFrame) -> DataFrame:
    """What a strip takes, as a journal's entries: path and frames, the tags of a file in their order."""
    none = F.lit(None).cast("string")
    taken = F.transform(F.array_sort(F.collect_list(F.struct("n", "key", "value", "format", "bytes"))), lambda x: F.struct(x["format"].alias("format"), x["key"].alias("key"), x["value"].alias("value"), x["bytes"].cast("long").alias("bytes")))
    gone = plan.where(~F.col("kept")).groupBy("path").agg(taken.alias("frames"))  # as many as a file has tags
    return gone.select("path", F.lit(None).cast("map<string,string>").alias("fields"), none.alias("source"), none.alias("art"), "frames")


def unstrip(stripped: DataFrame, entries: DataFrame) -> DataFrame:
    """Raw tags (path, format, key, value, bytes, n) with those of a journal's entries back behind them; what a file still holds is not added again."""
    back = entries.select("path", F.posexplode("frames").alias("__at", "x")).select("path", "x.format", "x.key", "x.value", "x.bytes", "__at")
    there = stripped.select(F.col("path").alias("__p"), F.col("key").alias("__k"), F.col("value").alias("__v"))
    back = back.join(there, (F.col("path") == F.col("__p")) & (F.col("key") == F.col("__k")) & F.col("value").eqNullSafe(F.col("__v")), "left_anti")
    last = stripped.groupBy(F.col("path").alias("__p")).agg(F.max("n").alias("__n"))
    rows = back.join(last, F.col("path") == F.col("__p"), "left").withColumn("n", F.coalesce(F.col("__n"), F.lit(-1)) + 1 + F.col("__at"))
    kinds = dict(stripped.dtypes)
    names = ("path", "format", "key", "value", "bytes", "n")
    return stripped.select(*names).unionByName(rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names]))


def edit_raw(raw: DataFrame, key: str, value: str | None) -> tuple[DataFrame, DataFrame]:
    """Set a native key: (rows after, errors by path).

    The first row of the key gets the value and its others go; null or blank removes it. A file without the
    key is an error, as is one whose first row is not text (column editable), unless it is removed; the rows
    of such files stay as they are.
    """
    value = (value or "").strip() or None
    own = F.col("key") == key
    editable = F.col("editable") if "editable" in raw.columns else F.lit(True)
    by = Window.partitionBy("path")
    rows = raw.withColumns({"__n": F.when(own, F.row_number().over(Window.partitionBy("path", own).orderBy("n"))), "__has": F.max(own.cast("int")).over(by)})
    rows = rows.withColumn("__bad", F.max(F.when((F.col("__n") == 1) & ~editable, 1).otherwise(0)).over(by) if value is not None else F.lit(0))
    said = F.when(F.col("__has") == 0, f"the file has no {key}").when(F.col("__bad") == 1, f"{key} is not text, so it can only be removed")
    errors = rows.select("path", said.alias("error")).where("error is not null").distinct()
    gone = F.col("__n").isNotNull() & (F.col("__bad") == 0) & (F.lit(value is None) | (F.col("__n") > 1))
    after = rows.where(~gone).withColumn("value", F.when((F.col("__n") == 1) & (F.col("__bad") == 0), F.lit(value)).otherwise(F.col("value")))
    return after.select(*raw.columns), errors


def non_canonical(plan: DataFrame) -> DataFrame:
    """(path, fields): kept tags that files hold otherwise than they would be written, of a strip's plan.

    These are: any of an ID3v2.2 tag (column v22), a user-defined frame for what has one of its own, a genre as a number, a date
    of more than a year, a Vorbis comment under a name that is only read, and a year without a release date beside it.
    """
    of = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[F.lower("format")]
    text, frame, field = F.coalesce(F.col("text") if "text" in plan.columns else F.lit(None), "value"), F.substring_index("key", ":", 1), F.col("field")
    framed = field.isin(*_native(0).values())
    by_key = F.when(of == "id3", (F.col("v22") if "v22" in plan.columns else F.lit(False)) | ((frame == "TXXX") & framed)).when(of == "vorbis", F.upper("key").isin(*ALIASES)).when(of == "mp4", F.col("key") == "gnre")
    genre = (of == "id3") & (field == "genre") & (normalise_genre(text) != text)
    dated = (field == "date") & date_beyond_year(text, parse_year(text)) & ((of != "mp4") | (F.col("key") == "©day"))
    rows = plan.withColumn("__odd", F.coalesce(by_key, F.lit(False)) | genre | dated)
    year = ((of == "id3") & frame.isin("TYER", "TDRC")) | ((of == "vorbis") & F.upper("key").isin("DATE", "YEAR") & (trim(text) != ""))
    release = ((of == "id3") & (frame == "TDRL")) | ((of == "vorbis") & (F.upper("key") == "RELEASEDATE") & (trim(text) != ""))
    kept = rows.where("kept").groupBy("path").agg(F.collect_set(F.when(F.col("__odd"), field)).alias("odd"), F.max(year).alias("y"), F.max(release).alias("r"))  # as many as there are tags
    fields = F.array_sort(F.array_union("odd", F.when(F.col("y") & ~F.col("r"), F.array(F.lit("date"))).otherwise(F.array().cast("array<string>"))))
    return kept.select("path", fields.alias("fields")).where(F.size("fields") > 0)


def date_beyond_year(date: Column, year: Column) -> Column:
    return (F.char_length(trim(date)) != 4) & (year > 0)
