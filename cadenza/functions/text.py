"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that fold to one ASCII letter, by that letter.
LETTERS = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł",
    "n": "ñńņňŉŋ", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšſ", "t": "ţťŧ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
#: Letters that fold to two.
PAIRS = {"æ": "ae", "œ": "oe", "ĳ": "ij", "ß": "ss", "þ": "th"}
_FROM = "".join(LETTERS.values())
_TO = "".join(k * len(v) for k, v in LETTERS.items())


def fold(c: Column) -> Column:
    """Lower case without the diacritics of Latin-1 and Latin Extended-A, and without combining marks.

    A text of as many bytes as characters is ASCII, and lower case is all that it needs.
    """
    lower = F.lower(c)
    out = F.translate(lower, _FROM + "ς", _TO + "σ")
    for letter, two in PAIRS.items():
        out = F.replace(out, F.lit(letter), F.lit(two))
    return F.when(F.octet_length(c) == F.char_length(c), lower).otherwise(F.regexp_replace(out, r"\p{Mn}", ""))


def fold_text(s: str) -> str:
    """fold() for a literal."""
    import unicodedata

    table = str.maketrans(dict(zip(_FROM + "ς", _TO + "σ", strict=True)) | PAIRS)
    return "".join(c for c in s.lower().translate(table) if unicodedata.category(c) != "Mn")


def fold_sql(x: str) -> str:
    """The same in DuckDB."""
    out = f"translate(lower({x}), '{_FROM}ς', '{_TO}σ')"
    for letter, two in PAIRS.items():
        out = f"replace({out}, '{letter}', '{two}')"
    return f"regexp_replace({out}, '\\p{{Mn}}', '', 'g')"


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _visible(c: Column) -> Column:
    """Whether a text starts with a printing character of ASCII; texts are compared by bytes."""
    return (c >= "!") & (c < "\x7f")


def trim_column(c: Column) -> Column:
    """trim() for a column as it stands: a text that starts and ends with printing characters of ASCII is not searched."""
    return F.when(_visible(c) & _visible(F.right(c, F.lit(1))), c).otherwise(trim(c))


def int_text(c: Column) -> Column:
    """A number in decimal, 0 as ''."""
    return F.when(c == 0, "").otherwise(c.cast("string"))


def int_prefix(c: Column) -> Column:
    """The whole number that a text starts with, else 0; what exceeds 32 bits is 0."""
    return F.coalesce(F.regexp_extract(trim(c), r"^[+-]?[0-9]+", 0).try_cast("int"), F.lit(0))


def pair(c: Column) -> Column:
    """number and total of 'n/total' or 'n-total'."""
    parts = F.split(c, r"[/-]", 2)
    return F.struct(int_prefix(parts[0]).alias("number"), int_prefix(F.coalesce(F.get(parts, 1), F.lit(""))).alias("total"))


def is_true(c: Column) -> Column:
    """Anything but empty, 0, false, no and off."""
    return ~F.lower(trim(c)).isin("", "0", "false", "no", "off")


def is_true_tag(c: Column) -> Column:
    """The same for flags in tags, where a NUL is false and 'off' is not."""
    return ~F.lower(trim(F.replace(c, F.lit("\0"), F.lit("")))).isin("", "0", "false", "no")


def parse_year(c: Column) -> Column:
    """The first run of exactly four digits from 1000 to 3000, else 0."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), 1), lambda x: x.cast("int"))
    return F.coalesce(F.get(F.filter(runs, lambda y: (y >= 1000) & (y <= 3000)), 0), F.lit(0))


def split_multi(c: Column) -> Column:
    """Values of a field that joins them by semicolons."""
    return F.filter(F.transform(F.split(c, ";"), trim), lambda x: x != "")


def join_multi(values: Column) -> Column:
    return F.array_join(values, "; ")


#: Genres by number (ID3v1 and its common extension).
GENRES = (
    "Blues|Classic Rock|Country|Dance|Disco|Funk|Grunge|Hip-Hop|Jazz|Metal|New Age|Oldies|Other|Pop|R&B|Rap|Reggae|Rock|Techno|Industrial|Alternative|Ska|Death Metal|Pranks|Soundtrack|Euro-Techno|Ambient|Trip-Hop|Vocal|Jazz+Funk|Fusion|Trance|Classical|Instrumental|Acid|House|Game|Sound Clip|Gospel|Noise|"
    "AlternRock|Bass|Soul|Punk|Space|Meditative|Instrumental Pop|Instrumental Rock|Ethnic|Gothic|Darkwave|Techno-Industrial|Electronic|Pop-Folk|Eurodance|Dream|Southern Rock|Comedy|Cult|Gangsta|Top 40|Christian Rap|Pop/Funk|Jungle|Native American|Cabaret|New Wave|Psychadelic|Rave|Showtunes|Trailer|Lo-Fi|Tribal|Acid Punk|Acid Jazz|Polka|Retro|Musical|Rock & Roll|Hard Rock|"
    "Folk|Folk-Rock|National Folk|Swing|Fast Fusion|Bebob|Latin|Revival|Celtic|Bluegrass|Avantgarde|Gothic Rock|Progressive Rock|Psychedelic Rock|Symphonic Rock|Slow Rock|Big Band|Chorus|Easy Listening|Acoustic|Humour|Speech|Chanson|Opera|Chamber Music|Sonata|Symphony|Booty Bass|Primus|Porn Groove|Satire|Slow Jam|Club|Tango|Samba|Folklore|"
    "Ballad|Power Ballad|Rhythmic Soul|Freestyle|Duet|Punk Rock|Drum Solo|A capella|Euro-House|Dance Hall|Goa|Drum & Bass|Club-House|Hardcore|Terror|Indie|BritPop|Negerpunk|Polsk Punk|Beat|Christian Gangsta|Heavy Metal|Black Metal|Crossover|Contemporary Christian|Christian Rock|Merengue|Salsa|Trash Metal|Anime|Jpop|Synthpop"
).split("|")


def normalise_genre(c: Column) -> Column:
    """'(17)', '17' -> the numbered genre; '(17)Hard Rock' -> the text; '(RX)', '(CR)' -> Remix, Cover; '(x)' -> x."""
    names = F.array(*map(F.lit, GENRES))
    t = trim(c)
    inner, rest = F.regexp_extract(t, r"^\(([^)]*)\)", 1), trim(F.regexp_replace(t, r"^\([^)]*\)", ""))
    numbered = lambda x: F.get(names, x.try_cast("int"))
    named = F.when(inner == "RX", "Remix").when(inner == "CR", "Cover").when(inner.rlike("^[0-9]+$"), numbered(inner))
    return F.when(t.rlike(r"^\([^)]+\)"), F.when(rest != "", rest).otherwise(F.coalesce(named, inner))).when(t.rlike("^[0-9]+$"), F.coalesce(numbered(t), t)).otherwise(t)


_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def is_mbid(c: Column) -> Column:
    return c.rlike(_UUID)


def _mbids(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[\x00/;, \t\n\r]+"), F.lower), lambda x: x != ""))


def normalise_mbids(c: Column) -> Column:
    """Identifiers joined by '; ', or null if any part is not one."""
    return F.when(F.forall(_mbids(c), is_mbid), join_multi(_mbids(c)))


def join_mbids(c: Column) -> Column:
    """The parts that are identifiers, joined by '; '."""
    return join_multi(F.filter(_mbids(c), is_mbid))


def first_mbid(c: Column) -> Column:
    return F.coalesce(F.get(F.filter(_mbids(c), is_mbid), 0), F.lit(""))


def letters_key(c: Column) -> Column:
    """The letters of a tag description, in upper case."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z]", ""))


def sanitise_segment(c: Column) -> Column:
    """A value as one segment of a path: separators become dashes, what file names may not hold underscores."""
    seen = F.translate(c, '/\\:*?"<>|', "--_______")
    return F.when(seen.rlike(r"(?U)[\x00-\x1f\x7f]|^\s|\s\z"), trim(F.regexp_replace(seen, r"[\x00-\x1f\x7f]", ""))).otherwise(seen)


def tidy_path(c: Column) -> Column:
    """Segments without blanks, dashes and underscores at their ends and dots at the end; what is then empty goes."""
    edges = lambda s: trim(F.regexp_replace(trim(s), r"^[ \-_]+|[ \-_]+\z", ""))
    parts = F.transform(F.split(c, "/"), lambda s: F.regexp_replace(edges(s), r"[.]+\z", ""))
    # most paths have nothing of that: one search tells
    untidy = c.rlike(r"(?U)(?:\A|/)(?:[\s\-_/]|\z)|[\s\-_.](?:/|\z)")
    return F.when(untidy, F.array_join(F.filter(parts, lambda s: s != ""), "/")).otherwise(c)


def dirname(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(basename(c), r"\.([^.]*)$", 1))


#: Formats by extension.
EXTENSIONS = {"mp3": "mp3", "flac": "flac", "m4a": "mp4", "m4b": "mp4", "mp4": "mp4", "aac": "mp4", "ogg": "ogg", "oga": "ogg", "opus": "opus", "wma": "wma", "wav": "wav", "aiff": "aiff", "aif": "aiff"}
MIME = {"mp3": "audio/mpeg", "flac": "audio/flac", "mp4": "audio/mp4", "ogg": "audio/ogg", "opus": "audio/ogg", "wma": "audio/x-ms-wma", "wav": "audio/wav", "aiff": "audio/aiff"}
WRITABLE = ("mp3", "flac", "mp4", "ogg", "opus")


def format_for(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def mime_for(fmt: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(known, fmt), F.lit("application/octet-stream"))


def writable(fmt: Column) -> Column:
    return fmt.isin(*WRITABLE)


def image_mime(data: Column) -> Column:
    """Of an image, by its first bytes."""
    starts = lambda h: F.hex(F.substring(data, 1, len(h) // 2)) == h
    return F.when(starts("FFD8FF"), "image/jpeg").when(starts("89504E47"), "image/png").when(starts("47494638"), "image/gif").when(starts("424D"), "image/bmp").when(starts("52494646") & (F.hex(F.substring(data, 9, 4)) == "57454250"), "image/webp").otherwise("")


def format_millis(c: Column) -> Column:
    """m:ss, or h:mm:ss."""
    s = F.floor(c / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def format_bytes(c: Column) -> Column:
    scaled = [(1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")]
    out = F.lit(None).cast("string")
    for size, unit in scaled:
        out = F.coalesce(out, F.when(c >= size, F.format_string(f"%.1f {unit}", c / size)))
    return F.coalesce(out, F.format_string("%d B", c))


def format_count(c: Column) -> Column:
    return F.format_number(c, 0)


def format_track_no(disc: Column, track: Column) -> Column:
    number = F.when(track > 0, F.lpad(track.cast("string"), 2, "0")).otherwise("")
    return F.when(disc > 0, F.concat(disc.cast("string"), F.lit("-"), number)).otherwise(number)


def number_pair(number: Column, total: Column) -> Column:
    """'n/total', 'n', or '' where both are absent."""
    return F.when(total > 0, F.concat(number.cast("string"), F.lit("/"), total.cast("string"))).when(number > 0, number.cast("string")).otherwise("")


def escape_lucene(c: Column) -> Column:
    return F.regexp_replace(c, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")


def keep_order_distinct(values: Column) -> Column:
    """Without empty values and repetitions, in order."""
    return F.array_distinct(F.filter(values, lambda x: x != ""))
