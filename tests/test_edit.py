import pytest
from pyspark.sql import functions as F

from cadenza import schema
from cadenza.functions import hashing
from cadenza.operators import edit, rawtags
from cadenza.operators.edit import BadRequest, BadTemplate, Conflict, NotFound, Selector


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [
        ("/m/a.mp3", "Elvis Presley", "", "The Sun Sessions", "Blue Suede Shoes", 3, 1955, False),
        ("/m/b.mp3", "AC/DC", "", "Back", "Hells Bells", 12, 0, False),
        ("/m/c.flac", "Björk", "Various", "Post", "Jóga", 0, 1997, True),
        ("/m/d.mp3", "Elvis Presley", "", "The Sun Sessions", "Blue Suede Shoes", 3, 1955, False),
    ]
    return schema.conform(spark.createDataFrame(rows, "path string, artist string, album_artist string, album string, title string, track_no int, year int, compilation boolean")).cache()


def test_selectors(tracks):
    a = hashing.fnv_text(b"/m/a.mp3")
    assert [r.path for r in edit.resolve(tracks, Selector(ids=(a, "zz"))).collect()] == ["/m/a.mp3"]
    assert edit.resolve(tracks, Selector(query="artist:elvis", exclude_ids=(a,))).count() == 1
    assert edit.resolve(tracks, Selector(all=True, expect_count=4)).count() == 4
    with pytest.raises(Conflict):
        edit.resolve(tracks, Selector(query="artist:elvis", expect_count=3))
    with pytest.raises(BadRequest):
        edit.resolve(tracks, Selector())


def test_set_apply_restore(tracks):
    plan = edit.plan_set(tracks, {"AA": "Various", "year": " 2001 ", "compilation": "yes", "comment": None}).cache()
    r = edit.report(plan).first()
    assert (r.matched, r.changed, r.same) == (4, 4, 0)
    by = {x.path: x for x in plan.collect()}
    assert by["/m/c.flac"].changes == {"year": "2001"} and by["/m/c.flac"].before == {"year": "1997"}
    assert by["/m/b.mp3"].before == {"albumartist": None, "year": None, "compilation": None}
    done = edit.apply(tracks, plan)
    assert done.columns == tracks.columns and done.where("album_artist = 'Various' and year = 2001 and compilation").count() == 4
    back = edit.restore(done, edit.journal(plan))
    assert sorted(map(str, back.collect())) == sorted(map(str, tracks.collect()))
    assert edit.report(edit.plan_set(done, {"year": "2001"})).first().same == 4
    for bad in ({}, {"path": "x"}, {"year": "abc"}, {"mbartistid": "nope"}):
        with pytest.raises(BadRequest):
            edit.validate(bad)


def test_patch(tracks):
    i = hashing.fnv_text(b"/m/a.mp3")
    assert edit.patch(tracks, i, {"title": "New"}).first().changes == {"title": "New"}
    with pytest.raises(Conflict):
        edit.patch(tracks, i, {"title": "New"}, if_match="0")
    with pytest.raises(NotFound):
        edit.patch(tracks, "0", {"title": "New"})


def test_split(spark, tracks):
    cases = [("$artist - $title", "Jay-Z - 99 Problems", {"artist": "Jay-Z", "title": "99 Problems"}), ("$artist - $title", "Faithless - Insomnia - Monster Mix", {"artist": "Faithless", "title": "Insomnia - Monster Mix"}), ("$artist - $title", "Atomic", None), ("$artist - $title", "- Atomic", None), ("$$$artist - $title", "$Money Man - Cash", {"artist": "Money Man", "title": "Cash"}), ("$title (live)", "One (live)", {"title": "One"})]
    got = spark.range(1).select(*[edit.split_title(t, F.lit(x)).alias(f"c{k}") for k, (t, x, _) in enumerate(cases)]).first()
    assert [got[k] for k in range(len(cases))] == [w for _, _, w in cases]
    for bad in ("", "no fields", "$path", "$mbartistid", "$artist $artist", "$title", "$artist - $a", "$", "$nonsense"):
        with pytest.raises(BadTemplate):
            edit.split_pattern(bad)
    assert {r.path: r.status for r in edit.plan_split(tracks, "$artist $title").collect()}["/m/c.flac"] == "skipped"


def test_rename(tracks):
    plan = edit.plan_rename(tracks, "$albumartist/$album/$track $title", ("/m",)).cache()
    by = {r.path: (r.status, r.dest) for r in plan.collect()}
    assert by["/m/a.mp3"] == ("changed", "/m/Elvis Presley/The Sun Sessions/03 Blue Suede Shoes.mp3")
    assert by["/m/b.mp3"] == ("changed", "/m/AC-DC/Back/12 Hells Bells.mp3")
    assert by["/m/c.flac"][0] == "incomplete" and by["/m/d.mp3"][0] == "collision"
    done = edit.apply_rename(tracks, plan)
    assert done.where("path like '/m/AC-DC/%'").count() == 1
    assert sorted(r.path for r in edit.restore(done, edit.journal(plan)).collect()) == ["/m/a.mp3", "/m/b.mp3", "/m/c.flac", "/m/d.mp3"]
    taken = tracks.select(F.lit("/m/AC-DC/Back/12 Hells Bells.mp3").alias("path")).limit(1)
    assert {r.path: r.status for r in edit.plan_rename(tracks, "$artist/$album/$track $title", ("/m",), taken).collect()}["/m/b.mp3"] == "collision"
    for bad in ("", "/abs/$title", "none", "$path"):
        with pytest.raises(BadTemplate):
            edit.plan_rename(tracks, bad, ("/m",))


def test_raw_tags(spark):
    raw = spark.createDataFrame([("/a", "mp3", "TIT2", "One", 5, 0), ("/a", "mp3", "TSSE", "LAME", 9, 1), ("/b", "flac", "title", "Two", 5, 0), ("/b", "flac", "Odd", "x", 3, 1), ("/b", "flac", "Odd", "y", 3, 2)], "path string, format string, key string, value string, bytes int, n int")
    report = {r.key: (r.tracks, r.bytes, r.examples) for r in rawtags.strip_report(rawtags.strip_plan(raw)).collect()}
    assert report == {"TSSE": (1, 9, ["LAME"]), "Odd": (1, 6, ["x", "y"])}
    assert rawtags.parse_keep(["TIT2", "lyrics", "default"]) >= {"title", "lyrics", "disc"}
    after, errors = rawtags.edit_raw(raw, "Odd", " z ")
    assert [(r.key, r.value) for r in after.where("path = '/b'").orderBy("n").collect()] == [("title", "Two"), ("Odd", "z")]
    assert [(r.path, r.error) for r in errors.collect()] == [("/a", "the file has no Odd")]
    assert rawtags.edit_raw(raw, "Odd", None)[0].count() == 3
    binary = raw.withColumn("editable", F.col("key") != "TSSE")
    after, errors = rawtags.edit_raw(binary.where("path = '/a'"), "TSSE", "x")
    assert after.count() == 2 and "only be removed" in errors.first().error
    assert rawtags.edit_raw(binary, "TSSE", " ")[0].where("key = 'TSSE'").count() == 0


def test_vocabulary(spark):
    """Every native key of a format resolves to its tag, and frames of ID3v2.2 by their successors; Vorbis comments in any case."""
    of = {f: {k: name for name, kinds in rawtags.VOCABULARY.items() for k in kinds[n]} for n, f in enumerate(("mp3", "flac", "mp4"))}
    of["mp3"] |= {old: of["mp3"].get(new, "") for old, new in rawtags.V22.items()} | {"COM": "comment", "tyer": "", "Nonsense": "", "DATE": ""}
    of["opus"] = {k.lower(): v for k, v in of["flac"].items()} | {"PICTURE": "artwork", "TIT2": "title", "soundcheck": "soundcheck"}
    of["wav"] = {"TIT2": ""}
    raw = spark.createDataFrame([("/a", f, k, "v", 1, 0) for f, keys in of.items() for k in keys], "path string, format string, key string, value string, bytes int, n int")
    got = {f: {} for f in of}
    for r in rawtags.resolve(raw).collect():
        got[r.format][r.key] = r.field
    assert got == of
    kept = {r.key for r in rawtags.strip_plan(raw).where("kept").collect()}
    assert {"TYER", "TYE", "ALBUM ARTIST", "gnre", "pgap", "stik"} <= kept and not {"TSSE", "POPM", "MUSICBRAINZ"} & kept
    assert len(rawtags.VOCABULARY) == 44 and len(rawtags.KEEP) == 18 and set(rawtags.KEEP) <= set(rawtags.VOCABULARY) == set(rawtags.SAYS)


#: (format, key, tag, whether a default strip keeps it), by the rules for descriptions.
DESCRIBED = [
    ("mp3", "COMM:iTunSMPB", "gapless", True), ("mp3", "TXXX:iTunPGAP", "gapless", True), ("mp3", "TXXX: itunnorm ", "soundcheck", True), ("mp3", "COMM:iTunes_CDDB_1", "itunes", True), ("mp3", "COMM", "comment", False),
    ("mp3", "COMM:anything", "comment", False), ("mp3", "COMM:ID3v1 Comment", "comment", False), ("mp3", "TXXX:TCMP", "compilation", True), ("mp3", "TXXX:comment", "comment", False), ("mp3", "TXXX:Mood", "mood", False),
    ("mp3", "TXXX:replaygain_track_gain", "replaygain", False), ("mp3", "TXXX:MusicBrainz Artist Id", "musicbrainz", False), ("mp3", "TXXX:MusicIP PUID", "musicbrainz", False), ("mp3", "TXXX:Acoustid Id", "acoustid", False),
    ("mp3", "TXXX:Gapless", "gapless", True), ("mp3", "TXXX:gapless ", "", False), ("mp3", "TXXX:anything", "", False), ("mp3", "TXXX", "", False), ("mp3", "TXX:mood", "mood", False), ("mp3", "COM:iTunNORM", "soundcheck", True),
    ("flac", "iTunSMPB", "gapless", True), ("flac", "ITUNNORM", "soundcheck", True), ("flac", "REPLAYGAIN_ALBUM_PEAK", "replaygain", False), ("ogg", "musicbrainz_trackid", "musicbrainz", False), ("opus", "ACOUSTID_ID", "acoustid", False),
    ("flac", "TCMP", "compilation", True), ("mp4", "----:iTunSMPB", "gapless", True), ("mp4", "----:com.apple.iTunes:iTunNORM", "soundcheck", True), ("mp4", "----:com.apple.iTunes:tool", "itunes", True),
    ("mp4", "----:com.apple.iTunes:MusicBrainz Album Id", "musicbrainz", False), ("mp4", "----:org.example.app:thing", "", False), ("mp4", "----:thing", "", False), ("mp4", "----", "", False), ("mp4", "----:a: b", "", False),
]


def test_descriptions_decide(spark):
    rows = [("/a", f, k, "v", 1, n) for n, (f, k, *_) in enumerate(DESCRIBED)]
    raw = spark.createDataFrame(rows, "path string, format string, key string, value string, bytes int, n int")
    got = {r.n: (r.field, r.kept) for r in rawtags.strip_plan(raw).collect()}
    assert [got[n] for n in range(len(rows))] == [x[2:] for x in DESCRIBED]
    told = raw.where("key in ('----:thing', '----:iTunSMPB')").withColumn("mean", F.lit("com.apple.iTunes"))
    assert {r.key: r.field for r in rawtags.resolve(told).collect()} == {"----:thing": "itunes", "----:iTunSMPB": "gapless"}
    says = rawtags.resolve(raw).select("key", rawtags.tag_meaning(F.col("field"), F.substring_index("key", ":", 1), F.col("format")).alias("m"))
    assert {r.key: r.m for r in says.collect()}["TXXX:anything"] == "user-defined text"


def test_kept_tags_in_other_forms(spark):
    rows = [
        ("/a", "mp3", "TXXX:TCMP", "1", False), ("/a", "mp3", "TCON", "(19)", False), ("/a", "mp3", "TIT2", "x", False), ("/b", "mp3", "TDRC", "2011-08-29", False), ("/c", "mp3", "TYER", "1999", False),
        ("/d", "mp3", "TYER", "1999", False), ("/d", "mp3", "TDRL", "1999", False), ("/e", "mp3", "TPE1", "x", True), ("/f", "flac", "PERFORMER", "x", False), ("/g", "flac", "DATE", "1999", False), ("/h", "mp4", "gnre", "9", False),
        ("/i", "mp4", "©day", "2011-08-29T07:00:00Z", False), ("/j", "mp4", "©day", "2011", False), ("/k", "flac", "DATE", "1999", False), ("/k", "flac", "releasedate", "1999", False), ("/l", "mp3", "TXXX:iTunNORM", "x", False),
        ("/m", "mp3", "TXXX:Mood", "x", False),
    ]
    raw = spark.createDataFrame([(p, f, k, v, 1, n, old) for n, (p, f, k, v, old) in enumerate(rows)], "path string, format string, key string, value string, bytes int, n int, v22 boolean")
    got = {r.path: r.fields for r in rawtags.non_canonical(rawtags.strip_plan(raw)).collect()}
    assert got == {"/a": ["compilation", "genre"], "/b": ["date"], "/c": ["date"], "/e": ["artist"], "/f": ["artist"], "/g": ["date"], "/h": ["genre"], "/i": ["date"]}


def test_rename_claims(spark):
    """What is incomplete or stays where it is claims no place."""
    rows = [("/m/a.mp3", "", "T", 1), ("/m/b.mp3", "X", "T", 1), ("/m/c.mp3", "X", "T", 1), ("/m/X/01 T.mp3", "X", "T", 1)]
    t = schema.conform(spark.createDataFrame(rows, "path string, artist string, title string, track_no int"))
    got = {r.path: r.status for r in edit.plan_rename(t, "$artist/$track $title", ("/m",)).collect()}
    assert got == {"/m/a.mp3": "incomplete", "/m/b.mp3": "changed", "/m/c.mp3": "collision", "/m/X/01 T.mp3": "same"}


def test_artwork_and_refresh(spark, tracks):
    art = spark.createDataFrame([("/m/a.mp3", bytearray(b"one")), ("/m/b.mp3", bytearray(b"two"))], "path string, art binary")
    got = {r.path: r.status for r in edit.plan_artwork(tracks, art, b"one").collect()}
    assert got == {"/m/a.mp3": "same", "/m/b.mp3": "changed", "/m/c.flac": "changed", "/m/d.mp3": "changed"}
    assert {r.path for r in edit.plan_artwork(tracks, art, None).where("status = 'changed'").collect()} == {"/m/a.mp3", "/m/b.mp3"}
    new = tracks.where("path = '/m/a.mp3'").withColumn("title", F.lit("Read anew"))
    done = edit.refresh(tracks, new)
    assert done.count() == 4 and done.where("title = 'Read anew'").count() == 1


def test_a_strip_is_kept_and_undone(spark):
    from cadenza.operators import rawtags
    from cadenza.sources import store

    rows = [("/a.mp3", "mp3", "TIT2", "t", 1, 0), ("/a.mp3", "mp3", "TXXX:Mood", "calm", 4, 1), ("/a.mp3", "mp3", "COMM", "c", 1, 2), ("/b.flac", "flac", "MOOD", None, 0, 0), ("/c.mp3", "mp3", "TALB", "x", 1, 0)]
    raw = spark.createDataFrame(rows, "path string, format string, key string, value string, bytes long, n int")
    plan = rawtags.strip_plan(raw)
    entries, kept = rawtags.journal(plan), plan.where("kept")
    detail = store.backup_detail(entries).first()
    assert (detail.entries, detail.samples, detail.notes, detail.formats) == (2, ["/a.mp3", "/b.flac"], ["2 tags", "1 tags"], {"mp3": 2, "flac": 1})
    assert [(r.key, r.tracks) for r in store.backup_groups(entries).collect()] == [("COMM", 1), ("MOOD", 1), ("TXXX:Mood", 1)]
    back = rawtags.unstrip(kept, entries)
    assert sorted((r.path, r.key, r.value or "", r.bytes) for r in back.collect()) == sorted((p, k, v or "", b) for p, _, k, v, b, _ in rows)
    assert rawtags.unstrip(back, entries).count() == len(rows)  # a second time adds nothing
    assert rawtags.journal(rawtags.strip_plan(raw.limit(0))).isEmpty() and store.backup_detail(entries.limit(0)).first().entries == 0
