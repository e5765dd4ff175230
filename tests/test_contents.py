import base64
import os

import pytest
from test_sources import FRAME, ODD, atom, comments, flac, id3

from cadenza.library import Library
from cadenza.operators import rawtags
from cadenza.operators.edit import Selector
from cadenza.sources import contents, samples, scan, store, tags


def block(kind, mime, data, about=b""):
    return kind.to_bytes(4) + len(mime).to_bytes(4) + mime + len(about).to_bytes(4) + about + b"\0" * 16 + len(data).to_bytes(4) + data


def shown(data, *names):
    return [tuple(r.get(n) for n in names) for r in tags.raw_tags(data, "unknown")[1]]


def test_id3_raw_tags():
    wide = lambda x: x.encode("utf-16")
    frames = [("TIT2", b"\x03Song"), ("TPE1", b"\0A\0B\0"), ("TXXX", b"\x01" + wide("Mood") + b"\0\0" + wide("calm")), ("TXXX", b"\0broken"), ("COMM", b"\0engiTunSMPB\0 0000 1"), ("COMM", b"\0eng\0plain"), ("WOAR", b"http://x\0"),
              ("WXXX", b"\0x\0http://y"), ("PRIV", b"owner\0\1\2"), ("POPM", b"abc"), ("APIC", b"\0JPG\0\x04about\0\xff\xd8\xffdata")]
    data = id3(frames) + FRAME
    assert shown(data, "key", "text", "editable", "bytes") == [
        ("TIT2", "Song", True, 15), ("TPE1", "A; B", True, 15), ("TXXX:Mood", "calm", True, 33), ("TXXX", "", True, 17), ("COMM:iTunSMPB", "0000 1", True, 30), ("COMM", "plain", True, 20), ("WOAR", "http://x", True, 19),
        ("WXXX", "", False, 21), ("PRIV", "", False, 18), ("POPM", "", False, 13), ("APIC", "", False, 29),
    ]
    values = dict(shown(data, "key", "value"))
    assert (values["TXXX:Mood"], values["COMM:iTunSMPB"], values["PRIV"], values["POPM"], values["APIC"]) == ("Mood=calm", "iTunSMPB: 0000 1", "owner", "3 bytes", "19 bytes")
    assert tags.pictures(data) == [(4, "image/jpeg", b"\xff\xd8\xffdata")]  # a MIME type that is none is told by the bytes
    old = id3([("TP1", b"\0Who"), ("TXX", b"\0Mood\0calm"), ("COM", b"\0eng\0x"), ("PIC", b"\0PNG\x03\0img")], 2) + FRAME
    assert shown(old, "key", "v22") == [("TPE1", True), ("TXXX:Mood", True), ("COMM", True), ("APIC", True)] and tags.pictures(old) == [(3, "image/png", b"img")]
    long = id3([("TIT2", b"\x03" + "ü".encode() * 40 + b"\n")]) + FRAME
    assert shown(long, "value") == [("ü" * 32 + "…",)]


def test_other_raw_tags():
    picture = block(4, b"image/png", b"img", b"about")
    data = flac(TITLE="One", ARTIST=["A", "B"], odd="x=y", METADATA_BLOCK_PICTURE=[base64.b64encode(picture).decode(), "not base64"])
    data = data[:4] + b"\6" + len(picture).to_bytes(3) + picture + data[4:]
    assert shown(data, "key", "text", "editable")[1:5] == [("TITLE", "One", True), ("ARTIST", "A", True), ("ARTIST", "B", True), ("odd", "x=y", True)]
    assert shown(data, "key", "bytes")[0] == ("PICTURE", len(picture) + 4) and shown(data, "key", "bytes")[1] == ("TITLE", 13)
    assert tags.pictures(data) == [(4, "image/png", b"img")] * 2
    value = lambda kind, v: atom("data", kind.to_bytes(4) + b"\0" * 4 + v)
    free = lambda mean, name: atom("----", atom("mean", b"\0" * 4 + mean) + atom("name", b"\0" * 4 + name) + value(1, b"v"))
    ilst = atom("ilst", atom("©nam", value(1, "Tïtle".encode())) + atom("trkn", value(0, b"\0\0\0\2\0\x08")) + atom("covr", value(14, b"P") + value(13, b"second")) + atom("covr", value(0, b"GIF89a")) + free(b"com.apple.iTunes", b"tool") + free(b"org.example", b"own"))
    m4a = atom("ftyp", b"M4A ") + atom("moov", atom("udta", atom("meta", b"\0" * 4 + ilst)))
    assert shown(m4a, "key", "mean", "text", "value", "editable") == [("©nam", "", "Tïtle", "Tïtle", True), ("trkn", "", "", "6 bytes", False), ("covr", "", "", "1 bytes", False), ("covr", "", "", "6 bytes", False), ("----:tool", "com.apple.iTunes", "v", "v", True), ("----:own", "org.example", "v", "v", True)]
    assert tags.pictures(m4a) == [(3, "image/png", b"P"), (3, "image/gif", b"GIF89a")]
    big = comments(TITLE="O", METADATA_BLOCK_PICTURE=base64.b64encode(block(3, b"image/png", b"z" * 90_000)).decode())
    opus = samples._opus({"title": "O", "artist": "", "genre": "", "year": 1, "track": 1, "mood": "", "gapless": "", "art": b"z" * 90_000})  # over several pages
    assert len(big) > 65536 and tags.pictures(opus) == [(3, "image/png", b"z" * 90_000)]
    chunk = lambda n, b, order: n + len(b).to_bytes(4, order) + b + b"\0" * (len(b) % 2)
    tag = id3([("TIT2", b"\0x"), ("APIC", b"\0image/png\0\3\0img")])
    assert tags.pictures(b"RIFF\0\0\0\0WAVE" + chunk(b"data", b"123", "little") + chunk(b"id3 ", tag, "little")) == [(3, "image/png", b"img")]
    assert tags.pictures(b"FORM\0\0\0\0AIFF" + chunk(b"ID3 ", tag, "big")) == [(3, "image/png", b"img")]
    for broken in (b"", b"fLaC\4\xff\xff\xff", id3([("APIC", b"\0image/png")]), b"OggS", m4a[:60], data[:50]):
        assert tags.pictures(broken, "mp3") == []


@pytest.fixture(scope="module")
def music(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("contents") / "music"
    art = bytearray(b"\x89PNG\r\n\x1a\nsame")
    rows = [(f"{folder}/{x.removesuffix('.mp3') or '_'} {e}/{n} {x.removesuffix('.mp3')}.{e}", f, f"Title {n}", "A", "Folk", 1990 + n, n + 1, "calm", f"{n:08d}", art if n % 2 else None) for n, (x, (f, e)) in enumerate((x, fe) for x in ODD[:8] for fe in (("mp3", "mp3"), ("flac", "flac"), ("mp4", "m4a"), ("opus", "opus")))]
    df = spark.createDataFrame(rows, samples.SAMPLE)
    assert samples.write_files(df) == len(rows) == 32
    (folder / "broken.mp3").write_bytes(b"ID3\3\0\0\0\0\x7f\x7fTIT2")
    os.symlink("nowhere", folder / "dangling.mp3")
    return str(folder)


def test_strip_and_art_of_scanned_files(spark, music):
    tracks = scan.scan(spark, [music])
    raw = contents.raw(tracks)
    plan = rawtags.strip_plan(raw)
    report = {(r.format, r.key): (r.field, r.tracks) for r in rawtags.strip_report(plan).collect()}
    assert report == {("mp3", "TXXX:Mood"): ("mood", 8), ("flac", "MOOD"): ("mood", 8), ("opus", "MOOD"): ("mood", 8)}  # gapless data stays
    assert {r.key for r in plan.where("field = 'gapless' and kept").collect()} == {"COMM:iTunSMPB", "ITUNSMPB", "----:iTunSMPB"}
    assert rawtags.non_canonical(plan).select("fields").distinct().first().fields == ["date"]  # a year without a release date beside it
    pictures = contents.covers(contents.pictures(tracks))
    assert pictures.count() == 16 and pictures.select("data").distinct().count() == 1
    lib = Library(tracks, (music,))
    summary = {r.image is None: r.tracks for r in lib.artwork_summary(pictures.selectExpr("path", "data as art")).collect()}
    assert summary == {True: 18, False: 16}
    job = lib.set_artwork(Selector(query="title:^title"), b"GIF89anew", pictures)
    assert job.result["changed"] == 32 and lib.pictures().count() == 2  # the 16 equal pictures of the files are one
    lib.undo(job.id)
    assert lib.df.where("has_art").count() == 16 and lib.artwork().where("hash <> ''").select("hash").distinct().count() == 1
    assert lib.strip(raw).count() == 3


def test_table_functions(spark, music):
    contents.register(spark)
    scan.scan(spark, [music]).selectExpr("path", "format as kind").where("format <> 'opus'").createOrReplaceTempView("files")
    got = spark.sql("SELECT key, count(*) AS n FROM raw_tags(TABLE(SELECT path, kind FROM files) PARTITION BY path) WHERE key IN ('TIT2', 'TITLE', '©nam') GROUP BY key")
    assert {r.key: r.n for r in got.collect()} == {"TIT2": 8, "TITLE": 8, "©nam": 8}
    assert spark.sql("SELECT count(DISTINCT sha2(data, 256)) AS n, sum(bytes) AS b FROM pictures(TABLE(SELECT path, kind FROM files) PARTITION BY path)").first() == (1, 12 * 8)
    store.remove(spark, f"{music}/none")
