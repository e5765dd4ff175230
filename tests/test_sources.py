import os
import struct

import pytest
from pyspark.sql import functions as F

from cadenza import schema
from cadenza.sources import files, scan, store, tags, walk


def id3(frames, version=3):
    body = b"".join(k.encode() + (len(v).to_bytes(4) if version > 2 else len(v).to_bytes(3)) + (b"\0\0" if version > 2 else b"") + v for k, v in frames)
    n = len(body)
    return b"ID3" + bytes([version, 0, 0, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


FRAME = bytes([0xFF, 0xFB, 0x90, 0x00]) + b"\0" * 413  # 128 kbit/s, 44.1 kHz


def comments(**kv):
    items = [f"{k}={v}".encode() for k, vs in kv.items() for v in ([vs] if isinstance(vs, str) else vs)]
    return struct.pack("<I", 1) + b"x" + struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(i)) + i for i in items)


def flac(**kv):
    info = b"\0" * 10 + (44100 << 44 | 1 << 41 | 15 << 36 | 88200).to_bytes(8) + b"\0" * 16
    c = comments(**kv)
    return b"fLaC" + b"\0" + len(info).to_bytes(3) + info + b"\x84" + len(c).to_bytes(3) + c


def atom(name, body):
    return (8 + len(body)).to_bytes(4) + name.encode("latin-1") + body


def test_mp3():
    data = id3([("TIT2", b"\x03Song"), ("TPE1", b"\x01" + "Bjørk".encode("utf-16")), ("TCON", b"\0(17)"), ("TRCK", b"\x003/12"), ("TYER", b"\x001999"), ("APIC", b"\0image/png\0\x03\0PNG"), ("TCMP", b"\x001"), ("COMM", b"\0eng\0note")]) + FRAME * 10
    t = tags.decode(data, "unknown")
    assert (t["title"], t["artist"], t["genre"], t["track_no"], t["track_total"], t["year"], t["has_art"], t["compilation"], t["comment"]) == ("Song", "Bjørk", "Rock", 3, 12, 1999, True, True, "note")
    assert (t["bitrate"], t["sample_rate"], t["duration_ms"]) == (128, 44100, 4170 * 8 // 128)
    assert tags.cover(tags.pictures(data)) == (3, "image/png", b"PNG")
    old = tags.decode(id3([("TT2", b"\0Old"), ("TRK", b"\x007")], 2) + FRAME, "mp3")
    assert (old["title"], old["track_no"]) == ("Old", 7)
    v1 = b"TAG" + b"Tail".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + b"LP".ljust(30, b"\0") + b"1980" + b"c".ljust(28, b"\0") + b"\0\x05" + b"\x11"
    t = tags.decode(FRAME + v1, "mp3")
    assert (t["title"], t["artist"], t["year"], t["track_no"], t["genre"]) == ("Tail", "Who", 1980, 5, "Rock")


def test_other_containers():
    t = tags.decode(flac(TITLE="One", ARTIST=["A", "B"], DATE="2001-02-03", TRACKNUMBER="4", TRACKTOTAL="9"), "x")
    assert (t["title"], t["artist"], t["year"], t["track_no"], t["track_total"], t["duration_ms"], t["channels"], t["format"]) == ("One", "A; B", 2001, 4, 9, 2000, 2, "flac")
    item = lambda k, v: atom(k, atom("data", b"\0" * 8 + v))
    ilst = atom("ilst", item("©nam", "Tïtle".encode()) + item("trkn", b"\0\0\0\x02\0\x08") + item("cpil", b"\x01") + item("gnre", b"\0\x12"))
    moov = atom("moov", atom("mvhd", b"\0" * 12 + (1000).to_bytes(4) + (5000).to_bytes(4) + b"\0" * 80) + atom("udta", atom("meta", b"\0" * 4 + ilst)))
    t = tags.decode(atom("ftyp", b"M4A ") + moov, "x")
    assert (t["title"], t["track_no"], t["track_total"], t["compilation"], t["genre"], t["duration_ms"], t["format"]) == ("Tïtle", 2, 8, True, "Rock", 5000, "mp4")
    head = b"OpusHead\x01\x02" + struct.pack("<H", 0) + b"\0" * 7
    page = lambda body, granule: b"OggS\0\0" + struct.pack("<q", granule) + b"\0" * 12 + bytes([1, len(body)]) + body
    t = tags.decode(page(head, 0) + page(b"OpusTags" + comments(TITLE="O"), 96000), "x")
    assert (t["title"], t["duration_ms"], t["format"], t["channels"]) == ("O", 2000, "opus", 2)
    chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    body = chunk(b"fmt ", struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)) + chunk(b"LIST", b"INFO" + chunk(b"INAM", b"W\0")) + chunk(b"data", b"\0" * 176400)
    t = tags.decode(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body, "x")
    assert (t["title"], t["duration_ms"], t["format"]) == ("W", 1000, "wav")
    for broken in (b"", b"fLaC\0\xff", b"ID3\3", b"OggS", b"RIFFxxxxWAVEfmt "):
        assert tags.decode(broken, "mp3")["has_art"] is False


def test_scan_tree_and_rescan(spark, tmp_path):
    files = {"a/01.mp3": id3([("TIT2", b"\x03One")]) + FRAME * 3, "a/02.flac": flac(TITLE="Two"), "b/broken.ogg": b"junk", "b/empty.mp3": b"", "@eaDir/x.mp3": FRAME, ".hidden/y.mp3": FRAME, "a/._01.mp3": FRAME, "a/notes.txt": b"text", "lost+found/z.mp3": FRAME, "skip/q.mp3": FRAME}
    for name, data in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    first = scan.scan(spark, [str(tmp_path)], exclude=["/skip/"]).cache()
    got = {os.path.relpath(r.path, tmp_path): (r.title, r.format) for r in first.collect()}
    assert got == {"a/01.mp3": ("One", "mp3"), "a/02.flac": ("Two", "flac"), "b/broken.ogg": ("", "ogg")}
    before = spark.createDataFrame(first.withColumn("title", F.concat(F.lit("kept "), F.col("title"))).collect(), first.schema)
    (tmp_path / "a/01.mp3").write_bytes(id3([("TIT2", b"\x03Changed")]) + FRAME * 5)
    again = {os.path.relpath(r.path, tmp_path): r.title for r in scan.scan(spark, [str(tmp_path)], before, ["/skip/"]).collect()}
    assert again == {"a/01.mp3": "Changed", "a/02.flac": "kept Two", "b/broken.ogg": "kept "}
    c = scan.counters(scan.listing(spark, [str(tmp_path)], ["*skip*"]), before).first()
    assert (c.found, c.reused, c.parsed, c.removed) == (3, 2, 1, 0)


#: Names that are paths, not URIs, globs or shell words.
ODD = ["with space.mp3", "umläut.mp3", "br[1].mp3", "hash#1.mp3", "pct%20x.mp3", "pct%.mp3", "q?x.mp3", "st*r.mp3", "a:b.mp3", "back\\slash.mp3", "quote'\".mp3", "new\nline.mp3", "漢字 ☃.mp3", "{a,b}.MP3", "~.mp3", "+&=.mp3", "file:x.mp3", "..mp3", " .mp3"]


def test_any_file_name_is_scanned(spark, tmp_path):
    for n, name in enumerate(ODD):
        for folder in ("plain", name.removesuffix(".mp3") + " d"):
            if not folder.startswith("."):
                (tmp_path / "music" / folder).mkdir(parents=True, exist_ok=True)
                (tmp_path / "music" / folder / name).write_bytes(id3([("TIT2", b"\x03Number %d" % n)]) + FRAME)
    (tmp_path / os.fsdecode(b"music/plain/bad\xff.mp3")).write_bytes(FRAME)
    for root in (f"{tmp_path}/music", f"file://{tmp_path}/music/"):
        done = scan.run(spark, [root])
        got = {r.path: (r.title, r.format) for r in done.tracks.collect()}
        want = {os.path.join(at, x): (f"Number {ODD.index(x)}", "mp3") for at, _, found in os.walk(tmp_path / "music") for x in found if "\udcff" not in x and not x.startswith(".")}
        assert got == want and len(got) > 30
        assert [(r.path.rpartition("/")[2], r.error) for r in done.errors.collect()] == [("bad\\xff.mp3", "the name is not UTF-8")]
        c = done.counters().first()
        assert (c.found, c.parsed, c.reused, c.errors, c.removed, c.bytes) == (len(want), len(want), 0, 1, 0, sum(os.path.getsize(p) for p in want))
        before = spark.createDataFrame(done.tracks.collect(), done.tracks.schema)
        done.close()
    again = scan.run(spark, [f"{tmp_path}/music"], before)
    assert again.read.count() == 0 and again.counters().first().reused == len(want) and again.tracks.count() == len(want)


def test_links(spark, tmp_path):
    """A loop, a diamond and a link to a file; loops end, and what two paths reach is read under one."""
    for d in ("a/b", "c", "away/deep"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("a/1.mp3", "a/b/2.mp3", "away/deep/3.mp3"):
        (tmp_path / f).write_bytes(id3([("TIT2", b"\x03" + f.encode())]) + FRAME)
    for link, to in (("a/b/up", "../.."), ("c/x", "../away/deep"), ("c/y", "../away"), ("a/self", "."), ("c/4.mp3", "../a/1.mp3"), ("c/broken.mp3", "nowhere")):
        os.symlink(to, tmp_path / link)
    roots = [f"{tmp_path}/a", f"{tmp_path}/c"]
    plain = {os.path.relpath(r.path, tmp_path): r.title for r in scan.scan(spark, roots).collect()}
    assert plain == {"a/1.mp3": "a/1.mp3", "a/b/2.mp3": "a/b/2.mp3", "c/4.mp3": "a/1.mp3", "c/broken.mp3": ""}
    done = scan.run(spark, roots, follow=True)
    got = {os.path.relpath(r.path, tmp_path) for r in done.tracks.collect()}
    assert got == {"a/1.mp3", "a/b/2.mp3", "c/4.mp3", "c/broken.mp3", "c/x/3.mp3"}
    real = [os.path.realpath(r.path) for r in done.tree.directories.collect()]
    assert len(real) == len(set(real)) == 6  # a, a/b, the folder of all, c, away, away/deep
    assert [os.path.relpath(r.path, tmp_path) for r in done.errors.collect()] == ["c/broken.mp3"]


def test_deep_and_overlapping_roots(spark, tmp_path):
    for k in range(30):
        (tmp_path / f"x{k % 3}" / f"y{k % 5}" / f"z{k}").mkdir(parents=True)
        (tmp_path / f"x{k % 3}" / f"y{k % 5}" / f"z{k}" / "t.ogg").write_bytes(b"OggS")
    (tmp_path / ".root").mkdir()
    (tmp_path / ".root" / "t.mp3").write_bytes(FRAME)
    roots = [str(tmp_path), f"{tmp_path}/x1", f"{tmp_path}/x1/y1/", f"{tmp_path}/none"]
    for limit in (1, 4, 4096):  # the smaller, the more rounds
        tree = walk.walk(spark, roots, limit=limit)
        assert tree.files.count() == 30 and tree.directories.count() == 1 + 3 + 15 + 30 and [os.path.basename(r.path) for r in tree.errors.collect()] == ["none"]
        tree.close()
    assert walk.walk(spark, [f"{tmp_path}/.root"]).files.count() == 1  # a root's own name is not judged
    assert walk.walk(spark, [str(tmp_path)], include_hidden=True).files.count() == 31


def test_what_cannot_be_read_keeps_its_row(tmp_path, monkeypatch):
    """No permission and a fault while reading have a row and an error, a file that is gone an error alone."""
    path = tmp_path / "a.mp3"
    path.write_bytes(id3([("TIT2", b"\x03One")]) + FRAME)
    (data,) = files.opened([str(path)])
    assert scan.read_file(str(path), "mp3", PermissionError(13, "Permission denied")) == ({"format": "mp3"}, "[Errno 13] Permission denied")
    monkeypatch.setattr(files.Bytes, "_read", lambda *a: (_ for _ in ()).throw(OSError(5, "Input/output error")))
    assert scan.read_file(str(path), "mp3", data) == ({"format": "mp3"}, "[Errno 5] Input/output error")
    monkeypatch.undo()
    (gone,) = files.opened([f"{tmp_path}/gone.mp3"])
    assert scan.read_file(f"{tmp_path}/gone.mp3", "mp3", gone)[0] is None and isinstance(gone, FileNotFoundError)


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("*.mp3", ["/a/b.mp3"], ["/a/b.ogg"]), ("/a/*", ["/a/b"], ["/x/a"]), ("b?.[mn]p[^4-9]", ["/a/bx.mp3"], ["/a/bx.mp4", "/a/b.mp3"]), ("[", ["/a/["], ["/a/b"]), ("\\*x", ["/a/*x"], ["/a/yx"]),
    ("/skip/", ["/a/skip/b"], ["/a/skipped"]), ("[]a]", ["/a/[]a]"], ["/a/a"]), ("ü[ä-ö]", ["/a/üö"], ["/a/üa"]),
])
def test_exclusions(spark, pattern, yes, no):
    rules = walk.Rules([pattern])
    assert [rules.excluded(p.rpartition("/")[2], p) for p in yes + no] == [True] * len(yes) + [False] * len(no)
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    assert {r.path for r in df.where(walk.excluded(F.col("path"), [pattern])).collect()} == set(yes)


def test_snapshot(spark, tmp_path):
    df = store.generate(spark, 24)
    for _ in range(2):
        store.save(df, f"{tmp_path}/snap", ["/music"])
    assert store.load(spark, f"{tmp_path}/snap").count() == 24 and store.roots_of(spark, f"{tmp_path}/snap") == ["/music"]
    assert "artist_f" in store.load(spark, f"{tmp_path}/snap").columns
    assert not [x for x in os.listdir(tmp_path) if x != "snap"]
    spark.createDataFrame([(3, ["/old"])], "version int, roots array<string>").write.mode("overwrite").json(f"{tmp_path}/snap/meta")
    with pytest.raises(store.OldSnapshot, match="/old"):
        store.load(spark, f"{tmp_path}/snap")


def test_journal_backups_exports(spark, tmp_path):
    entries = spark.createDataFrame([("/b", {"year": None, "title": "x"}, None), ("/a", {"title": "y"}, None)], store.JOURNAL)
    store.write_journal(entries, f"{tmp_path}/j", "one", "set", 5)
    assert sorted(map(str, store.read_journal(spark, f"{tmp_path}/j", "one").collect())) == sorted(map(str, entries.collect())) or store.read_journal(spark, f"{tmp_path}/j", "one").count() == 2
    d = store.backup_detail(entries).first()
    assert (d.entries, d.fields, d.samples) == (2, ["title", "year"], ["/a", "/b"])
    names = spark.createDataFrame([("one", 5), ("two", 9)], "name string, at long")
    side = spark.createDataFrame([("one", "set", 2)], "name string, kind string, entries long")
    assert [tuple(r) for r in store.backups(names, side).collect()] == [("two", 9, "strip", 0), ("one", 5, "set", 2)]
    for how in ("m3u", "tsv", "json"):
        store.export(store.generate(spark, 5), f"{tmp_path}/{how}", how)
    assert spark.read.text(f"{tmp_path}/m3u").count() == 5


def test_art(spark):
    files = spark.createDataFrame([("/a/Folder.PNG",), ("/a/cover.gif",), ("/a/cover.jpg",), ("/b/back.jpg",), ("/c/art.webp",)], "path string")
    art = store.folder_art(files)
    assert {(r.dir, r.art) for r in art.collect()} == {("/a", "/a/cover.jpg"), ("/c", "/c/art.webp")}
    t = schema.conform(spark.createDataFrame([("/a/2", True), ("/a/1", False), ("/a/3", True)], "path string, has_art boolean"))
    assert [tuple(r) for r in store.art_export(t).collect()] == [("/a", "/a/2")] and store.with_folder_art(t, art).where("art is not null").count() == 3
    c = spark.createDataFrame([("x", 0, False, 1, ""), ("x", 1, True, 2, "i"), ("y", 0, False, 1, "")], "album string, ord int, complete boolean, master_id int, image string")
    assert {(r.album, r.ord) for r in store.best_candidate(c, "album").collect()} == {("x", 1), ("y", 0)}
    assert store.with_masters(c, spark.createDataFrame([(9, "z")], "master_id int, image string")).count() == 1
