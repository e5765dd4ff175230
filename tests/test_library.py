import pytest
from pyspark.sql import functions as F

from cadenza import schema
from cadenza.functions import hashing, sql
from cadenza.library import Library
from cadenza.operators.edit import BadPath, Conflict, NotFound, Selector, cover_name, resolve_dest
from cadenza.sources import store


def test_library(spark):
    lib = Library(store.generate(spark, 80), ("/music",))
    assert lib.count("artist:nord") == 10 and lib.tracks("year:>2000", "-year", 3).items.count() == 3
    first = lib.tracks(limit=1).items.first()
    assert first.id == hashing.fnv_text(first.path.encode()) and first.writable
    plan = lib.batch_set(Selector(query="artist:nord", expect_count=10), {"genre": "Pop"}, dry_run=True)
    assert plan.count() == 10 and lib.count("genre:pop") == 0
    job = lib.batch_set(Selector(query="artist:nord"), {"genre": "Pop"})
    assert job.result["changed"] == 10 and lib.count("genre:pop") == 10
    page = lib.backup_page(limit=1)
    assert page.total == 1 and [r.name for r in page.items.collect()] == [job.id] and lib.backup(job.id).first().fields == ["genre"]
    lib.undo(job.id)
    assert lib.count("genre:pop") == 0 and [(r.name, r.entries) for r in lib.backups().collect()] == [(job.id, 10)]
    assert [r.seq for r in lib.events(after=0).collect()] == [1] and lib.events().count() == 0
    with pytest.raises(NotFound):
        lib.undo("nope")
    assert lib.albums(limit=2).items.count() == 2 and lib.artists().total == 8 and lib.folders().items.first().path == "/music"
    assert lib.values("artist", "caf").first().value == "Café Luna" and lib.duplicates(by="artist,year").items.count() >= 0
    lib.delete(Selector(query="artist:oddvar"))
    assert lib.count() == 70 and "mp3" in lib.capabilities()["formats"]


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT fold('BJÖRK Æß') AS f, track_id('/musïc/a') AS i, track_version('/a', 5, 7) AS v, fuzzy_score('elvis presley', 'presly') AS s, osa_distance('ab', 'ba') AS d, track_id('') AS e").first()
    assert (r.f, r.i, r.d, r.e) == ("bjork aess", hashing.fnv_text("/musïc/a".encode()), 1, "cbf29ce484222325") and 0.45 <= r.s <= 0.74
    assert r.v == hashing.fnv_text(b"/a" + (5).to_bytes(8, "little") + (7).to_bytes(8, "little"))
    sql.search_view(schema.conform(store.generate(spark, 16)), "artist:~orchrd", "found")
    assert spark.sql("SELECT count(*) AS n FROM found").first().n == 2


@pytest.mark.parametrize("query", ["", "nord", "artist:~nrod year:>1990", "-genre:jazz album:^harbour", '~"tin orchrd" -year:1999', "genre:", "year:1980-1985 ~cafe", "compilation:1", 'artist:"^oddvar$"', "year:abc", "album:1$"])
def test_search_table_function(spark, query):
    """The same rows and scores from SQL as from the compiled filter, over plain and stored columns."""
    from cadenza.plans.search import fold_columns, search_scored

    sql.register(spark)
    t = store.generate(spark, 120)
    want = sorted((r.path, r.score) for r in search_scored(t, query).collect())
    for name, df in (("plain", t), ("stored", fold_columns(t))):
        df.createOrReplaceTempView(name)
        got = spark.sql(f"SELECT path, score FROM search_tracks(TABLE({name}), '{query}')").collect()
        assert sorted((r.path, r.score) for r in got) == want


def test_search_table_function_refuses(spark):
    from pyspark.errors import AnalysisException

    sql.register(spark)
    store.generate(spark, 3).createOrReplaceTempView("few")
    assert spark.sql("SELECT title, count(*) AS n FROM search_tracks(TABLE(SELECT title, year FROM few), 'title:piece year:>1900') WHERE score = 1 GROUP BY title").count() == 3
    for bad in ("TABLE(SELECT title FROM few), 'year:>1'", "TABLE(few), path", "'x', 'y'"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM search_tracks({bad})").collect()


def mp3(title, extra=b""):
    body = title.encode()
    frame = b"TIT2" + (len(body) + 1).to_bytes(4) + b"\0\0\3" + body
    size = len(frame)
    return b"ID3\3\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + frame + extra + b"\xff\xfb\x90\x00" + b"\0" * 413


def test_rescans_survive_changes(spark, tmp_path):
    """Files are added, changed and removed between scans; nothing asked later needs them, and undo works in a later session."""
    music = tmp_path / "music"
    (music / "node_modules").mkdir(parents=True)
    for k in range(3):
        (music / f"{k}.mp3").write_bytes(mp3(f"Title {k}", b"\0" * (k * 70_000)))
    (music / "node_modules" / "x.mp3").write_bytes(mp3("skipped"))
    (music / "gone.mp3").symlink_to("nowhere")
    lib = Library(store.generate(spark, 0), (str(music),), f"{tmp_path}/home")
    counts = lib.scan()
    assert (counts["found"], counts["parsed"], counts["errors"]) == (4, 4, 1) and counts["first_errors"][0].startswith(f"{music}/gone.mp3: ")
    (music / "gone.mp3").unlink()
    assert (again := lib.scan()) | {"dirs": 1, "bytes": 0} == {"dirs": 1, "found": 3, "parsed": 0, "reused": 3, "errors": 0, "bytes": 0, "removed": 1, "last_error": None, "first_errors": []} and again["bytes"] > 0
    assert sorted(r.title for r in lib.df.collect()) == ["Title 0", "Title 1", "Title 2"] and lib.df.where("duration_ms > 0").count() == 3
    (music / "0.mp3").unlink()
    assert lib.count() == 3 and lib.count("title:^title") == 3
    (music / "1.mp3").write_bytes(mp3("Longer than before"))
    (music / "3.mp3").write_bytes(mp3("New"))
    lib.scan()
    assert sorted(r.title for r in lib.df.collect()) == ["Longer than before", "New", "Title 2"]
    job = lib.batch_set(Selector(query="title:new"), {"genre": "Jazz"})
    for f in music.glob("*.mp3"):
        f.unlink()
    later = Library.open(spark, f"{tmp_path}/home")
    assert later.count("genre:jazz") == 1 and later.roots == (str(music),)
    later.undo(job.id)
    assert later.count("genre:jazz") == 0 and later.count() == 3


def test_moves_and_unsaved_tracks(spark, tmp_path):
    lib = Library(store.generate(spark, 12), ("/music",), f"{tmp_path}/home")
    lib.save(f"{tmp_path}/saved")
    assert lib.dirty_count(f"{tmp_path}/saved") == 0
    first, second = lib.tracks(limit=2).items.collect()
    ending = first.path[first.path.rindex("."):]
    job = lib.move(first.id, f" new name{ending.upper()} ", first.version)
    moved = first.path[: first.path.rindex("/")] + "/new name" + ending.upper()
    assert job.result["changed"] == 1 and lib.df.where(F.col("path") == moved).count() == 1 and lib.dirty_count(f"{tmp_path}/saved") == 1
    lib.undo(job.id)
    assert lib.dirty_count(f"{tmp_path}/saved") == 0
    with pytest.raises(Conflict):
        lib.move(first.id, second.path)
    with pytest.raises(Conflict):
        lib.move(first.id, "x" + ending, "stale")
    lib._scanning.acquire()
    with pytest.raises(Conflict):
        lib.scan()


@pytest.mark.parametrize(("dest", "want"), [
    ("b.mp3", "/music/a/b.mp3"), ("../b.MP3", "/music/b.MP3"), (" /music/x/./y.mp3", "/music/x/y.mp3"), ("/music-old/b.mp3", None), ("../../b.mp3", None),
    ("", None), ("b/", None), ("b.flac", None), ("..", None), ("/", None), ("b", None),
])
def test_destinations(dest, want):
    if want is None:
        with pytest.raises(BadPath):
            resolve_dest("/music/a/t.mp3", dest, ("/music",))
    else:
        assert resolve_dest("/music/a/t.mp3", dest, ("/music",)) == want
    assert resolve_dest("/else/t.mp3", "u.mp3", ()) == "/else/u.mp3"


def test_cover_names():
    assert [cover_name(n) for n in ("cover.jpg", "Front.PNG", "art")] == ["cover.jpg", "Front.PNG", "art"]
    for bad in ("a/b.jpg", "a\\b.jpg", ".", "..", ".x.jpg", "a.txt", ""):
        with pytest.raises(BadPath):
            cover_name(bad)


def test_only_heads_are_read(tmp_path):
    from cadenza.sources import files, tags

    path = tmp_path / "a.mp3"
    path.write_bytes(mp3("Head") + b"\0" * (30 << 20))
    for data in files.opened([f"file://{path}", f"file://{tmp_path}/none.mp3"]):
        if isinstance(data, OSError):
            continue
        whole = tags.decode(path.read_bytes(), "mp3")
        assert tags.decode(data, "mp3") == whole and whole["title"] == "Head" and len(data.blocks) <= 4


def test_group_queries_select_their_groups(spark):
    """Two of three tracks name the album artist that all three bear as artist: only the artist selects them all."""
    from cadenza.operators import browse
    from cadenza.plans.search import search

    rows = [("/m/1.mp3", "X", "X", "A"), ("/m/2.mp3", "X", "X", "A"), ("/m/3.mp3", "X", "", "A"), ("/m/4.mp3", "Y", "X", "B"), ("/m/5.mp3", "Z", "", "C")]
    t = schema.conform(spark.createDataFrame(rows, "path string, artist string, album_artist string, album string"))
    got = {r.album: (r.query, r.tracks) for r in browse.albums(t).collect()}
    assert got["A"] == ('artist:"X" album:"A"', 3) and got["B"] == ('albumartist:"X" album:"B"', 1)
    assert all(search(t, q).count() == n for q, n in got.values())
    assert {r.name: r.query for r in browse.artists(t).collect()} == {"X": 'albumartist:"^X$"', "Z": 'artist:"^Z$"'}


def test_a_stop_after_any_step_leaves_a_library(spark, tmp_path, monkeypatch):
    """Edits and scans that stop after any of their steps change nothing: what follows opens, saves and undoes."""
    home = f"{tmp_path}/home"
    lib = Library(store.generate(spark, 40), ("/music",), home)
    first = lib.batch_set(Selector(query="artist:nord"), {"genre": "Pop"})
    assert lib.at["deltas"] == [] and lib.count("genre:pop") == 5  # an eighth of all rows: the table was written anew

    class Stop(Exception):
        pass

    for step, edit_all in (("write_delta", False), ("write_base", True), ("put_if_absent", False), ("tidy", False)):
        real, seen = getattr(store, step), []

        def stops(*a, real=real, seen=seen, **k):
            seen.append(1)
            if step != "put_if_absent":
                real(*a, **k)
            raise Stop

        monkeypatch.setattr(store, step, stops)
        before = Library.open(spark, home).at["number"]
        with pytest.raises(Stop):
            Library.open(spark, home).batch_set(Selector(all=True) if edit_all else Selector(query="title:^piece title:7$ year:<1990"), {"comment": f"by {step}"})
        monkeypatch.undo()
        lib = Library.open(spark, home)
        assert seen and lib.at["number"] == before + (step == "tidy")  # the one step after the commit
        assert lib.count() == 40 and (lib.count(f'comment:"by {step}"') > 0) == (step == "tidy")
    names = {r.name for r in lib.backups().collect()}
    assert first.id in names and len(store.names_in(spark, f"{home}/journals/entries")) > len(names)  # journals without a commit are not offered
    for gone in set(n.removeprefix("name=") for n in store.names_in(spark, f"{home}/journals/entries")) - names:
        with pytest.raises(NotFound):
            lib.undo(gone)
    lib.undo(first.id)
    assert lib.count("genre:pop") == 0 and lib.count() == 40
    used = set(lib.at["deltas"]) | {lib.at["base"]}
    assert set(store.tidy(spark, home, hours=0)) and used <= {f"data/{n}" for n in store.names_in(spark, f"{home}/data")}
    assert Library.open(spark, home).count() == 40


def test_of_two_commits_one_is_refused(spark, tmp_path):
    home = f"{tmp_path}/home"
    one = Library(store.generate(spark, 24), ("/music",), home)
    two = Library.open(spark, home)
    one.batch_set(Selector(query="title:^piece title:1$"), {"genre": "Pop"})
    with pytest.raises(store.Raced):
        two.delete(Selector(all=True))
    two.refresh()
    assert two.count() == 24 and two.count("genre:pop") == one.count("genre:pop") > 0
    assert [(r.type, r.seq) for r in two.events(after=0).collect()] == [("set.finished", 1)]  # events outlive sessions


def test_small_edits_are_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MAX_DELTAS", 2)
    lib = Library(store.generate(spark, 200), ("/music",), f"{tmp_path}/home")
    base = lib.at["base"]
    ids = [r.id for r in lib.tracks(limit=5).items.collect()]
    jobs = [lib.patch(id, {"title": f"Edited {n}"}) for n, id in enumerate(ids[:3])]
    assert lib.at["base"] != base and lib.at["deltas"] == []  # written anew when a third would lie over it
    assert lib.count("title:^edited") == 3 and lib.count() == 200
    moved = lib.move(ids[3], "elsewhere.mp3")
    lib.patch(ids[0], {"title": "Twice"})
    assert len(lib.at["deltas"]) == 2
    lib.undo(moved.id)
    lib.undo(jobs[1].id)
    assert lib.count("title:^edited") == 1 and lib.count("title:twice") == 1 and lib.df.where("path like '%elsewhere%'").count() == 0
    lib.delete(Selector(ids=(ids[4],)))
    assert Library.open(spark, lib.home).count() == 199


def test_pictures_are_set_and_undone(spark, tmp_path):
    home, png, jpeg = f"{tmp_path}/home", b"\x89PNG\r\n\x1a\nred", b"\xff\xd8\xffblue"
    lib = Library(schema.conform(spark.createDataFrame([(f"/m/{k}.mp3", k < 2) for k in range(6)], "path string, has_art boolean")), ("/m",), home)
    embedded = spark.createDataFrame([("/m/0.mp3", "image/png", bytearray(png)), ("/m/1.mp3", "image/gif", bytearray(b"GIF89agreen"))], "path string, mime string, data binary")
    plan = lib.set_artwork(Selector(all=True), png, embedded, dry_run=True)
    assert {r.path: r.status for r in plan.collect()} == {f"/m/{k}.mp3": "same" if k == 0 else "changed" for k in range(6)}
    one = lib.set_artwork(Selector(all=True), png, embedded)
    assert one.result["changed"] == 5 and lib.count() == lib.df.where("has_art").count() == 6
    two = lib.set_artwork(Selector(query="path:5"), jpeg)
    three = lib.set_artwork(Selector(query="path:5"), None)
    stored = {r.hash: (r.mime, bytes(r.data)) for r in lib.pictures().collect()}
    assert sorted(stored.values()) == [("image/gif", b"GIF89agreen"), ("image/jpeg", jpeg), ("image/png", png)] and lib.pictures().count() == 3
    later = Library.open(spark, home)
    shown = lambda: {r.path[-5]: stored[r.hash][1] for r in later.artwork(embedded.select("path", F.sha2("data", 256).alias("hash"))).collect()}
    assert shown() == dict.fromkeys("01234", png) and later.df.where("has_art").count() == 5
    later.undo(three.id)
    assert shown()["5"] == jpeg
    later.undo(two.id)
    later.undo(one.id)
    assert shown() == {"0": png, "1": b"GIF89agreen"} and later.df.where("has_art").count() == 2
    assert later.drop_pictures() == 0  # journals still refer to them all
    for job in (two, three):
        store.remove(spark, f"{home}/journals/entries/name={job.id}")
    assert later.drop_pictures() == 2 and [r.mime for r in later.pictures().collect()] == ["image/gif"]  # the other picture of a file is there alone


def test_versions_count_writes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MAX_DELTAS", 2)
    lib = Library(store.generate(spark, 60), ("/music",), f"{tmp_path}/home")
    one, other = lib.tracks(limit=2).items.collect()
    seen = [one.version]
    for n in range(3):
        lib.patch(one.id, {"title": f"Take {n}"}, seen[-1])
        seen.append(lib.get(one.id).first().version)
    assert len(set(seen)) == 4 and seen[1] == spark.range(1).select(hashing.live_version(F.lit(one.version), F.lit(1))).first()[0]
    with pytest.raises(Conflict):
        lib.patch(one.id, {"title": "Late"}, seen[2])
    later = Library.open(spark, lib.home)
    assert [(r.id, r.version) for r in later.tracks(limit=2).items.collect()] == [(one.id, seen[-1]), (other.id, other.version)]
    assert len(later.at["revs"]) <= 2 and [(r.path, r.n) for r in later.revs().collect()] == [(one.path, 3)]
    assert later.patch(one.id, {"title": "Take 2"}).result["changed"] == 0 and later.get(one.id).first().version == seen[-1]
