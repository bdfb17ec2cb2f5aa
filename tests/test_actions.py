import json
import os
import random

from pyspark.sql import functions as F

from kindred.functions.text import search_fold
from kindred.operators import keepers, removal, search, tags, views, waveform
from kindred.schema import TRACK, conform
from kindred.sources import frames, scan
from kindred.streaming import cache_state
from kindred.streaming.cache_stream import follow

K = keepers.KeeperRule


def tracks(spark):
    rows = [
        (0, "/m/a/one.mp3", "/m", "Éa", "P", "x", "mp3", 320, 300.0, 10), (1, "/m/b/one.flac", "/m", "Éa", "P", "x", "flac", 900, 300.4, 20), (2, "/m/b/two.flac", "/m", "Éa", "P", "y", "flac", 900, 300.8, 20),
        (3, "/n/m/t.mp3", "/n/m", "b 10", "", "x", "mp3", None, None, 5), (4, "/z/u.wav", None, "b 9", "Q", "x", "wav", 100, 9.0, 7),
    ]
    return conform(spark.createDataFrame(rows, "id long, path string, scan_root string, title string, artist string, album string, format string, bitrate int, duration double, file_size long"))


def groups(spark):
    return spark.createDataFrame([(0, [0, 1, 2], 0.9, ["sameTitle"]), (1, [3, 4], 0.95, ["fuzzyTitle"])], "id long, track_ids array<long>, confidence double, reasons array<string>")


def test_keepers(spark):
    pick = lambda *rules: [r.keeper for r in keepers.choices(groups(spark), tracks(spark), rules).orderBy("group_id").collect()]
    assert pick() == [0, 3]
    assert pick(K("prefer_lossless")) == [1, 4]
    assert pick(K("longer_duration")) == [2, 4]  # 300.4 does not beat 300.0, 300.8 does
    assert pick(K("prefer_lossless"), K("longer_duration")) == [1, 4]
    assert pick(K("higher_bitrate")) == [1, 4] and pick(K("path_does_not_contain", "/B/")) == [0, 3] and pick(K("prefer_format", "mp3")) == [0, 3] and pick(K("larger_file")) == [1, 4]
    rules = (K("prefer_lossless"), K("larger_file"))
    assert pick(*rules) == [1, 4]
    assert sorted(r.id for r in keepers.auto_select(groups(spark), tracks(spark), rules).collect()) == [0, 2, 3]
    marks = spark.createDataFrame([(1,), (9,)], "id long")
    assert sorted(r.id for r in keepers.apply_choices(marks, keepers.choices(groups(spark), tracks(spark), rules)).collect()) == [0, 2, 3, 9]
    assert sorted(r.id for r in keepers.valid_marks(marks, groups(spark)).collect()) == [1]
    assert sorted(r.id for r in keepers.toggle_marks(marks, spark.createDataFrame([(1,), (4,)], "id long")).collect()) == [4, 9]
    assert K("path_contains", "x").description == "Path contains “x”"


def test_keeper_fold_equals_a_plain_loop(spark):
    """Groups of many copies, ranks that are missing or equal, lengths around the tolerance."""
    rng = random.Random(5)
    rows = [(g, p, g * 1000 + p, rng.choice(["mp3", "flac"]), rng.choice([None, 100.0, 100.3, 100.5, 100.6, 101.1]), rng.choice([None, 1, 2])) for g in range(40) for p in range(rng.choice([2, 5, 120]))]
    copies = conform(spark.createDataFrame([(i, f, d, b) for _, _, i, f, d, b in rows], "id long, format string, duration double, bitrate int"))
    copies = copies.join(spark.createDataFrame([(i, g, p) for g, p, i, *_ in rows], "id long, group_id long, pos long"), "id").repartition(5)
    for rules in ((K("longer_duration"), K("higher_bitrate")), (K("prefer_lossless"), K("longer_duration"), K("higher_bitrate")), (K("higher_bitrate"), K("prefer_lossless"))):
        value = {"longer_duration": lambda r: r[4], "higher_bitrate": lambda r: r[5], "prefer_lossless": lambda r: float(r[3] == "flac")}
        want = {}
        for r in sorted(rows):
            ranks = [value[k.kind](r) for k in rules]
            if r[0] not in want or keepers.beats(ranks, want[r[0]][1], [k.tolerance for k in rules]):
                want[r[0]] = (r[2], ranks)
        assert {r.group_id: r.keeper for r in keepers.best_copies(copies, rules).collect()} == {g: i for g, (i, _) in want.items()}
    assert keepers.best_copies(copies.limit(0)).count() == 0


def test_search_index(spark):
    texts = [(0, "Blue Möon\nx"), (1, ""), (2, None), (3, "blue moons"), (4, "oo"), (5, "漢字 blue"), (6, "a\u0301b")]
    folded = spark.createDataFrame(texts, "id long, t string").select("id", search_fold(F.col("t")).alias("search_text"))
    index = search.build(folded)
    plain = {i: s or "" for i, s in folded.collect()}
    for needle in ("", "blue", "MOON", "mö", "oo", "o", "字", "n\nx", "moons", "nothing", "  blue  ", "ab"):
        wanted = {i for i, s in plain.items() if spark.range(1).select(search_fold(F.lit(needle.strip()))).first()[0] in s}
        assert {r.id for r in search.search(index, needle).collect()} == wanted
    less = search.without(search.without(index, spark.createDataFrame([(0,)], "id long")), spark.createDataFrame([(5,), (77,)], "id long"))
    assert {r.id for r in search.search(less, "blue").collect()} == {3} == {r.id for r in search.search(search.compacted(less), "blue").collect()}
    more = search.with_texts(less, spark.createDataFrame([(3, "gone"), (9, "blue again")], "id long, search_text string"))
    assert {r.id for r in search.search(more, "blue").collect()} == {9} and {r.id for r in search.search(more, "gone").collect()} == {3}
    plan = search.search(index, "moon")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(gram" in plan


def test_views(spark):
    g, t = groups(spark), tracks(spark)
    ids = lambda out: [(r.id, r.track_ids) for r in out.orderBy("rank").collect()]
    assert ids(views.arrange(g, t, "confidence")) == [(1, [3, 4]), (0, [0, 1, 2])]
    assert ids(views.arrange(g, t, "copies")) == [(0, [0, 1, 2]), (1, [3, 4])]
    assert ids(views.arrange(g, t, "title")) == [(1, [4, 3]), (0, [0, 1, 2])]
    assert ids(views.arrange(g, t, "bitrate", False)) == [(0, [1, 2, 0]), (1, [4, 3])]
    assert ids(views.arrange(g, t, "artist", False)) == [(1, [4, 3]), (0, [0, 1, 2])]
    found = lambda *a: sorted(r.id for r in views.filter_groups(g, t, *a).collect())
    assert found("ea") == [0] and found("  EA ", 0.95) == [] and found("", 0.95) == [1] and found("/z/") == [1]
    differ = lambda c: sorted(map(tuple, views.differing_cells(g, t, c).collect()))
    assert differ("album") == [(0, 2)] and differ("title") == [(1, 3), (1, 4)] and differ("path") == [] and differ("format") == [(0, 0), (1, 3), (1, 4)]
    assert [tuple(r) for r in views.describe(g, t).orderBy("group_id").collect()] == [(0, "P – Éa", "3 copies · 90% · Same title"), (1, "b 10", "2 copies · 95% · Fuzzy title")]
    assert [tuple(r) for r in views.drop_copies(g, spark.createDataFrame([(3,), (1,)], "id long")).select("id", "track_ids").collect()] == [(0, [0, 2])]
    assert [tuple(r) for r in views.format_counts(t).orderBy("pos").select("format", "n").collect()] == [("mp3", 2), ("flac", 2), ("wav", 1)]


class Files:
    def __init__(self, files, broken=()):
        self.files, self.broken = set(files), set(broken)

    def exists(self, path):
        return path in self.files

    def move(self, source, destination):
        if source in self.broken:
            raise OSError("no")
        self.files.remove(source)
        self.files.add(destination)

    def bin(self, source):
        self.move(source, "/bin" + source)
        return "/bin" + source


def test_removal(spark, tmp_path):
    t = tracks(spark)
    planned = removal.plan(t, "/out/")
    assert [r.destination for r in planned.orderBy("track_id").collect()] == ["/out/m/a/one.mp3", "/out/m/b/one.flac", "/out/m/b/two.flac", "/out/m 2/t.mp3", "/out/z/u.wav"]
    assert removal.unique_root_names(["/b/m", "/a/m", "/a/m 2"]) == {"/a/m": "m", "/a/m 2": "m 2", "/b/m": "m 3"}
    assert removal.moves_into_folders(planned, ["/out/m 2", "/o"]).first().track_id == 3 and removal.moves_into_folders(planned, ["/ou"]).count() == 0
    files = Files([r.path for r in t.collect()] + ["/out/m/a/one.mp3"], broken=["/m/b/two.flac"])
    done = removal.execute(planned, files)
    assert [r["destination"] for r in done.records] == ["/out/m/a/one 2.mp3", "/out/m/b/one.flac", "/out/m 2/t.mp3", "/out/z/u.wav"] and [f["trackID"] for f in done.failures] == [2]
    log = removal.RemovalLog()
    log.append(done)
    log.save(path := str(tmp_path / "log.json"))
    assert removal.RemovalLog.load(path).first_undoable() == done and json.load(open(path))["operations"][0]["mode"] == "folder"
    files.files.remove("/out/z/u.wav")
    files.files.add("/n/m/t.mp3")
    restored, failures = removal.undo(done, files)
    assert [r["trackID"] for r in restored] == [1, 0] and [f["trackID"] for f in failures] == [4, 3]
    log.mark_undone(done.id, "2020-01-01T00:00:00Z", failures)
    assert log.first_undoable() is None and removal.RemovalLog.load(str(tmp_path / "none.json")).operations == []
    open(path, "w").write("{")
    content, aside = removal.load_or_set_aside(path)
    assert content is None and os.path.exists(aside) and not os.path.exists(path)
    stop = removal.execute(removal.plan(t), Files([r.path for r in t.collect()]), cancelled=lambda: True)
    assert stop.records == [] and removal.summary(done, 5, "/out/") == "Moved 4 files to “out”. 1 file couldn't be moved."


def test_tags(spark):
    rows = [(1, {"TITLE": ["a"], "ZED": ["z"], "GENRE": ["g"], "MOOD": [""]}, {"TITLE": ["b"], "ABC": ["c"], "GENRE": [""], "MOOD": ["m"]})]
    pairs = spark.createDataFrame(rows, "pair_id int, source map<string,array<string>>, destination map<string,array<string>>")
    out = tags.compare(pairs).orderBy("pos").collect()
    assert [(r.key, r.can_copy, r.fills_gap) for r in out] == [("TITLE", True, False), ("GENRE", True, True), ("MOOD", False, False), ("ABC", False, False), ("ZED", True, False)]
    assert tags.changes(tags.compare(pairs), ["TITLE", "MOOD", "ZED"]).first().changes == {"TITLE": ["a"], "ZED": ["z"]}
    after = pairs.select(tags.written(F.col("destination"), F.expr("map('TITLE', array('n'), 'ABC', cast(array() as array<string>))")).alias("m")).first().m
    assert after == {"TITLE": ["n"], "GENRE": [""], "MOOD": ["m"]}
    pick = lambda copies, marked, source: spark.range(1).select(tags.default_destination(F.array(*map(F.lit, copies)), F.array(*map(F.lit, marked)), F.lit(source)).alias("x")).first().x
    assert pick([1, 2, 3], [1, 3], 1) == 2 and pick([1, 2, 3], [2], 1) == 3 and pick([1, 2, 3], [2, 3], 1) == 2 and pick([1], [5], 1) is None


def test_waveform(spark):
    frames = spark.createDataFrame([(1, f, [v, -v / 2]) for f, v in enumerate([0.1, 0.9, 0.2, 0.4, 0.3])], "id int, frame long, samples array<double>")
    out = [tuple(map(lambda x: round(x, 6), r[1:])) for r in waveform.measure(frames, 2).orderBy("slice").collect()]
    level = lambda v: round((sum(x * x + x * x / 4 for x in v) / (2 * len(v))) ** 0.5, 6)
    assert out == [(0, 0.9, level([0.1, 0.9, 0.2])), (1, 0.4, level([0.4, 0.3]))]
    row = spark.sql("SELECT array(0.1D, 0.5D, 0.3D, 0.9D, 0.2D) AS v, array(double('nan'), -1D, 2D, 0.5D, null) AS w")
    got = row.select(waveform.resample(F.col("v"), 2).alias("a"), waveform.resample(F.col("v"), 7).alias("b"), waveform.resample(F.col("v"), 5).alias("c"), F.transform("w", waveform.quantise).alias("q"), waveform.resample(F.slice("v", 1, 0), 3).alias("e")).first()
    assert got.a == [0.5, 0.9] and got.b == [0.1, 0.1, 0.5, 0.3, 0.3, 0.9, 0.2] and got.c == [0.1, 0.5, 0.3, 0.9, 0.2] and got.e == []
    assert got.q[:3] == [0, 0, 1] and got.q[3] == 128 / 255 and got.q[4] == 0


def test_scan(spark, tmp_path):
    kept, missing = scan.scan_roots([("/a/b", "/r/b"), ("/a", "/r"), ("/gone", None), ("/rx", "/rx"), ("/again", "/r")])
    assert kept == [("/a", "/r"), ("/rx", "/rx")] and [p for p, _ in missing] == ["/gone"]
    real = tmp_path / "music"
    for name in ("a b.MP3", "sub/c+d.flac", "note.txt", ".hidden/e.mp3", "sub/.f.mp3", "Song.logicx/Audio/g.wav"):
        (real / name).parent.mkdir(parents=True, exist_ok=True)
        (real / name).write_bytes(b"x" * 7)
    (real / "link.mp3").symlink_to(real / "a b.MP3")
    (real / "linked").symlink_to(real / "sub")
    files = scan.list_files(spark, [("/chosen", str(real))])
    both, unread = scan.list_roots(spark, [("/chosen", str(real)), ("/gone", str(tmp_path / "gone"))])
    assert both.count() == 2 and [p for p, m in unread] == ["/gone"] and unread[0][1].startswith("Couldn't read this: ")
    assert scan.list_files(spark, []).count() == 0
    assert sorted((r.path, r.scan_root, r.size) for r in files.collect()) == [("/chosen/a b.MP3", "/chosen", 7), ("/chosen/sub/c+d.flac", "/chosen", 7)]

    def read(paths):
        meta = paths.select("path", F.expr("map('TITLE', array('t', 'u'), 'DATE', array('x 1999'))").alias("properties"), F.expr("named_struct('format', 'unknown', 'bitrate', 9, 'sample_rate', int(null), 'bit_depth', int(null), 'channels', 2)").alias("stream"),
                            F.expr("named_struct('duration', 5D, 'format', 'aac', 'sample_rate', 44100, 'channels', 1)").alias("decoded"), F.when(F.col("path").contains("c+d"), F.array(F.lit("bad"))).otherwise(F.expr("cast(array() as array<string>)")).alias("problems"))
        return scan.build_tracks(paths, meta)

    kept_fields = type(TRACK)([f for f in TRACK.fields if f.name != "id"])
    empty = scan.load_cache(spark, str(tmp_path / "cache"), kept_fields)
    found, problems, cache = scan.scan(files, empty, read)
    rows = found.orderBy("id").collect()
    assert [(r.id, r.path, r.title, r.year, r.format, r.sample_rate, r.channels) for r in rows] == [(0, "/chosen/a b.MP3", "t; u", 1999, "unknown", 44100, 2), (1, "/chosen/sub/c+d.flac", "t; u", 1999, "unknown", 44100, 2)]
    assert [r.message for r in problems.collect()] == ["bad"]
    scan.save_cache(cache, str(tmp_path / "cache"))
    again = scan.load_cache(spark, str(tmp_path / "cache"), kept_fields)
    assert not scan.is_changed(cache, again) and scan.is_changed(empty, again)
    scan.save_cache(again, str(tmp_path / "cache"))  # from itself
    assert scan.load_cache(spark, str(tmp_path / "cache"), kept_fields).count() == 1 and [p.name for p in tmp_path.iterdir() if p.name.startswith("cache-")] == []
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet")
    assert scan.load_cache(spark, str(tmp_path / "broken"), kept_fields).count() == 0
    again = scan.load_cache(spark, str(tmp_path / "cache"), kept_fields)
    assert scan.to_read(files, again).count() == 1 and scan.cache_hits(files, again).count() == 1
    assert scan.evict(again, ["/chosen"], files.limit(0)).count() == 0 and scan.evict(again, ["/chose"], files.limit(0)).count() == 1
    check = spark.sql("SELECT '/r/x' p").select(scan.rebase(F.col("p"), "/r", "/c").alias("a"), scan.rebase(F.col("p"), "/", "/c").alias("b"), scan.rebase(F.col("p"), "/r", "/").alias("c"), scan.rebase(F.col("p"), "/q", "/c").alias("d")).first()
    assert tuple(check) == ("/c/x", "/c/r/x", "/x", "/r/x")
    assert spark.sql("SELECT 'MP4' c, 'ALAC' k").select(scan.codec_format(F.col("c"), F.col("k"))).first()[0] == "alac"

    inbox = str(tmp_path / "inbox")
    fresh = read(files)
    fresh.write.parquet(inbox)
    follow(spark, inbox, fresh.schema, str(tmp_path / "streamed"), str(tmp_path / "progress")).awaitTermination()
    assert scan.load_cache(spark, str(tmp_path / "streamed"), type(TRACK)([f for f in fresh.schema.fields if f.name != "problems"])).count() == 1


def test_versions_go_on_after_a_restart(spark, tmp_path):
    """Two runs over files that arrive one after the other give what one run over both gives."""
    schema = "path string, size long, modified timestamp"
    rows = [[("a", 1, "2024-01-01 00:00:01"), ("a", 1, "2024-01-01 00:00:02"), ("b", 5, "2024-01-01 00:00:01"), (None, 1, "2024-01-01 00:00:01")], [("a", 1, "2024-01-01 00:00:03"), ("a", 2, "2024-01-01 00:00:04"), ("a", 9, "2024-01-01 00:00:01"), ("b", 6, "2024-01-01 00:00:09")]]
    frames = [spark.createDataFrame(r, "path string, size long, m string").selectExpr("path", "size", "CAST(m AS timestamp) AS modified") for r in rows]
    stream = lambda at: spark.readStream.schema(schema).parquet(f"{tmp_path}/{at}")
    for at, parts in (("both", [frames[0].union(frames[1].filter("size <> 9"))]), ("steps", frames)):
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{at}")
            cache_state.follow_changes(stream(at), f"{tmp_path}/{at}-out", f"{tmp_path}/{at}-state")
    both, steps = (sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{at}-out").select("path", "version", "size").collect())) for at in ("both", "steps"))
    assert both == steps == [("a", 1, 1), ("a", 2, 2), ("b", 1, 5), ("b", 2, 6)]


def test_cache_side_is_not_shuffled(spark):
    cache = conform(spark.range(50).selectExpr("id", "concat('/lib/', id, '.mp3') AS path", "id AS file_size", "timestamp '2024-01-01' AS modified")).drop("id")
    files = cache.filter("file_size < 40").select("path", "scan_root", (F.col("file_size") + F.when(F.col("file_size") % 10 == 0, 1).otherwise(0)).alias("size"), "modified")
    table = scan.bucketed(cache, buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out, n in ((scan.cache_hits(files, table), 36), (scan.to_read(files, table), 4), (scan.evict(table, ["/lib"], files), 40), (scan.compared(files, table), 50)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == n and "Bucketed: true" in plan
            table_side = [line for line in plan.splitlines() if "Exchange" in line]
            assert table_side and all("kindred_cache" not in line for line in table_side) and len(table_side) == 1 + ("distinct" in plan or "Aggregate" in plan), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_frames_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    sounds = {1: [rng.uniform(-1.2, 1.2) for _ in range(5000)], 2: [0.5], 3: [], 4: None}
    folder = frames.write_frames(spark.createDataFrame(list(sounds.items()), "id long, samples array<double>"), "samples", f"file://{tmp_path}/pcm")
    read = frames.read_frames(spark, folder, range_bytes=512)
    assert read.filter("id = 1").select(F.spark_partition_id()).distinct().count() == 20
    got = {(r.id, r.frame): r.samples[0] for r in read.collect()}
    stored = lambda x: round(max(-1, min(1, x)) * 32767) / 32767
    assert len(got) == 5001 and all(abs(got[i, k] - stored(x)) < 1e-6 for i, s in sounds.items() for k, x in enumerate(s or []))
    two = frames.read_frames(spark, folder, channels=2).filter("id = 1")
    assert two.count() == 2500 and all(len(r.samples) == 2 and abs(r.samples[1] - stored(sounds[1][2 * r.frame + 1])) < 1e-6 for r in two.collect())
    whole, parts = (sorted(map(tuple, waveform.measure(x, 7).collect())) for x in (frames.read_frames(spark, folder), read))
    assert [w[:3] for w in whole] == [p[:3] for p in parts]


def test_postings_are_made_without_a_shuffle(spark):
    """Each task sorts the postings of its own texts; a small table is dealt over all cores first."""
    texts = spark.range(200).selectExpr("id", "concat('blue moon ', id) AS search_text")
    index = search.build(texts)
    read = index.postings.withColumn("file", F.input_file_name())
    assert read.filter("gram = 'moo'").select("file").distinct().count() > 1  # segments, not ranges
    assert {r.id for r in search.search(index, "moon 19").collect()} == {19, *range(190, 200)}


def test_versions_are_numbered_without_a_python_call_per_path(spark, tmp_path):
    """A batch is one window over its paths; two sizes at one time are two versions, and a repeated batch of sightings is none."""
    seen = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 2, 5), ("b", 3, 1), (None, 1, 1)], "path string, size long, m long").selectExpr("path", "size", "timestamp_seconds(m) AS modified")
    out = cache_state.changes(seen)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.version, r.size) for r in out.collect() if r.changed) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)]
    stream = lambda: spark.readStream.schema(seen.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        seen.write.mode("append").parquet(f"{tmp_path}/in")
        cache_state.follow_changes(stream(), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)]
