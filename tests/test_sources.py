"""Archives, recordings, metadata, tables and streams on small files."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from tandemetry.sources import recordings as R
from tandemetry.sources import archives, feature_store, tables
from tandemetry.streaming.windows import event_windows, windowed


@pytest.fixture
def folder(tmp_path):
    frame = lambda ms, x: " ".join([str(ms), *([f"{x} 0 1000"] * 25)])
    head = "\n".join(["NO_OF_FRAMES\t2", "NO_OF_CAMERAS\t8", "NO_OF_MARKERS\t2", "FREQUENCY\t100", *["X\t0"] * 5, "MARKER_NAMES\tA\tB"])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/P01T01.LAB", "0.5 a\n1.5 _\nbroken line here\n2.0 a\n3.0 b\n")
        z.writestr("d/k1.txt", frame(0, 500) + "\n" + frame(33, 1000))
        z.writestr("d/license.txt", "free")
        z.writestr("d/q1.tsv", head + "\n1\t2\t3\tNaN\t5\t6\n7\t8\t9\t10\t11\t12\n")
    return tmp_path


def test_members_annotations_and_frames(spark, folder):
    archive = str(folder / "a.zip")
    labels = R.members(spark, archive, ".lab").select(F.col("stem").alias("recording"), "content")
    codes = spark.createDataFrame([("a", "G01", "D01"), ("b", "G02", "D01")], "code string, gesture string, direction string")
    got = [(r.gesture, r.segment, r.start_s, r.end_s) for r in R.annotations(labels, codes).orderBy("ord").collect()]
    assert got == [("G01", "S01", 0.5, 1.5), ("G01", "S02", 2.0, 3.0), ("G02", "S01", 3.0, None)]
    with pytest.raises(Exception, match="unknown label"):
        R.annotations(labels, codes.filter("code = 'a'")).collect()
    texts = R.members(spark, archive, ".txt")
    assert [r.stem for r in texts.collect()] == ["k1"]
    k = R.depth_frames(texts).orderBy("frame").collect()
    assert [r.t for r in k] == [0.0, 0.033] and len(k[0].p) == 25 and k[1].p[3].x == 1.0
    q = R.marker_frames(R.members(spark, archive, ".tsv")).orderBy("frame").collect()
    assert [r.t for r in q] == [0.0, 0.01] and q[0].p[1].x is None and q[1].p[1].z == 0.012
    assert R.marker_header(R.members(spark, archive, ".tsv")).first().marker_names == ["A", "B"]
    with pytest.raises(Exception, match="wrong size"):
        R.marker_frames(R.members(spark, archive, ".tsv").withColumn("content", F.concat("content", F.lit("\n1")))).collect()


def test_participants(spark, tmp_path):
    row = lambda p: "\t".join([p, "F", "30", "60", "170", "5", "expert", "9", "8", "7", "8"])
    (tmp_path / "m.txt").write_text("\n".join(["Title", row("P01"), row("P2"), "note", row("P12")]))
    got = R.participants(spark, str(tmp_path / "m.txt"), 2).orderBy("participant_id").collect()
    assert [r.participant_id for r in got] == ["P01", "P12"] and got[0].skill_mean == 8
    with pytest.raises(ValueError):
        R.participants(spark, str(tmp_path / "m.txt"), 12)


def test_manifest_and_build_once(spark, folder, tmp_path):
    assert tables.manifest(spark, str(folder)).filter(F.length("sha256") == 64).count() == 1
    path, made = str(tmp_path / "t"), []

    def build():
        made.append(1)
        return spark.range(3)

    assert tables.build_once(spark, path, build).count() == tables.build_once(spark, path, build).count() == 3
    assert made == [1]


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    a = event_windows(spark, path)
    b = windowed(spark.read.parquet(path).withColumn("at", F.col("ts").cast("timestamp")), "at", "value", "event_type", "1 day", "1 hour")
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.mean, 9)) for r in df.collect())
    assert key(a) == key(b)


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    import os

    rows = ["2024-01-01 10:00:00", "2024-01-10 10:00:00"], ["2024-01-10 11:00:00"], ["2024-01-01 11:00:00", "2024-01-10 12:00:00"]
    (tmp_path / "e").mkdir()
    for i, times in enumerate(rows):  # one file a batch, in the order of their times of change
        made = spark.createDataFrame([(t, "click", float(i)) for t in times], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        table = made.toPandas()
        table.to_parquet(tmp_path / "e" / f"{i}.parquet", coerce_timestamps="us")
        os.utime(tmp_path / "e" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got = {r.start.day: (r.n, r.most) for r in event_windows(spark, str(tmp_path / "e"), files_per_batch=1).collect()}
    assert got == {1: (1, 0.0), 10: (3, 2.0)}


def many(folder, names, n=30):
    folder.mkdir()
    for name in names:
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("d/", "")
            for i in range(n):
                z.writestr(f"d/{name[0]}{i:02d}.TXT", f"first {i}\nsecond\n" + "x" * 2000)
            z.writestr(f"later/{name[0]}00.txt", "again")  # a stem's last member counts
            z.writestr("LICENSE.txt", "free")
            z.writestr("d/bad.bin", b"\xff\xfe")
    return str(folder)


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    path = many(tmp_path / "z", ["a.zip", "b.ZIP"])
    whole = archives.members(spark, path, ".txt")
    parts = archives.members(spark, path, ".txt", split_bytes=500)
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 60 and want[0][1:] == ("a00", "again") and want[1][2].startswith("first 1\nsecond\nx")
    assert sorted(map(tuple, parts.collect())) == want
    assert len({r[0] for r in parts.filter("archive like '%a.zip'").select(F.spark_partition_id()).collect()}) > 5
    one = archives.members(spark, f"{path}/*.zip", ".txt")
    assert one.select("archive").distinct().count() == 1 and one.count() == 30
    assert archives.members(spark, f"file://{path}/b.ZIP", ".bin").first().content == "��"
    assert archives.members(spark, path, ".none").count() == 0
    for missing in (str(tmp_path / "nowhere"), f"{path}/*.tar"):
        with pytest.raises(Exception, match="FileNotFound"):
            archives.members(spark, missing, ".txt").collect()
    (tmp_path / "broken.zip").write_text("no archive")
    with pytest.raises(Exception, match="BadZipFile"):
        archives.members(spark, str(tmp_path / "broken.zip"), ".txt").collect()


def test_only_what_is_asked_for_is_unpacked(spark, tmp_path, monkeypatch):
    path = many(tmp_path / "z", ["a.zip"])
    assert {r.content for r in archives.members(spark, path, ".txt", lines=0).collect()} == {None}
    assert sorted(r.content for r in archives.members(spark, path, ".txt", lines=1).filter("stem in ('a03', 'a04')").collect()) == ["first 3\n", "first 4\n"]
    assert archives.count_members(spark, path, ".txt", 30) == 30
    with pytest.raises(ValueError):
        archives.count_members(spark, path, ".txt", 12)
    reader = archives.MemberReader({"path": path, "suffix": ".txt"})
    left = list(reader.pushFilters([EqualTo(("stem",), "a05"), EqualTo(("archive",), "q")]))
    assert [f.attribute for f in left] == [("archive",)]
    opened = []
    unpack = reader._content
    monkeypatch.setattr(reader, "_content", lambda z, info: opened.append(info.filename) or unpack(z, info))
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert opened == ["d/a05.TXT"] and len(rows) == 1
    plan = archives.members(spark, path, ".txt").filter("stem = 'a05'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan zip_members" in plan and "a05" not in plan  # the source has taken the filter


def test_archives_written_by_tasks(spark, tmp_path):
    texts = spark.createDataFrame([(f"s{i}", None if i == 3 else f"é {i}\n" * i) for i in range(20)], "stem string, content string").repartition(3)
    done = archives.write_members(texts, f"file://{tmp_path}/out", ".txt").collect()
    assert sum(r.n for r in done) == 20 and len(done) == 3
    got = {r.stem: r.content for r in archives.members(spark, f"file://{tmp_path}/out", ".txt", split_bytes=50).collect()}
    assert got == {r.stem: r.content or "" for r in texts.collect()}
    again = archives.write_members(texts, f"file://{tmp_path}/out", ".txt").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, done)) and archives.count_members(spark, f"file://{tmp_path}/out", ".txt") == 20


def test_only_unseen_keys_are_extracted(spark, tmp_path):
    store, asked = str(tmp_path / "store"), []

    def extract(rows):
        asked.append(sorted((r.k for r in rows.select("k").distinct().collect()), key=str))
        return rows.filter("v > 0").groupBy("k").agg(F.sum("v").alias("total"))

    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, w string")
    run = lambda df, version="1": {r.k: (r.total, r.extracted) for r in feature_store.incremental(df, "k", store, version, extract).collect()}
    assert run(frame([])) == {} and asked.pop() == []
    rows = [("a", 1, None), ("a", 1, None), ("b", 2, "x"), (None, 3, ""), ("none", 0, "")]
    assert run(frame(rows)) == {"a": (2, True), "b": (2, True), None: (3, True)}
    assert asked.pop() == [None, "a", "b", "none"]
    assert run(frame(rows[::-1]).repartition(3)) == {"a": (2, False), "b": (2, False), None: (3, False)} and asked == []
    changed = [("a", 1, None), ("b", None, "x"), ("b", 2, "x"), (None, 3, ""), ("c", 4, "")]  # a repeat less, a row more, a new key, a key less
    assert run(frame(changed)) == {"a": (1, True), "b": (2, True), None: (3, False), "c": (4, True)}
    assert asked.pop() == ["a", "b", "c"]
    assert run(frame(changed), "2") == {"a": (1, True), "b": (2, True), None: (3, True), "c": (4, True)} and len(asked.pop()) == 4
    assert run(frame(rows)) == {"a": (2, False), "b": (2, False), None: (3, False)} and asked == []  # an earlier state is still known
    swapped = feature_store.digests(frame([("a", 1, None)]), "k").first().digest, feature_store.digests(frame([("a", None, "1")]), "k").first().digest
    assert swapped[0] != swapped[1]


def test_a_run_that_dies_leaves_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    total = lambda df: df.groupBy("k").agg(F.sum("v").alias("total"))
    feature_store.incremental(rows, "k", store, "1", total)
    spark.createDataFrame([("a", 77)], "k string, total long").write.parquet(f"{store}/features/died")  # before its manifest
    assert {(r.k, r.total) for r in feature_store.incremental(rows, "k", store, "1", total).collect()} == {("a", 1), ("b", 2)}


def test_segments_features_are_kept(spark, tmp_path):
    """The composed feature table: one trajectory changes, one is extracted."""
    from tandemetry.operators.conditions import as_it_is, feature_table
    from tandemetry.plans.views import pose

    few = pose(spark, "/root/testdata/sf0.001").filter("label < 3")
    whole = few.withColumn("x", F.when((F.col("label") == 1) & (F.col("frame") == 2), F.col("x") + 1).otherwise(F.col("x")))
    of = lambda rows: feature_table(rows, conditions={"as_it_is": as_it_is})
    feature_store.incremental(few, "label", str(tmp_path / "s"), "1", of)
    got = {r.label: r for r in feature_store.incremental(whole, "label", str(tmp_path / "s"), "1", of).collect()}
    assert {k: r.extracted for k, r in got.items()} == {0: False, 1: True, 2: False}
    want = {r.label: r for r in of(whole).collect()}
    assert all(got[k][c] == pytest.approx(want[k][c]) for k in want for c in ("knee", "path", "sparc"))
