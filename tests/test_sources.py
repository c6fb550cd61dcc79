import json

import pytest
from pyspark.sql import functions as F

from spanforge.functions.taxonomy import CLASSES, drift
from spanforge.sources import files, sinks
from spanforge.streaming import monitor

CSV = """video_id,level,is_anomaly,class_name,start_time_sec,end_time_sec,description_summary
 A ,2,true, fire ,1.5,9,"a, quoted ""word"" here"
B,1,false,normal,,,
C,1,true,smoke,,,
D,2,true,fire,5,5,
E,2,true,fire,9,5,
F,2,true,unheard,1,2,
G,2,true,fire,x,2,
H,2,true,fire,1,,
"""


def test_truth(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    events, videos, rejects = files.truth(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, events.collect()), key=str) == [("A", "fire", 1.5, 9.0), ("C", "smoke", None, None)]
    assert {r["video_id"] for r in videos.collect()} == {"A", "B", "C"}
    assert {r["video_id"]: r["reason"] for r in rejects.collect()} == {"D": "ends before it starts", "E": "ends before it starts", "F": "unknown class", "G": "not a number", "H": "one bound missing"}
    with pytest.raises(Exception, match="D: ends before it starts"):
        files.truth(spark, str(tmp_path / "t.csv"), strict=True)[0].collect()


def test_truth_without_level_and_folders(spark, tmp_path):
    for folder, rows in (("fire", "a,true,fire,1,2,x\nb,false,normal,,,\n"), ("smoke", "c,true,fire,1,2,x\nd,true,smoke,1,2,x\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "ground_truth.csv").write_text("video_id,is_anomaly,class_name,start_time_sec,end_time_sec,description_summary\n" + rows)
    rows = files.by_class_folder(spark, str(tmp_path))
    assert {(r["folder"], r["video_id"], r["class_name"]) for r in rows.collect()} == {("fire", "a", "fire"), ("fire", "b", "normal"), ("smoke", "c", "fire"), ("smoke", "d", "smoke")}
    assert [tuple(r) for r in files.impure(rows).collect()] == [("smoke", ["fire"])]


def test_manifest_last_entry_counts(spark, tmp_path):
    doc = {"schema_version": "1", "videos": [{"video_id": "A", "level": 1, "duration_sec": 5}, {"video_id": "B", "level": 2, "duration_sec": 6.5}, {"video_id": "A", "level": 3, "duration_sec": 7}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    got = files.manifest(spark, str(tmp_path / "m.json")).orderBy("manifest_ord").collect()
    assert [(r["video_id"], r["level"], r["duration"]) for r in got] == [("B", 2, 6.5), ("A", 3, 7.0)]


def test_json_lines(spark, tmp_path):
    rows = [{"video_id": "A", "events": [{"class_name": "fire", "start": 1, "end": 2}]}, {"video_id": "A", "events": [{"class_name": "smoke", "start_time_sec": 3, "end_time_sec": 4}]}, {"x": 1}, {"video_id": "B", "events": [], "failed": "oom"}]
    (tmp_path / "e.jsonl").write_text("\n".join([*map(json.dumps, rows), "", "{broken"]))
    got, problems = files.json_lines(spark, str(tmp_path / "e.jsonl"), files.EVENTS)
    assert [(r["video_id"], r["class_name"], r["t0"]) for r in files.exploded(got).collect()] == [("A", "smoke", 3.0)]
    assert sorted(r["problem"] for r in problems.collect()) == ["already seen, keeping the last", "no video_id", "not JSON"]


def test_small_readers(spark, tmp_path):
    assert files.durations(spark, str(tmp_path / "none.tsv")).collect() == []
    (tmp_path / "m.tsv").write_text("duration\tvideo_id\n1.5\ta\nx\tb\n\tc\n")
    assert [tuple(r) for r in files.durations(spark, str(tmp_path / "m.tsv")).collect()] == [("a", 1.5)]
    (tmp_path / "f.jsonl").write_text(json.dumps({"video_id": "a", "level": 1, "series": [{"t": 0, "ego": 0.5, "n": 3}]}) + "\n" + json.dumps({"video_id": "b", "failed": "x"}))
    assert [(r["video_id"], r["t"], r["ego"]) for r in files.features(spark, str(tmp_path / "f.jsonl")).collect()] == [("a", 0, 0.5)]
    doc = {"predictions": [{"video_id": "A", "events": [{"class_name": "fire", "start_time_sec": 1.0, "end_time_sec": 2.0}]}, {"video_id": "B", "events": []}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=2))
    assert [(r["video_id"], r["t1"]) for r in files.submission(spark, str(tmp_path / "s.json")).collect()] == [("A", 2.0)]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "A.mp4").write_bytes(b"x")
    known = spark.createDataFrame([("Z", 2, 4.0)], "video_id string, level int, duration double")
    assert [(r["video_id"], r["level"], r["duration"]) for r in files.listing(spark, str(tmp_path / "v"), known).collect()] == [("A", 1, None)]


def test_sinks(spark, tmp_path):
    videos = spark.createDataFrame([("A", 1, 5.0), ("B", 2, 6.0)], "video_id string, level int, duration double")
    events = spark.createDataFrame([("B", "fire", 1.0, 2.25)], "video_id string, class_name string, t0 double, t1 double")
    sinks.write_dataset(events, videos, str(tmp_path / "d"))
    back = files.truth_rows(spark, str(tmp_path / "d/ground_truth")).orderBy("video_id").collect()
    assert [(r["video_id"], r["class_name"], r["t1"]) for r in back] == [("A", "normal", None), ("B", "fire", 2.25)]
    rows = spark.range(50).select(F.col("id"), F.when(F.col("id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e"))).alias("events"))
    counts = sinks.write_training_rows(rows, str(tmp_path / "t"))
    assert counts.agg(F.sum("rows"), F.sum("negatives")).first() == (50, 10)
    for n in (3, 5):
        cache = sinks.cache_missing(spark.range(n), str(tmp_path / "c"), "id", lambda x: x.withColumn("v", F.rand()))
        assert cache.count() == n
    assert sinks.page(spark.createDataFrame([("</b>",)], "x string"), "<script>{data}</script>") == '<script>[{"x":"<\\/b>"}]</script>'
    bad = spark.createDataFrame([("missing id", "Q", None)], "problem string, video_id string, ord long")
    with pytest.raises(ValueError, match="Q: missing id"):
        sinks.refuse(bad)
    sinks.refuse(bad.limit(0))
    assert drift(CLASSES, CLASSES[1:]) == [CLASSES[0]]


def test_stream(spark, tmp_path):
    rows = spark.range(40).select(F.timestamp_seconds(F.col("id") * 3).alias("at"), (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("ms"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = monitor.append_to(monitor.windowed_latency(stream, "at", "k", "ms", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = rows.groupBy(F.window("at", "20 seconds", "10 seconds").alias("w"), "k").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("w0"), "k", "calls")
    assert got.count() and got.select("w0", "k", "calls").exceptAll(batch).count() == 0
    events = spark.createDataFrame([(1.0, None), (2.0, 9.0)], "t1 double, window_end double")
    assert monitor.due(monitor.alerts(events, 500.0), 2.0).count() == 1


def test_payload_is_one_document(spark, tmp_path):
    """Null times are written, empty explanations are not; videos without events have an empty list and the default runtime."""
    from spanforge.operators import documents

    rows = spark.createDataFrame([("B", 1, "fire", 1.5, 2.0, 'a "quoted" one'), ("B", 0, "smoke", None, None, ""), ("X", 0, "fire", 1.0, 2.0, None)], "video_id string, ord int, class_name string, t0 double, t1 double, explanation string")
    manifest = spark.createDataFrame([("B", 1), ("A", 0), ("C", 2)], "video_id string, manifest_ord int")
    sinks.write_payload(documents.submission_entries(rows, manifest), str(tmp_path / "out"), "1.0", "s1", "m1")
    [part] = (tmp_path / "out").glob("part-*")
    doc = json.loads(part.read_text())
    assert doc["run_metadata"] == {"total_wall_time_ms": 0.0, "max_parallel_videos": 1, "hardware": "unspecified"}
    assert [(p["video_id"], p["runtime_metadata"]["chunks_processed"]) for p in doc["predictions"]] == [("A", 1), ("B", 1), ("C", 1)]
    assert doc["predictions"][1]["events"] == [{"class_name": "smoke", "start_time_sec": None, "end_time_sec": None}, {"class_name": "fire", "start_time_sec": 1.5, "end_time_sec": 2.0, "explanation": 'a "quoted" one'}]
    assert [(r["video_id"], r["class_name"]) for r in files.submission(spark, str(part)).collect()] == [("B", "smoke"), ("B", "fire")]


def test_last_path_counts(spark, tmp_path):
    for name, kind in (("z", "fire"), ("a", "smoke")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"video_id": "A", "events": [{"class_name": kind, "start": 1, "end": 2}]}))
    got, _ = files.json_lines(spark, [str(tmp_path / "z.jsonl"), str(tmp_path / "a.jsonl")], files.EVENTS)
    assert [r["class_name"] for r in files.exploded(got).collect()] == ["smoke"]
    got, _ = files.json_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "z.jsonl")], files.EVENTS)
    assert [r["class_name"] for r in files.exploded(got).collect()] == ["fire"]
