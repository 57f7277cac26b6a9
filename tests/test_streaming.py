"""Streams give what the batch operators give."""
import pytest
from pyspark.sql import functions as F
from test_folds import FRAMES, frame_dets  # noqa: F401

from veilframe.operators import report, text as ops, video
from veilframe.streaming import flows, tracker


def run(stream, tmp_path, mode="append"):
    query = (stream.writeStream.format("memory").queryName("out").outputMode(mode)
             .option("checkpointLocation", f"{tmp_path}/checkpoint").start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.sql("SELECT * FROM out").collect()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    yield
    spark.conf.unset(name)


def timed(spark, rows):
    return spark.createDataFrame(rows, FRAMES).withColumn("ts", F.timestamp_seconds(F.col("frame_no") + 1000))


def late(spark, at, video=9):
    """A row of another video that moves the watermark."""
    return spark.createDataFrame([(video, 0, 0, "face", 0, 0, 50, 50, 1.0, False)], FRAMES).withColumn("ts", F.timestamp_seconds(F.lit(at)))


def test_tracks_equal_batch(spark, frame_dets, tmp_path, rocks):  # noqa: F811
    dets = timed(spark, frame_dets)
    # Frames of a video arrive in two halves each, out of order inside a file.
    for cond in ("frame_no < 31", "frame_no >= 31"):
        dets.where(cond).orderBy(F.desc("frame_no")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late(spark, 10000).write.mode("append").parquet(f"{tmp_path}/in")
    stream = tracker.track_stream(flows.frame_detections(spark, f"{tmp_path}/in", files_per_batch=1))
    got = sorted(tuple(r) for r in run(stream, tmp_path) if r.video_id != 9)
    assert got == sorted(map(tuple, video.track(spark.createDataFrame(frame_dets, FRAMES)).collect())) and any(r[-1] for r in got)


def test_ended_videos_leave_no_state(spark, frame_dets, tmp_path, rocks):  # noqa: F811
    """With lengths the tail equals the batch's; a restart goes on from the state; at the end only the last video is held."""
    lengths = [(v, 3 + max(r[1] for r in frame_dets if r[0] == v)) for v in {r[0] for r in frame_dets}]
    videos = spark.createDataFrame(lengths, "video_id bigint, frames int")
    dets = timed(spark, frame_dets).join(videos, "video_id")
    path, schema = f"{tmp_path}/in", dets.schema
    start = lambda: tracker.track_stream(spark.readStream.schema(schema).parquet(path)).writeStream.format("parquet").option(
        "path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    for part in (dets.where("frame_no < 31"), dets.where("frame_no >= 31"), late(spark, 10000).withColumn("frames", F.lit(1)), late(spark, 20000, 10).withColumn("frames", F.lit(1))):
        part.select(dets.columns).coalesce(1).write.mode("append").parquet(path)
        query = start()
        query.processAllAvailable()
        query.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.video_id < 9)
    want = video.track(spark.createDataFrame(frame_dets, FRAMES), videos)
    assert got == sorted(map(tuple, want.collect())) and len(got) > video.track(spark.createDataFrame(frame_dets, FRAMES)).count()
    held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/checkpoint")
    assert {r.key.video_id for r in held("progress").collect()} <= {10}
    assert held("tracks").count() <= 1


def test_redaction_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a@b.co now"), (2, "plain")], "id int, text string")
    df.write.parquet(f"{tmp_path}/in")
    got = run(flows.redacted(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), tmp_path)
    want = ops.redact(ops.detect(df), 1).select("id", "redacted").collect()
    assert sorted((r.id, r.redacted) for r in got) == sorted(map(tuple, want))


def test_running_counts(spark, frame_dets, tmp_path):  # noqa: F811
    dets = spark.createDataFrame(frame_dets, FRAMES).withColumn("ts", F.timestamp_seconds(F.col("frame_no")))
    dets.write.parquet(f"{tmp_path}/in")
    got = run(flows.running_counts(flows.frame_detections(spark, f"{tmp_path}/in")), tmp_path, "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, dets.groupBy("video_id", "type").count().collect()))


def test_hourly_rate(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = flows.hourly_rate(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    got = {(r.hour, r.event_type): r.n for r in run(stream, tmp_path)}
    want = {(r.hour, r.event_type): r.n for r in report.hourly_rate(events).collect()}
    # The last windows stay open until the watermark passes them.
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) < 12


def test_feedback_store(spark, tmp_path):
    rows = spark.sql("SELECT 'B-PER' label, TIMESTAMP '2024-01-20 00:00:00' ts UNION ALL SELECT 'B-LOC', TIMESTAMP '2024-01-01 00:00:00'")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = flows.store_feedback(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    later = spark.sql("SELECT 'B-DOC' label, TIMESTAMP '2024-01-02 00:00:00' ts")
    later.write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    # The second batch alone would have kept its row; the newest row of all decides.
    assert [r.label for r in flows.stored_feedback(spark, f"{tmp_path}/out").collect()] == ["B-PER"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_retention_reads_only_its_days(spark, tmp_path):
    """Old days are pruned by folder; compaction changes nothing that is read, also when it was interrupted."""
    path = f"{tmp_path}/store"
    days = ["2024-01-20 10:00:00", "2024-01-20 09:00:00", "2024-01-13 10:00:00", "2024-01-13 09:59:59", "2024-01-02 00:00:00", None]
    for number in range(6):
        rows = spark.createDataFrame([(f"{number}-{i}", d) for i, d in enumerate(days)], "label string, at string")
        flows.sinks.write_table(rows.select("label", F.col("at").cast("timestamp").alias("ts")).withColumn("dt", F.to_date("ts")), f"{path}/batch={number}", by=["dt"])
    read = lambda: sorted(r.label for r in flows.stored_feedback(spark, path).collect())
    want = sorted(f"{n}-{i}" for n in range(6) for i in range(3))
    assert read() == want and flows.stored_feedback(spark, path, None).count() == 36
    plan = flows.stored_feedback(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dt" in plan.split("PartitionFilters: [")[1].split("]")[0]
    flows.compact_feedback(spark, path)
    assert flows._numbers(spark, path, "batch") == [4, 5] and read() == want and flows.stored_feedback(spark, path, None).count() == 36
    # Interrupted after the copy was written: the batches it holds go when it is next read.
    flows.sinks.write_table(spark.read.parquet(f"{path}/batch=4"), f"{path}/_compacted-4", by=["dt"])
    assert read() == want and flows._numbers(spark, path, "batch") == [4, 5]
    for number in (6, 7):
        flows.sinks.write_table(spark.read.parquet(f"{path}/batch=5"), f"{path}/batch={number}", by=["dt"])
    flows.compact_feedback(spark, path, days=7)
    assert flows._numbers(spark, path, "batch") == [6, 7] and flows.stored_feedback(spark, path, None).count() == 7 * 4 + 6


def test_stored_counts_give_the_reports(spark, frame_dets, tmp_path):  # noqa: F811
    """Many batches with totals in between; a batch that runs again changes nothing."""
    dets = spark.createDataFrame(frame_dets, FRAMES).withColumn("ts", F.timestamp_seconds(F.col("frame_no")))
    path, start = f"{tmp_path}/counts", lambda where: flows.store_counts(flows.frame_detections(spark, f"{tmp_path}/in", files_per_batch=1), path, where, every=3)
    for part in range(9):
        dets.where(F.col("det_id") % 9 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = start(f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    videos = dets.groupBy("video_id").agg((F.max("frame_no") + 1).alias("frames"))
    want = sorted(map(str, video.report(dets, 24, videos).collect()))
    reports = lambda: sorted(map(str, flows.report_from_counts(spark, path, videos, 24).collect()))
    assert reports() == want and len(flows._totals(spark, path)) >= 2
    last = flows._numbers(spark, f"{path}/part", "batch")[-1]
    spark.read.parquet(f"{path}/part/batch={last}").cache().write.mode("overwrite").parquet(f"{path}/again")
    spark.read.parquet(f"{path}/again").write.mode("overwrite").parquet(f"{path}/part/batch={last}")
    assert reports() == want
    # The newest batch again, as after a failure before its commit.
    from veilframe.session import remove
    commits = f"{tmp_path}/checkpoint/commits"
    remove(spark, f"{commits}/{last}")
    remove(spark, f"{commits}/.{last}.crc")
    query = start(f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    assert reports() == want
