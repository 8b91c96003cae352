"""Streams run to the end equal their batch meaning."""

from pyspark.sql import functions as F

from slaframe.session import fresh_dir
from slaframe.streaming import streams

from conftest import SF_MID, SF_SMALL


def test_ingest_equals_batch(spark):
    base = fresh_dir(spark, "test-ingest")
    q = streams.stream_ingest(streams.read_event_stream(spark, SF_SMALL, "events.parquet"))
    streams.run_available(q, f"{base}/sink", f"{base}/ckpt")
    got = spark.read.parquet(f"{base}/sink")
    want = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_ingest_drops_duplicates_across_files(spark):
    base = fresh_dir(spark, "test-dups")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.write.parquet(f"{base}/in/a")
    ev.limit(50).write.parquet(f"{base}/in/b")  # the same events again
    src = spark.readStream.schema(streams.EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    streams.run_available(streams.stream_ingest(src, "365 days"), f"{base}/sink", f"{base}/ckpt")
    assert spark.read.parquet(f"{base}/sink").count() == ev.count()


def test_window_counts_hold_back_last_day(spark):
    base = fresh_dir(spark, "test-kpis")
    q = streams.stream_kpis(streams.read_event_stream(spark, SF_MID, "events.parquet"))
    streams.run_available(q, f"{base}/sink", f"{base}/ckpt")
    out = spark.read.parquet(f"{base}/sink")
    assert out.count() == 145
    assert out.agg(F.sum("events")).collect()[0][0] == 9671


def _two_runs(spark, name, watermark):
    base = fresh_dir(spark, name)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.where("event_id % 2 = 0").write.parquet(f"{base}/in/a")
    src = lambda: spark.readStream.schema(streams.EVENT_SCHEMA).option("recursiveFileLookup", "true") \
        .parquet(f"{base}/in")
    streams.run_available(streams.stream_ingest(src(), watermark), f"{base}/sink", f"{base}/ckpt")
    first = spark.read.parquet(f"{base}/sink").count()
    ev.where("event_id % 2 = 1").write.parquet(f"{base}/in/b")
    streams.run_available(streams.stream_ingest(src(), watermark), f"{base}/sink", f"{base}/ckpt")
    return ev, first, spark.read.parquet(f"{base}/sink")


def test_restart_resumes_from_checkpoint(spark):
    ev, first, out = _two_runs(spark, "test-restart", "365 days")
    assert first == ev.where("event_id % 2 = 0").count()
    assert out.count() == ev.count()


def test_rows_behind_the_watermark_are_dropped(spark):
    # After the first run the watermark is max(ts) - 1 hour; the second
    # file's events are interleaved in time, so nearly all are late.
    ev, first, out = _two_runs(spark, "test-late", "1 hour")
    late_ok = ev.where("event_id % 2 = 1").where(
        F.col("ts") >= ev.where("event_id % 2 = 0").agg(F.max("ts")).collect()[0][0]
        - __import__("datetime").timedelta(hours=1)).count()
    assert out.count() == first + late_ok


def _conflicting(spark, base, parts):
    """Events in ``parts`` files: repeated rows, ids on two dates, null ids."""
    ev = spark.read.schema(streams.EVENT_SCHEMA).parquet(f"{SF_SMALL}/events.parquet").limit(300)
    later = ev.where("event_id % 5 = 0").withColumn("ts", F.timestamp_add("DAY", F.lit(2), F.col("ts")))
    earlier = ev.where("event_id % 5 = 1").withColumn("ts", F.timestamp_add("DAY", F.lit(-2), F.col("ts")))
    null_ids = ev.where("event_id % 50 = 2").withColumn("event_id", F.lit(None).cast("long"))
    rows = ev.unionByName(later).unionByName(earlier).unionByName(ev.limit(50)).unionByName(null_ids)
    rows.orderBy(F.rand(7)).repartition(parts).write.parquet(f"{base}/in.parquet")
    return ev, null_ids, streams.read_event_stream(spark, f"{base}/in.parquet", max_files_per_trigger=1)


def test_ingest_is_the_same_for_any_split_into_batches(spark):
    got = []
    for parts in (1, 3, 5):
        base = fresh_dir(spark, f"test-split{parts}")
        ev, null_ids, stream = _conflicting(spark, base, parts)
        streams.ingest_once(stream, f"{base}/sink", f"{base}/ckpt")
        out = streams.read_ingested(spark, f"{base}/sink")
        got.append(sorted(map(str, out.collect())))
        want = ev.withColumn("ts", F.when(F.col("event_id") % 5 == 1, F.timestamp_add("DAY", F.lit(-2), F.col("ts"))).otherwise(F.col("ts")))
        want = want.unionByName(null_ids.orderBy("ts", "user_id", "event_type", "value", "props").limit(1))
        assert got[-1] == sorted(map(str, want.withColumn("event_date", F.to_date("ts")).collect()))
    assert got[0] == got[1] == got[2]


def test_ingest_batch_that_runs_again_changes_nothing(spark):
    """A second query without the first one's progress sees every file as new."""
    base = fresh_dir(spark, "test-again")
    ev, null_ids, stream = _conflicting(spark, base, 3)
    streams.ingest_once(stream, f"{base}/sink", f"{base}/ckpt")
    before = sorted(map(str, streams.read_ingested(spark, f"{base}/sink").collect()))
    streams.ingest_once(stream, f"{base}/sink", f"{base}/other")
    assert sorted(map(str, streams.read_ingested(spark, f"{base}/sink").collect())) == before


def test_ingest_without_files(spark):
    assert streams.read_ingested(spark, fresh_dir(spark, "test-none")).count() == 0


def test_late_rows_are_accounted_for(spark):
    """Files in no order: emitted, held and dropped rows are the input."""
    base = fresh_dir(spark, "test-late-counts")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    cut = {0: "day(ts) between 12 and 20", 1: "day(ts) > 20", 2: "day(ts) < 12", 3: "day(ts) = 5"}
    for k in range(4):  # the last two files are behind the watermark of the first two
        ev.where(cut[k]).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = streams.read_event_stream(spark, f"{base}/in", max_files_per_trigger=1)
    q = streams.run_available(streams.stream_kpis(stream), f"{base}/sink", f"{base}/ckpt")
    went = streams.event_balance(q, spark.read.parquet(f"{base}/sink"), f"{base}/ckpt")
    n = {k: ev.where(c).count() for k, c in cut.items()}
    assert went["rows"] == sum(n.values()) == went["emitted"] + went["held"] + went["dropped"]
    assert went["held"] > 0 and went["late_groups"] > 0
    # The third file is held against the watermark of the first one, the fourth against that of the second.
    first = ev.where(cut[0]).agg(F.max("ts")).first()[0]
    late = ev.where(cut[2]).where(F.date_trunc("day", "ts") + F.expr("INTERVAL 25 HOURS") <= F.lit(first).cast("timestamp_ntz")).count()
    assert went["dropped"] == late + n[3]


def test_scores_of_a_stream_equal_the_batch(spark):
    """Three micro-batches, a restart with more files, and a batch that runs again."""
    from slaframe.operators import model as M
    from slaframe.sources import files
    from slaframe.sources.tickets import tickets

    base = fresh_dir(spark, "test-score")
    t = tickets(spark, SF_SMALL).checkpoint()
    fitted = M.train_gbt(M.features(t), max_iter=3)
    files.save_model(fitted, f"{base}/model")
    stream = lambda: spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    t.where("ticket_id % 2 = 0").repartition(3).write.parquet(f"{base}/in")
    q = streams.score_stream(stream(), f"{base}/model", f"{base}/sink", f"{base}/ckpt")
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    t.where("ticket_id % 2 = 1").repartition(2).write.mode("append").parquet(f"{base}/in")
    streams.score_stream(stream(), f"{base}/model", f"{base}/sink", f"{base}/ckpt")

    def rows(df, risk, priority):
        return sorted(map(tuple, df.select("ticket_id", risk, priority).collect()))

    scored = M.score(fitted, t.drop("priority_score"))
    batch = scored.withColumn("p", streams.priority_formula("pred_sla_breach_prob", "severity", "vulnerable_population", "citizen_sentiment",
                                                            "festival_season", (0.50, 0.20, 0.15, 0.10, 0.05)))
    want = rows(batch, "pred_sla_breach_prob", "p")
    assert rows(spark.read.parquet(f"{base}/sink"), "stream_risk", "stream_priority") == want
    # Without its progress the stream numbers its batches from 0 again: they replace themselves.
    streams.score_stream(stream(), f"{base}/model", f"{base}/sink", f"{base}/other")
    assert rows(spark.read.parquet(f"{base}/sink"), "stream_risk", "stream_priority") == want


def test_missing_table_raises(spark):
    import pytest

    with pytest.raises(FileNotFoundError):
        streams.read_event_stream(spark, "/tmp/no-such-table.parquet")
