import glob
import random
import shutil
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from paperloom.operators.cache import latency_ewma, upsert_latest
from paperloom.operators.metrics import daily_usage
from paperloom.plans.fixtures import audit_rows, change_rows, describe
from paperloom.streaming import jobs


def split_log(tables, folder):
    """The event log as four files in time order, one per batch."""
    events = tables.read("events")
    step = events.count() // 4
    for part in range(4):
        piece = events.where(F.floor(F.col("event_id") / step).cast("int") == part) if part < 3 else events.where(F.col("event_id") >= 3 * step)
        path = f"{folder}/part{part}"
        piece.coalesce(1).write.parquet(path)
        for file in glob.glob(f"{path}/*.parquet"):
            shutil.copy(file, f"{folder}/events-{part}.parquet")


def test_streams_equal_their_batch_forms(spark, tables, tmp_path):
    def stream():
        return audit_rows(jobs.read_table_stream(spark, str(tmp_path), "events", tables.read("events").schema, 1))

    split_log(tables, tmp_path)
    batch = tables.audit

    averages = {r["key"]: (r["n"], r["ewma_ms"]) for r in jobs.run_latency_ewma(stream(), "action").collect()}
    counts = {r["action"]: r["count"] for r in batch.groupBy("action").count().collect()}
    expected = latency_ewma(batch, ["action"], ["timestamp", "event_id"], "latency_ms").collect()
    assert averages == {r["action"]: (counts[r["action"]], r["ewma_ms"]) for r in expected}

    log = jobs.cache_change_log(change_rows(stream()))
    assert log.select("batch").distinct().count() == 4
    columns = ["key", "value", "written_at", "seq"]
    wanted = upsert_latest(change_rows(batch), ["key"], ["written_at", "seq"]).select(columns).collect()
    assert sorted(jobs.current_cache(log).select(columns).collect()) == sorted(wanted)

    totals = jobs.run_user_totals(stream()).select("user_id", "actions").collect()
    assert sorted(totals) == sorted(batch.groupBy("user_id").count().collect())


def test_no_document_is_lost_for_its_date_or_a_restart(spark, tables, tmp_path):
    docs = describe(tables.documents).select("doc_id", "file_path", "checksum", "size_bytes", "creation_date")
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    ranked = docs.orderBy(F.desc("creation_date")).toPandas()
    step = len(ranked) // 4
    for at in range(4):  # newest first
        piece = spark.createDataFrame(ranked.iloc[at * step : (at + 1) * step if at < 3 else None], docs.schema)
        piece.coalesce(1).write.parquet(f"{tmp_path}/p{at}")
        shutil.copy(glob.glob(f"{tmp_path}/p{at}/*.parquet")[0], f"{folder}/documents-{at}.parquet")
        if at == 1:  # stop here and go on later, with a repeated file among the new ones
            stream = jobs.read_table_stream(spark, str(folder), "documents", docs.schema, 1)
            assert jobs.run_ingest(stream, path=state).count() == 2 * step
    shutil.copy(f"{folder}/documents-0.parquet", f"{folder}/documents-9.parquet")
    stream = jobs.read_table_stream(spark, str(folder), "documents", docs.schema, 1)
    found = jobs.run_ingest(stream, path=state).select(docs.columns)
    assert sorted(found.collect()) == sorted(docs.collect())


def test_usage_has_every_day_and_averages_any_order(spark, tables, tmp_path):
    split_log(tables, tmp_path)
    for part in (0, 3):  # the last quarter arrives first
        shutil.move(f"{tmp_path}/events-{part}.parquet", f"{tmp_path}/events_{3 - part}.parquet")

    def stream():
        return audit_rows(jobs.read_table_stream(spark, str(tmp_path), "events", tables.read("events").schema, 1))

    assert sorted(jobs.run_daily_usage(stream()).collect()) == sorted(daily_usage(tables.audit).collect())
    averages = {r["key"]: r["ewma_ms"] for r in jobs.run_latency_ewma(stream(), "action").collect()}
    expected = latency_ewma(tables.audit, ["action"], ["timestamp", "event_id"], "latency_ms").collect()
    assert averages == {r["action"]: r["ewma_ms"] for r in expected}


def test_averages_from_bounded_state_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=i), i, rng.choice([1.0, 250.5, 1e300, None])) for i in range(4000)]
    rows += [("b", start + timedelta(seconds=i // 3), i, float(i)) for i in range(4000, 4300)] + [("c", start, 1, float("inf"))]
    rows += [("c", start + timedelta(seconds=i), i, 1.0) for i in range(5000, 6500)] + [(None, start, 9000, 3.0)]
    kind = "action string, timestamp timestamp_ntz, event_id bigint, latency_ms double"
    whole = spark.createDataFrame(rows, kind)
    rng.shuffle(rows)
    for part in range(5):
        spark.createDataFrame(rows[part::5], kind).coalesce(1).write.parquet(f"{tmp_path}/p{part}")
        shutil.copy(glob.glob(f"{tmp_path}/p{part}/*.parquet")[0], f"{tmp_path}/log-{part}.parquet")
    stream = jobs.read_table_stream(spark, str(tmp_path), "log", whole.schema, 1)
    path = f"{tmp_path}/state"
    got = {r["key"]: (r["n"], r["ewma_ms"]) for r in jobs.run_latency_ewma(stream, "action", path=path, parts=1).collect()}
    counts = {r["action"]: r["count"] for r in whole.groupBy("action").count().collect()}
    expected = latency_ewma(whole, ["action"], ["timestamp", "event_id"], "latency_ms").collect()
    assert got == {r["action"]: (counts[r["action"]], r["ewma_ms"]) for r in expected}
    updates = spark.read.parquet(f"{path}/rows")
    assert updates.agg(F.max(F.size("at"))).head()[0] == jobs.KEEP


def test_a_batch_of_ingest_touches_its_own_ids_only(spark, tmp_path):
    kind = "doc_id bigint, file_path string, checksum string, size_bytes bigint, creation_date timestamp_ntz"
    for part in range(6):
        rows = [(i, f"f{i}", f"c{part}", part, datetime(2024, 1, 1)) for i in range(part * 50, part * 50 + 60)]  # ten ids come again
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/p{part}")
        shutil.copy(glob.glob(f"{tmp_path}/p{part}/*.parquet")[0], f"{tmp_path}/documents-{part}.parquet")
    stream = jobs.read_table_stream(spark, str(tmp_path), "documents", spark.createDataFrame([], kind).schema, 1)
    touched = []

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event): ...

        def onQueryProgress(self, event):
            touched.extend(s.numRowsUpdated for s in event.progress.stateOperators if event.progress.numInputRows)

        def onQueryIdle(self, event): ...

        def onQueryTerminated(self, event): ...

    listener = Listener()
    spark.streams.addListener(listener)
    found = jobs.run_ingest(stream, path=f"{tmp_path}/state").collect()
    time.sleep(2)
    spark.streams.removeListener(listener)
    assert sorted(r["doc_id"] for r in found) == list(range(310))
    assert all(r["checksum"] == f"c{max(0, (r['doc_id'] - 10) // 50) if r['doc_id'] % 50 < 10 else r['doc_id'] // 50}" for r in found)
    assert touched == [60] * 6


def test_cache_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    kind = "key string, value string, written_at timestamp_ntz, seq bigint"
    (tmp_path / "in").mkdir()
    start, log = datetime(2024, 1, 1), []

    def land(part, keys, late=0):
        rows = [(k, f"v{part}-{i}", start + timedelta(minutes=part - late), part * 1000 + i) for i, k in enumerate(keys)]
        log.extend(rows)
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/parts/p{part}")
        shutil.copy(glob.glob(f"{tmp_path}/parts/p{part}/*.parquet")[0], f"{tmp_path}/in/changes-{part}.parquet")

    def run():
        stream = jobs.read_table_stream(spark, f"{tmp_path}/in", "changes", spark.createDataFrame([], kind).schema, 1)
        return sorted(tuple(r) for r in jobs.run_cache_upserts(stream, path=f"{tmp_path}/state", buckets=16).collect())

    def wanted():
        newest = {}
        for row in sorted(log, key=lambda r: (r[2], r[3])):
            newest[row[0]] = row
        return sorted(newest.values())

    land(0, [f"k{i}" for i in range(300)] + ["k7"])
    assert run() == wanted()
    land(1, ["k7", "new", "k7"])
    land(2, ["k8", "k9"], late=5)  # older than what is held: nothing changes
    assert run() == wanted()
    written = [len(glob.glob(f"{tmp_path}/state/rows/batch={n}/bucket=*")) for n in range(3)]
    assert written[0] == 16 and written[1] <= 2 and written[2] <= 2


def test_a_table_that_is_a_folder_of_files_is_streamed_whole(spark, tables, tmp_path):
    docs = tables.read("documents")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copytree(f"{tmp_path}/documents.parquet", f"{tmp_path}/others.parquet")
    stream = jobs.read_table_stream(spark, str(tmp_path), "documents", docs.schema, 2)
    rows = jobs.run_ingest(describe(stream).select("doc_id", "file_path", "checksum", "size_bytes", "creation_date"))
    assert rows.count() == docs.count()
