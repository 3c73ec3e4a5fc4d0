from datetime import datetime, timedelta

from pyspark.sql import functions as F

from windrill.plans.compiler import Query
from windrill.streaming import live

T0 = datetime(2030, 1, 1)
SCHEMA = "i long, t timestamp, v long, g long"


def source(spark, tmp_path, rows, files=2):
    for k in range(files):
        part = rows[len(rows) * k // files : len(rows) * (k + 1) // files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def data(n=60):
    return [(i, T0 + timedelta(seconds=i), i % 5, i % 2) for i in range(n)]


def drained(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_event_time_slice_and_slide_equal_batch(spark, tmp_path):
    rows = data() + [(99, T0 + timedelta(hours=1), 0, 0)]  # the last row moves the watermark on
    for k, window in enumerate(("slice 10 seconds based on t", "slide 20 seconds advance every 10 seconds based on t")):
        q = Query.parse(f"from s group by g window {window} aggregate count() as n, sum(v) as s, first(i) as f, last(i) as l, distinctcount(v) as d where n > 1 append n, s, f, l, d to o")
        stream = live.event_time(q.plan, source(spark, tmp_path / str(k), rows), order_by=["t", "i"])
        name = f"event_{k}"
        drained(stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start())
        want = q.run(spark.createDataFrame(rows, SCHEMA), order_by=["t", "i"], keep_window=True)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, want.collect()))


def test_processing_time_is_a_batch_per_interval(spark, tmp_path):
    q = Query.parse("from s window slice 1 seconds aggregate count() as n, first(i) as f append n, f to o")
    got = []
    drained(live.processing_time(q.plan, source(spark, tmp_path, data(10)), lambda df, k: got.extend(map(tuple, df.collect())), str(tmp_path / "c"), ["i"], available_now=True))
    assert sorted(got) == [(5, 0), (5, 5)]


def run_stateful(spark, tmp_path, q, rows):
    out = []
    members = live.stateful_rows(q.plan, source(spark, tmp_path, rows), ["i"])
    writer = members.writeStream.foreachBatch(lambda df, k: out.extend(map(tuple, live.aggregate_rows(q.plan, df, ["i"]).collect())))
    drained(writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    return sorted(out)


def test_row_batches_keep_state(spark, tmp_path):
    q = Query.parse("from s window slice 7 rows aggregate count() as n, first(i) as f, last(i) as l append n, f, l to o")
    want = sorted(map(tuple, q.run(spark.createDataFrame(data(), SCHEMA), order_by=["i"]).collect()))
    assert run_stateful(spark, tmp_path, q, data()) == want


def test_sessions_keep_state(spark, tmp_path):
    q = Query.parse("from s group by g window session begin when v == 1 end when v == 3 inclusive aggregate count() as n, first(i) as f, last(i) as l append n, f, l to o")
    want = sorted(map(tuple, q.run(spark.createDataFrame(data(), SCHEMA), order_by=["i"]).collect()))
    assert run_stateful(spark, tmp_path, q, data()) == want and want


def test_reasons_and_groups_on_streams(spark, tmp_path):
    """Closing reasons, and the first row's group for a batch that runs across groups, as on bounded input."""
    batches = Query.parse("from s group by g where v != 2 window slice 4 rows aggregate count() as n, first(i) as f, reason() as why append n, f, why to o")
    sessions = Query.parse("from s group by g window session begin when v == 1 end when v == 3 inclusive aggregate count(*) as n, last(i) as l, reason() as why append n, l, why to o")
    expiring = Query.parse("from s group by g window session begin when v == 1 end when v == 3 inclusive expire after 3 seconds based on t aggregate count() as n, reason() as why append n, why to o")
    late = [(1000, T0 + timedelta(hours=1), 0, 0), (1001, T0 + timedelta(hours=1), 0, 1)]
    for k, (q, rows) in enumerate(((batches, data()), (sessions, data()), (expiring, data() + late))):
        want = sorted(map(tuple, q.run(spark.createDataFrame(rows, SCHEMA), order_by=["i"]).collect()))
        assert run_stateful(spark, tmp_path / str(k), q, rows) == want and want


def test_sessions_expire(spark, tmp_path):
    q = Query.parse("from s group by g window session begin when v == 1 end when v == 9 inclusive expire after 12 seconds based on t aggregate count() as n, first(i) as f, last(i) as l append n, f, l to o")
    rows = data() + [(1000, T0 + timedelta(hours=1), 0, 0), (1001, T0 + timedelta(hours=1), 0, 1)]
    want = sorted(map(tuple, q.run(spark.createDataFrame(rows, SCHEMA), order_by=["i"]).collect()))
    assert run_stateful(spark, tmp_path, q, rows) == want and want


def test_sinks_of_a_stream(spark, tmp_path):
    df = source(spark, tmp_path, data(10)).select("i", F.col("v").alias("x"))
    drained(df.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10
