"""Windows against plain-Python models of their meaning, on random rows."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrill.errors import AnalysisError
from windrill.functions.sketches import cms_cells, cms_counts, cms_estimate
from windrill.operators import windows
from windrill.plans.compiler import Query
from windrill.queries import QUERIES

T0 = datetime(2030, 1, 1, tzinfo=timezone.utc)


def rows_of(spark, values, groups=None):
    rows = [(i, T0 + timedelta(seconds=v), v, (groups or [0] * len(values))[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i long, t timestamp, v long, g long").withMetadata("i", {"usage": "sequence"})


def members(df, field="i"):
    return sorted(sorted(r.m) for r in df.groupBy("__w_id").agg(F.collect_list(field).alias("m")).collect())


def sticky_model(values, d, first=None):
    """The loop that the closed form stands for: a window stays open until a value passes its upper end."""
    out, hi = [], first
    for v in sorted(values):
        if hi is None or v > hi:
            hi = v // d * d + d
            out.append([])
        elif not out:
            out.append([])
        out[-1].append(v)
    return [w for w in out if w]


@pytest.mark.parametrize("seed", range(4))
def test_sticky_time_is_the_loop(spark, seed):
    r = random.Random(seed)
    d = r.choice([1, 2, 5])
    values = sorted(r.sample(range(0, 60), r.randint(5, 40)))
    got = members(windows.slice_time(rows_of(spark, values), "t", d * 1000, "sticky"), "v")
    assert got == sorted(sticky_model(values, d))


@pytest.mark.parametrize("seed", range(4))
def test_sticky_range_is_the_loop(spark, seed):
    r = random.Random(seed)
    n = r.choice([1, 2, 5])
    values = sorted(r.sample(range(-6, 40), 25))
    got = members(windows.slice_range(rows_of(spark, values), "v", n, "sticky"), "v")
    assert got == sorted(sticky_model(values, n, 0))


def test_boundaries(spark):
    df = rows_of(spark, [0, 1, 2, 3, 4, 5])
    assert len(members(windows.slice_time(df, "t", 1000))) == 6
    assert members(windows.slice_time(df, "t", 2000, "right"), "v") == [[0], [1, 2], [3, 4], [5]]
    assert members(windows.slice_time(df, "t", 1000, "sticky"), "v") == [[0, 1], [2, 3], [4, 5]]
    ids = rows_of(spark, list(range(41)))
    assert [len(m) for m in members(windows.slice_range(ids, "v", 20), "v")] == [1, 20, 20]
    assert [len(m) for m in members(windows.slice_range(ids, "v", 20, "left"), "v")] == [20, 20, 1]


def test_alignment_to_year_one(spark):
    df = spark.createDataFrame([("2030-01-01T17:00:01.5-07:00",)], "s string").withColumn("t", F.to_timestamp("s"))
    assert str(windows.slice_time(df, "t", 7000).first()["__w_start"]) == "2030-01-01 23:59:55" or windows.slice_time(df, "t", 7000).select(F.date_format("__w_start", "HH:mm:ss")).first()[0] == "23:59:55"


def test_row_batches(spark):
    df = rows_of(spark, list(range(7)))
    assert members(windows.slice_rows(df, 3, ["i"])) == [[0, 1, 2], [3, 4, 5]]
    assert members(windows.slice_rows(df, 3, ["i"], emit_incomplete=True)) == [[0, 1, 2], [3, 4, 5], [6]]
    assert windows.slice_rows(df.where("i < 0"), 3, ["i"]).count() == 0


def session_model(rows, inclusive, limit=None, mode="life"):
    """rows: (i, t, o, c) of one group in order -> [(members, reason)]."""
    out, cur, since = [], None, 0
    for i, t, o, c in rows:
        if cur is not None and limit is not None and t - since > limit:
            out.append((cur, "expire"))
            cur = None
        if cur is not None:
            if not c or inclusive:
                cur.append(i)
            if mode == "idle":
                since = t
            if c:
                out.append((cur, "close"))
                cur = None
        if cur is None and o:
            cur, since = [i], t
    return out


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("expire, mode", [(None, "life"), (3, "life"), (3, "idle")])
def test_sessions_are_the_automaton(spark, inclusive, expire, mode):
    r = random.Random(7)
    rows = [(i, T0 + timedelta(seconds=i + i // 7 * 2), r.randint(0, 3), r.randint(0, 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, t timestamp, v long, g long")
    o, c = F.col("v") >= 2, (F.col("v") == 3) | (F.col("v") == 0)
    if expire is None:
        got = windows.session(df, o, c, inclusive, ["i"], ("g",))
    else:
        got = windows.session_expire(df, o, c, inclusive, "t", expire * 1000, ["i"], ("g",), mode)
    got = sorted((tuple(sorted(x.m)), x.w) for x in got.groupBy("g", "__w_id").agg(F.collect_list("i").alias("m"), F.min("__w_reason").alias("w")).collect())
    want = []
    for g in range(4):
        own = [(i, (t - T0).total_seconds(), v >= 2, v in (0, 3)) for i, t, v, gg in rows if gg == g]
        want += [(tuple(m), w) for m, w in session_model(own, inclusive, expire, mode)]
    assert got == sorted(want)


def test_ungrouped_session_and_vector(spark):
    kinds = ["o", "m", "c", "m", "o", "oc", "m", "c"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "i long, k string")
    o, c = F.col("k").contains("o"), F.col("k").contains("c")
    assert members(windows.session(df, o, c, True, ["i"], ())) == [[0, 1, 2], [4, 5], [5, 6, 7]]
    assert members(windows.session(df, o, c, False, ["i"], ())) == [[0, 1], [4], [5, 6]]


def test_slide_and_gap(spark):
    df = rows_of(spark, [0, 5, 12, 40])
    got = members(windows.slide(df, "t", 10_000, 5_000), "v")
    assert got == sorted([[0], [0, 5], [5, 12], [12], [40], [40]])
    assert members(windows.session_gap(df, "t", 10_000, ()), "v") == [[0, 5, 12], [40]]


def test_groups_stay_apart_and_counts_are_exact(spark):
    df = spark.createDataFrame([(1, "23", 0), (12, "3", 0)], "a long, b string, v long")
    out = Query.parse("from t group by a, b window slice 10 rows based on v aggregate count() as n append n to u").run(df).collect()
    assert sorted(map(tuple, out)) == [(1, 1, "23"), (1, 12, "3")]
    many = spark.range(1_200_000).withColumn("k", F.lit(0).cast("long"))
    out = Query.parse("from t window slice 10 rows based on k aggregate count() as n, sum(id) as s append n, s to u").run(many).collect()
    assert tuple(out[0]) == (1_200_000, 1_200_000 * 1_199_999 // 2)


def test_integer_division_and_nulls(spark):
    df = spark.createDataFrame([(-7, 0, None), (5, 0, 2.0)], "x long, k long, y double")
    q = "from t where x / 2 == -3 and x % 2 == -1 or x == 5 window slice 10 rows based on k aggregate count(y) as n, avg(y) as a, sum(y) as s, first(y) as f append n, a, s, f to u"
    r = Query.parse(q).run(df, order_by=["x"]).first()
    assert tuple(r) == (2, 2.0, 2.0, None)


def test_analysis_errors(spark):
    df = rows_of(spark, [1, 2])
    for text in (
        "from t window slice 1 rows based on v aggregate sum(nope) as s append s to u", "from t window slice 1 rows based on v aggregate sum(v) as s append nope to u", "from t window slice 1 seconds aggregate sum(v) as s append s to u",
        "from t group by g window slice 1 rows based on v aggregate group(v) as s append s to u", "from t where v == \"x\" window slice 1 rows based on v aggregate count() as s append s to u", "from t window slice 1 rows based on t aggregate count() as s append s to u",
        "from t window slice 1 rows based on v aggregate sum(t) as s append s to u", "from t group by g window slice 1 rows based on v aggregate count() as g append g to u",
    ):
        with pytest.raises(AnalysisError):
            Query.parse(text).run(df)


def test_fluent_form_equals_text(spark):
    df = rows_of(spark, [1, 5, 12, 13], [0, 0, 1, 1])
    text = Query.parse("from t group by g where v > 1 window slice 10 seconds based on t aggregate count() as n, max(v) as m where n > 0 append m, n where m > 1 to u")
    fluent = Query.from_("t").group_by("g").where("v > 1").slice("10 seconds", on="t").aggregate(n="count()", m="max(v)").having("n > 0").append("m", "n").where("m > 1").to("u")
    assert text.plan == fluent.plan
    fluent.run(df)
    assert sorted(map(tuple, spark.table("u").collect())) == [(5, 1, 0), (13, 2, 1)]


def test_sketches_are_close(spark):
    df = spark.range(50_000).withColumn("x", F.col("id") % 20_000).withColumn("k", F.lit(1).cast("long"))
    r = Query.parse("from t window slice 10 rows based on k aggregate uniq(x) as u, distinctcount(x) as d, cms(x) as c append u, d, c to v").run(df).first()
    assert r.d == 20_000 and abs(r.u - r.d) < 0.01 * r.d
    counts = cms_counts(bytes(r.c), np.arange(20_000))
    assert (counts >= 2).all() and (counts >= 3)[:10_000].all() and (counts <= 3 + 50).all()


def test_sketch_estimates_as_columns_equal_the_bytes(spark):
    """The same estimate for every whole number, by columns alone: no sketch is given to Python once an item."""
    counted = [-(1 << 63), -5, -1, 0, 1, 1499, 1 << 31, (1 << 32) + 7, (1 << 63) - 1] * 3 + [7, None]
    df = spark.createDataFrame([(x, 1) for x in counted] + [(x * x * 104_729, 1) for x in range(9000)], "x long, k long")
    sketches = Query.parse("from t window slice 10 rows based on k aggregate cms(x) as c append c to v").run(df)
    r = random.Random(3)
    items = [*counted[:9], 7, *(r.randrange(-(1 << 63), 1 << 63) for _ in range(500)), *(x * x * 104_729 for x in range(1000))]
    asked = spark.createDataFrame([(x,) for x in items] + [(None,)], "x long")
    out = asked.crossJoin(sketches.select(cms_cells("c").alias("cells"))).select("x", cms_estimate("cells", "x").alias("n"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    want = cms_counts(bytes(sketches.first().c), np.array(items))
    assert want.min() >= 0 and len(set(want)) > 3
    assert sorted(map(tuple, out.where("x is not null").collect())) == sorted(zip(items, want.tolist()))
    assert [r.n for r in out.where("x is null").collect()] == [None]


def test_agg_cms_keeps_all_rows_without_python(spark, tmp_path):
    """As its SQL, also for events without a type or a user; the work for a row doesn't grow with the sketch."""
    r = random.Random(4)
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=10 * (i % 3)), r.choice([None, -3, 5, 6, 1 << 40]), r.choice([None, "view", "click"])) for i in range(900)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["agg_cms"](spark, str(tmp_path))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    want = Counter((t, u, i % 3) for i, _, u, t in rows)
    assert Counter(map(tuple, out.collect())) == Counter((t, u, n, True) for (t, u, _), n in want.items())


def test_uniq_is_within_one_percent(spark):
    df = spark.range(1_200_000).selectExpr("id % 6 as g", "id as x", "cast(1 as long) as k")
    for function in ("uniq", "hll"):
        rows = Query.parse(f"from t group by g window slice 10 rows based on k aggregate {function}(x) as u append u to v").run(df).collect()
        assert len(rows) == 6 and all(abs(r.u - 200_000) <= 0.01 * 200_000 for r in rows)


def test_ungrouped_sequences_run_in_parts(spark):
    """Sessions and gaps without groups equal the models on rows spread over range partitions, and no plan has one partition."""
    r = random.Random(6)
    times = sorted(r.sample(range(4000), 400))
    df = rows_of(spark, times).repartition(3)
    for inclusive in (True, False):
        q = Query.parse(f"from t window session begin when v % 6 == 1 or v % 35 == 0 end when v % 6 == 3 or v % 7 == 0 {'inclusive' if inclusive else 'exclusive'} aggregate count() as n, first(i) as f, last(i) as l append n, f, l to u")
        out = q.run(df, order_by=["t"])
        model = [m for m, why in session_model([(k, v, v % 6 == 1 or v % 35 == 0, v % 6 == 3 or v % 7 == 0) for k, v in enumerate(times)], inclusive) if why == "close"]
        assert sorted(map(tuple, out.collect())) == sorted((len(m), m[0], m[-1]) for m in model) and len(model) > 20
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    gaps = Query.from_("t").gap("20 seconds", on="t").aggregate(n="count()").append("n").run(df)
    want, last = [], None
    for t in times:
        if last is None or t - last >= 20:
            want.append(0)
        want[-1] += 1
        last = t
    assert sorted(x.n for x in gaps.collect()) == sorted(want)
    assert "SinglePartition" not in gaps._jdf.queryExecution().executedPlan().toString()


def test_expiring_sessions_run_python_once(spark):
    q = Query.parse("from t group by g window session begin when v == 1 end when v == 3 inclusive expire after 9 seconds based on t aggregate count() as n append n to u")
    plan = q.run(rows_of(spark, [1, 2], [0, 1]), order_by=["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_no_shuffle_of_rows_for_aggregates(spark):
    plan = Query.parse("from t group by g window slice 10 seconds based on t aggregate sum(v) as s append s to u").run(rows_of(spark, [1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Python" not in plan


def test_model_counts():
    groups = defaultdict(list)
    for k in range(5):
        groups[k % 2].append(k)
    assert session_model([(0, 0, True, False), (1, 1, False, True)], True) == [([0, 1], "close")]
