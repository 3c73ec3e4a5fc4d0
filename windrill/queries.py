"""One query per operator, each written in the clause language, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates
from .functions.sketches import cms_cells, cms_estimate, cms_total
from .operators import windows
from .plans.compiler import Query
from .sources import files
from .sources.catalog import Field, Table
from .sources.files import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: table -> (time field, sequence field)
TABLES = {"events": ("ts", "event_id"), "lineitem": ("l_shipdate", None), "orders": ("o_orderdate", "o_orderkey"), "conversations": (None, "turn")}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{table}.parquet", *TABLES[table])


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals: sums depend on the order of their terms."""
    return df.select(*[F.round(f"`{n}`", 6).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _add(name: str, text: str, sql: str | None, order: list[str] | None = None, keep: bool = False, **window) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = Query.parse(text, **window)
        return _rounded(q.run(load(spark, sf_dir, q.plan.source), order_by=order, keep_window=keep))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["slice_time_group"](spark, sf_dir)


def ingress_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


QUERIES["ingress_scan"] = ingress_scan
ORACLE_SQL["ingress_scan"] = "SELECT event_id, ts, user_id, event_type, value FROM events"

_EVENTS = Table("events", [Field("event_id", "integer64", "sequence"), Field("ts", "timestamp", "time"), Field("user_id", "integer64", "group"), Field("event_type", "text", "group"), Field("value", "float64")])


def ingress_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text, written by the sink and read by the source with its declared types, through a window."""
    where = files.scratch(spark, "delimited")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts")
    files.write_delimited(load(spark, sf_dir, "events").select("event_id", stamp, "user_id", "event_type", "value"), where)
    q = Query.parse("from events group by event_type where value > 10.0 window slice 60 minutes based on ts aggregate count() as n, sum(value) as s, first(event_id) as f append n, s, f to out")
    return _rounded(q.run(files.read_delimited(spark, where, _EVENTS), order_by=["event_id"]))


def egress_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's result, written by the sink and read back."""
    where = files.scratch(spark, "egress")
    q = Query.parse("from events group by event_type window slice 60 minutes based on ts aggregate count() as n, max(value) as top append n, top to out")
    files.write_parquet(_rounded(q.run(load(spark, sf_dir, "events"))), where)
    return read_parquet(spark, where)


_HOUR = "date_trunc('hour', ts)"
_ORDER = ["ts", "event_id"]
_N = "CAST(count(*) AS BIGINT) AS n"

QUERIES |= {"ingress_delimited": ingress_delimited, "egress_parquet": egress_parquet}
ORACLE_SQL["ingress_delimited"] = f"SELECT {_N}, round(sum(value), 6) AS s, min(event_id) AS f, event_type FROM events WHERE value > 10 GROUP BY event_type, {_HOUR}"
ORACLE_SQL["egress_parquet"] = f"SELECT {_N}, round(max(value), 6) AS top, event_type FROM events GROUP BY event_type, {_HOUR}"

_add("filter_pre", 'from events where value > 50.0 and not (event_type == "error") or user_id % 7 == 3 window slice 60 minutes based on ts aggregate count() as n, sum(value) as total append n, total to out',
     f"SELECT {_N}, round(sum(value), 6) AS total FROM events WHERE value > 50 AND NOT (event_type = 'error') OR user_id % 7 = 3 GROUP BY {_HOUR}")
_add("filter_having", "from events group by event_type window slice 60 minutes based on ts aggregate count(value) as n, avg(value) as mean_value where n >= 3 append n, mean_value to out",
     f"SELECT {_N}, round(avg(value), 6) AS mean_value, event_type FROM events GROUP BY event_type, {_HOUR} HAVING count(*) >= 3")
_add("filter_project", "from events window slice 60 minutes based on ts aggregate count() as n, max(value) as top append top, n where top > 90.0 to out",
     f"SELECT round(max(value), 6) AS top, {_N} FROM events GROUP BY {_HOUR} HAVING max(value) > 90")
_add("slice_time", "from events window slice 10 minutes based on ts aggregate avg(value) as a, sum(value) as s, count() as n, first(event_id) as f, last(event_id) as l append a, s, n, f, l to out",
     f"SELECT round(avg(value), 6) AS a, round(sum(value), 6) AS s, {_N}, arg_min(event_id, (ts, event_id)) AS f, arg_max(event_id, (ts, event_id)) AS l FROM events GROUP BY epoch_us(ts) // 600000000", _ORDER)
_add("slice_time_group", "from events group by event_type where value > 0.0 window slice 60 minutes based on ts aggregate count() as n, avg(value) as a, first(value) as f, last(value) as l append n, a, f, l where n > 0 to out",
     f"SELECT {_N}, round(avg(value), 6) AS a, round(arg_min(value, (ts, event_id)), 6) AS f, round(arg_max(value, (ts, event_id)), 6) AS l, event_type FROM events WHERE value > 0 GROUP BY event_type, {_HOUR}", _ORDER)
_add("slice_time_unaligned", "from events window slice 7 minutes based on ts aggregate count() as n, min(event_id) as f append n, f to out",
     f"SELECT {_N}, min(event_id) AS f FROM events GROUP BY (epoch_us(ts) + 62135596800000000) // 420000000")
_add("slice_time_milliseconds", "from events window slice 90500 milliseconds based on ts aggregate count() as n, min(event_id) as f append n, f to out",
     f"SELECT {_N}, min(event_id) AS f FROM events GROUP BY (epoch_us(ts) + 62135596800000000) // 90500000")
_DAY = "((epoch_us(l_shipdate) + 62135596800000000) // 86400000000)"
_add("slice_time_right", "from lineitem window slice 1440 minutes based on l_shipdate aggregate count() as n, sum(l_quantity) as q append n, q to out",
     f"SELECT {_N}, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY (epoch_us(l_shipdate) + 62135596800000000 - 1) // 86400000000", boundary="right")
_add("slice_time_sticky", "from lineitem window slice 1440 minutes based on l_shipdate aggregate count() as n, sum(l_quantity) as q append n, q to out",
     f"""WITH r AS (SELECT l_quantity, {_DAY} AS k, (epoch_us(l_shipdate) + 62135596800000000) % 86400000000 = 0 AS edge FROM lineitem),
b AS (SELECT k, bool_or(NOT edge) AS interior FROM r GROUP BY k),
m AS (SELECT k, CASE WHEN interior OR coalesce(lag(k) OVER (ORDER BY k), k - 2) <> k - 1 THEN k END AS anchor FROM b),
a AS (SELECT k, max(anchor) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS anchor FROM m),
t AS (SELECT k + 1 AS k FROM a WHERE (k - anchor) % 2 = 0)
SELECT {_N}, round(sum(l_quantity), 6) AS q FROM r LEFT JOIN t ON r.k = t.k GROUP BY CASE WHEN edge AND t.k IS NOT NULL THEN r.k - 1 ELSE r.k END""", boundary="sticky")  # fmt: skip
_add("slice_range", "from events window slice 20 rows based on event_id aggregate count() as n, min(event_id) as f, max(event_id) as l append n, f, l to out",
     f"SELECT {_N}, min(event_id) AS f, max(event_id) AS l FROM events GROUP BY floor((event_id - 1) / 20.0)")
_add("slice_range_left", "from events window slice 20 rows based on event_id aggregate count() as n, min(event_id) as f append n, f to out",
     f"SELECT {_N}, min(event_id) AS f FROM events GROUP BY floor(event_id / 20.0)", boundary="left")
_add("slice_range_sticky", "from orders window slice 20 rows based on o_orderkey aggregate count() as n, min(o_orderkey) as f append n, f to out",
     f"""WITH r AS (SELECT o_orderkey AS x, o_orderkey // 20 AS k, o_orderkey % 20 = 0 AS edge FROM orders),
b AS (SELECT k, bool_or(NOT edge) AS interior FROM r WHERE x > 0 GROUP BY k),
m AS (SELECT k, CASE WHEN interior OR coalesce(lag(k) OVER (ORDER BY k), k - 2) <> k - 1 THEN k END AS anchor FROM b),
a AS (SELECT k, max(anchor) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS anchor FROM m),
t AS (SELECT k + 1 AS k FROM a WHERE (k - anchor) % 2 = 0)
SELECT {_N}, min(x) AS f FROM r LEFT JOIN t ON r.k = t.k GROUP BY CASE WHEN x <= 0 THEN -1 WHEN edge AND t.k IS NOT NULL THEN r.k - 1 ELSE r.k END""", boundary="sticky")  # fmt: skip
_add("slice_range_group", "from events group by event_type, user_id window slice 1000 rows based on event_id aggregate count() as n, sum(value) as s append s, n to out",
     f"SELECT round(sum(value), 6) AS s, {_N}, event_type, user_id FROM events GROUP BY event_type, user_id, floor((event_id - 1) / 1000.0)")
_BATCH = "SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events WHERE value > 10"
_add("slice_rows", "from events where value > 10.0 window slice 25 rows aggregate count() as n, sum(value) as s, first(event_id) as f, last(event_id) as l append n, s, f, l to out",
     f"SELECT {_N}, round(sum(value), 6) AS s, arg_min(event_id, i) AS f, arg_max(event_id, i) AS l FROM ({_BATCH}) GROUP BY i // 25 HAVING count(*) = 25", _ORDER)
_add("slice_rows_group", "from events group by event_type where value > 10.0 window slice 25 rows aggregate count() as n append n to out",
     f"SELECT {_N}, arg_min(event_type, i) AS event_type FROM ({_BATCH}) GROUP BY i // 25 HAVING count(*) = 25", _ORDER)
_add("slice_rows_per_group", "from events group by user_id window slice 10 rows aggregate count() as n, last(event_id) as l, reason() as why append n, l, why to out",
     f"SELECT {_N}, max(event_id) AS l, CASE WHEN count(*) = 10 THEN 'rows' ELSE 'end' END AS why, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY user_id, i // 10", _ORDER, per_group=True, emit_incomplete=True)
_add("slide", "from events group by event_type window slide 60 minutes advance every 20 minutes based on ts aggregate count() as n, sum(value) as s append n, s to out",
     f"SELECT {_N}, round(sum(value), 6) AS s, event_type FROM (SELECT *, unnest(generate_series(0, 2)) AS j FROM events) GROUP BY event_type, epoch_us(ts) // 1200000000 - j")


def _session_sql(o: str, c: str, inclusive: bool, key: str | None, complete: bool = True) -> str:
    part = f"PARTITION BY {key} " if key else ""
    group = f", {key}" if key else ""
    return f"""WITH e AS (SELECT *, {o} AS o, {c} AS c FROM events),
a AS (SELECT *, last_value(CASE WHEN o THEN 1 WHEN c THEN 0 END IGNORE NULLS) OVER ({part}ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM e),
b AS (SELECT *, coalesce(lag(after) OVER ({part}ORDER BY ts, event_id), 0) = 1 AS opened FROM a),
s AS (SELECT *, o AND (NOT opened OR c) AS starts FROM b),
n AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER ({part}ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM s),
d AS (SELECT *, sid - CAST(starts AS INTEGER) AS earlier FROM n),
m AS (SELECT event_id, value, user_id, earlier AS w FROM d WHERE opened AND (NOT c OR {inclusive}) UNION ALL SELECT event_id, value, user_id, sid FROM d WHERE starts),
z AS (SELECT {key or "0"} AS kk, max(earlier) AS done FROM d WHERE opened AND c GROUP BY 1)
SELECT {_N}, round(sum(value), 6) AS s, min(event_id) AS f, max(event_id) AS l{group} FROM m JOIN z ON z.kk = {"m." + key if key else "0"} WHERE w <= done GROUP BY w{group}"""


_SESSION = "aggregate count() as n, sum(value) as s, first(event_id) as f, last(event_id) as l append n, s, f, l to out"
_add("session", f'from events window session begin when event_type == "signup" end when event_type == "error" inclusive {_SESSION}', _session_sql("event_type = 'signup'", "event_type = 'error'", True, None), _ORDER)
_add("session_group", f'from events group by user_id window session begin when event_type == "signup" end when event_type == "error" inclusive {_SESSION}', _session_sql("event_type = 'signup'", "event_type = 'error'", True, "user_id"), _ORDER)
_add("session_exclusive", f'from events group by user_id window session begin when event_type == "view" or value > 90.0 end when event_type == "purchase" or value > 95.0 exclusive {_SESSION}', _session_sql("(event_type = 'view' OR value > 90)", "(event_type = 'purchase' OR value > 95)", False, "user_id"), _ORDER)
_add("session_expire", 'from events group by user_id window session begin when event_type == "signup" end when event_type == "error" inclusive expire after 1440 minutes based on ts aggregate count() as n, first(event_id) as f, last(event_id) as l, reason() as why append n, f, l, why to out',
     """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'signup' AS o, event_type = 'error' AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS sid, false AS opened, CAST(0 AS BIGINT) AS since, CAST(NULL AS BIGINT) AS member, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS VARCHAR) AS why, false AS starts, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.i, CASE WHEN (NOT r.opened OR e.t - r.since > 86400000000 OR e.c) AND e.o THEN r.sid + 1 ELSE r.sid END,
 CASE WHEN r.opened AND e.t - r.since <= 86400000000 AND NOT e.c THEN true ELSE e.o END,
 CASE WHEN (NOT r.opened OR e.t - r.since > 86400000000 OR e.c) AND e.o THEN e.t ELSE r.since END,
 CASE WHEN r.opened AND e.t - r.since <= 86400000000 THEN r.sid END,
 CASE WHEN r.opened AND (e.t - r.since > 86400000000 OR e.c) THEN r.sid END,
 CASE WHEN r.opened AND e.t - r.since > 86400000000 THEN 'expire' WHEN r.opened AND e.c THEN 'close' END,
 (NOT r.opened OR e.t - r.since > 86400000000 OR e.c) AND e.o, e.event_id
 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
m AS (SELECT user_id, member AS w, event_id FROM r WHERE member IS NOT NULL UNION ALL SELECT user_id, sid, event_id FROM r WHERE starts),
d AS (SELECT user_id, ended AS w, why FROM r WHERE ended IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS n, min(event_id) AS f, max(event_id) AS l, min(why) AS why, user_id FROM m JOIN d USING (user_id, w) GROUP BY user_id, w""", _ORDER)  # fmt: skip


def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query.from_("events").group_by("user_id").gap("120 minutes", on="ts").aggregate(n="count()", s="sum(value)").append("n", "s")
    return _rounded(q.run(load(spark, sf_dir, "events")))


QUERIES["session_gap"] = session_gap
ORACLE_SQL["session_gap"] = f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
w AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS w FROM g)
SELECT {_N}, round(sum(value), 6) AS s, user_id FROM w GROUP BY user_id, w"""


def session_gap_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Query.from_("events").gap("10 minutes", on="ts").aggregate(n="count()", s="sum(value)").append("n", "s")
    return _rounded(q.run(load(spark, sf_dir, "events")))


QUERIES["session_gap_ungrouped"] = session_gap_ungrouped
ORACLE_SQL["session_gap_ungrouped"] = f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) < 600000000 THEN 0 ELSE 1 END AS fresh FROM events),
w AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS w FROM g)
SELECT {_N}, round(sum(value), 6) AS s FROM w GROUP BY w"""


def growing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = windows.growing(load(spark, sf_dir, "events"), {"n": F.count(F.lit(1)), "s": F.sum("value")}, _ORDER, ("user_id",))
    return _rounded(df.select("event_id", "n", "s"))


QUERIES["growing_window"] = growing_window
ORACLE_SQL["growing_window"] = "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"

for _name, _call, _sql in (
    ("agg_avg", "avg(value)", "round(avg(value), 6)"),
    ("agg_mean", "mean(user_id)", "round(avg(user_id), 6)"),
    ("agg_count", "count(value)", "CAST(count(*) AS BIGINT)"),
    ("agg_count_all", "count()", "CAST(count(*) AS BIGINT)"),
    ("agg_sum", "sum(user_id)", "CAST(sum(user_id) AS BIGINT)"),
    ("agg_first", "first(event_type)", "arg_min(event_type, (ts, event_id))"),
    ("agg_last", "last(event_type)", "arg_max(event_type, (ts, event_id))"),
    ("agg_min", "min(value)", "round(min(value), 6)"),
    ("agg_max", "max(value)", "round(max(value), 6)"),
    ("agg_distinct", "distinctcount(user_id)", "CAST(count(DISTINCT user_id) AS BIGINT)"),
    ("agg_group", "group(event_type)", "min(event_type)"),
    ("agg_reason", "reason()", "'interval'"),
):
    _add(_name, f"from events group by event_type window slice 360 minutes based on ts aggregate {_call} as x append x to out", f"SELECT {_sql} AS x, event_type FROM events GROUP BY event_type, epoch_us(ts) // 21600000000", _ORDER)

_add("agg_distinct_mixed", "from events window slice 360 minutes based on ts aggregate distinctcount(user_id) as d, count() as n, last(value) as l append d, n, l to out",
     f"SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS d, {_N}, round(arg_max(value, (ts, event_id)), 6) AS l FROM events GROUP BY epoch_us(ts) // 21600000000", _ORDER)

def agg_uniq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts from sketches, held against exact ones: within one in a hundred."""
    q = Query.parse("from events group by event_type window slice 14400 minutes based on ts aggregate uniq(user_id) as u, hll(value) as v, distinctcount(user_id) as d, distinctcount(value) as e append u, v, d, e to out")
    df = q.run(load(spark, sf_dir, "events"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 0.01 * F.col(b))
    return df.select("event_type", F.col("d").alias("users"), F.col("e").alias("vals"), near("u", "d").alias("users_near"), near("v", "e").alias("vals_near"))


QUERIES["agg_uniq"] = agg_uniq
_TEN_DAYS = "(epoch_us(ts) + 62135596800000000) // 864000000000"
ORACLE_SQL["agg_uniq"] = f"SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(DISTINCT value) AS BIGINT) AS vals, true AS users_near, true AS vals_near FROM events GROUP BY event_type, {_TEN_DAYS}"


def agg_cms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user occurs by a window's sketch: never less than exactly, and more by a thousandth of the window at most.

    The second holds with the confidence that the sketch was asked for, not for every user of every table. Sketches
    leave NULL out; how often it occurs is what their total lacks."""
    events = load(spark, sf_dir, "events")
    q = Query.parse("from events group by event_type window slice 14400 minutes based on ts aggregate cms(user_id) as sketch, count(*) as n append sketch, n to out")
    sketches = q.run(events, keep_window=True).withColumn("cells", cms_cells("sketch")).drop("sketch")  # one row a window and group
    exact = Query.parse("from events group by event_type, user_id window slice 14400 minutes based on ts aggregate count() as times append times to out").run(events, keep_window=True)
    keys = ("event_type", "window_start", "window_end")
    # merged, as sketches are far larger than Spark expects when it chooses what to broadcast
    renamed = sketches.withColumnsRenamed({k: f"of_{k}" for k in keys}).hint("merge")
    both = exact.join(renamed, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    both = both.withColumn("estimate", F.coalesce(cms_estimate("cells", "user_id"), F.col("n") - cms_total("cells")))
    return both.select("event_type", "user_id", "times", ((F.col("estimate") >= F.col("times")) & (F.col("estimate") <= F.col("times") + F.ceil(0.001 * F.col("n")))).alias("near"))


QUERIES["agg_cms"] = agg_cms
ORACLE_SQL["agg_cms"] = f"SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS times, true AS near FROM events GROUP BY event_type, user_id, {_TEN_DAYS}"


def agg_user_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate: the spread of a field, registered under a name."""
    aggregates.USER["spread"] = lambda c: F.max(c) - F.min(c)
    q = Query.parse("from events group by event_type window slice 360 minutes based on ts aggregate spread(value) as x append x to out")
    return _rounded(q.run(load(spark, sf_dir, "events")))


QUERIES["agg_user_defined"] = agg_user_defined
ORACLE_SQL["agg_user_defined"] = "SELECT round(max(value) - min(value), 6) AS x, event_type FROM events GROUP BY event_type, epoch_us(ts) // 21600000000"

_add("expr_arith", "from events where (user_id + 3) * 2 / 5 - 1 >= event_id % 40 and value * 2.0 - 1.5 > user_id / 2 window slice 60 minutes based on ts aggregate count() as n, sum(event_id) as s append n, s to out",
     f"SELECT {_N}, CAST(sum(event_id) AS BIGINT) AS s FROM events WHERE (user_id + 3) * 2 // 5 - 1 >= event_id % 40 AND value * 2.0 - 1.5 > user_id // 2 GROUP BY {_HOUR}")
_add("expr_true_false", 'from events where true and not (event_type == "view" and true) or false window slice 60 minutes based on ts aggregate count(*) as n append n where true to out',
     f"SELECT {_N} FROM events WHERE event_type <> 'view' GROUP BY {_HOUR}")
_add("expr_bool", 'from events where event_type == "view" or event_type == "click" and value < 20.0 or not (value <= 80.0 or user_id != 5) window slice 60 minutes based on ts aggregate count() as n append n to out',
     f"SELECT {_N} FROM events WHERE event_type = 'view' OR event_type = 'click' AND value < 20 OR NOT (value <= 80 OR user_id <> 5) GROUP BY {_HOUR}")
_add("expr_time", "from events where ts + 90 minutes > '2024-01-05T00:00:00Z' and ts - '2024-01-20T00:00:00Z' < 30 minutes window slice 60 minutes based on ts aggregate count() as n, first(event_id) as f, last(event_id) as l append n, f, l to out",
     f"SELECT {_N}, min(event_id) AS f, max(event_id) AS l FROM events WHERE ts + INTERVAL 90 MINUTE > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 00:30:00' GROUP BY {_HOUR}", _ORDER)
_add("expr_append", "from events window slice 60 minutes based on ts aggregate first(ts) as begin, last(ts) as end, count() as n append seconds(end - begin) as duration, n, n * 2 + 1 as odd to out",
     f"SELECT CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS duration, {_N}, CAST(count(*) * 2 + 1 AS BIGINT) AS odd FROM events GROUP BY {_HOUR}", _ORDER)
_add("lineitem_slice", "from lineitem group by l_returnflag, l_linestatus where l_discount >= 0.05 window slice 43200 minutes based on l_shipdate aggregate sum(l_quantity) as q, sum(l_extendedprice) as p, avg(l_discount) as d, count() as n append q, p, d, n to out",
     f"SELECT round(sum(l_quantity), 6) AS q, round(sum(l_extendedprice), 6) AS p, round(avg(l_discount), 6) AS d, {_N}, l_returnflag, l_linestatus FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag, l_linestatus, (epoch_us(l_shipdate) + 62135596800000000) // 2592000000000")
_add("orders_slice", "from orders group by o_orderpriority window slice 10080 minutes based on o_orderdate aggregate count() as n, max(o_totalprice) as top append n, top to out",
     f"SELECT {_N}, round(max(o_totalprice), 6) AS top, o_orderpriority FROM orders GROUP BY o_orderpriority, (epoch_us(o_orderdate) + 62135596800000000) // 604800000000")
_add("conversation_sessions", 'from conversations group by conv_id window session begin when role == "user" end when role == "assistant" inclusive aggregate count() as n, first(turn) as f, last(turn) as l append n, f, l to out',
     """WITH e AS (SELECT *, role = 'user' AS o, role = 'assistant' AS c FROM conversations),
a AS (SELECT *, last_value(CASE WHEN o THEN 1 WHEN c THEN 0 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM e),
b AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY conv_id ORDER BY turn, text), 0) = 1 AS opened FROM a),
n AS (SELECT *, sum(CAST(o AND (NOT opened OR c) AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS sid FROM b),
z AS (SELECT conv_id, max(sid) AS done FROM n WHERE opened AND c GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n, min(turn) AS f, max(turn) AS l, n.conv_id FROM n JOIN z USING (conv_id) WHERE (opened OR o) AND sid <= done GROUP BY n.conv_id, sid""", ["turn", "text"])  # fmt: skip

_SAMPLE = [(1, "17:00:01"), (2, "17:00:04"), (3, "17:00:11"), (4, "17:00:12"), (5, "17:00:17"), (6, "17:00:26"), (7, "17:00:40"), (8, "17:00:43"), (9, "17:00:49")]


def readme_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine rows with times as text: sums by ten seconds, with the window's length and the text of its last time."""
    rows = spark.createDataFrame([(x, f"2030-01-01T{t}-07:00") for x, t in _SAMPLE], "x long, t string").withColumn("t__time", F.to_timestamp("t"))
    df = rows.withMetadata("t", {"usage": "time", "time_column": "t__time"})
    q = Query.parse("from foo window slice 10 seconds based on t aggregate avg(x) as avg, sum(x) as total, count() as n, first(t) as begin, last(t) as end append avg, total, n, seconds(end - begin) as duration, end as close to bar")
    return q.run(df)


QUERIES["readme_example"] = readme_example
ORACLE_SQL["readme_example"] = """SELECT CAST(column0 AS DOUBLE) AS avg, CAST(column1 AS BIGINT) AS total, CAST(column2 AS BIGINT) AS n, CAST(column3 AS BIGINT) AS duration, column4 AS close FROM (VALUES
(1.5, 3, 2, 3, '2030-01-01T17:00:04-07:00'), (4, 12, 3, 6, '2030-01-01T17:00:17-07:00'), (6, 6, 1, 0, '2030-01-01T17:00:26-07:00'), (8, 24, 3, 9, '2030-01-01T17:00:49-07:00')) AS v(column0, column1, column2, column3, column4)"""
