import json

import pytest

from windrill.errors import AnalysisError
from windrill.plans.compiler import Query
from windrill.sources import files
from windrill.sources.catalog import Catalog

FIELDS = [("a", "integer64", "data"), ("b", "float64", "data"), ("c", "text", "data"), ("d", "boolean", "data"), ("t1", "timestamp", "time"), ("rowid", "integer64", "sequence"), ("g1", "integer64", "group")]
RAW = {"id": 0, "name": "i", "databases": [{"id": 1, "name": "d", "schemas": [{"id": 1, "name": "s", "tables": [{"id": 1, "name": "t", "fields": [{"id": k, "name": n, "type": t, "usage": u, "description": ""} for k, (n, t, u) in enumerate(FIELDS)]}]}]}]}
LINES = """# a|b|c|d|t1|rowid|g1
1|0.5|x|t|2030-01-01T17:00:01-07:00|1|7

2|1.5|"y|z"|FALSE|2030-01-01T17:00:04.123-07:00|2|7
3|2.5||1|2030-01-02T00:00:12Z|3|8
"""


def test_catalog(tmp_path):
    c = Catalog.from_json(RAW)
    assert [f.name for f in c.table("i.d.s.t").schema().fields] == [f[0] for f in FIELDS]
    assert c.table("i.d.s.t").schema()["t1"].metadata["usage"] == "time"
    again = Catalog.from_json(c.to_json())
    assert again.tables == c.tables and json.loads(again.to_json()) == json.loads(c.to_json())
    for bad in ("i.d.s", "i.d.s.nope"):
        with pytest.raises(AnalysisError):
            c.table(bad)
    (path,) = c.write_templates(tmp_path)
    assert path.name == "i_d_s_t.csv" and path.read_text().splitlines()[0] == "#|a|b|c|d|t1|rowid|g1"
    broken = json.loads(json.dumps(RAW))
    broken["databases"][0]["schemas"][0]["tables"][0]["fields"][0]["type"] = "integer16"
    with pytest.raises(AnalysisError):
        Catalog.from_json(broken)


def test_delimited_text(spark, tmp_path):
    table = Catalog.from_json(RAW).table("i.d.s.t")
    (tmp_path / "in.csv").write_text(LINES)
    df = files.read_delimited(spark, str(tmp_path / "in.csv"), table)
    rows = df.orderBy("a").collect()
    assert [(r.a, r.b, r.c, r.d, r.t1) for r in rows] == [(1, 0.5, "x", True, "2030-01-01T17:00:01-07:00"), (2, 1.5, "y|z", False, "2030-01-01T17:00:04.123-07:00"), (3, 2.5, "", True, "2030-01-02T00:00:12Z")]
    q = Query.parse("from i.d.s.t group by g1 where t1 < '2030-01-02T00:00:10Z' window slice 10 seconds based on t1 aggregate count() as n, last(t1) as l append n, l to o")
    out = q.run(df)
    assert sorted(map(tuple, out.collect())) == [(2, "2030-01-01T17:00:04.123-07:00", 7)]
    files.write_delimited(out, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "2|2030-01-01T17:00:04.123-07:00|7"
    files.write_parquet(out, str(tmp_path / "p"))
    assert files.read_parquet(spark, str(tmp_path / "p")).count() == 1


@pytest.mark.parametrize("line", ["x|0.5|x|t|2030-01-01T17:00:01Z|1|7", "1|0.5|x|maybe|2030-01-01T17:00:01Z|1|7", "1|0.5|x|t|yesterday|1|7", "1|0.5"])
def test_bad_rows_fail(spark, tmp_path, line):
    (tmp_path / "in.csv").write_text(line + "\n")
    with pytest.raises(Exception):
        files.read_delimited(spark, str(tmp_path / "in.csv"), Catalog.from_json(RAW).table("i.d.s.t")).collect()


def test_lines_of_a_message_source(spark):
    df = spark.createDataFrame([(x,) for x in LINES.splitlines()], "value string")
    assert sorted(r.a for r in files.parse_lines(df, Catalog.from_json(RAW).table("i.d.s.t")).collect()) == [1, 2, 3]
