import io
import json

from windrill.__main__ import main

QUERY = "from i.d.s.t group by g window slice 10 rows based on r aggregate count() as n, sum(r) as s append s, n to out"
CATALOG = {"id": 0, "name": "i", "databases": [{"id": 0, "name": "d", "schemas": [{"id": 0, "name": "s", "tables": [{"id": 0, "name": "t", "fields": [{"name": "r", "type": "integer64", "usage": "sequence"}, {"name": "g", "type": "text", "usage": "group"}]}]}]}]}


def test_compile(monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", io.StringIO(QUERY))
    assert main(["compile"]) == 0
    assert json.loads(capsys.readouterr().out)["type"] == "egress"


def test_catalog_and_run(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps(CATALOG))
    (tmp_path / "q.txt").write_text(QUERY)
    (tmp_path / "in.csv").write_text("1|a\n2|a\n11|b\n")
    assert main(["catalog", str(tmp_path / "c.json"), "--templates", str(tmp_path)]) == 0
    assert (tmp_path / "i_d_s_t.csv").read_text() == "#|r|g\n#|integer64|text\n"
    capsys.readouterr()
    assert main(["run", str(tmp_path / "q.txt"), str(tmp_path / "in.csv"), "--catalog", str(tmp_path / "c.json")]) == 0
    assert sorted(capsys.readouterr().out.split()) == ["11|1|b", "3|2|a"]
    assert main(["run", str(tmp_path / "q.txt"), str(tmp_path / "in.csv"), "--catalog", str(tmp_path / "c.json"), "--explain"]) == 0
    assert "HashAggregate" in capsys.readouterr().out
