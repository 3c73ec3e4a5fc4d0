"""The corpus pipeline: each stage's decision against brute force on a small corpus, and odd rows."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from windrill.llm.shared import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    clean = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(60)]
    rows = [(k, t) for k, t in enumerate(clean)]
    rows += [(100 + k, f"you idiot scum {clean[k]} idiot") for k in range(0, 40)]
    rows += [(200, clean[3]), (201, clean[3] + " more"), (202, "item " + " ".join(f"b{i}" for i in range(20)) + " tail"), (203, "mail joe.doe@mail.example.com now"), (204, None), (205, ""), (None, "no id"), (210, "twin"), (210, "twin")]
    labels = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 1) for k in range(40)]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array(["en"] * len(rows)), "source": pa.array(["s"] * len(rows)), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(table, d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), d / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": pa.array([" ".join(f"b{i}" for i in range(20))])}), d / "benchmark.parquet")
    return str(d)


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), "test")
        assert docs.columns == COLUMNS
        kept[name] = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect() if True and r.text is not None)
    ids = {k: [i for i, _ in v] for k, v in kept.items()}
    assert not set(range(100, 140)) & set(ids["toxicity"]) and set(range(60)) <= set(ids["toxicity"])
    assert not {200, 201} & set(ids["jaccard"]) and ids["jaccard"].count(210) == 1 and {3, 202, 203, -1} <= set(ids["jaccard"])
    assert set(ids["jaccard"]) - set(ids["decontamination"]) == {202}
    assert dict(kept["pii"])[203] == "mail [EMAIL] now"
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count() and last.where("not round_trip").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, last.collect()))


def test_rows_without_or_with_equal_ids(spark, folder):
    words = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    leak = "item " + words("b", 20) + " tail"
    rows = [(1, words("p")), (None, words("p") + " more"), (None, words("q")), (None, words("q")), (2, words("r")), (2, words("s")), (3, words("s") + " end"), (4, words("t")), (4, leak), (None, f"{leak} {words('y', 60)}"), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cut(corpus_pipeline.drop_similar(spark, docs, folder), "test")
    key = lambda r: (r[0] or -1, r[1] or "")
    want = [rows[k] for k in (0, 2, 4, 5, 7, 8, 9, 10, 11, 12)]
    assert kept.columns == COLUMNS and sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(want, key=key)
    clean = corpus_pipeline.drop_leaks(spark, kept, folder)
    assert clean.columns == COLUMNS and sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted([x for x in want if "b3 b4" not in (x[1] or "")], key=key)


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        t = pq.read_table(f"{folder}/{name}.parquet")
        pq.write_table(t.slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
