"""A corpus pipeline of five stages; each works on all that the one before kept.

1. Toxicity: documents scored at or above 0.5 go. 2. N-gram Jaccard join: of each group of linked documents the one with the
smallest doc_id (then row key) stays. 3. Benchmark decontamination: documents that hold a benchmark item go. 4. PII: personal data in the text is
replaced by its kind. 5. SentencePiece: the texts are encoded and, from the ids, decoded and compared.

Stages 2 and 3 decide by what a row holds: the row key of stage 2 is a 64-bit hash of doc_id and text, stage 3 goes by a hash of
the text. Rows without a doc_id are treated as all others and stay last in stage 2; rows that share a doc_id have no effect on
each other unless their texts are similar. A null text is scored as empty, is similar to nothing, holds no item and stays null
until it is encoded as empty; texts of any length are read whole. Ties: of equal rows one stays. Further columns pass through
the first four stages, whatever their names. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrill.llm import decontam, jaccard, pii, piece, toxicity
from windrill.llm.shared import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents outside the held-out fold; the decision is made on the text where it lies."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, toxicity.not_held_out()))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until docs has no such column."""
    out = []
    for name in names:
        while name in docs.columns:
            name = f"_{name}"
        out.append(name)
    return out


#: rows of one number each that a join may send to every task; more are joined by shuffling
BROADCAST_ROWS = 1_000_000


def _sent(table: DataFrame) -> DataFrame:
    """A written table of one number a row, marked for broadcast if it is within BROADCAST_ROWS, so that texts needn't move."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group, the one with the smallest doc_id; rows that are equal in doc_id and text count as one."""
    row, group, place = _free(docs, "_row", "_group", "_place")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = jaccard.jaccard_join(keyed.select(F.col(row).alias("doc_id"), "text"))
    linked = found.where("n_similar > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias(group)).distinct()
    near = cut(keyed.select(row, "doc_id").join(linked, row), "pipeline-similar")
    first = near.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("m")).select(F.col("m")[row].alias(row))
    gone = _sent(cut(near.select(row).distinct().join(first, row, "left_anti"), "pipeline-gone"))
    kept = keyed.join(gone, row, "left_anti")
    twice = cut(near.groupBy(row).count().where("count > 1").select(row).join(first, row, "left_semi"), "pipeline-twice")
    if twice.limit(1).count() == 0:
        return kept.select(*docs.columns)
    twice = _sent(twice)
    again = kept.join(twice, row, "left_semi").withColumn(place, F.row_number().over(W.partitionBy(row).orderBy(row)))
    return kept.join(twice, row, "left_anti").select(*docs.columns).unionByName(again.where(F.col(place) == 1).select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go; rows of one text go together."""
    (key,) = _free(docs, "_text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    text = F.xxhash64("text")
    found = cut(decontam.find_items(docs.select(text.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(key)).distinct(), "pipeline-leaks")
    return docs.withColumn(key, text).join(_sent(found), key, "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; n_chars follows the new text."""
    return pii.redact_table(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_similar),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("pieces", encode),
]

#: the toxicity model, the latent space and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
