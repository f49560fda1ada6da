"""The corpus pipeline: documents that are toxic go, one of each group of near duplicates stays, sources are mixed to
their target weights, and what is left is packed into sequences. STAGES are (name, function(spark, docs, sf_dir))."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, mixing, packing, queries, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled documents, doesn't call toxic. A null or empty text has no evidence against it; repeated rows are judged each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, toxicity.with_low_quality(labels))
    # As long as any column of docs, and one more letter: no name of docs can be equal.
    new = "_" * (1 + max(map(len, docs.columns)))
    return toxicity.score(docs, model, prefix=f"{new}p_", flag=f"{new}toxic").where(~F.col(f"{new}toxic")).select(*docs.columns)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows whose fingerprints are linked, one row: the smallest doc_id (any before null), then the smallest fingerprint and hash of the row."""
    # Two hashes of all columns name a row; rows that are equal throughout share them.
    values = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    h, g = common.unused(docs.columns, "_h"), common.unused(docs.columns, "_g")
    keyed = docs.withColumns({h: F.xxhash64(*values), g: F.xxhash64(F.lit(1), *values)})
    rows = simhash.fingerprints(keyed, keep=(h, g))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("fp").alias("f"), h, g)).alias("first")
    nodes = common.materialize(rows.groupBy("fp").agg(first), "nodes")
    kept = common.materialize(simhash.grouped(nodes).groupBy("component").agg(F.min("first").alias("first")).select(f"first.{h}", f"first.{g}"), "kept")
    # Texts are shuffled once, by the hashes, at every size; equal rows then meet without another shuffle.
    return keyed.join(kept.hint("merge"), [h, g], "left_semi").dropDuplicates([h, g]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. A null text counts no words and stays once, as an empty one does; null sources are one source; ties are settled by a hash of the id; repeated rows are
    documents each; other columns go along, whatever their names."""
    other = [c for c in docs.columns if c not in ("doc_id", "source")]
    out = mixing.mix(docs.withColumns({f"_{c}": F.col(c) for c in other}), keep=tuple(f"_{c}" for c in other))
    # Columns of docs begin with an underscore here, the mix's own ones don't.
    out = out.where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col("id" if c == "doc_id" else "source" if c == "source" else f"_{c}").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences. A null text is empty: one piece, the end id alone. Null and repeated ids are documents of their own, ties in length are
    placed by the order of the scan, other columns are not read."""
    return packing.pack(docs, queries.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", one_per_group), ("mixing", mix_sources), ("best-fit packing", pack)]

#: The stages are a trained classifier, an iterated graph, a numerical optimum and a tokenizer: no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet and read again. Empty tables give an empty result; nulls, ties and repeated rows are as each stage has them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
