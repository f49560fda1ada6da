"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Conversation -1, which both the query and its SQL add: a user's, then an assistant's row.
CONTROL = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import chat

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L conv_id, t.turn, t.role, '{CONTROL}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    done = chat.format_conversations(turns.unionByName(extra))
    read = done.withColumn("turns", chat.read_turns(F.col("formatted")))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    whole = read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), digest.alias("turns_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "spans", "formatted")
    keep = ("n_turns", "turns_sha256", "formatted_chars")
    examples = chat.expand(whole, keep).withColumn("turns_before", F.size(F.split("context", r"<\|im_start\|>", -1)) - 2)
    examples = examples.select("conv_id", *keep, "turn", (F.col("turns_before") == F.col("turn")).alias("whole"), chat.unescape(F.col("target")).alias("reply"))
    none = whole.where(F.size("spans") == 0).select("conv_id", *keep, F.lit(None).cast("int").alias("turn"), F.lit(None).cast("boolean").alias("whole"), F.lit(None).cast("string").alias("reply"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("turn", "reply")))), lambda x: x["reply"]), "")
    out = examples.unionByName(none).groupBy("conv_id", *keep).agg(joined.alias("loss"), F.count("turn").alias("n_examples"), F.coalesce(F.every("whole"), F.lit(True)).alias("contexts_whole"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples", "contexts_whole")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import flatgraph

    out = flatgraph.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "audit_recall", "audit_recall_linked")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import mtree

    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import urls

    return urls.judge(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import simhash

    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.with_low_quality(_table(spark, sf_dir, "labels")))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import mixing

    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import warc

    index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import packing

    out = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumnRenamed("id", "doc_id")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import license as scans

    out = scans.scan(_table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    every = F.concat(base, F.transform("spans", lambda s: s["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.col("best"))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(every).alias("labels"), score.alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_embeddings": op2_embeddings,
    "op3_topk": op3_topk,
    "op4_urls": op4_urls,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_mix": op7_mix,
    "op8_warc": op8_warc,
    "op9_pack": op9_pack,
    "op10_license": op10_license,
}

ORACLE: dict[str, str] = {
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    # SHA-1 in base32: the hex digits in eights of five (20 bits), each as four letters of 5 bits.
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
t AS (SELECT body, max(page_id) AS top FROM p GROUP BY body),
v AS (SELECT page_id, body, list_transform(range(0, 8), lambda i: list_sum(list_transform(range(1, 6), lambda j:
  (instr('0123456789abcdef', substr(hex, (i * 5 + j)::INT, 1)) - 1)::BIGINT << (4 * (5 - j))))::BIGINT) AS parts FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM v JOIN t USING (body)""",
    "op1_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  count(*) FILTER (role = 'assistant') AS n_examples,
  sum(24 + length(text) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'gs')) + length(role) + length(regexp_replace(role, '[^\\\\<\\[\\n]', '', 'gs'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, n_examples, TRUE AS contexts_whole FROM g""",
}
