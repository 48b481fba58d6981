"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import align, decontaminate, exact_dedup, fuzzy_lines, licenses, materialise, mixing, simhash, spelling, tool_calls, toxicity, warc, winnowing
from tidemark.llm.common import read

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise.materialised(read(spark, sf_dir, "documents"))
    return rows.withColumn("sha256", F.sha2("payload", 256)).drop("payload")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# what the tools of the derived calls accept
_SCHEMAS = [
    ("search", '{"type":"object","required":["query","limit"],"additionalProperties":false,"properties":{"query":{"type":"string","minLength":1},"limit":{"type":"integer","minimum":1,"maximum":50}}}'),
    ("lookup", '{"type":"object","required":["key"],"properties":{"key":{"type":"integer","minimum":0},"fields":{"type":"array","items":{"type":"string","maxLength":12}}}}'),
    ("note", '{"type":"object","required":["body","share"],"properties":{"body":{"type":"string"},"share":{"type":"number","maximum":4},"kind":{"enum":["plain","rich"]}}}'),
]


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in the conversations: each assistant turn calls a tool with its text, the turn after it has the result.

    Every call needs the result of the assistant's turn before; each seventh turn names that of its own result's turn, which is no call.
    """
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    call = F.concat_ws("-", F.lit("call"), "conv_id", "turn")
    kind = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("note"), F.lit("sort")), (F.pmod(F.floor(F.col("turn") / 2), F.lit(4)) + 1).cast("int"))
    arguments = (
        F.when(kind == "search", F.to_json(F.struct(F.col("text").alias("query"), size.alias("limit"))))
        .when(kind == "lookup", F.to_json(F.struct(F.split("text", r"\s+").alias("fields"), F.col("conv_id").alias("key"))))
        .otherwise(F.to_json(F.struct((size / 16).alias("share"), F.col("text").alias("body"), F.lit("plain").alias("kind"))))
    )
    before = F.concat_ws("-", F.lit("call"), "conv_id", F.col("turn") - 2)
    odd = F.concat_ws("-", F.lit("call"), "conv_id", F.col("turn") + 1)
    calls = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("pos"), call.alias("call_id"), kind.alias("name"), arguments.alias("arguments"),
        F.when(F.pmod("turn", F.lit(7)) == 0, F.array(before, odd)).otherwise(F.array(before)).alias("needs"),
    )
    results = turns.where("role = 'user' and turn > 0").select(
        "conv_id", F.col("turn").alias("pos"), F.concat_ws("-", F.lit("call"), "conv_id", F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


@query
def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = derived_calls(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return tool_calls.formatted(calls, results, spark.createDataFrame(_SCHEMAS, "name string, schema string"))


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.edited_and_next(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnowing.digest(F.col("entries")).alias("fingerprint"),
        F.when(F.col("edited").isNotNull(), winnowing.digest(F.col("edited_entries"))).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query
def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.documents(read(spark, sf_dir, "documents"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
same AS (SELECT sha1(body) AS digest, strlen(body) AS size, max(page_id) AS largest FROM p WHERE strlen(body) >= 1000 GROUP BY 1, 2)
SELECT p.page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM p LEFT JOIN same ON digest = sha1(body) AND size = strlen(body)
"""


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"), {"text_sha256": exact_dedup.digest(F.col("text"))}).drop("settled")


ORACLES["op12_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)
"""


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.documents(read(spark, sf_dir, "documents"))
