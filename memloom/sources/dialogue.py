"""Dialogue documents to turn and question tables, and back to nested form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.sources.json_arrays import read_json_array

SESSION_TURNS = "array<struct<dia_id:string,speaker:string,text:string>>"
SESSION_SCHEMA = (
    "sample_id string, conversation map<string,string>, "
    "qa array<struct<question:string,answer:string,category:string,evidence:array<string>>>, observation map<string,string>"
)
HAYSTACK_SCHEMA = (
    "question_id string, question_type string, question string, answer string, question_date string, "
    "haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)


def read_session_documents(spark: SparkSession, path: str) -> DataFrame:
    """Conversation documents with ``session_N`` keys; session bodies stay JSON text until parsed."""
    return read_json_array(spark, path, SESSION_SCHEMA)


def read_haystack_documents(spark: SparkSession, path: str) -> DataFrame:
    """Instances with ``instance_no``, their place in the file."""
    return read_json_array(spark, path, HAYSTACK_SCHEMA, "instance_no")


def convert_json_array(spark: SparkSession, path: str, target: str, schema: str) -> DataFrame:
    """Read top-level JSON arrays once and keep them as Parquet; the table of the new files."""
    read_json_array(spark, path, schema).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def session_turns(documents: DataFrame) -> DataFrame:
    """Turns in session order; a missing id becomes ``D{session}:{running turn number}``."""
    names = F.filter(F.map_keys("conversation"), lambda key: key.rlike("^session_[1-9][0-9]*$"))
    keyed = F.array_sort(F.transform(names, lambda key: F.substring(key, 9, 10).cast("int")))
    bodies = F.transform(keyed, lambda n: F.struct(n.alias("n"), F.element_at("conversation", F.concat(F.lit("session_"), n.cast("string"))).alias("body"),
                                                   F.try_element_at("conversation", F.concat(F.lit("session_"), n.cast("string"), F.lit("_date_time"))).alias("ts")))
    sessions = documents.select(F.col("sample_id").alias("conv_id"), F.posexplode(bodies).alias("s", "e")).select(
        "conv_id", "s", F.col("e.n").alias("n"), F.col("e.ts").alias("ts"), F.from_json("e.body", SESSION_TURNS).alias("turns"))
    rows = sessions.select("conv_id", "s", "n", "ts", F.posexplode("turns").alias("i", "t"))
    sizes = sessions.select("conv_id", "s", F.size("turns").alias("size"))
    # one row per session of a conversation: the running offset is a sum over a short window
    before = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv_id", "s", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    placed = rows.join(offsets, ["conv_id", "s"]).withColumn("pos", F.col("offset") + F.col("i"))
    fallback = F.concat(F.lit("D"), F.col("n").cast("string"), F.lit(":"), (F.col("pos") + 1).cast("string"))
    return placed.select(
        "conv_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce(F.nullif("t.dia_id", F.lit("")), fallback).alias("turn_id"), F.coalesce("t.speaker", F.lit("")).alias("speaker"),
        F.coalesce("t.text", F.lit("")).alias("text"), "ts", F.concat(F.lit("session_"), F.col("n").cast("string")).alias("session_id"))


def session_questions(documents: DataFrame) -> DataFrame:
    q = documents.select(F.col("sample_id").alias("conv_id"), F.posexplode("qa").alias("i", "q"))
    number = F.lpad((F.col("i") + 1).cast("string"), 4, "0")
    return q.select("conv_id", F.concat("conv_id", F.lit(":q"), number).alias("question_id"), "q.question", "q.answer", "q.category", F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence"))


def _haystack(documents: DataFrame) -> DataFrame:
    """Instances with their conversation id; unequal parallel arrays are an error."""
    same = (F.size("haystack_session_ids") == F.size("haystack_dates")) & (F.size("haystack_dates") == F.size("haystack_sessions"))
    conv = F.concat(F.lit("lme_"), F.lpad((F.col("instance_no") + 1).cast("string"), 4, "0"), F.lit("_"), tx.safe_id("question_id"))
    checked = F.when(same, conv).otherwise(F.raise_error(F.concat(F.lit("mismatched haystack lengths for "), F.col("question_id"))).cast("string"))
    return documents.withColumn("conv_id", checked)


def haystack_turns(documents: DataFrame) -> DataFrame:
    """Turns of parallel session arrays without blanks. ``documents`` carries ``instance_no`` (0-based)."""
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    sessions = _haystack(documents).select("conv_id", F.posexplode(zipped).alias("s", "z")).select(
        "conv_id", "s", F.col("z.haystack_session_ids").alias("session_id"), F.col("z.haystack_dates").alias("ts"), F.posexplode("z.haystack_sessions").alias("t", "turn"))
    pad = lambda c: F.lpad(c.cast("string"), 3, "0")
    return sessions.filter(F.trim(F.coalesce("turn.content", F.lit(""))) != "").select(
        "conv_id", F.concat(F.lit("s"), pad(F.col("s")), F.lit(":"), "session_id", F.lit(":t"), pad(F.col("t"))).alias("turn_id"), F.coalesce(F.nullif("turn.role", F.lit("")), F.lit("unknown")).alias("speaker"),
        F.trim("turn.content").alias("text"), "ts", "session_id", F.coalesce("turn.has_answer", F.lit(False)).alias("is_gold"))


def haystack_questions(documents: DataFrame, turns: DataFrame) -> DataFrame:
    """One question per instance with its gold turns and abstention flag."""
    gold = turns.filter("is_gold").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn_id")).alias("gold_evidence"))
    return _haystack(documents).join(gold, "conv_id", "left").select(
        "conv_id", F.concat("conv_id", F.lit(":q0001")).alias("question_id"), F.coalesce("question_type", F.lit("unknown")).alias("question_type"), "question", "answer", "question_date",
        F.coalesce("gold_evidence", F.array().cast("array<string>")).alias("gold_evidence"), F.col("question_id").endswith("_abs").alias("is_abstention"))


def nest_paths(candidates: DataFrame) -> DataFrame:
    """Candidate rows (capped per question) to one nested item per question."""
    fields = [c for c in candidates.columns if c not in ("question_id", "rank")]
    return candidates.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("paths"))


def flatten_paths(items: DataFrame) -> DataFrame:
    return items.select("question_id", F.inline("paths"))
