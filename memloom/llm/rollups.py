"""Token totals by source, language and tokenizer version, kept up to date by signed changes in batches that commit once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.shared import new_path, stored
from memloom.llm.tokens import VOCABULARY, document_encoder

WORD = "[^\\x20\\x09-\\x0D]+"
GROUP = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs long, tokens long"


class TokenRollups:
    """Totals in a folder that driver and executors share.

    A change says what happens to one document's count under one tokenizer version: ``change`` (its own id), ``kind``
    (insert, delete or revise), ``source, lang, version, tokens`` and, for a revision, ``old_tokens``; a document that moves to
    another source or language is deleted there and inserted here. A batch is summed to one signed row per group and written to
    a folder named by the batch; the marker that Spark writes last commits it. A batch that has its marker is not written
    again, one that failed half way is overwritten, so a batch counts once however often it is sent. Totals add up the
    committed folders and never read a document.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> list[str]:
        """Folders of the batches that are whole."""
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(status.getPath().getParent().toString() for status in found or [])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was committed before. A change id that comes twice in a batch counts once."""
        if any(folder.endswith(f"/batch={batch}") for folder in self.committed()):
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, version, docs, tokens`` over all committed batches; groups without documents and tokens are left out."""
        folders = self.committed()
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(*folders)
        sums = deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs != 0 OR tokens != 0")


def signed(changes: DataFrame) -> DataFrame:
    """One signed row per group. Unknown kinds are refused; null counts are 0."""
    kind = F.lower("kind")
    count, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
    unknown = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown.cast("int"))
    tokens = F.when(kind == "insert", count).when(kind == "delete", -count).otherwise(count - old)
    once = changes.dropDuplicates(["change"]).select(*[F.col(c).cast("string").alias(c) for c in GROUP], docs.cast("long").alias("docs"), tokens.alias("tokens"))
    return once.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``row, doc_id, source, lang, words, ids``: words and vocabulary ids of every whole text; null texts have none of either."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = document_encoder(vocabulary)
        for batch in batches:
            ids = pa.array([len(ids_of(text or "")) for text in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=["row", "doc_id", "source", "lang", "words", "ids"])

    words = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    picked = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        words.alias("words"), F.col(text_column).alias("text"),
    )
    return stored(picked.mapInArrow(count, "row long, doc_id long, source string, lang string, words long, ids long"), "token-counts")


def changes_of(counts: DataFrame, kind: str, version: str, tokens: Column, old_tokens: Column | None = None) -> DataFrame:
    old = F.lit(None).cast("long") if old_tokens is None else old_tokens
    return counts.select(
        F.concat_ws(":", F.lit(kind), F.lit(version), "row").alias("change"), F.lit(kind).alias("kind"), "source", "lang", F.lit(version).alias("version"), tokens.alias("tokens"), old.alias("old_tokens"),
    )


def corpus_rollups(docs: DataFrame, vocabulary: str = VOCABULARY, least_words: int = 50) -> DataFrame:
    """Totals of a corpus after four batches, one of them sent twice: all texts by words, all texts by vocabulary ids, the ids
    revised to count an end id each, and texts of fewer than ``least_words`` words deleted again under both versions.

    Null sources and languages are groups of their own; every input row is a document, also one that repeats another.
    """
    counts = token_counts(docs, vocabulary=vocabulary)
    book = TokenRollups(docs.sparkSession, new_path(docs.sparkSession, "rollups"))
    by_ids = changes_of(counts, "insert", vocabulary, F.col("ids"))
    book.commit("1-words", changes_of(counts, "insert", "words", F.col("words")))
    book.commit("2-ids", by_ids)
    book.commit("3-end-ids", changes_of(counts, "revise", vocabulary, F.col("ids") + 1, F.col("ids")))
    short = counts.where(F.col("words") < least_words)
    book.commit("4-short", changes_of(short, "delete", "words", F.col("words")).unionByName(changes_of(short, "delete", vocabulary, F.col("ids") + 1)))
    book.commit("2-ids", by_ids)
    return book.totals()
