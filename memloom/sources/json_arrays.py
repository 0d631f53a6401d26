"""Top-level JSON arrays read by many tasks: files are cut at every closing brace, and running sums tell which of them ends a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _net(segments: Column, side: int) -> Column:
    """Opening minus closing brackets in every second part between quotes."""
    text = F.array_join(F.filter(segments, lambda _, i: i % 2 == side), "")
    return F.length(F.regexp_replace(text, r"[^{\[]", "")) - F.length(F.regexp_replace(text, r"[^\]]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, place, value`` and what a piece does to the state before it: the quotes it flips, and the change of depth if it
    starts outside (``out``) or inside (``into``) a string. The brace that ended the piece counts where it stands outside."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value")
    segments = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    quotes = F.size("segments") - 1
    return rows.withColumn("segments", segments).select(
        "file", "split", "place", "value", quotes.alias("quotes"), (_net(F.col("segments"), 0) - (1 - quotes % 2)).alias("out"), (_net(F.col("segments"), 1) - quotes % 2).alias("into"))


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, place, value, ends, number``: pieces of the files, whether one ends a record, and its record's number in the file.

    State is a running sum twice over: quotes tell whether a piece starts in a string, brackets how deep it ends. Sums run inside one
    split of a file, of at most ``spark.sql.files.maxPartitionBytes``; one row a split carries them on to the next.
    """
    here = Window.partitionBy("file", "split").orderBy("place")
    before, upto = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda total: F.coalesce(total, F.lit(0))

    inner = _pieces(spark, path).withColumn("flipped", zero(F.sum("quotes").over(before)) % 2)
    by_start = [F.when(F.col("flipped") == side, F.col("out")).otherwise(F.col("into")) for side in (0, 1)]
    inner = inner.select("file", "split", "place", "value", ((F.col("flipped") + F.col("quotes")) % 2).alias("left"), F.sum(by_start[0]).over(upto).alias("depth0"), F.sum(by_start[1]).over(upto).alias("depth1"))

    last = lambda c: F.max_by(c, "place").alias(c)
    splits = inner.groupBy("file", "split").agg(last("left"), last("depth0"), last("depth1"), F.min_by(F.ltrim(F.regexp_replace("value", r"^[\s\x{FEFF}]+", "")).startswith("["), "place").alias("array"))
    splits = splits.withColumn("parity", zero(F.sum("left").over(earlier)) % 2)
    change = F.when(F.col("parity") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    splits = splits.select(
        "file", "split", "parity", zero(F.sum(change).over(earlier)).alias("deep"), F.first("array").over(whole).cast("int").alias("base"),
        F.sum(change).over(whole).alias("final"), (F.sum("left").over(whole) % 2).alias("open"))
    # the piece after the last brace counts one that is not there
    broken = (F.col("open") == 1) | ~((F.col("final") == -1) | (F.col("final") == 0) & (F.col("base") == 0))
    splits = splits.select("file", "split", "parity", "deep", F.when(broken, F.raise_error(F.concat(F.lit("JSON text ends early: "), F.col("file"))).cast("int")).otherwise(F.col("base")).alias("base"))

    depth = F.col("deep") + F.when(F.col("parity") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    ends = ((F.col("parity") + F.col("left")) % 2 == 0) & (depth == F.col("base"))
    marked = inner.join(splits, ["file", "split"]).select("file", "split", "place", "value", ends.alias("ends"))
    numbered = marked.withColumn("local", zero(F.sum(F.col("ends").cast("bigint")).over(before)))
    held = marked.groupBy("file", "split").agg(F.count_if("ends").alias("held")).select("file", "split", zero(F.sum("held").over(earlier)).alias("offset"))
    return numbered.join(held, ["file", "split"]).select("file", "split", "place", "value", "ends", (F.col("offset") + F.col("local")).alias("number"))


def read_json_array(spark: SparkSession, path: str, schema: str, number: str | None = None) -> DataFrame:
    """Objects of top-level JSON arrays as rows of ``schema``, with their 0-based place in the file as column ``number`` if asked for.

    A file is read by as many tasks as it has splits and through Spark's own reader, so from any store; a record that crosses a
    border meets by (file, number). Objects one after the other without an array are records too; other elements of an array are
    left out, an object that does not fit the schema has nulls, a file that ends inside a record is an error.
    """
    piece = F.struct("split", "place", "value")
    records = json_pieces(spark, path).groupBy("file", "number").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("ends").alias("whole")).filter("whole")
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), "}"), F.lit("}"))
    parsed = records.select(F.col("number").alias("__number"), F.from_json(F.regexp_replace(text, r"^[^{]*", ""), schema).alias("record"))
    return parsed.select(*([F.col("__number").alias(number)] if number else []), "record.*")
