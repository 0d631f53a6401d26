"""Graph tables on disk, result files, completeness and integrity checks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import digests
from memloom.operators.ordering import first_per, top_per
from memloom.session import checkpoint_folder, cut_lineage, own_folder


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``; one of this machine for a local master without it."""
    base = checkpoint_folder(spark)
    return f"{base.rstrip('/')}/memloom-{uuid.uuid4().hex}" if base else own_folder(spark)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table of their own in the shared folder, read again column by column."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet tables sorted by conversation inside hash partitions, so scans of one conversation skip files
    and row groups by their statistics without a directory per conversation."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        table.repartition("conv_id").sortWithinPartitions("conv_id").write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def missing_keys(tables: Sequence[DataFrame], key: str = "question_id") -> DataFrame:
    """Keys that some table has and another lacks, with the index of the table that lacks them."""
    keys = [t.select(key).distinct() for t in tables]
    everything = reduce(DataFrame.union, keys).distinct()
    return reduce(DataFrame.union, [everything.join(k, key, "left_anti").select(key, F.lit(i).alias("missing_in")) for i, k in enumerate(keys)])


def join_complete(tables: Sequence[DataFrame], key: str = "question_id") -> DataFrame:
    """Equi join of result tables; an error names the first keys missing on any side."""
    lost = missing_keys(tables, key).limit(20).collect()
    if lost:
        raise ValueError(f"incomplete inputs: {[(r[0], r[1]) for r in lost]}")
    return reduce(lambda a, b: a.join(b, key), tables)


def _ordered_union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.withColumn("source_no", F.lit(i)) for i, t in enumerate(tables)])


def first_wins(tables: Sequence[DataFrame], key: str = "question_id") -> DataFrame:
    """Union of tables that keeps the row of the earliest table per key."""
    return first_per(_ordered_union(tables), [key], ["source_no"])


def last_wins(tables: Sequence[DataFrame], key: str = "question_id") -> DataFrame:
    rows = _ordered_union(tables).withColumn("source_back", -F.col("source_no"))
    return first_per(rows, [key], ["source_back"]).drop("source_back")


def merge_questions(questions: DataFrame, items: DataFrame, drop_abstention: bool = False) -> DataFrame:
    """Every question with its paths, an empty list where there are none; question columns win."""
    rows = questions.filter("NOT is_abstention") if drop_abstention else questions
    extra = [c for c in items.columns if c == "question_id" or c not in rows.columns]
    joined = rows.join(items.select(*extra), "question_id", "left")
    return joined.withColumn("paths", F.coalesce("paths", F.array().cast(dict(items.dtypes)["paths"])))


def remaining(inputs: DataFrame, done: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """Inputs not yet in the sink."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def card_cache_key(model: str, context: int, cards: int) -> Column:
    return F.concat_ws("|", F.lit(model), F.lit(f"ctx{context}"), F.lit(f"cards{cards}"), F.col("question_id").cast("string"))


# Fixed value: endings at which Spark's text reader would unpack a file.
PACKED = r"(?i)\.(?:gz|bz2|deflate|snappy|lz4|zst)$"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def file_hashes(spark: SparkSession, path: str, pattern: str = "*", piece: int = 1 << 27) -> DataFrame:
    """SHA-256 of each file.

    Files of up to ``piece`` bytes are hashed by one task each. Longer ones are cut into the splits of Spark's text reader and stored once;
    then a round hashes the next ``piece`` bytes of every file and hands on the digest's state, so that no task reads a whole file.
    Packed files, which that reader would unpack, are hashed by one task whatever their length.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    long = (F.col("_metadata.file_size") > piece) & ~F.col("_metadata.file_path").rlike(PACKED)
    listed = files.filter(long).select(F.xxhash64("_metadata.file_path").alias("key"), name, "length").collect() if digests.available() else []
    if not listed:
        return files.select(name, "length", F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(path).filter(long)
    hashed = spark.createDataFrame(_hashes_by_rounds(lines, listed, piece), "file string, length long, sha256 string")
    return files.filter(~long).select(name, "length", F.sha2("content", 256).alias("sha256")).unionByName(hashed)


def _hashes_by_rounds(lines: DataFrame, listed: Sequence, piece: int) -> list[tuple[str, int, str]]:
    """(file, length, SHA-256) of the ``listed`` files, whose ``lines`` Spark reads in splits. Only states pass the driver."""
    spark = lines.sparkSession
    numbers = {row.key: i for i, row in enumerate(listed)}

    def stretches(batches):
        """Neighbouring lines of a split joined again; every line but the first of a file brings the line end before it."""
        last, part = None, 0
        for batch in batches:
            keys, starts = (batch.column(c).to_numpy() for c in ("key", "start"))
            ends = [*(np.flatnonzero((np.diff(keys) != 0) | (np.diff(starts) != 0)) + 1).tolist(), len(keys)]
            for low, high in zip([0, *ends], ends):
                key, start = int(keys[low]), int(starts[low])
                data = pc.binary_join(pa.ListArray.from_arrays([0, high - low], batch.column("line").slice(low, high - low)), b"\n")[0].as_py()
                fresh = (key, start) != last
                last, part = (key, start), 0 if fresh else part + 1
                data = data if fresh and start == 0 else b"\n" + data
                yield pa.RecordBatch.from_pylist([{"no": numbers[key], "start": start, "part": part, "size": len(data), "data": data, "round": start // piece}])

    def folded(batches):
        """State of each file after the bytes that follow its last state."""
        number, digest = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["start"] < 0:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"no": number, "state": digest.state()}])
                    number, digest = row["no"], digests.Sha256(row["data"])
                else:
                    digest.update(row["data"])
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"no": number, "state": digest.state()}])

    path = f"{shared_folder(spark)}/stretches"
    schema = "no long, start long, part long, size long, data binary, round long"
    lines.select(F.xxhash64("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")).mapInArrow(
        stretches, schema).write.partitionBy("round").option("compression", "none").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    rounds = [(row.no, row.round) for row in stored.select("no", "round").distinct().orderBy("round").collect()]
    sizes = {row.no: row.size for row in stored.groupBy("no").agg(F.sum("size").alias("size")).collect()}
    # the reader drops a byte order mark and the last line end; the length tells which of them a file has
    lost = {i: row.length - sizes.get(i, 0) for i, row in enumerate(listed)}
    if not set(lost.values()) <= {0, 1, 3, 4}:
        raise ValueError(f"files changed while they were read: {[listed[i].file for i, n in lost.items() if n not in (0, 1, 3, 4)][:20]}")
    states = {i: digests.Sha256().update(BYTE_ORDER_MARK if n >= 3 else b"").state() for i, n in lost.items()}
    for at in dict.fromkeys(r for _, r in rounds):
        here = [no for no, r in rounds if r == at]
        before = spark.createDataFrame([(no, -1, 0, states[no]) for no in here], "no long, start long, part long, data binary")
        rows = before.unionByName(stored.filter(F.col("round") == at).select("no", "start", "part", "data"))
        dealt = rows.repartitionById(len(listed), F.col("no").cast("int")).sortWithinPartitions("no", "start", "part")
        states.update({row.no: bytes(row.state) for row in dealt.mapInArrow(folded, "no long, state binary").collect()})
    return [(row.file, row.length, digests.Sha256(states[i]).update(b"\n" if lost[i] in (1, 4) else b"").hexdigest()) for i, row in enumerate(listed)]


def verify_files(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """ok, mismatch or missing per manifest entry."""
    rows = manifest.select("file", F.col("sha256").alias("expected")).join(hashes, "file", "left")
    return rows.select("file", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "ok").otherwise("mismatch").alias("verdict"))


def slice_rows(rows: DataFrame, order: Sequence, offset: int, limit: int, near: int = 100_000) -> DataFrame:
    """Rows ``offset`` … ``offset + limit`` of a total order.

    Slices that end within the first ``near`` rows are a distributed top-k. Farther ones are found by place: rows are sorted over all
    tasks and stored with their place in the task, one count a task tells the rows before it, and only the slice leaves the tasks.
    """
    if offset + limit <= near:
        return rows.orderBy(*order).offset(offset).limit(limit)
    placed = cut_lineage(rows.orderBy(*order).withColumn("__place", F.monotonically_increasing_id())).withColumn("__task", F.shiftright("__place", 33))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__task").agg(F.count(F.lit(1)).alias("__rows")).select("__task", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    at = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(counts, "__task").filter((at >= offset) & (at < offset + limit)).drop("__task", "__place", "__before")


def first_per_question(rows: DataFrame, count: int) -> DataFrame:
    return top_per(rows, ["question_id"], [F.asc("rank"), F.asc("node_id")], count, "slice_no")
