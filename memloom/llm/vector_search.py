"""Exact top-k by inner product as a Voronoi join: pivots, distance bounds from cell summaries, bounded replication, local solving."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.shared import stored


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def products(left: pa.Array, right: pa.Array, width: int) -> np.ndarray:
    """Exact inner products: as floating-point numbers while these hold every sum, else as 64-bit integers; larger ones are refused."""
    a, b = matrix(left, width), matrix(right, width)
    most = (np.abs(a).max() if a.size else 0.0) * (np.abs(b).max() if b.size else 0.0) * width
    if most < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    if np.abs(a @ b.T).max() >= 2.0**63:
        raise OverflowError("an inner product exceeds 64 bits")
    whole = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    return whole(left) @ whole(right).T


def lifted(vectors: np.ndarray, radius2: float) -> np.ndarray:
    """One more component that gives all data vectors the same length: the largest inner product is then the nearest point."""
    return np.sqrt(np.maximum(0.0, radius2 - (vectors**2).sum(1)))


def cell_distances(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each point and the distance to it."""
    points = np.c_[vectors, extra]
    square = np.maximum(0.0, (points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)[None, :])
    cell = square.argmin(1)
    return cell, np.sqrt(square[np.arange(len(cell)), cell])


def cell_groups(centres: np.ndarray, queries: dict[int, int], least: int) -> dict[int, int]:
    """Neighbouring query cells in groups of at least ``least`` queries: cells in the order of the pivots' main direction."""
    if not queries:
        return {}
    cells = np.array(sorted(queries))
    spread = centres[cells] - centres[cells].mean(0)
    direction = np.linalg.svd(spread, full_matrices=False)[2][0]
    groups, group, held = {}, 0, 0
    for cell in cells[np.argsort(spread @ direction, kind="stable")].tolist():
        groups[cell] = group
        held += queries[cell]
        if held >= least:
            group, held = group + 1, 0
    return groups


def assigned(rows: DataFrame, pivots: np.ndarray, radius2: float, query: bool) -> DataFrame:
    """Rows ``id, vector`` with ``cell`` and ``distance``; queries have 0 where data have the lifting component."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    width = pivots.shape[1] - 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                vectors = matrix(part["vector"], width)
                cell, distance = cell_distances(vectors, np.zeros(len(vectors)) if query else lifted(vectors, radius2), shared.value)
                yield pa.RecordBatch.from_arrays([part["id"], part["vector"], pa.array(cell, pa.int32()), pa.array(distance)], names=["id", "vector", "cell", "distance"])

    return rows.mapInArrow(assign, "id long, vector array<long>, cell int, distance double")


def top_inner_products(data: DataFrame, queries: DataFrame, k: int = 20, pivots: int = 64, query_block: int = 512, data_block: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries (id, vector)`` the ``k`` largest inner products with rows of
    ``data (id, vector)`` other than those of its own id; ties to the smaller id. Integer vectors of one width.

    Data vectors get one more component so that all have the same length; nearness then orders as the inner product does.
    Both sides fall into the Voronoi cells of ``pivots`` hashed data vectors. A query cell's radius and the ``k + 1`` least
    distances inside every data cell bound how far the neighbours of the cell's queries can be; a data vector goes to a group
    of neighbouring query cells only if the triangle inequality lets it be that near for one of them. What a group asks and
    receives is split by hash into blocks, so neither a hot cell nor a run of equal vectors meets in one task; partial answers are merged per query.
    """
    spark = data.sparkSession
    data, queries = (rows.select("id", F.col("vector").cast("array<long>").alias("vector")) for rows in (data, queries))
    probe = data.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("r"), F.max(F.size("vector")).alias("w")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if probe["w"] is None:
        return empty
    radius2, width = float(probe["r"]), probe["w"]
    picked = data.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(pivots).select("vector").toArrow()["vector"].combine_chunks()
    points = matrix(picked, width)
    centres = np.unique(np.c_[points, lifted(points, radius2)], axis=0)
    data_cells = stored(assigned(data, centres, radius2, False), "knn-data")
    query_cells = stored(assigned(queries, centres, radius2, True), "knn-queries")
    # Distances are roots of differences of squares up to radius2, so they may be off by a small share of the radius.
    slack = 1e-6 * (1.0 + float(np.sqrt(radius2)))

    near = Window.partitionBy("cell", "slice").orderBy("distance")
    sliced = data_cells.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64)))
    heads = sliced.select("cell", "slice", "distance").withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    heads = heads.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("distance")), 1, k + 1).alias("nearest"))
    data_summary = {r["cell"]: r["nearest"] for r in heads.collect()}
    query_summary = {r["cell"]: (r["r"], r["n"]) for r in query_cells.groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect()}
    between = np.sqrt(np.maximum(0.0, ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2)))

    group_of = cell_groups(centres, {cell: n for cell, (_, n) in query_summary.items()}, query_block)
    asked, least = Counter(), {}
    for cell, (radius, n) in query_summary.items():
        reach = np.sort(np.concatenate([radius + between[cell, other] + np.array(nearest) for other, nearest in data_summary.items()]))
        bound = reach[k] if len(reach) > k else np.inf
        asked[group_of[cell]] += n
        for other in data_summary:
            key = (group_of[cell], other)
            least[key] = min(least.get(key, np.inf), max(0.0, float(between[cell, other] - radius - bound)) - slack)
    if not least:
        return empty
    route = spark.createDataFrame([(group, cell, value) for (group, cell), value in least.items()], "group int, cell int, least double")
    sent = data_cells.join(F.broadcast(route), "cell").where("distance >= least").select("group", "id", "vector")
    received = {r["group"]: r["n"] for r in sent.groupBy("group").agg(F.count("*").alias("n")).collect()}
    sizes = spark.createDataFrame([(g, -(-n // data_block), -(-asked[g] // query_block)) for g, n in received.items()], "group int, data_blocks int, query_blocks int")
    members = spark.createDataFrame(list(group_of.items()), "cell int, group int")

    left = query_cells.join(F.broadcast(members), "cell").join(F.broadcast(sizes), "group")
    left = left.select("group", F.pmod(F.xxhash64("id", F.lit("q")), "query_blocks").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("data_blocks") - 1)).alias("d"), "id", "vector")
    right = sent.join(F.broadcast(sizes), "group")
    right = right.select("group", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("q"), F.pmod(F.xxhash64("id", F.lit("d")), "data_blocks").cast("int").alias("d"), "id", "vector")

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        ids = data["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        base = data["vector"].combine_chunks().take(pa.array(order))
        out: list[list[np.ndarray]] = [[], [], []]
        asked = queries["id"].to_numpy()
        wanted = queries["vector"].combine_chunks()
        for low in range(0, len(asked), 256):
            score = products(wanted.slice(low, 256), base, width)
            for i, row in enumerate(score):
                own = ids == asked[low + i]
                row[own] = np.iinfo(np.int64).min
                limit = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else np.iinfo(np.int64).min
                kept = np.flatnonzero((row >= limit) & ~own)
                kept = kept[np.argsort(-row[kept], kind="stable")][:k]
                out[0].append(np.full(len(kept), asked[low + i]))
                out[1].append(ids[kept])
                out[2].append(row[kept])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": join(out[0]), "vec_id": join(out[1]), "score": join(out[2])})

    keys = ["group", "q", "d"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 64) -> DataFrame:
    """``id, vector``: floor(scale * x) of every component; rows without an id, with a null or non-finite component, or without
    components take no part. Vectors shorter or longer than the commonest have no inner product with it: ``of_one_width`` leaves
    them out. Components of any size are kept; an inner product of more than 64 bits ends the query with an error."""
    real = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & (F.size(vector_column) > 0) & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(real, lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def of_one_width(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the commonest width, of equal ones the least."""
    widths = rows.groupBy(F.size("vector").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(2).collect()
    return rows if len(widths) < 2 else rows.where(F.size("vector") == widths[0]["w"])


def embedding_neighbours(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``top_inner_products`` of the rows whose id is divisible by ``every`` among all rows. A repeated id is one candidate per row."""
    rows = of_one_width(stored(quantised(table), "knn-vectors"))
    return top_inner_products(rows, rows.where(F.col("id") % every == 0), k)
