"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op4_sampled_splitters")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.sharding import shard_documents

    return shard_documents(table(spark, folder, "documents"))


@query("op9_robust_outliers")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.quality import judge_quality

    return judge_quality(table(spark, folder, "documents"))


@query("op2_nearest_toxic_examples")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_weighted_near_copies")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.near_copies import near_copy_classes

    return near_copy_classes(table(spark, folder, "documents"))


@query("op5_block_apportionment")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.mixing import mix_documents

    return mix_documents(table(spark, folder, "documents"))


@query("op6_mixture_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"))


@query("op8_chunked_warc")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, folder, "pages"))


@query("op1_voronoi_top20", """
    WITH v AS (
        SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.id AS query_id, b.id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.vector_search import embedding_neighbours

    return embedding_neighbours(table(spark, folder, "embeddings"))


@query("op3_template_extraction")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.templates import extract_articles

    return extract_articles(table(spark, folder, "pages"))


@query("op7_token_rollups")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.rollups import corpus_rollups

    return corpus_rollups(table(spark, folder, "documents"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, folder, "documents"), tails=True)


@query("op12_fourier_quality")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.kernel_quality import score_quality

    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_bloom_search", """
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM documents WHERE text IS NOT NULL
    ), i AS (
        SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
        FROM benchmark WHERE text IS NOT NULL
    ), totals AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS length FROM d WHERE len(terms) > 0),
    asked AS (SELECT item, item_id, term, count(*) AS repeats FROM (SELECT item, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
    held AS (SELECT row, doc_id, size, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS size, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weighted AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(t.n) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS weight FROM held, totals t GROUP BY term),
    scored AS (
        SELECT item, item_id, row, doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * t.n) // t.length)))) AS BIGINT) AS score
        FROM asked JOIN held USING (term) JOIN weighted USING (term), totals t GROUP BY item, item_id, row, doc_id
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from memloom.llm.signature_search import rank_documents

    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
