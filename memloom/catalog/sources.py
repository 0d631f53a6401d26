"""Source and sink queries; nested documents are built by Spark from the dialogue table."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import query
from memloom.catalog.edges import graph
from memloom.catalog.expansion import SEED_SQL, found
from memloom.functions import text as tx
from memloom.sources import artifacts as ar
from memloom.sources import dialogue as dg
from memloom.sources import tables as tb
from memloom.sources.tables import TURNS_SQL


def session_json(spark, d):
    """One JSON document per conversation with ``session_N`` keys, parsed with the source's schema; assistant turns carry no id."""
    t = tb.turns(spark, d)
    turn = F.struct("pos", F.when(F.col("speaker") != "assistant", F.col("turn_id")).alias("dia_id"), "speaker", "text")
    sessions = t.groupBy("conv_id", "session_id").agg(F.array_sort(F.collect_list(turn)).alias("ts"), F.min("ts").alias("first_ts"))
    body = F.transform("ts", lambda x: F.struct(x["dia_id"].alias("dia_id"), x["speaker"].alias("speaker"), x["text"].alias("text")))
    key = F.concat(F.lit("session_"), F.substring("session_id", 2, 9))
    entry = F.concat(F.lit('"'), key, F.lit('":'), F.to_json(body), F.lit(',"'), key, F.lit('_date_time":"'), F.col("first_ts"), F.lit('"'))
    qa = F.concat(F.lit('[{"question":"Who is '), F.col("conv_id"), F.lit('?","answer":"x","category":2,"evidence":["D1:1"]},{"question":"And?"}]'))
    return sessions.groupBy("conv_id").agg(F.array_join(F.collect_list(entry), ",").alias("body")).select(
        "conv_id", F.concat(F.lit('{"sample_id":"'), F.col("conv_id"), F.lit('","conversation":{'), F.col("body"), F.lit('},"qa":'), qa, F.lit("}")).alias("doc"))


def session_documents(spark, d):
    return session_json(spark, d).select(F.from_json("doc", dg.SESSION_SCHEMA).alias("r")).select("r.*")


@query("session_keyed_turns_S01", "WITH " + TURNS_SQL + """z AS (SELECT 1) SELECT conv_id, pos, turn_id, speaker, text, min(ts) OVER (PARTITION BY conv_id, session_id) AS ts, 'session_' || substr(session_id, 2) AS session_id FROM turns""")
def _(spark, d):
    return dg.session_turns(session_documents(spark, d))


@query("session_keyed_questions_S01", "WITH c AS (SELECT DISTINCT 'c' || conv_id AS conv_id FROM conversations) SELECT conv_id, conv_id || ':q0001' AS question_id, 'Who is ' || conv_id || '?' AS question, '2' AS category, 'D1:1' AS evidence FROM c UNION ALL SELECT conv_id, conv_id || ':q0002', 'And?', NULL, '' FROM c")
def _(spark, d):
    return dg.session_questions(session_documents(spark, d)).select("conv_id", "question_id", "question", "category", F.array_join("evidence", "|").alias("evidence"))


def haystack_documents(spark, d):
    """One instance per conversation with parallel session arrays; the user's turns hold the answer."""
    t = tb.turns(spark, d)
    number = F.regexp_extract("conv_id", "([0-9]+)", 1).cast("bigint")
    sessions = t.groupBy("conv_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "speaker", "text"))).alias("ts"), F.min("ts").alias("dt"))
    turn = F.transform("ts", lambda x: F.struct(x["speaker"].alias("role"), F.when(x["speaker"] == "system", F.lit("  ")).otherwise(x["text"]).alias("content"), (x["speaker"] == "user").alias("has_answer")))
    docs = sessions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("session_id", "dt", turn.alias("turns")))).alias("s")).select(
        number.alias("instance_no"), F.concat(F.lit("q/"), F.col("conv_id"), F.when(number % 10 == 0, "_abs").otherwise("")).alias("question_id"), F.when(number % 2 == 0, "temporal").alias("question_type"), F.lit("?").alias("question"),
        F.lit("!").alias("answer"), F.lit("2024/01/01").alias("question_date"), F.transform("s", lambda x: x["session_id"]).alias("haystack_session_ids"), F.transform("s", lambda x: x["dt"]).alias("haystack_dates"),
        F.transform("s", lambda x: x["turns"]).alias("haystack_sessions"))
    return docs


HAY_SQL = TURNS_SQL + """
hy AS (SELECT *, substr(conv_id, 2)::BIGINT AS n, pos % 4 AS t FROM turns),
hc AS (SELECT *, 'lme_' || lpad((n + 1)::VARCHAR, 4, '0') || '_q_' || conv_id || CASE WHEN n % 10 = 0 THEN '_abs' ELSE '' END AS cid FROM hy)"""


@query("haystack_turns_S02", "WITH " + HAY_SQL + " SELECT cid AS conv_id, 's' || lpad((substr(session_id, 2)::INT - 1)::VARCHAR, 3, '0') || ':' || session_id || ':t' || lpad(t::VARCHAR, 3, '0') AS turn_id, speaker, trim(text) AS text, session_id, speaker = 'user' AS is_gold FROM hc WHERE speaker <> 'system'")
def _(spark, d):
    return dg.haystack_turns(haystack_documents(spark, d)).drop("ts")


@query("haystack_questions_S02", "WITH " + HAY_SQL + " SELECT cid AS conv_id, cid || ':q0001' AS question_id, CASE WHEN n % 2 = 0 THEN 'temporal' ELSE 'unknown' END AS question_type, count(*) FILTER (speaker = 'user')::INTEGER AS gold_turns, n % 10 = 0 AS is_abstention FROM hc GROUP BY cid, n")
def _(spark, d):
    docs = haystack_documents(spark, d)
    return dg.haystack_questions(docs, dg.haystack_turns(docs)).select("conv_id", "question_id", "question_type", F.size("gold_evidence").alias("gold_turns"), "is_abstention")


def _array_files(spark, rows, part):
    """A folder of JSON array files, one per ``part`` of ``rows`` (key, doc), in the order of their keys."""
    path = ar.shared_folder(spark)
    arrays = rows.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("key", "doc"))).alias("docs"))
    text = F.concat(F.lit("[\n  "), F.array_join(F.transform("docs", lambda x: x["doc"]), ",\n  "), F.lit("\n]"))
    arrays.select("part", text.alias("value")).write.partitionBy("part").text(path)
    return path


@query("session_files_S01", "WITH " + TURNS_SQL + """z AS (SELECT 1) SELECT conv_id, pos, turn_id, speaker, text, min(ts) OVER (PARTITION BY conv_id, session_id) AS ts, 'session_' || substr(session_id, 2) AS session_id FROM turns""")
def _(spark, d):
    """All conversations by way of JSON array files."""
    rows = session_json(spark, d).select(F.col("conv_id").alias("key"), "doc")
    return dg.session_turns(dg.read_session_documents(spark, _array_files(spark, rows, F.pmod(F.xxhash64("key"), F.lit(8)))))


@query("haystack_files_S02", "WITH " + HAY_SQL + """
SELECT conv_id AS question, 's' || lpad((substr(session_id, 2)::INT - 1)::VARCHAR, 3, '0') || ':' || session_id || ':t' || lpad(t::VARCHAR, 3, '0') AS turn_id, speaker, trim(text) AS text, session_id, speaker = 'user' AS is_gold FROM hc WHERE speaker <> 'system'""")
def _(spark, d):
    """All instances by way of JSON array files; an instance is found again by its question, since its number is its place in a file."""
    docs = haystack_documents(spark, d)
    rows = docs.select(F.col("instance_no").alias("key"), F.to_json(F.struct(*[c for c in docs.columns if c != "instance_no"])).alias("doc"))
    read = dg.read_haystack_documents(spark, _array_files(spark, rows, F.floor(F.col("key") / 50)))
    turns = dg.haystack_turns(read).drop("ts")
    return turns.withColumn("question", F.regexp_extract("conv_id", r"_q_(c[0-9]+)", 1)).drop("conv_id")


@query("id_sanitiser_S03", r"SELECT page_id, left(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), 80) AS safe FROM pages UNION ALL SELECT -1 - doc_id, left(regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g'), 80) FROM documents")
def _(spark, d):
    pages = tb.table(spark, d, "pages").select("page_id", tx.safe_id("url").alias("safe"))
    return pages.unionByName(tb.table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("page_id"), tx.safe_id("text").alias("safe")))


@query("graph_store_round_trip_S04", "WITH " + SEED_SQL + " SELECT 'node' AS kind, conv_id, node_id AS a, type AS b FROM nodes UNION ALL SELECT 'edge', conv_id, src, dst FROM edges")
def _(spark, d):
    path = ar.shared_folder(spark)
    ar.write_graph(*graph(spark, d), path)
    nodes, edges = ar.read_graph(spark, path)
    return nodes.select(F.lit("node").alias("kind"), "conv_id", F.col("node_id").alias("a"), F.col("type").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), "conv_id", F.col("src").alias("a"), F.col("dst").alias("b")))


@query("candidate_paths_round_trip_S05", "WITH " + SEED_SQL + " SELECT q AS question_id, rank::INTEGER AS rank, doc AS node_id, round(norm, 6) AS score FROM hits WHERE rank <= 100")
def _(spark, d):
    hits = found(spark, d, 100)[3].select("question_id", "rank", "node_id", F.round("norm", 6).alias("score"))
    return dg.flatten_paths(dg.nest_paths(hits))


@query("json_array_conversion_S06", "SELECT doc_id, lang, text FROM documents")
def _(spark, d):
    path = ar.shared_folder(spark)
    # JSON array files of many objects, as the exported artifacts are
    rows = tb.table(spark, d, "documents").select("doc_id", "lang", "text")
    arrays = rows.groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "lang", "text"))).alias("value"))
    arrays.write.mode("overwrite").partitionBy("part").text(f"{path}/json")
    return dg.convert_json_array(spark, f"{path}/json", f"{path}/parquet", "doc_id long, lang string, text string")


def _artifacts(spark, d):
    l = tb.table(spark, d, "labels").withColumnRenamed("doc_id", "question_id")
    docs = tb.table(spark, d, "documents").withColumnRenamed("doc_id", "question_id")
    return l.select("question_id", "quality"), l.select("question_id", "toxic"), docs.select("question_id", "lang")


@query("artifact_completeness_S07", "SELECT doc_id AS question_id, i.i::INTEGER AS missing_in FROM documents CROSS JOIN range(0, 2) i(i) WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return ar.missing_keys(_artifacts(spark, d))


@query("artifact_join_S07", "SELECT l.doc_id AS question_id, quality, toxic, lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def _(spark, d):
    a, b, c = _artifacts(spark, d)
    return ar.join_complete([a, b, c.join(a.select("question_id"), "question_id", "left_semi")])


WINS_SQL = "SELECT doc_id AS question_id, {0} AS source_no, {1} AS value FROM (SELECT d.doc_id, l.doc_id IS NOT NULL AS has, d.doc_id % 2 = 0 AS even, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE has OR even"


def _sources(spark, d):
    l = tb.table(spark, d, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").cast("bigint").alias("value"))
    return [l, tb.table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("question_id"), (F.col("doc_id") + 10).alias("value"))]


@query("first_wins_union_S08", WINS_SQL.format("CASE WHEN has THEN 0 ELSE 1 END", "CASE WHEN has THEN quality::BIGINT ELSE doc_id + 10 END"))
def _(spark, d):
    return ar.first_wins(_sources(spark, d)).select("question_id", "source_no", "value")


@query("last_wins_union_S09", WINS_SQL.format("CASE WHEN even THEN 1 ELSE 0 END", "CASE WHEN even THEN doc_id + 10 ELSE quality::BIGINT END"))
def _(spark, d):
    return ar.last_wins(_sources(spark, d)).select("question_id", "source_no", "value")


@query("question_path_merge_S10", "WITH " + SEED_SQL + " SELECT qs.q AS question_id, count(h.doc)::INTEGER AS paths FROM qs LEFT JOIN hits h ON h.q = qs.q AND h.rank <= 100 WHERE substr(qs.conv_id, 2)::BIGINT % 10 <> 0 GROUP BY qs.q")
def _(spark, d):
    q, _, _, hits = found(spark, d, 100)
    items = dg.nest_paths(hits.select("question_id", "rank", "node_id"))
    asked = q.withColumn("is_abstention", F.regexp_extract("conv_id", "([0-9]+)", 1).cast("bigint") % 10 == 0)
    return ar.merge_questions(asked, items, drop_abstention=True).select("question_id", F.size("paths").alias("paths"))


@query("resume_remaining_S11", "SELECT doc_id AS question_id, 'm|ctx50|cards3|' || doc_id AS cache_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    docs = tb.table(spark, d, "documents").select(F.col("doc_id").alias("question_id"))
    done = tb.table(spark, d, "labels").select(F.col("doc_id").alias("question_id"))
    return ar.remaining(docs, done).select("question_id", ar.card_cache_key("m", 50, 3).alias("cache_key"))


@query("file_integrity_S12")
def _(spark, d):
    hashes = ar.file_hashes(spark, d, "*.parquet")
    manifest = hashes.select("file", F.when(F.col("file").startswith("labels"), F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return ar.verify_files(hashes, manifest)


@query("row_slicing_S13", "WITH r AS (SELECT user_id AS q, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events) SELECT 'first' AS kind, q AS question_id, n AS node_id FROM r WHERE x <= 3 UNION ALL SELECT 'slice', user_id, event_id FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100)")
def _(spark, d):
    e = tb.table(spark, d, "events").select(F.col("user_id").alias("question_id"), F.col("event_id").alias("node_id"), F.col("event_id").alias("rank"), "ts")
    first = ar.first_per_question(e, 3).select(F.lit("first").alias("kind"), "question_id", "node_id")
    return first.unionByName(ar.slice_rows(e, ["ts", "node_id"], 100, 50).select(F.lit("slice").alias("kind"), "question_id", "node_id"))
