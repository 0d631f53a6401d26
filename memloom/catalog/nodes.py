"""Node extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import query
from memloom.functions import text as tx
from memloom.operators import nodes as nd
from memloom.sources import tables as tb
from memloom.sources.tables import NODES_SQL, TURNS_SQL, content_terms_sql, term_set_sql

joined = lambda c: F.array_join(c, "|")

UNICODE_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
NAMES_SQL = "list_filter(" + UNICODE_WORDS + ", lambda t: regexp_matches(t, '^[A-Z][a-zA-Z][a-zA-Z]+$'))"


def names_sql(expr: str) -> str:
    return NAMES_SQL.format(expr)


def lexical_sql(expr: str) -> str:
    return f"list_transform(regexp_extract_all({expr}, '[A-Za-z0-9_''-]+'), lambda t: lower(t))"


@query("whitespace_normalisation_N01", r"""
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM documents""")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", tx.squeeze("text").alias("clean"))


@query("content_terms_N02", f"""
SELECT doc_id, array_to_string({content_terms_sql('text')}, '|') AS terms, len({content_terms_sql('text')})::INTEGER AS n FROM documents""")
def _(spark, d):
    terms = tx.content_terms("text")
    return tb.table(spark, d, "documents").select("doc_id", joined(terms).alias("terms"), F.size(terms).alias("n"))


@query("raw_nodes_N03", "WITH " + NODES_SQL + """last_ AS (SELECT 1)
SELECT conv_id, node_id, type, text, time, status, confidence, pos, turn_id, speaker, session_id FROM raws""")
def _(spark, d):
    return tb.raw_nodes(spark, d).drop("source", "support_ids")


@query("fact_nodes_N04", "WITH " + NODES_SQL + """last_ AS (SELECT 1)
SELECT conv_id, node_id, type, text, time, status, confidence, raw_id, pos, turn_id, speaker, session_id FROM facts""")
def _(spark, d):
    return tb.fact_nodes(spark, d).withColumn("raw_id", F.col("support_ids")[0]).drop("source", "support_ids")


@query("status_inference_N05", """
WITH t AS (SELECT doc_id, lower(text) AS l FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(l, 'not anymore|no longer|changed|instead') THEN 'outdated'
  WHEN regexp_matches(l, 'except|unless') THEN 'exception'
  WHEN regexp_matches(l, 'maybe|possibly|unclear|not sure') THEN 'disputed' ELSE 'active' END AS status FROM t""")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", tx.infer_status("text").alias("status"))


@query("anchor_assignment_N06", "WITH " + NODES_SQL + """last_ AS (SELECT 1)
SELECT conv_id, node_id, text, fact_id, fact_pos FROM anchor_members""")
def _(spark, d):
    return nd.anchor_members(tb.turns(spark, d)).select("conv_id", "node_id", "text", "fact_id", "fact_pos")


def _observations(spark, d):
    """Assistant turns read as observations about the turn itself and the turn before it."""
    turns = tb.turns(spark, d)
    support = F.concat(
        F.lit("['"), F.col("turn_id"), F.lit("', '"),
        F.concat(F.lit("D"), F.floor((F.col("pos") - 1) / 4) + 1, F.lit(":"), F.col("pos")), F.lit("']"),
    )
    return turns.filter("speaker = 'assistant' AND pos > 0").select(
        "conv_id", (F.col("pos") + 1).alias("obs_no"), F.col("session_id").alias("session_key"), "speaker", "text",
        support.alias("support"),
    )


OBSERVATIONS_SQL = """
obs AS (
  SELECT conv_id, pos + 1 AS obs_no, session_id, speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, turn_id AS t1,
         'D' || ((pos - 1) // 4 + 1) || ':' || pos AS t0
  FROM turns WHERE speaker = 'assistant' AND pos > 0),
"""


@query("observation_facts_N07", "WITH " + TURNS_SQL + OBSERVATIONS_SQL + """last_ AS (SELECT 1)
SELECT o.conv_id, o.conv_id || ':fact:obs:' || lpad(CAST(o.obs_no AS VARCHAR), 4, '0') AS node_id, o.text,
  coalesce(a.ts, b.ts) AS time, 0.86::DOUBLE AS confidence,
  o.conv_id || ':raw:' || o.t1 || '|' || o.conv_id || ':raw:' || o.t0 AS support_ids,
  concat_ws('|', a.speaker || ': ' || a.text, b.speaker || ': ' || b.text) AS support_texts
FROM obs o LEFT JOIN clean a ON a.conv_id = o.conv_id AND a.turn_id = o.t1
LEFT JOIN clean b ON b.conv_id = o.conv_id AND b.turn_id = o.t0""")
def _(spark, d):
    return nd.observation_facts(_observations(spark, d), tb.turns(spark, d)).select(
        "conv_id", "node_id", "text", "time", "confidence",
        joined("support_ids").alias("support_ids"), joined("support_texts").alias("support_texts"),
    )


@query("support_id_parsing_N08", "WITH " + TURNS_SQL + """forms AS (
  SELECT conv_id, pos, 'list' AS form, turn_id AS parsed FROM turns UNION ALL
  SELECT conv_id, pos, 'comma', turn_id || '|' || speaker FROM turns UNION ALL
  SELECT conv_id, pos, 'single', turn_id FROM turns UNION ALL SELECT conv_id, pos, 'null', '' FROM turns)
SELECT * FROM forms""")
def _(spark, d):
    t = tb.turns(spark, d)
    forms = F.array(
        F.struct(F.lit("list").alias("form"), F.concat(F.lit("['"), "turn_id", F.lit("']")).alias("value")),
        F.struct(F.lit("comma").alias("form"), F.concat("turn_id", F.lit(", "), "speaker").alias("value")),
        F.struct(F.lit("single").alias("form"), F.col("turn_id").alias("value")),
        F.struct(F.lit("null").alias("form"), F.lit(None).cast("string").alias("value")),
    )
    return t.select("conv_id", "pos", F.inline(forms)).select(
        "conv_id", "pos", "form", joined(tx.parse_support_ids("value")).alias("parsed")
    )


def _document_facts(spark, d):
    """Documents as rule facts: the source is the conversation, the language the speaker."""
    return tb.table(spark, d, "documents").select(
        F.col("source").alias("conv_id"),
        F.concat(F.col("source"), F.lit(":fact:"), F.col("doc_id").cast("string")).alias("node_id"),
        F.concat(F.initcap("lang"), F.lit(" said: "), tx.squeeze("text")).alias("text"),
        F.initcap("lang").alias("speaker"), F.lit(None).cast("string").alias("time"), F.lit("active").alias("status"),
        F.array(F.concat(F.col("source"), F.lit(":raw:"), F.col("doc_id").cast("string"))).alias("support_ids"),
        F.lit("rule_extracted").alias("source"),
    )


@query("rule_statements_N09")
def _(spark, d):
    return nd.rule_statements(_document_facts(spark, d)).select(
        "conv_id", "node_id", "text", F.round("score", 6).alias("score"), joined("signals").alias("signals"),
        F.round("confidence", 6).alias("confidence"),
    )


SENTENCES_SQL = r"""
sent AS (
  SELECT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS s,
         generate_subscripts(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), 1) AS n
  FROM documents),
marked AS (SELECT doc_id, n, s, regexp_replace(s, '[^\x00-\x7F]', 'z', 'g') AS a FROM sent),
"""


def _sentences(spark, d):
    return tb.table(spark, d, "documents").select(
        "doc_id", F.posexplode(F.split(tx.squeeze("text"), r"(?<=[.!?]) ")).alias("n", "s")
    ).withColumn("n", F.col("n") + 1)


def _flag_sql(pattern: str) -> str:
    return f"regexp_matches(a, '(?i){pattern}')"


FILLER_SQL = r"^(?:thanks(?:\s+[\p{L}\p{M}\p{N}_]+)?|thank you|wow|cool|awesome|great|nice|okay|ok|sure|yeah|yep|aww|haha)\s*[,!.-]*\s*"
LEAD_SQL = r"^(?:by the way|btw|actually|well)\s*[,!.-]*\s*"


@query("clause_cleaning_N10", "WITH " + SENTENCES_SQL + f"""
stripped AS (
  SELECT doc_id, n, trim(regexp_replace(regexp_replace(s, '(?i){FILLER_SQL}', ''), '(?i){LEAD_SQL}', '')) AS v
  FROM marked),
judged AS (SELECT *, regexp_replace(v, '[^\\x00-\\x7F]', 'z', 'g') AS a FROM stripped)
SELECT doc_id, n::INTEGER AS n, v AS clause FROM judged
WHERE v <> '' AND NOT v LIKE '%?'
  AND NOT {_flag_sql('^(?:what|when|where|who|why|how|did|do|does|is|are|was|were|can|could|would|will|have|has)' + chr(92) + 'b')}
  AND NOT {_flag_sql('^(?:thanks|thank you|wow|cool|awesome|great|nice|okay|ok|sure|yeah|yep|aww|haha)[!,. ]*$')}
  AND NOT {_flag_sql("^(?:that|it|this) (?:is|''s|sounds|looks) (?:great|awesome|cool|nice|amazing|wonderful|impressive|fantastic|inspiring)[!,. ]*$")}
  AND NOT {_flag_sql('^(?:i agree|sounds good|good luck|congratulations|congrats)[!,. ]*$')}
""")
def _(spark, d):
    return _sentences(spark, d).select("doc_id", "n", nd.clean_clause(F.col("s")).alias("clause")).filter("clause IS NOT NULL")


def _cue_sql(name: str) -> str:
    return _flag_sql(rf"\b(?:{nd.SIGNAL_PATTERNS[name]})\b")


@query("clause_quality_N11", "WITH " + SENTENCES_SQL + f"""
f AS (
  SELECT doc_id, n, s, len({content_terms_sql('s')}) AS terms, len(string_split(s, ' ')) AS words,
    {_flag_sql(r"\b(?:i|i''m|i''ve|i''d|me|my|mine|we|we''re|we''ve|us|our|ours)\b")} AS p1,
    {_flag_sql(r"\b(?:you|your|yours|you''re|you''ve)\b")} AS p2,
    {_flag_sql(r"\b(?:because|so that|which|who|where|when)\b")} AS conn,
    list_filter([{', '.join(f"CASE WHEN {_cue_sql(k)} THEN '{k}' END" for k in nd.SIGNAL_PATTERNS)}], lambda x: x IS NOT NULL) AS sig
  FROM marked)
SELECT doc_id, n::INTEGER AS n, array_to_string(sig, '|') AS signals,
  round(CASE WHEN words < 5 OR terms < 3 OR (p2 AND NOT p1) OR NOT (list_contains(sig, 'state') OR list_contains(sig, 'event')) THEN 0::DOUBLE
   ELSE greatest(0::DOUBLE, least(1::DOUBLE, 0.2::DOUBLE + least(0.2::DOUBLE, 0.025::DOUBLE * terms) + least(0.35::DOUBLE, 0.1::DOUBLE * len(sig))
     + CASE WHEN words BETWEEN 7 AND 45 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN p1 THEN 0.08::DOUBLE ELSE 0 END
     + CASE WHEN conn THEN 0.04::DOUBLE ELSE 0 END - CASE WHEN words > 65 THEN 0.12::DOUBLE ELSE 0 END)) END, 6) AS score
FROM f""")
def _(spark, d):
    signals = nd.clause_signals(F.col("s"))
    return _sentences(spark, d).withColumn("sig", signals).select(
        "doc_id", "n", joined("sig").alias("signals"), F.round(nd.clause_score(F.col("s"), F.col("sig")), 6).alias("score")
    )


@query("first_person_rewrite_N12")
def _(spark, d):
    return _sentences(spark, d).select("doc_id", "n", nd.rewrite_first_person(F.col("s"), F.lit("James")).alias("text"))


def _mixed_facts(spark, d):
    obs = nd.observation_facts(_observations(spark, d), tb.turns(spark, d)).select(
        "conv_id", "node_id", "text", "time", "source", "status", "support_ids", "speaker"
    )
    return tb.fact_nodes(spark, d).select(obs.columns).unionByName(obs)


CANON_SQL = "WITH " + NODES_SQL + OBSERVATIONS_SQL + """
covered AS (SELECT conv_id, conv_id || ':raw:' || t1 AS raw_id FROM obs UNION SELECT conv_id, conv_id || ':raw:' || t0 FROM obs),
rules AS (SELECT f.conv_id, f.node_id, c.raw_id IS NOT NULL AS is_covered FROM facts f
          LEFT JOIN covered c ON c.conv_id = f.conv_id AND c.raw_id = f.raw_id),
obs_facts AS (SELECT conv_id, conv_id || ':fact:obs:' || lpad(CAST(obs_no AS VARCHAR), 4, '0') AS node_id, 'canonical' AS role FROM obs)
"""


@query("canonical_fact_policy_none_N13", CANON_SQL + """
SELECT * FROM obs_facts UNION ALL
SELECT conv_id, node_id, CASE WHEN is_covered THEN 'alias' ELSE 'rejected' END FROM rules""")
def _(spark, d):
    return nd.canonical_facts(_mixed_facts(spark, d), "none").select("conv_id", "node_id", "role")


@query("canonical_fact_policy_random_N13", CANON_SQL + """,
drawn AS (SELECT node_id FROM rules WHERE NOT is_covered ORDER BY md5(node_id || '|13'), node_id LIMIT 40)
SELECT * FROM obs_facts UNION ALL
SELECT conv_id, node_id, CASE WHEN is_covered THEN 'alias' WHEN node_id IN (SELECT node_id FROM drawn) THEN 'canonical' ELSE 'rejected' END FROM rules""")
def _(spark, d):
    return nd.canonical_facts(_mixed_facts(spark, d), "random", sample_size=40).select("conv_id", "node_id", "role")


@query("canonical_fact_policy_filtered_N13")
def _(spark, d):
    return nd.canonical_facts(_mixed_facts(spark, d), "filtered")


@query("entity_tokens_N14", f"""
WITH e AS (SELECT doc_id, {names_sql('text')} AS w FROM documents),
u AS (SELECT doc_id, list_filter(w, lambda t, i: list_position(w, t) = i) AS names FROM e)
SELECT doc_id, array_to_string(names, '|') AS names,
 array_to_string(list_filter(names, lambda t: NOT list_contains(['What','When','Where','Which','Would','Could','Should','The','How','Why'], t)), '|') AS query_names FROM u""")
def _(spark, d):
    return tb.table(spark, d, "documents").select(
        "doc_id", joined(tx.name_tokens("text")).alias("names"), joined(tx.query_names("text")).alias("query_names")
    )


ENTITY_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.ENTITY_TERM_STOPWORDS) + "]"
GENERIC_SQL = "[" + ", ".join(f"'{w}'" for w in tx.GENERIC_NAMES) + "]"


def normalize_entity_sql(expr: str) -> str:
    return (
        f"CASE WHEN list_contains({GENERIC_SQL}, {expr}) OR {expr} = '' THEN '' ELSE "
        f"array_to_string(list_filter({lexical_sql(expr)}, lambda t: NOT list_contains({ENTITY_STOP_SQL}, t)), '_') END"
    )


@query("fact_entity_ranking_N15", f"""
WITH f AS (SELECT source AS conv_id, doc_id AS fact_id, upper(left(lang, 1)) || substr(lang, 2) AS speaker, {names_sql('text')} AS w,
     'e' || (doc_id // 6) AS event_id FROM documents),
u AS (SELECT conv_id, fact_id, unnest(w) AS entity, generate_subscripts(w, 1) AS seen FROM f),
intext AS (SELECT conv_id, fact_id, entity, 2.0::DOUBLE AS weight, 0 AS stage, min(seen) AS seen FROM u
           WHERE NOT list_contains({GENERIC_SQL}, entity) GROUP BY ALL),
spoken AS (SELECT conv_id, fact_id, speaker AS entity, 3.0::DOUBLE, 1, 0 FROM f),
ev AS (SELECT DISTINCT conv_id, event_id, speaker AS entity FROM f),
byev AS (SELECT f.conv_id, f.fact_id, ev.entity, 1.5::DOUBLE, 2, 0 FROM f JOIN ev USING (conv_id, event_id)),
byep AS (SELECT f.conv_id, f.fact_id, 'Ep ' || f.event_id AS entity, 0.75::DOUBLE, 3, 0 FROM f),
rows_ AS (SELECT * FROM intext UNION ALL SELECT * FROM spoken UNION ALL SELECT * FROM byev UNION ALL SELECT * FROM byep),
keyed AS (SELECT *, {normalize_entity_sql('entity')} AS entity_key FROM rows_),
tot AS (SELECT conv_id, fact_id, entity_key, sum(weight) AS weight, arg_min(entity, (stage, seen, entity)) AS entity
        FROM keyed WHERE entity_key <> '' OR stage = 1 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fact_id ORDER BY weight DESC, entity_key) AS rank FROM tot)
SELECT conv_id, fact_id, entity_key, weight, entity, rank::INTEGER AS rank FROM rk WHERE rank <= 4""")
def _(spark, d):
    docs = tb.table(spark, d, "documents").select(
        F.col("source").alias("conv_id"), F.col("doc_id").alias("node_id"), "text", F.initcap("lang").alias("speaker"),
        F.concat(F.lit("e"), F.floor(F.col("doc_id") / 6).cast("string")).alias("event_id"),
    )
    fact_event = docs.select("conv_id", F.col("node_id").alias("fact_id"), "event_id")
    events = docs.select("conv_id", "event_id", F.col("speaker").alias("entity"), F.lit(0).alias("seen")).distinct()
    episodes = docs.select("conv_id", "event_id", F.col("event_id").alias("episode_id")).distinct()
    episode_entities = episodes.select(
        "conv_id", "episode_id", F.concat(F.lit("Ep "), "episode_id").alias("entity"), F.lit(0).alias("seen")
    )
    return nd.rank_entities(docs, fact_event, events, episodes, episode_entities)


@query("entity_normalisation_N16", f"""
WITH w AS (SELECT DISTINCT unnest({names_sql('text')}) AS name FROM documents)
SELECT name, {normalize_entity_sql('name')} AS entity_key,
  {normalize_entity_sql("(name || ' said And ' || name)")} AS pair_key FROM w""")
def _(spark, d):
    names = tb.table(spark, d, "documents").select(F.explode(tx.name_tokens("text")).alias("name")).distinct()
    pair = F.concat("name", F.lit(" said And "), "name")
    return names.select("name", tx.normalize_entity("name").alias("entity_key"), tx.normalize_entity(pair).alias("pair_key"))


@query("session_canonicalisation_N17", "WITH " + TURNS_SQL + """x AS (
 SELECT conv_id, pos, 'raw' AS form, session_id AS session FROM turns UNION ALL SELECT conv_id, pos, 'turn', session_id FROM turns
 UNION ALL SELECT conv_id, pos, 'key', session_id FROM turns UNION ALL SELECT conv_id, pos, 'plain', speaker FROM turns)
SELECT * FROM x""")
def _(spark, d):
    forms = F.array(
        F.struct(F.lit("raw").alias("form"), F.concat_ws(":raw:", "conv_id", "turn_id").alias("v")),
        F.struct(F.lit("turn").alias("form"), F.col("turn_id").alias("v")),
        F.struct(F.lit("key").alias("form"), F.regexp_replace("session_id", "^D", "session_0").alias("v")),
        F.struct(F.lit("plain").alias("form"), F.col("speaker").alias("v")),
    )
    return tb.turns(spark, d).select("conv_id", "pos", F.inline(forms)).select(
        "conv_id", "pos", "form", tx.canonical_session("v").alias("session")
    )


@query("anchor_confidence_N18", """
SELECT event_id, round(1 / (1 + exp(-(1.2*(value/100) + 0.8*((user_id%5)/5.0::DOUBLE)
   + CASE WHEN event_type = 'click' THEN 1.0 WHEN event_type = 'view' THEN 0.7 WHEN event_type = 'error' THEN 0.55 ELSE 0.4 END
   + 0.5*((event_id%7)/7.0::DOUBLE) - 1.2*((event_id%3)/3.0::DOUBLE) - 0.8*((event_id%2)/2.0::DOUBLE)))), 6) AS confidence FROM events""")
def _(spark, d):
    source = F.when(F.col("event_type") == "click", "raw_dialogue").when(F.col("event_type") == "view", "Summary").when(
        F.col("event_type") == "error", "rule_inferred").otherwise("manual")
    part = lambda c, n: (F.col(c) % n) / F.lit(float(n))
    return tb.table(spark, d, "events").select(
        "event_id",
        F.round(nd.anchor_confidence(F.col("value") / 100, part("user_id", 5), nd.source_weight(source),
                                     part("event_id", 7), part("event_id", 3), part("event_id", 2)), 6).alias("confidence"),
    )


def hash_embedding_sql(source: str, key: str, text: str, dim: int) -> str:
    """CTEs ``cells`` and ``vec`` (dense list) of the hashed embedding of ``source``."""
    return f"""
hv AS (SELECT {key} AS k, ('0x' || left(md5(t), 8))::BIGINT AS v FROM (SELECT {key}, unnest({lexical_sql(text)}) AS t FROM {source})),
cells AS (SELECT k, v % {dim} AS b, sum(CASE WHEN (v >> 8) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS c FROM hv GROUP BY ALL),
size_ AS (SELECT k, sqrt(sum(c * c)) AS s FROM cells GROUP BY k),
grid AS (SELECT q.k, i.i, coalesce(c.c / nullif(s.s, 0), 0.0::DOUBLE) AS x FROM (SELECT {key} AS k FROM {source}) q CROSS JOIN range(0, {dim}) i(i)
         LEFT JOIN cells c ON c.k = q.k AND c.b = i.i LEFT JOIN size_ s ON s.k = q.k),
vec AS (SELECT k, list(x ORDER BY i) AS vector FROM grid GROUP BY k)"""


@query("hash_embedding_N19", "WITH " + hash_embedding_sql("documents", "doc_id", "text", 31) + """
SELECT k AS doc_id, array_to_string(list_transform(vector, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',') AS cells FROM vec""")
def _(spark, d):
    vectors = nd.hash_embedding(tb.table(spark, d, "documents"), ["doc_id"], 31)
    return vectors.select(
        "doc_id", F.array_join(F.transform("vector", lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",").alias("cells")
    )


@query("fact_order_key_N20", "WITH " + TURNS_SQL + """x AS (SELECT 1)
SELECT conv_id, pos, 'D' || lpad(CAST(pos // 4 + 1 AS VARCHAR), 4, '0') AS session, (pos + 1)::BIGINT AS number, turn_id AS id FROM turns""")
def _(spark, d):
    return tb.turns(spark, d).select("conv_id", "pos", tx.turn_order("turn_id").alias("o")).select(
        "conv_id", "pos", "o.session", "o.number", "o.id"
    )


@query("fact_view_known_entities_N21", "WITH " + NODES_SQL + f"""
known AS (SELECT DISTINCT conv_id, speaker FROM facts),
men AS (SELECT conv_id, node_id, unnest({names_sql('text')}) AS entity FROM facts),
ents AS (SELECT m.conv_id, m.node_id, m.entity FROM men m JOIN known k ON k.conv_id = m.conv_id AND k.speaker = m.entity
         UNION SELECT conv_id, node_id, speaker FROM facts),
agg AS (SELECT conv_id, node_id, string_agg(entity, '|' ORDER BY entity) AS entities FROM ents GROUP BY ALL)
SELECT f.conv_id, f.node_id, f.session_id AS session, a.entities, len({term_set_sql('f.text')})::INTEGER AS terms
FROM facts f JOIN agg a USING (conv_id, node_id)""")
def _(spark, d):
    facts = tb.fact_nodes(spark, d)
    return nd.fact_views(facts, nd.known_speakers(facts)).select(
        "conv_id", "node_id", "session", joined("entities").alias("entities"), F.size("terms").alias("terms")
    )
