"""Turns to typed nodes: RAW, FACT and ANCHOR rows, observation facts, rule statements, entity ranks."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from memloom.functions import text as tx
from memloom.operators.ordering import dense_ordinal
from memloom.session import cut_lineage

NODE_COLUMNS = [
    "conv_id", "node_id", "type", "text", "time", "source", "status", "confidence", "support_ids", "pos",
    "turn_id", "speaker", "session_id",
]


def clean_turns(turns: DataFrame) -> DataFrame:
    """Whitespace-normalised turns without blanks; missing turn ids and speakers get their defaults."""
    spoken = F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit("unknown"))
    named = F.coalesce(
        F.nullif(F.col("turn_id"), F.lit("")), F.concat(F.lit("t"), F.lpad((F.col("pos") + 1).cast("string"), 4, "0"))
    )
    return (
        turns.filter(F.col("text").rlike(r"(?U)\S"))
        .withColumn("turn_id", named)
        .withColumn("speaker", spoken)
        .withColumn("text", tx.squeeze("text"))
    )


def raw_nodes(turns: DataFrame) -> DataFrame:
    return _raw_nodes(clean_turns(turns))


def _raw_nodes(clean: DataFrame) -> DataFrame:
    return clean.select(
        "conv_id",
        F.concat_ws(":raw:", "conv_id", "turn_id").alias("node_id"),
        F.lit("RAW").alias("type"),
        F.concat_ws(": ", "speaker", "text").alias("text"),
        F.col("ts").alias("time"),
        F.lit("raw_dialogue").alias("source"),
        F.lit("active").alias("status"),
        F.lit(1.0).alias("confidence"),
        F.array().cast("array<string>").alias("support_ids"),
        "pos", "turn_id", "speaker", "session_id",
    )


def fact_nodes(turns: DataFrame) -> DataFrame:
    return _fact_nodes(clean_turns(turns))


def _fact_nodes(clean: DataFrame) -> DataFrame:
    said = F.concat_ws(" said: ", "speaker", "text")
    return clean.select(
        "conv_id",
        F.concat_ws(":fact:", "conv_id", "turn_id").alias("node_id"),
        F.lit("FACT").alias("type"),
        said.alias("text"),
        F.col("ts").alias("time"),
        F.lit("rule_extracted").alias("source"),
        tx.infer_status(said).alias("status"),
        F.lit(0.72).alias("confidence"),
        F.array(F.concat_ws(":raw:", "conv_id", "turn_id")).alias("support_ids"),
        "pos", "turn_id", "speaker", "session_id",
    )


def anchor_members(turns: DataFrame) -> DataFrame:
    """One row per fact with the number of the anchor it belongs to (no list is built here)."""
    labelled = _labelled(clean_turns(turns))
    return labelled.join(_anchors(labelled), ["conv_id", "anchor_key"]).select(
        "conv_id", "node_id",
        F.col("label").alias("text"),
        F.col("first_time").alias("time"),
        F.col("first_pos").alias("pos"),
        "anchor_no",
        F.concat_ws(":fact:", "conv_id", "turn_id").alias("fact_id"),
        F.col("pos").alias("fact_pos"),
    )


def _labelled(clean: DataFrame) -> DataFrame:
    return clean.select(
        "conv_id", "pos", "turn_id", "ts", tx.anchor_text(F.col("text")).alias("anchor_text")
    ).withColumn("anchor_key", F.lower("anchor_text"))


def _anchors(labelled: DataFrame) -> DataFrame:
    """Topic labels of a conversation, numbered by their first turn."""
    firsts = labelled.groupBy("conv_id", "anchor_key").agg(
        F.min("pos").alias("first_pos"),
        F.min_by("anchor_text", "pos").alias("label"),
        F.min_by("ts", "pos").alias("first_time"),
    )
    return dense_ordinal(firsts, ["conv_id"], "first_pos", "anchor_no").withColumn("anchor_no", F.col("anchor_no") + 1).withColumn(
        "node_id", F.concat(F.col("conv_id"), F.lit(":anchor:"), pad_number(F.col("anchor_no"))))


def pad_number(number: Column, width: int = 4) -> Column:
    """Zero-padded number that keeps all digits of longer numbers."""
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def anchor_nodes(turns: DataFrame) -> DataFrame:
    """One ANCHOR per distinct topic label.

    Its facts stay rows of :func:`anchor_members`: a label shared by a third of a corpus would not fit a list.
    """
    return _anchor_nodes(_labelled(clean_turns(turns)))


def _anchor_nodes(labelled: DataFrame) -> DataFrame:
    empty = F.lit(None).cast("string")
    return _anchors(labelled).select(
        "conv_id", "node_id",
        F.lit("ANCHOR").alias("type"),
        F.col("label").alias("text"),
        F.col("first_time").alias("time"),
        F.lit("rule_inferred_anchor").alias("source"),
        F.lit("active").alias("status"),
        F.lit(0.58).alias("confidence"),
        F.array().cast("array<string>").alias("support_ids"),
        F.col("first_pos").alias("pos"),
        empty.alias("turn_id"), empty.alias("speaker"), empty.alias("session_id"),
    )


def extract_nodes(turns: DataFrame) -> DataFrame:
    """RAW, FACT and ANCHOR rows; turns are cleaned and labelled once, into a stored table."""
    clean = clean_turns(turns)
    clean = cut_lineage(clean.withColumn("anchor_text", tx.anchor_text(F.col("text"))))
    labelled = clean.withColumn("anchor_key", F.lower("anchor_text"))
    return _raw_nodes(clean).unionByName(_fact_nodes(clean)).unionByName(_anchor_nodes(labelled))


def observation_facts(observations: DataFrame, turns: DataFrame) -> DataFrame:
    """Facts from an observation table ``(conv_id, obs_no, session_key, speaker, text, support)``.

    ``support`` is the free-form support value; unknown turn ids keep their raw id but add no text or time.
    """
    parsed = observations.withColumn("support_turn_ids", tx.parse_support_ids("support"))
    known = turns.groupBy("conv_id", "turn_id").agg(
        F.max_by(F.struct("speaker", "text", "ts"), "pos").alias("turn")
    )
    exploded = parsed.select(
        "conv_id", "obs_no", F.col("speaker").alias("said_by"), F.posexplode("support_turn_ids").alias("sup_pos", "turn_id")
    ).join(known, ["conv_id", "turn_id"])
    supports = exploded.groupBy("conv_id", "obs_no").agg(
        F.array_sort(F.collect_list(F.struct("sup_pos", "turn", "said_by"))).alias("found")
    )
    quotes = F.filter(F.col("found"), lambda f: tx.squeeze(F.coalesce(f["turn"]["text"], F.lit(""))) != "")
    stamped = F.filter(F.col("found"), lambda f: F.coalesce(f["turn"]["ts"], F.lit("")) != "")
    raw_ids = F.transform("support_turn_ids", lambda t: F.concat_ws(":raw:", F.col("conv_id"), t))
    return parsed.join(supports, ["conv_id", "obs_no"], "left").select(
        "conv_id",
        F.concat(F.col("conv_id"), F.lit(":fact:obs:"), pad_number(F.col("obs_no"))).alias("node_id"),
        F.lit("FACT").alias("type"),
        tx.squeeze("text").alias("text"),
        F.coalesce(F.transform(stamped, lambda f: f["turn"]["ts"]), F.array().cast("array<string>")).alias(
            "support_timestamps"
        ),
        F.lit("locomo_observation").alias("source"),
        F.lit("active").alias("status"),
        F.lit(0.86).alias("confidence"),
        raw_ids.alias("support_ids"),
        F.coalesce(
            F.transform(
                quotes,
                lambda f: F.concat_ws(": ", F.coalesce(f["turn"]["speaker"], f["said_by"]), tx.squeeze(f["turn"]["text"])),
            ),
            F.array().cast("array<string>"),
        ).alias("support_texts"),
        "session_key", "speaker", "support_turn_ids", "obs_no",
    ).withColumn("time", F.get("support_timestamps", F.lit(0)))


# --- rule statements -------------------------------------------------------------------------------------

# Cue patterns of the clause scorer.
SIGNAL_PATTERNS = {
    "event": r"went|go|visited|traveled|travelled|started|finished|joined|attended|bought|made|created|painted"
             r"|played|won|lost|met|adopted|moved|changed|received|celebrated|camped|hiked|learned|decided|booked"
             r"|applied|graduated|married|divorced|helped|volunteered|built|wrote|read|watched|cooked|having|enjoying",
    "number": r"\d+(?:st|nd|rd|th)?",
    "relation": r"mother|father|mom|dad|parent|parents|sister|brother|husband|wife|partner|friend|friends|daughter"
                r"|son|children|kids|family|mentor|colleague",
    "state": r"am|is|are|was|were|have|has|had|live|lives|work|works|study|studies|like|likes|love|loves|prefer"
             r"|prefers|want|wants|plan|plans|hope|hopes|need|needs|feel|feels|believe|believes|know|knows|own|owns",
    "time": r"today|tonight|yesterday|tomorrow|last|next|ago|recently|currently|monday|tuesday|wednesday|thursday"
            r"|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november"
            r"|december",
}
FILLER = r"(?iU)^(?:thanks(?:\s+\w+)?|thank you|wow|cool|awesome|great|nice|okay|ok|sure|yeah|yep|aww|haha)\s*[,!.-]*\s*"
LEAD_IN = r"(?iU)^(?:by the way|btw|actually|well)\s*[,!.-]*\s*"
QUESTION_START = (
    r"(?iU)^(?:what|when|where|who|why|how|did|do|does|is|are|was|were|can|could|would|will|have|has)\b"
)
LOW_INFORMATION = [
    r"(?iU)^(?:thanks|thank you|wow|cool|awesome|great|nice|okay|ok|sure|yeah|yep|aww|haha)[!,. ]*$",
    r"(?iU)^(?:that|it|this) (?:is|'s|sounds|looks) "
    r"(?:great|awesome|cool|nice|amazing|wonderful|impressive|fantastic|inspiring)[!,. ]*$",
    r"(?iU)^(?:i agree|sounds good|good luck|congratulations|congrats)[!,. ]*$",
]
FIRST_PERSON = r"(?iU)\b(?:i|i'm|i've|i'd|me|my|mine|we|we're|we've|us|our|ours)\b"
SECOND_PERSON = r"(?iU)\b(?:you|your|yours|you're|you've)\b"
CONNECTIVE = r"(?iU)\b(?:because|so that|which|who|where|when)\b"
# First-person openings with the words that follow the speaker's name.
OPENING_REWRITES = [
    ("I'm", " is"), ("I am", " is"), ("I've", " has"), ("I have", " has"), ("I'd", " would"), ("I'll", " will"),
    ("I", ""), ("My", "'s"), ("We're", " and others are"), ("We've", " and others have"), ("We", " and others"),
    ("Our", " and others'"),
]
GLOBAL_REWRITES = [
    ("I'm", " is"), ("I've", " has"), ("I'd", " would"), ("I'll", " will"), ("I", ""), ("me", ""), ("my", "'s"),
    ("mine", "'s"), ("We're", " and others are"), ("We've", " and others have"), ("We", " and others"),
    ("us", " and others"), ("our", " and others'"),
]


def clean_clause(text: Column) -> Column:
    """Clause without filler; null for questions and low-information replies."""
    stripped = F.regexp_replace(tx.squeeze(text), FILLER, "")
    stripped = F.trim(F.regexp_replace(stripped, LEAD_IN, ""))

    def keep(value: Column) -> Column:
        reject = (value == "") | value.endswith("?") | value.rlike(QUESTION_START)
        for pattern in LOW_INFORMATION:
            reject = reject | value.rlike(pattern)
        return F.when(~reject, value)

    return tx.let(stripped, keep)


def clause_signals(text: Column) -> Column:
    """Names of the cue groups found in a clause, sorted."""
    return F.array_compact(
        F.array(*[F.when(text.rlike(rf"(?iU)\b(?:{cues})\b"), F.lit(name)) for name, cues in SIGNAL_PATTERNS.items()])
    )


def clause_score(text: Column, signals: Column) -> Column:
    """Quality of a clause in [0, 1]; 0 when it is too short, second-person only or carries no statement."""
    terms = F.size(tx.content_terms(text))
    words = F.size(F.split(tx.squeeze(text), " "))
    first, second = text.rlike(FIRST_PERSON), text.rlike(SECOND_PERSON)
    stated = F.arrays_overlap(signals, F.array(F.lit("state"), F.lit("event")))
    score = (
        F.lit(0.20)
        + F.least(F.lit(0.20), F.lit(0.025) * terms)
        + F.least(F.lit(0.35), F.lit(0.10) * F.size(signals))
        + F.when(words.between(7, 45), 0.10).otherwise(0.0)
        + F.when(first, 0.08).otherwise(0.0)
        + F.when(text.rlike(CONNECTIVE), 0.04).otherwise(0.0)
        - F.when(words > 65, 0.12).otherwise(0.0)
    )
    blocked = (words < 5) | (terms < 3) | (second & ~first) | ~stated
    return F.when(blocked, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def end_sentence(text: Column) -> Column:
    value = F.trim(text)
    return F.when((value == "") | value.rlike(r"[.!?]$"), value).otherwise(F.concat(value, F.lit(".")))


def rewrite_first_person(text: Column, speaker: Column) -> Column:
    """First-person clause told about its speaker."""
    name = F.regexp_replace(speaker, r"([\\$])", r"\\$1")

    def rewritten(value: Column) -> Column:
        opened = value
        for opening, tail in reversed(OPENING_REWRITES):
            pattern = rf"(?iU)^{opening}\b"
            opened = F.when(
                value.rlike(pattern), F.regexp_replace(value, F.lit(pattern), F.concat(name, F.lit(tail)))
            ).otherwise(opened)
        changed = opened
        for word, tail in GLOBAL_REWRITES:
            changed = F.regexp_replace(changed, F.lit(rf"(?iU)\b{word}\b"), F.concat(name, F.lit(tail)))
        return tx.let(changed, lambda c: _told(value, c, speaker))

    return tx.let(F.trim(text), lambda v: F.when(speaker == "", end_sentence(v)).otherwise(rewritten(v)))


def _told(original: Column, changed: Column, speaker: Column) -> Column:
    """Statements the rewrites left alone are attributed to the speaker."""
    untouched = (changed == original) & ~F.startswith(F.lower(changed), F.lower(speaker))
    stated = F.concat(
        speaker, F.lit(" stated that "), F.lower(F.left(changed, F.lit(1))), F.substring(changed, 2, 1 << 30)
    )
    return end_sentence(F.when(untouched, stated).otherwise(changed))


def rule_statements(facts: DataFrame) -> DataFrame:
    """Best informative sentence of each rule fact, rewritten about its speaker (0 or 1 row per fact)."""
    prefix = F.concat(F.col("speaker"), F.lit(" said:"))
    body = F.when(
        (F.col("speaker") != "") & F.startswith(F.lower(F.trim("text")), F.lower(prefix)),
        F.trim(F.substring(F.trim("text"), F.length(prefix) + 1, F.length("text"))),
    ).otherwise(F.trim("text"))
    judged = F.transform(
        F.split(body, r"(?<=[.!?])(?U)\s+"),
        lambda sentence: tx.let(clean_clause(sentence), lambda c: F.struct(c.alias("clause"), clause_signals(c).alias("signals"))),
    )
    sentences = (
        facts.withColumn("speaker", F.trim(F.coalesce("speaker", F.lit(""))))
        .select("conv_id", "node_id", "speaker", "time", "status", "support_ids", F.posexplode(judged).alias("sent_no", "j"))
        .filter(F.col("j.clause").isNotNull())
        .select("conv_id", "node_id", "speaker", "time", "status", "support_ids", "sent_no", "j.clause", "j.signals")
        .withColumn("score", clause_score(F.col("clause"), F.col("signals")))
        .filter(F.col("score") > 0)
    )
    best = sentences.groupBy("conv_id", "node_id").agg(
        F.min_by(
            F.struct("speaker", "time", "status", "support_ids", "clause", "signals", "score"),
            F.struct(-F.col("score"), F.col("sent_no")),
        ).alias("b")
    ).select("conv_id", F.col("node_id").alias("source_fact_id"), "b.*")
    suffix = F.regexp_extract("source_fact_id", r"(?s):fact:(.*)$", 1)
    return best.select(
        "conv_id",
        F.concat(F.col("conv_id"), F.lit(":fact:rule_sem:"), suffix).alias("node_id"),
        "source_fact_id",
        rewrite_first_person(F.col("clause"), F.col("speaker")).alias("text"),
        "time",
        F.lit("filtered_rule_statement").alias("source"),
        "status",
        F.least(F.lit(0.88), F.lit(0.62) + F.lit(0.28) * F.col("score")).alias("confidence"),
        "support_ids", "speaker", "score", "signals",
    )


def rule_coverage(facts: DataFrame) -> DataFrame:
    """Rule facts with the flag whether observations already support all of their raw turns.

    Works on exploded supports with joins, so a conversation's covered set is never gathered in one row.
    """
    supports = facts.select("conv_id", "node_id", "source", F.explode("support_ids").alias("raw_id"))
    observed = (
        supports.filter(F.col("source").isin("locomo_observation", "sentence_fact"))
        .select("conv_id", "raw_id").distinct().withColumn("covered", F.lit(1))
    )
    per_rule = (
        supports.filter(F.col("source") == "rule_extracted")
        .join(observed, ["conv_id", "raw_id"], "left")
        .groupBy("conv_id", "node_id")
        .agg(F.min(F.coalesce("covered", F.lit(0))).alias("all_covered"))
    )
    return facts.filter(F.col("source") == "rule_extracted").join(per_rule, ["conv_id", "node_id"], "left").withColumn(
        "is_covered", F.coalesce(F.col("all_covered") == 1, F.lit(False))
    ).drop("all_covered")


def canonical_facts(
    facts: DataFrame, policy: str = "none", threshold: float = 0.60, sample_size: int = 944, seed: int = 13
) -> DataFrame:
    """Role of each fact in the hierarchy: ``canonical``, ``alias`` or ``rejected``.

    Observations are canonical; covered rules are aliases; the rest follows ``policy``. The seeded sample
    orders rules by a hash of id and seed over the whole graph.
    """
    if policy not in {"none", "filtered", "random", "all"}:
        raise ValueError(f"unsupported policy: {policy}")
    columns = ["conv_id", "node_id", "role", "derived_id"]
    none = F.lit(None).cast("string")
    observed = facts.filter(F.col("source").isin("locomo_observation", "sentence_fact")).select(
        "conv_id", "node_id", F.lit("canonical").alias("role"), none.alias("derived_id")
    )
    rules = rule_coverage(facts)
    covered = rules.filter("is_covered").select(
        "conv_id", "node_id", F.lit("alias").alias("role"), none.alias("derived_id")
    )
    open_rules = rules.filter("NOT is_covered").drop("is_covered")
    if policy == "all":
        rest = open_rules.select("conv_id", "node_id", F.lit("canonical").alias("role"), none.alias("derived_id"))
    elif policy == "filtered":
        good = rule_statements(open_rules).filter(F.col("score") >= threshold).select(
            "conv_id", F.col("source_fact_id").alias("node_id"), F.col("node_id").alias("derived_id")
        )
        rest = open_rules.join(good, ["conv_id", "node_id"], "left").select(
            "conv_id", "node_id",
            F.when(F.col("derived_id").isNotNull(), "alias").otherwise("rejected").alias("role"), "derived_id",
        )
        derived = good.select("conv_id", F.col("derived_id").alias("node_id"), F.lit("canonical").alias("role"),
                              none.alias("derived_id"))
        rest = rest.unionByName(derived)
    elif policy == "random":
        drawn = (
            open_rules.select("conv_id", "node_id", F.md5(F.concat_ws("|", "node_id", F.lit(str(seed)))).alias("draw"))
            .orderBy("draw", "node_id").limit(sample_size).select("conv_id", "node_id", F.lit(1).alias("drawn"))
        )
        rest = open_rules.join(drawn, ["conv_id", "node_id"], "left").select(
            "conv_id", "node_id",
            F.when(F.col("drawn") == 1, "canonical").otherwise("rejected").alias("role"), none.alias("derived_id"),
        )
    else:
        rest = open_rules.select("conv_id", "node_id", F.lit("rejected").alias("role"), none.alias("derived_id"))
    return observed.select(columns).unionByName(covered.select(columns)).unionByName(rest.select(columns))


# --- entities --------------------------------------------------------------------------------------------


def known_speakers(nodes: DataFrame) -> DataFrame:
    """Distinct speakers per conversation."""
    return (
        nodes.filter(F.col("type").isin("RAW", "FACT") & (F.trim(F.coalesce("speaker", F.lit(""))) != ""))
        .select("conv_id", F.trim("speaker").alias("entity")).distinct()
    )


def fact_entities(facts: DataFrame, speakers: DataFrame) -> DataFrame:
    """(fact, entity) rows: capitalised words that name a known speaker, plus the fact's own speaker."""
    mentioned = facts.select("conv_id", "node_id", F.explode(tx.name_tokens("text")).alias("entity")).join(
        speakers, ["conv_id", "entity"], "left_semi"
    )
    own = facts.filter(F.coalesce("speaker", F.lit("")) != "").select("conv_id", "node_id", F.col("speaker").alias("entity"))
    return mentioned.select("conv_id", "node_id", "entity").unionByName(own).distinct()


def fact_views(facts: DataFrame, speakers: DataFrame) -> DataFrame:
    """Facts with terms, entities, session and sort key, ready for clustering."""
    entities = fact_entities(facts, speakers).groupBy("conv_id", "node_id").agg(
        F.array_sort(F.collect_list("entity")).alias("entities")
    )
    return facts.join(entities, ["conv_id", "node_id"], "left").select(
        "conv_id", "node_id", "text", "speaker", "support_ids",
        F.coalesce(F.nullif("session_id", F.lit("")), F.split("turn_id", ":").getItem(0), F.lit("")).alias("session"),
        tx.term_set("text").alias("terms"),
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
        tx.turn_order("turn_id").alias("order_key"),
        "pos",
    )


def rank_entities(
    facts: DataFrame, fact_event: DataFrame, event_entities: DataFrame, event_episode: DataFrame,
    episode_entities: DataFrame, keep: int = 4,
) -> DataFrame:
    """Weighted entities of each fact: text 2, speaker 3, event 1.5, episode 0.75; the best ``keep`` remain."""
    def weighted(df: DataFrame, weight: float, stage: int) -> DataFrame:
        return df.select("conv_id", "fact_id", "entity", F.lit(weight).alias("weight"), F.lit(stage).alias("stage"), "seen")

    in_text = facts.select(
        "conv_id", F.col("node_id").alias("fact_id"), F.posexplode(tx.name_tokens("text")).alias("seen", "entity")
    ).filter(~F.col("entity").isin(tx.GENERIC_NAMES))
    spoken = facts.filter(F.coalesce("speaker", F.lit("")) != "").select(
        "conv_id", F.col("node_id").alias("fact_id"), F.col("speaker").alias("entity"), F.lit(0).alias("seen")
    )
    by_event = fact_event.join(event_entities, ["conv_id", "event_id"])
    by_episode = fact_event.join(event_episode, ["conv_id", "event_id"]).join(episode_entities, ["conv_id", "episode_id"])
    rows = (
        weighted(in_text, 2.0, 0)
        .unionByName(weighted(spoken, 3.0, 1))
        .unionByName(weighted(by_event, 1.5, 2))
        .unionByName(weighted(by_episode, 0.75, 3))
        .withColumn("entity_key", tx.normalize_entity("entity"))
        .filter((F.col("entity_key") != "") | (F.col("stage") == 1))
    )
    totals = rows.groupBy("conv_id", "fact_id", "entity_key").agg(
        F.sum("weight").alias("weight"), F.min_by("entity", F.struct("stage", "seen", "entity")).alias("entity")
    )
    order = Window.partitionBy("conv_id", "fact_id").orderBy(F.desc("weight"), "entity_key")
    return totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


# --- scores ----------------------------------------------------------------------------------------------


def source_weight(source: Column) -> Column:
    lowered = F.lower(source)
    return (
        F.when(lowered.contains("raw"), 1.0)
        .when(lowered.contains("summary"), 0.7)
        .when(lowered.rlike("inferred|llm"), 0.55)
        .otherwise(0.4)
    )


def anchor_confidence(
    support: Column, repeat: Column, source: Column, recency: Column, conflict: Column, uncertainty: Column
) -> Column:
    raw = 1.2 * support + 0.8 * repeat + source + 0.5 * recency - 1.2 * conflict - 0.8 * uncertainty
    return 1 / (1 + F.exp(-raw))


#: Words whose hashes a task remembers.
HASHED_WORDS = 1 << 17


def hash_embedding(texts: DataFrame, key: list[str], dim: int = 31) -> DataFrame:
    """Signed hashed bag-of-words vectors, unit length, keyed by ``key``; every row is computed by itself.

    A task remembers the hashes of up to ``HASHED_WORDS`` short words, since texts repeat theirs.
    """
    pattern = re.compile(tx.LEXICAL_PATTERN.encode())

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            rows, codes, null = [], [], []
            for row, text in enumerate(batch.column(len(key)).cast(pa.binary()).to_pylist()):
                null.append(text is None)
                # bytes are lowered as ASCII, which tokens are
                for token in pattern.findall(text.lower()) if text is not None else ():
                    code = known.get(token)
                    if code is None:
                        value = int.from_bytes(hashlib.md5(token).digest()[:4], "big")
                        code = 2 * (value % dim) + (value >> 8) % 2
                        if len(token) <= 32:
                            if len(known) >= HASHED_WORDS:
                                known.clear()
                            known[token] = code
                    rows.append(row)
                    codes.append(code)
            codes = np.array(codes, dtype=np.int64)
            cells = np.bincount(np.array(rows, dtype=np.int64) * dim + codes // 2, weights=2.0 * (codes % 2) - 1.0, minlength=len(null) * dim).reshape(-1, dim)
            size = np.sqrt((cells * cells).sum(axis=1, keepdims=True))
            unit = np.where(size > 0, cells / np.where(size > 0, size, 1.0), 0.0)
            starts = pa.array(np.arange(len(null) + 1, dtype=np.int32) * dim, mask=np.array([*null, False]))
            vectors = pa.ListArray.from_arrays(starts, pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(key)], vectors], [*key, "vector"])

    schema = StructType([*(texts.schema[c] for c in key), StructField("vector", ArrayType(DoubleType()))])
    return texts.select(*key, "text").mapInArrow(run, schema)
