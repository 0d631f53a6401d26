"""Retrieval and answer metrics as aggregations; every rate of nothing is 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as tx


RATES = ["hit", "recall", "full_cover"]


def evidence_id(value: Column | str) -> Column:
    """Text after the last ``:raw:`` or ``:fact:`` of an id."""
    text = F.trim(tx.col_of(value))
    return (
        F.when(text.contains(":raw:"), F.regexp_extract(text, r"(?s)^.*:raw:(.*)$", 1))
        .when(text.contains(":fact:"), F.regexp_extract(text, r"(?s)^.*:fact:(.*)$", 1))
        .otherwise(text)
    )


def node_evidence(nodes: DataFrame, raw_supports: bool = False) -> DataFrame:
    """(node, evidence) rows: a RAW node gives its turn, a FACT its own turn and its supports.

    With ``raw_supports`` the node table's extra ``support_raw_ids`` count as well.
    """
    own = nodes.filter("type IN ('RAW', 'FACT') AND turn_id IS NOT NULL AND turn_id <> ''").select(
        "conv_id", "node_id", evidence_id("turn_id").alias("evidence"))
    facts = nodes.filter("type = 'FACT'")
    rows = own.unionByName(facts.select("conv_id", "node_id", F.explode("support_ids").alias("e")).select("conv_id", "node_id", evidence_id("e").alias("evidence")))
    if raw_supports:
        rows = rows.unionByName(facts.select("conv_id", "node_id", F.explode("support_raw_ids").alias("e")).select(
            "conv_id", "node_id", evidence_id("e").alias("evidence")))
    return rows.distinct()


def coverage_rows(questions: DataFrame, found: DataFrame, gold: DataFrame, key: str = "question_id") -> DataFrame:
    """Hit, recall and full cover per question from (question, evidence) rows; no gold gives zeros."""
    wanted = gold.select(key, "evidence").distinct()
    sizes = wanted.groupBy(key).agg(F.count(F.lit(1)).alias("gold"))
    matched = wanted.join(found.select(key, "evidence").distinct(), [key, "evidence"]).groupBy(key).agg(F.count(F.lit(1)).alias("matched"))
    base = questions.select(key).join(sizes, key, "left").join(matched, key, "left").select(
        key, F.coalesce("gold", F.lit(0)).alias("gold"), F.coalesce("matched", F.lit(0)).alias("matched"))
    return base.withColumn("hit", (F.col("matched") > 0).cast("double")).withColumn(
        "recall", F.when(F.col("gold") > 0, F.col("matched") / F.col("gold")).otherwise(0.0)).withColumn(
        "full_cover", ((F.col("gold") > 0) & (F.col("matched") == F.col("gold"))).cast("double"))


def retrieval_rows(questions: DataFrame, paths: DataFrame, nodes: DataFrame, gold: DataFrame, k: int, evidence: DataFrame | None = None) -> DataFrame:
    """Per question: metrics over the distinct nodes of the first ``k`` paths, their words and mean path length.

    ``paths``: (question_id, conv_id, rank, node_ids).
    """
    first = paths.filter(F.col("rank") <= k)
    chosen = first.select("question_id", "conv_id", F.explode("node_ids").alias("node_id")).distinct()
    known = evidence if evidence is not None else node_evidence(nodes)
    found = chosen.join(known, ["conv_id", "node_id"]).select("question_id", "evidence")
    words = chosen.join(nodes.select("conv_id", "node_id", F.size(F.split(F.trim("text"), r"\s+")).alias("words")), ["conv_id", "node_id"]).groupBy(
        "question_id").agg(F.sum("words").alias("tokens"))
    lengths = first.groupBy("question_id").agg(F.avg(F.size("node_ids")).alias("path_len"))
    return coverage_rows(questions, found, gold).join(words, "question_id", "left").join(lengths, "question_id", "left").withColumn(
        "tokens", F.coalesce("tokens", F.lit(0))).withColumn("path_len", F.coalesce("path_len", F.lit(0.0)))


def summarize(rows: DataFrame, means: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Macro means overall or per group."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_questions"), *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in means])


def summarize_with_total(rows: DataFrame, means: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per-group means plus the overall row (group ``ALL``)."""
    rolled = rows.rollup(*keys).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("num_questions"),
        *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in means])
    full = (1 << len(keys)) - 1
    wanted = rolled.filter(F.col("_g").isin(0, full))
    for key in keys:
        wanted = wanted.withColumn(key, F.when(F.col("_g") == full, F.lit("ALL")).otherwise(F.col(key).cast("string")))
    return wanted.drop("_g")


def fold_spread(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over folds."""
    cells = [c for v in values for c in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))]
    return rows.groupBy(*keys).agg(*cells)


def paired_counts(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Both, left only, right only, neither and the net gain of the right side."""
    both = left.select(key, F.col(flag).cast("boolean").alias("l")).join(right.select(key, F.col(flag).cast("boolean").alias("r")), key)
    only_left, only_right = F.count_if(F.col("l") & ~F.col("r")), F.count_if(~F.col("l") & F.col("r"))
    return both.agg(
        F.count_if(F.col("l") & F.col("r")).alias("both"), only_left.alias("left_only"), only_right.alias("right_only"),
        F.count_if(~F.col("l") & ~F.col("r")).alias("neither"), (only_right - only_left).alias("net"))


def change_label(before: Column, after: Column) -> Column:
    return (
        F.when(~before & after, "fix").when(before & ~after, "break").when(before & after, "unchanged_correct").otherwise("unchanged_wrong")
    )


def change_counts(rows: DataFrame, before: str, after: str, keys: Sequence[str] = ()) -> DataFrame:
    """Fix, break and unchanged counts with both accuracies, overall or per group."""
    b, a = F.col(before).cast("boolean"), F.col(after).cast("boolean")
    label = change_label(b, a)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("questions"), F.avg(b.cast("double")).alias("accuracy_before"), F.avg(a.cast("double")).alias("accuracy_after"),
        *[F.count_if(label == name).alias(name) for name in ("fix", "break", "unchanged_correct", "unchanged_wrong")])


def exact_match(prediction: Column, answer: Column) -> Column:
    return (F.lower(F.trim(prediction)) == F.lower(F.trim(answer))).cast("double")


def answer_tokens(text: Column) -> Column:
    """Lower-cased words without punctuation and articles."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(clean, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def token_overlap(rows: DataFrame, key: Sequence[str], prediction: str, gold: str) -> DataFrame:
    """Token F1 and BLEU-1 (with brevity penalty) per row from multiset overlap."""
    key = list(key)
    sized = rows.select(*key, answer_tokens(F.col(prediction)).alias("p"), answer_tokens(F.col(gold)).alias("g"))
    times = lambda tokens, token: F.size(F.filter(tokens, lambda t: t == token))
    shared = F.aggregate(F.array_intersect("p", "g"), F.lit(0), lambda acc, t: acc + F.least(times(F.col("p"), t), times(F.col("g"), t)))
    joined = sized.select(*key, F.size("p").alias("np"), F.size("g").alias("ng"), shared.alias("common"))
    np_, ng = F.col("np"), F.col("ng")
    precision, recall = F.col("common") / np_, F.col("common") / ng
    f1 = F.when((np_ == 0) | (ng == 0) | (F.col("common") == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    brevity = F.when(np_ > ng, 1.0).otherwise(F.exp(1 - ng / np_))
    bleu = F.when((np_ == 0) | (ng == 0), F.lit(0.0)).otherwise(brevity * precision)
    both_empty = (np_ == 0) & (ng == 0)
    return joined.select(*key, F.when(both_empty, 1.0).otherwise(f1).alias("f1"), F.when(both_empty, 1.0).otherwise(bleu).alias("bleu1"))


def usage_totals(rows: DataFrame, sums: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sums of usage columns, per call and per question."""
    calls, questions = F.count(F.lit(1)), F.countDistinct("question_id")
    cells = []
    for name in sums:
        total = F.coalesce(F.sum(name), F.lit(0))
        cells += [total.alias(f"{name}_total"), (total / calls).alias(f"{name}_per_call"), (total / questions).alias(f"{name}_per_question")]
    return rows.groupBy(*keys).agg(calls.alias("calls"), questions.alias("questions"), *cells)


def percentile_rank(values: DataFrame, keys: Sequence[str], value: str, q: float, rule: str, ranges: int = 256) -> DataFrame:
    """Value at a rank of the sorted column: ``round`` and ``trunc`` of (n-1)q, or ``ceil`` of nq minus one.

    Found by narrowing: a key's values fall into ``ranges`` ranges at approximate quantiles, range counts tell which range holds the
    rank, and only its distinct values are sorted. A key with any number of distinct values is counted by all tasks.
    """
    keys, named = list(keys), values.withColumn("_key", F.struct(F.lit(1).alias("_one"), *keys))
    whole = ["_key"]
    counts = named.filter(F.col(value).isNotNull()).groupBy(*whole, value).agg(F.count(F.lit(1)).alias("n"))
    cuts = counts.groupBy(*whole).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 50 * ranges).alias("_cuts"))
    parted = counts.join(cuts, whole).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = parted.groupBy(*whole, "_range").agg(F.sum("n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*whole))
    index = {
        "round": F.bround((total - 1) * q, 0), "trunc": F.floor((total - 1) * F.lit(q)), "ceil": F.ceil(total * F.lit(q)) - 1,
    }[rule].cast("bigint")
    upto = F.sum("_n").over(Window.partitionBy(*whole).orderBy("_range"))
    placed = sums.withColumn("_before", upto - F.col("_n")).withColumn("_index", F.least(total - 1, F.greatest(F.lit(0), index)))
    held = placed.filter((F.col("_before") <= F.col("_index")) & (F.col("_before") + F.col("_n") > F.col("_index"))).drop("_n")
    inside = parted.join(held, [*whole, "_range"])
    reached = F.col("_before") + F.sum("n").over(Window.partitionBy(*whole, "_range").orderBy(value))
    hit = inside.withColumn("_upto", reached).filter((F.col("_upto") > F.col("_index")) & (F.col("_upto") - F.col("n") <= F.col("_index")))
    return hit.select(*[F.col(f"_key.{k}").alias(k) for k in keys], F.col(value).alias("percentile"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def gate_report(rows: DataFrame) -> DataFrame:
    """Coverage, executability, consensus and takeover quality of verified answers, as one row.

    Columns: full_cover, executable, consensus, takeover, correct, baseline_correct (booleans), anchors, valid_anchors.
    """
    n, took, kept = F.count(F.lit(1)), F.count_if("takeover"), F.count_if(~F.col("takeover"))
    return rows.agg(
        n.alias("questions"), ratio(F.count_if("full_cover"), n).alias("role_coverage"), ratio(F.count_if("executable"), n).alias("executable_rate"),
        ratio(F.count_if("consensus"), n).alias("consensus_rate"), ratio(took, n).alias("takeover_rate"),
        ratio(F.count_if(F.col("takeover") & F.col("correct")), took).alias("takeover_precision"),
        ratio(F.count_if(~F.col("takeover") & F.col("baseline_correct")), kept).alias("fallback_accuracy"),
        ratio(F.sum("valid_anchors"), F.sum("anchors")).alias("anchor_valid_ratio"))


def evidence_state(matched: Column, gold: Column) -> Column:
    return F.when((gold > 0) & (matched == gold), "full").when(matched > 0, "partial").otherwise("none")


def error_audit(rows: DataFrame) -> DataFrame:
    """Accuracy by evidence state with the errors made despite a hit. Columns: matched, gold, correct."""
    state = evidence_state(F.col("matched"), F.col("gold"))
    return rows.groupBy(state.alias("evidence_state")).agg(
        F.count(F.lit(1)).alias("questions"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.count_if(~F.col("correct") & (F.col("matched") > 0)).alias("wrong_despite_hit"))


def error_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("correct")).withColumn("evidence_state", evidence_state(F.col("matched"), F.col("gold")))


def failure_funnel(audits: DataFrame) -> DataFrame:
    """Questions, repairable and converted ones per failure type."""
    return audits.groupBy("failure_type").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("repairable").alias("repairable"), F.count_if("converted").alias("converted"))


def graph_diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts, cross-conversation edges and facts without an event as (metric, value) rows.

    ``edges`` carries src_conv and dst_conv beside role, src and dst.
    """
    counts = nodes.groupBy(F.concat(F.lit("nodes:"), "type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    roles = edges.groupBy(F.concat(F.lit("edges:"), "role").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    crossing = edges.agg(F.count_if(F.col("src_conv") != F.col("dst_conv")).cast("double").alias("value")).select(
        F.lit("cross_conversation_edges").alias("metric"), "value")
    loose = nodes.filter("type = 'FACT'").join(edges.filter("role = 'fact_event'").select(F.col("src").alias("node_id")), "node_id", "left_anti").agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("fact_without_event").alias("metric"), "value")
    return counts.unionByName(roles).unionByName(crossing).unionByName(loose)


def size_statistics(members: DataFrame, cluster: Sequence[str]) -> DataFrame:
    """Mean, median, maximum and singleton share of cluster sizes, as one row."""
    sizes = members.groupBy(*cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("clusters"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"), F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(0.0)).alias("median_size"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_size"), F.coalesce(F.avg((F.col("n") == 1).cast("double")), F.lit(0.0)).alias("singleton_ratio"))


# Fixed value: phrases of a refused answer.
REFUSAL = (
    r"(?iU)\b(?:insufficient evidence|not enough (?:information|evidence)|cannot determine|can't determine"
    r"|unable to determine|unknown)\b"
)


def is_refusal(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(REFUSAL)


def judged_label(reply: Column) -> Column:
    """CORRECT or WRONG from a fenced or bare JSON reply; anything unreadable is WRONG."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    inner = F.trim(F.when(text.rlike(r"(?s)```(?:json)?\s*(.*?)\s*```"), fenced).otherwise(text))
    body = F.when(inner.rlike(r"(?s)^\{.*\}$"), inner)
    label = F.upper(F.trim(F.coalesce(F.get_json_object(body, "$.label"), F.lit(""))))
    return F.when(label == "CORRECT", "CORRECT").otherwise("WRONG")


def split_summaries(rows: DataFrame, means: Sequence[str]) -> DataFrame:
    """The same summary for all, answerable, abstention and gold-bearing questions."""
    tags = F.array_compact(F.array(
        F.lit("all"), F.when(~F.col("is_abstention"), F.lit("answerable")), F.when(F.col("is_abstention"), F.lit("abstention")), F.when(F.col("gold") > 0, F.lit("gold_bearing"))))
    return summarize(rows.withColumn("split", F.explode(tags)), means, ["split"])


def ingestion_counts(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """Instances, turns, gold turns, abstentions and questions per type as (metric, value) rows."""
    base = turns.agg(F.countDistinct("conv_id").alias("instances"), F.count(F.lit(1)).alias("turns"))
    asked = questions.agg(F.sum(F.size("gold_evidence")).alias("gold_turns"), F.count_if("is_abstention").alias("abstentions"))
    rows = base.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in ("instances", "turns")]))).unionByName(
        asked.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in ("gold_turns", "abstentions")]))))
    kinds = questions.groupBy(F.concat(F.lit("type:"), F.coalesce("question_type", F.lit("unknown"))).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return rows.unionByName(kinds)


def recall_at_k(predicted: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Share of gold evidence among the first ``k`` predictions per question."""
    first = predicted.filter(F.col("rank") <= k).select("question_id", "evidence").distinct()
    wanted = gold.select("question_id", "evidence").distinct()
    return wanted.join(first.withColumn("found", F.lit(1)), ["question_id", "evidence"], "left").groupBy("question_id").agg(
        F.avg(F.coalesce("found", F.lit(0)).cast("double")).alias("recall"))


