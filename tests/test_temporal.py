import calendar
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memloom.functions import temporal as tm
from memloom.operators import temporal as tp


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def when(text):
    return datetime.fromisoformat(text)


@pytest.mark.parametrize("text,want", [
    ("1:56 pm on 8 May, 2023", "2023-05-08 13:56"), ("2023/05/20 (Sat) 20:08", "2023-05-20 20:08"), ("2023-05-20", "2023-05-20"), ("soon", None), ("2023-02-30", None)])
def test_parse_time(value, text, want):
    assert value(tm.parse_time(F.lit(text))) == (when(want) if want else None)


@pytest.mark.parametrize("text,anchor,want", [
    ("one month ago", "2024-03-31 10:00:00", "2024-02-29 10:00:00"), ("4000 years ago", "2024-03-31", None), ("about two weeks ago", "2024-03-31", "2024-03-17"), ("last year", "2024-02-29", "2023-02-28"), ("0 days ago", "2024-01-01", None)])
def test_relative_time(value, text, anchor, want):
    row = value(tm.relative_time(F.lit(text), at(anchor)))
    assert row["at"] == (when(want) if want else None)
    if want is None:
        assert row["status"] == "ambiguous"


def test_absolute_time_borrows_only_the_year(value):
    assert value(tm.absolute_time(F.lit("on October 15th"), at("2023-11-01 08:00:00")))["at"] == when("2023-10-15 08:00")
    assert value(tm.absolute_time(F.lit("on October 15th"), F.lit(None).cast("timestamp_ntz")))["status"] == "symbolic"
    assert value(tm.absolute_time(F.lit("February 30"), at("2023-11-01")))["status"] == "ambiguous"


@pytest.mark.parametrize("text,want,precision", [
    ("exactly three weeks ago", "2023-04-29", "week"), ("on the 15th of March", "2023-03-15", "day"), ("last summer", "2022-07-01", "season"), ("in January", "2023-01-01", "month"), ("someday", None, "unknown")])
def test_bind_time(value, text, want, precision):
    row = value(tm.bind_time(F.lit(text), at("2023-05-20")))
    assert row["at"] == (when(want) if want else None) and row["precision"] == precision


@pytest.mark.parametrize("text,anchor,loose,strict", [
    ("last Saturday", "2023-05-25", "2023-05-20", None), ("the day after tomorrow", "2022-07-09", "2022-07-10", "2022-07-11"), ("the day before yesterday", "2023-06-26", "2023-06-25", "2023-06-24"), ("last Sunday", "2023-06-26", "2023-06-25", None)])
def test_named_speaker_rules(value, text, anchor, loose, strict):
    assert value(tm.bind_named(F.lit(text), at(anchor)))["at"] == when(loose)
    assert value(tm.bind_named_strict(F.lit(text), at(anchor)))["at"] == (when(strict) if strict else None)


def test_intervals(value):
    row = value(tm.grounded_interval(F.lit("last weekend"), at("2023-05-22 09:00:00")))
    assert (row["start"], row["end"]) == (when("2023-05-20"), when("2023-05-21 23:59:59"))
    row = value(tm.grounded_interval(F.lit("mid-February 2022"), at("2023-05-22")))
    assert (row["start"], row["end"]) == (when("2022-02-10"), when("2022-02-20 23:59:59"))


OPS = "question_id string, operand_no int, identity string, occurred timestamp, duration_unit string"
ASK = "question_id string, question string, query_type string, question_time timestamp"


def solve(spark, solver, question, kind, *times):
    rows = [("q", i, name, when(t) if t else None, None) for i, (name, t) in enumerate(times, start=1)]
    ops = spark.createDataFrame(rows, OPS).withColumn("occurred", F.col("occurred").cast("timestamp_ntz"))
    asked = spark.createDataFrame([("q", question, kind, when("2023-06-01"))], ASK).withColumn("question_time", F.col("question_time").cast("timestamp_ntz"))
    found = solver(ops, asked).collect()
    return found[0].answer if found else None


def test_elapsed_counts_calendar_days(spark):
    assert solve(spark, tp.solve_elapsed, "How many days passed?", "elapsed", ("a", "2025-01-08 23:50"), ("b", "2025-01-15 00:10")) == "7 days"
    assert solve(spark, tp.solve_elapsed, "How many days did I spend there?", "duration", ("a", "2023-05-15"), ("b", "2023-05-17")) == "3 days"
    assert solve(spark, tp.solve_elapsed, "How many days in total?", "duration", ("a", "2023-05-15"), ("b", "2023-05-17"), ("c", "2023-05-19")) is None


def test_ordering_needs_every_time(spark):
    assert solve(spark, tp.solve_ordering, "Which came first?", "ordering", ("late", "2023-05-20"), ("early", "2023-05-01")) == "early was first"
    assert solve(spark, tp.solve_ordering, "Give the order", "ordering", ("later", "2023-05-20"), ("earlier", "2023-05-01")) == "earlier, then later"
    assert solve(spark, tp.solve_ordering, "Which came first?", "ordering", ("a", None), ("b", "2023-05-01")) is None


def test_amounts_and_answer_types(value):
    assert value(tm.amount_text(F.lit(2.5), F.lit("year"))) == "2.5 years"
    assert value(tm.amount_text(F.lit(1.0), F.lit("day"))) == "1 day"
    assert value(tm.rounded_duration(F.lit(86400.0 * 45), F.lit("how many months"))) == "2 months"
    assert value(tm.answer_type(F.lit("the week before 7 May 2023"))) == "DATE_WINDOW"
    assert value(tm.answer_type(F.lit("maybe"))) is None


def test_sidecar_record_of_a_spoken_offset(spark):
    units = spark.createDataFrame([("q", "u", "bought binoculars exactly three weeks ago", when("2023-05-20 20:08"), 1)], "question_id string, unit_id string, claim string, mentioned timestamp, rank int")
    row = tp.event_time_records(units.withColumn("mentioned", F.col("mentioned").cast("timestamp_ntz"))).first()
    assert row.occurred == when("2023-04-29 20:08") and row.constraint_text == "event_time = mentioned_at - 3 week(s)"


def test_overlapping_expressions_count_once(spark):
    rows = spark.createDataFrame([("two days ago, 3 weeks later and yesterday",)], "t string").select(tp.relative_expressions("t").alias("e")).first().e
    assert [(r["text"], r["anchor"], r["direction"]) for r in rows] == [("two days ago", "mentioned_at", -1), ("3 weeks later", "related_event", 1), ("yesterday", "mentioned_at", -1)]


def states(spark):
    rows = [("Ann", "Job", 1, "A", when("2025-03-01"), 0.85), ("ann", "job", 2, "B", when("2025-05-01"), 0.85), ("ann", "job", 3, "C", when("2025-05-02"), 0.5), ("bob", "job", 4, "D", None, 0.85)]
    return spark.createDataFrame(rows, "entity string, attribute string, state_id long, value string, valid_from timestamp, confidence double").withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))


def test_state_versions_and_as_of(spark):
    versions = tp.state_versions(states(spark))
    ends = {r.state_id: r.valid_to for r in versions.collect()}
    assert ends == {1: when("2025-05-01"), 2: when("2025-05-02"), 3: None, 4: None}
    assert {(r.src, r.relation, r.dst) for r in tp.state_edges(versions).collect()} >= {("2", "SUPERSEDES", "1"), ("1", "UPDATED_BY", "2"), ("1", "CONTRADICTS", "2"), ("1", "VALID_DURING", "event:1")}
    asked = spark.createDataFrame([("Ann", "job", i, when(t)) for i, t in enumerate(["2025-02-01", "2025-04-30", "2025-05-01 12:00", "2025-06-01"])], "entity string, attribute string, ask_id int, at timestamp")
    got = {r.ask_id: r.value for r in tp.state_at(versions, asked.withColumn("at", F.col("at").cast("timestamp_ntz"))).collect()}
    assert got == {0: None, 1: "A", 2: "B", 3: None}


def test_propagation_composes_hops_and_reports_conflicts(spark):
    times = spark.createDataFrame([("q", "a", when("2023-05-01")), ("p", "a", when("2023-05-01")), ("p", "b", when("2023-05-09"))], "question_id string, event_id string, at timestamp").withColumn("at", F.col("at").cast("timestamp_ntz"))
    links = spark.createDataFrame(
        [("q", "b", "a", "AFTER_OFFSET", 2, "week"), ("q", "b", "c", "BEFORE_OFFSET", 1, "month"), ("p", "b", "a", "AFTER_OFFSET", 2, "day")],
        "question_id string, event_id string, anchor_event_id string, relation string, offset_value int, offset_unit string")
    known, conflicts = tp.propagate(times, links)
    assert {(r.question_id, r.event_id): r.at for r in known.collect()}[("q", "c")] == when("2023-06-15")
    assert [(r.question_id, r.event_id) for r in conflicts.collect()] == [("p", "b")]


def moved(at, amount, unit):
    """A calendar shift by hand."""
    if unit in ("month", "year"):
        months = at.year * 12 + at.month - 1 + amount * (12 if unit == "year" else 1)
        last = calendar.monthrange(months // 12, months % 12 + 1)[1]
        return at.replace(year=months // 12, month=months % 12 + 1, day=min(at.day, last))
    return at + timedelta(hours=amount * {"hour": 1, "day": 24, "week": 168}[unit])


def spread(times, links):
    """Rounds over one question by hand."""
    known = {}
    for event, at in times:
        known[event] = min(at, known.get(event, at))
    both = [(a, e, n, u) for e, a, n, u in links] + [(e, a, -n, u) for e, a, n, u in links]
    fresh = dict(known)
    while fresh:
        reached = [(b, moved(fresh[a], n, u)) for a, b, n, u in both if a in fresh and b not in known and u != "moon"]
        fresh = {b: min(t for e, t in reached if e == b) for b, _ in reached}
        known.update(fresh)
    wrong = {(e, a) for e, a, n, u in links if u != "moon" and e in known and a in known and moved(known[a], n, u).date() != known[e].date()}
    return known, wrong | {(e, "absolute") for e, at in times if any(f == e and t.date() != at.date() for f, t in times)}


def test_propagation_is_one_shuffle_and_equals_rounds_by_hand(spark):
    rng = random.Random(8)
    times, links = [], []
    for q in range(300):
        events = [f"e{q}"] + [f"e{i}" for i in range(rng.randrange(2, 9))]
        times += [(q, rng.choice(events), datetime(2024, rng.randrange(1, 13), rng.choice([1, 28, 15]), rng.randrange(24), 5)) for _ in range(rng.randrange(4))]
        links += [(q, rng.choice(events), rng.choice(events), rng.choice(["AFTER_OFFSET", "BEFORE_OFFSET", "SAME_TIME"]), rng.randrange(15), rng.choice(["hour", "day", "week", "month", "year", "moon"])) for _ in range(rng.randrange(9))]
    # a chain of 60 links, over a month end each time
    times.append((999, "c0", datetime(2024, 1, 31)))
    links += [(999, f"c{i + 1}", f"c{i}", "AFTER_OFFSET", 1, "month") for i in range(60)]
    t = spark.createDataFrame(times, "question_id long, event_id string, at timestamp_ntz").repartition(7)
    l = spark.createDataFrame(links, "question_id long, event_id string, anchor_event_id string, relation string, offset_value int, offset_unit string").repartition(7)
    spark.sparkContext.setJobGroup("propagation", "propagation")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        known, conflicts = tp.propagate(t, l)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("propagation")) < 10
    signed = {"AFTER_OFFSET": 1, "BEFORE_OFFSET": -1, "SAME_TIME": 0}
    want = {q: spread([(e, at) for k, e, at in times if k == q], [(e, a, signed[r] * n, u) for k, e, a, r, n, u in links if k == q]) for q in {r[0] for r in times + links}}
    assert sorted(map(tuple, known.collect())) == sorted((q, e, at) for q, (found, _) in want.items() for e, at in found.items())
    assert {tuple(r) for r in conflicts.collect()} == {(q, *pair) for q, (_, wrong) in want.items() for pair in wrong}
