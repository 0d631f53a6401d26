import pytest
from pyspark.sql import functions as F

from memloom.operators import cards as ca
from memloom.operators import metrics as me
from memloom.operators import packs as pk

NODES = "conv_id string, node_id string, type string, text string, time string, status string, confidence double, support_ids array<string>, pos long, turn_id string, speaker string, session_id string"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([
        ("c", "c:raw:s1:t000", "RAW", "user: Which flash for my camera?", "2023", "active", 1.0, [], 0, "t000", "user", "s1"),
        ("c", "c:raw:s1:t001", "RAW", "assistant: Take the X200 flash.", "2023", "active", 1.0, [], 1, "t001", "assistant", "s1"),
        ("c", "c:fact:1", "FACT", "assistant said: Take the X200 flash.", "2023", "active", 0.7, ["c:raw:s1:t001"], 1, "t001", "assistant", "s1"),
    ], NODES)


def contract(spark, question, **kw):
    return pk.query_contract(spark.createDataFrame([("q", question)], "question_id string, question string"), **kw)


def test_assistant_answer_is_grounded_with_its_request(spark, nodes):
    path = spark.createDataFrame([("q", "c", "c:fact:1", 1, "eu_event", 0.9, None)], "question_id string, conv_id string, node_id string, rank int, route_source string, ce double, role string")
    units = pk.evidence_units(path, nodes)
    assert [q["support_kind"] for q in units.first().quotes] == ["request_pair", "direct"]
    asked = contract(spark, "What flash did you recommend for my camera?")
    assert asked.first().operation == "assistant_recall"
    chosen = pk.select_within_budget(pk.slot_coverage(units, asked))
    pack = pk.assemble_packs(chosen, asked).first()
    assert pack.answerability == "SUPPORTED" and pack.covered_slots == ["assistant_response"] and pack.grounded_units == 1


def test_named_speakers_do_not_gate(spark):
    row = contract(spark, "How many dogs did Ann and Bob adopt?", named_speakers=True).first()
    assert row.operation == "count" and row.target_speaker == "any" and row.target_entities == ["Ann", "Bob"]


def test_budget_skips_and_continues(spark):
    rows = [("q", f"u{i}", i, f"claim {c}", [f"m{c}"], cost, "user", "user") for i, (c, cost) in enumerate([("a", 50), ("b", 80), ("a", 1), ("c", 40)], start=1)]
    units = spark.createDataFrame(rows, "question_id string, unit_id string, rank int, claim string, raw_message_ids array<string>, token_cost long, speaker string, target_speaker string")
    assert sorted(r.unit_id for r in pk.select_within_budget(units, 100).collect()) == ["u1", "u4"]
    assert [r.unit_id for r in pk.select_within_budget(units, 10).collect()] == ["u1"]


def test_windows_merge_where_they_touch(spark):
    raws = spark.createDataFrame([("c", f"r{i}", "s", i) for i in range(12)], "conv_id string, node_id string, session_id string, pos long")
    records = spark.createDataFrame([("q", "c", 1, ["r2"]), ("q", "c", 2, ["r5"]), ("q", "c", 3, ["r11"])], "question_id string, conv_id string, rank int, raw_ids array<string>")
    spans = lambda gap: sorted({(r.start, r.end) for r in pk.message_windows(records, raws, 1, gap).collect()})
    assert spans(0) == [(1, 7), (10, 12)]
    records = spark.createDataFrame([("q", "c", 1, ["r2"]), ("q", "c", 2, ["r6"])], "question_id string, conv_id string, rank int, raw_ids array<string>")
    assert spans(0) == [(1, 4), (5, 8)] and spans(1) == [(1, 8)]


def test_quantities(value):
    assert value(pk.money_values(F.lit("paid $ 1,200.50 and $7"))) == ["$1,200.50", "$7"]
    assert value(pk.duration_values(F.lit("2 hours, three weeks and a five-day-long trip"))) == ["2 hours", "3 weeks", "5 days"]


def test_card_needs_two_known_facts(spark):
    reply = '{"cards":[{"type":"State","roles":{"Old State":{"value":"a","fact_ids":["f1"]},"mood":{"fact_ids":["f2","zz"]}}},{"type":"state","support_facts":["f1","zz"]}]}'
    cards = ca.validate_cards(spark.createDataFrame([("q", reply)], "question_id string, reply string"), spark.createDataFrame([("q", "f1"), ("q", "f2")], "question_id string, node_id string"))
    assert {(r.card_no, r.role, r.node_id, r.is_needed) for r in cards.collect()} == {(1, "old_state", "f1", True), (1, "evidence", "f2", True)}


def test_quota_then_model_order(spark):
    rows = spark.createDataFrame([("q", n, s, i) for i, (n, s) in enumerate([("a", 0.9), ("b", 0.8), ("c", 0.1), ("d", 0.05)], start=1)], "question_id string, node_id string, model_score double, rank int")
    index = spark.createDataFrame([("q", "c", 0.5), ("q", "d", 0.7), ("q", "a", 0.1)], "question_id string, node_id string, card_score double")
    assert [r.node_id for r in ca.quota_selection(rows, index, 3, 2).orderBy("selected_no").collect()] == ["d", "c", "a"]


def test_metric_edge_cases(spark, value):
    asked = spark.createDataFrame([("q",), ("none",)], "question_id string")
    gold = spark.createDataFrame([("q", "1"), ("q", "2")], "question_id string, evidence string")
    found = spark.createDataFrame([("q", "1"), ("none", "1")], "question_id string, evidence string")
    rows = {r.question_id: (r.hit, r.recall, r.full_cover) for r in me.coverage_rows(asked, found, gold).collect()}
    assert rows == {"q": (1.0, 0.5, 0.0), "none": (0.0, 0.0, 0.0)}
    pair = spark.createDataFrame([(1, "The cat sat", "a cat sat down"), (2, "", "")], "id int, p string, g string")
    scores = {r.id: (round(r.f1, 4), round(r.bleu1, 4)) for r in me.token_overlap(pair, ["id"], "p", "g").collect()}
    assert scores == {1: (0.8, round(2.718281828459045 ** (1 - 3 / 2), 4)), 2: (1.0, 1.0)}
    assert value(me.judged_label(F.lit('```json\n{"label": "correct"}\n```'))) == "CORRECT"
    assert value(me.judged_label(F.lit("CORRECT"))) == "WRONG"
    assert value(me.is_refusal(F.lit("Insufficient evidence."))) is True
