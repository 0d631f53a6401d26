"""End to end: turns and questions to packs, and the semantic hierarchy of a graph."""

import json

from memloom.operators import packs as pk
from memloom.plans.answer import evidence_packs
from memloom.plans.build import build_graph, build_hierarchy

TURNS = "conv_id string, pos long, turn_id string, speaker string, text string, ts string, session_id string"
SAID = ["I adopted a grey kitten named Mochi", "The weather was awful in Lisbon", "Mochi the kitten sleeps on my piano", "My brother repairs old violins", "I moved to Porto last spring"]


def turns(spark):
    return spark.createDataFrame([(c, i, f"D{i // 3 + 1}:{i + 1}", "user", t, f"2023-05-0{i + 1}", f"D{i // 3 + 1}") for c in ("a", "b") for i, t in enumerate(SAID if c == "a" else SAID[1:4:2])], TURNS)


def test_questions_get_grounded_packs_of_their_conversation(spark):
    asked = spark.createDataFrame([("q1", "a", "Where does the kitten Mochi sleep?"), ("q2", "b", "Who repairs old violins?"), ("q3", "none", "What is it?")], "question_id string, conv_id string, question string")
    packs, units = evidence_packs(turns(spark), asked)
    rows = {r.question_id: r for r in packs.collect()}
    assert rows["q1"].answerability == rows["q2"].answerability == "SUPPORTED" and rows["q1"].grounded_units == rows["q1"].units > 0
    assert rows["q3"].answerability == "UNSUPPORTED" and rows["q3"].units == 0
    chosen = units.collect()
    assert all(u.node_id.startswith(f"{u.conv_id}:") and u.raw_message_ids for u in chosen)
    first = min((u for u in chosen if u.question_id == "q1"), key=lambda u: u.rank)
    assert "Mochi the kitten sleeps" in first.claim
    text = {r.question_id: json.loads(r.text) for r in pk.render_packs(units).collect()}
    assert any("violins" in quote["text"] for unit in text["q2"] for quote in unit["q"])
    small, kept = evidence_packs(turns(spark), asked, budget=1)
    assert {r.question_id: r.units for r in small.collect()} == {"q1": 1, "q2": 1, "q3": 0} and kept.count() == 2


def test_every_fact_has_one_event_and_every_event_one_topic(spark):
    nodes, _ = build_graph(turns(spark))
    built = build_hierarchy(nodes)
    facts = nodes.filter("type = 'FACT'").count()
    assert built["fact_event"].count() == facts == 7
    topics, episodes = built["topics"].collect(), built["episodes"].collect()
    assert len({r.event_id for r in topics}) == len(topics) == len(episodes) == built["events"].count()
