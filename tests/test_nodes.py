from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators import nodes as nd

FACTS = "conv_id string, node_id string, text string, speaker string, time string, status string, support_ids array<string>, source string"


def rule(n, text, speaker="James", conv="c1"):
    return (conv, f"{conv}:fact:D1:{n}", f"{speaker} said: {text}", speaker, None, "active", [f"{conv}:raw:D1:{n}"], "rule_extracted")


def observation(n, text, raws, conv="c1"):
    return (conv, f"{conv}:fact:obs:{n:04d}", text, "James", None, "active", raws, "locomo_observation")


def test_support_ids_from_every_form(value):
    assert value(tx.parse_support_ids(F.lit("['D1:2', 'D1:3']"))) == ["D1:2", "D1:3"]
    assert value(tx.parse_support_ids(F.lit("D1:2, D1:3"))) == ["D1:2", "D1:3"]
    assert value(tx.parse_support_ids(F.lit("'D1:2'"))) == ["D1:2"]
    assert value(tx.parse_support_ids(F.lit(None).cast("string"))) == []


def test_status_order_and_anchor_label(value):
    assert value(tx.infer_status(F.lit("She changed it, maybe"))) == "outdated"
    assert value(tx.infer_status(F.lit("All except one, maybe"))) == "exception"
    assert value(tx.infer_status(F.lit("Maybe"))) == "disputed"
    assert value(tx.anchor_text(F.lit("the of a"))) == "General memory"
    assert value(tx.anchor_text(F.lit("Blue blue cars race, cars win big red trophies"))) == "Topic: blue, cars, race, win, big, red"


def test_names_respect_unicode_word_boundaries(value):
    assert value(tx.name_tokens(F.lit("Anna met Quelqueé and Bob"))) == ["Anna", "Bob"]


def test_session_and_safe_ids(value):
    assert value(tx.canonical_session(F.lit("c1:raw:D3:12"))) == "D3"
    assert value(tx.canonical_session(F.lit("session_03"))) == "D3"
    assert value(tx.safe_id(F.lit("a b/c-d_é"))) == "a_b_c-d_é"
    assert value(F.length(tx.safe_id(F.lit("x" * 100)))) == 80


def test_truncation_at_word(value):
    assert value(tx.truncate_at_word(F.lit("alpha beta gamma delta"), 11)) == "alpha."
    assert value(tx.truncate_at_word(F.lit("short"), 12)) == "short"


def test_filtered_policy_rewrites_the_informative_sentence(spark):
    facts = spark.createDataFrame([rule(1, "I went bowling yesterday and got 2 strikes."), rule(2, "Wow! What happened next?")], FACTS)
    assert [r.text for r in nd.rule_statements(facts).collect()] == ["James went bowling yesterday and got 2 strikes."]
    roles = {r.node_id: r.role for r in nd.canonical_facts(facts, "filtered").collect()}
    assert roles == {"c1:fact:D1:1": "alias", "c1:fact:rule_sem:D1:1": "canonical", "c1:fact:D1:2": "rejected"}


def test_first_person_rewrites(value):
    said = lambda t: value(nd.rewrite_first_person(F.lit(t), F.lit("Ann")))
    assert said("I'm tired and my dog sleeps") == "Ann is tired and Ann's dog sleeps."
    assert said("We've moved") == "Ann and others have moved."
    assert said("The weather was good") == "Ann stated that the weather was good."


def test_covered_rules_become_aliases_and_policy_none_rejects_the_rest(spark):
    facts = spark.createDataFrame([rule(1, "a"), rule(2, "b"), observation(1, "James did a", ["c1:raw:D1:1"])], FACTS)
    roles = {r.node_id: r.role for r in nd.canonical_facts(facts, "none").collect()}
    assert roles == {"c1:fact:obs:0001": "canonical", "c1:fact:D1:1": "alias", "c1:fact:D1:2": "rejected"}
    assert {r.role for r in nd.canonical_facts(facts, "all").collect() if r.node_id.endswith("D1:2")} == {"canonical"}


def test_random_policy_is_seeded_and_exact(spark):
    facts = spark.createDataFrame([rule(i, f"text {i}") for i in range(5)], FACTS)
    first = sorted(r.node_id for r in nd.canonical_facts(facts, "random", sample_size=2, seed=7).filter("role = 'canonical'").collect())
    again = sorted(r.node_id for r in nd.canonical_facts(facts, "random", sample_size=2, seed=7).filter("role = 'canonical'").collect())
    assert len(first) == 2 and first == again
