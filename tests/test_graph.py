"""Edges, folds and paths against direct loops, with one conversation holding most rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import edges as ed
from memloom.operators import expansion as ex
from memloom.operators import folds as fo
from memloom.operators import nodes as nd
from memloom.operators.ordering import dense_ordinal

WORDS = "river stone garden music travel coffee winter summer market bridge paint train doctor letter window forest".split()


def turns(spark, seed=3, hot=60, cold=12):
    rng = random.Random(seed)
    rows = []
    for conv, size in [("hot", hot), ("a", cold), ("b", cold)]:
        for pos in range(size):
            text = " ".join(rng.choices(WORDS, k=rng.randint(2, 9))) + rng.choice(["", " now", " not here", " topic"])
            rows.append((conv, pos, f"D{pos // 6 + 1}:{pos + 1}", rng.choice(["Ann", "Bob"]), text, None, f"D{pos // 6 + 1}"))
    return spark.createDataFrame(rows, "conv_id string, pos long, turn_id string, speaker string, text string, ts string, session_id string")


def terms(text):
    import re

    from memloom.functions.text import CONTENT_STOPWORDS

    return {t.lower() for t in re.findall(r"[A-Za-z][A-Za-z0-9_'-]+", text) if len(t) > 2 and t.lower() not in CONTENT_STOPWORDS}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def nodes(spark):
    return nd.extract_nodes(turns(spark)).cache()


def test_dense_ordinal_spreads_a_hot_key(spark):
    rows = spark.createDataFrame([("k", p) for p in range(0, 100, 3)] + [("z", 5)], "key string, pos long")
    got = {(r.key, r.pos): r.ordinal for r in dense_ordinal(rows, ["key"], "pos", chunk=7).collect()}
    assert [got[("k", p)] for p in range(0, 100, 3)] == list(range(34)) and got[("z", 5)] == 0


def test_anchor_links_match_an_exhaustive_loop(spark, nodes):
    facts, anchors = nodes.filter("type = 'FACT'"), nodes.filter("type = 'ANCHOR'")
    want = set()
    fact_rows, anchor_rows = facts.collect(), anchors.collect()
    for f in fact_rows:
        pool = [(a, len(terms(f.text) & terms(a.text))) for a in anchor_rows if a.conv_id == f.conv_id]
        pool = sorted([p for p in pool if p[1] > 0], key=lambda p: (-p[1], p[0].pos))[:40]
        ranked = sorted(enumerate(pool), key=lambda p: (-jaccard(terms(f.text), terms(p[1][0].text)), p[0]))[:3]
        want |= {(f.node_id, p[0].node_id) for _, p in ranked if jaccard(terms(f.text), terms(p[0].text)) >= 0.08}
    got = {(r.src, r.dst) for r in ed.link_anchors(facts, anchors).collect()}
    assert got == want and want


@pytest.mark.parametrize("limit", [2, 5, 40])
def test_anchor_candidates_keep_the_best_when_words_are_crowded(nodes, limit):
    facts, anchors = nodes.filter("type = 'FACT'"), nodes.filter("type = 'ANCHOR'")
    anchor_rows, want = anchors.collect(), set()
    for f in facts.collect():
        here = sorted((a for a in anchor_rows if a.conv_id == f.conv_id), key=lambda a: (-len(terms(f.text) & terms(a.text)), a.pos))
        matched = [a for a in here if terms(f.text) & terms(a.text)]
        want |= {(f.node_id, a.node_id) for a in (matched or sorted(here, key=lambda a: a.pos))[:limit]}
    assert {(r.fact_id, r.anchor_id) for r in ed.anchor_candidates(facts, anchors, limit).collect()} == want


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_change_edges_match_a_window_loop_for_any_partitioning(spark, nodes, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    facts = nodes.filter("type = 'FACT'")
    want = set()
    by_conv = {}
    for r in sorted(facts.collect(), key=lambda r: r.pos):
        by_conv.setdefault(r.conv_id, []).append(r)
    for rows in by_conv.values():
        for i, new in enumerate(rows):
            for old in rows[max(0, i - 20):i]:
                if jaccard(terms(new.text), terms(old.text)) < 0.18:
                    continue
                low = new.text.lower()
                if new.status == "outdated" or any(w in low for w in ("changed", "updated", "now", "instead", "no longer")):
                    want.add((new.node_id, old.node_id, "UPDATES"))
                elif any(w in f"{old.text.lower()} {low}" for w in ("not ", "never", "contradict", "wrong")):
                    want.add((new.node_id, old.node_id, "CONFLICTS_WITH"))
    got = {(r.src, r.dst, r.relation) for r in ed.change_edges(facts).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want and {k for _, _, k in want} == {"UPDATES", "CONFLICTS_WITH"}


def test_graph_is_intact_and_stays_inside_conversations(nodes):
    edges = ed.build_edges(nodes)
    assert ed.dangling_edges(edges, nodes).count() == 0
    assert edges.filter(~F.startswith("src", F.concat("conv_id", F.lit(":")))).count() == 0


def fact_views(spark, nodes):
    facts = nodes.filter("type = 'FACT'")
    vectors = nd.hash_embedding(facts, ["node_id"], 16)
    return nd.fact_views(facts, nd.known_speakers(facts)).join(vectors, "node_id")


def naive_events(rows):
    clusters, out = [], {}
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-12 else v
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) * np.linalg.norm(b) > 1e-12 else 0.0
    number = lambda s: int(s[1:])
    for r in rows:
        v, best, best_score = unit(np.asarray(r.vector, dtype=np.float32)), None, -1.0
        for c in clusters[max(0, len(clusters) - 256):]:
            if c["n"] >= 6:
                continue
            spread = [number(s) for s in c["s"] | {r.session}]
            if max(spread) - min(spread) > 1:
                continue
            gap = 0 if r.session in c["s"] else min(abs(number(r.session) - number(s)) for s in c["s"])
            score = (0.6 * cos(v, c["v"]) + 0.15 * jaccard(set(r.entities), c["e"]) + 0.15 * jaccard(set(r.terms), c["t"])
                     + 0.05 * {0: 1.0, 1: 0.5}.get(gap, 0.0) + 0.05 * (r.speaker in c["p"]) - 0.06 * gap)
            if score > best_score:
                best, best_score = c, score
        if best is None or best_score < 0.52:
            best = {"no": len(clusters) + 1, "n": 0, "v": v, "s": set(), "e": set(), "t": set(), "p": set()}
            clusters.append(best)
        else:
            best["v"] = unit((best["v"] * best["n"] + v) / (best["n"] + 1))
        best["n"] += 1
        best["s"].add(r.session), best["p"].add(r.speaker)
        best["e"] |= set(r.entities)
        best["t"] |= set(r.terms)
        out[r.node_id] = best["no"]
    return out


@pytest.mark.parametrize("partitions", [1, 16])
def test_event_clusters_match_a_direct_loop(spark, nodes, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    views = fact_views(spark, nodes)
    got = {r.node_id: r.event_no for r in fo.cluster_events(views).collect()}
    want = {}
    rows = sorted(views.collect(), key=lambda r: (r.conv_id, r.order_key.session, r.order_key.number, r.pos))
    for conv in {r.conv_id for r in rows}:
        want |= naive_events([r for r in rows if r.conv_id == conv])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want
    sizes = {}
    for node, number in got.items():
        sizes[(node.split(":")[0], number)] = sizes.get((node.split(":")[0], number), 0) + 1
    assert max(sizes.values()) <= 6 and len(got) == len(rows)


def test_topic_segments_match_a_direct_loop(spark, nodes):
    views = fact_views(spark, nodes)
    got = {r.node_id: r.topic_no for r in fo.topic_segments(views, max_facts=5).collect()}
    want = {}
    rows = sorted(views.collect(), key=lambda r: (r.conv_id, r.pos))
    for conv in {r.conv_id for r in rows}:
        segments, current = [], []
        for r in [r for r in rows if r.conv_id == conv]:
            if current:
                p = current[-1]
                a, b = np.asarray(p.vector), np.asarray(r.vector)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                low = (a @ b / size if size > 1e-12 else 0.0) < 0.10 and jaccard(set(p.terms), set(r.terms)) < 0.08
                if r.session != p.session or len(current) >= 5 or (len(current) >= 2 and low):
                    segments.append(current)
                    current = []
            current.append(r)
        segments.append(current)
        merged = []
        for s in segments:
            if merged and len(s) < 2 and len(merged[-1]) + len(s) <= 5:
                merged[-1] = merged[-1] + s
            else:
                merged.append(s)
        want |= {r.node_id: i for i, s in enumerate(merged, start=1) for r in s}
    assert got == want


def test_bounded_paths_follow_queue_order(spark):
    edges = spark.createDataFrame(
        [("c", "f1", "a", "IS_SPECIFIC_OF", 0.9), ("c", "f2", "a", "IS_SPECIFIC_OF", 0.8), ("c", "f1", "r1", "SUPPORTS", 0.98), ("c", "f2", "f1", "UPDATES", 0.7)],
        "conv_id string, src string, dst string, relation string, confidence double")
    starts = spark.createDataFrame([("c", "a")], "conv_id string, node_id string")
    got = [r.path for r in ex.bounded_paths(starts, edges).orderBy("path_no").collect()]
    assert got == [["a", "f1", "r1"], ["a", "f1", "f2"], ["a", "f2", "f1", "r1"]]


def test_siblings_keep_the_strongest_and_skip_hubs(spark):
    links = spark.createDataFrame([("c", f"f{i}", "hub", 0.5 + i / 100) for i in range(9)] + [("c", "f0", "small", 0.9), ("c", "f8", "small", 0.6)],
                                  "conv_id string, fact_id string, anchor_id string, confidence double")
    seeds = spark.createDataFrame([("q", "c", "f8")], "question_id string, conv_id string, node_id string")
    assert {(r.anchor_id, r.node_id) for r in ex.siblings(seeds, links, 2).collect()} == {("hub", "f7"), ("hub", "f6"), ("small", "f0")}
    assert {r.anchor_id for r in ex.siblings(seeds, links, 2, max_degree=5).collect()} == {"small"}
    assert math.isclose(ex.siblings(seeds, links, 2, 5).first().sibling_confidence, 0.9)


@pytest.mark.parametrize("common", [3, 6])
def test_words_in_every_anchor_keep_candidates_exact_and_linear(spark, common):
    rng = random.Random(common)
    everywhere = WORDS[:common]
    rare = [f"word{i}x" for i in range(60)]
    text = lambda k: " ".join([*rng.sample(everywhere, rng.choice([common, common, common - 1])), *rng.choices(rare, k=k)])
    facts = [("c", f"f{i}", text(rng.randrange(0, 3))) for i in range(150)]
    anchors = [("c", f"a{i}", text(rng.randrange(0, 3)), i) for i in range(300)]
    f = spark.createDataFrame(facts, "conv_id string, node_id string, text string")
    a = spark.createDataFrame(anchors, "conv_id string, node_id string, text string, pos long")
    pairs = ed._sharing_pairs(f, a, 10).cache()
    want = set()
    for _, fact, body in facts:
        ranked = sorted((x for x in anchors if terms(body) & terms(x[2])), key=lambda x: (-len(terms(body) & terms(x[2])), x[3]))
        want |= {(fact, x[1]) for x in ranked[:10]}
    got = {}
    for r in pairs.collect():
        got.setdefault(r.fact_id, []).append((-r.shared, r.anchor_pos, r.anchor_id))
    assert {(k, x[2]) for k, v in got.items() for x in sorted(v)[:10]} == want
    assert pairs.count() < 0.4 * len(facts) * len(anchors)
    wide = spark.createDataFrame([("c", f"b{i}", text(0), 300 + i) for i in range(600)], a.schema)
    assert ed._sharing_pairs(f, a.unionByName(wide), 10).count() < 1.2 * pairs.count()
