"""Greedy clusters by bounds against loops over every open cluster, on one hot key."""

import random

import numpy as np
import pytest

from memloom.operators import folds as fo
from memloom.operators import greedy as gr


def overlap(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def cos(a, b):
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b) / size) if size > 1e-12 else 0.0


def loop(rows, score, threshold, capacity, normal=True, scan=None):
    """Cluster number per row: each row is scored with every cluster that is not full."""
    clusters, out = [], []
    for vector, sets in rows:
        best, best_score = None, -1.0
        for c in clusters:
            if c["n"] >= capacity or (scan and c["no"] <= len(clusters) - scan):
                continue
            value = score(vector, sets, c)
            if value is not None and value > best_score:
                best, best_score = c, value
        if best is None or best_score < threshold:
            best = {"no": len(clusters) + 1, "n": 1, "v": vector, "sets": {k: set(v) for k, v in sets.items()}}
            clusters.append(best)
        else:
            moved = (best["v"] * best["n"] + vector) / (best["n"] + 1)
            best["v"] = gr.unit(moved) if normal else moved
            best["n"] += 1
            for k, v in sets.items():
                best["sets"][k] |= v
        out.append(best["no"])
    return out


def vectors(rng, n, kinds, dim=12):
    centres = [np.array([rng.gauss(0, 1) for _ in range(dim)]) for _ in range(kinds)]
    return [centres[rng.randrange(kinds)] + np.array([rng.gauss(0, 0.6) for _ in range(dim)]) for _ in range(n)]


@pytest.mark.parametrize("seed, scan", [(1, None), (2, None), (3, 9)])
def test_bounds_choose_what_a_loop_chooses(seed, scan):
    rng = random.Random(seed)
    rows = [(gr.unit(v.astype(np.float32)), {"terms": set(rng.sample("abcdefghijklmno", rng.randrange(0, 6))), "entities": set(rng.sample("xyz", rng.randrange(0, 3)))}) for v in vectors(rng, 600, 40)]
    extra = lambda sets, c: None if "a" in sets["terms"] and "b" in (c["sets"] if isinstance(c, dict) else c.sets)["terms"] else 0.05 * ("c" in sets["terms"])
    score = gr.Score(0.65, {"entities": 0.2, "terms": 0.1}, extra, 0.05)
    direct = lambda v, s, c: None if extra(s, c) is None else 0.65 * cos(v, c["v"]) + 0.2 * overlap(s["entities"], c["sets"]["entities"]) + 0.1 * overlap(s["terms"], c["sets"]["terms"]) + extra(s, c)
    clusters = gr.OpenClusters(score, 0.52, 8, scan)
    assert [clusters.place(*r) for r in rows] == loop(rows, direct, 0.52, 8, scan=scan)


def test_topics_and_episodes_equal_a_loop(spark):
    rng = random.Random(5)
    names = [f"t{i}" for i in range(40)]
    events = [(("hot" if i < 160 else "cold"), f"e{i:03d}", [float(x) for x in v], rng.sample(names, rng.randrange(0, 8)), rng.sample(["Ann", "Bob", "Eve"], rng.randrange(0, 3)), sorted(rng.sample([f"D{k}" for k in range(1, 9)], rng.randrange(0, 3))), i) for i, v in enumerate(vectors(rng, 200, 15))]
    df = spark.createDataFrame(events, "conv_id string, event_id string, vector array<double>, terms array<string>, entities array<string>, sessions array<string>, first_pos long")
    got = {r.event_id: r.topic_no for r in fo.cluster_topics(df).collect()}

    def near(a, b):
        if not a or not b:
            return 0.0
        return 1.0 if a & b else 0.5 if min(abs(int(x[1:]) - int(y[1:])) for x in a for y in b) == 1 else 0.0

    topic = lambda v, s, c: 0.65 * cos(v, c["v"]) + 0.2 * overlap(s["e"], c["sets"]["e"]) + 0.1 * overlap(s["t"], c["sets"]["t"]) + 0.05 * near(s["s"], c["sets"]["s"])
    episode = lambda v, s, c: 0.7 * cos(v, c["v"]) + 0.15 * overlap(s["e"], c["sets"]["e"]) + 0.1 * overlap(s["t"], c["sets"]["t"]) + 0.05 * overlap(s["s"], c["sets"]["s"])
    read = lambda e: (gr.unit(np.asarray(e[2], dtype=np.float32)), {"t": set(e[3]), "e": set(e[4]), "s": set(e[5])})
    want = {}
    for conv in ("hot", "cold"):
        own = [e for e in events if e[0] == conv]
        want |= dict(zip([e[1] for e in own], loop([read(e) for e in own], topic, 0.52, 8)))
    assert got == want and len(set(want.values())) > 5
    named = df.join(spark.createDataFrame([(e, f"topic{n}") for e, n in want.items()], "event_id string, topic_id string"), "event_id")
    got = {r.event_id: r.episode_no for r in fo.cluster_episodes(named).collect()}
    want_episodes = {}
    for key in {(e[0], want[e[1]]) for e in events}:
        own = sorted((e for e in events if (e[0], want[e[1]]) == key), key=lambda e: (e[5][0] if e[5] else e[1], e[6], e[1]))
        want_episodes |= dict(zip([e[1] for e in own], loop([read(e) for e in own], episode, 0.50, 6)))
    assert got == want_episodes


def test_states_of_a_hot_entity_equal_a_loop_and_meet_few_clusters(spark):
    rng = random.Random(6)
    names = [f"t{i}" for i in range(300)]
    units = []
    for i in range(900):
        g = rng.randrange(150)
        vector = [float(x) for x in np.random.default_rng(g).normal(size=12) + np.random.default_rng(1000 + i).normal(size=12) / 2]
        units.append(("c", "ann", f"f{i:04d}", rng.sample(names[2 * g : 2 * g + 9] + names[:3], 5), vector, f"p{g // 2}", f"v{rng.randrange(300)}", rng.choice(["", None, f"s{g}"])))
    df = spark.createDataFrame(units, "conv_id string, entity_key string, fact_id string, terms array<string>, vector array<double>, episode_id string, event_id string, session_id string")
    got = {r.fact_id: r.state_no for r in fo.cluster_entity_states(df).collect()}
    names = ("episode_id", "event_id", "session_id")
    ordered = sorted(units, key=lambda u: (u[5] or "zzzz", u[7] or "zzzz", u[6] or "zzzz", u[2]))
    rows = [(np.asarray(u[4]), {"terms": set(u[3]), **{n: {x} if x else set() for n, x in zip(names, u[5:])}}) for u in ordered]
    score = lambda v, s, c: 0.35 * max(0.0, cos(v, c["v"])) + 0.25 * overlap(s["terms"], c["sets"]["terms"]) + sum(w * bool(s[n] & c["sets"][n]) for n, w in zip(names, (0.18, 0.12, 0.10)))
    numbers = loop(rows, score, 0.50, 20, normal=False)
    kept = sorted(n for n in set(numbers) if numbers.count(n) >= 2)
    assert got == {u[2]: kept.index(n) + 1 if n in kept else None for u, n in zip(ordered, numbers)} and len(kept) > 20
    held = gr.OpenClusters(gr.Score(0.35, {"terms": 0.25}, lambda s, c: sum(w * bool(s[n] & c.sets[n]) for n, w in zip(names, (0.18, 0.12, 0.10))), 0.40, names, True), 0.50, 20, normal=False)
    for row in rows:
        held.place(*row)
    assert held.compared < 4 * len(rows) < 0.05 * len(rows) * held.opened


def test_runs_restart_where_no_cluster_reaches(spark):
    rows = [("a", s, [n]) for s, n in [("D0001", 1), ("D0002", 2), ("D0005", 5), ("D0006", 6), ("D0009", 9)]] + [("b", "D0001", [1]), ("b", "D0004", [4]), ("b", "x", [None])]
    df = spark.createDataFrame([(c, o, [x for x in n if x is not None]) for c, o, n in rows], "conv_id string, o1 string, numbers array<long>")
    got = {(r.conv_id, r.o1): r.run for r in fo.restart_runs(df, 1).collect()}
    assert [got[("a", s)] for s in ("D0001", "D0002", "D0005", "D0006", "D0009")] == [0, 0, 1, 1, 2] and {v for (c, _), v in got.items() if c == "b"} == {0}
