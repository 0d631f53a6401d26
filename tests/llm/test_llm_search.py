import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from memloom.llm import signature_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item long, width int, ids string, score string, bound string, rank int"
ITEMS = "item_id long, text string, doc_id long, terms string, counts int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def direct_ranking(docs, items, k):
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, length = len(counted), sum(size for _, _, size in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, size in counted:
            m = 100 - 25 + 25 * size * n // length
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(map(repr, out))


def cases(rng):
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 300)))) for i in range(400)]
    docs += [(500 + i, docs[i][1]) for i in range(30)] + [(600, None), (601, ""), (602, "!? ..."), (None, docs[3][1]), (None, "w1 w2"), docs[7], docs[7]]
    docs += [(700, "Ünï-cöde ÉÉ W1 w1_W2 \x00x\x7fy"), (701, " ".join(word() for _ in range(60_000))), (702, "w1 " * 5000)]
    items = [(i, " ".join(docs[rng.randrange(400)][1].split()[:40])) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w1"), (104, "w2 w2 w2 W1"), (105, "ünï cöde éÉ x y"), (None, "w5 w6"), items[0], (106, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    return docs, items


@pytest.mark.parametrize("first, sent, items_at_once, documents", [(48, 200_000, 1000, 512), (1, 0, 10, 16)])
def test_ranking_equals_scores_of_all_documents(spark, monkeypatch, first, sent, items_at_once, documents):
    for name, value in (("FIRST", first), ("SENT", sent), ("ITEMS", items_at_once), ("DOCUMENTS", documents)):
        monkeypatch.setattr(search, name, value)
    docs, items = cases(random.Random(first))
    table = spark.createDataFrame([(i, t, 1, 2, "i", "s", "b", 3) for i, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, 9, "t", 1) for i, t in items], ITEMS)
    got = search.rank_documents(table, asked).collect()
    assert sorted(repr(tuple(r)) for r in got) == direct_ranking(docs, items, 20)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, 2, "i", "s", "b", 3)], DOCS), spark.createDataFrame([(1, "a", 9, "t", 1)], ITEMS)
    assert [tuple(r)[:3] for r in search.rank_documents(docs, items).collect()] == [(1, 1, 1)]
    assert search.rank_documents(docs.limit(0), items).count() == search.rank_documents(docs, items.limit(0)).count() == 0


def test_bounds_hold_and_exclude(spark):
    docs, items = cases(random.Random(3))
    counted = [Counter(search.terms_of(t)) for _, t in docs]
    known = sorted({t for _, text in items for t in search.terms_of(text)})
    number = {t: i for i, t in enumerate(known)}
    asked = [Counter(search.terms_of(t)) for _, t in items if search.terms_of(t)]
    n, length = sum(map(bool, counted)), sum(c.total() for c in counted)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for c in counted) + 1))) for t in known])
    queries = search.Queries(np.arange(len(asked)), number, weights, np.array([number[t] for c in asked for t in c]), np.array([x for c in asked for x in c.values()]), np.cumsum([0, *map(len, asked[:-1])]), n, length)
    rows = spark.createDataFrame(list(enumerate(t for _, t in docs)), "doc_id long, text string")
    close = total = 0
    for block in search.build_index(rows).collect():
        found = search.bounds(queries, search.hash_terms(known), block["width"], np.array(block["sizes"]), np.array(block["most"]), bytes(block["slices"]))
        for column, row in enumerate(block["ids"]):
            parts = np.zeros(len(known), np.int64)
            for t, tf in counted[row].items():
                if t in number:
                    parts[number[t]] = search.part(np.int64(tf), queries.damping(np.int64(counted[row].total())))
            exact = queries.sums(parts)
            assert (found[:, column] >= exact).all()
            close += (found[:, column] <= 1.5 * exact + 1).sum()
            total += len(exact)
    assert total == len(asked) * n and close > 0.9 * total
