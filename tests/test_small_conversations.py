"""Anchor links of small conversations compare all pairs; the result is that of the search by words."""

from memloom.operators import edges as ed


def test_small_conversations_compare_all_pairs(spark, monkeypatch):
    words = "boat harbour lamp stone river market window garden".split()
    row = lambda c, n, k: (f"c{c}", f"c{c}:{k}:{n:02d}", " ".join(words[(c + n * i) % 8] for i in range(1 + n % 4)) if n else "no of", n)
    facts, anchors = (spark.createDataFrame([row(c, n, k) for c in range(3) for n in range(9)], "conv_id string, node_id string, text string, pos int") for k in ("fact", "anchor"))
    rows = lambda df: sorted(map(tuple, ed.top_per(df, ["conv_id", "fact_id"], [ed.F.desc("shared"), ed.F.asc("anchor_pos")], 3).collect()))
    wanted = rows(ed._sharing_pairs(facts, anchors, 3, small_pairs=0))
    monkeypatch.setattr(ed, "_pairs_by_words", None)
    assert rows(ed._sharing_pairs(facts, anchors, 3)) == wanted != []
