"""Hash embeddings: words are hashed once a task, rows keep nulls and texts without words."""

import hashlib
import math

from memloom.operators import nodes as nd


def by_hand(text, dim):
    cells = [0.0] * dim
    for token in text.lower().split():
        value = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
        cells[value % dim] += 1.0 if (value >> 8) % 2 else -1.0
    size = math.sqrt(sum(x * x for x in cells))
    return [x / size if size > 0 else 0.0 for x in cells]


def test_hash_embedding_remembers_words(spark, monkeypatch):
    texts = [(1, "Boat lamp boat"), (2, ""), (3, None), (4, "lamp stone LAMP river-bank it's")]
    vectors = nd.hash_embedding(spark.createDataFrame(texts, "id long, text string"), ["id"], 7)
    assert "MapInArrow" in vectors._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.vector for r in vectors.collect()} == {n: None if t is None else by_hand(t, 7) for n, t in texts}
