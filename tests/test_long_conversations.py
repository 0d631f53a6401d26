import duckdb
import pytest

import __spark_entry__ as entry
from memloom.operators import retrieval as re_

WORDS = ["garden", "window", "bicycle", "teacher", "mountain", "kitchen", "letter", "river", "violin", "market", "station"]


@pytest.fixture(scope="module")
def long_conversation(tmp_path_factory):
    """One conversation of 240 turns that share a word with its question, one of six."""
    folder = tmp_path_factory.mktemp("long")
    rows = [(c, t, "user" if t % 2 else "assistant", f"the project {WORDS[t % 11]} {WORDS[t % 7]} {' again' * (t % 5)} number{t % 40}")
            for c, n in ((1, 240), (2, 6)) for t in range(n)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY conversations TO '{folder}/conversations.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["filtered_siblings_X06", "external_rerank_X16", "retrieval_features_F02"])
def test_hits_beyond_the_hundredth_count(spark, long_conversation, name):
    folder, con = long_conversation
    wanted = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    plain = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(tuple(r) for r in entry.queries()[name](spark, folder).select(*columns).collect()) == plain(wanted.fetchall())


@pytest.mark.parametrize("scope", [None, "conv_id"])
@pytest.mark.parametrize("scope_words", [0, 4096])
def test_all_hits_are_ranked_without_a_limit(spark, scope, scope_words):
    docs = spark.createDataFrame([("a", i, f"red {'blue ' * (i % 3)}thing{i}") for i in range(150)] + [("a", 150, "none")], "conv_id string, doc_id long, text string")
    asked = spark.createDataFrame([("a", "q", "red blue")], "conv_id string, question_id string, text string")
    hits = re_.bm25_top_k(asked, docs, None, scope=scope, scope_words=scope_words).orderBy("rank").collect()
    best = re_.bm25_top_k(asked, docs, 30, scope=scope).orderBy("rank").collect()
    assert [r["rank"] for r in hits] == list(range(1, 151))
    assert [(r.doc_id, round(r.score, 9)) for r in hits[:30]] == [(r.doc_id, round(r.score, 9)) for r in best]
