"""Steps that many dialogue queries share: cleaned turns, scoped BM25, edges built on demand."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from memloom.functions import text as tx
from memloom.operators import edges as ed
from memloom.operators import retrieval as re_


def texts(spark):
    words = "boat harbour lamp stone river market window garden".split()
    docs = [(f"c{c}", f"c{c}:{n:02d}", " ".join(words[(c + n * k) % 8] for k in range(1 + n % 5)) + (" Lamp" if n % 3 else "")) for c in range(3) for n in range(12)]
    asked = [(f"c{c}", f"q{c}{n}", f"{words[n]} {words[c]} {words[c]} lamp unheard") for c in range(3) for n in range(2)] + [("c1", "q1n", None), ("c9", "q9", "boat")]
    return spark.createDataFrame(asked, "conv_id string, question_id string, text string"), spark.createDataFrame(
        [*docs, ("c0", "c0:null", None), ("c2", "c2:none", "")], "conv_id string, doc_id string, text string")


def ranked(rows):
    return sorted((r.conv_id, r.question_id, r["rank"], r.doc_id, round(r.score, 9)) for r in rows.collect())


def test_scoped_scores_are_summed_where_documents_lie(spark, monkeypatch):
    asked, docs = texts(spark)
    wanted = ranked(re_.bm25_top_k(asked, docs, 5, scope="conv_id", scope_words=0))
    mixed = ranked(re_.bm25_top_k(asked, docs, 5, scope="conv_id", scope_words=6))
    monkeypatch.setattr(re_, "used_postings", None)
    assert ranked(re_.bm25_top_k(asked, docs, 5, scope="conv_id")) == wanted == mixed
    assert {r[1] for r in wanted} == {"q00", "q01", "q10", "q11", "q20", "q21"}


def test_candidates_build_no_edges(spark, monkeypatch):
    monkeypatch.setattr(ed, "build_edges", None)
    assert entry.queries()["seed_relation_features_F03"](spark, "/root/testdata/sf0.001").count() > 0


def test_squeeze_collapses_every_kind_of_run(spark):
    rows = [(" a \n b c  d\t",), (" \n",), ("a b",), ("",), ("x 　y",)]
    got = spark.createDataFrame(rows, "text string").select(tx.squeeze("text"), F.trim(F.regexp_replace("text", r"(?U)\s+", " "))).collect()
    assert all(r[0] == r[1] for r in got)
