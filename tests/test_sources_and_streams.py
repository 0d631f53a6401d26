import datetime
import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import edges as ed
from memloom.operators import nodes as nd
from memloom.sources import artifacts as ar
from memloom.sources import dialogue as dg
from memloom.sources import json_arrays as ja
from memloom.streaming import turns as st

TURNS = "conv_id string, pos long, turn_id string, speaker string, text string, ts string, session_id string"


def test_session_documents_round_trip(spark, tmp_path):
    doc = [{"sample_id": "c1", "conversation": {"session_2": [{"speaker": "B", "text": "later"}], "session_1": [{"dia_id": "D1:1", "speaker": "A", "text": "hi"}, {"speaker": "B", "text": "yo"}], "session_1_date_time": "noon"},
            "qa": [{"question": "Q?", "answer": "A", "category": 2, "evidence": ["D1:1"]}]}]
    (tmp_path / "d.json").write_text(json.dumps(doc))
    docs = dg.read_session_documents(spark, str(tmp_path / "d.json"))
    assert [(r.turn_id, r.session_id, r.ts) for r in dg.session_turns(docs).orderBy("pos").collect()] == [("D1:1", "session_1", "noon"), ("D1:2", "session_1", "noon"), ("D2:3", "session_2", None)]
    assert [(r.question_id, r.evidence) for r in dg.session_questions(docs).collect()] == [("c1:q0001", ["D1:1"])]


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    pick = ['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "𝄞", "}}", '\\"', "x"]
    word = lambda: "".join(rng.choice(pick) for _ in range(rng.randrange(12)))
    rows = [{"k": n, "t": word(), "m": {word() + str(i): word() for i in range(rng.randrange(3))}, "l": [{"a": word(), "b": [[]]} for _ in range(rng.randrange(3))]} for n in range(150)]
    (tmp_path / "tight.json").write_text(json.dumps(rows), encoding="utf-8")
    (tmp_path / "wide.json").write_text("\ufeff \n" + json.dumps(rows, indent=3, ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    schema = "k long, t string, m map<string,string>, l array<struct<a:string,b:array<array<int>>>>"
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        for name in ("tight", "wide", "lines"):
            path = str(tmp_path / f"{name}.json")
            assert ja.json_pieces(spark, path).select("split").distinct().count() > 5
            got = sorted(((r.n, r.k, r.t, r.m, [(x.a, x.b) for x in r.l]) for r in ja.read_json_array(spark, path, schema, "n").collect()), key=lambda r: r[0])
            assert got == [(n, r["k"], r["t"], r["m"], [(x["a"], x["b"]) for x in r["l"]]) for n, r in enumerate(rows)]
        one_task = spark.read.schema(schema).option("multiLine", True).json(str(tmp_path / "tight.json"))
        plain = lambda df: sorted(map(repr, df.collect()))
        assert plain(one_task) == plain(ja.read_json_array(spark, str(tmp_path / "tight.json"), schema))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_arrays_without_records_and_broken_files(spark, tmp_path):
    for name, text, want in (("none", "", []), ("empty", "[]", []), ("blank", " [ ] ", []), ("one", '{"k": 1}', [1]), ("odd", '[null, 3, {"k": 2} , "}", {"k": "bad"}, {}]', [2, None, None])):
        (tmp_path / name).write_text(text)
        assert [r.k for r in ja.read_json_array(spark, str(tmp_path / name), "k int", "n").orderBy("n").collect()] == want
    for name, text in (("cut1", '[{"k": 1}, {"k": 2'), ("cut2", '[{"k": 1}, {"k": 2}'), ("cut3", '[{"k": 1}, {"k": "2}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="ends early"):
            ja.read_json_array(spark, str(tmp_path / name), "k int").collect()


def test_haystack_rejects_unequal_arrays(spark):
    schema = "instance_no long, " + dg.HAYSTACK_SCHEMA
    good = spark.createDataFrame([(0, "x_abs", None, "?", "!", "d", ["s"], ["t"], [[("user", " hi ", True), ("user", " ", None)]], [])], schema)
    turns = dg.haystack_turns(good)
    assert [(r.turn_id, r.text) for r in turns.collect()] == [("s000:s:t000", "hi")]
    question = dg.haystack_questions(good, turns).first()
    assert question.is_abstention and question.gold_evidence == ["s000:s:t000"] and question.conv_id == "lme_0001_x_abs"
    bad = spark.createDataFrame([(0, "x", None, "?", "!", "d", ["s", "u"], ["t"], [[("user", "hi", True)]], [])], schema)
    with pytest.raises(Exception, match="mismatched haystack lengths"):
        dg.haystack_turns(bad).collect()


def test_far_slices_are_found_by_place(spark):
    values = [(n * 7919 % 1009 // 3, n) for n in range(1009)]
    rows = spark.createDataFrame(values, "a int, b int").repartition(5)
    for offset, limit in ((0, 20), (123, 400), (1000, 50), (1009, 5), (2000, 1), (300, 0)):
        got = ar.slice_rows(rows, [F.desc("a"), F.asc("b")], offset, limit, 10)
        want = sorted(values, key=lambda v: (-v[0], v[1]))[offset : offset + limit]
        assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_completeness_is_enforced(spark):
    a, b = (spark.createDataFrame(rows, "question_id string, v int") for rows in ([("q1", 1), ("q2", 2)], [("q1", 3)]))
    with pytest.raises(ValueError, match="q2"):
        ar.join_complete([a, b.withColumnRenamed("v", "w")])


def write_batch(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_streamed_changes_equal_batch_over_several_batches(spark, tmp_path):
    rows = [("c", i, f"D1:{i + 1}", "Ann", f"the blue house by the river {'now' if i % 2 else 'not sold'} {i}", None, "D1") for i in range(30)]
    for n in range(3):
        write_batch(spark, str(tmp_path / "in"), f"b{n}", rows[n * 10:(n + 1) * 10], TURNS)
    got = st.run_available(st.change_edges(stream(spark, str(tmp_path / "in"), TURNS)), str(tmp_path / "out"))
    want = ed.change_edges(nd.fact_nodes(spark.createDataFrame(rows, TURNS)))
    key = lambda df: sorted((r.src, r.dst, r.relation) for r in df.select("src", "dst", "relation").collect())
    assert key(got) == key(want) and got.count() > 0


def test_streamed_versions_drop_and_count_late_rows(spark, tmp_path):
    schema = "entity string, attribute string, state_id long, value long, ts timestamp"
    at = lambda n: __import__("datetime").datetime(2024, 1, n)
    write_batch(spark, str(tmp_path / "in"), "b0", [("a", "x", 1, 1, at(1)), ("a", "x", 3, 3, at(5))], schema)
    write_batch(spark, str(tmp_path / "in"), "b1", [("a", "x", 2, 2, at(3)), ("a", "x", 4, 4, at(9))], schema)
    versions = st.latest_versions(st.run_available(st.state_versions(stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out")))
    rows = versions.orderBy("state_id").collect()
    assert [(r.state_id, r.next_id, r.late_rows) for r in rows] == [(1, 3, 0), (3, 4, 1), (4, None, 1)]
    asked = spark.createDataFrame([("a", "x", 1, at(2)), ("a", "x", 2, at(9)), ("a", "x", 3, at(30)), ("a", "x", 4, __import__("datetime").datetime(2023, 1, 1))], "entity string, attribute string, ask long, at timestamp")
    assert sorted((r.ask, r.state_id) for r in st.versions_at(versions, asked).collect()) == [(1, 1), (2, 4), (3, 4)]


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def progress(stream, target):
    """State rows after each micro-batch, of a stream run to its end."""
    with st.keyed_state(stream.sparkSession):
        query = stream.writeStream.option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{target}/data").start()
        query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


def test_streamed_sessions_keep_the_open_ones(spark, tmp_path):
    schema = "conv_id string, speaker string, ts timestamp"
    write_batch(spark, str(tmp_path / "in"), "b0", [("c", "a", at(0)), ("c", "b", at(30)), ("c", "a", at(61))], schema)
    write_batch(spark, str(tmp_path / "in"), "b1", [("c", "c", at(70)), ("d", "a", at(600))], schema)
    rows = st.session_table(st.run_available(st.session_activity(stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"))).collect()
    assert sorted((r.conv_id, r.turns, r.speakers) for r in rows) == [("c", 2, 2), ("c", 2, 2), ("d", 1, 1)]


def test_streamed_sessions_merge_close_and_free_their_state(spark, tmp_path):
    schema = "conv_id string, speaker string, ts timestamp"
    first = [(f"k{i}", "a", at(i)) for i in range(40)] + [("m", "a", at(0)), ("m", "b", at(50))]
    batches = [first, [("m", "c", at(25)), ("x", "a", at(60))], [("x", "a", at(80)), ("x", "b", at(1000))], [("x", "b", at(1010)), ("k3", "z", at(1020))], [("x", None, at(1030))]]
    for n, rows in enumerate(batches):
        write_batch(spark, str(tmp_path / "in"), f"b{n}", rows, schema)
    held = progress(st.session_activity(stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"))
    assert max(held) > 80 and held[-1] < 12
    rows = st.session_table(spark.read.parquet(str(tmp_path / "out" / "data"))).collect()
    got = sorted((r.conv_id, r.turns, r.speakers, r.first_ts, r.last_ts) for r in rows)
    assert got == sorted([*[(f"k{i}", 1, 1, at(i), at(i)) for i in range(40)], ("k3", 1, 1, at(1020), at(1020)), ("m", 3, 3, at(0), at(50)), ("x", 2, 1, at(60), at(80)), ("x", 3, 1, at(1000), at(1030))])


def test_a_late_turn_is_placed_by_its_position(spark, tmp_path):
    rows = [("c", i, f"D1:{i + 1}", "Ann", f"the blue house by the river {'now' if i % 2 else 'not sold'} {i}", None, "D1") for i in range(12)]
    for n, part in enumerate([rows[:3] + rows[4:9], [rows[3]], rows[9:]]):
        write_batch(spark, str(tmp_path / "in"), f"b{n}", part, TURNS)
    got = st.run_available(st.change_edges(stream(spark, str(tmp_path / "in"), TURNS)), str(tmp_path / "out"))
    want = ed.change_edges(nd.fact_nodes(spark.createDataFrame(rows, TURNS)))
    key = lambda df: sorted((r.src, r.dst, r.relation) for r in df.select("src", "dst", "relation").collect())
    assert key(got) == key(want)


def test_idle_conversations_leave_the_state(spark, tmp_path):
    turn = lambda conv, i, minute: (conv, i, f"D1:{i + 1}", "Ann", f"the blue house by the river now {i}", str(at(minute)), "D1")
    batches = [[turn(f"k{c}", i, i) for c in range(20) for i in range(3)], [turn("live", 0, 3000)], [turn("live", 1, 3001)], [turn("live", 2, 3002)]]
    for n, rows in enumerate(batches):
        write_batch(spark, str(tmp_path / "in"), f"b{n}", rows, TURNS)
    held = progress(st.change_edges(stream(spark, str(tmp_path / "in"), TURNS), idle="1 day"), str(tmp_path / "out"))
    assert max(held) >= 20 and held[-1] < 5
    assert spark.read.parquet(str(tmp_path / "out" / "data")).filter("src LIKE 'live%'").count() == 3


def test_idle_states_go_and_open_versions_come_once(spark, tmp_path):
    schema = "entity string, attribute string, state_id long, value long, ts timestamp"
    batches = [[(f"e{i}", "x", i, i, at(i)) for i in range(30)], [("a", "x", 100, 1, at(5000))], [("a", "x", 101, 2, at(5001))], [("e7", "x", 102, 9, at(5002))]]
    for n, rows in enumerate(batches):
        write_batch(spark, str(tmp_path / "in"), f"b{n}", rows, schema)
    held = progress(st.state_versions(stream(spark, str(tmp_path / "in"), schema), idle="1 day"), str(tmp_path / "out"))
    assert max(held) >= 30 and held[-1] < 10
    emitted = spark.read.parquet(str(tmp_path / "out" / "data"))
    assert emitted.filter("valid_to IS NULL").groupBy("entity", "state_id").count().filter("count > 1").count() == 0
    rows = {(r.entity, r.state_id): (r.next_id, r.valid_to) for r in st.latest_versions(emitted).collect()}
    assert rows[("e7", 7)] == (102, at(5002)) and rows[("e7", 102)] == (None, None) and rows[("a", 100)] == (101, at(5001)) and rows[("e3", 3)] == (None, None)


def test_graph_store_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([("c", 0, "D1:1", "Ann", "river stone", None, "D1")], TURNS)
    nodes = nd.extract_nodes(turns)
    ar.write_graph(nodes, ed.build_edges(nodes), str(tmp_path / "g"))
    back, edges = ar.read_graph(spark, str(tmp_path / "g"))
    assert back.count() == 3 and edges.filter(F.col("relation") == "SUPPORTS").count() == 1


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_streams_as_one_file_or_as_a_directory_of_files(spark, tmp_path, parts):
    rows = spark.range(30).selectExpr("id AS conv_id", "'x' AS text")
    rows.repartition(parts).write.parquet(str(tmp_path / "t.parquet"))
    folder = tmp_path
    if parts == 1:
        folder = tmp_path / "file"
        folder.mkdir()
        next((tmp_path / "t.parquet").glob("part-*.parquet")).rename(folder / "t.parquet")
    rows.limit(1).write.parquet(str(folder / "other.parquet"))
    got = st.run_available(st.table_stream(spark, str(folder), "t.parquet"), str(tmp_path / "out"))
    assert sorted(r.conv_id for r in got.collect()) == list(range(30))


def test_versions_are_made_of_plain_rows():
    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    made = st.Versions(None)
    made.init(Handle())
    rows = lambda *found: iter([st.Row(at=a, state_id=i, value=v) for a, i, v in found])
    first = list(made.handleInputRows(("e", "x"), rows((50, 2, 7), (10, 1, 5)), None))
    assert [tuple(r) for r in first] == [("e", "x", 1, 5, 10, 50, 2, 0), ("e", "x", 2, 7, 50, None, None, 0)]
    assert [tuple(r) for r in made.handleInputRows(("e", "x"), rows((20, 3, 1), (60, 4, 2)), None)] == [("e", "x", 2, 7, 50, 60, 4, 1), ("e", "x", 4, 2, 60, None, None, 1)]


def test_sessions_are_made_of_plain_rows():
    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def put(self, value):
            self.value = value

        update = put

        def clear(self):
            self.value = None

    class Handle:
        timers = []

        def getListState(self, name, schema):
            return Held()

        getValueState = getListState

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, timer):
            self.timers.remove(timer)

        def registerTimer(self, timer):
            self.timers.append(timer)

    class Passed:
        def getCurrentWatermarkInMs(self):
            return 100_000

    made = st.Sessions("30 seconds")
    made.init(Handle())
    second = 1_000_000
    rows = [st.Row(at=n * second, speaker=who) for n, who in ((200, "b"), (10, "a"), (40, None), (175, "a"))]
    got = [tuple(r) for r in made.handleInputRows(("c",), iter(rows), Passed())]
    assert got == [("c", 10 * second, 40 * second, 2, 1, True, 0), ("c", 175 * second, 200 * second, 2, 2, False, 0)]
    assert Handle.timers == [230_001]


def test_long_files_are_hashed_split_by_split(spark, tmp_path):
    rng, mark = random.Random(3), b"\xef\xbb\xbf"
    files = {"random": rng.randbytes(200_000), "a {b}%20é": rng.randbytes(70_001), "line ends": b"\n" * 20_000, "no last end": b"ab\r\ncd" * 4000, "last end": b"ab\ncd\n" * 4000, "mark": mark + b"ab\n" * 6000,
             "mark, no end": mark + b"a\nb" * 6000, "marks only": mark * 6000, "no line": bytes(90_000), "short": b"x\n", "packed.gz": gzip.compress(rng.randbytes(3500))}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    # a task that takes a longer file whole fails
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "16384")
    try:
        got = {row.file: (row.length, row.sha256) for row in ar.file_hashes(spark, str(tmp_path), piece=16384).collect()}
    finally:
        for key, setting in before.items():
            spark.conf.set(key, setting)
    assert got == {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in files.items()}
