"""Streaming jobs over several batches: levelled index, session state, expiry by event time, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import behaviour as B
from corpusmill.operators import retrieve as R
from corpusmill.plans import streams as P
from corpusmill.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("fanout", [2, 3])
def test_levelled_index_equals_a_rebuild(spark, tmp_path, fanout):
    batches = [
        [("a", 1, "one two"), ("b", 1, "two three")], [("c", 2, "three four")], [("a", 1, None)], [("d", 3, "five one"), ("b", 1, "two six")],
        [("a", 1, "one seven")], [("c", 2, None), ("x", 9, None)], [("e", 4, "two two"), ("e", 4, None)],
    ]
    frames = [spark.createDataFrame(b, "chunk_id string, doc_id long, content string") for b in batches]
    path, check = str(tmp_path / "index"), str(tmp_path / "check")
    J.index_upkeep(P.in_order(spark, frames, "chunks"), path, check, fanout).awaitTermination()
    state = {}
    for batch in batches:
        for chunk, doc, content in sorted(batch, key=lambda r: r[2] is not None):  # of a batch's rows of a chunk one with content holds
            state[chunk] = (chunk, doc, content)
    now = spark.createDataFrame([r for r in state.values() if r[2] is not None], "chunk_id string, doc_id long, content string")
    key = ["token", "chunk_id", "doc_id", "tf", "length"]
    want = sorted(map(tuple, R.postings(now).select(*key).collect()))
    assert sorted(map(tuple, J.read_index(spark, path).select(*key).collect())) == want
    runs = J._runs(spark, path)
    assert all(sum(r[0] == level for r in runs) < fanout for level in range(10)) and max(r[0] for r in runs) >= 1
    assert [b[1] for b in runs[1:]] == [a[2] + 1 for a in runs[:-1]]  # they cover all batches without a gap
    # A run whose merge was cut off is not read; its parts still are.
    J._write_run(R.postings(now).limit(0), now.select("chunk_id").limit(0), f"{path}/level=9/run=0-{len(batches) - 1}")
    (tmp_path / f"index/level=9/run=0-{len(batches) - 1}/gone/_SUCCESS").unlink()
    assert sorted(map(tuple, J.read_index(spark, path).select(*key).collect())) == want
    J._drop_covered(spark, path)
    assert sorted(map(tuple, J.read_index(spark, path).select(*key).collect())) == want


def test_runs_hold_words_and_no_postings(spark, tmp_path):
    """A run takes a row a chunk, and a batch without repeated chunks is written as it comes."""
    frames = [spark.createDataFrame([(f"{b}_{k}", k, f"one two w{k} w{b} one") for k in range(50)], "chunk_id string, doc_id long, content string") for b in range(2)]
    path = str(tmp_path / "index")
    J.index_upkeep(P.in_order(spark, frames, "chunks"), path, str(tmp_path / "check"), 2).awaitTermination()
    (run,) = J._runs(spark, path)
    stored = spark.read.parquet(f"{J._folder(path, run)}/words")
    assert run[0] == 1 and stored.count() == 100 and "token" not in stored.columns
    assert J.read_index(spark, path).count() == R.postings(frames[0].unionByName(frames[1])).count()


def test_session_state_equals_the_batch_operators(spark):
    rows = [(s, k, "abca"[(k * (s + 1)) % 4], at(k)) for s in range(3) for k in range(25)]
    frame = spark.createDataFrame(rows, "session long, seq long, cmd string, ts timestamp")
    files = P.in_order(spark, [frame.where(f"seq between {a} and {b}") for a, b in ((0, 6), (7, 7), (8, 24))], "commands")
    got = P.drain(spark, J.command_pairs(files, recent=4))
    want = B.pairs(frame)
    key = ["session", "pair", "a", "b", "ts"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    counts = got.groupBy("session", "a", "b").agg(F.max("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted((r["a"], r["b"], r["n"]) for r in B.pair_counts(want).collect())
    last = got.orderBy(F.desc("pair")).where("session = 0").first()
    assert last["recent"] == [r[2] for r in rows if r[0] == 0][20:24]


def test_profile_over_batches(spark):
    rows = [("u", 1, at(1), "cats", ["north"]), ("u", 2, at(5), "cat", ["south", "north"]), ("u", 3, at(3), "dogs", []), ("v", 4, at(2), "x", None or [])]
    frame = spark.createDataFrame([(0 if u == "u" else 1, s, t, topic, r) for u, s, t, topic, r in rows], "user long, seq long, ts timestamp, topic string, regions array<string>")
    out = P.drain(spark, J.running_profile(P.in_order(spark, [frame.where("seq <= 2"), frame.where("seq > 2")], "profile")), "update")
    last = out.groupBy("user").agg(F.max_by(F.struct("n", "last_active", "topics", "regions"), "run").alias("x")).select("user", "x.*").orderBy("user").collect()
    assert [tuple(r) for r in last] == [(0, 3, at(5), ["cats", "dogs"], ["north", "south"]), (1, 1, at(2), ["x"], [])]


def test_an_answer_expires_by_event_time(spark):
    batches = [[("q", 1, at(0), "a1"), ("q", 2, at(20), "a2")], [("r", 3, at(90), "b1")], [("s", 4, at(91), "c1")], [("q", 5, at(92), "a3"), ("q", 6, at(93), "a4"), ("r", 7, at(119), "b2"), ("r", 8, at(120), "b3")]]
    frames = [spark.createDataFrame(b, "hash string, seq long, ts timestamp, answer string") for b in batches]
    got = {r["seq"]: (r["answer"], r["hit"]) for r in P.drain(spark, J.answer_cache(P.in_order(spark, frames, "requests"), 30 * 60_000, "1 minute")).collect()}
    assert got == {1: ("a1", False), 2: ("a1", True), 3: ("b1", False), 4: ("c1", False), 5: ("a3", False), 6: ("a3", True), 7: ("b1", True), 8: ("b3", False)}


def test_windows_drop_late_rows(spark):
    batches = [[(at(10), 1), (at(20), 1)], [(at(300), 1)], [(at(301), 1)], [(at(15), 1), (at(302), 1)], [(at(900), 1)], [(at(901), 1)]]
    frames = [spark.createDataFrame([(t, u, "e") for t, u in b], "ts timestamp, user_id long, event_type string") for b in batches]
    for slide, first in ((None, 2), ("30 minutes", 2)):
        rows = P.drain(spark, J.windows(P.in_order(spark, frames, "late"), "1 hour", "1 hour", slide), "append")
        got = {r["start"]: r["n"] for r in rows.collect()}
        assert got[T0] == first and got[at(300)] == 3
    found = sorted((r["first"], r["n"]) for r in P.drain(spark, J.sessions(P.in_order(spark, frames, "sessions"), "1 hour", "30 minutes"), "append").collect())
    assert found == [(at(10), 2), (at(300), 3)]
