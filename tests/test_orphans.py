import datetime as dt

from paperweir.operators.orphans import PARENTS, REFS, OrphanState, last_state, step
from paperweir.operators.skew import salted_join
from paperweir.streaming.orphans import EVENTS, OrphanStream


def t(day):
    return dt.datetime(2024, 1, day) if day else None


def refs(spark, *rows):
    return spark.createDataFrame([("log", str(i), k, "chunks", k, t(d)) for i, k, d in rows], REFS)


def came(spark, *rows):
    return spark.createDataFrame([("chunks", k, t(d), present, not present) for k, d, present in rows], PARENTS)


def kinds(state):
    return {(r.source_key, r.ref_key): r.orphan_kind for r in state.orphans().collect()}


def test_states_follow_events(spark):
    s = step(OrphanState.start(spark), refs(spark, (1, "a", 5), (2, "b", 5), (3, "c", None)), came(spark, ("a", 1, True), ("c", 9, True)))
    assert kinds(s) == {("2", "b"): "missing"}
    s = step(s, refs(spark, (4, "a", 6)), came(spark, ("b", 9, True), ("d", None, False)))
    assert kinds(s) == {("2", "b"): "late"}
    s = step(s, came=came(spark, ("b", 2, True)))  # an earlier arrival shows up: no longer late
    assert kinds(s) == {}
    s = step(s, left=spark.createDataFrame([("chunks", "a")], "target string, key string"))
    assert kinds(s) == {("1", "a"): "deleted", ("4", "a"): "deleted"}
    s = step(s, came=came(spark, ("a", 1, True)))  # it came back
    assert kinds(s) == {}
    assert {r.n_refs for r in s.counts().collect()} == set()


def test_any_periods_give_the_same(spark):
    r = refs(spark, *[(i, f"k{i % 7}", (i % 27) + 1 if i % 5 else None) for i in range(200)], (0, "k0", 1), (0, "k0", 1))
    c = came(spark, *[(f"k{i}", 3 * i + 1, True) for i in range(4)], ("k5", None, False), ("k6", None, True))
    one = kinds(last_state(r, c, []))
    assert one == kinds(last_state(r, c, ["2024-01-05", "2024-01-12", "2024-01-20"]))
    assert set(one.values()) == {"late", "deleted", "missing"}


def test_a_time_that_comes_later_is_judged(spark):
    r = refs(spark, (1, "a", 3), (2, "a", 21), (3, "b", 3), (4, "a", None))
    c = came(spark, ("a", None, True), ("a", 20, True), ("b", None, True))
    one = kinds(last_state(r, c, []))
    assert one == {("1", "a"): "late"}
    assert kinds(last_state(r, c, ["2024-01-10", "2024-01-15"])) == one
    assert kinds(last_state(r, c, ["2024-01-02", "2024-01-10"])) == one


def test_departures_reopen_and_layers_go_together(spark):
    s = step(OrphanState.start(spark, parts=4), refs(spark, (1, "a", 5), (2, "b", 5), (1, "a", 5)), came(spark, ("a", 1, True)))
    s = step(s, came=came(spark, ("a", 1, True)))  # nothing new
    assert s.stored("moved").count() == 0 and s.stored("parents").count() == 1
    s = step(s, refs(spark, (3, "a", None)), came(spark, ("b", 4, True)), spark.createDataFrame([("chunks", "a")], "target string, key string"))
    assert kinds(s) == {("1", "a"): "deleted", ("3", "a"): "deleted"}
    small, old = s.compacted()
    assert kinds(small) == kinds(s) and len(old) == 3 + 2 + 2 and [len(v) for v in small.layers.values()] == [1, 1, 0]
    back = step(small, came=came(spark, ("a", 9, True)))
    assert kinds(back) == {("1", "a"): "late"}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    day = lambda d: t(d)
    ref = lambda i, k, d: ("reference", "log", str(i), k, "chunks", k, day(d))
    event = lambda kind, k, d=None: (kind, None, None, None, "chunks", k, day(d))
    batches = [
        [ref(1, "a", 5), ref(2, "b", 5), event("arrival", "b", 1)],
        [ref(3, "c", 6), event("removal", "d"), ref(4, "d", 7)],
        [event("arrival", "a", 9), event("departure", "b")],
        [],
        [event("arrival", "c", 2), ref(5, "b", None)],
    ]
    at = f"file://{tmp_path}/state"
    for n, rows in enumerate(batches):
        for _ in range(2):  # each batch comes twice, to a new object every time
            OrphanStream(spark, at, parts=8).apply(spark.createDataFrame(rows, EVENTS), n)
    assert kinds(OrphanState.load(spark, at)) == {("1", "a"): "late", ("2", "b"): "deleted", ("4", "d"): "deleted", ("5", "b"): "deleted"}
    step(OrphanState.load(spark, at), refs(spark, (9, "x", 1)))  # a driver that is lost before it saves
    OrphanStream(spark, at, parts=8).apply(spark.createDataFrame([ref(6, "d", 1)], EVENTS), 5)
    assert kinds(OrphanState.load(spark, at)).keys() == {("1", "a"), ("2", "b"), ("4", "d"), ("5", "b"), ("6", "d")}


def test_stream_query_restarts_from_its_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[("reference", "log", "1", "a", "chunks", "a", t(5))], [("reference", "log", "2", "z", "chunks", "z", t(5))], [("arrival", None, None, None, "chunks", "a", t(1))]]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = OrphanStream(spark, f"file://{tmp_path}/state", parts=4)  # the driver is another one each time
        stream.start(spark.readStream.schema(EVENTS).json(str(tmp_path / "in")), str(tmp_path / "check")).awaitTermination(120)
        assert stream.state.batch == i
    assert kinds(OrphanState.load(spark, f"file://{tmp_path}/state")) == {("2", "z"): "missing"}


def test_empty(spark):
    assert last_state(refs(spark).limit(0), came(spark).limit(0), ["2024-01-05"]).orphans().count() == 0


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(600)] + [(None, -i) for i in range(150)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), (None, 4)], "k string, w int")
    for how in ("inner", "left"):
        a = sorted(map(tuple, salted_join(left, right, ["k"], how, hot_rows=100).select("k", "v", "w").collect()), key=repr)
        assert a == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()), key=repr)
