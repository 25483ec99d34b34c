"""Operators that have no SQL, or rules that the test tables don't reach."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.order import last_before, numbered, running
from palimpsest.operators.scan import Key, scan, simplify
from palimpsest.operators.sequences import Sequence
from palimpsest.operators.transactions import Conflict, Relation
from palimpsest.operators.versions import Snapshot, as_of, flashback, lock_rows
from palimpsest.plans.catalogue import ORACLES, QUERIES
from palimpsest.sources.version_log import VersionLog
from palimpsest.streaming.cdc import with_schema_version
from palimpsest.streaming.slots import Slot, emit_ready, stream
from tests.compare import assert_same

VERSION = "_rid long, _ver int, _begin_xid long, _begin_csn long, _begin_cid long, _end_xid long, _end_csn long, _end_cid long, x string"


@pytest.mark.parametrize(
    "keys, kept, conflict",
    [
        ([("a", ">", 10), ("a", ">", 20)], [("a", ">", 20)], False),
        ([("a", ">", 10), ("a", ">=", 11)], [("a", ">=", 11)], False),
        ([("a", ">=", 10), ("a", ">", 10)], [("a", ">", 10)], False),
        ([("a", "=", 1), ("a", "<", 5)], [("a", "=", 1)], False),
        ([("a", "=", 1), ("a", "=", 2)], None, True),
        ([("a", "=", 1), ("a", ">", 2)], None, True),
        ([("a", "is null", None), ("a", "=", 1)], None, True),
        ([("a", "=", None)], None, True),
        ([("a", "is not null", None), ("a", "<", 5)], [("a", "<", 5)], False),
    ],
)
def test_simplify(keys, kept, conflict):
    found, clash = simplify([Key(*k) for k in keys])
    assert clash == conflict
    if not conflict:
        assert found == [Key(*k) for k in kept]


def test_scan_reaches_the_reader(spark, tmp_path):
    spark.range(100).withColumn("b", F.col("id") * 2).write.parquet(f"{tmp_path}/t")
    df = scan(spark.read.parquet(f"{tmp_path}/t"), [Key("id", ">", 5), Key("id", "<=", 9)], ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert df.count() == 4


def test_empty_and_null_lists(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert scan(df, [Key("a", "in", [])]).count() == 0
    assert scan(df, [Key("a", "in", [None])]).count() == 0
    assert scan(df, [Key("a", "in", [1, None])]).count() == 1


def test_running(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    rows = running(df, [F.col("k"), F.col("id")], F.col("id")).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1, 1001))
    before = 0
    for r in rows:
        assert r["before"] == before
        before += r["id"]


def relation(spark, n=3):
    rows = [(i, 1, 0, 0, 0, None, None, None, f"v{i}") for i in range(n)]
    return Relation(spark.createDataFrame(rows, VERSION), ["x"], csn=5)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "_rid long, x string")


def shown(df):
    return {r["_rid"]: r["x"] for r in df.collect()}


def test_savepoints(spark):
    t = relation(spark).begin()
    t.insert(rows(spark, (10, "a")))
    t.savepoint("s")
    t.insert(rows(spark, (11, "b")))
    t.savepoint("s")
    t.delete(rows(spark, (0, None)))
    t.rollback_to("s")
    assert set(shown(t.read())) == {0, 1, 2, 10, 11}
    t.release("s")
    t.rollback_to("s")
    assert set(shown(t.read())) == {0, 1, 2, 10}
    with pytest.raises(KeyError):
        t.release("other")


def test_statement_rollback_and_nested(spark):
    """A failed insert is taken back alone; a second transaction begun within another commits whatever becomes of that."""
    r = relation(spark)
    t = r.begin()
    t.insert(rows(spark, (10, "a")))
    t.insert(rows(spark, (0, "conflict")))
    t.rollback_statement()
    inner = r.begin()
    inner.insert(rows(spark, (20, "own")))
    inner.commit()
    assert set(shown(t.read())) == {0, 1, 2, 10, 20}
    t.abort()
    assert set(shown(as_of(r.versions))) == {0, 1, 2, 20}


def test_version_log(spark, tmp_path):
    """Commits are appended and read back; one that stopped before its line counts for nothing and can be made again."""
    log = VersionLog(spark, f"file://{tmp_path}/log")
    log.create(relation(spark).versions)
    writes = lambda *w: spark.createDataFrame(list(w), "_rid long, op string, _cid long, x string")
    log.append(writes((1, "UPDATE", 0, "new"), (2, "DELETE", 0, None), (9, "INSERT", 1, "more")), 7, 5, ["x"])
    assert shown(as_of(log.read())) == {0: "v0", 1: "new", 9: "more"} and shown(as_of(log.read(), 5)) == {0: "v0", 1: "v1", 2: "v2"}
    log._commit = lambda name: None
    log.append(writes((0, "DELETE", 0, None)), 8, 6, ["x"])
    assert shown(as_of(log.read())) == {0: "v0", 1: "new", 9: "more"}
    VersionLog(spark, log.folder).append(writes((0, "UPDATE", 0, "again")), 8, 6, ["x"])
    assert shown(as_of(log.read())) == {0: "again", 1: "new", 9: "more"}


def test_version_log_row_ids_in_use(spark, tmp_path):
    """Inserts begin rows of their own at version 1, whatever their row ids had before; end marks hit only the versions that they were made for."""
    log = VersionLog(spark, f"file://{tmp_path}/log")
    log.create(relation(spark).versions)
    writes = lambda *w: spark.createDataFrame(list(w), "_rid long, op string, _cid long, x string")
    live = lambda: sorted((r["_rid"], r["_ver"], r["x"]) for r in as_of(log.read()).collect())
    log.append(writes((0, "INSERT", 1, "a"), (1, "UPDATE", 0, "b"), (1, "INSERT", 1, "c"), (2, "DELETE", 0, None), (2, "INSERT", 1, "d")), 7, 5, ["x"])
    assert live() == [(0, 1, "a"), (0, 1, "v0"), (1, 1, "c"), (1, 2, "b"), (2, 1, "d")]
    log.append(writes((2, "DELETE", 0, None)), 8, 6, ["x"])
    log.append(writes((2, "INSERT", 0, "e")), 9, 7, ["x"])
    log.append(writes((2, "UPDATE", 0, "f")), 10, 8, ["x"])
    assert live() == [(0, 1, "a"), (0, 1, "v0"), (1, 1, "c"), (1, 2, "b"), (2, 2, "f")]
    assert log.read().where("_rid = 2").count() == 4 and {r["x"] for r in as_of(log.read(), 8).where("_rid = 2").collect()} == {"e"}


def orders_in_use(spark, folder):
    """Orders, written to folder, whose keys reach those that the queries' inserts take; returned as a pandas frame."""
    ids = spark.range(60).unionByName(spark.range(999_990, 1_000_060))
    status = F.element_at(F.array(*map(F.lit, "OFP")), (F.col("id") % 7 % 3 + 1).cast("int"))
    orders = ids.select(F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), status.alias("o_orderstatus"), (F.col("id") % 1000 + 0.5).cast("double").alias("o_totalprice"))
    orders.write.parquet(f"{folder}/orders.parquet")
    return orders.toPandas()


def test_dml_append_row_ids_in_use(spark, tmp_path):
    orders = orders_in_use(spark, tmp_path)
    assert_same(QUERIES["dml_append"](spark, str(tmp_path)), ORACLES["dml_append"], tmp_path, orders=orders)


def test_dml_final_state_row_ids_in_use(spark, tmp_path):
    orders = orders_in_use(spark, tmp_path)
    assert_same(QUERIES["dml_final_state"](spark, str(tmp_path)), ORACLES["dml_final_state"], tmp_path, orders=orders)


def test_row_ids_inserted_again(spark):
    """A row inserted again begins at version 1; flashback, locks and conflicts don't take it for the one before."""
    r = relation(spark)
    late = r.begin("transaction snapshot")
    late.update(rows(spark, (1, "late")))
    for op, row in (("delete", (1, None)), ("insert", (1, "again")), ("insert", (2, "beside"))):
        t = r.begin()
        getattr(t, op)(rows(spark, row))
        t.commit()
    assert sorted((x["_rid"], x["_ver"], x["x"]) for x in as_of(r.versions).collect()) == [(0, 1, "v0"), (1, 1, "again"), (2, 1, "beside"), (2, 1, "v2")]
    for csn in (5, 6, 7, 8):
        found = [sorted((x["_rid"], x["x"]) for x in f(r.versions, csn).collect()) for f in (flashback, as_of)]
        assert found[0] == found[1] and len(found[0]) == {5: 3, 6: 2, 7: 3, 8: 4}[csn]
    assert {(x["_rid"], x["found"], x["x"]) for x in lock_rows(r.versions, Snapshot(5), ["x"]).collect()} == {(0, "unchanged", "v0"), (1, "newest", "again"), (2, "newest", "beside")}
    with pytest.raises(Conflict):
        late.commit()
    t = r.begin()
    t.update(rows(spark, (1, "next")))
    t.commit()
    assert [(x["_ver"], x["x"]) for x in as_of(r.versions).where("_rid = 1").collect()] == [(2, "next")]


def test_isolation_conflict_and_flashback(spark):
    r = relation(spark)
    fixed, fresh, writer = r.begin("transaction snapshot"), r.begin(), r.begin()
    writer.update(rows(spark, (1, "new")))
    assert shown(fresh.read())[1] == "v1" and shown(writer.read())[1] == "new"
    csn = writer.commit()
    assert shown(fixed.read())[1] == "v1" and shown(fresh.read())[1] == "new"
    fixed.update(rows(spark, (1, "late")))
    with pytest.raises(Conflict):
        fixed.commit()
    assert r.status[fixed.xid] == ("aborted", None) and r.status[writer.xid] == ("committed", csn)
    assert shown(flashback(r.versions, csn)) == shown(as_of(r.versions, csn)) == {0: "v0", 1: "v1", 2: "v2"}
    r.pin("cursor", csn)
    assert r.vacuum().count() == 4
    r.pinned.clear()
    assert r.vacuum().count() == 3
    with pytest.raises(ValueError):
        r.begin("serializable")


def test_sequences(spark):
    s = Sequence(min_value=1, max_value=3, last_value=1)
    assert [r["value"] for r in s.draw(spark, 4).orderBy("n").collect()] == [1, 2, 3, None]
    assert s.after(spark, 2).last_value == 2 and s.after(spark, 9).last_value == 3
    with pytest.raises(ValueError):
        s.set(4)
    down = Sequence(increment=-2, min_value=0, max_value=5, last_value=1, is_called=True, cycle=True)
    assert [r["value"] for r in down.draw(spark, 4).orderBy("n").collect()] == [5, 3, 1, 5]
    assert down.reset() == Sequence(increment=-2, min_value=0, max_value=5, last_value=0, cycle=True)


RECORD = "lsn long, xid long, kind string, csn long, op string"


def test_commit_order_holds_back(spark):
    records = [(1, 1, "ROW", None, "INSERT"), (2, 2, "ROW", None, "INSERT"), (3, 1, "COMMITTING", 10, None), (4, 2, "COMMITTING", 11, None), (5, 2, "COMMIT", 11, None), (6, 3, "ROW", None, "INSERT"), (7, 3, "ABORT", None, None)]
    ready, waiting = emit_ready(spark.createDataFrame(records, RECORD), -1)
    assert ready.count() == 0 and {r["xid"] for r in waiting.collect()} == {1, 2}
    ready, waiting = emit_ready(spark.createDataFrame([*records, (8, 1, "COMMIT", 10, None)], RECORD), -1)
    assert {(r["xid"], r["csn"]) for r in ready.collect()} == {(1, 10), (2, 11)} and waiting.count() == 0
    assert emit_ready(spark.createDataFrame([*records, (8, 1, "COMMIT", 10, None)], RECORD), 10)[0].count() == 1


def test_slot_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    slot = Slot(spark, f"file://{tmp_path}/slot")
    for part in ([(1, 1, "ROW", None, "INSERT"), (2, 2, "ROW", None, "INSERT"), (3, 2, "COMMIT", 7, None)], [(4, 1, "ROW", None, "UPDATE"), (5, 1, "COMMIT", 9, None)]):
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(source)
        stream(spark, spark.readStream.schema(RECORD).parquet(source), slot, f"{tmp_path}/out").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("csn", "lsn").collect()
    assert [(r["xid"], r["csn"], r["lsn"]) for r in out] == [(2, 7, 2), (1, 9, 1), (1, 9, 4)]
    assert slot.confirmed_csn == 9 and slot.start_point() == {"confirmed": 9, "restart_lsn": None}
    slot.acquire()
    with pytest.raises(RuntimeError, match="in use"):
        slot.acquire()
    slot.release()
    slot.drop()


def test_slot_stream_restarts(spark, tmp_path):
    """A batch that stopped between its state and the stream's commit runs again and loses nothing; old states go."""
    source, slot = f"{tmp_path}/in", Slot(spark, f"file://{tmp_path}/slot")
    parts = [[(1, 1, "ROW", None, "INSERT"), (2, 2, "ROW", None, "INSERT"), (3, 2, "COMMIT", 7, None)], [(4, 1, "ROW", None, "UPDATE"), (5, 1, "COMMIT", 9, None), (6, 3, "ROW", None, "INSERT")],
             [(7, 3, "COMMITTING", 12, None), (8, 4, "ROW", None, "INSERT"), (9, 4, "COMMIT", 13, None)], [(10, 3, "COMMIT", 12, None)]]
    for number, part in enumerate(parts):
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(source)
        for again in (False, True):
            stream(spark, spark.readStream.schema(RECORD).parquet(source), slot, f"{tmp_path}/out").awaitTermination()
            if not again:
                for name in (f"{number}", f".{number}.crc"):
                    (tmp_path / "slot/checkpoint/commits" / name).unlink()
        if number == 2:
            assert slot.start_point() == {"confirmed": 9, "restart_lsn": 6}
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("csn", "lsn").collect()
    assert [(r["xid"], r["csn"], r["lsn"]) for r in out] == [(2, 7, 2), (1, 9, 1), (1, 9, 4), (3, 12, 6), (4, 13, 8)]
    assert slot.confirmed_csn == 13 and len(list((tmp_path / "slot/state").glob("[0-9]*"))) == 2 and len(list((tmp_path / "slot").glob("waiting-*"))) == 2
    slot.advance(20)
    assert slot.confirmed_csn == 20


def test_numbered_and_last_before(spark):
    """Groups larger than a partition, single rows, nulls before the first value and rows of a group without any."""
    df = spark.range(3000).select((F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 100)).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 900 == 5, F.col("id")).alias("v")).repartition(7)
    want_nth, want_last, nth, last = {}, {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: r["k"]):
        nth[r["g"]] = want_nth[r["k"]] = nth.get(r["g"], 0) + 1
        last[r["g"]] = want_last[r["k"]] = r["v"] if r["v"] is not None else last.get(r["g"])
    assert {r["k"]: r["nth"] for r in numbered(df, ["g"], ["k"]).collect()} == want_nth
    assert {r["k"]: r["x"] for r in last_before(df, ["g"], ["k"], F.col("v"), "x").collect()} == want_last


def test_schema_version_missing(spark):
    changes, dictionary = spark.createDataFrame([(5, 1), (9, 1), (9, 2)], "lsn long, table_id long"), spark.createDataFrame([(1, 5, "a")], "table_id long, table_csn long, definition string")
    found = {(r["lsn"], r["table_id"]): r["definition"] for r in with_schema_version(changes, dictionary, missing="null").collect()}
    assert found == {(5, 1): None, (9, 1): "a", (9, 2): None}
    with pytest.raises(Exception, match="no visible definition of table"):
        with_schema_version(changes, dictionary).collect()
