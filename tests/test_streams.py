"""Stateful steps over streams against the same steps over whole tables."""

import pytest
from pyspark.sql import functions as F

from muster import operators as ops
from muster.context import ROW_ID, RosterContext
from muster.errors import LogicError
from muster.streaming import stateful


@pytest.fixture
def state(spark):
    for k, v in stateful.STATE.items():
        spark.conf.set(k, v)
    yield
    for k in stateful.STATE:
        spark.conf.unset(k)


def through(spark, folder, parts, step, restart=False):
    """What a step makes of these tables, each of which arrives as a micro-batch; restart: each in a query of its own that
    goes on from the checkpoint."""
    source, out = f"{folder}/in", f"{folder}/out"
    parts[0].limit(0).write.parquet(source)

    def drain():
        stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1000).parquet(source)
        step(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()

    for p in parts:
        p.write.mode("append").parquet(source)
        if restart:
            drain()
    if not restart:
        drain()
    return spark.read.parquet(out)


def test_identities_of_a_stream(spark, state, small, tmp_path):
    """Micro-batches of customers give the rows of the whole table, also after restarts."""
    rows = spark.read.parquet(f"{small}/customer.parquet").selectExpr("c_custkey", "string(c_custkey) AS id", "if(c_custkey % 5 = 0, null, c_mktsegment) AS segment", "if(c_custkey % 35 = 0, null, string(c_nationkey)) AS nation").coalesce(2)
    want = ops.identity_deduplicator(RosterContext(rows.withColumn(ROW_ID, F.col("c_custkey"))), ["segment", "nation"], "id").data.drop(ROW_ID)
    parts = [rows.filter(f"c_custkey >= {lo} AND c_custkey < {lo + 40}") for lo in range(0, 160, 40)]
    got = through(spark, tmp_path, parts, lambda s: stateful.identities(s, ["segment", "nation"], "id", "c_custkey"), restart=True)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == rows.count()
    with pytest.raises(LogicError):
        stateful.identities(rows, ["nope"], "id")


@pytest.mark.parametrize("kind", ["timestamp", "bigint"])
def test_history_of_a_shuffled_stream(spark, state, small, tmp_path, kind):
    """Events in any order: late rows cut intervals, and what is corrected in the end is the history of the whole table."""
    date = {"timestamp": "ts", "bigint": "bigint(unix_micros(timestamp(ts)))"}[kind]
    rows = spark.read.parquet(f"{small}/events.parquet").selectExpr("event_id", f"if(event_id % 50 = 0, null, {date}) AS d", "if(user_id % 7 = 0, null, user_id) AS user_id")
    want = ops.scd_type_2(RosterContext(rows), "user_id", "d", tie_break=["event_id"]).data
    parts = [rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)]
    changes = through(spark, tmp_path, parts, lambda s: stateful.history(s, "user_id", "d", ["event_id"]), restart=True)
    got = stateful.latest(changes, "user_id", ["event_id"]).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert changes.count() > rows.count() and changes.filter("not is_current").count() < 3 * rows.count()
    with pytest.raises(LogicError):
        stateful.history(rows, "user_id", "d")


def test_history_asks_its_state_twice_for_an_entity():
    """One read and one write for an entity's rows of a micro-batch, and versions that grow."""
    import pandas as pd
    from pyspark.sql.types import LongType, StructField, StructType

    calls, kept = [], []

    class State:
        def get(self):
            calls.append("get")
            return iter(list(kept))

        def put(self, rows):
            calls.append("put")
            kept[:] = rows

    class Handle:
        def getListState(self, name, schema):  # noqa: N802
            return State()

    step = stateful._History(StructType([StructField("d", LongType()), StructField("t", LongType())]), "d", ["t"])
    step.init(Handle())
    versions = [next(step.handleInputRows((1,), iter([pd.DataFrame({"d": [d, d + 1], "t": [d, d]})]), None)) for d in (5, 1)]
    assert calls == ["get", "put"] * 2 and versions[0]["version"].max() < versions[1]["version"].min()
    assert versions[1][["d", "effective_to", "is_current"]].values.tolist() == [[1, 2, False], [2, 5, False]]
