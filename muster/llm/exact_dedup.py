"""Exact deduplication by a stateful stream.

A stream of digests updates a keyed state that lives on disk (RocksDB) and never expires.  For each digest the state
retains how many rows had it, the identifier that stays (the largest) and the locator of its content (file and row).
Documents come in arrivals; each is one micro-batch.  While the batch is taken, the digests that were hit are checked over
full bytes: the arrival's texts against each other and against the retained content, which is fetched by its locator, also
after a restart.  Digests under which texts differ are recorded, and their rows are told apart by the texts themselves.

A digest that very many rows share costs one state and one row from each task; in the join of rows with states the digests
of at least one row in ``HOT`` (so at most ``HOT`` digests) are broadcast, and only the others shuffle.

Defined results: a null text counts as empty; texts of any length are taken whole; identifiers may have any type that has
an order, and a null one is smaller than any other; of repeated rows with the same identifier and text exactly one stays
(the one that lies last in the files); an empty table gives no rows; other columns are carried through by ``drop_copies``
and not looked at, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, kind, located, scratch, table, text_of, without, written

#: Settings of the keyed state: on disk, with bounded memory for all stores of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store sets aside megabytes of disk
}
AT = "struct<file:string,n:bigint>"
HOT = 1000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_state(rows: DataFrame) -> DataFrame:
    """What is retained of each digest; on a stream, Spark keeps it as state and combines rows before the shuffle,
    so a digest that a third of all rows share sends one row from each task."""
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "at")).alias("keep"))


class Dedup:
    """The stream's folder: ``digests`` (its input, a folder for each arrival), ``state`` (its checkpoint), ``changes`` (the
    states that each micro-batch changed) and ``collisions``.  A new object over the same folder goes on where it was."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", text_col: str = "text", digest: Callable[[Column], Column] = sha256, most_broadcast: int = MOST_BROADCAST) -> None:
        self.spark, self.folder, self.text_col, self.digest, self.most_broadcast = spark, folder, text_col, digest, most_broadcast
        self.rows = f"digest binary, id {id_type}, at {AT}"
        self.changed = f"digest binary, n bigint, keep struct<id:{id_type},at:{AT}>, batch bigint"

    def arrive(self, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """Take located rows; returns digest, id and at of each."""
        text = text_of(f"row`.`{self.text_col}")
        path = f"{self.folder}/digests/arrival={uuid.uuid4().hex}"
        rows.select(self.digest(text).alias("digest"), F.col(f"row.`{id_col}`").alias("id"), "at").write.parquet(path)
        own = self.spark.read.schema(self.rows).parquet(path)
        if own.isEmpty():
            return own
        texts = rows.select(self.digest(text).alias("digest"), text.alias("t"))
        before = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            stream = self.spark.readStream.schema(f"{self.rows}, arrival string").parquet(f"{self.folder}/digests")
            to = keyed_state(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: self._batch(df, i, texts))
            to.option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return own

    def _batch(self, states: DataFrame, batch: int, texts: DataFrame) -> None:
        """Every micro-batch writes to folders of its own, so a repeated batch overwrites itself."""
        path = f"{self.folder}/changes/batch={batch}"
        states.write.mode("overwrite").parquet(path)
        hits = self.spark.read.schema(self.changed).parquet(path).filter("n > 1").select("digest")
        seen, few = texts, hits.count() * 64 <= self.most_broadcast
        if few:  # else all texts of the arrival are looked at, as digests don't say where their texts are
            seen = texts.join(F.broadcast(hits), "digest", "left_semi")
        if batch:
            before = self.states(before=batch).join(F.broadcast(hits) if few else hits.hint("merge"), "digest", "left_semi")
            seen = seen.unionByName(self._retained(before))
        # The least and the greatest text of a digest are equal if and only if all its texts are.  Tasks compare what they have
        # read before anything is shuffled: a text that very many rows share leaves each of them once.
        told = seen.groupBy("digest").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo != hi").select("digest")
        told.write.mode("overwrite").parquet(f"{self.folder}/collisions/batch={batch}")

    def _retained(self, states: DataFrame) -> DataFrame:
        """digest and t (the content at the locator) of each state; only the files that locators name are read."""
        own = written(states.select("digest", F.col("keep.at").alias("at")), "retained")
        files = [r[0] for r in own.select("at.file").distinct().collect()]
        if not files:
            return own.select("digest", F.lit("").alias("t"))
        content = located(self.spark.read.parquet(*files))
        return content.join(own.hint("merge"), "at").select("digest", text_of(f"row`.`{self.text_col}").alias("t"))

    def states(self, before: int | None = None) -> DataFrame:
        """The last state of each digest over all micro-batches (counts only grow), or over those before one."""
        all_ = self.spark.read.schema(self.changed).parquet(f"{self.folder}/changes")
        all_ = all_ if before is None else all_.filter(F.col("batch") < before)
        return all_.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).select("digest", "s.n", "s.keep")

    def collisions(self) -> DataFrame:
        """Digests under which texts differ."""
        return self.spark.read.schema("digest binary, batch bigint").parquet(f"{self.folder}/collisions").select("digest").distinct()


def classes(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row for each located row: id, at, n, keep (id, at), kept, digest.

    ``digest`` may be weak: hits are checked over full bytes."""
    spark = rows.sparkSession
    dedup = Dedup(spark, scratch(spark, "dedup"), kind(rows.select(F.col(f"row.`{id_col}`").alias("id")), "id"), text_col, digest, most_broadcast)
    own = dedup.arrive(rows, id_col)
    if own.isEmpty():
        return own.select("*", F.lit(0).cast("bigint").alias("n"), F.struct("id", "at").alias("keep"), F.lit(True).alias("kept"))
    state, total = written(dedup.states(), "states"), own.count()

    hot = state.filter(F.col("n") * HOT >= total).select("digest", F.struct("n", "keep").alias("hot"))
    out = own.join(F.broadcast(hot), "digest", "left")
    # Rows with a hot digest need no partner any more; a key of their own spreads them over the shuffle.
    cold = F.concat(F.lit(b"0"), F.col("digest"))
    key = F.when(F.col("hot").isNull(), cold).otherwise(F.encode(F.concat(F.lit("1"), F.hex(F.xxhash64("at"))), "UTF-8"))
    out = out.withColumn("key", key).join(state.select(cold.alias("key"), F.struct("n", "keep").alias("cold")), "key", "left")
    out = out.select("digest", "id", "at", F.coalesce("hot", "cold").alias("s")).select("digest", "id", "at", "s.n", "s.keep")
    differ = dedup.collisions()
    if not differ.isEmpty():
        text = text_of(f"row`.`{text_col}")
        told = rows.select(digest(text).alias("digest"), text.alias("t"), F.col(f"row.`{id_col}`").alias("id"), "at").join(differ, "digest", "left_semi")
        split = told.groupBy("digest", "t").agg(F.count("*").alias("n2"), F.max(F.struct("id", "at")).alias("keep2"))
        fixed = written(told.join(split, ["digest", "t"]).select("at", "n2", "keep2"), "told-apart")
        out = out.join(fixed, "at", "left").withColumns({"n": F.coalesce("n2", "n"), "keep": F.coalesce("keep2", "keep")}).drop("n2", "keep2")
    return out.select("id", "at", "n", "keep", (F.col("keep.at") == F.col("at")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    got = classes(located(docs), **options)
    return got.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without the copies, all columns as they were."""
    rows = located(docs)
    return without(rows, classes(rows, **options).filter(~F.col("kept")).select("at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
