"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits are linked when at most ``RADIUS`` bits differ.  Bit i gets a nonzero vector a(i) of
RADIUS + 1 bits; the table of each nonzero vector v hashes the bits whose a(i) has an odd product with v.  For any
RADIUS differing bits some v is orthogonal to all their vectors, so the pair meets in that table (Pagh, CoveringLSH):
no linked pair is missed.  Only distinct fingerprints take part, so copies cost nothing, however many there are.

Groups that meet in a table are cut into chunks of bounded size; each pair of chunks is compared where Spark has
brought it together, and gives one link from each row to a representative, not all pairs.

Defined results: a null text counts as empty, and texts without words have fingerprint zero; a null identifier is
ignored when the smallest of a component is sought (all null: null); repeated rows give repeated rows; an empty table
gives none; texts of any length are taken whole.  ``drop_near_copies`` carries all columns through, whatever their names,
and keeps the row with the smallest identifier of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, located, map_texts, table, without, written, written_at

SEED, WORDS, RADIUS, BITS = 42, 3, 3, 64
#: Rows of a bucket's chunk.
CHUNK = 512


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included."""
    w = text.lower().split()
    if not w:
        return 0
    k = min(words, len(w))
    grams = map(b" ".join, zip(*[w[i:] for i in range(k)]))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), "<u8", len(w) - k + 1)
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # a very long text is taken in pieces, for the memory
        set_bits += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""

    def run(ids: list, texts: list) -> dict:
        return {"id": ids, "fp": np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)}

    key = docs.select(F.col(id_col).alias("k")).schema["k"].dataType.simpleString()
    return map_texts(docs, run, f"id {key}, fp bigint", text_col, F.col(id_col))


def masks(radius: int = RADIUS) -> list[int]:
    """The covering family: for each nonzero v the bits i with <a(i), v> odd, a(i) running through the nonzero vectors."""
    k = (1 << (radius + 1)) - 1
    found = [sum(1 << i for i in range(BITS) if ((i % k + 1) & v).bit_count() % 2) for v in range(1, k + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in found]


def _linked(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by run: each row that is linked to another of its run, and the first row of its class there."""
    n, label = len(fp), np.arange(len(fp), dtype=np.int32)
    pairs, at = [], np.arange(n - 1, dtype=np.int32)
    for step in range(1, n):
        at = at[at + step < n]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        pairs.append((near, near + step))
    if not pairs:
        return label[:0], label[:0]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps (column fp): they join exactly what pairs within the radius join.

    A bucket of n distinct fingerprints is met ceil(n / chunk) times by each of them, so no group is gathered in one task."""
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks(radius)])).alias("t", "m")).select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("key"))
    met = keyed.groupBy("t", "key").count().filter("count > 1")
    cand = keyed.join(met, ["t", "key"])
    cut = F.ceil(F.col("count") / chunk).cast("int")
    cand = cand.withColumn("own", F.pmod(F.xxhash64("fp"), cut)).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    cand = cand.select("fp", "t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    by = ["t", "key", "lo", "hi"]
    near = written(cand, "candidates").repartition(*by).sortWithinPartitions(*by, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            fp, keys = cols[0], cols[1:]
            new = np.zeros(len(fp), bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            at, rep = _linked(fp.view(np.uint64), np.cumsum(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[rep])], names=["a", "b"])

        left = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            if left is not None:
                cols = [np.concatenate(x) for x in zip(left, cols)]
            same = np.logical_and.reduce([k == k[-1] for k in cols[1:]]) if len(cols[0]) else np.zeros(0, bool)
            yield found([c[~same] for c in cols])
            left = [c[same] for c in cols]  # the last run may go on in the next batch; it has a bounded size
        if left is not None and len(left[0]):
            yield found(left)

    return near.mapInArrow(run, "a bigint, b bigint").distinct()


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) for all nodes of the links (a, b) that aren't roots.

    Alternating large-star and small-star steps; each round is written to the shared folder."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e, path = written_at(pairs.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = sign(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        old, (e, path) = path, written_at(star(star(e, True), False), "links")
        discard(e.sparkSession, old)
        now = sign(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component (the smallest id that links reach) of every row."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    own = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = own.join(components(links(own)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(roots.select("fp", "root").join(least, "root").select("fp", "component"), "fp")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs."""
    return simhash(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the smallest identifier, and of those that lies first."""
    rows = located(docs)
    first = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "at")
    got = written(simhash(rows.select(first.alias("key"), F.col("row.text").alias("t")), "key", "t"), "near-copies")
    return without(rows, got.filter("id != component").select("id.at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
