"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block`` documents.  With target weight w of W in all, block j of a source (from 0)
is released at slot floor(j W / w) and due by slot ceil((j + 1) W / w); the earliest deadline goes first.  The weights
fill the slots exactly, so every block lies within its window, and as long as every source has blocks, each source's
share of the first t slots deviates from t w / W by less than one block.  The windows repeat every W slots: one period
is scheduled, W being a parameter's size, and the rest is arithmetic on block numbers, whatever the number of documents.
A source that has run out leaves its slots empty; the others keep theirs, and positions close the gaps.

Within a source documents come in the order of md5(doc_id), a hash of the row and doc_id, so only rows that are the same in
all columns (but maps) tie, and a task that runs again numbers rows as before.  Ranks are counted over ranges of md5(doc_id), so a
source with a third of all rows is spread over as many tasks as it needs.  Identifiers that alone hold ``HEAVY`` times a range's
share of rows (null may be one) get ranges of their own by the hash of the row; only rows that are the same share one of these.

Defined results: sources that are not listed, and null, share the weight ``other`` and count as one source; no row is
dropped or repeated; a null doc_id hashes as the empty text; repeated rows get ranks of their own; an empty table gives
no rows; texts are carried along whole.  ``interleaved`` carries all columns through, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Target weights of the production query, and that of all other sources together.
TARGET = {"src0": 20} | {f"src{i}": 4 for i in range(1, 20)}
OTHER, BLOCK = 4, 64
#: Documents in a range of hashes, about; ranges of a source at most.
RANGE_ROWS, RANGE_BITS = 1024, 16
#: An identifier with so many times the rows of a range has its own; a source has 2 ** RANGE_BITS / HEAVY of them at most.
HEAVY = 8
NAMES = ("block_no", "slot", "release", "deadline", "position")


def period(weights: list[int]) -> list[tuple[int, int, int]]:
    """(slot, source number, block number) of one period, earliest deadline first; ties go to the lower number."""
    total, after, out = sum(weights), [0] * len(weights), []
    for slot in range(total):
        ready = [(-(-(j + 1) * total // w), s) for s, (j, w) in enumerate(zip(after, weights)) if j * total // w <= slot]
        s = min(ready)[1]
        out.append((slot, s, after[s]))
        after[s] += 1
    return out


def ranged(rows: DataFrame, held: dict[int, int]) -> tuple[DataFrame, list[str]]:
    """Rows (s, h, x, ...) with the columns that name their range, whose order is that of h and x."""

    def by_source(values: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("s"))

    bits = {s: min(RANGE_BITS, math.ceil(math.log2(max(1, n / RANGE_ROWS)))) for s, n in held.items()}  # a large source has more ranges
    rows = rows.withColumn("r", F.call_function("shiftright", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"), by_source({s: 16 - b for s, b in bits.items()})))
    least = by_source({s: HEAVY * max(RANGE_ROWS, n >> bits[s]) for s, n in held.items()})
    large = rows.groupBy("s", "r").count().filter(F.col("count") > least).select("s", "r").collect()
    if not large:
        return rows, ["s", "r"]
    spark = rows.sparkSession
    theirs = rows.join(F.broadcast(spark.createDataFrame(large, "s int, r int")), ["s", "r"], "left_semi")
    heavy = theirs.groupBy("s", "r", "h").count().filter(F.col("count") > least).collect()
    of = defaultdict(list)
    for k in heavy:
        of[k["s"], k["r"]].append((k["h"], min(RANGE_BITS, math.ceil(math.log2(k["count"] / RANGE_ROWS)))))
    cuts = spark.createDataFrame([(*k, [h for h, _ in sorted(v)], [b for _, b in sorted(v)]) for k, v in of.items()], "s int, r int, hashes array<string>, bits array<int>")
    at = F.array_position("hashes", F.col("h"))  # 0: not heavy; the heavy ones of a range come between the others
    rows = rows.join(F.broadcast(cuts), ["s", "r"], "left")
    place = F.coalesce(2 * F.size(F.filter("hashes", lambda y: y < F.col("h"))) + (at > 0).cast("int"), F.lit(0))
    piece = F.when(at > 0, F.call_function("shiftright", F.col("x"), 64 - F.element_at("bits", at.cast("int")))).otherwise(F.lit(0).cast("bigint"))
    return rows.withColumns({"place": place, "piece": piece}).drop("hashes", "bits"), ["s", "r", "place", "piece"]


def scheduled(docs: DataFrame, target: dict[str, int] = TARGET, other: int = OTHER, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``row`` (a struct of all columns of docs, so none can clash), block_no, slot, release, deadline and position."""
    names, all_columns = list(target), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    index = F.create_map(*[F.lit(x) for kv in ((n, i) for i, n in enumerate(names)) for x in kv]) if names else None
    known = F.coalesce(F.try_element_at(index, F.col(f"`{source_col}`").cast("string")), F.lit(len(names))) if names else F.lit(0)
    hashed = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    told = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = docs.select(known.alias("s"), hashed.alias("h"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(*told).alias("x"), all_columns)
    held = {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()}  # as many rows as there are weights
    present = sorted(held)
    weights = [[*target.values(), other][s] for s in present]
    total = sum(weights)
    if not present:
        return docs.select(all_columns, *[F.lit(None).cast("bigint").alias(n) for n in NAMES])

    rows, keys = ranged(rows, held)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    own = Window.partitionBy(*keys).orderBy("h", "x", "id")
    rows = rows.withColumn("k", F.row_number().over(own) - 1).join(offsets, keys)  # rows are dealt by these already
    rank = F.col("o") + F.col("k")

    plan, so_far = [], [0] * len(present)
    for slot, s, j in period(weights):
        plan.append((present[s], j, slot, list(so_far)))
        so_far[s] += 1
    slots = docs.sparkSession.createDataFrame(plan, "s int, j bigint, i bigint, before array<bigint>")
    w = F.element_at(F.create_map(*[F.lit(x) for kv in zip(present, weights) for x in kv]), F.col("s")).cast("bigint")
    rows = rows.withColumn("block_no", F.expr(f"(o + k) div {block}")).withColumn("w", w)
    rows = rows.withColumn("j", F.col("block_no") % F.col("w")).join(F.broadcast(slots), ["s", "j"])  # one row for each slot of the period
    turn = F.expr("block_no div w")
    earlier = sum((F.least(F.lit(held[s]).cast("bigint"), (turn * weights[k] + F.col("before")[k]) * block) for k, s in enumerate(present)), F.lit(0).cast("bigint"))
    return rows.select(
        "row",
        "block_no",
        (turn * total + F.col("i")).alias("slot"),
        F.expr(f"block_no * {total} div w").alias("release"),
        F.expr(f"((block_no + 1) * {total} + w - 1) div w").alias("deadline"),
        (earlier + rank % block).alias("position"),
    )


def interleaved(docs: DataFrame, rows_per_file: int = 8192, most_files: int = 20_000, **options) -> DataFrame:
    """docs in the scheduled order: partition after partition of ``rows_per_file`` rows (or more, so that there are no more
    than ``most_files``), each sorted.

    A row's partition follows from its position, so none is sampled for."""
    count = docs.count()
    rows_per_file = max(rows_per_file, math.ceil(count / most_files))
    n = max(1, math.ceil(count / rows_per_file))
    rows = scheduled(docs, **options).select("row", "position")
    rows = rows.repartitionById(n, F.expr(f"cast(position div {rows_per_file} as int)"))
    return rows.sortWithinPartitions("position").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return scheduled(docs).select("row.*", *NAMES)


def _sql() -> str:
    """For tables that have every listed source and no other."""
    total = sum(TARGET.values())
    slots = ", ".join(f"('{list(TARGET)[s]}', {j}, {slot})" for slot, s, j in period(list(TARGET.values())))
    weights = ", ".join(f"('{s}', {w})" for s, w in TARGET.items())
    return f"""
WITH slots(source, j, i) AS (VALUES {slots}), weights(source, w) AS (VALUES {weights}),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS k FROM documents),
placed AS (SELECT doc_id, ranked.source, k, k // {BLOCK} AS b, w, (k // {BLOCK}) // w * {total} + i AS slot
           FROM ranked JOIN weights USING (source) JOIN slots ON slots.source = ranked.source AND slots.j = (k // {BLOCK}) % w)
SELECT doc_id, source, b AS block_no, slot, b * {total} // w AS release, ((b + 1) * {total} + w - 1) // w AS deadline,
       row_number() OVER (ORDER BY slot, k) - 1 AS position
FROM placed
"""


SQL = _sql()
