"""Effective-dated history: each row is valid until the entity's next."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

from ..context import ROW_ID, RosterContext, fresh, quoted
from ..errors import LogicError

#: Keys (entity, date, ties) that are sampled for each shuffle partition, and at least; keys of the sample in a range.
SAMPLED, LEAST_SAMPLED, RANGE_KEYS = 64, 1024, 16


def _ranges(data: DataFrame, entity_column: str, order: list[Column]) -> DataFrame | None:
    """Entities that hold more than half a partition's share of all rows (few, as shares add up to one), each with the keys
    at which its ranges begin: e, bounds, and the same bounds in groups.  None if there are none.

    Reads the key columns twice, to count them and for a sample of bounded size; every bound is the key of a row."""
    keys = data.select(quoted(entity_column).alias("e"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("k"))
    partitions = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST_SAMPLED, SAMPLED * partitions)
    sample = keys.sample(min(1.0, most / max(1, keys.count())), seed=11)
    found = sample.groupBy("e").agg(F.sort_array(F.collect_list("k")).alias("ks")).filter(F.size("ks") >= max(2 * RANGE_KEYS, most // (2 * partitions)))
    found = found.select("e", F.expr(f"transform(sequence({RANGE_KEYS}, size(ks) - 1, {RANGE_KEYS}), i -> element_at(ks, i + 1))").alias("bounds")).collect()
    if not found:
        return None
    rows = []
    for e, bounds in found:
        step = math.isqrt(len(bounds)) + 1
        rows.append((e, bounds, [bounds[k : k + step] for k in range(0, len(bounds), step)], step))
    key = ArrayType(keys.schema["k"].dataType)
    schema = StructType([StructField("e", keys.schema["e"].dataType), StructField("bounds", key), StructField("groups", ArrayType(key))])
    return data.sparkSession.createDataFrame([r[:3] for r in rows], schema)


def _closed_by_ranges(data: DataFrame, entity_column: str, date_column: str, order: list[Column], sort: list[Column], ranges: DataFrame) -> DataFrame:
    """data with effective_to.  Rows of large entities are dealt to ranges of their order; the first row of a range, which is
    known beforehand, closes the last one of the range before."""
    hot, key, at, last = (fresh(data, x) for x in ("hot", "key", "range", "last"))
    ranges = ranges.select(F.col("e").alias(f"{hot}e"), F.struct("bounds", "groups").alias(hot))
    # As bounds are sorted, the number of groups that begin at or before the key leads to the group in which it lies.
    group = f"size(filter({hot}.groups, g -> g[0] <= {key}))"
    number = F.expr(f"if({hot} IS NULL OR {group} = 0, 0, ({group} - 1) * size({hot}.groups[0]) + size(filter({hot}.groups[{group} - 1], b -> b <= {key})))")
    data = data.join(F.broadcast(ranges), quoted(entity_column).eqNullSafe(F.col(f"{hot}e")), "left")
    data = data.withColumn(key, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).withColumn(at, number)
    data = data.withColumn(hot, F.get(F.col(f"{hot}.bounds"), F.col(at))["k0"]).drop(key, f"{hot}e")  # the date after the range
    w = Window.partitionBy(quoted(entity_column), F.col(at)).orderBy(*sort)
    data = data.withColumns({"effective_to": F.lead(quoted(date_column)).over(w), last: F.lead(F.lit(True)).over(w).isNull()})
    return data.withColumn("effective_to", F.when(F.col(last), F.col(hot)).otherwise(F.col("effective_to"))).drop(hot, at, last)


def scd_type_2(ctx: RosterContext, entity_column: str = "employee_id", date_column: str = "start_date", tie_break: list[str] | None = None, ordered: bool = False, split_entities: bool = True, dry_run: bool = False) -> RosterContext:
    """date_column becomes effective_from; effective_to is the entity's next date; is_current if there is none.

    Nulls come first; ties go by tie_break, then by the order of rows.  One shuffle by entity: the new order of rows (entity,
    date, ties) is kept in the hidden row id, and only sinks sort by it; ordered=True sorts here.

    Entities (or a null entity) that hold more than a task's share of all rows are found by a sample of the key columns, of
    bounded size, and dealt to ranges of their order, whatever the type of the date; the others' rows stay together.
    split_entities=False leaves the sample out, for data of which it is known that no entity is that large.  The source must give the
    same rows each time it is read."""
    missing = [c for c in (entity_column, date_column) if c not in ctx.data.columns]
    if missing:
        raise LogicError(f"scd_type_2: column(s) not found: {', '.join(missing)}")
    if entity_column == date_column or ("effective_from" in ctx.data.columns and date_column != "effective_from"):
        raise LogicError("scd_type_2: effective_from would not be unique")
    ties = [quoted(c) for c in tie_break or []] + ([quoted(ROW_ID)] if ROW_ID in ctx.data.columns else [])
    keys, order = [quoted(date_column), *ties], [quoted(date_column).asc_nulls_first(), *ties]
    data = ctx.data.drop(*[c for c in ("effective_to", "is_current") if c != date_column and c != entity_column])
    ranges = _ranges(data, entity_column, keys) if split_entities and not dry_run else None
    if ranges is not None:
        data = _closed_by_ranges(data, entity_column, date_column, keys, order, ranges)
    else:
        w = Window.partitionBy(quoted(entity_column)).orderBy(*order)
        data = data.withColumn("effective_to", F.lead(quoted(date_column)).over(w))
    if ordered:
        data = data.orderBy(quoted(entity_column).asc_nulls_first(), *order)
    if ROW_ID in data.columns:
        data = data.withColumn(ROW_ID, F.struct(quoted(entity_column).alias("e"), quoted(date_column).alias("d"), *[t.alias(f"t{k}") for k, t in enumerate(ties)]))
    data = data.select(*[quoted(c).alias("effective_from" if c == date_column else c) for c in data.columns]).withColumn("is_current", F.col("effective_to").isNull())
    if dry_run:
        data = data.withColumn("effective_to", F.col("effective_to").cast("string"))
    names = ("effective_from", "effective_to", "is_current")
    return ctx.with_data(data).came_from(names, "LOGIC_ACTION", "scd_type_2")
