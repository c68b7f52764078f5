"""Mark rows of the same identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import ROW_ID, RosterContext, Warning_, fresh, numbered, quoted
from ..errors import LogicError
from .rows import text_column

ADDED = ("canonical_id", "is_duplicate")


def identity_deduplicator(ctx: RosterContext, columns: list[str] | None = None, employee_id_column: str = "employee_id", dry_run: bool = False) -> RosterContext:
    """Adds canonical_id (of the first row with the same key) and is_duplicate; no row goes.

    The key is the first of the columns that isn't null; rows without one are their own key.  The first row of each key that
    several rows share is found by an aggregation that combines before the shuffle, and joined back: as a broadcast where
    Spark measures these keys as small, else by a shuffle, in which Spark's adaptive execution splits a key that very many rows
    share.  The source must number its rows alike each time it is read."""
    columns = ["national_id", "email"] if columns is None else columns
    if dry_run:
        data = ctx.data.withColumns({"canonical_id": F.lit(None).cast("string"), "is_duplicate": F.lit(None).cast("boolean")})
        return ctx.with_data(data).came_from(ADDED, "LOGIC_ACTION", "identity_deduplicator")
    present = [c for c in columns if c in ctx.data.columns]
    if not present:
        ctx.warnings.add(Warning_("identity_deduplicator", f"no identity column among {', '.join(columns)}; rows are not marked", 0))
        return ctx
    if employee_id_column not in ctx.data.columns:
        raise LogicError(f"identity_deduplicator: column '{employee_id_column}' not found")
    for c in (*present, employee_id_column):
        text_column(ctx, c, "identity_deduplicator")
    data = ctx.data if ROW_ID in ctx.data.columns else numbered(ctx.data)
    data = data.drop(*[c for c in ADDED if c not in (*present, employee_id_column)])
    key, first, n = (fresh(data, x) for x in ("key", "first", "n"))
    keyed = data.withColumn(key, F.coalesce(*[quoted(c) for c in present]))
    own = F.coalesce(quoted(employee_id_column), F.lit("unknown"))
    groups = keyed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(quoted(ROW_ID).alias("row"), own.alias("id"))).alias(first), F.count("*").alias(n))
    out = keyed.join(groups.filter(F.col(n) > 1).drop(n), key, "left")
    added = {"canonical_id": F.coalesce(F.col(f"{first}.id"), own), "is_duplicate": F.coalesce(F.col(f"{first}.row") != quoted(ROW_ID), F.lit(False))}
    out = out.withColumns(added).drop(key, first)
    if ROW_ID not in ctx.data.columns:
        out = out.drop(ROW_ID)
    return ctx.with_data(out).came_from(ADDED, "LOGIC_ACTION", "identity_deduplicator")
