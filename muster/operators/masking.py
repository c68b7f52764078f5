"""Mask personal data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType

from ..context import RosterContext, Warning_, quoted
from ..errors import LogicError


@dataclass(frozen=True)
class Mask:
    name: str
    strategy: str = "redact"
    keep_last: int = 4
    mask_prefix: str = "***-**-"


def redacted(c: Column, keep: int, prefix: str) -> Column:
    """The prefix and the last ``keep`` bytes, or ???? if there are fewer; a character that the cut would split is left out."""
    raw = c.cast("binary")
    tail = F.substring(raw, F.octet_length(c) - keep + 1, F.lit(keep)) if keep else F.lit("").cast("binary")
    whole = F.unhex(F.regexp_replace(F.hex(tail), "^(?:[89AB][0-9A-F])+", "")).cast("string")
    return F.when(c.isNull(), None).otherwise(F.concat(F.lit(prefix), F.when(F.octet_length(c) >= keep, whole).otherwise("????")))


def pii_masking(ctx: RosterContext, columns: list[Mask], dry_run: bool = False) -> RosterContext:
    """``zero`` gives 0 in every row, also for null, in the column's number type, or bigint for others; every other strategy
    redacts.  A missing column gives a warning."""
    data, done = ctx.data, []
    for m in columns:
        if m.name not in ctx.data.columns:
            if not dry_run:
                ctx.warnings.add(Warning_("pii_masking", f"nothing to mask: no column '{m.name}'", 0))
            continue
        kind = ctx.data.schema[m.name].dataType
        if m.strategy == "zero":
            to = kind if isinstance(kind, IntegerType | LongType | FloatType | DoubleType) else LongType()
            data = data.withColumn(m.name, F.lit(0).cast(to))
        elif isinstance(kind, StringType):
            data = data.withColumn(m.name, redacted(quoted(m.name), m.keep_last, m.mask_prefix))
        elif not dry_run:
            raise LogicError(f"pii_masking: column '{m.name}' is not a string column")
        done.append(m.name)
    return ctx.with_data(data).came_from(done, "LOGIC_ACTION", "pii_masking")
