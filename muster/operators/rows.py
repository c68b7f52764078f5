"""Filter rows by a pattern, and replace the first match of one."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..context import RosterContext, Warning_, fresh, quoted
from ..errors import ConfigurationError, LogicError
from ..functions.patterns import MOST_REPLACEMENT, check, found, replace_first


def text_column(ctx: RosterContext, column: str, action: str) -> None:
    if column not in ctx.data.columns:
        raise LogicError(f"{action}: column '{column}' not found")
    if not isinstance(ctx.data.schema[column].dataType, StringType):
        raise LogicError(f"{action}: column '{column}' is not a string column")


def _configured(column: str, pattern: str) -> None:
    if not column:
        raise ConfigurationError("column must not be empty")
    check(pattern)


def filter_by_value(ctx: RosterContext, column: str, pattern: str, dry_run: bool = False) -> RosterContext:
    """Rows in whose column the pattern is found; null never matches."""
    _configured(column, pattern)
    if dry_run:
        return ctx
    text_column(ctx, column, "filter_by_value")
    keep = F.coalesce(found(quoted(column), pattern), F.lit(False))

    def warned(got: dict) -> Warning_ | None:
        n, lost = got["n"] or 0, got["lost"] or 0
        return Warning_("filter_by_value", f"'{column}': {lost} of {n} row(s) dropped", lost) if lost else None

    mark = fresh(ctx.data, "keep")
    data = ctx.warnings.observe(ctx.data.withColumn(mark, keep), warned, n=F.count("*"), lost=F.count_if(~F.col(mark)))
    return ctx.with_data(data.filter(F.col(mark)).drop(mark))


def regex_replace(ctx: RosterContext, column: str, pattern: str, replacement: str, dry_run: bool = False) -> RosterContext:
    """The first match replaced by the replacement as it stands; null stays null."""
    _configured(column, pattern)
    if len(replacement.encode()) > MOST_REPLACEMENT:
        raise ConfigurationError(f"replacement is longer than {MOST_REPLACEMENT} bytes")
    if not dry_run:
        text_column(ctx, column, "regex_replace")
        ctx = ctx.with_data(ctx.data.withColumn(column, replace_first(quoted(column), pattern, replacement)))
    return ctx.came_from([column], "LOGIC_ACTION", "regex_replace")
