"""Phone numbers get their country's calling code."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..context import RosterContext, Warning_, fresh, quoted
from ..errors import ConfigurationError, LogicError
from ..functions.lookups import dial_codes, looked_up


def cellphone_sanitizer(ctx: RosterContext, phone_column: str, country_columns: list[str], output_column: str, dry_run: bool = False) -> RosterContext:
    """Digits and + only.  A number that starts with + stays; else one leading 0 goes and the calling code of the first country
    column that resolves (alpha-2 or alpha-3) comes before it; with none, the digits stay.  Empty numbers become null."""
    if not phone_column or not output_column or not country_columns or not all(country_columns):
        raise ConfigurationError("phone_column, country_columns and output_column must not be empty")
    missing = [c for c in (phone_column, *country_columns) if c not in ctx.data.columns]
    if missing:
        raise LogicError(f"cellphone_sanitizer: column(s) not found: {', '.join(missing)}")
    texts = [c for c in country_columns if isinstance(ctx.data.schema[c].dataType, StringType) or dry_run]
    data, found = ctx.data, []
    for c in texts:
        found.append(fresh(data, "dial"))
        data = looked_up(data, dial_codes(), quoted(c), found[-1])
    dial = F.coalesce(*map(F.col, found), F.lit(None).cast("string"))
    phone = quoted(phone_column).cast("string")
    digits = F.regexp_replace(phone, "[^0-9+]", "")
    number = (
        F.when(digits == "", None)
        .when(digits.startswith("+") | dial.isNull(), digits)
        .otherwise(F.concat(F.lit("+"), dial, F.lit(" "), F.regexp_replace(digits, "^0", "")))
    )
    if not dry_run:

        def warned(got: dict) -> Warning_ | None:
            n = got["unresolved"]
            return Warning_("cellphone_sanitizer", f"{n} number(s) without a known country have no calling code", n) if n else None

        data = ctx.warnings.observe(data, warned, unresolved=F.count_if(phone.isNotNull() & dial.isNull()))
    data = data.withColumn(output_column, number).drop(*found)
    return ctx.with_data(data).came_from([output_column], "cellphone_sanitizer", "cellphone_sanitizer")
