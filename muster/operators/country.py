"""Country names and codes become ISO codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..context import RosterContext, Warning_, fresh, quoted
from ..errors import ConfigurationError, LogicError
from ..functions.lookups import countries, country_keys, looked_up
from ..functions.text import trim_space

FORMATS = ("alpha2", "alpha3")
#: Values that a warning names.
NAMED = 10


def iso_country_sanitizer(ctx: RosterContext, source_column: str, output_column: str, output_format: str = "alpha2", dry_run: bool = False) -> RosterContext:
    """Unknown values become null and are counted in a warning; blank ones become null only."""
    if output_format not in FORMATS:
        raise ConfigurationError(f"output_format must be one of {', '.join(FORMATS)}")
    if not source_column or not output_column:
        raise ConfigurationError("source_column and output_column must not be empty")
    if source_column not in ctx.data.columns:
        raise LogicError(f"iso_country_sanitizer: column '{source_column}' not found")
    raw = quoted(source_column).cast("string")
    codes = country_keys() if output_format == "alpha2" else {k: countries()[c][0] for k, c in country_keys().items()}
    found = fresh(ctx.data, "code")
    data = before = looked_up(ctx.data, codes, raw, found)
    if not dry_run:
        unknown = raw.isNotNull() & (trim_space(raw) != "") & F.col(found).isNull()

        def warned(got: dict) -> Warning_ | None:
            if not got["unknown"]:
                return None
            common = before.filter(unknown).groupBy(raw.alias("v")).count().orderBy(F.desc("count"), "v").limit(NAMED).collect()
            return Warning_("iso_country_sanitizer", f"no ISO code for {got['unknown']} value(s)", got["unknown"], ", ".join(f"{r['v']} ({r['count']}x)" for r in common))

        data = ctx.warnings.observe(data, warned, unknown=F.count_if(unknown))
    data = data.withColumn(output_column, F.col(found)).drop(found)
    return ctx.with_data(data).came_from([output_column], "iso_country_sanitizer", "iso_country_sanitizer")
