"""Letters with diacritics become plain ones."""

from __future__ import annotations

from ..context import RosterContext, quoted
from ..errors import LogicError
from ..functions.text import without_diacritics
from .rows import text_column


def handle_diacritics(ctx: RosterContext, columns: list[str], output_suffix: str | None = None, dry_run: bool = False) -> RosterContext:
    """In place, or in new columns with the suffix; every result is made from the columns as they came."""
    if dry_run and not output_suffix:
        return ctx.came_from(columns, "handle_diacritics")
    for c in columns:
        text_column(ctx, c, "handle_diacritics")
    names = [c + (output_suffix or "") for c in columns]
    if output_suffix and (taken := [n for n in names if n in ctx.data.columns]):
        raise LogicError(f"handle_diacritics: column(s) already exist: {', '.join(taken)}")
    data = ctx.data.withColumns({n: without_diacritics(quoted(c)) for n, c in zip(names, columns)}) if columns else ctx.data
    return ctx.with_data(data).came_from(names, "handle_diacritics")
