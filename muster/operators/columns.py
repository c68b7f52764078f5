"""Rename and drop columns; both are strict about names."""

from __future__ import annotations

from ..context import ROW_ID, RosterContext, quoted
from ..errors import ConfigurationError, LogicError


def _present(ctx: RosterContext, names: list[str], what: str) -> None:
    missing = [n for n in names if n not in ctx.columns]
    if missing:
        raise LogicError(f"{what}: column(s) not found: {', '.join(missing)}")


def rename_column(ctx: RosterContext, mapping: dict[str, str]) -> RosterContext:
    """All renames at once, so columns can be swapped."""
    if len(set(mapping.values())) != len(mapping):
        raise ConfigurationError("rename targets must be unique")
    _present(ctx, list(mapping), "rename_column")
    names = [mapping.get(c, c) for c in ctx.data.columns]
    if len(set(names)) != len(names):
        raise LogicError("rename_column: a target is already a column")
    data = ctx.data.select([quoted(c).alias(n) for c, n in zip(ctx.data.columns, names)])
    return ctx.with_data(data).came_from(list(mapping.values()), "LOGIC_ACTION", "rename_column")


def drop_column(ctx: RosterContext, columns: list[str]) -> RosterContext:
    if len(set(columns)) != len(columns):
        raise ConfigurationError("columns to drop must be unique")
    _present(ctx, columns, "drop_column")
    keep = [quoted(c) for c in ctx.data.columns if c not in columns or c == ROW_ID]
    return ctx.with_data(ctx.data.select(keep)).modified(columns, "drop_column")
