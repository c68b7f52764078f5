"""Apply the steps of a manifest to a stream.

Row-wise steps run as they do on tables.  Identities keep their state by key; history, which may only be the last step,
gives changes (see ``stateful``, whose settings the session then needs)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..context import RosterContext
from ..errors import ConfigurationError
from ..plans.manifest import SINKS, SOURCES, Environment, Manifest
from . import stateful


def stream(rows: DataFrame, manifest: Manifest, env: Environment) -> DataFrame:
    """rows, a streaming DataFrame, through all steps; warnings that count rows are left to the stream's own metrics."""
    ctx = RosterContext(rows)
    ctx.warnings.observe = lambda df, make, **counts: df
    for k, s in enumerate(manifest.actions):
        if s.action_type in (*SOURCES, *SINKS):
            raise ConfigurationError(f"'{s.action_type}' cannot be a step of a stream")
        if s.action_type == "identity_deduplicator":
            keys = [c for c in s.config.get("columns") or ["national_id", "email"] if c in ctx.columns]
            if keys:
                ctx = ctx.with_data(stateful.identities(ctx.data, keys, s.config.get("employee_id_column") or "employee_id", s.config.get("order_column")))
        elif s.action_type == "scd_type_2":
            if k + 1 < len(manifest.actions):
                raise ConfigurationError("'scd_type_2' gives changes on a stream, so it must be the last step")
            return stateful.history(ctx.data, s.config.get("entity_column") or "employee_id", s.config.get("date_column") or "start_date", s.config.get("tie_break"))
        else:
            ctx = s.execute(ctx, env)
    return ctx.data
