"""Run a manifest, or validate it without reading any data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException

from ..context import RosterContext, visible
from ..errors import LogicError, MusterError, StepError, ValidationError
from ..sinks.auth import auth_from, resolved
from ..sources.convert import prepare_source
from .manifest import SINKS, Environment, Manifest, Step, start


def run_steps(manifest: Manifest, env: Environment) -> RosterContext:
    """The table after all steps, as a plan; the first step that fails ends the run."""

    def step(ctx: RosterContext, s: Step) -> RosterContext:
        try:
            return s.execute(ctx, env)
        except (MusterError, AnalysisException) as e:
            error = e if isinstance(e, MusterError) else LogicError(str(e).splitlines()[0])
            raise StepError(s.action_type, s.action_type, error, ctx.warnings.drain(ran=False)) from e

    return reduce(step, manifest.actions, start(env.spark))


def prepare_sources(manifest: Manifest, env: Environment, uploads: str) -> dict[str, tuple[str, list[str]]]:
    """Convert what each CSV source of the manifest needs from the folder of uploads, by its filename and table_index."""
    steps = [s for s in manifest.actions if s.action_type == "generic_ingestion_connector"]
    return {s.id: prepare_source(env.spark, env.location, f"{uploads}/{s.config['filename']}", s.config.get("table_index") or 0) for s in steps}


@dataclass(frozen=True)
class StepColumns:
    action_id: str
    action_type: str
    columns_after: list[str]


@dataclass(frozen=True)
class Validation:
    steps: list[StepColumns]
    final_columns: list[str]


def validate(manifest: Manifest, env: Environment) -> Validation:
    """Columns after every step, by analysis of an empty table: no job runs, no file is opened."""
    ctx, steps = start(env.spark), []
    for s in manifest.actions:
        try:
            ctx = s.execute(ctx, env, dry_run=True)
            columns = ctx.columns
        except (MusterError, AnalysisException) as e:
            error = e if isinstance(e, MusterError) else LogicError(str(e).splitlines()[0])
            raise StepError(s.id, s.action_type, error) from e
        steps.append(StepColumns(s.id, s.action_type, columns))
    return Validation(steps, steps[-1].columns_after if steps else [])


def validate_pipeline(manifest: Manifest, env: Environment, check_egress: bool = True) -> Validation:
    """validate, and whether the last step is a sink whose required columns the pipeline produces."""
    try:
        got = validate(manifest, env)
    except StepError as e:
        raise ValidationError(f"{e.action_type} '{e.action_id}' fails: {str(e.error).split(';')[0]}") from e
    if not check_egress:
        return got
    if not manifest.actions:
        raise ValidationError("a manifest needs steps")
    last = manifest.actions[-1]
    if last.action_type == "show_data":
        return got
    if last.action_type != "api_dispatcher":
        raise ValidationError(f"the last step must be a sink ({' or '.join(SINKS)}), not '{last.action_type}'")
    try:
        auth = resolved(auth_from(last.config), env.settings)
    except MusterError as e:
        raise ValidationError(e.args[0]) from e
    missing = [k for k in auth.schema if k not in got.final_columns]
    if missing:
        raise ValidationError(f"the endpoint's schema asks for columns that the last step does not have: {', '.join(missing)}")
    return got


@dataclass(frozen=True)
class Outcome:
    status: str
    rows: int | None
    warnings: list
    error: str | None = None
    error_action: str | None = None
    columns: list[str] | None = None


def run(manifest: Manifest, env: Environment, log=None) -> Outcome:
    """Validate, build and run all steps, count the rows, and keep a record of it in log (a RunLog)."""
    run_id = log.begin(manifest) if log else None
    try:
        got = validate(manifest, env)
        if log:
            log.validated(run_id, got)
    except StepError as e:
        out = Outcome("validation_failed", None, e.warnings, str(e.error), e.action_id)
        if log:
            log.end(run_id, out)
        return out
    try:
        ctx = run_steps(manifest, env)
        rows = visible(ctx.data).count() if not ctx.warnings.pending else _full_count(ctx)
        out = Outcome("success", rows, ctx.warnings.drain(), columns=ctx.columns)
        ctx.release()
    except StepError as e:
        out = Outcome("failed", None, e.warnings, str(e.error), e.action_id)
    except Exception as e:  # a job that fails closes its record as well
        out = Outcome("failed", None, [], str(e).splitlines()[0])
    if log:
        log.end(run_id, out)
    return out


def _full_count(ctx: RosterContext) -> int:
    """Rows of a table with observed counts: all its columns are made, so that nothing observed is pruned."""
    from pyspark.sql import functions as F

    return ctx.data.agg(F.count("*"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in ctx.data.columns])) if ctx.data.columns else F.lit(0)).first()[0]
