"""Manifests: an ordered list of actions, and the registry that turns each into work on a table."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from .. import operators as ops
from ..context import RosterContext, Warnings
from ..errors import ConfigurationError
from ..operators.masking import Mask
from ..sinks.auth import DEFAULT, auth_from, resolved
from ..sinks.dispatch import BATCH_ROWS, Dispatcher, api_dispatcher
from ..sinks.show_data import show_data
from ..sources.csv import Location, checked_filename, empty, generic_ingestion
from ..sources.sage import COLUMNS as SAGE_COLUMNS
from ..sources.sage import SageConfig, sage
from ..sources.workday import COLUMNS as WORKDAY_COLUMNS
from ..sources.workday import ResponseGroup, WorkdayConfig, workday


@dataclass(frozen=True)
class Environment:
    """What actions need besides their configuration; transports can be replaced in tests."""

    spark: SparkSession
    location: Location | None = None
    settings: dict | None = None
    clients: dict = field(default_factory=dict)


Execute = Callable[[RosterContext, dict, Environment, bool, str], RosterContext]
REGISTRY: dict[str, Execute] = {}
SOURCES, SINKS = ("generic_ingestion_connector", "workday_hris_connector", "sage_hr_connector"), ("api_dispatcher", "show_data")


def action(name: str) -> Callable[[Execute], Execute]:
    """Register an action type: f(context, config, environment, dry_run, action id)."""

    def put(f: Execute) -> Execute:
        REGISTRY[name] = f
        return f

    return put


def _taken(config: dict, required: tuple[str, ...], optional: dict) -> dict:
    missing = [k for k in required if config.get(k) is None]
    if missing:
        raise ConfigurationError(f"missing field(s): {', '.join(missing)}")
    return {k: config[k] for k in required} | {k: v if config.get(k) is None else config[k] for k, v in optional.items()}


def _fresh(ctx: RosterContext, got: RosterContext) -> RosterContext:
    """A source replaces table and metadata; warnings go on."""
    return replace(got, warnings=ctx.warnings)


@action("generic_ingestion_connector")
def _(ctx, config, env, dry_run, _id):
    c = _taken(config, ("filename",), {"columns": None, "table_index": 0, "multi_line": True})
    checked_filename(c["filename"])
    if dry_run:
        names = c["columns"] or []
        return _fresh(ctx, RosterContext(empty(env.spark, names)).came_from(names, "GENERIC_INGESTION"))
    return _fresh(ctx, generic_ingestion(env.spark, env.location, c["filename"], c["columns"], c["multi_line"]))


@action("workday_hris_connector")
def _(ctx, config, env, dry_run, _id):
    c = _taken(config, ("tenant_url", "tenant_id", "username", "password"), {"worker_count_limit": 200, "response_group": {}})
    try:
        c["response_group"] = ResponseGroup(**c["response_group"])
    except TypeError as e:
        raise ConfigurationError(str(e)) from e
    if dry_run:
        return _fresh(ctx, RosterContext(empty(env.spark, list(WORKDAY_COLUMNS))).came_from(list(WORKDAY_COLUMNS), "WORKDAY_HRIS"))
    return _fresh(ctx, workday(env.spark, WorkdayConfig(**c), env.clients.get("soap")))


@action("sage_hr_connector")
def _(ctx, config, env, dry_run, _id):
    flags = {f"include_{h}_history": False for h in ("team", "employment_status", "position")}
    c = _taken(config, ("subdomain", "api_token"), flags)
    if dry_run:
        return _fresh(ctx, RosterContext(empty(env.spark, list(SAGE_COLUMNS))).came_from(SAGE_COLUMNS, "SAGE_HR"))
    return _fresh(ctx, sage(env.spark, SageConfig(**c), env.clients.get("rest")))


@action("scd_type_2")
def _(ctx, config, env, dry_run, _id):
    return ops.scd_type_2(ctx, **_taken(config, (), {"entity_column": "employee_id", "date_column": "start_date", "tie_break": None, "split_entities": True}), dry_run=dry_run)


@action("pii_masking")
def _(ctx, config, env, dry_run, _id):
    return ops.pii_masking(ctx, masks(config), dry_run)


def masks(config: dict) -> list[Mask]:
    """Of ``columns``, or of the older form with mask_ssn and mask_salary, both true if missing."""
    if "columns" not in config:
        both = (("mask_ssn", Mask("ssn")), ("mask_salary", Mask("salary", "zero")))
        return [m for flag, m in both if config.get(flag, True)]
    out = []
    for c in config["columns"]:
        c = _taken(c, ("name",), {"strategy": "redact", "keep_last": 4, "mask_prefix": "***-**-"})
        out.append(Mask(**c | {"strategy": c["strategy"] if c["strategy"] == "zero" else "redact"}))
    return out


@action("identity_deduplicator")
def _(ctx, config, env, dry_run, _id):
    return ops.identity_deduplicator(ctx, **_taken(config, (), {"columns": ["national_id", "email"], "employee_id_column": "employee_id"}), dry_run=dry_run)


@action("regex_replace")
def _(ctx, config, env, dry_run, _id):
    return ops.regex_replace(ctx, **_taken(config, ("column", "pattern", "replacement"), {}), dry_run=dry_run)


@action("filter_by_value")
def _(ctx, config, env, dry_run, _id):
    return ops.filter_by_value(ctx, **_taken(config, ("column", "pattern"), {}), dry_run=dry_run)


@action("iso_country_sanitizer")
def _(ctx, config, env, dry_run, _id):
    return ops.iso_country_sanitizer(ctx, **_taken(config, ("source_column", "output_column"), {"output_format": "alpha2"}), dry_run=dry_run)


@action("cellphone_sanitizer")
def _(ctx, config, env, dry_run, _id):
    return ops.cellphone_sanitizer(ctx, **_taken(config, ("phone_column", "country_columns", "output_column"), {}), dry_run=dry_run)


@action("handle_diacritics")
def _(ctx, config, env, dry_run, _id):
    return ops.handle_diacritics(ctx, **_taken(config, (), {"columns": [], "output_suffix": None}), dry_run=dry_run)


@action("rename_column")
def _(ctx, config, env, dry_run, _id):
    return ops.rename_column(ctx, **_taken(config, ("mapping",), {}))


@action("drop_column")
def _(ctx, config, env, dry_run, _id):
    return ops.drop_column(ctx, **_taken(config, ("columns",), {}))


@action("api_dispatcher")
def _(ctx, config, env, dry_run, _id):
    auth = auth_from(config)
    if dry_run:
        return ctx
    transport = {"transport": env.clients["http"]} if "http" in env.clients else {}
    return api_dispatcher(ctx, Dispatcher(resolved(auth, env.settings), batch_rows=config.get("batch_rows", BATCH_ROWS) or None, in_tasks=config.get("in_tasks", not transport), **transport))


@action("show_data")
def _(ctx, config, env, dry_run, action_id):
    return show_data(ctx, env.location.output(action_id) if env.location else None, dry_run=dry_run)


@dataclass(frozen=True)
class Step:
    id: str
    action_type: str
    config: dict = field(default_factory=dict)

    def execute(self, ctx: RosterContext, env: Environment, dry_run: bool = False) -> RosterContext:
        return REGISTRY[self.action_type](ctx, self.config, env, dry_run, self.id)


@dataclass(frozen=True)
class Manifest:
    version: str
    actions: tuple[Step, ...]

    @classmethod
    def parse(cls, text: str | dict) -> Manifest:
        """From JSON; action types must be known and configurations objects (a missing one is empty)."""
        try:
            raw = json.loads(text) if isinstance(text, str) else text
            steps = tuple(Step(a["id"], a["action_type"], {} if a.get("config") is None else a["config"]) for a in raw["actions"])
            manifest = cls(raw["version"], steps)
        except (ValueError, KeyError, TypeError) as e:
            raise ConfigurationError(f"manifest cannot be read: {e!r}") from e
        for s in steps:
            if s.action_type not in REGISTRY:
                raise ConfigurationError(f"unknown action type '{s.action_type}'")
            if not isinstance(s.config, dict):
                raise ConfigurationError(f"the config of a {s.action_type} must be an object")
        return manifest

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "actions": [{"id": s.id, "action_type": s.action_type, "config": s.config} for s in self.actions]}, ensure_ascii=False)


def start(spark: SparkSession) -> RosterContext:
    return RosterContext(empty(spark, []), warnings=Warnings())


def uses_default_auth(manifest: Manifest) -> bool:
    return any(s.action_type == "api_dispatcher" and auth_from(s.config) == DEFAULT for s in manifest.actions)
