"""JSON schemas of the actions' configurations, for editors and agents that write manifests."""

from __future__ import annotations

from ..errors import ConfigurationError
from .manifest import REGISTRY

_TEXT, _TEXTS, _FLAG, _COUNT = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "boolean"}, {"type": "integer", "minimum": 0}
_MAP = {"type": "object", "additionalProperties": {"type": "string"}}


def _object(required: dict, optional: dict | None = None) -> dict:
    return {"type": "object", "properties": required | (optional or {}), "required": list(required)}


_MASK = _object({"name": _TEXT}, {"strategy": {"enum": ["redact", "zero"]}, "keep_last": _COUNT, "mask_prefix": _TEXT})
_DESTINATION = {"schema": _MAP, "body_path": _TEXT, "batch_rows": _COUNT}
SCHEMAS = {
    "generic_ingestion_connector": _object({"filename": _TEXT}, {"columns": _TEXTS, "table_index": _COUNT, "multi_line": _FLAG}),
    "workday_hris_connector": _object({k: _TEXT for k in ("tenant_url", "tenant_id", "username", "password")}, {"worker_count_limit": _COUNT, "response_group": {"type": "object", "additionalProperties": _FLAG}}),
    "sage_hr_connector": _object({"subdomain": _TEXT, "api_token": _TEXT}, {f"include_{h}_history": _FLAG for h in ("team", "employment_status", "position")}),
    "scd_type_2": _object({}, {"entity_column": _TEXT, "date_column": _TEXT, "tie_break": _TEXTS, "split_entities": _FLAG}),
    "pii_masking": _object({}, {"columns": {"type": "array", "items": _MASK}, "mask_ssn": _FLAG, "mask_salary": _FLAG}),
    "identity_deduplicator": _object({}, {"columns": _TEXTS, "employee_id_column": _TEXT}),
    "regex_replace": _object({"column": _TEXT, "pattern": _TEXT, "replacement": _TEXT}),
    "filter_by_value": _object({"column": _TEXT, "pattern": _TEXT}),
    "iso_country_sanitizer": _object({"source_column": _TEXT, "output_column": _TEXT}, {"output_format": {"enum": ["alpha2", "alpha3"]}}),
    "cellphone_sanitizer": _object({"phone_column": _TEXT, "country_columns": _TEXTS, "output_column": _TEXT}),
    "handle_diacritics": _object({"columns": _TEXTS}, {"output_suffix": _TEXT}),
    "rename_column": _object({"mapping": _MAP}),
    "drop_column": _object({"columns": _TEXTS}),
    "api_dispatcher": {
        "oneOf": [
            _object({"destination_url": _TEXT}, {"auth_type": {"enum": ["bearer", "api_key", "none"]}, "token": _TEXT, "placement": {"enum": ["authorization_header", "custom_header", "query_param"]}, "placement_key": _TEXT, "extra_headers": _MAP} | _DESTINATION),
            _object({"auth_type": {"enum": ["oauth", "oauth1"]}} | {k: _TEXT for k in ("destination_url", "consumer_key", "consumer_secret", "access_token", "token_secret")}, _DESTINATION),
            _object({"auth_type": {"enum": ["oauth2", "oidc", "openid"]}} | {k: _TEXT for k in ("destination_url", "client_id", "client_secret", "token_url")}, {"scopes": _TEXTS, "grant_type": {"enum": ["client_credentials", "authorization_code"]}, "refresh_token": _TEXT} | _DESTINATION),
            _object({"auth_type": {"enum": ["default"]}}),
        ]
    },
    "show_data": _object({}),
}


def action_schema(action_type: str) -> dict:
    if action_type not in REGISTRY:
        raise ConfigurationError(f"unknown action type '{action_type}'")
    return SCHEMAS[action_type]


def manifest_schema() -> dict:
    actions = [_object({"id": _TEXT, "action_type": {"const": k}, "config": v}) for k, v in SCHEMAS.items()]
    return _object({"version": _TEXT, "actions": {"type": "array", "items": {"oneOf": actions}}})
