"""Errors of pipelines."""

from __future__ import annotations


class MusterError(Exception):
    prefix = ""

    def __str__(self) -> str:
        return f"{self.prefix}{super().__str__()}"


class IngestionError(MusterError):
    prefix = "Ingestion error: "


class ValidationError(MusterError):
    prefix = "Validation error: "


class LogicError(MusterError):
    prefix = "Logic error: "


class EgressError(MusterError):
    pass


class ConfigurationError(MusterError):
    prefix = "Configuration error: "


class ConflictError(MusterError):
    prefix = "Conflict: "


class StepError(MusterError):
    """A failed step, with the warnings that earlier steps gave."""

    def __init__(self, action_id: str, action_type: str, error: Exception, warnings: list | None = None) -> None:
        super().__init__(str(error))
        self.action_id, self.action_type, self.error, self.warnings = action_id, action_type, error, warnings or []
