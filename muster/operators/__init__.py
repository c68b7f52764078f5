"""Transforms: each takes a context and gives a new one; all data work is in column expressions and windows."""

from .columns import drop_column, rename_column
from .country import iso_country_sanitizer
from .dedup import identity_deduplicator
from .diacritics import handle_diacritics
from .masking import pii_masking
from .phone import cellphone_sanitizer
from .rows import filter_by_value, regex_replace
from .scd import scd_type_2

__all__ = ["cellphone_sanitizer", "drop_column", "filter_by_value", "handle_diacritics", "identity_deduplicator", "iso_country_sanitizer", "pii_masking", "regex_replace", "rename_column", "scd_type_2"]
