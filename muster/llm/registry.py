"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, bpe, exact_dedup, hpylm, license_scan, mixing, periods, quality_gbt, quality_rules, records, simhash, token_counts, url_filter

MODULES = {
    "op1_license_scan": license_scan,
    "op2_quality_rules": quality_rules,
    "op3_url_filter": url_filter,
    "op4_hpylm": hpylm,
    "op5_mixing": mixing,
    "op6_byte_bpe": bpe,
    "op7_exact_dedup": exact_dedup,
    "op8_simhash": simhash,
    "op9_token_counts": token_counts,
    "op10_quality_gbt": quality_gbt,
    "op11_token_records": records,
    "op12_token_alignment": alignment,
    "op13_periodic_runs": periods,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if hasattr(module, "SQL")}
