"""Hold a Spark result against SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def texts(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        if str(df[c].dtype) in ("Int64", "Float64", "float64"):
            df[c] = df[c].astype(float)
    df = df.astype(str).replace({"nan": "None", "<NA>": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def by_sql(sql: str, sf: str) -> pd.DataFrame:
    c = duckdb.connect()
    for p in Path(sf).iterdir():
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c.sql(sql).df()


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(texts(got), texts(want), check_dtype=False)
