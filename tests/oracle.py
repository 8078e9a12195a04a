"""Compares a query with its SQL twin in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for r in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(None if pd.isna(v) else (round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else v) for v in r))
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in r))


def differences(a: pd.DataFrame, b: pd.DataFrame) -> list[str]:
    out = []
    if sorted(a.columns) != sorted(b.columns):
        return [f"columns {sorted(a.columns)} and {sorted(b.columns)}"]
    x, y = norm(a), norm(b)
    if len(x) != len(y):
        out.append(f"{len(x)} and {len(y)} rows")
    for r, s in zip(x, y):
        if any(u != v and not (isinstance(u, float) and isinstance(v, (float, int)) and abs(u - v) <= 2e-5 * max(1, abs(u))) for u, v in zip(r, s)):
            out.append(f"{r} and {s}")
            if len(out) > 3:
                break
    return out
