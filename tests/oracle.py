"""Compare a plan's rows with its SQL twin's rows."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        col = frame[c]
        if pd.api.types.is_bool_dtype(col):
            frame[c] = col.astype(str)
        elif pd.api.types.is_numeric_dtype(col):
            frame[c] = col.astype(float)
        else:
            frame[c] = col.map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    masked = [c for c in sql_rows.columns if pd.api.types.is_extension_array_dtype(sql_rows[c]) and pd.api.types.is_integer_dtype(sql_rows[c])]
    sql_rows = sql_rows.astype({c: float for c in masked if sql_rows[c].isna().any()})  # as pandas shows Spark's integers with nulls
    kinds = {c: (spark_rows[c].dtype.kind, sql_rows[c].dtype.kind) for c in spark_rows.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and set(k) - set("iu")}
    if odd and len(spark_rows):
        return f"types {odd}"
    a, b = _plain(spark_rows), _plain(sql_rows)
    for c in a.columns:
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            same = np.isclose(a[c], b[c], rtol=1e-12, atol=1e-12, equal_nan=True)
        else:
            same = (a[c] == b[c]).to_numpy()
        if not same.all():
            at = int(np.argmin(same))
            return f"column {c}: {a.iloc[at].to_dict()} != {b.iloc[at].to_dict()} ({(~same).sum()} rows)"
    return None
