"""Holds a Spark result against DuckDB SQL over the same files."""

import os

import duckdb


def plain(v):
    if v is None or type(v).__name__ in ("NaTType", "NAType") or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, bool):
        return v
    return round(float(v), 9) if isinstance(v, int | float) or type(v).__name__ == "Decimal" else str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(v) for v in r]) for r in frame.astype(object).values.tolist())


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = df.toPandas(), con.execute(sql).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows_of(ours), rows_of(theirs)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
