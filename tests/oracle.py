"""Rows of a query and of its SQL, in a form that compares."""

import math

import duckdb


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.to_pydatetime() if hasattr(v, "to_pydatetime") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(tidy(r[k]) for k in order) for r in data), key=repr)


def differ(df, sql, sf_dir):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, want.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if len(a) == len(b) and not bad else f"{len(a)} rows against {len(b)}, {len(bad)} differ, first {bad[:1]}"
