"""Side-by-side comparison of a query with its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return str(v)
        return f"{float(v):.6f}"

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
