"""Shared compare: Spark result vs DuckDB oracle, order-insensitive."""

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return repr(round(v, 9))
        if hasattr(v, "item"):
            return norm(v.item())
        return repr(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    cols = spark_df.columns
    rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(ocols), (cols, ocols)
    assert len(rows) == len(orows), (len(rows), len(orows))
    a, b = canon(rows, cols), canon(orows, ocols)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
