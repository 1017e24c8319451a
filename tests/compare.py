"""Compare a query with its SQL as the driver does."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(map(repr, ([r[i] for i in order] for r in cursor.fetchall())))


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(map(repr, ([r[n] for n in names] for r in df.collect())))
