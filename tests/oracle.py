import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(found, names):
    return sorted(repr([norm(r[names.index(n)]) for n in sorted(names)]) for r in found)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), names)
