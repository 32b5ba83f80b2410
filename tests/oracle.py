import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark, sf_dir, run, sql):
    """Both engines' rows, columns by name, values rounded as the driver does."""
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = con.execute(sql)
    at = {c[0]: i for i, c in enumerate(found.description)}
    assert sorted(at) == names
    expected = sorted((tuple(plain(r[at[c]]) for c in names) for r in found.fetchall()), key=repr)
    assert got == expected
    return got
