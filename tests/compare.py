"""Order-insensitive comparison of query results with SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _text(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(_text, v)) + "]"
    return str(v)


def normal(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_text, row)) for row in frame.itertuples(index=False, name=None))


def assert_same(spark_frame, sql_frame):
    assert sorted(spark_frame.columns) == sorted(sql_frame.columns)
    assert normal(spark_frame) == normal(sql_frame)
