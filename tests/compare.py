"""Comparison of a Spark result with the other engine's."""

import duckdb
import numpy as np
import pandas.api.types as kinds

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    frame = frame.copy()
    for c in frame.columns:
        number = kinds.is_numeric_dtype(frame[c]) and not kinds.is_bool_dtype(frame[c])
        frame[c] = frame[c].astype(float).round(9) if number else frame[c].astype(str)
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns).reset_index(drop=True)


def same(df, sql, sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    ours, theirs = plain(df.toPandas()), plain(db.sql(sql).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for c in ours.columns:
        if ours[c].dtype.kind == "f":
            assert np.isclose(ours[c], theirs[c], equal_nan=True, rtol=1e-12, atol=2e-9).all(), c
        else:
            assert (ours[c] == theirs[c]).all(), c
