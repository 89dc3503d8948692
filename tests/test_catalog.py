"""Every registered query against its SQL on the small tables."""

import math
import pathlib
from collections import Counter

import duckdb
import pytest

from tidewater import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for p in pathlib.Path(SF).glob("*.parquet"):
            connection.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        yield connection


def plain(value):
    return "NaN" if isinstance(value, float) and math.isnan(value) else 0.0 if value == 0 and isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(map(plain, r)) for r in df.collect()] if name != "feat_hist" else df.collect()
    assert got
    if name in catalog.ORACLE_SQL:
        columns = ", ".join(f'"{c}"' for c in df.columns)
        want = [tuple(map(plain, r)) for r in db.sql(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall()]
        assert Counter(got) == Counter(want)
        kinds = dict(zip(df.columns, db.sql(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").types))
        assert {c: k for c, k in df.dtypes if k in ("bigint", "int")} == {c: {"BIGINT": "bigint", "INTEGER": "int"}.get(str(t), str(t)) for c, t in kinds.items() if dict(df.dtypes)[c] in ("bigint", "int")}


@pytest.mark.parametrize("broken", [lambda df: df.filter("version = 2"), lambda df: df.filter("version = 1"), lambda df: df.withColumn("version", -df["version"])])
def test_rows_show_an_upsert_that_loses_or_keeps_rows_wrongly(spark, monkeypatch, broken):
    right, latest = Counter(catalog.layer_upsert(spark, SF).collect()), catalog.sinks.latest
    monkeypatch.setattr(catalog.sinks, "latest", lambda df, keys, version: latest(broken(df), keys, version))
    assert Counter(catalog.layer_upsert(spark, SF).collect()) != right
