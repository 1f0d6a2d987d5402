"""The registry, and every query against its SQL twin on the smallest fixture."""

import glob
import math
import os

import duckdb
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    """A value as text, floats to six digits; the type names differ between the engines, the values must not."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    try:
        return f"{float(x):.6g}" if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_twin(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted(repr([plain(x) for x in row]) for row in frame.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(repr([plain(x) for x in row]) for row in duck.execute(f"SELECT {quoted} FROM ({registry.oracles()[name]})").fetchall())
    assert ours == theirs


def test_a_name_is_registered_once():
    with pytest.raises(ValueError):
        registry.query("auc")(lambda spark, sf_dir: None)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.oracles()) <= set(__spark_entry__.oracle_sql())
