"""Each registered query with SQL against another engine on the same tables; the others run and have rows."""

import glob
import math
import os

import duckdb
import pytest

from narrata.plans import beliefs, characters, clusters, comparisons, geometry, narrative, queries, registry, scales, steps, terms, validation

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
assert all((queries, narrative, comparisons, characters, scales, clusters, geometry, validation, steps, terms, beliefs))

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def engine():
    found = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return found


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_like_sql(spark, engine, name):
    df = registry.QUERIES[name](spark, DATA)
    other = engine.execute(registry.SQL[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in other.description], other.fetchall())


#: Queries that take long even on the smallest tables.
LONG = {"detector_falsifiability", "detector_redundancy", "shape_clusters"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys() - LONG))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert len(set(map(str.lower, df.columns))) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
