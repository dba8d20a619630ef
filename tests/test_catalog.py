"""Every registered query against its SQL. Set CATALOG=all for all of them."""

import os

import duckdb
import pytest

from beatloom.catalog import ORACLES, QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "e3_rr_local_spread", "e15_session_split", "i16_soft_features", "c8_nearest_within", "c11_in_intervals",
    "i7_coverage_subtract", "g2_greedy_dedup", "d9_describe_metrics", "n2_roc_auc", "l15_cosinor", "k0_snapped_windows",
    "j2_rsa_events", "i2_build_labels", "flagship_segment_review",
]
NAMES = sorted(ORACLES) if os.environ.get("CATALOG") == "all" else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
