import datetime
import random

import duckdb
import pytest

from calibra.plans.registry import ORACLE_SQL, QUERIES


def rows_of(spark, sf, name):
    """A query's rows and those of its SQL, over events and embeddings of a folder."""
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(tuple(r[c] for c in columns) for r in df.collect()), sorted(want)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Events in sessions of their own, some with equal or near hashes."""
    sf, rnd = str(tmp_path_factory.mktemp("sf")), random.Random(6)
    some = [[rnd.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(4)]
    near = [-x if i < 5 else x for i, x in enumerate(some[1])]
    vectors = [some[0], some[1], some[2], some[0], near, some[1], some[3], near, some[0]]
    spark.createDataFrame([(i, v, i) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    start = datetime.datetime(2020, 1, 1)
    events = [(i, start + datetime.timedelta(hours=i), "view", '{"k": %d}' % (i % 3)) for i in range(len(vectors))]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, props string").write.parquet(f"{sf}/events.parquet")
    return sf


def test_sessions_of_equal_hashes_merge(spark, copies):
    got, want = rows_of(spark, copies, "session_merge")
    assert got == want
    session = dict(got)
    assert session[0] == session[3] == session[8] and session[1] == session[4] == session[5] == session[7] and len(set(session.values())) == 4


def test_all_configs_are_compared(spark, tmp_path):
    events = [(i, datetime.datetime(2020, 1, 1), "view" if i % 3 else "click", '{"k": %d, "j": 1}' % i) for i in range(600)]
    events.append((600, datetime.datetime(2020, 1, 1), "view", '{"k": 7}'))
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    order = lambda rows: sorted(rows, key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT allowed, n, one, other, path FROM ({ORACLE_SQL['config_diff_all']})").fetchall()
    got = [(r.allowed, r.n, r.one, r.other, r.path) for r in QUERIES["config_diff_all"](spark, str(tmp_path)).collect()]
    assert order(got) == order(want)
    assert sum(n for _, n, *_, path in got if path == "props.k") == 301
