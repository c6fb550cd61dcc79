"""Each query with an oracle against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from spanforge.plans import registry

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or x != x:
        return "none"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(frame):
    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_permutation_null_is_repeatable(spark):
    f = registry.queries()["permutation_null"]
    a, b = f(spark, SF).first(), f(spark, SF).first()
    assert a == b and 0 <= a["p"] <= 1 and 0 <= a["null_mean"] <= 1


def test_submission_rows_of_all_videos(spark):
    from spanforge.plans import tables

    rows = registry.queries()["submission_rows_all_videos"](spark, SF)
    assert {r["video_id"] for r in rows.select("video_id").distinct().collect()} == {r["video_id"] for r in tables.videos(spark, SF).collect()}
    assert rows.where("video_id % 13 = 0").count() > 0


def test_permutation_null_is_whole(spark):
    got = registry.queries()["permutation_null"](spark, SF).collect()
    spikes = {r["least"]: r for r in registry.queries()["spike_precision_recall"](spark, SF).collect()}
    assert [r["least"] for r in got] == [2.0, 2.5, 3.0]
    for r in got:
        want = spikes[r["least"]]
        assert r["real"] == pytest.approx(want["precision"] or 0) and r["real_recall"] == pytest.approx(want["recall"])
        for p, null in (("p", "null_mean"), ("p_recall", "null_recall")):
            assert 0 <= r[null] <= 1 and 0 <= r[p] <= 1 and r[p] * 2000 == pytest.approx(round(r[p] * 2000))


def test_hash_split(spark):
    got = registry.queries()["hash_split"](spark, SF).toPandas()
    share = got.groupby("event_type")["part"].apply(lambda p: (p == "dev").mean())
    assert ((share > 0.15) & (share <= 0.2)).all()


def test_empty_spans_in_others_meet(spark, tmp_path):
    """An empty event meets an event around it and not one that it only touches, as in SQL."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT id::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_hours(hour) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, value::DOUBLE AS value, '{"k": 50}' AS props
 FROM (VALUES (0, 10, 60), (1, 20, 0), (2, 47, 0), (3, 40, 20), (5, 10, 0), (7, 70, 0), (9, 48, 2), (4, 48, 0), (11, 48, 0)) t(id, hour, value)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    name = "binned_interval_join"
    got, want = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
    assert {(r.g_id, r.p_id) for r in got.itertuples()} == {(0, 1), (0, 3), (2, 3), (0, 9), (0, 11), (4, 3)}
