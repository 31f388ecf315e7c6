"""Times around the ends of buckets, against DuckDB."""

import duckdb
import pytest
from compare import assert_same

from docplan.queries import ORACLE, QUERIES

TIMES = [f"{day} {time}" for day in ("2024-01-01", "1969-12-31", "1970-01-01", "1902-03-04", "2300-01-01", "9999-12-30") for time in ("00:59:59.999499", "00:59:59.9995", "00:59:59.999999", "01:00:00", "01:00:00.0005", "22:59:59.9994", "22:59:59.9996", "23:00:00.000499", "23:59:59.9995")]


@pytest.mark.parametrize("kind", ["TIMESTAMP", "TIMESTAMPTZ"])
def test_time_buckets_at_the_ends_of_hours(spark, tmp_path, kind):
    rows = ", ".join(f"({i}, '{t}', {i % 7}, 'e{i % 2}', {i}.5, NULL)" for i, t in enumerate(TIMES)) + ", (900, NULL, 1, 'e0', 3, NULL), (901, NULL, 1, NULL, NULL, NULL), (902, '2024-01-01 00:59:59.9999', 1, NULL, NULL, NULL)"
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"COPY (SELECT e::BIGINT AS event_id, t::{kind} AS ts, u::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value, p::VARCHAR AS props FROM (VALUES {rows}) x(e, t, u, k, v, p)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert_same(QUERIES["time_buckets"](spark, str(tmp_path)), str(tmp_path), ORACLE["time_buckets"])
