from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """``rows(ddl, *tuples)`` → DataFrame."""
    return lambda ddl, *data: spark.createDataFrame(list(data), ddl)


def day(n: int) -> datetime:
    return datetime(2024, 1, n)


def cells(df, *columns) -> list[tuple]:
    """Rows as sorted tuples, nulls first."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.fixture
def todo(rows):
    """Three users (one deleted), three lists (one empty), four items (one deleted)."""
    users = rows(
        "id BIGINT, email STRING, username STRING, password_hash STRING, deleted_at TIMESTAMP",
        (1, "one@test.com", "one", "h1", None),
        (2, "two@test.com", "two", "h2", None),
        (3, "three@test.com", "three", "h3", day(5)),
    )
    lists = rows(
        "id BIGINT, user_id BIGINT, title STRING, color STRING, position INT, updated_at TIMESTAMP, deleted_at TIMESTAMP",
        (10, 1, "home", "#FF0000", 0, day(1), None),
        (11, 1, "work", None, 1, day(1), None),
        (12, 3, "gone", None, 0, day(1), day(5)),
    )
    items = rows(
        "id BIGINT, list_id BIGINT, title STRING, is_completed BOOLEAN, completed_at TIMESTAMP, position INT, "
        "updated_at TIMESTAMP, deleted_at TIMESTAMP",
        (100, 10, "a", False, None, 0, day(1), None),
        (101, 10, "b", True, day(2), 1, day(1), None),
        (102, 10, "c", False, None, 2, day(1), day(3)),
        (103, 12, "d", False, None, 0, day(1), None),
    )
    return {"users": users, "lists": lists, "items": items}
