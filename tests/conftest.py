import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedskein import schemas  # noqa: E402
from feedskein.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "tests",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["broadcast", "salted"])
def joins(request, spark):
    """Runs a test with broadcast joins and again with the salted joins for large lookups."""
    if request.param == "salted":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def make(spark):
    """Frames of the engine's tables from rows of their leading columns, as far as needed."""

    def build(schema, rows):
        names = [f.name for f in schema]
        full = [dict(zip(names, row)) if not isinstance(row, dict) else row for row in rows]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema)

    class Make:
        def captures(self, *rows):
            """(url, body) or a dict; fetched well unless said otherwise."""
            filled = []
            for row in rows:
                row = dict(row) if isinstance(row, dict) else {"url": row[0], "body": row[1]}
                if "error_kind" not in row:
                    row.setdefault("http_status", 200)
                row.setdefault("fetched_at", datetime(2025, 1, 1))
                filled.append(row)
            return build(schemas.CAPTURES, filled)

        def feeds(self, *rows):
            return build(schemas.FEEDS, [(i, t, u, *(rest or [""])) for i, t, u, *rest in rows])

        def observations(self, *rows):
            filled = []
            for row in rows:
                row = {"title": "t", "link": "", "summary": "", **row}
                row["fetched_at"] = row.get("fetched_at", datetime(2025, 1, 1))
                row.setdefault("pos", 0)
                filled.append(row)
            return build(schemas.OBSERVATIONS, filled)

        def actions(self, *rows):
            return build(schemas.ACTIONS, rows)

        def articles(self, *rows):
            filled = [
                {"title": "t", "link": "", "summary": "", "is_read": False, "is_favorite": False, **row}
                for row in rows
            ]
            return build(schemas.ARTICLES, filled)

    return Make()


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]
