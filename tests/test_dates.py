from datetime import datetime as D

import pytest
from feedskein.functions.dates import first_date, parse_date

CASES = {
    "Mon, 15 Jan 2025 10:00:00 GMT": D(2025, 1, 15, 10),  # it was a Wednesday
    "Wed, 15 Jan 2025 10:00:00 GMT": D(2025, 1, 15, 10),
    "15 Jan 2025 10:00 +0530": D(2025, 1, 15, 4, 30),
    "15 January 2025 10:00:00 -0100 (somewhere)": D(2025, 1, 15, 11),
    "Sat, 05 Jul 2025 08:00:00 EST": D(2025, 7, 5, 13),  # a zone name has one offset all year
    "Sat, 05 Jul 2025 08:00:00 EDT": D(2025, 7, 5, 12),
    "Sat, 05 Jul 2025 08:00:00 Nowhere": D(2025, 7, 5, 8),
    "15-Jan-25 10:00:00 Z": D(2025, 1, 15, 10),
    "Fri, 15 Jan 99 10:00:00 GMT": D(1999, 1, 15, 10),
    "15 Jan 2025": D(2025, 1, 15),
    "2025-01-15T10:00:00Z": D(2025, 1, 15, 10),
    "2025-01-15T10:00:00.987Z": D(2025, 1, 15, 10),
    "2025-01-15T10:00:00+02:00": D(2025, 1, 15, 8),
    "2025-01-15 10:00": D(2025, 1, 15, 10),
    "20250115T101112-08:00": D(2025, 1, 15, 18, 11, 12),
    "2025-01-15": D(2025, 1, 15),
    "2025-01": D(2025, 1, 1),
    "2025": D(2025, 1, 1),
    "Wed Jan 15 10:00:00 2025": D(2025, 1, 15, 10),
    "  2025-01-15T10:00:00Z\n": D(2025, 1, 15, 10),
    "2025-02-30T10:00:00Z": None,
    "31 Jun 2025 10:00:00 GMT": None,
    "15 Foo 2025 10:00:00 GMT": None,
    "yesterday": None,
    "": None,
}


def test_notations(spark):
    frame = spark.createDataFrame([(t,) for t in CASES], "text string")
    got = {r.text: r.d for r in frame.select("text", parse_date("text").alias("d")).collect()}
    assert got == CASES


@pytest.mark.parametrize("published, updated, expected", [
    ("2025-01-15", "2025-02-01", D(2025, 1, 15)),
    (None, "2025-02-01", D(2025, 2, 1)),
    ("unreadable", "2025-02-01", D(2025, 2, 1)),
    (None, None, None),
])
def test_published_before_updated(spark, published, updated, expected):
    frame = spark.createDataFrame([(published, updated)], "p string, u string")
    assert frame.select(first_date("p", "u")).first()[0] == expected
