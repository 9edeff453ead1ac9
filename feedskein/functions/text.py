"""Small text and ordering expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def feed_type(body: Column) -> Column:
    """atom if the first 500 characters hold `<feed`, else rss."""
    head = F.lower(F.substring(body, 1, 500))
    return F.when(F.contains(head, F.lit("<feed")), "atom").otherwise("rss")


def root_name(body: Column) -> Column:
    """Name of the first element outside comments; '' if there is none.

    Declarations and instructions need no rule, since no letter follows their `<`. An
    unclosed comment lasts to the end, which also keeps the match linear.
    """
    comment = r"(?s)<!--.*?(?:-->|\z)"
    bare = F.when(F.contains(body, F.lit("<!--")), F.regexp_replace(body, comment, "")).otherwise(body)
    return F.regexp_extract(bare, r"<([A-Za-z_][\w:.-]*)", 1)


def arrival(at: Column, seq: Column) -> Column:
    """(time, sequence number) as one number that sorts the same way.

    A decimal can be updated in place in an aggregation buffer, so min and max over it
    stay hash aggregates; over a struct they would be sort aggregates.
    """
    big = "decimal(38,0)"
    return (
        F.unix_micros(at).cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
        + seq.cast("decimal(19,0)")
    ).cast(big)
