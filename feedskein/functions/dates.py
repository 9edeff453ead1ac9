"""Dates of feed entries as UTC wall-clock time, all in built-in expressions.

Three notations: RFC 822 (`Mon, 15 Jan 2025 10:00:00 EST`), ISO 8601 / W3C (`2025-01-15`,
`2025-01-15T10:00:00.5+02:00`) and C asctime (`Wed Jan 15 10:00:00 2025`). The weekday
is not checked, fractions of a second are dropped and a missing zone means UTC. Each
notation costs one pattern match; its groups go to try_make_timestamp_ntz, which gives
null for a date that does not exist.

The expressions are put together as SQL text: as columns they are some hundred calls to
the JVM, which a stream would repeat for every micro-batch.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedskein.functions.text import WHITESPACE

# Zone names of RFC 822 with their offsets in minutes.
ZONE_MINUTES = {
    "ut": 0, "utc": 0, "gmt": 0, "z": 0,
    "adt": -180, "ast": -240, "edt": -240, "est": -300, "cdt": -300, "cst": -360,
    "mdt": -360, "mst": -420, "pdt": -420, "pst": -480,
    "a": -60, "n": 60, "m": -720, "y": 720,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_RFC822 = (
    r"(?i)\A(?:[a-z]+\.?,?\s+|[a-z]+,)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?[\s-]+(\d{4}|\d{2})"
    r"(?:\s+" + _CLOCK + r"\s*([a-z]+|[+-]\d{2}:?\d{2})?(?:\s*\(.*\))?)?\z"
)
_ISO = (
    r"(?i)\A(\d{4})(?:-?(\d{2})(?:-?(\d{2})"
    r"(?:[t\s]+(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?\s*(z|[+-]\d{2}(?::?\d{2})?)?)?)?)?\z"
)
_ASCTIME = r"(?i)\A(?:[a-z]{3,9}\s+)?([a-z]{3})[a-z]*\s+(\d{1,2})\s+" + _CLOCK + r"\s+(\d{4})\z"


def _number(part, default):
    return f"if({part} = '', {default}, try_cast({part} AS int))"


def _year(part):
    """Two digits below 90 are of this century."""
    return (
        f"try_cast({part} AS int) + CASE WHEN length({part}) > 2 THEN 0 "
        f"WHEN try_cast({part} AS int) < 90 THEN 2000 ELSE 1900 END"
    )


def _month(part):
    at = f"instr('{MONTHS}', lower({part}))"
    return f"if({at} % 3 = 1, ({at} + 2) div 3, null)"


def _zone(part):
    """Offset from UTC in minutes; an unknown name counts as UTC."""
    digits = f"replace({part}, ':', '')"
    minutes = (
        f"(try_cast(substring({digits}, 2, 2) AS int) * 60 + coalesce(try_cast(substring({digits}, 4, 2) AS int), 0))"
    )
    names = ", ".join(f"'{name}', {offset}" for name, offset in ZONE_MINUTES.items())
    return (
        f"CASE substring({part}, 1, 1) WHEN '+' THEN {minutes} WHEN '-' THEN -{minutes} "
        f"ELSE coalesce(try_element_at(map({names}), lower({part})), 0) END"
    )


def _instant(year, month, day, hour, minute, second, zone):
    return (
        f"try_make_timestamp_ntz({year}, cast({month} AS int), {day}, {hour}, {minute}, {second})"
        f" - make_dt_interval(0, 0, {zone}, 0)"
    )


def _notation(pattern, groups, *parts):
    """The instant of the parts, or null. The pattern runs once however often they use its
    groups: transform over a one-element array binds them to the variable g."""
    marked = "\\u0001" + "\\u0001".join(f"${n + 1}" for n in range(groups))
    found = f"slice(split(regexp_replace(x, r'{pattern}', '{marked}'), '\\u0001'), 2, {groups})"
    return f"transform(array({found}), g -> if(size(g) = {groups}, {_instant(*parts)}, null))[0]"


_CLOCK_PARTS = [_number(f"g[{n}]", 0) for n in (3, 4, 5)]
_NOTATIONS = [
    _notation(_RFC822, 7, _year("g[2]"), _month("g[1]"), _number("g[0]", 1), *_CLOCK_PARTS, _zone("g[6]")),
    _notation(_ISO, 7, _number("g[0]", 0), _number("g[1]", 1), _number("g[2]", 1), *_CLOCK_PARTS, _zone("g[6]")),
    _notation(
        _ASCTIME, 6, _number("g[5]", 0), _month("g[0]"), _number("g[1]", 1),
        *[_number(f"g[{n}]", 0) for n in (2, 3, 4)], "0",
    ),
]
_BLANKS = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)


def date_sql(*texts: str) -> str:
    """SQL for the first of the texts (SQL expressions) that is a date.

    coalesce stops at the first that is not null, so the usual notations cost least.
    """
    read = f"coalesce({', '.join(_NOTATIONS)})"
    tried = [f"transform(array(btrim({text}, '{_BLANKS}')), x -> {read})[0]" for text in texts]
    return f"coalesce({', '.join(tried)})"


def parse_date(column: str) -> Column:
    return F.expr(date_sql(column))


def first_date(published: str, updated: str) -> Column:
    """published if it can be read, else updated, else null."""
    return F.expr(date_sql(published, updated))
