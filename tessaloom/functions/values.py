"""Value functions: truthy coalescing, lexical casts and fits, windows of dates."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_paths import strict_json

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def truthy(c: Column, kind: str = "string") -> Column:
    """The value, or null where it is empty: '', 0, false or an empty array."""
    if kind == "string":
        return F.nullif(c, F.lit(""))
    if kind == "boolean":
        return F.when(c, c)
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit(0))


def first_truthy(*columns: Column, kind: str = "string", default=None) -> Column:
    return F.coalesce(*(truthy(c, kind) for c in columns), F.lit(default))


def first_present(*columns: Column) -> Column:
    """0 and false stay; null and '' don't."""
    return F.coalesce(*(F.when(c.cast("string") != "", c) for c in columns))


def bounded_int(c: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.floor(c.try_cast("double")).try_cast("int"), F.lit(default))))


#: Lexical shapes of the checked types.
SHAPES = {
    "boolean": r"(?i)^(true|false)$",
    "integer": r"^[+-]?\d+$",
    "number": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "datetime": r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$",
}


def fits(kind: str, c: Column) -> Column:
    """Whether the whole text is of the kind; dates must exist, JSON must parse."""
    if kind in ("boolean", "integer", "number"):
        return c.rlike(SHAPES[kind])
    if kind == "date":
        return c.rlike(SHAPES["date"]) & F.try_to_date(c).isNotNull() if hasattr(F, "try_to_date") else c.rlike(SHAPES["date"]) & c.try_cast("date").isNotNull()
    if kind == "datetime":
        return c.rlike(SHAPES["datetime"]) & c.try_cast("timestamp").isNotNull()
    opening = "[" if kind == "json_array" else "{"
    return F.startswith(F.ltrim(c), F.lit(opening)) & strict_json(c).isNotNull()


def lexical(c: Column, datatype: str) -> Column:
    """The canonical text of a value of an XML Schema type, null where it isn't one."""
    text = F.trim(c)
    number = text.try_cast("decimal(38,18)")
    plain = F.when(text.rlike(SHAPES["number"]) & number.isNotNull(), text)
    rules = {
        "string": c,
        "integer": F.when(text.rlike(SHAPES["integer"]), F.regexp_replace(text, r"^\+", "")),
        "nonNegativeInteger": F.when(text.rlike(r"^\+?\d+$"), F.regexp_replace(text, r"^\+", "")),
        "positiveInteger": F.when(text.rlike(r"^\+?0*[1-9]\d*$"), F.regexp_replace(text, r"^\+", "")),
        "decimal": F.when(plain.rlike("[eE]"), number.cast("string")).otherwise(plain),
        "boolean": F.when(text.rlike(SHAPES["boolean"]), F.lower(text)),
        "date": F.when(fits("date", text), text),
        "dateTime": c,
        "anyURI": F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), text),
    }
    return rules[datatype]


def month_before(c: Column) -> Column:
    return F.add_months(c, -1)


def resolve_window(start: date | None, end: date | None, today: date) -> tuple[date, date]:
    """End defaults to today; without a start, 30 days if an end is given, else that day."""
    if end is None:
        return start or today, today
    return start or end - timedelta(days=29), end


def calendar_date(c: Column) -> Column:
    """A date that exists, written YYYY-MM-DD; else null."""
    t = F.trim(c)
    return F.when(t.rlike(SHAPES["date"]), t.try_cast("date"))


def epoch(c: Column) -> Column:
    """Seconds from 1970 to the date's midnight in UTC."""
    return F.unix_date(calendar_date(c)).cast("long") * 86_400


#: Words for days, longer ones first, and the shape of written dates.
RELATIVE_DAYS = {"大前天": 3, "前天": 2, "昨天": 1, "昨日": 1, "今天": 0, "今日": 0, "当天": 0}
WRITTEN_DATE = r"(?:(\d{4})\s*(?:年|[-/.])\s*)?(\d{1,2})\s*(?:月|[-/.])\s*(\d{1,2})\s*日?"


def asked_date(c: Column, today: Column) -> Column:
    """The date a text asks for: a written one (of today's year, if it names none), else a day
    relative to today, else today; null if it names several or one that doesn't exist."""
    part = lambda i: F.regexp_extract_all(c, F.lit(WRITTEN_DATE), F.lit(i))
    year = F.coalesce(F.nullif(F.get(part(1), F.lit(0)), F.lit("")), F.year(today).cast("string"))
    written = F.concat_ws("-", year, F.lpad(F.get(part(2), F.lit(0)), 2, "0"), F.lpad(F.get(part(3), F.lit(0)), 2, "0")).try_cast("date")
    words = F.regexp_extract_all(c, F.lit("|".join(RELATIVE_DAYS)), F.lit(0))
    days = F.element_at(F.create_map(*(F.lit(x) for p in RELATIVE_DAYS.items() for x in p)), F.get(words, F.lit(0)))
    dates, relative = F.size(part(0)), F.size(words)
    return F.when(dates + relative > 1, F.lit(None).cast("date")).when(dates == 1, written).when(relative == 1, F.date_sub(today, days)).otherwise(today)
