"""How archives are walked: requests and cursors as expressions over rows of specifications.

A specification is a row: name, kind (date, page or offset), url (with {date}, {page} or {offset}), date_format, pagesize,
first (page), method (GET or POST), body (a JSON template with the same marks; null for none) and max_units. A cursor is
a struct of the four fields below, kept as JSON between runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURSOR = "struct<date: date, page: int, offset: int, units_done: int>"


def _cursor(date: Column, page: Column, offset: Column, units: Column) -> Column:
    return F.struct(date.cast("date").alias("date"), page.cast("int").alias("page"), offset.cast("int").alias("offset"), units.cast("int").alias("units_done"))


def initial_cursor(spec: Column, since: Column) -> Column:
    """Where history begins: at a date, at the first page or at the start."""
    day = F.when(spec["kind"] == "date", since)
    return _cursor(day, F.coalesce(spec["first"], F.lit(1)), F.lit(0), F.lit(0))


def live_cursor(spec: Column, today: Column) -> Column:
    """Where the newest entries stand."""
    return initial_cursor(spec, today)


def advance_cursor(spec: Column, cursor: Column) -> Column:
    """The next unit; an offset moves by as many entries as a page holds, so that none is read twice or left out."""
    kind = spec["kind"]
    return _cursor(
        F.when(kind == "date", F.date_add(cursor["date"], 1)).otherwise(cursor["date"]),
        F.when(kind == "page", cursor["page"] + 1).otherwise(cursor["page"]),
        F.when(kind == "offset", cursor["offset"] + spec["pagesize"]).otherwise(cursor["offset"]),
        cursor["units_done"] + 1,
    )


def ended(spec: Column, cursor: Column, today: Column) -> Column:
    """Nothing is left: the date lies ahead, or so many units are done."""
    return F.coalesce((spec["kind"] == "date") & (cursor["date"] > today), F.lit(False)) | F.coalesce(cursor["units_done"] >= spec["max_units"], F.lit(False))


def build_request(spec: Column, cursor: Column) -> Column:
    """struct<method, url, body>; a walk by date without a date is an error."""
    day = F.when((spec["kind"] == "date") & cursor["date"].isNull(), F.raise_error(F.lit("a walk by date needs a date")).cast("string")).otherwise(F.call_function("date_format", cursor["date"], spec["date_format"]))
    marks = {"{date}": F.coalesce(day, F.lit("")), "{page}": cursor["page"].cast("string"), "{offset}": cursor["offset"].cast("string"), "{pagesize}": spec["pagesize"].cast("string")}
    url, body = spec["url"], spec["body"]
    for mark, value in marks.items():
        url, body = (F.replace(t, F.lit(mark), F.coalesce(value, F.lit(""))) for t in (url, body))
    return F.struct(F.coalesce(spec["method"], F.lit("GET")).alias("method"), url.alias("url"), body.alias("body"))


def cursor_json(cursor: Column) -> Column:
    return F.to_json(cursor)


def read_cursor(text: Column) -> Column:
    """Of JSON; older forms are a bare page number or a bare date."""
    number = F.when(text.rlike(r"^\s*\d{1,9}\s*$"), F.trim(text).try_cast("int"))
    day = F.when(text.rlike(r'^\s*"?\d{4}-\d{2}-\d{2}"?\s*$'), F.translate(F.trim(text), '"', "").try_cast("date"))
    read = F.from_json(text, CURSOR)
    none = F.lit(None)
    return (
        F.when(number.isNotNull(), _cursor(none, number, F.lit(0), F.lit(0)))
        .when(day.isNotNull(), _cursor(day, F.lit(1), F.lit(0), F.lit(0)))
        .otherwise(_cursor(read["date"], F.coalesce(read["page"], F.lit(1)), F.coalesce(read["offset"], F.lit(0)), F.coalesce(read["units_done"], F.lit(0))))
    )
