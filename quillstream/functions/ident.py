"""Identifiers: court case numbers, company tax ids, tender ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import to_halfwidth

#: Year, category, number; parts may be spaced and the year's second character left out. A number may have any length.
CASE = r"(?U)(\d{2,3})\s*年\s*度?\s*([一-鿿]{1,8}?)\s*字\s*第?\s*(\d+)\s*號"
#: Fixed value: checksum weights of the eight digits.
WEIGHTS = (1, 2, 1, 2, 1, 2, 4, 1)


def extract_case_numbers(c: Column) -> Column:
    """Canonical forms of all case numbers, distinct in order of appearance."""
    t = F.coalesce(to_halfwidth(c), F.lit(""))
    part = lambda k: F.regexp_extract_all(t, F.lit(CASE), F.lit(k))
    z = F.arrays_zip(part(1).alias("y"), part(2).alias("k"), part(3).alias("n"))
    whole = lambda x: F.concat(x["y"].cast("int").cast("string"), F.lit("年度"), F.translate(x["k"], "臺", "台"), F.lit("字第"), F.regexp_replace(x["n"], "^0+(?=.)", ""), F.lit("號"))
    return F.array_distinct(F.transform(z, whole))


def normalize_case_number(c: Column) -> Column:
    return F.get(extract_case_numbers(c), F.lit(0))


def is_valid_tax_id(c: Column) -> Column:
    """Eight digits whose weighted digit sums add up to a multiple of five; a seventh digit 7 may count one more."""
    total = F.lit(0)
    for i, w in enumerate(WEIGHTS):
        p = F.substring(c, i + 1, 1).cast("int") * w
        total = total + F.floor(p / 10).cast("int") + p % 10
    return F.when(c.rlike("^[0-9]{8}$"), (total % 5 == 0) | ((F.substring(c, 7, 1) == "7") & ((total + 1) % 5 == 0))).otherwise(False)


def extract_tax_ids(c: Column) -> Column:
    t = F.coalesce(to_halfwidth(c), F.lit(""))
    return F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(r"(?<!\d)(\d{8})(?!\d)"), F.lit(1)), is_valid_tax_id))


def normalize_tender_id(c: Column) -> Column:
    t = F.upper(F.regexp_replace(to_halfwidth(c), r"(?U)\s+", ""))
    return F.translate(t, "–—_", "---")
