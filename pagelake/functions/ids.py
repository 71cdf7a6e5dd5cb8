"""The grammar of page, box and request ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_id(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.png$", "")


def issue_of(name: Column) -> Column:
    """What stands before "_page_"."""
    return F.element_at(F.split(name, "_page_"), 1)


def periodical_of(issue: Column) -> Column:
    """Prefix before the first "-"."""
    return F.element_at(F.split(issue, "-", 2), 1)


def issue_date(issue: Column) -> Column:
    """Date after the first "-"; null where it is none."""
    return F.try_to_timestamp(F.try_element_at(F.split(issue, "-", 2), F.lit(2)), F.lit("yyyy-MM-dd")).cast("date")


def box_page_id(block: Column, column: Column, order: Column) -> Column:
    text = lambda c: c.cast("int").cast("string")
    return F.concat(F.lit("B"), text(block), F.lit("C"), text(column), F.lit("R"), text(order))


def custom_id(page: Column, box_class: Column, box: Column, segment: Column) -> Column:
    return F.concat(page, F.lit("_"), box_class, F.lit("_"), box, F.lit("_segment_"), segment.cast("string"))


def decompose(c: Column) -> dict[str, Column]:
    """issue_id, page_number, class, block, column, reading_order, segment of a custom id."""
    number = lambda pattern: F.regexp_extract(c, pattern, 1).try_cast("int")
    return {
        "issue_id": issue_of(c),
        "page_number": number(r"_page_(\d+)"),
        "class": F.regexp_extract(c, r"_page_\d+_([^_]+)_", 1),
        "block": number(r"_B(\d+)C"),
        "column": number(r"C(\d+)R"),
        "reading_order": number(r"R(\d+)_segment"),
        "segment": number(r"_segment_(\d+)"),
    }
