"""Month parsing and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brickline.functions.numbers import once

# Textual month formats accepted by parse_month and the shape of each.
MONTH_FORMATS = {
    "MMM yyyy": r"^[A-Za-z]{3} \d{4}$",
    "MMMM yyyy": r"^[A-Za-z]{4,} \d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{4,} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "MMM-yyyy": r"^[A-Za-z]{3}-\d{4}$",
}
# Fixed value: day zero of spreadsheet serial dates.
SERIAL_ORIGIN = "1899-12-30"
# Horizon labels in months.
HORIZON_MONTHS = {"1y": 12, "2y": 24, "5y": 60, "10y": 120}
MONTH_ABBREVIATIONS = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]


def month_floor(c: Column) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(c.cast("date"), "MM")


def _first_of(year: Column, month: Column) -> Column:
    return F.try_to_date(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01")), "yyyy-MM-dd")


def _cut_date(text: Column) -> Column:
    """Month start from numbers between dashes or slashes, the year first, the day optional."""

    def first(parts: Column) -> Column:
        year, month, day = (F.get(parts, F.lit(k)) for k in range(3))
        short = F.length(month).between(1, 2) & F.coalesce(F.length(day), F.lit(1)).between(1, 2)
        return F.when(F.size(parts).between(2, 3) & (F.length(year) == 4) & short, _first_of(year, month))

    return once(F.split(text, "[-/]"), first)


def parse_month(c: Column) -> Column:
    """Month start from ISO-like, named-month or spreadsheet-serial text, else null.

    The shape is tested before a format is tried: a failing parse is far slower
    than a pattern test.
    """
    def parsed(text: Column) -> Column:
        out = (
            F.when(text.rlike("^[0-9]+[-/][0-9/-]+$"), _cut_date(text))
            .when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd"))
            .when(
                text.rlike(r"^\d{5}(\.\d+)?$"),
                F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), F.floor(text.try_cast("double")).cast("int")),
            )
        )
        for pattern, shape in MONTH_FORMATS.items():
            out = out.when(text.rlike(shape), F.try_to_date(text, pattern))
        return out

    return F.trunc(once(F.trim(c.cast("string")), parsed), "MM")


def parse_mon_year(c: Column) -> Column:
    """``Jan 2005`` to its first day, else null."""
    return F.try_to_date(F.trim(c), "MMM yyyy")


def _month_number(word: Column) -> Column:
    """1 to 12 for a word that begins with a month's short name, else null."""
    short = F.array(*map(F.lit, MONTH_ABBREVIATIONS))
    return F.nullif(F.array_position(short, F.left(F.lower(word), F.lit(3))), F.lit(0)).cast("int")


def month_from_filename(name: Column, run_date: Column) -> Column:
    """Month next to the year in a file name; without one, the month before ``run_date``.

    The name is cut into runs of letters and of digits. The month is the number after the year, or the month name
    before or after it.
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit("([a-z]+|[0-9]+)"), 1)

    def read(parts: Column) -> Column:
        year_at = F.array_position(F.transform(parts, lambda p: p.rlike("^20[0-9]{2}$")), True).cast("int") - 1
        before, year, after = (F.get(parts, year_at + k) for k in (-1, 0, 1))
        number = after.try_cast("int")
        month = F.coalesce(F.when(number.between(1, 12), number), _month_number(before), _month_number(after))
        return F.when(year_at >= 0, F.make_date(year.try_cast("int"), month, F.lit(1)))

    return F.coalesce(once(runs, read), F.add_months(F.trunc(run_date.cast("date"), "MM"), -1))


def extract_year(c: Column) -> Column:
    """First four-digit run as an integer, else null."""
    return F.regexp_extract(c.cast("string"), r"(\d{4})", 1).try_cast("int")


def year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def parse_posted_date(c: Column) -> Column:
    """The first ``month-name day, year`` of the text, names in full or short, else null."""
    names = "|".join(MONTH_ABBREVIATIONS)
    shape = rf"(?i)\b((?:{names})[a-z]*)[.]?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})\b"
    month, day, year = (F.regexp_extract(c, shape, k) for k in (1, 2, 3))
    text = F.concat_ws("-", year, _month_number(month).cast("string"), day)
    return F.when(year != "", F.try_to_date(text, "yyyy-M-d"))


def months_since(c: Column, cutoff: str) -> Column:
    """Whole months between the month of ``cutoff`` and the month of ``c``."""
    start = F.lit(cutoff).cast("date")
    return (
        (F.year(c) - F.year(start)) * 12 + F.month(c) - F.month(start)
    ).cast("int")


def parse_horizon(c: Column) -> Column:
    """Horizon label to months; an unknown label is null."""
    ladder = None
    for label, months in HORIZON_MONTHS.items():
        ladder = (F if ladder is None else ladder).when(F.lower(c) == label, months)
    return ladder
