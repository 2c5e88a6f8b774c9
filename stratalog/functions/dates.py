"""Archive dates: parsing, labels, keys and seasons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNDATED = "ongedateerd"

# Dutch month names and the labels of missing dates.
MONTHS = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mrt", "apr", "mei", "jun", "jul", "aug", "sep", "okt", "nov", "dec")
NO_YEAR, NO_DATE, NO_LABEL = "Geen datum", "Datum onbekend", "—"

_DMY = r"(?<!\d)(\d{2})-(\d{2})-(\d{4})"


def named(values: tuple[str, ...], at: Column) -> Column:
    """The ``at``-th (from 1) of some names; null outside of them."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), F.when((at >= 1) & (at <= len(values)), at.cast("int")))


def iso_text(date: Column, time: Column | None = None) -> Column:
    """`dd-MM-yyyy` anywhere in a text to ISO text, with `Thh:mm:00` if the time has one; empty without a match. No calendar check."""
    part = lambda k: F.regexp_extract(date, _DMY, k)
    day = F.concat(part(3), F.lit("-"), part(2), F.lit("-"), part(1))
    if time is not None:
        clock = F.regexp_extract(time, r"(\d{2}:\d{2})", 1)
        day = F.when(F.coalesce(clock, F.lit("")) != "", F.concat(day, F.lit("T"), clock, F.lit(":00"))).otherwise(day)
    return F.when(F.coalesce(part(3), F.lit("")) == "", F.lit("")).otherwise(F.coalesce(day, F.lit("")))


def date_text(iso: Column, raw: Column) -> Column:
    """The ISO text, else the raw date, else null."""
    return F.coalesce(F.nullif(iso, F.lit("")), F.nullif(raw, F.lit("")))


def parsed(value: Column) -> Column:
    """Timestamp of an ISO text; null for anything else, impossible dates too."""
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?")
    return F.when(iso, F.coalesce(F.try_to_timestamp(F.regexp_replace(F.substring(value, 1, 19), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(F.substring(value, 1, 16), "T", " "), F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd"))))


def year_key(value: Column) -> Column:
    return F.when(parsed(value).isNotNull(), F.substring(value, 1, 4)).otherwise(F.lit(UNDATED))


def year_label(year: Column) -> Column:
    return F.when(year == UNDATED, F.lit(NO_YEAR)).otherwise(year)


def month_key(value: Column) -> Column:
    return F.when(parsed(value).isNotNull(), F.concat(F.lit("m-"), F.substring(value, 1, 7))).otherwise(F.lit(f"m-{UNDATED}"))


def gallery_month_key(year: Column, month: Column) -> Column:
    """`yyyy-MM`; `unknown` where year or month is null or 0."""
    known = (F.coalesce(year, F.lit(0)) != 0) & (F.coalesce(month, F.lit(0)) != 0)
    return F.when(known, F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).otherwise(F.lit("unknown"))


def season(month: Column) -> Column:
    """Dutch season of a month; winter also for null."""
    return F.when(month.between(3, 5), "lente").when(month.between(6, 8), "zomer").when(month.between(9, 11), "herfst").otherwise("winter")


def month_label(key: Column) -> Column:
    year, month = F.regexp_extract(key, r"(\d{4})-(\d{2})", 1), F.regexp_extract(key, r"(\d{4})-(\d{2})", 2)
    return F.coalesce(F.concat(named(MONTHS, F.nullif(month, F.lit("")).cast("int")), F.lit(" "), year), F.lit(NO_DATE))


def short_month_label(key: Column) -> Column:
    return F.coalesce(named(SHORT_MONTHS, F.nullif(F.regexp_extract(key, r"\d{4}-(\d{2})", 1), F.lit("")).cast("int")), F.lit(NO_LABEL))


def long_label(value: Column) -> Column:
    """`07 maart 2008`; the raw text where it is no date."""
    ts = parsed(value)
    return F.coalesce(F.concat(F.lpad(F.dayofmonth(ts).cast("string"), 2, "0"), F.lit(" "), named(MONTHS, F.month(ts)), F.lit(" "), F.year(ts).cast("string")), value)


def day_label(value: Column) -> Column:
    ts = parsed(value)
    return F.coalesce(F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "), named(SHORT_MONTHS, F.month(ts))), F.lit(NO_LABEL))


def date_time_label(iso: Column, raw: Column) -> Column:
    """Date label with ` · hh:mm`, which midnight does not get."""
    clock = F.regexp_extract(F.coalesce(iso, F.lit("")), r"T(\d{2}:\d{2})", 1)
    label = long_label(date_text(iso, raw))
    return F.when((clock != "") & (clock != "00:00"), F.concat(label, F.lit(" · "), clock)).otherwise(label)


#: Accepted input formats, in order of preference.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy")
_SHAPES = (r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", r"^\d{4}-\d\d-\d\d$", r"^\d\d-\d\d-\d{4}$", r"^\d\d/\d\d/\d{4}$")


def parse_any(*values: Column) -> Column:
    """The first value, by its first 19 characters, that one of ``FORMATS`` reads."""
    tries = [F.when(F.substring(v, 1, 19).rlike(shape), F.try_to_timestamp(F.substring(v, 1, 19), F.lit(f))) for v in values for f, shape in zip(FORMATS, _SHAPES, strict=True)]
    return F.coalesce(*tries)


def prefix_date(value: Column) -> Column:
    """Date at the beginning of a text, ISO or else `dd-MM-yyyy`."""
    iso = F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2})", 1)
    dmy = F.regexp_extract(value, r"^(\d{2}-\d{2}-\d{4})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.nullif(dmy, F.lit("")), F.lit("dd-MM-yyyy"))).cast("date")


def prefix_year(value: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(value, r"^(\d{4})", 1), F.lit("")), F.lit("unknown"))


def weekday(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def day_gap(first: Column, last: Column) -> Column:
    return F.datediff(last, first)
