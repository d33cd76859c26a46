"""Relative-time phrases as column expressions over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph import vocab

# Phrase patterns of the calendar parser, on lower-cased text.
AMOUNT = r"\b(?:during|since|in|over)?\s*(?:last|past|the\s+last|the\s+past)?\s+(\d+)\s+{unit}s?\b"
UNITS = [("hour", 3600), ("day", 86400), ("week", 604800), ("month", 2592000)]
QUARTER = r"\b(?:since|during)\s+q([1-4])\b"
MONTH_DAY = r"\b(?:since|after|on)\s+([a-z]+)\s+(\d{1,2})\b"
ISO_DAY = r"\b(?:since|after|on)\s+(\d{4}-\d{2}-\d{2})\b"

# Phrase patterns of the rolling parser, in order, with seconds per unit.
ROLLING_AMOUNTS = [
    (r"\blast\s+([0-9]+)\s+days?\b", 86400),
    (r"\blast\s+([0-9]+)\s+weeks?\b", 604800),
    (r"\blast\s+([0-9]+)\s+hours?\b", 3600),
]
ROLLING_WORDS = [
    (r"\bpast\s+week\b", 604800), (r"\byesterday\b", 86400), (r"\btoday\b", 43200), (r"\brecent\b", 1209600),
]


def _plus(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1_000_000)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    hit = F.regexp_extract(text, pattern, group)
    return F.when(F.regexp_extract(text, pattern, 0) != "", hit)


def calendar_range(query: Column, anchor: Column) -> Column:
    """struct(start, end, phrase): first matching rule wins; all null when nothing matches."""
    low = F.lower(query)
    out = F.struct(F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"),
                   F.lit(None).cast("string").alias("phrase"))

    def hit(start: Column, end: Column, phrase: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), phrase.alias("phrase"))

    day = F.date_trunc("day", anchor)
    rules: list[tuple[Column, Column]] = []
    for unit, seconds in UNITS:
        pattern = AMOUNT.format(unit=unit)
        phrase = _found(low, pattern)
        amount = F.coalesce(_found(low, pattern, 1).try_cast("long"), F.lit(0))
        rules.append((phrase.isNotNull(), hit(_plus(anchor, -amount * seconds), anchor, phrase)))
    rules.append((low.rlike(r"\btoday\b"), hit(day, anchor, F.lit("today"))))
    rules.append((low.rlike(r"\byesterday\b"), hit(_plus(day, F.lit(-86400)), day, F.lit("yesterday"))))

    quarter = _found(low, QUARTER, 1).try_cast("int")
    year = F.year(anchor)
    q_start = F.make_timestamp(year, quarter * 3 - 2, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    q_end = _plus(F.add_months(q_start, 3).cast("timestamp"), F.lit(-1))
    rules.append((quarter.isNotNull(), hit(q_start, q_end, _found(low, QUARTER))))

    numbers = F.create_map(*[F.lit(x) for pair in vocab.MONTHS.items() for x in pair])
    month = F.try_element_at(numbers, _found(low, MONTH_DAY, 1))
    dom = _found(low, MONTH_DAY, 2)

    def dated(y: Column) -> Column:
        text = F.concat_ws("-", y.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(dom, 2, "0"))
        return F.when(month.isNotNull(), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))

    this_year, last_year = dated(year), dated(year - 1)
    named = F.when(this_year > anchor, last_year).otherwise(this_year)
    rules.append((named.isNotNull(), hit(named, anchor, _found(low, MONTH_DAY))))

    iso = F.try_to_timestamp(_found(low, ISO_DAY, 1), F.lit("yyyy-MM-dd"))
    rules.append((iso.isNotNull(), hit(iso, anchor, _found(low, ISO_DAY))))
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def without_phrase(query: Column, phrase: Column) -> Column:
    """The question with every occurrence of a phrase removed, ignoring case, spaces collapsed."""
    quoted = F.concat(F.lit(r"(?i)\Q"), phrase, F.lit(r"\E"))
    cleaned = F.regexp_replace(F.trim(F.regexp_replace(query, quoted, F.lit(""))), r"\s+", " ")
    return F.when(phrase.isNull(), query).otherwise(cleaned)


def rolling_range(query: Column, anchor: Column) -> Column:
    """struct(start, end, clean): the looser variant used by document search."""
    none = F.lit(None).cast("timestamp")
    out = F.struct(none.alias("start"), none.alias("end"), query.alias("clean"))
    rules = []
    for pattern, seconds in ROLLING_AMOUNTS:
        amount = F.coalesce(F.regexp_extract(F.lower(query), pattern, 1).try_cast("long"), F.lit(0))
        rules.append((pattern, _plus(anchor, -amount * seconds), anchor))
    for pattern, seconds in ROLLING_WORDS:
        if "yesterday" in pattern:
            rules.append((pattern, _plus(anchor, F.lit(-2 * seconds)), _plus(anchor, F.lit(-seconds))))
        else:
            rules.append((pattern, _plus(anchor, F.lit(-seconds)), anchor))
    for pattern, start, end in reversed(rules):
        clean = F.trim(F.regexp_replace(query, "(?i)" + pattern, ""))
        out = F.when(
            query.rlike("(?i)" + pattern), F.struct(start.alias("start"), end.alias("end"), clean.alias("clean"))
        ).otherwise(out)
    return out
