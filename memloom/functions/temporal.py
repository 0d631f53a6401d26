"""Date scalars: parsing, calendar shifts, relative and absolute expressions. Unresolved stays null."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.text import col_of, let

# Number words, months, weekdays and units of the expression grammar.
NUMBER_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
AMOUNT = r"a|an|one|two|three|four|five|six|seven|eight|nine|ten|\d+"
MONTH = "|".join(MONTHS)
RELATIVE = (
    r"\b(?:today|yesterday|the day before yesterday|(?:about\s+)?(?:" + AMOUNT + r")\s+(?:day|week|month|year)s?\s+ago"
    r"|last\s+(?:week|month|year))\b"
)
MONTH_DATE = r"\b(?:on\s+)?(" + MONTH + r")\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?\b"
SAME_DAY_RETURN = (
    r"\b(?:just\s+)?(?:got\s+back|returned)\s+from\s+(?:an?\s+)?(?:guided\s+)?(?:tour|visit|trip|event|concert|exhibit)\b"
)
RANGE_LIMITS = {"day": 36500, "week": 5200, "month": 1200, "year": 100}
PARSE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy/M/d H:mm", "yyyy/M/d", "yyyy-M-d H:mm", "yyyy-M-d",
    "h:mm a 'on' d MMMM, yyyy", "h:mma 'on' d MMMM, yyyy",
]


def parse_time(value: Column | str) -> Column:
    """Timestamp of the accepted forms; a weekday in parentheses is dropped; anything else is null."""
    text = F.trim(F.regexp_replace(F.coalesce(col_of(value), F.lit("")), r"\s*\([A-Za-z]{3}\)\s*", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\b(am|pm)\b", "$1"), r"Z$", "")

    def first(t: Column) -> Column:
        upper = F.when(t.rlike(r"(?i)\d\s*[ap]m\s"), F.regexp_replace(F.regexp_replace(t, r"(?i)(\d)\s*am\s", "$1 AM "), r"(?i)(\d)\s*pm\s", "$1 PM ")).otherwise(t)
        return F.coalesce(*[F.try_to_timestamp(upper, F.lit(p)) for p in PARSE_FORMATS]).cast("timestamp_ntz")

    return let(text, first)


def iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def shift_parts(amount: Column, unit: Column) -> tuple[Column, Column]:
    """Months or, for hours to weeks, seconds of an amount; both null for any other unit."""
    months = F.when(unit == "month", amount).when(unit == "year", amount * 12)
    seconds = F.when(unit == "hour", amount * 3600).when(unit == "day", amount * 86400).when(unit == "week", amount * 604800)
    return months.cast("int"), F.round(seconds).cast("bigint")


def shift(ts: Column, amount: Column, unit: Column) -> Column:
    """Calendar shift: months and years clamp to the month end, hours to weeks add time."""
    months, seconds = shift_parts(amount, unit)
    day = F.to_date(ts)
    moved = F.date_diff(F.add_months(day, months), day)
    return F.when(months.isNotNull(), F.timestamp_add("DAY", moved.cast("bigint"), ts)).when(seconds.isNotNull(), F.timestamp_add("SECOND", seconds, ts))


def moved(at: np.ndarray, months: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """``shift`` of microseconds inside a task, by its parts; one of them is 0."""
    day = at.astype("M8[us]").astype("M8[D]")
    month = day.astype("M8[M]")
    target = month + months.astype("m8[M]")
    last = (target + 1).astype("M8[D]") - 1
    other = np.minimum(target.astype("M8[D]") + (day - month.astype("M8[D]")), last)
    return at + (other - day).astype("m8[us]").astype("int64") + seconds * 1_000_000


def word_number(word: Column) -> Column:
    """Number of a digit string or number word; 0 for anything else."""
    lowered = F.lower(word)
    value = F.when(lowered.rlike(r"^\d{1,9}$"), F.expr("1").cast("bigint") * lowered.try_cast("bigint"))
    for name, number in NUMBER_WORDS.items():
        value = F.when(lowered == name, F.lit(number).cast("bigint")).otherwise(value)
    return F.coalesce(value, F.lit(0).cast("bigint"))


def month_number(name: Column) -> Column:
    lowered = F.lower(name)
    value = F.lit(None).cast("int")
    for number, month in enumerate(MONTHS, start=1):
        value = F.when(lowered == month, F.lit(number)).otherwise(value)
    return value


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Date of valid parts, null otherwise."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def with_clock(day: Column, clock_of: Column) -> Column:
    """A date at the time of day of a timestamp."""
    return F.timestamp_add("DAY", F.date_diff(day, F.to_date(clock_of)).cast("bigint"), clock_of)


def _answer(at: Column, status: Column | str, trace: Column | str) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(at.cast("timestamp_ntz").alias("at"), lit(status).alias("status"), lit(trace).alias("trace"))



def relative_time(expression: Column | str, anchor: Column) -> Column:
    """Struct (at, status, trace) of a relative expression against its anchor time."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(col_of(expression), F.lit("")))), r"^about\s+", "")
    pattern = r"^(\w+)\s+(day|week|month|year)s?\s+ago$"
    none = F.lit(None)

    def solve(t: Column) -> Column:
        last = t.startswith("last ")
        unit = F.when(last, F.regexp_extract(t, r"(\S+)$", 1)).otherwise(F.regexp_extract(t, pattern, 2))
        amount = F.when(last, F.lit(1).cast("bigint")).otherwise(word_number(F.regexp_extract(t, pattern, 1)))
        limit = F.lit(0)
        for name, value in RANGE_LIMITS.items():
            limit = F.when(unit == name, F.lit(value)).otherwise(limit)
        return (
            F.when((t == ""), _answer(none, "unknown", "missing_expression_or_anchor"))
            .when(anchor.isNull(), _answer(none, "symbolic", "missing_expression_or_anchor"))
            .when(t == "today", _answer(anchor, "exact", "today@mentioned_at"))
            .when(t == "yesterday", _answer(shift(anchor, F.lit(-1), F.lit("day")), "exact", "yesterday@mentioned_at"))
            .when(t == "the day before yesterday", _answer(shift(anchor, F.lit(-2), F.lit("day")), "exact", "day_before_yesterday@mentioned_at"))
            .when(~last & ~t.rlike(pattern), _answer(none, "symbolic", "unsupported_relative_expression"))
            .when(amount <= 0, _answer(none, "ambiguous", "invalid_relative_amount"))
            .when(amount > limit, _answer(none, "ambiguous", "relative_amount_out_of_range"))
            .otherwise(_answer(shift(anchor, -amount, unit), "exact", F.concat(F.lit("relative_"), unit, F.lit("@mentioned_at"))))
        )

    return let(text, solve)


def absolute_time(text: Column | str, anchor: Column) -> Column:
    """Struct (at, status, trace) of an explicit month and day; a missing year is borrowed from the anchor."""
    pattern = r"(?i)" + MONTH_DATE

    def solve(t: Column) -> Column:
        year = F.nullif(F.regexp_extract(t, pattern, 3), F.lit(""))
        day = safe_date(F.coalesce(year.try_cast("int"), F.year(anchor)), month_number(F.regexp_extract(t, pattern, 1)),
                        F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")).try_cast("int"))
        at = F.when(anchor.isNotNull(), with_clock(day, anchor)).otherwise(day.cast("timestamp_ntz"))
        none = F.lit(None)
        return (
            F.when(~t.rlike(pattern), _answer(none, "unknown", "missing_absolute_date"))
            .when(year.isNull() & anchor.isNull(), _answer(none, "symbolic", "missing_year_anchor"))
            .when(day.isNull(), _answer(none, "ambiguous", "invalid_absolute_date"))
            .otherwise(_answer(at, "exact", "explicit_month_day"))
        )

    return let(F.coalesce(col_of(text), F.lit("")), solve)


def weekday(ts: Column) -> Column:
    """Monday 0 … Sunday 6."""
    return F.weekday(ts)


def _day_start(day: Column) -> Column:
    return day.cast("timestamp_ntz")


def _day_end(day: Column) -> Column:
    return F.timestamp_add("SECOND", F.lit(86399).cast("bigint"), day.cast("timestamp_ntz"))


def grounded_interval(expression: Column | str, mentioned: Column) -> Column:
    """Struct (start, end, trace) of last weekend, last month, last year or a mid-month span; null otherwise.

    Ends are whole seconds (the last second of the last day).
    """
    def span(start: Column, end: Column, trace: str) -> Column:
        return F.struct(_day_start(start).alias("start"), _day_end(end).alias("end"), F.lit(trace).alias("trace"))

    def solve(t: Column) -> Column:
        today = F.to_date(mentioned)
        since_sunday = F.pmod(weekday(mentioned) - 6, F.lit(7))
        sunday = F.date_sub(today, F.when(since_sunday == 0, F.lit(7)).otherwise(since_sunday))
        month_start = F.add_months(F.trunc(today, "month"), -1)
        year = F.year(mentioned) - 1
        mid = r"^(?:in\s+)?mid[-\s](" + MONTH + r")(?:\s+(\d{4}))?$"
        mid_year = F.coalesce(F.nullif(F.regexp_extract(t, mid, 2), F.lit("")).try_cast("int"), F.year(mentioned))
        mid_month = month_number(F.regexp_extract(t, mid, 1))
        return (
            F.when(mentioned.isNull(), F.lit(None))
            .when(t == "last weekend", span(F.date_sub(sunday, 1), sunday, "last_completed_weekend@mentioned_at"))
            .when(t == "last month", span(month_start, F.last_day(month_start), "previous_calendar_month@mentioned_at"))
            .when(t == "last year", span(safe_date(year, F.lit(1), F.lit(1)), safe_date(year, F.lit(12), F.lit(31)), "previous_calendar_year@mentioned_at"))
            .when(t.rlike(mid), span(safe_date(mid_year, mid_month, F.lit(10)), safe_date(mid_year, mid_month, F.lit(20)), "mid_month_interval"))
        )

    return let(F.regexp_replace(F.lower(F.trim(F.coalesce(col_of(expression), F.lit("")))), r"^just\s+", ""), solve)


def grounded_point(expression: Column | str, mentioned: Column) -> Column:
    """Relative, then absolute resolution of a spoken expression ("just", "a couple of days ago")."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(col_of(expression), F.lit("")))), r"^just\s+", "")
    text = F.regexp_replace(text, r"\ba couple of\s+days?\s+ago\b", "two days ago")
    return let(text, lambda t: let(relative_time(t, mentioned), lambda r: F.when(r["at"].isNotNull(), r).otherwise(absolute_time(t, mentioned))))


def bind_time(expression: Column | str, mentioned: Column) -> Column:
    """Struct (at, precision, duration_value, duration_unit, status) by the ordered binding rules."""
    none_b, none_s = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def made(at: Column, precision: Column | str, value: Column = none_b, unit: Column = none_s) -> Column:
        return F.struct(at.cast("timestamp_ntz").alias("at"), (F.lit(precision) if isinstance(precision, str) else precision).alias("precision"),
                        value.alias("duration_value"), unit.alias("duration_unit"), F.when(at.isNotNull(), "resolved").otherwise("unresolved").alias("status"))

    unresolved = made(F.lit(None).cast("timestamp_ntz"), "unknown")
    # Forms of offsets and dates.
    offset = r"(?:exactly\s+|about\s+|around\s+|for\s+(?:the\s+past\s+)?|past\s+)?(" + AMOUNT + r")\s+(day|week|month|year)s?(?:\s+ago|\s+now)?"
    slash = r"\b(?:on\s+the\s+)?(\d{1,2})/(\d{1,2})\b"
    day_of = r"(?:on\s+the\s+)?(\d{1,2})(?:st|nd|rd|th)?\s+of\s+(" + MONTH + r")"
    month_day = r"(?:on\s+)?(" + MONTH + r")\s+(\d{1,2})(?:st|nd|rd|th)?"

    def dated(month: Column, day: Column) -> Column:
        return with_clock(safe_date(F.year(mentioned), month, day), mentioned)

    def number(t: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast("int")

    def solve(t: Column) -> Column:
        amount, unit = word_number(F.regexp_extract(t, offset, 1)), F.regexp_extract(t, offset, 2)
        return (
            F.when(mentioned.isNull() | (t == ""), unresolved)
            .when(t.isin("today", "just", "recently") | t.startswith("just recently"),
                  made(mentioned, F.when(t == "today", "day").otherwise("approximate_recent")))
            .when(t.contains("yesterday"), made(shift(mentioned, F.lit(-1), F.lit("day")), "day"))
            .when(t.rlike(offset), made(shift(mentioned, -amount, unit), F.when(t.rlike("about|around"), "approximate").otherwise(unit), amount, unit))
            .when(t == "last week", made(shift(mentioned, F.lit(-1), F.lit("week")), "week"))
            .when(t.contains("last summer"), made(safe_date(F.year(mentioned) - 1, F.lit(7), F.lit(1)), "season"))
            .when(t.contains("few years ago"), made(shift(mentioned, F.lit(-3), F.lit("year")), "coarse_multi_year"))
            .when(t.rlike(slash), made(dated(number(t, slash, 1), number(t, slash, 2)), "day"))
            .when(t.rlike(day_of), made(dated(month_number(F.regexp_extract(t, day_of, 2)), number(t, day_of, 1)), "day"))
            .when(t.rlike(month_day), made(dated(month_number(F.regexp_extract(t, month_day, 1)), number(t, month_day, 2)), "day"))
            .when(t.rlike(r"\bin\s+january\b"), made(safe_date(F.when(F.month(mentioned) > 1, F.year(mentioned)).otherwise(F.year(mentioned) - 1), F.lit(1), F.lit(1)), "month"))
            .otherwise(unresolved)
        )

    return let(F.lower(F.trim(F.coalesce(col_of(expression), F.lit("")))), solve)


def _override(base: Column, at: Column, precision: str) -> Column:
    return F.struct(at.cast("timestamp_ntz").alias("at"), F.lit(precision).alias("precision"), base["duration_value"].alias("duration_value"),
                    base["duration_unit"].alias("duration_unit"), F.when(at.isNotNull(), "resolved").otherwise("unresolved").alias("status"))


def bind_named(expression: Column | str, mentioned: Column) -> Column:
    """Named-speaker rules on top of the binding rules: last weekday, tomorrow, last month, last year."""
    def solve(t: Column) -> Column:
        named = F.regexp_extract(t, r"\blast\s+(" + "|".join(WEEKDAYS) + r")\b", 1)
        target = F.lit(None).cast("int")
        for number, name in enumerate(WEEKDAYS):
            target = F.when(named == name, F.lit(number)).otherwise(target)
        back = F.pmod(weekday(mentioned) - target, F.lit(7))
        back = F.when(back == 0, F.lit(7)).otherwise(back)
        return let(bind_time(t, mentioned), lambda base: (
            F.when(base["at"].isNotNull() | mentioned.isNull(), base)
            .when(named != "", _override(base, shift(mentioned, -back, F.lit("day")), "day"))
            .when(t.contains("tomorrow"), _override(base, shift(mentioned, F.lit(1), F.lit("day")), "day"))
            .when(t == "last year", _override(base, safe_date(F.year(mentioned) - 1, F.lit(1), F.lit(1)), "year"))
            .when(t == "last month", _override(base, F.add_months(F.trunc(F.to_date(mentioned), "month"), -1), "month"))
            .otherwise(base)))

    return let(F.lower(F.trim(F.coalesce(col_of(expression), F.lit("")))), solve)


def bind_named_strict(expression: Column | str, mentioned: Column) -> Column:
    """Second version: compound days are exact, named weekdays stay unresolved."""
    def solve(t: Column) -> Column:
        day = lambda base, n: _override(base, shift(mentioned, F.lit(n), F.lit("day")), "day")
        return let(bind_time(t, mentioned), lambda base: (
            F.when(mentioned.isNull(), base)
            .when(t.contains("day after tomorrow"), day(base, 2))
            .when(t.contains("day before yesterday"), day(base, -2))
            .when(t.rlike(r"\byesterday\b"), day(base, -1))
            .when(t.rlike(r"\btomorrow\b"), day(base, 1))
            .when(t.rlike(r"\blast\s+(?:" + "|".join(WEEKDAYS) + r")\b"), _override(base, F.lit(None).cast("timestamp_ntz"), "weekday_relative_ambiguous"))
            .otherwise(base)))

    text = F.regexp_replace(F.lower(F.trim(F.coalesce(col_of(expression), F.lit("")))), r"\s+", " ")
    return let(text, solve)


def target_time(question: Column | str, question_time: Column) -> Column:
    """Time a question asks about; questions that name a weekday stay open."""
    def solve(t: Column) -> Column:
        found = F.regexp_extract(t, r"(" + RELATIVE + r")", 1)
        return F.when((found != "") & ~t.rlike(r"\b(?:" + "|".join(WEEKDAYS) + r")\b"), relative_time(found, question_time)["at"])

    return let(F.lower(F.coalesce(col_of(question), F.lit(""))), solve)


def day_text(ts: Column) -> Column:
    """``7 May 2023``."""
    return F.date_format(ts, "d MMMM yyyy")


def date_answer(at: Column, precision: Column) -> Column:
    return F.when(precision == "year", F.date_format(at, "yyyy")).when(precision == "month", F.date_format(at, "MMMM yyyy")).otherwise(day_text(at))


def typed_date_answer(at: Column, mentioned: Column, precision: Column, expression: Column) -> Column:
    """Struct (answer, answer_type) of a when-question by the precision of its event; null when unsafe."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(expression, F.lit("")))), r"\s+", " ")
    season = F.regexp_extract(text, r"(spring|summer|autumn|fall|winter)", 1)
    season = F.when(season == "fall", "autumn").otherwise(season)
    made = lambda a, k: F.struct(a.alias("answer"), F.lit(k).alias("answer_type"))
    year = F.date_format(at, "yyyy")
    p = F.lower(precision)
    return (
        F.when(at.isNull() | text.rlike(r"\blast\s+(?:" + "|".join(WEEKDAYS) + r")\b"), F.lit(None))
        .when(p.isin("week", "approximate_week") | text.contains("last week"),
              F.when(mentioned.isNotNull(), made(F.concat(F.lit("the week before "), day_text(mentioned)), "DATE_WINDOW")))
        .when((p == "season") | (season != ""), F.when(season != "", made(F.concat(season, F.lit(" "), year), "DATE_WINDOW")))
        .when(p.isin("approximate", "approximate_year"), made(F.concat(F.lit("around "), year), "YEAR"))
        .when(p == "year", made(year, "YEAR"))
        .when(p == "month", made(F.date_format(at, "MMMM yyyy"), "MONTH"))
        .when(p == "day", made(day_text(at), "DATE_POINT"))
    )


def answer_type(answer: Column | str) -> Column:
    """Kind of a rendered answer, null for anything unrecognised."""
    t = F.lower(F.trim(F.coalesce(col_of(answer), F.lit(""))))
    year = r"(?:18|19|20)\d{2}"
    return (
        F.when(t.rlike(rf"^(?:around\s+)?{year}$"), "YEAR")
        .when(t.rlike(rf"^\d{{1,2}}\s+(?:{MONTH})\s+{year}$"), "DATE_POINT")
        .when(t.rlike(rf"^(?:{MONTH})\s+{year}$"), "MONTH")
        .when(t.startswith("the week before ") & t.rlike(rf"\b{year}\b"), "DATE_WINDOW")
        .when(t.rlike(rf"^(?:spring|summer|autumn|winter)\s+{year}$"), "DATE_WINDOW")
        .when(t.rlike(r"^\d+(?:\.\d+)?\s+(?:days?|weeks?|months?|years?)$"), "DURATION")
    )


def answer_unit(question: Column) -> Column:
    t = F.lower(question)
    result = F.lit("day")
    for unit in ("year", "month", "week", "day"):
        result = F.when(t.rlike(rf"\b{unit}s?\b"), unit).otherwise(result)
    return result


def calendar_days(left: Column, right: Column) -> Column:
    return F.abs(F.date_diff(F.to_date(right), F.to_date(left)))


def month_difference(left: Column, right: Column, floor_by_day: bool) -> Column:
    """Months between two dates: by month number, or complete months only."""
    early, late = F.least(F.to_date(left), F.to_date(right)), F.greatest(F.to_date(left), F.to_date(right))
    months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)
    return months - F.when(F.lit(floor_by_day) & (F.dayofmonth(late) < F.dayofmonth(early)), 1).otherwise(0)


def difference(left: Column, right: Column, unit: Column, floor_by_day: bool = False) -> Column:
    days, months = calendar_days(left, right), month_difference(left, right, floor_by_day)
    hours = F.abs(F.timestamp_diff("SECOND", left, right)) / 3600
    return (
        F.when(unit == "hour", hours).when(unit == "day", days.cast("double")).when(unit == "week", days / 7)
        .when(unit == "month", months.cast("double")).otherwise(months / 12)
    )


def amount_text(value: Column, unit: Column) -> Column:
    """``3 weeks``, ``1 day``, ``2.5 years``: up to two decimals, trailing zeros dropped."""
    whole = F.bround(value, 0)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", "")
    shown = F.when(F.abs(value - whole) < 1e-6, whole.cast("bigint").cast("string")).otherwise(plain)
    return F.concat(shown, F.lit(" "), unit, F.when(F.abs(value - 1) < 1e-6, "").otherwise("s"))


def rounded_duration(seconds: Column, question: Column) -> Column:
    """Elapsed seconds in the unit the question names: 30-day months, 365-day years, half-to-even."""
    t, days = F.lower(question), seconds / 86400.0
    made = lambda v, u: F.concat(F.bround(v, 0).cast("bigint").cast("string"), F.lit(" " + u))
    return (
        F.when(t.contains("month"), made(days / 30.0, "months")).when(t.contains("week"), made(days / 7.0, "weeks"))
        .when(t.contains("year"), made(days / 365.0, "years")).otherwise(made(days, "days"))
    )
