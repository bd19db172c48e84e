"""Column-to-column expressions. All run inside Catalyst; there is no Python UDF here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.constants import LABEL_FLOORS, MISSING_NUMBER_WORDS, QUARTER_FRAME

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(value: Column) -> Column:
    """NaN and infinities count as missing."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def lenient_number(text: Column) -> Column:
    """Number held as text; blanks, placeholder words and junk become null."""
    t = F.trim(text.cast("string"))
    return F.when(~t.isin(MISSING_NUMBER_WORDS) & t.rlike(_NUMBER), t.try_cast("double"))


def lenient_date(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast("date")


# A time of day followed by a zone name or an offset.
_ZONED = r"\d:\d{2}(:\d{2}(\.\d+)?)?\s*([A-Za-z][A-Za-z/_]*|[+-]\d{1,2}(:?\d{2})?)$"


def trading_date(value: Column) -> Column:
    """UTC calendar day of a date or of text in mixed formats; null if unreadable. Text without a zone
    is taken as UTC, whatever the session's time zone."""
    text = F.trim(value.cast("string"))
    in_utc = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone())
    return F.when(text.rlike(_ZONED), F.to_date(in_utc)).otherwise(F.to_date(text.try_cast("timestamp_ntz")))


def strict_trading_date(value: Column) -> Column:
    """As ``trading_date``, but an unreadable value fails the job and is named in the error."""
    day = trading_date(value)
    shown = F.coalesce(value.cast("string"), F.lit("null"))
    return F.when(day.isNotNull(), day).otherwise(
        F.raise_error(F.concat(F.lit("unparseable trading date: "), shown)).cast("date")
    )


def symbol_text(value: Column) -> Column:
    return F.upper(F.trim(value))


def zero_padded_cik(value: Column) -> Column:
    """Ten-digit identifier; an optional ``CIK`` prefix is dropped, anything but digits fails."""
    digits = F.regexp_replace(F.upper(F.trim(value.cast("string"))), "^CIK", "")
    return F.when(digits.rlike(r"^\d+$"), F.lpad(digits, F.greatest(F.length(digits), F.lit(10)), F.lit("0"))).otherwise(
        F.raise_error(F.concat(F.lit("CIK must contain digits only: "), F.coalesce(digits, F.lit("null"))))
    )


def frame_year(frame: Column) -> Column:
    return F.regexp_extract(frame, QUARTER_FRAME, 1).try_cast("int")


def frame_quarter(frame: Column) -> Column:
    return F.regexp_extract(frame, QUARTER_FRAME, 2).try_cast("int")


def is_quarter_frame(frame: Column) -> Column:
    return F.coalesce(frame.rlike(QUARTER_FRAME), F.lit(False))


def prior_year_frame(year: Column, quarter: Column) -> Column:
    return F.format_string("CY%dQ%d", year - 1, quarter)


def clip(value: Column, lower: Column, upper: Column) -> Column:
    """Null-safe clip: ``least``/``greatest`` alone would turn a null value into a bound."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, upper), lower))


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)


def half_even_long(value: Column) -> Column:
    return F.bround(value, 0).cast("long")


def iso_date(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def score_label(score: Column) -> Column:
    """Word for a 0-100 score; null has its own word, other values fail."""
    out = F.when(score.isNull(), "Unavailable").when(
        (score < 0) | (score > 100),
        F.raise_error(F.concat(F.lit("score outside 0-100: "), score.cast("string"))),
    )
    for floor, label in LABEL_FLOORS:
        out = out.when(score >= floor, label)
    return out


def technical_signal(rsi: Column, close: Column, sma_50: Column) -> Column:
    return (
        F.when(rsi.isNull() | sma_50.isNull(), "Insufficient history")
        .when(rsi >= 70, "Overbought")
        .when(rsi <= 30, "Oversold")
        .when((close > sma_50) & (rsi >= 50), "Bullish")
        .when((close < sma_50) & (rsi < 50), "Bearish")
        .otherwise("Neutral")
    )


def kept(items: Sequence[Column]) -> Column:
    """Array of the items that are not null, in the order given."""
    return F.array_compact(F.array(*items))


def direction_adjusted(percentile: Column, direction: str) -> Column | None:
    if direction == "higher":
        return percentile
    if direction == "lower":
        return F.lit(100.0) - percentile
    return None
