"""Text to typed values; what cannot be read becomes NULL."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"
# The range of times a nanosecond clock can hold; others count as unreadable.
FIRST_TIME, LAST_TIME = "1677-09-22 00:00:00", "2262-04-11 00:00:00"
ZONED_TEXT = r"(?i)\d:\d\d.*(z|[+-]\d{1,2}(:?\d\d)?)\s*$"


def coerce_numeric(text: Column) -> Column:
    """DOUBLE from text. The pattern keeps out forms only the JVM reads as numbers, such as ``1d``."""
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def coerce_integer(text: Column) -> Column:
    """INT from text such as ``3`` or ``3.0``; a fractional or unreadable value gives NULL."""
    number = coerce_numeric(text)
    return F.when(number % 1 == 0, number.try_cast("int"))


def utc_naive(ts: Column) -> Column:
    """TIMESTAMP to the zone-free wall time in UTC, whatever the session zone is.

    Counted from the epoch: local wall times repeat an hour each autumn and cannot be converted back.
    """
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000)).try_cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def minute_number(ts: Column) -> Column:
    """Minutes since the epoch of a zone-free time, from its fields alone."""
    return F.unix_date(F.to_date(ts)).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def utc_instant(ts: Column) -> Column:
    """The TIMESTAMP of a zone-free time in UTC, the reverse of ``utc_naive``."""
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return F.timestamp_micros(minute_number(ts) * 60_000_000 + micros)


def coerce_timestamp(text: Column) -> Column:
    """TIMESTAMP_NTZ from text; a zone in the text is converted to UTC, text without one is kept as it is."""
    ts = F.when(text.rlike(ZONED_TEXT), utc_naive(text.try_cast("timestamp"))).otherwise(
        text.try_cast("timestamp_ntz")
    )
    first, last = (F.lit(bound).cast("timestamp_ntz") for bound in (FIRST_TIME, LAST_TIME))
    return F.when(ts.between(first, last), ts)


def parse_iso_timestamp(text: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Display form of an ISO timestamp text, ``Z`` accepted."""
    return F.date_format(coerce_timestamp(text), pattern)


def to_day(ts: Column) -> Column:
    return F.to_date(ts)


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts)


def elapsed_days(first: Column, last: Column) -> Column:
    """Whole days between two points in time: elapsed time rounded down, not a calendar difference."""
    return F.extract(F.lit("DAY"), last - first).cast("bigint")


def error_message(envelope_error: Column) -> Column:
    """Message of a failed page: the nested ``message``, else the plain text, else a fixed text."""
    nested = F.get_json_object(envelope_error, "$.message")
    plain = F.when(~envelope_error.startswith("{"), envelope_error)
    return F.coalesce(nested, plain, F.lit("Unknown error"))
