"""United States public holidays as a rule on the date, so that no table has to be joined."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and rules of the holidays. Weekdays count from Sunday = 1.
FIXED_DAYS = [
    ("New Year's Day", 1, 1, None),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, None),
    ("Veterans Day", 11, 11, None),
    ("Christmas Day", 12, 25, None),
]
WEEKDAY_RULES = [
    ("Martin Luther King Jr. Day", 1, 2, 15, 21),
    ("Washington's Birthday", 2, 2, 15, 21),
    ("Memorial Day", 5, 2, 25, 31),
    ("Labor Day", 9, 2, 1, 7),
    ("Columbus Day", 10, 2, 8, 14),
    ("Thanksgiving Day", 11, 5, 22, 28),
]


def _fixed_name(day: Column) -> Column:
    name = F.lit(None).cast("string")
    for label, month, number, since in FIXED_DAYS:
        hit = (F.month(day) == month) & (F.dayofmonth(day) == number)
        if since is not None:
            hit = hit & (F.year(day) >= since)
        name = F.when(hit, label).otherwise(name)
    return name


def holiday_name(day: Column, observed: bool = False) -> Column:
    """Holiday on ``day`` or NULL. ``observed`` also names the Friday or Monday next to a weekend holiday."""
    name = _fixed_name(day)
    for label, month, weekday, first, last in WEEKDAY_RULES:
        hit = (
            (F.month(day) == month)
            & (F.dayofweek(day) == weekday)
            & F.dayofmonth(day).between(first, last)
        )
        name = F.when(hit, label).otherwise(name)
    if observed:
        after = F.when(F.dayofweek(day) == 6, _fixed_name(F.date_add(day, 1)))
        before = F.when(F.dayofweek(day) == 2, _fixed_name(F.date_sub(day, 1)))
        name = F.coalesce(name, F.concat(F.coalesce(after, before), F.lit(" (observed)")))
    return name


def us_holidays(spark: SparkSession, first_year: int, last_year: int, observed: bool = False) -> DataFrame:
    """Table ``ds, holiday``; one row per holiday, so its size is set by the number of years."""
    days = F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
                      F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))
    return (
        spark.range(1)
        .select(F.explode(days).alias("ds"))
        .withColumn("holiday", holiday_name(F.col("ds"), observed))
        .filter(F.col("holiday").isNotNull())
    )
