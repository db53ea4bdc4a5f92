"""Column lists and schemas of the incident tables."""

from pyspark.sql import types as T

# Column names of the landed records, in stored order.
INCIDENT_COLUMNS = [
    "INCIDENT_NUMBER",
    "OFFENSE_CODE",
    "OFFENSE_CODE_GROUP",
    "OFFENSE_DESCRIPTION",
    "DISTRICT",
    "REPORTING_AREA",
    "SHOOTING",
    "OCCURRED_ON_DATE",
    "YEAR",
    "MONTH",
    "DAY_OF_WEEK",
    "HOUR",
    "UCR_PART",
    "STREET",
    "Lat",
    "Long",
    "Location",
]

# Columns the cleaning step removes when present.
DROPPED_COLUMNS = ["_id", "Location", "REPORTING_AREA", "SHOOTING", "UCR_PART"]

# Raw values are text; operators.clean coerces them in one place.
RAW_INCIDENT = T.StructType([T.StructField(name, T.StringType()) for name in INCIDENT_COLUMNS])

CODE_LOOKUP = T.StructType([T.StructField("CODE", T.StringType()), T.StructField("NAME", T.StringType())])


def page_schema(record: T.StructType) -> T.StructType:
    """Envelope of one landed page. ``error`` stays text: it may be an object or a plain string."""
    return T.StructType(
        [
            T.StructField("offset", T.LongType()),
            T.StructField("success", T.BooleanType()),
            T.StructField("error", T.StringType()),
            T.StructField("result", T.StructType([T.StructField("records", T.ArrayType(record))])),
        ]
    )


METADATA = T.StructType(
    [
        T.StructField("last_updated", T.StringType()),
        T.StructField(
            "date_range",
            T.StructType(
                [
                    T.StructField("start", T.StringType()),
                    T.StructField("end", T.StringType()),
                    T.StructField("total_days", T.LongType()),
                ]
            ),
        ),
        T.StructField("total_records", T.LongType()),
        T.StructField("districts", T.ArrayType(T.StringType())),
        T.StructField("data_source", T.StringType()),
        T.StructField("resource_id", T.StringType()),
    ]
)
