"""Text helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters replaced by an underscore, then characters removed.
REPLACED = "/\\:|"
REMOVED = '?*"<>'


def normalize_name(name: Column) -> Column:
    """Name that is safe in a path: separators become ``_``, wildcards and quotes vanish."""
    return F.translate(name, REPLACED + REMOVED, "_" * len(REPLACED))
