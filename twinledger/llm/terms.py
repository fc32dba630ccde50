"""Terms of a text: longest runs of letters and digits of the lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """All terms of a text in order; null gives null, a text without terms an empty array."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
