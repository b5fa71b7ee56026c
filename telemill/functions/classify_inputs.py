"""Texts that classifiers look at."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.functions.exprs import decoded_banner, has_value


def banner_of(*fields: str) -> Column:
    """Decoded, lower-cased text of the first field that has any."""
    return decoded_banner(F.coalesce(*[F.when(has_value(f), F.col(f)) for f in fields]))
