"""From string records to typed notices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import currency, first_email, money, tidy, timestamp, to_enum

# Procedures of a notice.
PROCEDURES = ["open", "restricted", "negotiated", "framework_agreement", "prior_information_notice", "expression_of_interest", "direct_award", "unknown"]


def normalize(rough: DataFrame, default_currency: str | None = None) -> DataFrame:
    """Typed columns of a raw notice; a blank title is the reason in `rejected`."""
    title = tidy(F.col("title"), 500)
    return rough.select("notice_id", title.alias("title"), F.when(title.isNull(), "title").alias("rejected"), timestamp(F.col("publication"), ["dd/MM/yyyy"]).cast("timestamp_ntz").alias("publication"), money(F.col("budget")).alias("budget"), currency(F.col("budget"), default_currency).alias("currency"), to_enum(F.col("procedure"), PROCEDURES).alias("procedure"), first_email(F.col("contact")).alias("email"), tidy(F.col("country")).alias("country"))


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`missing`: the first of the columns that is null or blank."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return rows.withColumn("missing", F.coalesce(*(F.when(empty(c), F.lit(c)) for c in columns), F.lit(None).cast("string")))
