"""Search for raw entity ids and forbidden names in texts that leave the house."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leak_scan(df: DataFrame, row_id: str, text: str, ids: DataFrame) -> DataFrame:
    """(row_id, entity_value): rows whose text holds an id as a token of its own; a longer hexadecimal run that merely contains
    its digits is none. ids: one column."""
    tokens = df.select(row_id, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9A-Fa-f]+"), F.lit(0)))).alias("entity_value"))
    return tokens.join(ids.select(F.col(ids.columns[0]).cast("string").alias("entity_value")).distinct(), "entity_value", "left_semi").select(row_id, "entity_value")


def forbidden_fields(df: DataFrame, row_id: str, json: str, names: list[str]) -> DataFrame:
    """(row_id, field): JSON texts with a key among names, at any depth."""
    keys = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(r'"((?:[^"\\]|\\.)*+)"\s*:'), F.lit(1))
    return df.select(row_id, F.explode(F.array_distinct(keys)).alias("field")).where(F.col("field").isin(names))
