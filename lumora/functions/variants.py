"""Facts of JSON texts of any shape, by the VARIANT type: a text is parsed once however many facts are taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, json_col: str, variant: str = "variant", *, strict: bool = False) -> DataFrame:
    """df with the text as a variant; one that is no JSON is null, or fails if strict."""
    return df.withColumn(variant, (F.parse_json if strict else F.try_parse_json)(F.col(json_col)))


def facts(df: DataFrame, variant: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each name: the value at a path ($.a[0].b) as a type, null where it is missing or does not cast."""
    return df.withColumns({name: F.try_variant_get(F.col(variant), path, kind) for name, (path, kind) in paths.items()})


def shape(df: DataFrame, variant: str, by: list[str] = ()) -> DataFrame:
    """by, shape: the type that holds all values of a variant column (or group), as Spark writes types."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(variant).alias("shape"))
