"""CSV tables of examples, with line breaks and quotes inside cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators.order import row_index

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
UNNAMED_INDEX = "_c0"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a table with a header; types are inferred unless a schema is given.

    Cells may span lines, so a file is read by one task: keep files to a few hundred
    megabytes, as `write_csv` does through the partitions it writes. Inference costs a pass
    over the data; give the schema for large tables. An unnamed index column is dropped,
    an empty cell is null.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    table = reader.csv(path)
    return table.drop(UNNAMED_INDEX) if UNNAMED_INDEX in table.columns else table


def write_csv(df: DataFrame, path: str, index_by: str | None = None) -> None:
    """Write a table with a header; nested columns become JSON text.

    `index_by` adds a leading unnamed column with the row number in the order of that key.
    """
    if index_by is not None:
        df = row_index(df, index_by, "").select("", *df.columns)
    nested = (T.StructType, T.MapType, T.ArrayType, T.VariantType)
    kinds = {field.name: field.dataType for field in df.schema.fields}
    cells = [
        F.to_json(df[name]).alias(name) if isinstance(kind, nested) else df[name] for name, kind in kinds.items()
    ]
    df.select(*cells).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
