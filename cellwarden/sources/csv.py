"""CSV loading by column name, and CSV to JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: timestamp pattern of the exported counter and trace files.
TIMESTAMP_PATTERN = "MM/dd/yyyy HH:mm:ss"


def read_csv_text(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as strings under the names in the header.

    The header is read first and every file is then checked against it (``enforceSchema`` off):
    a file with another column order fails instead of being read by position. Without
    ``multiline`` the files are split over tasks; line breaks inside quotes need it, and then a
    file is the unit of work.
    """
    options = {"header": True, "escape": '"', "multiLine": multiline}
    names = spark.read.options(**options, inferSchema=False).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(text).options(**options, enforceSchema=False).csv(path)


def _typed(raw: DataFrame, field: T.StructField, pattern: str) -> Column:
    if field.name not in raw.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    text = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        return F.to_timestamp(text, pattern).alias(field.name)
    return text.cast(field.dataType).alias(field.name)


def load_csv_by_name(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    ts_pattern: str = TIMESTAMP_PATTERN,
    multiline: bool = False,
) -> DataFrame:
    """Match columns by header name, ignore unknown ones, give missing ones NULL.

    Text that does not parse raises, because no bad rows are allowed. A required column that
    is absent from the file is an error before anything is read.
    """
    raw = read_csv_text(spark, path, multiline)
    absent = [f.name for f in schema if not f.nullable and f.name not in raw.columns]
    if absent:
        raise ValueError(f"required columns missing from {path}: {absent}")
    return raw.select([_typed(raw, f, ts_pattern) for f in schema])


def append_csv(spark: SparkSession, path: str, schema: T.StructType, table_path: str) -> None:
    """Append the rows of a CSV file to a parquet table."""
    load_csv_by_name(spark, path, schema).write.mode("append").parquet(table_path)


def breaks_in_fields(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field holds a line break: then, and only then, a line has an odd number of quotes."""
    return not spark.read.text(path).where(F.pmod(F.regexp_count("value", F.lit('"')), F.lit(2)) == 1).isEmpty()


def csv_to_jsonl(spark: SparkSession, source: str, target: str, multiline: bool | None = None) -> None:
    """Write every CSV row as a JSON object of strings; empty fields stay ``""``.

    Files are read in splits, by many tasks each, unless a field holds a line break (``multiline`` says so, or a pass over
    the lines finds out). A missing source raises ``FileNotFoundError`` with the path.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.globStatus(hadoop):
        raise FileNotFoundError(f"the file '{source}' was not found")
    if multiline is None:
        multiline = breaks_in_fields(spark, source)
    rows = read_csv_text(spark, source, multiline).na.fill("")
    rows.write.option("ignoreNullFields", False).json(target)
