"""The state of analysed cases as JSON text, and back.

Reading keeps what the schema does not know: fields of newer writers stay in ``unknown``, as variants, and are written again with the
case. Text that is no JSON object, or whose fields do not have the schema's types, is kept whole in ``damaged`` beside its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN, DAMAGED = "unknown", "damaged"


def case_text(columns: list[Column], unknown: Column | None = None) -> Column:
    """One JSON object of the columns, nulls included, followed by the unknown fields."""
    known = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    if unknown is None:
        return known
    others = F.to_json(unknown)
    return F.when(
        F.coalesce(F.size(unknown) > 0, F.lit(False)),
        F.concat(F.substr(known, F.lit(1), F.length(known) - 1), F.lit(","), F.substr(others, F.lit(2))),
    ).otherwise(known)


def write_state(cases: DataFrame, id_col: str = "incident_id") -> DataFrame:
    """(id, state): a text per case; a column ``unknown`` (map) is written as fields of the object."""
    names = [c for c in cases.columns if c not in (UNKNOWN, DAMAGED)]
    unknown = F.col(UNKNOWN) if UNKNOWN in cases.columns else None
    return cases.select(id_col, case_text([F.col(c) for c in names], unknown).alias("state"))


def read_state(texts: DataFrame, schema: T.StructType, id_col: str = "incident_id", text_col: str = "state") -> DataFrame:
    """The cases of (id, state): the schema's columns, ``unknown`` and ``damaged`` (null for a sound case).

    Of a damaged case the id beside the text is kept, and its other columns are null.
    """
    text = F.col(text_col)
    marked = T.StructType([*schema.fields, T.StructField(DAMAGED, T.StringType())])
    parsed = F.from_json(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED})
    is_object = F.coalesce(F.substr(F.ltrim(text), F.lit(1), F.lit(1)) == "{", F.lit(False))
    read = texts.select(F.col(id_col).alias("_id"), text.alias("_text"), parsed.alias("_case"), is_object.alias("_object"))
    damaged = F.when(F.col("_object"), F.col(f"_case.{DAMAGED}")).otherwise(F.coalesce("_text", F.lit("")))
    read = read.withColumn(DAMAGED, damaged)
    sound = F.col(DAMAGED).isNull()
    fields = F.from_json(F.when(sound, F.col("_text")), "map<string,variant>")
    names = [f.name for f in schema.fields]
    return read.select(
        *[
            F.coalesce(F.when(sound, F.col(f"_case.`{n}`")), F.col("_id")).alias(n) if n == id_col else F.when(sound, F.col(f"_case.`{n}`")).alias(n)
            for n in names
        ],
        F.map_filter(fields, lambda k, v: ~k.isin(names)).alias(UNKNOWN),
        DAMAGED,
    )
