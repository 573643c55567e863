"""The record table: one row a publication of a source, multi-valued fields as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANY = T.ArrayType(T.StringType())
RECORD = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", _MANY),
        T.StructField("year", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("citations", T.LongType()),
        T.StructField("doi", T.StringType()),
        T.StructField("doc_type", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("keywords", _MANY),
        T.StructField("index_keywords", _MANY),
        T.StructField("affiliations", _MANY),
        T.StructField("countries", _MANY),
        T.StructField("references", _MANY),
        T.StructField("funding", _MANY),
        T.StructField("language", T.StringType()),
        T.StructField("volume", T.StringType()),
        T.StructField("pages", T.StringType()),
        T.StructField("source_db", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """``df`` in the columns and types of ``RECORD``: missing ones null, blank text null, bad numbers null, citations 0."""
    out = []
    for field in RECORD:
        if field.name not in df.columns:
            column = F.lit(None).cast(field.dataType)
        elif field.dataType == T.StringType():
            column = F.nullif(F.trim(F.col(field.name).cast("string")), F.lit(""))
        else:
            column = F.col(field.name).try_cast(field.dataType)
        out.append((F.coalesce(column, F.lit(0).cast("long")) if field.name == "citations" else column).alias(field.name))
    return df.select(*out)
