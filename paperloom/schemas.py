"""The types of an extracted document and its parts, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


ExtractedFigure = _struct(index=T.IntegerType(), image_path=T.StringType(), caption=T.StringType(), page=T.IntegerType(), bbox=T.ArrayType(T.DoubleType()), kind=T.StringType())
ExtractedTable = _struct(index=T.IntegerType(), markdown=T.StringType(), caption=T.StringType(), page=T.IntegerType())
ExtractedReference = _struct(raw=T.StringType())
Metadata = _struct(title=T.StringType(), authors=T.StringType(), year=T.StringType(), abstract=T.StringType(), n_pages=T.IntegerType(), auto_fallback=T.StringType())
ExtractedDoc = _struct(
    markdown=T.StringType(), figures=T.ArrayType(ExtractedFigure), tables=T.ArrayType(ExtractedTable),
    references=T.ArrayType(ExtractedReference), metadata=Metadata, backend=T.StringType(),
)
