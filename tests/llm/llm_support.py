from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
)


def docs_of(spark, rows):
    """Documents from (doc_id, text, lang, source) with shorter tuples filled up with nulls."""
    return spark.createDataFrame([tuple(r) + (None,) * (4 - len(r)) for r in rows], DOC)
