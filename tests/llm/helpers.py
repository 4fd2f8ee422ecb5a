"""Small tables with the odd cases, shared by the tests of this folder."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [None, "", " ", "\n\n", "a", "ÉÀ ß", "日本語 テスト 🎉", "x" * 5000, "one two  three\n four", "\x00\x1f odd \x7f", "İstanbul K Σς"]
SF = "/root/testdata/sf0.001"
