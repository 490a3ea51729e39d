import pytest
from made_up import prose
from pyspark.sql import types as T

#: Names that operators give to columns of their own.
CLASHES = "part mask n_hit items cleaned text_key item kept score votes spans ids removed found terms n_words body mark rank span words sketch own_0 in_0".split()


@pytest.fixture(scope="session")
def edge_rows():
    long = "\n".join(prose(40, i) for i in range(1500))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, long), (6, long[:200_000] + " end"), (7, "x" * 30_000), (8, prose(120, 8)), (9, prose(120, 8)), (9, prose(120, 8)),
            (10, "Ünï cödé 漢字 😀 mail a.b@c.example.org, 10.0.0.255 and +1 (555) 010-9999 or 4111 1111 1111 1111"), (None, prose(60, 11)), (None, None), (12, "!!! ??? ..."), (13, "1 " * 3000), (-5, "negative id")]


@pytest.fixture(scope="session")
def edge_dir(spark, edge_rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in CLASHES]])
    rows = [(i, t, None if k % 3 == 0 else ("en", "fr")[k % 2], None, None, *["x"] * len(CLASHES)) for k, (i, t) in enumerate(edge_rows)]
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/full/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{path}/empty/documents.parquet")
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(4, 1, 1), (8, 0, 0), (10, None, None), (None, 1, 1), (5, 1, 0), (5, 1, 0)], labels).write.parquet(f"{path}/full/labels.parquet")
    spark.createDataFrame([], labels).write.parquet(f"{path}/empty/labels.parquet")
    items = "item_id long, text string, rank string, found string"
    spark.createDataFrame([(1, prose(120, 8), "x", "x"), (2, None, "x", "x"), (3, "", "x", "x"), (None, prose(12, 8), "x", "x"), (4, "one", "x", "x"), (4, "two", "x", "x"), (5, "漢字 😀 Ünï", "x", "x")], items).write.parquet(f"{path}/full/benchmark.parquet")
    spark.createDataFrame([], items).write.parquet(f"{path}/empty/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, first=0):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts, first)], "doc_id long, text string")
    return docs
