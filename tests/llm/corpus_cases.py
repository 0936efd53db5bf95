"""Small documents with the awkward cases that every operator must define."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)
LABELS = StructType([StructField("doc_id", LongType()), StructField("quality", IntegerType()), StructField("toxic", IntegerType())])


def docs_frame(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "a b c d e a b c d e f g",
    "a b c d e " * 40,
    "line one\nline one\n\n \nline two\r\nline one",
    "é ü ñ 漢字\x0bx\x0cy z #1 100% <b> a&b",
    "the same text here is repeated once more\n" * 3,
    "word " * 30_000,
    " ".join(f"w{i % 977}" for i in range(20_000)),
    "one",
]
