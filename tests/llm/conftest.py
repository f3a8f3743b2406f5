import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))

#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", "en", None, 4),
    (4, "one", "en", "a", 3),
    (5, "one two", "en", "b", 7),
    (6, "One\x0btwo", "en", "b", 7),
    (7, LONG, "en", "a", len(LONG)),
    (8, LONG + " tail", None, "c", None),
    (9, "一二三四五 😀 \ufffd \x00 ▁▁ é", "zh", "é", 20),
    (10, "same text again and again same text again and again", "en", "a", 51),
    (10, "same text again and again same text again and again", "en", "a", 51),
    (None, "same text again and again same text again and again", "en", "a", 51),
    (None, None, None, None, None),
]


@pytest.fixture()
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture()
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def frame(spark: SparkSession, texts: dict[int, str | None], source: str | None = "s") -> DataFrame:
    return spark.createDataFrame([(i, t, "en", source, None) for i, t in texts.items()], SCHEMA)
