import pathlib

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
#: Nulls, empty and odd texts, ties, repeated rows, very long texts.
EDGES = [
    (1, ""), (2, None), (3, " "), (4, "a"), (5, "a"), (5, "a"), (None, "lost"), (6, "one  two\tthree\r\n\n four's we'll"),
    (7, "É ß µ ª ² ½ ŝ Σας ΣΑΣ 漢字かな 한글 👍🏽 é ẛ̣ İI"), (8, "x\x1cy\x1dz <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>"),
    (9, "漢字" * 700), (10, "word " * 3000), (11, "ab" * 4000), (12, " " * 5000 + "x" + "　" * 3000), (13, "x\n\n\n  y   " * 900), (13, "x\n\n\n  y   " * 900), (14, "12345,67!?--" * 500),
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """The odd rows, with columns whose names operators use within."""
    rows = [(i, t, "x", 1, 2, b"c", 0.5) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long, r int, content binary, score double")


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture
def table_dir(tmp_path):
    """Writes tables as a folder that queries can read."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(str(pathlib.Path(tmp_path, f"{name}.parquet")))
        return str(tmp_path)

    return make
