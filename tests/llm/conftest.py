import os

import duckdb
import pytest

from packspark.plans.verify import duck_conn

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return duck_conn(SF)


@pytest.fixture(scope="session")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def got(spark):
    """Results of registered queries on the smallest tables, each run once."""
    import __spark_entry__ as entry

    made = {}

    def run(name):
        if name not in made:
            made[name] = entry.queries()[name](spark, SF).toPandas()
        return made[name]

    return run


ODD = [(1, None, "a"), (2, "", "b"), (3, "Word", "c"), (None, "one two three four five six", "d"),
       (4, "one two three four five six", None), (4, "one two three four five six", None),
       (5, "x " * 30000, "e"), (6, "line\n\nline\nline \t end", "f"), (7, "ünïcödé \U0001F600 中文 ½", "g")]


@pytest.fixture()
def odd(spark):
    """Null, empty, very long, repeated and id-less rows, with extra columns named like results."""
    return spark.createDataFrame([(*r, 9, "z") for r in ODD],
                                 "doc_id bigint, text string, lang string, n_words int, kept string")


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, n_words int, kept string")


assert os.path.isdir(SF)
