import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from logquarry import configure
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def lines(spark):
    """lines(text, ...) -> line table of one file; lines({file: [text]}) of several."""
    from logquarry import schema

    def make(*texts, owner="o", dataset="d"):
        files = texts[0] if texts and isinstance(texts[0], dict) else {"f": list(texts)}
        rows = [(owner, dataset, f, i, v) for f, vs in files.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, schema.LINE_SCHEMA)
    return make


@pytest.fixture
def rows(spark):
    """rows({field: value}, ...) -> row table with all columns, like a load gives."""
    from logquarry import fixed_values as V
    from logquarry.operators.parsers import enrich

    def make(*items):
        data = [("o", "d", i.get("file", "f"), n, i.get("format", "generic"),
                 *[i.get(f, "") for f in V.SEARCH_FIELDS], i.get("raw", i.get("msg", "")))
                for n, i in enumerate(items)]
        schema = "owner string, dataset string, file string, line_no long, format string, " + ", ".join(
            f"{f} string" for f in V.SEARCH_FIELDS) + ", value string"
        return enrich(spark.createDataFrame(data, schema))
    return make
