import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
from quercus import schema as S  # noqa: E402
from quercus.sources.upper import builtin_upper  # noqa: E402
from quercus.workspace import Workspace  # noqa: E402
from tools.check_queries import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
UP = S.UPPER_PREFIX


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture()
def ws(spark):
    return Workspace(spark)


@pytest.fixture(scope="session")
def upper():
    return builtin_upper()


def kind(x):
    return "bnode" if x.startswith("_:") else "iri" if x.startswith(("http", "urn:")) else "literal"


@pytest.fixture(scope="session")
def graph(spark):
    """(artifact -> [(s, p, o)]) as a triples table."""

    def build(artifacts):
        rows = [
            (a, s, kind(s), p, o, kind(o), S.XSD + "string" if kind(o) == "literal" else None, None)
            for a, triples in artifacts.items()
            for s, p, o in triples
        ]
        return spark.createDataFrame(rows, S.TRIPLES)

    return build
