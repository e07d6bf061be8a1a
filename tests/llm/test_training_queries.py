import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import assert_same, database

from glyphmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert_same(got, database(SF).sql(ORACLES[name]).df())
    elif name != "op9_license_scans":
        assert sorted(got["doc_id"]) == sorted(spark.read.parquet(f"{SF}/documents.parquet").toPandas()["doc_id"])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
