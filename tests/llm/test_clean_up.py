"""What queries leave in the shared folder: what their result reads, and with a scope nothing."""

import os

import pytest

from gistmill.llm import catalogue
from gistmill.plans import tables

SF = "/root/testdata/sf0.001"
LEFT = {
    "pipeline": ["secrets"], "op1_simhash": ["components", "fingerprints"], "op3_sharding": ["places"], "op4_tiff": ["media"], "op5_warc": ["records"], "op8_perspectives": ["ranges"],
}


def left(spark) -> list[str]:
    return sorted(os.listdir(tables.root(spark).removeprefix("file://")))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_nothing_else_is_left(spark, name):
    before = set(left(spark))
    with tables.scope(spark):
        assert catalogue.queries()[name](spark, SF).count() > 0
        assert sorted(x.rpartition("-")[0] for x in set(left(spark)) - before) == LEFT.get(name, [])
    assert set(left(spark)) == before


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master})

    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(Session(master))
    assert tables.shared_dir(Session("local[4]")).startswith("file://")
