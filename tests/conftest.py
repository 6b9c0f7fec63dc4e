from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from fieldweave.session import SETTINGS, ship

    more = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    s = SparkSession.builder.master("local[8]").config(map=SETTINGS | more).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


@pytest.fixture(autouse=True, scope="session")
def networks_once(spark):
    """Many queries are asked of one network: it is multiplied once a session and read from its table afterwards."""
    from fieldweave.operators import similarity
    from fieldweave.operators.lineage import settle

    plain, held = similarity.correlation_network, {}

    def once(field, *args, **how):
        key = (field.semanticHash(), repr(args), repr(sorted(how.items())))
        if key not in held:
            held[key] = settle(plain(field, *args, **how))
        return held[key]

    similarity.correlation_network = once
    yield
    similarity.correlation_network = plain
