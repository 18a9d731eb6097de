"""What a session needs on a cluster."""

import os
import subprocess
import sys

import pytest

from pursuit import staging

ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pursuit.session import build_session
spark = build_session("elsewhere", "local-cluster[1,1,1024]", spark__ui__enabled="false", spark__executor__memory="1g", spark__sql__shuffle__partitions="1")
from pyspark.sql import functions as F
from pursuit.operators import stretches
from pursuit import schema as S
rows = spark.range(5).selectExpr(*["cast(1 as {{}}) as {{}}".format(f.dataType.simpleString(), f.name) if f.name not in ("frame_id", "play_direction")
                                   else ("id + 1 as frame_id" if f.name == "frame_id" else "'left' as play_direction") for f in S.INPUT_SCHEMA.fields])
print("stretches", stretches.stretches(rows).agg(F.sum("n")).first()[0])
"""


def test_executors_get_the_package_from_any_folder(tmp_path):
    """Executors of their own processes, started where the package is not on the path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=root)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "stretches 5" in done.stdout, done.stderr[-2000:]


class Session:
    """As much of a session as ``shared_dir`` looks at."""

    def __init__(self, master, **conf):
        self.sparkContext, self._conf = self, {k.replace("__", "."): v for k, v in conf.items()}
        self.master, self.conf = master, self

    def get(self, key, default=None):
        return self._conf.get(key, default)

    def getCheckpointDir(self):
        return None


def test_a_warehouse_on_one_machine_is_refused_on_a_cluster():
    for warehouse in ("file:/root/spark-warehouse", "/root/spark-warehouse"):
        with pytest.raises(RuntimeError, match="on one machine"):
            staging.shared_dir(Session("spark://host:7077", spark__sql__warehouse__dir=warehouse))
        assert staging.shared_dir(Session("local[4]", spark__sql__warehouse__dir=warehouse)) == f"{warehouse}/_staging"
    assert staging.shared_dir(Session("yarn", spark__sql__warehouse__dir="hdfs://n/w")) == "hdfs://n/w/_staging"
    assert staging.shared_dir(Session("yarn", spark__checkpoint__dir="hdfs://n/c/", spark__sql__warehouse__dir="file:/w")) == "hdfs://n/c"
    with pytest.raises(RuntimeError, match="set spark.checkpoint.dir"):
        staging.shared_dir(Session("yarn"))
