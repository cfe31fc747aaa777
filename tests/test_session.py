"""The session leaves the cluster's settings alone, and cleans up."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SETTINGS = """
from pyspark.sql import SparkSession
SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "4000").config("spark.ui.enabled", "false").getOrCreate()
from toxscan.session import get_spark
spark = get_spark()
print("PARTITIONS", spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.getConf().get("spark.driver.memory", "unset"))
"""


def test_submitted_settings_stand():
    env = {k: v for k, v in os.environ.items() if k != "TOXSCAN_DRIVER_MEMORY"} | {"PYTHONPATH": REPO}
    out = subprocess.run([sys.executable, "-c", SETTINGS], env=env, capture_output=True, text=True, timeout=300)
    assert "PARTITIONS 4000 unset" in out.stdout, out.stderr[-1000:]


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from toxscan.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

        class _jsc:
            @staticmethod
            def sc():
                class Scala:
                    @staticmethod
                    def isLocal():
                        return False

                return Scala

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


CLEAN = """
import os
from toxscan.session import bucket_by_doc, cleanup, get_spark, shared_dir, write_table
spark = get_spark("local[2]", shuffle_partitions=2, extra_conf={"spark.checkpoint.dir": os.environ["SHARED"]})
spark.sparkContext.setCheckpointDir(os.environ["SHARED"])
t = write_table(spark.range(10).withColumnRenamed("id", "doc_id"), "some")
bucket_by_doc(t, "more").count()
folder = shared_dir(spark).removeprefix("file:")
before = len(os.listdir(folder + "/toxscan"))
cleanup(spark)
print("LEFT", before, os.path.exists(folder + "/toxscan"), len(spark.catalog.listTables()))
"""


def test_cleanup_empties_the_shared_folder(tmp_path):
    out = subprocess.run([sys.executable, "-c", CLEAN], env=os.environ | {"PYTHONPATH": REPO, "SHARED": str(tmp_path)}, cwd=tmp_path,
                         capture_output=True, text=True, timeout=300)
    assert "LEFT 2 False 0" in out.stdout, out.stderr[-1000:]
