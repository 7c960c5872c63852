"""Where intermediate tables go if ``spark.checkpoint.dir`` is not set."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from glyphward.llm.tables import shared_dir

UNSET = """
import sys
from pyspark.sql import SparkSession
from glyphward.llm.tables import save, shared_dir
conf = {"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.driver.memory": "1g", "spark.sql.warehouse.dir": sys.argv[1]}
spark = SparkSession.builder.config(map=conf).getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert save(spark.range(3), "three").count() == 3  # the setting cannot be set in a session
assert shared_dir(spark) == shared_dir(spark)
spark.sparkContext.setCheckpointDir(sys.argv[2])
kept = save(spark.range(4), "four")
assert kept.count() == 4 and sys.argv[2] in kept.kept_at
"""


def test_save_without_the_setting(tmp_path):
    for name in ("conf", "tmp"):
        (tmp_path / name).mkdir()
    root = str(Path(__file__).resolve().parents[2])
    own = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env = own | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path / "tmp"), "PYTHONPATH": root}
    ran = subprocess.run([sys.executable, "-c", UNSET, str(tmp_path / "warehouse"), str(tmp_path / "set")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr[-2000:]


@pytest.mark.parametrize("master", ["local-cluster[3,2,3000]", "spark://host:7077", "yarn", "k8s://https://host"])
def test_a_cluster_without_the_setting_writes_to_the_warehouse(master):
    settings = {"spark.sql.warehouse.dir": "file:/shared/warehouse/"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: settings.get(key, *default)), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_dir(session) == "file:/shared/warehouse"
