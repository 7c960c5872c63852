"""The engine's shared folder if ``spark.checkpoint.dir`` is not set."""

from types import SimpleNamespace

import pytest

from glyphward.sources.files import shared_dir


def session(master, checkpoints=None):
    """A session without the setting; as in Spark, it cannot be set there."""
    settings = {"spark.sql.warehouse.dir": "file:/shared/warehouse"}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: settings.get(key, *default)), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints))


@pytest.mark.parametrize("master", ["local-cluster[3,2,3000]", "spark://host:7077", "yarn"])
def test_cluster_without_the_setting(master):
    assert shared_dir(session(master)) == "file:/shared/warehouse"
    assert shared_dir(session(master, "file:/shared/set")) == "file:/shared/set"


def test_one_machine_without_the_setting(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    assert shared_dir(session("local[2]")) == shared_dir(session("local"))
