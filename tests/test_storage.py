import subprocess
import sys
from types import SimpleNamespace

import pytest

from pointlake import storage


def session(master, configured=None):
    conf = SimpleNamespace(get=lambda name, default=None: configured)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app {master}", getConf=lambda: conf))


def test_no_local_folder_on_a_cluster(tmp_path):
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(session(master))
        assert storage.shared_dir(session(master, "hdfs://host/shared/")) == "hdfs://host/shared"
    one = storage.shared_dir(session("local[2]"))
    assert one == storage.shared_dir(session("local[2]"))


def test_a_name_taken_after_the_look_is_not_replaced(spark, tmp_path, monkeypatch):
    class Late:
        """A file system on which every writer looks before any other has put its file in place."""

        def __init__(self, files):
            self.files = files

        def exists(self, at):
            return False

        def __getattr__(self, name):
            return getattr(self.files, name)

    real = storage._file_system
    monkeypatch.setattr(storage, "_file_system", lambda s, p: (Late(real(s, p)[0]), real(s, p)[1]))
    folder = tmp_path / "with space %41"
    for path in (str(folder), f"file:{tmp_path}/b"):
        assert storage.write_once(spark, path, "00000000", "first") and not storage.write_once(spark, path, "00000000", "second")
        assert storage.read_text(spark, f"{path}/00000000") == "first"
    assert [p.name for p in folder.iterdir()] == ["00000000"]


SCRIPT = """
import os, sys
from pyspark.sql import SparkSession
from pointlake import storage
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
path = storage.scratch(spark, "x")
spark.range(3).write.parquet(path)
assert storage.names(spark, path) and storage.names(spark, path + "-none") == []
print("kept", sum(n.startswith("pointlake") for n in os.listdir(sys.argv[1])))
"""


def test_what_is_kept_goes_with_the_application(tmp_path):
    got = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], capture_output=True, text=True, timeout=120, check=True)
    assert got.stdout.strip().splitlines()[-1] == "kept 1" and not list(tmp_path.glob("pointlake*"))
