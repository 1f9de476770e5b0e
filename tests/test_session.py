"""The shared folder and what is written to it, without a checkpoint folder being set."""

import os
import subprocess
import sys

from origintrace import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cut_and_drop(spark):
    with session.dropped_afterwards(spark):
        path = session.scratch_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert session.cut(spark.range(5), "five").count() == 5
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))
    assert session.cut(spark.range(5), "stays").count() == 5


def test_without_any_settings(tmp_path):
    """A fresh process with an empty settings folder: the folder is its own, and the same for the whole session."""
    code = "from origintrace.session import *; s = local_session(1, 1, '1g'); assert shared_folder(s) == shared_folder(s); assert cut(s.range(4), 'x').count() == 4"
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
