import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from edgewright import storage

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.fixture()
def shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "base_dir", lambda spark: f"file://{tmp_path}")
    yield tmp_path
    storage.release(spark)


def test_tables_of_a_session_lie_in_one_folder_and_go(spark, shared):
    a, b = storage.cut(spark.range(5), "a"), storage.cut(spark.range(7), "b")
    (folder,) = shared.iterdir()
    assert folder.name.startswith(storage.SESSION) and (a.count(), b.count()) == (5, 7)
    storage.drop_table(a)
    assert len([p for p in folder.iterdir() if p.is_dir()]) == 1 and b.count() == 7
    storage.release(spark)
    storage.release(spark)
    assert not list(shared.iterdir())
    assert storage.cut(spark.range(2), "again").count() == 2


def test_stale_sessions_go(spark, shared):
    for name, age in (("ew-session-old", 8), ("ew-session-new", 6)):
        (shared / name).mkdir()
        (shared / name / storage.LEASE).write_text("")
        os.utime(shared / name / storage.LEASE, (time.time() - age * 86_400,) * 2)
    (shared / "ew-session-other").mkdir()
    (shared / "kept").mkdir()
    storage.cut(spark.range(5), "a")
    assert {"ew-session-new", "ew-session-other", "kept"} < {p.name for p in shared.iterdir()} and not (shared / "ew-session-old").exists()
    assert storage.sweep(spark, 5) == 1


def test_nothing_is_left_when_a_session_ends(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from edgewright import storage
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
assert storage.cut(s.range(9), "t").count() == 9
import glob; assert len(glob.glob({str(tmp_path)!r} + "/ew-session-*")) == 1
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    for _ in range(50):  # the JVM ends a moment after its Python
        if not list(tmp_path.glob("ew-*")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.glob("ew-*"))  # Spark's own checkpoint folder is not ours


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Some

    session = lambda master, base: Some(conf=Some(get=lambda *_: base), sparkContext=Some(master=master))
    assert storage.base_dir(session("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    assert storage.base_dir(session("local[2]", None)) == f"file://{storage.LOCAL_FALLBACK}"
    with pytest.raises(ValueError):
        storage.base_dir(session("spark://x", None))
