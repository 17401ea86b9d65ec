"""Every registered query against its SQL at the smallest scale."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from edgewright.plans import catalog

SF = "/root/testdata/sf0.001"
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert [dict(df.dtypes)[c] for c in columns] == [TYPES[str(dict(zip(want.columns, want.types, strict=True))[c])] for c in columns]
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_points(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).columns == ["capture_id", "frame_no", "hex", "channel", "action", "valid", "direct_bits"]


def test_rest_stands_without_the_training_data_folders(tmp_path):
    """The entry points and the capture queries import where those folders are missing."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "edgewright", tmp_path / "edgewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'decoded_frames' in e.queries() and not any(n.startswith('op') for n in e.queries()); assert 'pipeline' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
