"""The entry module loads without a JVM, a session or Spark's jars; shipped code needs no package on the workers."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, cwd, **env):
    return subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=cwd, capture_output=True, text=True, timeout=300,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env)


def test_loads_without_jvm_or_jars(tmp_path):
    done = run(f"""
        import sys, glob, zipfile
        sys.path.insert(0, {REPO!r})
        import pyspark.core.context as c
        def refuse(*a, **k): raise AssertionError("no JVM at import")
        c.launch_gateway = c.SparkContext._ensure_initialized = zipfile.ZipFile = refuse
        glob.glob = lambda *a, **k: []
        import __spark_entry__ as e
        assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 181
        """, tmp_path)
    assert done.returncode == 0, done.stderr


def test_workers_need_no_package(tmp_path):
    """The driver alone can import the package: the workers start in another folder, without its path."""
    done = run(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import __spark_entry__ as e
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "4").config("spark.sql.warehouse.dir", {str(tmp_path)!r} + "/warehouse")
                 .config("spark.checkpoint.dir", {str(tmp_path)!r} + "/shared").config("spark.driver.memory", "1g").getOrCreate())
        def importable(batches):
            import importlib.util
            for b in batches:
                yield b.assign(id=int(importlib.util.find_spec("plumbline") is not None))
        assert [r.id for r in spark.range(1).mapInPandas(importable, "id bigint").collect()] == [0]
        assert e.queries()["ts_adf"](spark, "/root/testdata/sf0.001").count() > 0
        """, tmp_path, PYSPARK_PYTHON=sys.executable)
    assert done.returncode == 0, done.stderr[-3000:]
