"""The format of Arrow files: partitions, filters, commits, failing tasks, streams."""

import datetime as dt
import os
import subprocess
import sys
import textwrap
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThanOrEqual, Not

from plumbline.operators.registry import Registry
from plumbline.sources import arrow_files as A
from plumbline.streaming import jobs

SCHEMA = ("id bigint, name string, amount decimal(10,2), score double, day date, at timestamp, local timestamp_ntz, flag boolean, "
          "tags array<string>, raw binary")


@pytest.fixture(scope="module")
def rows(spark):
    A.register(spark)
    t = dt.datetime(2024, 1, 1, 3, 4, 5, 678901)
    odd = [(None,) * 10, (7, "é", Decimal("1.50"), float("nan"), t.date(), t, t, True, ["a", None], b"\0x"), (8, "", Decimal("-3.25"), -0.0, None, None, t, False, [], b"")]
    many = [(i, f"n{i % 7}", Decimal(i) / 4, i / 3, dt.date(2024, 1, 1 + i % 28), t + dt.timedelta(hours=i), None, i % 2 == 0, None, None) for i in range(3000)]
    return spark.createDataFrame(odd + many, SCHEMA)


def load(spark, path, **options):
    return spark.read.format(A.NAME).options(**options).load(str(path))


def same(a, b):
    return a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_round_trip_in_many_partitions(spark, rows, tmp_path):
    rows.repartition(3).write.format(A.NAME).mode("append").save(str(tmp_path))
    assert same(load(spark, tmp_path), rows)
    files = A.live(str(tmp_path))[0]["files"]
    assert len(files) == 3 and sum(f["rows"] for f in files) == 3003
    one = spark.range(300_000).coalesce(1)
    one.write.format(A.NAME).mode("append").save(str(tmp_path / "one"))
    assert load(spark, tmp_path / "one", partition_bytes=1).rdd.getNumPartitions() == 30   # one for each batch that arrived
    assert load(spark, tmp_path / "one", partition_bytes=1).agg(F.sum("id")).first()[0] == 299_999 * 150_000


def test_appends_replacements_and_columns(spark, rows, tmp_path):
    path = str(tmp_path)
    for part in (rows.where("id < 10"), rows.where("id >= 10")):
        part.write.format(A.NAME).mode("append").save(path)
    assert load(spark, path).count() == 3002
    rows.where("id = 5").write.format(A.NAME).mode("overwrite").save(path)
    rows.where("id IS NULL").write.format(A.NAME).mode("append").save(path)
    assert same(load(spark, path), rows.where("id = 5 OR id IS NULL"))
    assert same(load(spark, path, columns="name, id"), rows.where("id = 5 OR id IS NULL").select("name", "id"))
    assert A.commits(path) == [1, 2, 3, 4]
    # a file without a commit is not read
    A.store(path, pa.schema([("id", pa.int64())]), iter([pa.RecordBatch.from_arrays([pa.array([1])], ["id"])]))
    assert load(spark, path).count() == 2


def test_empty_tables(spark, rows, tmp_path):
    rows.where("false").write.format(A.NAME).mode("append").save(str(tmp_path))
    assert same(load(spark, tmp_path), rows.where("false"))
    with pytest.raises(Exception, match="no table of Arrow files"):
        load(spark, tmp_path / "nowhere")


CONDITIONS = ["name = 'n3' AND id > 2000", "id IN (5, 6, 9000)", "id NOT IN (5, 6)", "name IS NULL", "name IS NOT NULL AND day <= DATE '2024-01-03'",
              "score > 900", "NOT (name = 'n1')", "flag", "NOT flag", "amount >= 700.25", "at < TIMESTAMP '2024-01-02 00:00:00'", "local IS NOT NULL",
              "local = TIMESTAMP_NTZ '2024-01-01 03:04:05.678901'", "id = 5 OR name = 'n2'", "id % 5 = 1 AND id < 40", "raw = X'0078'", "isnan(score)",
              "id <=> NULL", "size(tags) = 2", "name > 'n5'", "id = -1", "at IS NULL", "day > DATE '2024-01-27' AND NOT (id IN (27, 28))"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters(spark, rows, filtered, condition):
    assert same(A.scan(spark, filtered, condition), rows.where(condition))


@pytest.fixture(scope="module")
def filtered(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("filtered"))
    rows.repartitionByRange(6, "id").write.format(A.NAME).mode("append").save(path)
    return path


def test_filters_are_pushed_and_files_left_out(spark, rows, filtered, capsys):
    A.scan(spark, filtered, "id > 2500 AND name = 'n3' AND id % 2 = 0").explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThan(id,2500)" in pushed and "EqualTo(name,n3)" in pushed
    reader = A.PushedReader(filtered, pa.schema([("id", pa.int64())]), 1 << 30)
    whole = len(reader.partitions())
    assert list(reader.pushFilters([GreaterThan(("id",), 2500)])) == []
    assert 0 < len(reader.partitions()) < whole


def test_a_loaded_table_may_be_used_again(spark, rows, filtered):
    df = load(spark, filtered)
    assert df.where("name = 'n3'").count() == rows.where("name = 'n3'").count()
    assert df.where("name = 'n4'").count() == rows.where("name = 'n4'").count()
    assert same(df.where("name = 'n1'").unionByName(df.where("id < 9")), rows.where("name = 'n1'").unionByName(rows.where("id < 9")))
    assert df.count() == 3003


def test_what_a_file_may_hold():
    file = {"rows": 4, "columns": {"x": {"min": 3, "max": 9, "nulls": 1}, "y": {"min": None, "max": None, "nulls": 4}, "z": {"min": None, "max": None, "nulls": 0}}}
    x, y, z = ("x",), ("y",), ("z",)
    held = [EqualTo(x, 3), GreaterThan(x, 8), LessThanOrEqual(x, 3), In(x, [1, 9]), IsNull(x), IsNotNull(x), IsNull(y), EqualTo(z, 1), Not(EqualTo(x, 1)), EqualTo(x, "a")]
    not_held = [EqualTo(x, 2), GreaterThan(x, 9), LessThanOrEqual(x, 2), In(x, [1, None]), IsNotNull(y), EqualTo(y, 1), IsNull(z)]
    assert [A.may_hold(f, file) for f in held] == [True] * len(held)
    assert [A.may_hold(f, file) for f in not_held] == [False] * len(not_held)


def test_registry(spark, rows, tmp_path):
    reg = Registry()
    reg.register_format(spark, A.ArrowFiles)
    reg.write(A.NAME, rows, str(tmp_path))
    assert same(reg.read(spark, f"{A.NAME}://{tmp_path}"), rows)


def test_two_writers_and_repeated_batches(tmp_path):
    path, schema = str(tmp_path), pa.schema([("id", pa.int64())])
    assert [A.add_commit(path, schema, [], writer="s", batch=b) for b in (0, 1, 1, 0, 2)] == [1, 2, 0, 0, 3]
    assert A.add_commit(path, schema, [], writer="t", batch=0) == 4


def test_failed_batches_leave_no_file(tmp_path):
    schema = pa.schema([("id", pa.int64())])

    def breaks():
        yield pa.RecordBatch.from_arrays([pa.array([1, 2])], schema=schema)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        A.store(str(tmp_path), schema, breaks())
    assert [f for f in os.listdir(tmp_path) if f.endswith(".arrow")] == []


def test_a_task_that_fails_once(tmp_path):
    """Its first attempt has written a batch when it ends; the rows are there once, and an aborted job leaves nothing."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import os, sys
        sys.path.insert(0, {repo!r})
        import pyarrow as pa
        from pyspark.sql import SparkSession
        from plumbline.sources import arrow_files as A
        spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g")
                 .config("spark.sql.execution.arrow.maxRecordsPerBatch", "100").getOrCreate())
        A.register(spark)
        path, mark = {str(tmp_path / "t")!r}, {str(tmp_path / "mark")!r}
        def fail(batches, always):
            for i, b in enumerate(batches):
                yield b
                if i == 1 and (always or not os.path.exists(mark)):
                    open(mark, "w").close()
                    os._exit(1) if not always else 1 / 0
        spark.range(0, 1000, 1, 2).mapInArrow(lambda b: fail(b, False), "id bigint").write.format(A.NAME).mode("append").save(path)
        assert os.path.exists(mark)
        rows = sorted(r.id for r in spark.read.format(A.NAME).load(path).collect())
        assert rows == list(range(1000)), len(rows)
        try:
            spark.range(0, 1000, 1, 2).mapInArrow(lambda b: fail(b, True), "id bigint").write.format(A.NAME).mode("append").save(path)
            raise SystemExit("the job did not fail")
        except Exception as e:
            assert "ZeroDivision" in str(e) or "abort" in str(e).lower(), e
        assert A.commits(path) == [1] and spark.read.format(A.NAME).load(path).count() == 1000
        """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=200,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable})
    assert done.returncode == 0, done.stderr[-3000:]


def test_streams(spark, rows, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    parts = [rows.where(f"id % 3 = {k}") for k in range(3)]

    def run(where, at):
        stream = spark.readStream.format(A.NAME).load(source).where("flag")
        jobs.run_available(stream.writeStream.format(A.NAME).outputMode("append").option("path", where).option("writer", "w"), at)

    for part in parts[:2]:
        part.write.format(A.NAME).mode("append").save(source)
    run(sink, checkpoint)
    run(sink, checkpoint)   # nothing new
    parts[2].write.format(A.NAME).mode("append").save(source)
    run(sink, checkpoint)
    assert same(load(spark, sink), rows.where("flag"))
    # the same batches of the same writer again, by a stream that has lost its checkpoint: nothing doubles
    before = load(spark, sink).count()
    run(sink, str(tmp_path / "other"))
    assert load(spark, sink).count() == before
    with pytest.raises(Exception, match="writer"):
        stream = spark.readStream.format(A.NAME).load(source)
        jobs.run_available(stream.writeStream.format(A.NAME).option("path", sink), str(tmp_path / "third"))
