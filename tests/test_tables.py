"""Items, samples, comparisons, versions, sources and extension points."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, experiments, items, lineage, manifest, profile, sampling, versions
from plumbline.operators.fusion import UnsupportedDetector
from plumbline.operators.registry import Registry
from plumbline.sources import annotations, tables
from plumbline.sources.cache import AnalysisCache
from plumbline.sources.sinks import append_timeline, write_decisions


def item_table(spark):
    return spark.createDataFrame([(f"i{k}", f"{s or 'raw'}/{k}.jpg", s, ["car", "bus"] if k % 2 else ["bus"]) for k, s in
                                  enumerate(["train", "train", "test", None, "valid"])],
                                 "id string, path string, split string, classes array<string>")


def test_filter_by_class_index_and_name(spark):
    it = item_table(spark)
    assert items.filter_items(it, cls=0, names=["car", "bus"]).count() == 2
    assert items.filter_items(it, cls="bus").count() == 5
    p = items.page(items.filter_items(it, "train"), limit=1, offset=1).collect()
    assert [(r["path"], r["total"]) for r in p] == [("train/1.jpg", 2)]


def test_edits(spark):
    it, ids = item_table(spark), spark.createDataFrame([("i0",), ("i2",), ("nope",)], "id string")
    with pytest.raises(ValueError):
        items.relabel(it, ids, "plane", ["car", "bus"])
    got = {r["id"]: r["classes"] for r in items.relabel(it, ids, "0", ["car", "bus"]).collect()}
    assert got["i0"] == ["car"] and got["i1"] == ["car", "bus"]
    moved = {r["id"]: (r["split"], r["moved"]) for r in items.move(it, ids, "test").collect()}
    assert moved["i0"] == ("test", True) and moved["i2"] == ("test", False) and moved["i1"] == ("train", False)
    assert [r["id"] for r in items.unknown_ids(it, ids).collect()] == ["nope"]
    assert items.remove(it, ids).count() == 3


def test_splits_are_disjoint_and_whole(spark):
    got = sampling.split_ratio(spark.range(103), "id").toPandas()
    assert got["id"].is_unique and len(got) == 103
    sizes = got.groupby(["part", "split"]).size().to_dict()
    assert sizes == {("reference", "train"): 32, ("reference", "valid"): 9, ("current", "train"): 32, ("current", "valid"): 9,
                     ("target", "train"): 16, ("target", "valid"): 5}


def test_stratified_has_every_class(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 990, "big").when(F.col("id") < 999, "small"))
    got = {r["stratum"]: r["count"] for r in sampling.sample_stratified(df, F.col("c"), 50, "id").groupBy("stratum").count().collect()}
    assert got == {"big": 49, "small": 1, "unknown": 1}
    assert sampling.sample_random(df, 5000, "id").count() == 1000


def test_layouts(spark):
    layouts = {"roboflow": ["data.yaml", "train/images/a.jpg", "train/labels/a.txt"],
               "yolo": ["images/a.jpg", "labels/a.txt"], "voc": ["Annotations/a.xml", "JPEGImages/a.jpg"],
               "coco": ["images/a.jpg", "annotations/x.json"], "image_bundle": ["a.jpg", "__MACOSX/x.csv"],
               "tabular_bundle": ["a.csv", "b.txt", "c.png"], "text_bundle": ["a.md", "b.png"], "unknown": ["x.bin"],
               "yolo2": ["data.yaml", "train/images/a.jpg", "images/a.jpg", "labels/a.txt"]}
    df = spark.createDataFrame([(d, p) for d, ps in layouts.items() for p in ps], "dataset string, path string")
    got = {r["dataset"]: r["format"] for r in manifest.detect_format(df).collect()}
    assert got == {d: d.rstrip("2") for d in layouts}


def test_row_diff_is_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "z")], "id int, v string")
    got = {r["id"]: r["state"] for r in compare.row_diff(a, b, "id").collect()}
    assert got == {1: "same", 2: "changed", 3: "removed", 4: "added"}


def test_incremental(spark):
    a = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0), ("c", 1, 0.0), ("d", 1, 0.0)], "path string, size int, mtime double")
    b = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 0.0), ("c", 1, 1.5), ("e", 1, 0.0)], "path string, size int, mtime double")
    got = {r["path"]: r["state"] for r in compare.incremental_changes(a, b).collect()}
    assert got == {"a": "unchanged", "b": "modified", "c": "modified", "d": "removed", "e": "new"}
    assert {r["state"] for r in compare.incremental_changes(a.where("false"), b).collect()} == {"new"}


def test_views(spark):
    df, views = spark.range(10), spark.createDataFrame([("v", 3), ("v", 4)], "name string, id long")
    assert compare.apply_view(df, views, "v", "keep_only", "id").count() == 2
    assert compare.apply_view(df, views, "v", "remove", "id").count() == 8
    for op in ("keep_only", "remove"):
        assert compare.apply_view(df, views, "none", op, "id").count() == 10
    p = compare.preview_view(df, views, "v", "keep_only", "id", 3).collect()
    assert [tuple(r) for r in p] == [(0, 8, 2), (1, 8, 2), (2, 8, 2)]
    assert compare.preview_view(df, views, "none", "keep_only", "id").count() == 0
    with pytest.raises(ValueError):
        compare.apply_view(df, views, "v", "sort", "id")


def test_upsert(spark):
    schema = "base_id string, target_id string, overall double, created_at int"
    old, new = spark.createDataFrame([("a", "b", 0.1, 1)], schema), spark.createDataFrame([("a", "b", 0.9, 2), ("a", "c", 0.5, 2)], schema)
    assert {(r["target_id"], r["overall"]) for r in compare.upsert_results(old, new).collect()} == {("b", 0.9), ("c", 0.5)}
    assert {(r["target_id"], r["overall"]) for r in compare.upsert_results(old, new, force=False).collect()} == {("b", 0.1), ("c", 0.5)}


def test_lineage_counts_a_node_at_both_hops_twice(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b", "r"), ("a", "c", "r"), ("b", "c", "r"), ("c", "d", "r"), ("b", "d", "r")],
                                  "source string, target string, relationship string")
    got = {r["id"]: r for r in lineage.impact(nodes, edges).collect()}
    assert (got["a"]["direct_dependents"], got["a"]["indirect_dependents"], got["a"]["impact_count"]) == (2, 2, 4)
    assert got["d"]["indirect_dependencies"] == 2 and got["e"]["severity"] == "low" and got["a"]["severity"] == "medium"


def test_bfs_stops_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r")], "source string, target string, relationship string")
    reached = lineage.reach(edges, spark.createDataFrame([("a",)], "id string"), 9)
    assert {(r["id"], r["depth"]) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r["source"], r["target"]) for r in lineage.walked_edges(edges, reached).collect()} == {("a", "b"), ("b", "c")}


def test_fingerprint(spark):
    a, b = spark.range(100), spark.range(100).orderBy(F.desc("id")).repartition(3)
    one = versions.fingerprint(a, "t").first()["hash"]
    assert one == versions.fingerprint(b, "t").first()["hash"]
    assert one != versions.fingerprint(a.where("id > 0"), "t").first()["hash"]
    assert one != versions.fingerprint(a.unionByName(a.where("id = 1")), "t").first()["hash"]


def test_policies(spark):
    states = spark.createDataFrame([("a", "clean"), ("b", "modified")], "name string, state string")
    with pytest.raises(versions.VersionState):
        versions.check(states, "strict")
    assert {r["name"]: r["outcome"] for r in versions.check(states, "auto").collect()} == {"a": "ok", "b": "new version"}
    with pytest.raises(ValueError):
        versions.check(states, "none")


def test_next_version(spark):
    reg = spark.createDataFrame([("a", "v1.9"), ("a", "v1.10"), ("a", "v0.99"), ("a", "beta"), ("b", "beta")], "name string, version string")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert {r[0]: r[1] for r in versions.next_version(names, reg).collect()} == {"a": "v1.11", "b": "v0.1", "c": "v1.0"}


def test_compare_needs_two_runs(spark):
    long = spark.createDataFrame([("r1", "m", 1.0), ("r2", "m", 2.0)], "run_id string, metric string, value double")
    assert experiments.compare(long, ["r1", "r2", "zz"]).first().asDict() == {"metric": "m", "r1": 1.0, "r2": 2.0}
    with pytest.raises(ValueError):
        experiments.compare(long, ["r1", "zz"])


# ---- sources ---------------------------------------------------------------

def test_csv_union(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,idx\n"one\nmore",7\ntwo,8\n')
    (tmp_path / "b.csv").write_text("text,id\nthree,9\n")
    (tmp_path / "c.csv").write_text("other\nx\n")
    paths = [str(tmp_path / f"{n}.csv") for n in "abc"]
    got = {(r["text"], r["_source_file"], r["_id"]) for r in tables.read_csv_union(spark, paths, "text", multiline=True).collect()}
    assert got == {("one\nmore", "a.csv", "7"), ("two", "a.csv", "8"), ("three", "b.csv", "9")}
    (tmp_path / "d.csv").write_text("text\n" + "\n".join(f"row {i}" for i in range(500)) + "\n")
    rows = tables.read_csv_union(spark, [str(tmp_path / "d.csv")], "text", multiline=False).collect()
    assert {(r["text"], r["_id"]) for r in rows} == {(f"row {i}", f"d_{i}") for i in range(500)}
    with pytest.raises(ValueError):
        tables.read_csv_union(spark, [paths[2]], "text")


def test_row_numbers_across_pieces_of_a_file(spark, tmp_path):
    (tmp_path / "d.csv").write_text("text\n" + "\n".join(f"row {i}" for i in range(2000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = tables.read_csv_union(spark, [str(tmp_path / "d.csv")], "text", multiline=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["text"], r["_id"]) for r in rows} == {(f"row {i}", f"d_{i}") for i in range(2000)}


def test_specs(spark):
    ok = {"modality": "text", "text_column": "t", "id_column": "i"}
    assert tables.bind(spark.createDataFrame([(1, "x", 2)], "i int, t string, z int"), tables.parse_spec(ok, "text")).columns == ["i", "t"]
    for bad in ({"modality": "audio"}, {"modality": "text"}):
        with pytest.raises(tables.DatasetError):
            tables.parse_spec(bad, "text")
    with pytest.raises(tables.DatasetError):
        tables.bind(spark.range(1), tables.parse_spec(ok, "text"))


def test_uri(spark, tmp_path):
    spark.range(3).write.option("header", True).csv(str(tmp_path / "x.csv"))
    assert tables.read_uri(spark, f"file://{tmp_path}/x.csv").count() == 3
    for uri in ("ftp://h/x", "no-scheme"):
        with pytest.raises(tables.NoAdapter) as e:
            tables.read_uri(spark, uri)
        assert e.value.code == "no_adapter_for_scheme"


def test_label_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 .5 .5 .1 .2\n2.0 .1 .1 .1 .1\n\nbad line\n7\nnan 1 1 1 1\n")
    got = [(r["class_id"], r["w"]) for r in annotations.read_label_files(spark, str(tmp_path)).collect()]
    assert got == [(0, 0.1), (2, 0.1), (7, None)]


def test_voc(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<annotation><filename>a.jpg</filename><object><name> cat </name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax>"
        "<ymax>4</ymax></bndbox></object><object><name>dog</name></object></annotation>")
    assert sorted(r["class"] for r in annotations.read_voc_objects(spark, str(tmp_path)).collect()) == ["cat", "dog"]


def test_manifest_reads_no_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "sub/b.txt", "sub/._c.txt", ".DS_Store"):
        (tmp_path / name).write_text("xy")
    got = tables.file_manifest(spark, str(tmp_path))
    assert {(r["path"].rsplit("/", 1)[1], r["size"], r["extension"]) for r in got.collect()} == {("a.JPG", 2, "jpg"), ("b.txt", 2, "txt")}
    assert "content" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_cache(spark, tmp_path):
    cache = AnalysisCache(spark, str(tmp_path / "cache"))
    assert cache.load("h", "k") is None and cache.list().count() == 0
    cache.save(spark.range(4), "h", "k", "s1")
    cache.link("h", "k", "s2")
    assert cache.load("h", "k").count() == 4 and cache.copy("h", "h2", "s3") == 1
    assert {(r["data_hash"], r["snapshot_id"]) for r in cache.list().collect()} == {("h", "s1"), ("h", "s2"), ("h2", "s3")}
    assert {r[0] for r in cache.snapshots_of("h").collect()} == {"s1", "s2"}


def test_sinks(spark, tmp_path):
    line = spark.createDataFrame([("2024", 0.1, "NORMAL", 1, 2)], "timestamp string, overall_score double, status string, files_added int, files_removed int")
    for _ in range(2):
        append_timeline(line, str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 2
    write_decisions(spark.createDataFrame([("1", 'a "b"', "s")], "id string, scores_json string, site_id string"), str(tmp_path / "d"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "d/csv")).first()["scores_json"] == 'a "b"'


def test_registry(spark):
    reg = Registry()
    with pytest.raises(UnsupportedDetector):
        reg.check_detector("none")
    reg.check_detector("default")
    reg.register_transform("text.upper", F.lower)  # the first to claim a name keeps it
    assert spark.range(1).select(reg.transform("text.upper", F.lit("a")), reg.transform("x", F.lit("a"))).first()[:] == ("A", "a")
    with pytest.raises(tables.NoAdapter):
        reg.write("nowhere", spark.range(1), "x")


def test_describe_text_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("",)], "c string")
    assert tuple(profile.describe_text(df, ["c"]).first()) == ("c", 2, 2, "a", 1)


def test_csv_union_reads_once_per_header(spark, tmp_path, monkeypatch):
    for k in range(200):
        head = "text,lang" if k % 2 else "lang,text"
        row = f"t{k},en" if k % 2 else f"en,t{k}"
        (tmp_path / f"f{k}.csv").write_text(f"{head}\n{row}\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    reads = []
    real = type(spark.read).csv
    monkeypatch.setattr(type(spark.read), "csv", lambda self, path, *a, **k: reads.append(path) or real(self, path, *a, **k))
    got = tables.read_csv_union(spark, [str(p) for p in sorted(tmp_path.glob("*.csv"))], "text")
    rows = {r["_id"]: (r["text"], r["lang"], r["_source_file"]) for r in got.collect()}
    assert len(reads) == 2
    assert rows == {f"f{k}_0": (f"t{k}", "en", f"f{k}.csv") for k in range(200)}


def test_annotation_files_are_bounded(spark, tmp_path, monkeypatch):
    """XML is read by whole files, so a large table makes many of them."""
    from plumbline.queries import sources
    monkeypatch.setattr(sources, "VOC_OBJECTS", 10)
    spark.range(300).selectExpr("id AS p_partkey", "concat('a kind', id % 3, ' z') AS p_name", "cast(id AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    path = sources.write_voc(spark, str(tmp_path))
    found = annotations.read_voc_objects(spark, path).groupBy("file").count().collect()
    assert sum(r["count"] for r in found) == 300 and max(r["count"] for r in found) <= 10
