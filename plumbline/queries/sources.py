"""Sources and sinks, read back from files Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from ..operators import manifest, profile
from ..plans.frames import r, spread
from ..plans.scratch import scratch_path
from ..sources import annotations, arrow_files, tables
from ..sources.cache import AnalysisCache
from ..streaming import jobs


@query("src_csv", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_csv(spark, sf):
    path = scratch_path(spark, "nation")
    table(spark, sf, "nation").write.option("header", True).csv(path)
    return tables.read_csv(spark, path)


@query("src_csv_union", """SELECT doc_id::VARCHAR AS _id, md5(text) AS digest, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM documents
UNION ALL SELECT 'nation_' || (row_number() OVER (ORDER BY n_nationkey) - 1), md5(n_name), 'bare' FROM nation""")
def src_csv_union(spark, sf):
    path = scratch_path(spark, "documents")
    d = table(spark, sf, "documents")

    def write(df, name):
        df.write.option("header", True).option("escape", '"').option("lineSep", "\n").csv(f"{path}/{name}")

    write(d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("index"), "text", "lang"), "even")
    write(d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), "text"), "odd")
    write(d.select("doc_id", "lang"), "no_text")
    both = tables.read_csv_union(spark, [f"{path}/even", f"{path}/odd", f"{path}/no_text"], "text", multiline=True)
    kind = F.when(F.col("_id").cast("bigint") % 2 == 0, "even").otherwise("odd")
    rows = both.select("_id", F.md5("text").alias("digest"), kind.alias("kind"))
    # one named file without an id column: <stem>_<row>
    table(spark, sf, "nation").coalesce(1).orderBy("n_nationkey").select(F.col("n_name").alias("text")).write.option("header", True).csv(f"{path}/named")
    tables.rename_single_file(spark, f"{path}/named", f"{path}/nation.csv")
    bare = tables.read_csv_union(spark, [f"{path}/nation.csv"], "text")
    return rows.unionByName(bare.select("_id", F.md5("text").alias("digest"), F.lit("bare").alias("kind")))


@query("src_text_lines", """WITH l AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no,
 unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, line_no, md5(line) AS digest, (SELECT count(*) FROM l) AS n_lines FROM l ORDER BY doc_id, line_no LIMIT 20""")
def src_text_lines(spark, sf):
    from ..plans.frames import with_scalars
    lines = tables.text_lines(table(spark, sf, "documents"), "text", "doc_id")
    first = lines.orderBy("doc_id", "line_no").limit(20).select("doc_id", "line_no", F.md5("line").alias("digest"))
    return with_scalars(first, lines.agg(F.count("*").alias("n_lines")))


@query("src_json_doc", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'text' ELSE 'json' END AS kind,
 CASE WHEN event_id % 4 <> 0 THEN CAST(props->>'$.k' AS INTEGER) END AS k FROM events""")
def src_json_doc(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("note: "), "props")).otherwise(F.col("props")).alias("props"))
    return tables.json_or_text(e, "props").select(
        "event_id", "kind", F.try_variant_get("parsed", "$.k", "int").alias("k"))


@query("src_declared", "SELECT event_id, ts, value, event_type FROM events")
def src_declared(spark, sf):
    spec = tables.parse_spec({
        "modality": "timeseries", "csv_file": "events.parquet", "timestamp_column": "ts", "id_column": "event_id",
        "numeric_columns": ["value"], "categorical_columns": ["event_type"]}, "timeseries")
    return tables.bind(table(spark, sf, "events"), spec)


@query("src_manifest", """WITH h AS (SELECT n_regionkey AS k FROM nation GROUP BY 1)
SELECT 'part_' || k || '.json' AS name, 'json' AS extension, CAST(length('{"k":' || k || '}') + 1 AS BIGINT) AS size FROM h""")
def src_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    keys = table(spark, sf, "nation").select(F.col("n_regionkey").cast("bigint").alias("k"), F.col("n_regionkey").alias("part")).distinct()
    keys.repartition(1, "part").write.partitionBy("part").json(path)
    files = tables.file_manifest(spark, path)
    name = F.concat(F.lit("part_"), F.regexp_extract("path", r"part=(\d+)/", 1), F.lit(".json"))
    return files.select(name.alias("name"), "extension", "size")


# label lines made from the parts; two kinds of bad lines
LINE_SQL = """CASE WHEN p_partkey % 13 = 0 THEN 'x 0.1 0.2 0.3 0.4' WHEN p_partkey % 13 = 1 THEN ''
 ELSE concat(p_size % 7, CASE WHEN p_partkey % 2 = 0 THEN '.7' ELSE '' END, '  0.5 0.25 ', (p_partkey % 9 + 1) / 10e0, ' 0.125') END"""
CLASS_NAMES = ["small", "red", "blue", "ring", "widget"]
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(CLASS_NAMES))
LABELS = f"""lab AS (SELECT p_partkey AS item, p_size % 7 AS class_id, (p_partkey % 9 + 1) / 10e0 AS w FROM part WHERE p_partkey % 13 > 1),
nm AS (SELECT * FROM (VALUES {_NAMES}) t(class_id, name)),
yolo AS (SELECT item, class_id, 0.5::DOUBLE AS cx, 0.25::DOUBLE AS cy, w, 0.125::DOUBLE AS h, coalesce(name, 'class_' || class_id) AS class FROM lab LEFT JOIN nm USING (class_id))"""


def label_names(spark):
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_id int, name string")


def yolo_labels(spark, sf):
    lines = table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.expr(LINE_SQL).alias("line"))
    return annotations.name_classes(annotations.parse_label_lines(lines), label_names(spark))


@query("src_yolo_labels", f"WITH {LABELS} SELECT item, class_id, cx, cy, w, h, class FROM yolo")
def src_yolo_labels(spark, sf):
    return yolo_labels(spark, sf).select("item", "class_id", "cx", "cy", "w", "h", "class")


#: Objects of an annotation file, some 230 bytes each: XML is read by whole files.
VOC_OBJECTS = 50_000


def write_voc(spark, sf):
    """Annotation XML with one object per part, the class from its name, in files of a bounded size."""
    path = scratch_path(spark, "voc")
    p = spread(table(spark, sf, "part"), "p_partkey")
    box = F.struct(*[(F.col("p_size") * k).cast("double").alias(c) for k, c in enumerate(("xmin", "ymin", "xmax", "ymax"), 1)])
    objects = p.select(F.array(F.struct(F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" ")).alias("name"),
                                        box.alias("bndbox"))).alias("object"))
    objects.write.format("xml").option("rootTag", "annotations").option("rowTag", "annotation").option("maxRecordsPerFile", VOC_OBJECTS).save(path)
    return path


@query("src_voc_objects", """SELECT split_part(p_name, ' ', 2) AS class, count(*) AS n, CAST(sum(p_size) AS DOUBLE) AS width FROM part GROUP BY 1""")
def src_voc_objects(spark, sf):
    o = annotations.read_voc_objects(spark, write_voc(spark, sf))
    return o.groupBy("class").agg(F.count("*").alias("n"), F.sum((F.col("xmax") - F.col("xmin")) / 2).alias("width"))


def coco_documents(spark, sf):
    """One document per part with one to three annotations; category 9 has no name."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    notes = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 3), lambda i: F.struct(
        (k * 10 + i).alias("id"), k.alias("image_id"), F.when((k + i) % 5 == 4, 9).otherwise((k + i) % 5).alias("category_id")))
    # the five regions are the categories of every document
    categories = table(spark, sf, "region").agg(F.collect_list(F.struct(
        F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))).alias("c")).scalar()
    return p.select(F.concat(F.lit("part"), k.cast("string")).alias("document"),
                    F.to_json(F.struct(categories.alias("categories"), notes.alias("annotations"))).alias("content"))


COCO = """co0 AS (SELECT p_partkey AS k, unnest(range(p_partkey % 3 + 1)) AS i FROM part),
co1 AS (SELECT k, i, CASE WHEN (k + i) % 5 = 4 THEN 9 ELSE (k + i) % 5 END AS category_id FROM co0),
coco AS (SELECT 'part' || k AS document, k * 10 + i AS annotation_id, k AS image_id, category_id, r_name FROM co1 LEFT JOIN region ON r_regionkey = category_id)"""


@query("src_coco_annotations", f"""WITH {COCO} SELECT document, annotation_id, image_id, coalesce(r_name, 'unknown') AS class,
 coalesce(r_name, category_id::VARCHAR) AS class_or_id FROM coco""")
def src_coco_annotations(spark, sf):
    docs = coco_documents(spark, sf)
    a = annotations.coco_annotations(docs)
    b = annotations.coco_annotations(docs, unknown="id").select("annotation_id", F.col("class").alias("class_or_id"))
    return a.join(b, "annotation_id").select("document", "annotation_id", "image_id", "class", "class_or_id")


@query("annotation_summary", f"""WITH {LABELS}, {COCO}, al AS (SELECT 'yolo' AS format, class FROM yolo
 UNION ALL SELECT 'coco', coalesce(r_name, 'unknown') FROM coco UNION ALL SELECT 'voc', split_part(p_name, ' ', 2) FROM part)
SELECT *, CAST(sum(n) OVER (PARTITION BY format) AS BIGINT) AS total FROM (SELECT format, class, count(*) AS n FROM al GROUP BY ALL)""")
def annotation_summary(spark, sf):
    parts = [yolo_labels(spark, sf).select(F.lit("yolo").alias("format"), "class"),
             annotations.coco_annotations(coco_documents(spark, sf)).select(F.lit("coco").alias("format"), "class"),
             annotations.read_voc_objects(spark, write_voc(spark, sf)).select(F.lit("voc").alias("format"), "class")]
    return profile.annotation_summary(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("src_uri", """SELECT 'supplier' AS name, count(*) AS n_rows, round(sum(s_acctbal), 2) AS total FROM supplier
UNION ALL SELECT 'ftp', NULL, NULL""")
def src_uri(spark, sf):
    s = tables.read_uri(spark, f"file://{sf}/supplier.parquet")
    ok = s.agg(F.lit("supplier").alias("name"), F.count("*").alias("n_rows"), r(F.sum("s_acctbal"), 2).alias("total"))
    try:
        tables.read_uri(spark, "ftp://host/supplier.parquet")
        raise AssertionError("an unknown scheme was accepted")
    except tables.NoAdapter:
        refused = spark.range(1).select(F.lit("ftp").alias("name"), F.lit(None).cast("bigint").alias("n_rows"),
                                        F.lit(None).cast("double").alias("total"))
    return ok.unionByName(refused)


@query("cache_analysis", """WITH n AS (SELECT 'customer' AS name, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)
SELECT name, kind, 'shape' AS cache_type, name || '@' || k AS snapshot_id, n_rows FROM n
CROSS JOIN (VALUES ('original', 1), ('original', 2), ('copy', 3)) t(kind, k)""")
def cache_analysis(spark, sf):
    from ..operators import versions
    cache = AnalysisCache(spark, scratch_path(spark, "cache"))
    loaded = []
    for name in ("customer", "orders"):
        df = table(spark, sf, name)
        digest = versions.fingerprint(df, name).first()["hash"]
        if cache.load(digest, "shape") is None:
            cache.save(df.agg(F.count("*").alias("n_rows")), digest, "shape", f"{name}@1")
        cache.link(digest, "shape", f"{name}@2")
        cache.copy(digest, f"copy-{name}", f"{name}@3")
        loaded += [(name, "original", digest), (name, "copy", f"copy-{name}")]
    out = None
    for name, kind, digest in loaded:
        one = cache.list().where(F.col("data_hash") == digest).select(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), "cache_type", "snapshot_id",
            cache.load(digest, "shape").scalar().alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("register_source", """SELECT 'customer' AS name, count(*) AS n_rows FROM customer UNION ALL SELECT 'part', count(*) FROM part
UNION ALL SELECT 'nation.parquet', count(*) FROM nation""")
def register_source(spark, sf):
    from ..operators import registry
    reg = registry.Registry()
    reg.register_source("rows", lambda spark, uri, **o: table(spark, sf, uri.split("://")[1]))
    out = None
    for uri in ("rows://customer", "rows://part", f"file://{sf}/nation.parquet"):
        one = reg.read(spark, uri).agg(F.lit(uri.rsplit("/", 1)[-1]).alias("name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


@query("register_sink", f"""WITH k AS (SELECT split_part(url, '/', 1) AS folder, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY 1)
SELECT sink, k.* FROM k, (SELECT unnest(['files', 'lines']) AS sink)""")
def register_sink(spark, sf):
    from ..operators import registry
    reg = registry.Registry()
    path = scratch_path(spark, "sink")
    reg.register_sink("files", lambda df, target: df.write.mode("append").parquet(target))
    reg.register_sink("lines", lambda df, target: df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(target))
    sizes = table(spark, sf, "pages").groupBy(F.split_part("url", F.lit("/"), F.lit(1)).alias("folder")).agg(
        F.count("*").alias("n"), F.sum(F.length("html").cast("bigint")).alias("size"))
    reg.write("files", sizes, f"{path}/files")
    reg.write("lines", sizes, f"{path}/lines")
    a = spark.read.parquet(f"{path}/files").withColumn("sink", F.lit("files"))
    b = spark.read.schema("folder string, n bigint, size bigint").json(f"{path}/lines").withColumn("sink", F.lit("lines"))
    return a.unionByName(b)


@query("register_source_format", """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem
 WHERE l_returnflag = 'R' AND l_linenumber IN (1, 3) AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_orderkey % 7 < 3 AND l_quantity > 10""")
def register_source_format(spark, sf):
    """Rows of a format that Spark has no reader for, read in many tasks with what can be filtered there filtered there."""
    path = scratch_path(spark, "arrow")
    arrow_files.register(spark)
    li = table(spark, sf, "lineitem")
    li.write.format(arrow_files.NAME).mode("append").save(path)
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
    return arrow_files.scan(spark, path, """l_returnflag = 'R' AND l_linenumber IN (1, 3) AND l_shipdate >= TIMESTAMP_NTZ '1995-01-01'
        AND l_orderkey % 7 < 3 AND l_quantity > 10""", columns)


@query("register_sink_format", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
 WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0""")
def register_sink_format(spark, sf):
    """Commits that add and one that replaces, through names of a registry."""
    from ..operators import registry
    reg = registry.Registry()
    reg.register_format(spark, arrow_files.ArrowFiles)
    path = scratch_path(spark, "arrow")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    reg.write(arrow_files.NAME, rows.where("o_orderkey % 3 = 0"), path)
    rows.where("o_orderstatus = 'O'").write.format(arrow_files.NAME).mode("overwrite").save(path)
    reg.write(arrow_files.NAME, rows.where("o_orderstatus = 'F'"), path)
    reg.write(arrow_files.NAME, rows.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0"), path)
    return reg.read(spark, f"{arrow_files.NAME}://{path}")


@query("stream_source_format", """SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'none'""")
def stream_source_format(spark, sf):
    """Rows that arrive in commits, streamed commit by commit into another table; a restart goes on where it stopped."""
    arrow_files.register(spark)
    path = scratch_path(spark, "arrow")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    for step in range(3):
        events.where(F.col("event_id") % 3 == step).write.format(arrow_files.NAME).mode("append").save(f"{path}/in")
        if step != 1:   # two commits lie there at the second start
            stream = spark.readStream.format(arrow_files.NAME).load(f"{path}/in")
            jobs.run_available(stream.where("event_type <> 'none'").writeStream.format(arrow_files.NAME).outputMode("append")
                               .option("path", f"{path}/out").option("writer", "copy"), f"{path}/checkpoint")
    return spark.read.format(arrow_files.NAME).load(f"{path}/out")
