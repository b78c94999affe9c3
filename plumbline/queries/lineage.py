"""Lineage and versions: region -> nation -> customer -> order as the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from ..operators import lineage, versions
from ..plans.ordered import numbered
from ..plans.scratch import scratch_path

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _id(prefix, col):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def graph(spark, sf):
    re, na = table(spark, sf, "region"), table(spark, sf, "nation")
    cu, od = table(spark, sf, "customer"), table(spark, sf, "orders")
    none = F.lit(None).cast("string")
    nodes = re.select(_id("r", "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("name"),
                      F.lit("v1").alias("version"), none.alias("timestamp"))
    nodes = nodes.unionByName(na.select(_id("n", "n_nationkey").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("name"),
                                        F.lit("v1").alias("version"), none.alias("timestamp")))
    nodes = nodes.unionByName(cu.select(
        _id("c", "c_custkey").alias("id"), F.lit("dataset").alias("type"),
        F.concat(F.lit("set"), (F.col("c_custkey") % 100).cast("string")).alias("name"),
        F.concat(F.lit("v"), F.floor(F.col("c_custkey") / 100).cast("string")).alias("version"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("19"), (F.col("c_custkey") % 8 + 92).cast("string"), F.lit("-03-01 00:00:00")))
        .otherwise("bad time").alias("timestamp")))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "analysis").otherwise("experiment")
    nodes = nodes.unionByName(od.select(
        _id("o", "o_orderkey").alias("id"), kind.alias("type"), F.col("o_orderpriority").alias("name"), none.alias("version"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp")))
    edges = na.select(_id("r", "n_regionkey").alias("source"), _id("n", "n_nationkey").alias("target"), F.lit("contains").alias("relationship"))
    edges = edges.unionByName(cu.select(_id("n", "c_nationkey").alias("source"), _id("c", "c_custkey").alias("target"), F.lit("contains").alias("relationship")))
    edges = edges.unionByName(od.select(_id("c", "o_custkey").alias("source"), _id("o", "o_orderkey").alias("target"),
                                        F.when(F.col("o_orderkey") % 2 == 0, "generates").otherwise("uses").alias("relationship")))
    # every seventh order also depends on a nation, so that two ways lead to it
    edges = edges.unionByName(od.where("o_orderkey % 7 = 0").select(
        F.concat(F.lit("n"), (F.col("o_orderkey") % 25).cast("string")).alias("source"), _id("o", "o_orderkey").alias("target"),
        F.lit("target").alias("relationship")))
    return nodes, edges


GRAPH = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS name, 'v1' AS version, NULL AS timestamp FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, 'v1', NULL FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'dataset', 'set' || (c_custkey % 100), 'v' || (c_custkey // 100),
  CASE WHEN c_custkey % 3 <> 0 THEN '19' || (c_custkey % 8 + 92) || '-03-01 00:00:00' ELSE 'bad time' END FROM customer
 UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'analysis' ELSE 'experiment' END, o_orderpriority, NULL,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders),
edges AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target, 'contains' AS relationship FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains' FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'generates' ELSE 'uses' END FROM orders
 UNION ALL SELECT 'n' || (o_orderkey % 25), 'o' || o_orderkey, 'target' FROM orders WHERE o_orderkey % 7 = 0)"""


@query("lineage_dependencies", f"""WITH {GRAPH} SELECT target AS id, source AS dependency, relationship FROM edges
WHERE target IN (SELECT id FROM nodes WHERE type = 'analysis')""")
def lineage_dependencies(spark, sf):
    nodes, edges = graph(spark, sf)
    return lineage.dependencies(edges, nodes.where("type = 'analysis'"))


@query("lineage_dependents", f"""WITH {GRAPH} SELECT source AS id, target AS dependent, relationship FROM edges
WHERE source IN (SELECT id FROM nodes WHERE type = 'nation')""")
def lineage_dependents(spark, sf):
    nodes, edges = graph(spark, sf)
    return lineage.dependents(edges, nodes.where("type = 'nation'"))


@query("lineage_impact", f"""WITH {GRAPH}, e AS (SELECT DISTINCT source AS a, target AS b FROM edges),
h AS (SELECT x.a, y.b FROM e x JOIN e y ON y.a = x.b),
c AS (SELECT id, (SELECT count(*) FROM e WHERE a = id) AS direct_dependents, (SELECT count(DISTINCT b) FROM h WHERE a = id) AS indirect_dependents,
 (SELECT count(*) FROM e WHERE b = id) AS direct_dependencies, (SELECT count(DISTINCT a) FROM h WHERE b = id) AS indirect_dependencies FROM nodes)
SELECT *, direct_dependents + indirect_dependents AS impact_count, CASE WHEN direct_dependents + indirect_dependents >= 5 THEN 'high'
 WHEN direct_dependents + indirect_dependents >= 2 THEN 'medium' ELSE 'low' END AS severity FROM c""")
def lineage_impact(spark, sf):
    return lineage.impact(*graph(spark, sf))


@query("lineage_bfs", f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT id AS root, id, 0 AS depth FROM nodes WHERE type = 'region'
 UNION SELECT root, target, depth + 1 FROM walk JOIN edges ON source = walk.id WHERE depth < 2),
seen AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY ALL),
w AS (SELECT s.root, s.id, count(*) AS n FROM seen s JOIN edges e ON e.source = s.id LEFT JOIN seen t ON t.root = s.root AND t.id = e.target
 WHERE t.depth IS NULL OR t.depth > s.depth OR (t.depth = s.depth AND t.id > s.id) GROUP BY ALL)
SELECT root, id, depth, coalesce(n, 0) AS edges_walked FROM seen LEFT JOIN w USING (root, id)""")
def lineage_bfs(spark, sf):
    nodes, edges = graph(spark, sf)
    reached = lineage.reach(edges, nodes.where("type = 'region'"), 2)
    walked = lineage.walked_edges(edges, reached).groupBy("root", F.col("source").alias("id")).agg(F.count("*").alias("edges_walked"))
    return reached.join(walked, ["root", "id"], "left").fillna(0, ["edges_walked"])


@query("lineage_overview", f"""WITH {GRAPH} SELECT 'type' AS section, type AS name, count(*) AS n FROM nodes GROUP BY ALL
UNION ALL SELECT 'children', source || '/' || relationship, count(*) FROM edges WHERE source IN (SELECT id FROM nodes WHERE type = 'dataset') GROUP BY ALL""")
def lineage_overview(spark, sf):
    return lineage.overview(*graph(spark, sf), "dataset")


@query("lineage_timeline", f"""WITH {GRAPH}, v AS (SELECT * FROM nodes WHERE type = 'dataset' AND name = 'set7'),
ev AS (SELECT 'version' AS event_type, id, id AS dataset_id, version, timestamp FROM v
 UNION ALL SELECT n.type, n.id, v.id, v.version, n.timestamp FROM v JOIN edges e ON e.source = v.id JOIN nodes n ON n.id = e.target)
SELECT event_type, id, dataset_id, version, timestamp, row_number() OVER (ORDER BY try_cast(timestamp AS TIMESTAMP) NULLS FIRST,
 CASE WHEN event_type = 'version' THEN 0 ELSE 1 END, id) AS place FROM ev""")
def lineage_timeline(spark, sf):
    # the place in the listing, to check the order
    at = F.coalesce(F.unix_micros(F.try_to_timestamp("timestamp")), F.lit(-(2 ** 62)))
    marked = lineage.timeline(*graph(spark, sf), "set7").withColumn("_at", at).withColumn(
        "_kind", F.when(F.col("event_type") == "version", 0).otherwise(1))
    return numbered(marked, [], ["_at", "_kind", "id"], "place").select(
        "event_type", "id", "dataset_id", "version", "timestamp", (F.col("place") + 1).alias("place"))


@query("lineage_version_items", f"""WITH {GRAPH} SELECT n.type, n.id, relationship FROM edges e JOIN nodes n ON n.id = e.target
 JOIN nodes v ON v.id = e.source WHERE v.name = 'set7' AND v.version = 'v1' AND n.type IN ('analysis', 'experiment')
UNION ALL SELECT 'dataset', name, 'registered' FROM (SELECT DISTINCT name FROM nodes WHERE type = 'dataset')""")
def lineage_version_items(spark, sf):
    nodes, edges = graph(spark, sf)
    names = nodes.where("type = 'dataset'").select(F.lit("dataset").alias("type"), F.col("name").alias("id"),
                                                   F.lit("registered").alias("relationship")).distinct()
    return lineage.version_items(nodes, edges, "set7", "v1").unionByName(names)


@query("lineage_append", f"""WITH {GRAPH} SELECT 'type' AS section, type AS name, count(*) AS n FROM nodes GROUP BY ALL
UNION ALL SELECT 'children', source || '/' || relationship, count(*) FROM edges WHERE source IN (SELECT id FROM nodes WHERE type = 'dataset') GROUP BY ALL""")
def lineage_append(spark, sf):
    path = scratch_path(spark, "lineage")
    nodes, edges = graph(spark, sf)
    lineage.append(f"{path}/nodes", f"{path}/edges", nodes.where("type <> 'experiment'"), edges.where("relationship <> 'uses'"))
    lineage.append(f"{path}/nodes", f"{path}/edges", nodes.where("type = 'experiment'"), edges.where("relationship = 'uses'"))
    return lineage.overview(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), "dataset")


@query("lineage_orphans", """SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 <> 5 AND o_orderkey % 3 <> 0
 AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey % 3 = 0 AND p.o_orderkey + 1 = orders.o_orderkey)
 AND o_orderkey <> (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
def lineage_orphans(spark, sf):
    o = table(spark, sf, "orders")
    snapshots = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 10 == 5, "kept").alias("alias"),
                         F.col("o_orderdate").alias("created_at"))
    relations = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("source"), (F.col("o_orderkey") + 1).alias("target"))
    return lineage.orphans(snapshots, relations).select("id")


# ---- versions --------------------------------------------------------------

@query("table_fingerprint")
def table_fingerprint(spark, sf):
    out = None
    for name in TABLES:
        one = versions.fingerprint(table(spark, sf, name), name)
        out = one if out is None else out.unionByName(one)
    return out


@query("version_status", """SELECT 'customer' AS name, 'v1.0' AS version, 'first' AS alias, 'clean' AS state, 'ok' AS outcome
UNION ALL SELECT 'orders', 'v1.0', 'first', CASE WHEN count(*) = count(*) FILTER (o_orderkey % 2 = 0) THEN 'clean' ELSE 'modified' END,
 CASE WHEN count(*) = count(*) FILTER (o_orderkey % 2 = 0) THEN 'ok' ELSE 'warning' END FROM orders
UNION ALL SELECT 'part', NULL, NULL, 'unversioned', 'warning'""")
def version_status(spark, sf):
    c, o, p = (table(spark, sf, n) for n in ("customer", "orders", "part"))
    registered = versions.fingerprint(c, "customer").unionByName(versions.fingerprint(o.where("o_orderkey % 2 = 0"), "orders"))
    registry = registered.select("name", F.lit("v1.0").alias("version"), "hash", F.lit("first").alias("alias"),
                                 F.to_timestamp(F.lit("2024-01-01")).alias("created_at"))
    current = versions.fingerprint(c, "customer").unionByName(versions.fingerprint(o, "orders")).unionByName(versions.fingerprint(p, "part"))
    return versions.check(versions.status(current, registry), "warning").select("name", "version", "alias", "state", "outcome")


def registry(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("ds"), (k % 50).cast("string")).alias("name"),
        F.when((k % 6 == 0) | (k % 50 == 1), "draft").otherwise(F.concat(F.lit("v"), (k % 4).cast("string"), F.lit("."), (k % 17).cast("string"))).alias("version"),
        F.when(k % 9 == 0, F.concat(F.lit("a"), (k % 450).cast("string"))).alias("alias"), k.alias("id"), F.col("o_orderdate").alias("created_at"))


REGISTRY = """reg AS (SELECT 'ds' || (o_orderkey % 50) AS name, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 50 = 1 THEN 'draft'
 ELSE 'v' || (o_orderkey % 4) || '.' || (o_orderkey % 17) END AS version, CASE WHEN o_orderkey % 9 = 0 THEN 'a' || (o_orderkey % 450) END AS alias,
 o_orderkey AS id, o_orderdate AS created_at FROM orders)"""


@query("version_next", f"""WITH {REGISTRY}, n AS (SELECT DISTINCT 'ds' || (c_custkey % 60) AS name FROM customer),
p AS (SELECT name, max(CASE WHEN version <> 'draft' THEN split_part(substr(version, 2), '.', 1)::BIGINT * 1000 + split_part(version, '.', 2)::BIGINT END) AS m
 FROM reg GROUP BY name)
SELECT n.name, CASE WHEN p.name IS NULL THEN 'v1.0' ELSE 'v' || coalesce(m // 1000, 0) || '.' || (coalesce(m % 1000, 0) + 1) END AS next_version
FROM n LEFT JOIN p USING (name)""")
def version_next(spark, sf):
    names = table(spark, sf, "customer").select(F.concat(F.lit("ds"), (F.col("c_custkey") % 60).cast("string")).alias("name")).distinct()
    return versions.next_version(names, registry(spark, sf))


@query("version_alias", f"""WITH {REGISTRY}, w AS (SELECT DISTINCT name, alias FROM reg WHERE alias IS NOT NULL UNION ALL SELECT 'ds0', 'no-such'),
k AS (SELECT name, alias, count(DISTINCT version) AS n, min(version) AS v FROM reg WHERE alias IS NOT NULL GROUP BY ALL)
SELECT name, alias, CASE WHEN n = 1 THEN v END AS version, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'conflict' ELSE 'ok' END AS state
FROM w LEFT JOIN k USING (name, alias)""")
def version_alias(spark, sf):
    reg = registry(spark, sf).where("alias IS NOT NULL")
    wanted = reg.select("name", "alias").distinct().unionByName(
        spark.range(1).select(F.lit("ds0").alias("name"), F.lit("no-such").alias("alias")))
    return versions.resolve_alias(reg, wanted)


@query("versions_newest", f"""WITH {REGISTRY} SELECT name, version, coalesce(alias, '') AS alias, id,
 row_number() OVER (PARTITION BY name ORDER BY created_at DESC, id) AS rank FROM reg""")
def versions_newest(spark, sf):
    return versions.newest_first(registry(spark, sf), ["name"], "created_at", "id").select(
        "name", "version", F.coalesce("alias", F.lit("")).alias("alias"), "id", "rank")


@query("snapshots_newest", f"""WITH {REGISTRY} SELECT id, created_at, coalesce(alias, '') AS alias FROM reg ORDER BY created_at DESC, id LIMIT 50""")
def snapshots_newest(spark, sf):
    reg = registry(spark, sf)
    aliases = reg.where("alias IS NOT NULL").select("id", "alias")
    return versions.snapshots_newest(reg.select("id", "created_at"), aliases, 50).select(
        "id", "created_at", F.coalesce("alias", F.lit("")).alias("alias"))
