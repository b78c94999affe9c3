"""The queries of the operators on the test tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, exact, html_text, licences, mixing, near, prefix_trie, quality, runs, secrets, substrings, suffixes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The words of a text, as a list.
WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return (groups.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("sha").alias("text_sha256")))


@query("op6_near_dedup", rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, {WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
p AS (SELECT doc_id, n, word || coalesce(' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY pos), '') AS shingle, pos FROM w),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM p WHERE n = 1 OR pos < n),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS size FROM sh GROUP BY doc_id),
ln AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
 JOIN sz x ON x.doc_id = a.doc_id JOIN sz y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.size, y.size HAVING 100 * count(*) >= 80 * (x.size + y.size - count(*))),
reach AS (SELECT doc_id AS root, doc_id FROM t UNION SELECT root, ln.b FROM reach JOIN ln ON ln.a = reach.doc_id)
SELECT t.doc_id, coalesce(size, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t LEFT JOIN sz USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)""")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near.near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                         F.col("id").eqNullSafe(F.col("component")).alias("kept"))


@query("op5_substring_dedup", rf"""WITH t AS (SELECT doc_id, {WORDS_SQL.format(text="coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
k AS (SELECT doc_id, pos, word, {" || ' ' || ".join(["word"] + [f"lead(word, {i}) OVER d" for i in range(1, 20)])} AS run FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, word, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS again FROM k),
c AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN r USING (doc_id)""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_suffix_dedup", r"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, o, h[2 * o + 1:2 * o + 998] AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 400)) AS o FROM t)),
b AS (SELECT doc_id, o + i AS p, h[2 * i + 1:2 * i + 2] AS byte, CASE WHEN 2 * i + 200 <= length(h) THEN md5(h[2 * i + 1:2 * i + 200]) END AS run
 FROM (SELECT doc_id, o, h, unnest(range(least(400, length(h) // 2))) AS i FROM k)),
f AS (SELECT doc_id, p, byte, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, p) > 1 AS again FROM b),
c AS (SELECT doc_id, p, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM c),
r AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
 string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)""")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits",
                        F.col("start").alias("start_char"), F.col("end").alias("end_char"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return (rated.select(F.col("row.doc_id").alias("doc_id"), "score").withColumn("held_out", quality.held_out("doc_id"))
            .select("doc_id", "held_out", "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted")))


@query("op1_source_mixing", r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                      md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   (ARRAY[3.0::DOUBLE, 1.0, 2.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
caps AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS seen
           FROM caps WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (SELECT source, source_size, CASE WHEN seen >= ratio THEN cap ELSE weight *
             ((sum(source_size) OVER () * 1.5::DOUBLE - sum(CASE WHEN seen >= ratio THEN cap ELSE 0 END) OVER ())
              / nullif(sum(CASE WHEN seen >= ratio THEN 0 ELSE weight END) OVER (), 0)) END AS target FROM levels),
placed AS (SELECT doc_id, size, source_size, target,
                  sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle
           FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(middle <= target AS INT) + CAST(source_size + middle <= target AS INT)) AS BIGINT) AS taken FROM placed""")
def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    # in the order of the first copy's place in training, rows that the mix leaves out last
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    tie = F.xxhash64("id")
    return (mixed.repartitionByRange(first, tie).sortWithinPartitions(first, tie)
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken")))


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(F.col("id").alias("doc_id"), *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secrets.BASE],
                        F.sha2(joined(of(*secrets.BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract(table(spark, sf_dir, "pages"))
    return texts.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.licences(table(spark, sf_dir, "documents"))
    return (found.select(F.col("id").alias("doc_id"), F.explode("found").alias("f"))
            .select("doc_id", F.col("f.licence").alias("license"), F.round("f.dice", 6).alias("dice"),
                    F.col("f.start").alias("start_word"), F.col("f.end").alias("end_word")))


#: CRC-32 of a text of digits, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
 lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations that begin like the first of their five: (conv, records) with up to eight turns of it in front."""
    h = (F.crc32(F.col("conv").cast("string")) % 9).cast("int")
    first = conversations.where("conv % 5 = 0").select(F.col("conv").alias("first"), F.slice("records", 1, 8).alias("head"))
    nothing = F.array().cast("array<string>")
    both = conversations.withColumn("h", h).join(first, F.col("conv") - F.col("conv") % 5 == F.col("first"), "left")
    return both.select("conv", F.concat(F.slice(F.coalesce("head", nothing), 1, F.col("h")),
                                        F.slice("records", F.col("h") + 1, F.size("records"))).alias("records"))


@query("op11_prefix_trie", f"""WITH o AS MATERIALIZED (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS rec, strlen(coalesce(text, '')) AS bytes,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
 FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, {CRC_SQL.format(text="conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (SELECT c.conv_id, o.pos, o.rec, o.bytes FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.pos <= h
 UNION ALL SELECT c.conv_id, h + o.pos, o.rec, o.bytes FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > h),
q AS (SELECT conv_id, row_number() OVER w AS depth, bytes, md5(string_agg(rec, '') OVER w) AS node FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
 UNION ALL SELECT conv_id, 0, 0, '' FROM c),
p AS MATERIALIZED (SELECT *, lag(node) OVER d AS parent, lead(node) OVER d IS NULL AS ends FROM q WINDOW d AS (PARTITION BY conv_id ORDER BY depth)),
n AS MATERIALIZED (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
 string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM p GROUP BY node, depth),
k AS MATERIALIZED (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS kids FROM n GROUP BY ALL) x ON x.parent = n.node AND x.depth = n.depth),
s AS (SELECT p.node, p.depth, sum((k.kids = 0)::INT) AS n_leaves, sum((k.n_convs - 1) * k.bytes) AS saved FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY ALL)
SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.kids AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(k.ids, '')) AS ends_sha256
FROM k JOIN s ON s.node = k.node AND s.depth = k.depth LEFT JOIN k up ON up.node = k.parent AND up.depth = k.depth - 1""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


@query("op12_warc_normalise", """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
 CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to FROM g""")
def op12_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.normalise(warc.write(table(spark, sf_dir, "pages")))
    return warc.read(index, payloads=False).select(
        F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to_page").cast("bigint").alias("refers_to"))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document, by a hash of its id, with a tail that repeats."""
    if doc_id is None or not words or (h := crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


@query("op13_periodic_runs", rf"""WITH t AS (SELECT *, len(ws) AS n, {CRC_SQL.format(text="doc_id::VARCHAR")} AS h
 FROM (SELECT doc_id, {WORDS_SQL.format(text="coalesce(text, '')")} AS ws FROM documents)),
a AS (SELECT *, (h // 10) % nullif(n, 0) AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
w AS MATERIALIZED (SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
k AS MATERIALIZED (SELECT doc_id, n, i, {" || ' ' || ".join(["word"] + [f"lead(word, {i}) OVER d" for i in range(1, 6)])} AS gram FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON y.doc_id = x.doc_id AND y.gram = x.gram AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
r AS MATERIALIZED (SELECT doc_id, q, min(i) AS s, count(*) + 5 + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m)
 GROUP BY doc_id, q, island HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
f AS MATERIALIZED (SELECT * FROM r WHERE NOT EXISTS (FROM r x WHERE x.doc_id = r.doc_id AND x.q < r.q AND x.s <= r.s AND x.s + x.len >= r.s + r.len)),
b AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(len := len, s := -s, q := -q)) AS best, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM f GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (FROM f WHERE f.doc_id = w.doc_id AND w.i >= f.s + f.q AND w.i < f.s + f.len) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.len AS length, -best.q AS period, 1000 * best.len // -best.q AS exponent_milli,
 sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)""")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"))
