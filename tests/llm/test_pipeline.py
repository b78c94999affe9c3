"""The pipeline against a brute-force version, and the queries by themselves."""

from collections import Counter
from zlib import crc32

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import decontaminate, mixing, quality, queries

from .test_duplicates import near_components

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    benchmark = [" ".join("".join(c.lower() if c.isalnum() else " " for c in r.text).split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        got = Counter(r.doc_id for r in out.collect())
        if name == "quality classifier":
            scores = {r.row.doc_id: r.score for r in quality.scored(docs, quality.train(docs, labels)).collect()}
            want = {i: 1 for i, s in scores.items() if s >= quality.CUT}
        elif name == "exact dedup":
            last = {r.text: i for i, r in sorted(before.items())}
            want = {i: 1 for i in last.values()}
        elif name == "near dedup":
            want = {i: 1 for i, _, c in near_components([(i, r.text) for i, r in before.items()]) if i == c}
        elif name == "benchmark decontamination":
            plain = {i: " ".join("".join(c.lower() if c.isalnum() else " " for c in r.text).split()) for i, r in before.items()}
            want = {i: 1 for i, t in plain.items() if not any(b in t for b in benchmark)}
        else:
            want = {r.id: len(r.positions) for r in mixing.mix(docs).collect() if r.positions}
        assert got == want, name
        if name != "source mixing":
            assert out.columns == docs.columns
            assert {r.doc_id: r for r in out.collect()} == {i: rows[i] for i in want}
            docs = spark.createDataFrame([rows[i] for i in sorted(want)], docs.schema)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_quality_query(spark):
    got = queries.QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.98 * len(held)


def test_benchmark_query(spark):
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, SF).collect()}
    table = decontaminate.letters()

    def plain(text):
        return decontaminate.normal([text], table)[0][1:-1].astype("uint32").tobytes().decode("utf-32-le")
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(r.doc_id, k) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for k, t in items.items() if t in plain(r.text or "")}
    assert whole and whole <= got


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op4_html_extraction", "op5_substring_dedup", "op6_near_dedup", "op7_secret_scan"])
def test_one_row_per_row(spark, name):
    table = "pages" if "html" in name else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
