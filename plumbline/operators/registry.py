"""Extension points: profilers, detectors, transforms, sources and sinks by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource

from ..functions import text as T
from ..sources.tables import NoAdapter, read_uri
from .fusion import DETECTORS, UnsupportedDetector

Profiler = Callable[[DataFrame], DataFrame]
Detector = Callable[[DataFrame, DataFrame, dict], DataFrame]


class Registry:
    """Names to plain functions over DataFrames and columns; the first to claim a name keeps it."""

    def __init__(self) -> None:
        self.profilers: dict[str, Profiler] = {}
        self.detectors: dict[tuple[str, str], Detector] = {}
        self.notes: dict[str, str] = {}
        self.transforms: dict[str, Callable[[Column], Column]] = {
            "text.upper": T.upper, "text.lower": T.lower, "text.normalize": T.normalize,
            "text.drop_blank_lines": T.drop_blank_lines, "text.tokenize": T.simple_tokens}
        self.sources: dict[str, Callable[..., DataFrame]] = {}
        self.sinks: dict[str, Callable[[DataFrame, str], None]] = {}

    def register_profiler(self, modality: str, profiler: Profiler) -> None:
        self.profilers.setdefault(modality, profiler)

    def register_detector(self, modality: str, name: str, detector: Detector, notes: str = "") -> None:
        self.detectors.setdefault((modality, name), detector)
        if notes:
            self.notes.setdefault(modality, notes)

    def register_transform(self, name: str, transform: Callable[[Column], Column]) -> None:
        self.transforms.setdefault(name, transform)

    def register_source(self, scheme: str, reader: Callable[..., DataFrame]) -> None:
        self.sources.setdefault(scheme, reader)

    def register_format(self, spark: SparkSession, source: type[DataSource]) -> None:
        """A format of Spark's own: ``spark.read.format(name)``, streams and writers as far as the source has them.

        URIs whose scheme is the format's name are read by it, ``write`` with that target appends.
        """
        name = source.name()
        spark.dataSource.register(source)
        self.register_source(name, lambda s, uri, **o: s.read.format(name).options(**o).load(uri.partition("://")[2]))
        self.register_sink(name, lambda df, where: df.write.format(name).mode("append").save(where))

    def register_sink(self, target: str, writer: Callable[[DataFrame, str], None]) -> None:
        self.sinks.setdefault(target, writer)

    # ---- use ----

    def profile(self, modality: str, df: DataFrame) -> DataFrame:
        if modality not in self.profilers:
            raise KeyError(f"no profiler for {modality!r}")
        return self.profilers[modality](df)

    def check_detector(self, name: str) -> None:
        """Accept a name any modality declares; ``default`` always is."""
        declared = {n for names in DETECTORS.values() for n in names} | {n for _, n in self.detectors}
        if name != "default" and name not in declared:
            raise UnsupportedDetector(f"unsupported_detector: {name!r}")

    def detect(self, modality: str, name: str, base: DataFrame, target: DataFrame, spec: dict | None = None) -> DataFrame:
        self.check_detector(name)
        if (modality, name) not in self.detectors:
            raise UnsupportedDetector(f"unsupported_detector: {name!r} for {modality!r}")
        return self.detectors[modality, name](base, target, spec or {})

    def transform(self, name: str, column: Column) -> Column:
        """An unknown name leaves the column as it is."""
        return self.transforms.get(name, lambda c: c)(column)

    def read(self, spark: SparkSession, uri: str, **options) -> DataFrame:
        scheme = uri.partition("://")[0]
        return self.sources[scheme](spark, uri, **options) if scheme in self.sources else read_uri(spark, uri, **options)

    def write(self, target: str, df: DataFrame, where: str) -> None:
        if target not in self.sinks:
            raise NoAdapter(f"no sink {target!r}")
        self.sinks[target](df, where)

    def detector_table(self, spark: SparkSession) -> DataFrame:
        """(modality, default_detector, supported, notes)."""
        modalities = sorted({*DETECTORS, *(m for m, _ in self.detectors)})
        rows = []
        for m in modalities:
            names = sorted({*DETECTORS.get(m, {}), *(n for x, n in self.detectors if x == m)})
            rows.append((m, DETECTORS.get(m, {}).get("default", names[0]), names, self.notes.get(m, "")))
        return spark.createDataFrame(rows, "modality string, default_detector string, supported array<string>, notes string")


def register_sql(spark: SparkSession) -> None:
    """SQL-callable forms of the small formulas, as temporary SQL functions."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION drift_status(score DOUBLE) RETURNS STRING
        RETURN CASE WHEN score < 0.15 THEN 'NORMAL' WHEN score < 0.25 THEN 'WARNING' ELSE 'CRITICAL' END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION image_quality(sharpness DOUBLE, noise DOUBLE) RETURNS DOUBLE
        RETURN (least(sharpness / 100, 1.0) * 0.6 + greatest(0.0, 1 - noise / 0.5) * 0.4) * 100""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION psi_of_shares(base ARRAY<DOUBLE>, target ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN abs(aggregate(zip_with(base, target, (p, q) -> (q - p) * ln(q / p)), 0D, (a, x) -> a + x))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION entropy_of_counts(counts ARRAY<BIGINT>) RETURNS DOUBLE
        RETURN -aggregate(transform(filter(counts, c -> c > 0), c -> c / aggregate(counts, 0L, (a, x) -> a + x)),
                          0D, (a, p) -> a + p * log2(p))""")


def smoothed_shares(counts: Column, bins: int) -> Column:
    """Add-one smoothed shares of an array of bin counts."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(counts, lambda c: (c + 1) / (total + bins))
