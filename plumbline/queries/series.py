"""Time series and signals made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, table
from .drift import EVENTS_CUT, events_halves
from .sqlparts import cdf_ctes
from ..operators import series
from ..plans.frames import r

FRAME = 16


def events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("ts_order", """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
 count(*) OVER (PARTITION BY event_type) AS n FROM events""")
def ts_order(spark, sf):
    e = events(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return series.ts_order(e, "event_type", "ts", "event_id").select(
        "event_id", "event_type", "pos", F.col("pos_total").alias("n"))


DECOMPOSED = """p AS (SELECT event_id, event_type, value AS x, row_number() OVER w - 1 AS pos,
 count(*) OVER (PARTITION BY event_type) AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
t AS (SELECT *, pos % 12 AS phase, CASE WHEN pos >= 6 AND pos < n - 6 THEN (sum(x) OVER (PARTITION BY event_type ORDER BY pos
 ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - 0.5 * (lag(x, 6) OVER w + lead(x, 6) OVER w)) / 12 END AS trend
 FROM p WHERE n >= 24 WINDOW w AS (PARTITION BY event_type ORDER BY pos)),
m AS (SELECT event_type, phase, avg(x - trend) AS m FROM t GROUP BY ALL),
s AS (SELECT event_type, phase, m - avg(m) OVER (PARTITION BY event_type) AS seasonal FROM m),
d AS (SELECT t.*, seasonal, x - trend - seasonal AS resid FROM t JOIN s USING (event_type, phase))"""


@query("ts_decompose", f"""WITH {DECOMPOSED} SELECT event_id, event_type, round(trend, 6) + 0.0 AS trend,
 round(seasonal, 6) + 0.0 AS seasonal, round(resid, 6) + 0.0 AS resid FROM d""")
def ts_decompose(spark, sf):
    d = series.decompose(events(spark, sf), "event_type", ["ts", "event_id"], "value")
    return d.select("event_id", "event_type", *[r(c).alias(c) for c in ("trend", "seasonal", "resid")])


@query("ts_strengths", f"""WITH {DECOMPOSED} SELECT event_type, round(var_pop(trend) / (var_pop(x) + 1e-10), 6) AS trend_strength,
 round(var_pop(seasonal) / (var_pop(x) + 1e-10), 6) AS seasonal_strength,
 round(var_pop(resid) / (var_pop(x) + 1e-10), 6) AS residual_strength FROM d GROUP BY event_type""")
def ts_strengths(spark, sf):
    d = series.decompose(events(spark, sf), "event_type", ["ts", "event_id"], "value")
    s = series.strengths(d, "event_type")
    return s.select("event_type", *[r(c).alias(c) for c in s.columns[1:]])


@query("ts_kpss", """WITH p AS (SELECT event_type, value, row_number() OVER w AS rk, sum(value) OVER w AS c, avg(value) OVER g AS m,
 count(*) OVER g AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
 g AS (PARTITION BY event_type)),
e AS (SELECT event_type, rk, n, value - m AS e, c - rk * m AS s FROM p),
st AS (SELECT event_type, max(n) AS n, sum(s * s) AS eta, sum(e * e) AS ss FROM e GROUP BY 1),
l1 AS (SELECT event_type, n, unnest(range(1, floor(pow(n, 2 / 9))::BIGINT + 1)) AS lag FROM st),
a1 AS (SELECT l1.event_type, l1.lag, sum(a.e * b.e) AS s FROM l1 JOIN e a ON a.event_type = l1.event_type
  JOIN e b ON b.event_type = a.event_type AND b.rk = a.rk + l1.lag GROUP BY ALL),
h AS (SELECT st.event_type, any_value(ss / n) + sum(a1.s / (n / 2)) AS s0, sum(a1.lag * a1.s / (n / 2)) AS s1, any_value(n) AS n,
  any_value(eta) AS eta, any_value(ss) AS ss FROM st JOIN a1 USING (event_type) GROUP BY 1),
c AS (SELECT *, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3) * pow(n, 1 / 3)), n - 1)::BIGINT AS lags FROM h),
l2 AS (SELECT event_type, lags, unnest(range(1, lags + 1)) AS lag FROM c),
a2 AS (SELECT l2.event_type, sum(a.e * b.e * (1 - l2.lag / (l2.lags + 1))) AS s FROM l2 JOIN e a ON a.event_type = l2.event_type
  JOIN e b ON b.event_type = a.event_type AND b.rk = a.rk + l2.lag GROUP BY 1),
f AS (SELECT event_type, n, lags, (eta / (n * n)) / ((ss + 2 * coalesce(s, 0)) / n) AS q FROM c LEFT JOIN a2 USING (event_type)),
z AS (SELECT *, CASE WHEN q <= 0.347 THEN 0.1 WHEN q <= 0.463 THEN 0.1 + (q - 0.347) * (0.05 - 0.1) / (0.463 - 0.347)
 WHEN q <= 0.574 THEN 0.05 + (q - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
 WHEN q <= 0.739 THEN 0.025 + (q - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END AS p FROM f)
SELECT event_type, n, lags, round(q, 6) AS statistic, round(p::DOUBLE, 6) AS p_value, p > 0.05 AS stationary FROM z""")
def ts_kpss(spark, sf):
    k = series.kpss(events(spark, sf), "event_type", ["ts", "event_id"], "value")
    return k.select("event_type", "n", "lags", r("statistic").alias("statistic"), r("p_value").alias("p_value"), "stationary")


@query("ts_adf")
def ts_adf(spark, sf):
    return series.adf(events(spark, sf), "user_id", ["ts", "event_id"], "value")


# ---- signals ---------------------------------------------------------------

def signal_ctes(key: str, source: str = "events") -> str:
    """CTEs up to ``en``, ``zc`` and ``sp``: energy, zero crossings and spectrum per signal ``k``."""
    return f"""sg AS (SELECT {key} AS k, value AS v, row_number() OVER w - 1 AS pos, lag(value) OVER w AS prev,
 avg(value) OVER (PARTITION BY {key}) AS m FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
fr AS (SELECT *, floor(pos / {FRAME})::BIGINT AS frame FROM sg),
en AS (SELECT k, avg(rms) AS rms_mean, stddev_pop(rms) AS rms_std FROM
 (SELECT k, frame, sqrt(avg(v * v)) AS rms FROM fr GROUP BY ALL) GROUP BY k),
zc AS (SELECT k, avg(z) AS zcr_mean FROM (SELECT k, frame, avg(CASE WHEN prev IS NOT NULL AND (v - m < 0) <> (prev - m < 0)
 THEN 1.0::DOUBLE ELSE 0.0 END) AS z FROM fr GROUP BY ALL) GROUP BY k),
ft AS (SELECT k, frame, f, sqrt(pow(sum(v * h * cos(2 * pi() * f * (pos % {FRAME}) / {FRAME})), 2)
   + pow(sum(v * h * sin(2 * pi() * f * (pos % {FRAME}) / {FRAME})), 2)) AS mag
 FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * (pos % {FRAME}) / {FRAME}) AS h FROM fr)
 CROSS JOIN (SELECT unnest(range({FRAME // 2 + 1})) AS f) GROUP BY ALL),
fs AS (SELECT k, frame, f / {FRAME} AS hz, mag, sum(mag) OVER (PARTITION BY k, frame) AS total,
 sum(mag) OVER (PARTITION BY k, frame ORDER BY f) AS upto FROM ft),
ce AS (SELECT k, frame, CASE WHEN max(total) > 0 THEN sum(hz * mag) / max(total) ELSE 0 END AS centroid,
 min(hz) FILTER (upto >= 0.85 * total) AS rolloff FROM fs GROUP BY ALL),
bw AS (SELECT k, frame, centroid, rolloff, sqrt(sum(CASE WHEN total > 0 THEN mag / total ELSE 0 END * pow(hz - centroid, 2)))
 AS bandwidth FROM fs JOIN ce USING (k, frame) GROUP BY ALL),
sp AS (SELECT k, avg(centroid) AS c, avg(bandwidth) AS b, avg(rolloff) AS o FROM bw GROUP BY k)"""


def framed(spark, sf):
    return series.frames(events(spark, sf), "user_id", ["ts", "event_id"], "value", FRAME)


@query("signal_energy", f"""WITH {signal_ctes('user_id')} SELECT k AS user_id, round(rms_mean, 6) AS rms_mean,
 round(rms_std, 6) AS rms_std FROM en""")
def signal_energy(spark, sf):
    e = series.energy(framed(spark, sf), "user_id")
    return e.select("user_id", r("rms_mean").alias("rms_mean"), r("rms_std").alias("rms_std"))


@query("signal_zcr", f"WITH {signal_ctes('user_id')} SELECT k AS user_id, round(zcr_mean, 6) AS zcr_mean FROM zc")
def signal_zcr(spark, sf):
    return series.zero_crossings(framed(spark, sf), "user_id").select("user_id", r("zcr_mean").alias("zcr_mean"))


@query("signal_spectrum", f"""WITH {signal_ctes('user_id')} SELECT k AS user_id, round(c, 6) AS spectral_centroid_mean,
 round(b, 6) AS spectral_bandwidth_mean, round(o, 6) AS spectral_rolloff_mean FROM sp""")
def signal_spectrum(spark, sf):
    s = series.spectrum(framed(spark, sf), "user_id", FRAME)
    return s.select("user_id", *[r(c).alias(c) for c in s.columns[1:]])


_HALF = f"(CASE WHEN ts < TIMESTAMP '{EVENTS_CUT}' THEN 'base' ELSE 'target' END || '/' || user_id)"
_FEATURES = """SELECT split_part(k, '/', 1) AS side, attr, value FROM
 (SELECT k, rms_mean, zcr_mean, c AS spectral_centroid_mean FROM en JOIN zc USING (k) JOIN sp USING (k))
 UNPIVOT (value FOR attr IN (rms_mean, zcr_mean, spectral_centroid_mean))"""


@query("drift_audio_features", f"""WITH {signal_ctes(_HALF)}, {cdf_ctes(_FEATURES)}
SELECT attr, round(score, 6) + 0.0 AS score FROM w1 UNION ALL SELECT 'overall', round(avg(score), 6) + 0.0 FROM w1""")
def drift_audio_features(spark, sf):
    e = events_halves(spark, sf).withColumn("signal", F.concat_ws("/", "side", F.col("user_id").cast("string")))
    f = series.signal_features(e, "signal", ["ts", "event_id"], "value", FRAME)
    scores = series.audio_drift(f.withColumn("side", F.split_part("signal", F.lit("/"), F.lit(1))))
    return scores.select("attr", r("score").alias("score"))
