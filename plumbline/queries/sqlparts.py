"""Building blocks of the check SQL."""

from __future__ import annotations

from ..functions.text import LANGUAGES, SPACE, TOKEN, stopwords


def unpivot(columns: list[str], source: str, side: str, where: str = "true") -> str:
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return (f"SELECT side, attr, value FROM (SELECT {side} AS side, {cols} FROM {source} WHERE {where}) "
            f"UNPIVOT (value FOR attr IN ({', '.join(columns)}))")


def sides(base: str) -> str:
    return f"CASE WHEN {base} THEN 'base' ELSE 'target' END"


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_LONG = unpivot(LINE_COLUMNS, "lineitem", sides("l_returnflag = 'A'"), "l_returnflag IN ('A', 'R')")


def hist_ctes(long: str, bins: int) -> str:
    """CTEs up to ``h(attr, bin, lo, hi, n_base, n_target)`` with empty bins."""
    return f"""long AS ({long}),
rng AS (SELECT attr, min(value) AS lo, max(value) AS hi, count(*) FILTER (side = 'base') AS nb,
               count(*) FILTER (side = 'target') AS nt FROM long GROUP BY attr),
cnt AS (SELECT attr, CASE WHEN hi = lo THEN 0 ELSE
               least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) END AS bin,
               count(*) FILTER (side = 'base') AS n_base, count(*) FILTER (side = 'target') AS n_target
        FROM long JOIN rng USING (attr) GROUP BY ALL),
h AS (SELECT rng.attr, g.bin, lo, hi, nb, nt, coalesce(n_base, 0) AS n_base, coalesce(n_target, 0) AS n_target
      FROM rng CROSS JOIN (SELECT unnest(range({bins})) AS bin) g
      LEFT JOIN cnt ON cnt.attr = rng.attr AND cnt.bin = g.bin)"""


def psi_ctes(long: str, bins: int = 10) -> str:
    """CTEs up to ``psi(attr, score)``."""
    q, p = f"((n_target + 1) / (nt + {bins}))", f"((n_base + 1) / (nb + {bins}))"
    return hist_ctes(long, bins) + f""",
psi AS (SELECT attr, CASE WHEN max(hi) = max(lo) OR max(nb) = 0 OR max(nt) = 0 THEN 0.0
               ELSE abs(sum(({q} - {p}) * ln({q} / {p}))) END AS score FROM h GROUP BY attr)"""


def kl_ctes(long: str, bins: int = 20) -> str:
    p = f"((n_base / nb + 1e-10) / (1 + {bins} * 1e-10))"
    q = f"((n_target / nt + 1e-10) / (1 + {bins} * 1e-10))"
    return hist_ctes(long, bins) + f""",
kl AS (SELECT attr, CASE WHEN max(hi) = max(lo) THEN 0.0
              ELSE abs(sum({p} * ln({p} / {q}))) END AS score FROM h GROUP BY attr)"""


def cdf_ctes(long: str) -> str:
    """CTEs up to ``cdf(attr, value, next_value, fb, ft)``."""
    return f"""long AS ({long}),
vals AS (SELECT attr, value, count(*) FILTER (side = 'base') AS b, count(*) FILTER (side = 'target') AS t
         FROM long GROUP BY attr, value),
cdf AS (SELECT attr, value, lead(value) OVER w AS next_value,
               sum(b) OVER w / sum(b) OVER (PARTITION BY attr) AS fb,
               sum(t) OVER w / sum(t) OVER (PARTITION BY attr) AS ft
        FROM vals WINDOW w AS (PARTITION BY attr ORDER BY value)),
w1 AS (SELECT attr, coalesce(sum(abs(fb - ft) * (next_value - value)), 0) AS score FROM cdf GROUP BY attr),
ks AS (SELECT attr, max(abs(fb - ft)) AS score FROM cdf GROUP BY attr)"""


def skew(x: str) -> str:
    """Population skewness from raw power sums."""
    return (f"((avg({x}*{x}*{x}) - 3*avg({x})*avg({x}*{x}) + 2*avg({x})*avg({x})*avg({x}))"
            f" / pow(var_pop({x}), 1.5))")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_attributes(source: str = "documents") -> str:
    """SELECT doc_id, lang and the seven attributes of every document."""
    cases = " ".join(
        f"WHEN lang = '{code}' THEN len(list_filter(toks, lambda w: w IN ({', '.join(quote(x) for x in stopwords(name))})))"
        for code, name in LANGUAGES.items())
    return f"""SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS length_chars, CAST(len(toks) AS INTEGER) AS length_words,
 coalesce(len(regexp_extract_all(text, '[{SPACE}]')) / nullif(length(text), 0), 0.0) AS whitespace_ratio,
 coalesce(len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}{SPACE}]')) / nullif(length(text), 0), 0.0) AS special_char_ratio,
 coalesce((CASE {cases} ELSE 0 END) / nullif(len(toks), 0), 0.0) AS stopword_ratio,
 coalesce(len(list_distinct(toks)) / nullif(len(toks), 0), 0.0) AS vocab_diversity,
 CASE WHEN lang = 'en' AND len(toks) > 0 THEN greatest(0.0, least(100.0, 100 - 1.5 * coalesce(len(toks) /
   nullif(len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: regexp_matches(s, '[^{SPACE}]'))), 0), 0.0)))
   ELSE 0.0 END AS readability
FROM (SELECT doc_id, lang, coalesce(text, '') AS text,
             regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS toks FROM {source})"""
