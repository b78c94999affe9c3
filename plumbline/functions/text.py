"""Text measures as built-in expressions, evaluated over the whole text.

The tokeniser takes runs of letters and digits and single other marks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

# Character classes, written out because regex engines differ in \s.
SPACE = r" \t\n\r\f\x0b\x1c-\x1f\x85\p{Z}"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}" + SPACE + "]"

# Language codes and the stopword lists they stand for.
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}

ATTRIBUTES = ["length_chars", "length_words", "whitespace_ratio", "special_char_ratio",
              "stopword_ratio", "vocab_diversity", "readability"]


@lru_cache
def stopwords(language: str) -> tuple[str, ...]:
    """The stop words of Spark ML, kept as text beside this module: no JVM and no session is needed."""
    path = Path(__file__).with_name("stopwords") / f"{language}.txt"
    return tuple(path.read_text(encoding="utf-8").split("\n")[:-1])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _is_one_of(words: list[str]) -> Callable[[Column], Column]:
    return lambda token: token.isin(words)


def _stopword_count(toks: Column, language: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for code, name in LANGUAGES.items():
        out = out.when(language.isin(code, name), F.size(F.filter(toks, _is_one_of(list(stopwords(name))))))
    return out.otherwise(F.lit(0))


def with_text_attributes(df: DataFrame, text: str = "text", language: Column | str = "en") -> DataFrame:
    """Add the seven text attributes; a null or empty text has zeros."""
    lang = language if isinstance(language, Column) else F.lit(language)
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.withColumn("_lang", lang).withColumn("_toks", tokens(t))
    chars, words = F.length(t), F.size("_toks")
    sentences = F.size(F.filter(F.split(t, "[.!?]+"), lambda s: s.rlike(f"[^{SPACE}]")))

    def share(n: Column, of: Column) -> Column:
        return F.coalesce(n / F.nullif(of, F.lit(0)), F.lit(0.0))

    per_sentence = share(words, sentences)
    readable = F.when(F.col("_lang").isin("en", "english") & (words > 0),
                      F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - per_sentence * 1.5)))
    return (base
            .withColumn("length_chars", chars)
            .withColumn("length_words", words)
            .withColumn("whitespace_ratio", share(F.regexp_count(t, F.lit(f"[{SPACE}]")), chars))
            .withColumn("special_char_ratio",
                        share(F.regexp_count(t, F.lit(rf"[^\p{{L}}\p{{N}}{SPACE}]")), chars))
            .withColumn("stopword_ratio", share(_stopword_count(F.col("_toks"), F.col("_lang")), words))
            .withColumn("vocab_diversity", share(F.size(F.array_distinct("_toks")), words))
            .withColumn("readability", F.coalesce(readable, F.lit(0.0)))
            .drop("_toks", "_lang"))


# ---- text transforms -------------------------------------------------------

def upper(text: Column) -> Column:
    return F.upper(text)


def lower(text: Column) -> Column:
    return F.lower(text)


def simple_tokens(text: Column) -> Column:
    """Lower-case, full stops become spaces, split on white space."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\.", " "), f"[{SPACE}]+", " "))
    return F.filter(F.split(cleaned, " "), lambda t: t != "")


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def drop_blank_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\r\n|\r|\n"), lambda s: s.rlike(f"[^{SPACE}]")), "\n")
