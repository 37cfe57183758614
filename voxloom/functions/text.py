"""Text normalisation and word-level edit distance as column expressions.

Unicode composition and full case folding have no Spark built-in. Text made
only of characters for which they equal plain lower case stays in the JVM;
only the other rows carry a value into a small Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Characters whose composed form is themselves and which never combine.
_NFC_SAFE = r"\u0000-\u02ff\u0400-\u0482\u048a-\u052f\u2002-\u206f"
# The same without the letters whose case folding differs from lower case; the
# one frequent exception, sharp s, is folded by hand.
_FOLD_SAFE = (
    r"\u0000-\u00b4\u00b6-\u00de\u00e0-\u00ff"
    r"\u0400-\u0482\u048a-\u052f\u2002-\u206f"
)
# Compatibility forms exist inside Latin-1 too, so the NFKC class is narrower.
_KFOLD_SAFE = r"\u0000-\u007f\u00c0-\u00de\u00e0-\u00ff\u0400-\u0482\u048a-\u052f"

# Python's str.split() white space.
SPACE_CLASS = (
    r"[\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680"
    r"\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def _compose_fold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFC", v).casefold()
    )


@F.pandas_udf(StringType())
def _compat_fold(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold()
    )


def _only_unsafe(text: Column, safe: str) -> Column:
    return F.when(text.rlike(f"[^{safe}]"), text)


def nfc(text: Column) -> Column:
    return F.coalesce(_compose(_only_unsafe(text, _NFC_SAFE)), text)


def _simple_fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def nfc_casefold(text: Column) -> Column:
    return F.coalesce(_compose_fold(_only_unsafe(text, _FOLD_SAFE)), _simple_fold(text))


def nfkc_casefold(text: Column) -> Column:
    return F.coalesce(_compat_fold(_only_unsafe(text, _KFOLD_SAFE)), _simple_fold(text))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE_CLASS, " "))


def review_normalise(text: Column) -> Column:
    """Composed, case-folded, straight apostrophes, single spaces, no outer ' .,!'."""
    folded = F.replace(nfc_casefold(text), F.lit("’"), F.lit("'"))
    return F.btrim(collapse_space(folded), F.lit(" .,!"))


def keyword_normalise(text: Column) -> Column:
    """Compatibility-folded words separated by single spaces."""
    return F.trim(F.regexp_replace(nfkc_casefold(text), r"[^\p{L}\p{N}_]+", " "))


def wer_words(text: Column) -> Column:
    """Composed, lower-cased, punctuation dropped, split on white space."""
    bare = F.regexp_replace(F.lower(nfc(text)), r"\p{P}", "")
    return F.filter(F.split(bare, SPACE_CLASS), lambda w: w != "")


def _as_symbols(words: Column, vocabulary: Column) -> Column:
    """Spell a word list as one string with one code point per distinct word.

    Code points start above the surrogate range, so every position in the
    vocabulary maps to a valid character.
    """
    return F.array_join(
        F.transform(
            words,
            lambda w: F.decode(
                F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + F.lit(0x10000)), 8, "0")),
                "UTF-32",
            ),
        ),
        "",
    )


def with_word_distance(df: DataFrame, reference: str, hypothesis: str, out: str) -> DataFrame:
    """Adds the word-level edit distance of two word-list columns.

    Distinct words of the pair become distinct characters, which turns the
    word problem into the built-in character-level ``levenshtein``. The shared
    vocabulary is a column of its own so that it is built once per row and
    not once per word.
    """
    vocabulary = df.withColumn("_vocabulary", F.array_union(reference, hypothesis))
    words = F.col("_vocabulary")
    return vocabulary.withColumn(
        out,
        F.levenshtein(
            _as_symbols(F.col(reference), words), _as_symbols(F.col(hypothesis), words)
        ).cast("long"),
    ).drop("_vocabulary")
