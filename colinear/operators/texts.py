"""Texts as ordered sequences of elements, so that what compares regions compares texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_grams(texts: DataFrame, k: int = 4) -> DataFrame:
    """(acr, text) -> (acr, pos, motif): every run of k words, A-Z lower-cased, words being what white space parts.

    pos is the run's first word. Texts of fewer words, empty and null ones have no rows; whole texts are read.
    Rows of one acr that repeat give their elements once.
    """
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = texts.select("acr", words.alias("_words")).where(F.size("_words") >= k)
    grams = F.transform(F.sequence(F.lit(1), F.size("_words") - (k - 1)), lambda i: F.array_join(F.slice("_words", i, k), " "))
    return cut.select("acr", F.posexplode(grams).alias("pos", "motif"))


def of_known(occ: DataFrame, known: DataFrame) -> DataFrame:
    """The elements of occ whose motif known has: others can't be anchors, so they need not be grouped or shuffled by region."""
    return occ.join(known.select("motif").distinct(), "motif", "left_semi").select("acr", "pos", "motif")
