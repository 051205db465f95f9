"""Scalar formulas, all of them Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centred(score: Column, mean: Column, center: float) -> Column:
    """Scores scaled so that their mean is `center`."""
    return score * (F.lit(float(center)) / mean)


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; 0 where the standard error is 0."""
    pooled = (x1 + x2) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return F.when(F.coalesce(error, F.lit(0.0)) == 0, 0.0).otherwise((x1 / n1 - x2 / n2) / F.nullif(error, F.lit(0.0)))


def match_score(p_hit: Column, p_background: Column, rarity: float) -> Column:
    """Log-odds plus weighted information of the background; a probability of 0 or less is an error."""
    odds = F.log2(p_hit / p_background) + F.lit(float(rarity)) * -F.log2(p_background)
    return F.when((p_hit <= 0) | (p_background <= 0), F.raise_error(F.lit("match_score: probabilities must be positive"))).otherwise(odds)


def global_distance(longer: Column, shorter: Column, chain: Column, alpha: float, scale: float) -> Column:
    """Blend of the shares of the longer and the shorter sequence that the scaled chain leaves; 1 for an empty one."""
    left = lambda n: (n - chain * scale) / F.nullif(n, F.lit(0))
    blend = alpha * left(longer) + (1 - alpha) * left(shorter)
    return F.when(shorter == 0, 1.0).otherwise(F.greatest(F.lit(0.0), blend))


def local_distance(score: Column, beta: float) -> Column:
    """beta / score; null for a score of 0."""
    return F.lit(float(beta)) / F.nullif(score, F.lit(0.0))


def per_base(score: Column, start: Column, stop: Column) -> Column:
    """Alignment score by the hit's length."""
    return score / (stop + 1 - start)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0 to 1 between low and high; null where these are equal."""
    return (value - low) / F.nullif(high - low, F.lit(0))


def blended(align: Column, chain: Column, fraction: float, align_range: tuple[Column, Column], chain_range: tuple[Column, Column]) -> Column:
    """Alignment distance and chain score, each on its own 0 to 1; a missing chain counts 0."""
    return fraction * (1 - min_max(align, *align_range)) + (1 - fraction) * min_max(F.coalesce(chain, F.lit(0.0)), *chain_range)


def feature_blend(length: Column, largest_length: Column, features: list[tuple[Column, Column]], fraction: float) -> Column:
    """fraction of length / largest, the rest in equal parts of 1 - feature / largest."""
    rest = sum(((1 - x / F.nullif(most, F.lit(0))) for x, most in features), F.lit(0.0))
    return fraction * length / F.nullif(largest_length, F.lit(0)) + (1 - fraction) / len(features) * rest


def adjusted(value: Column, by: float) -> Column:
    return value + F.lit(by)


def replicate_mean(values: Column) -> Column:
    """Mean of a comma-separated list of numbers."""
    x = F.transform(F.split(values, ","), lambda v: F.trim(v).cast("double"))
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def gff_attribute(attributes: Column, name: str) -> Column:
    """A value of `k=v;k=v`; of a parent the part before the first dot."""
    value = F.str_to_map(attributes, F.lit(";"), F.lit("="))[name]
    return F.split(value, r"\.")[0] if name == "Parent" else value


def promoter(strand: Column, start: Column, stop: Column, reach: int) -> tuple[Column, Column]:
    """The `reach` bases before a gene, by strand, half-open on the plus side as BED has it."""
    plus = strand == "+"
    return F.when(plus, F.greatest(F.lit(0), start - reach - 1)).otherwise(stop), F.when(plus, start - 1).otherwise(stop + reach)


def consensus_letters(pssm: Column) -> Column:
    """The likeliest letter of each row of a matrix of A, C, G and T; the first of equals."""
    letter = lambda row: F.substring(F.lit("ACGT"), F.array_position(row, F.array_max(row)).cast("int"), F.lit(1))
    return F.array_join(F.transform(pssm, letter), "")


def evalue_similarity(evalue: Column) -> Column:
    """-log10 of an E-value: missing counts 100, 0 gives 10."""
    e = F.coalesce(F.when(F.isnan(evalue), None).otherwise(evalue), F.lit(100.0))
    return F.when(e == 0, 10.0).otherwise(-F.log10(e))


def sub_sequence(sequence: Column, start: Column, stop: Column, reverse: Column | None = None, complement: bool = False) -> Column:
    """Bases start to stop, 1-based and inclusive; reversed (and with complement complemented) where asked."""
    s = F.substring(sequence, start, stop - start + 1)
    if reverse is None:
        return s
    turned = F.reverse(s)
    return F.when(reverse, F.translate(turned, "ACGTacgt", "TGCAtgca") if complement else turned).otherwise(s)


def extension_window(seq_index: Column, acr_index: Column, acr_length: Column, seq_length: Column, k: int, multiplier: float) -> tuple[Column, Column]:
    """[start, stop) in the sequence that an extension of a seed may reach."""
    start = F.greatest(F.lit(0), seq_index - F.floor(acr_index * multiplier))
    stop = F.least(seq_length, seq_index + k + F.floor((acr_length - (acr_index + k)) * multiplier))
    return start.cast("int"), stop.cast("int")


def rounded(value: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(value, 0)
