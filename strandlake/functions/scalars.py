"""Scalar and aggregate column functions shared by operators and readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y", "MT"]


def plain_chrom(c: Column) -> Column:
    """Chromosome names without a chr prefix; M is MT."""
    bare = F.regexp_replace(c, "^[cC][hH][rR]", "")
    return F.when(F.upper(bare) == "M", "MT").otherwise(F.upper(bare))


def chrom_rank(c: Column) -> Column:
    """Natural order 1 to 22, X, Y, MT; others last."""
    p = F.array_position(F.array(*map(F.lit, CHROMOSOMES)), c)
    return F.when(p > 0, p).otherwise(len(CHROMOSOMES) + 1)


def complement(c: Column) -> Column:
    """Complementary bases, letter by letter."""
    return F.translate(c, "ACGTacgt", "TGCAtgca")


def log2_odds(p: Column, q: Column) -> Column:
    """log2 of p's odds over q's; null where either is 0 or 1."""
    return F.log2(F.try_divide(p * (1 - q), q * (1 - p)))


def known_sum(c: Column) -> Column:
    """An aggregate: the sum, or null if any row is null."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def id_digest(ids: Column) -> Column:
    """An aggregate: SHA-256 of a short list of ids in order, joined by line feeds."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids.cast("string"))), "\n"), 256)


def joined(names: Column, most: int) -> Column:
    """The first `most` entries of an array joined by commas, with '+N more' behind them."""
    more = F.concat(F.lit(",+"), F.size(names) - most, F.lit(" more"))
    return F.concat(F.array_join(F.slice(names, 1, most), ","), F.when(F.size(names) > most, more).otherwise(""))
