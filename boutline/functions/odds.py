"""Odds, margins and probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def american_to_prob(odds: Column) -> Column:
    """The probability in American odds; zero odds give one."""
    return F.when(odds < 0, -odds / (100 - odds)).otherwise(100 / (odds + 100))


def decimal_to_american(odds: Column) -> Column:
    """Decimal odds above one as American odds, whole."""
    return F.when(odds >= 2, F.round((odds - 1) * 100)).otherwise(F.round(-100 / (odds - 1)))


def fair_decimal(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), 1 / p)


def fair_american(p: Column) -> Column:
    return F.when((p > 0) & (p < 0.5), 100 * (1 - p) / p).when((p >= 0.5) & (p < 1), -100 * p / (1 - p))


def devig(o1: Column, o2: Column) -> Column:
    """The probability of the first of two outcomes without the margin."""
    return (1 / o1) / (1 / o1 + 1 / o2)


def overround(*odds: Column) -> Column:
    total = F.lit(0.0)
    for o in odds:
        total = total + 1 / o
    return total - 1


def clipped_logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
