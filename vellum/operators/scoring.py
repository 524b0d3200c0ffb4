"""Scorers: a scorer gives the contribution of one posting as a Column."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer(Protocol):
    def contribution(self, tf: Column, df: Column, n_docs: Column, length: Column, avg_length: Column) -> Column: ...


class BM25:
    """Okapi BM25 with idf floored at 0; a missing length counts as tf, a missing average as 1."""

    def __init__(self, k: float = 1.2, b: float = 0.75) -> None:
        self.k, self.b = k, b

    def contribution(self, tf: Column, df: Column, n_docs: Column, length: Column, avg_length: Column) -> Column:
        idf = F.greatest(F.lit(0.0), F.log((n_docs - df + 0.5) / (df + 0.5) + 1))
        ratio = F.coalesce(length, tf) / F.coalesce(avg_length, F.lit(1.0))
        return idf * (tf * (self.k + 1)) / (tf + self.k * (1 - self.b + self.b * ratio))
