"""Index configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from vellum.functions.analysis import Analyzer, get_analyzer


@dataclass(frozen=True)
class IndexConfig:
    """Which analyzer a field has, which fields aren't stored or aren't indexed, and how much a field's scores count."""

    analyzers: dict[str, str] = field(default_factory=dict)
    no_store: tuple[str, ...] = ()
    no_index: tuple[str, ...] = ()
    boost: dict[str, float] = field(default_factory=dict)

    def analyzer(self, name: str) -> Analyzer:
        return get_analyzer(self.analyzers.get(name, "standard"))


@dataclass(frozen=True)
class MergePolicy:
    max_segments: int = 10
    merge_count: int = 4
