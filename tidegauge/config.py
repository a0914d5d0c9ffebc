"""Settings of the engine and the interfaces that can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from .functions.granularity import LADDER
from .functions.scalars import SHARDS


@dataclass(frozen=True)
class EngineConfig:
    """The defaults that operators use if nothing else is given."""

    shards: int = SHARDS
    past_ms: int = 3 * 86_400_000
    future_ms: int = 600_000
    rollup_delay_ms: int = 300_000
    short_delay_ms: int = 300_000
    long_delay_ms: int = 7_200_000
    reroll_span_ms: int = 3 * 86_400_000
    discovery_per_minute: int = 50_000
    discovery_per_tenant_minute: int = 500
    discovery_limit: int = 10_000
    metrics_per_request: int = 100
    repair_on_read: bool = True
    force_ttl_s: int | None = None
    points_algorithm: str = "GEOMETRIC"
    ttl_days: dict[str, int] = field(default_factory=lambda: {g.short: g.ttl_days for g in LADDER})


class Discovery(Protocol):
    """Finds series by glob."""

    def search(self, index: DataFrame, tenant: str, queries: list[str], limit: int | None = None) -> DataFrame: ...


class NameSearch(Protocol):
    """Names one level deep."""

    def __call__(self, index: DataFrame, tenant: str, query: str) -> DataFrame: ...


class Events(Protocol):
    """Finds annotations."""

    def __call__(self, events: DataFrame, tenant: str, tags: str | None = None, start: int | None = None, until: int | None = None, limit: int | None = None) -> DataFrame: ...


#: name -> implementation; an application registers its own under a new name.
MODULES: dict[str, dict[str, object]] = {"discovery": {}, "names": {}, "events": {}, "listeners": {}}


def register(kind: str, name: str, module: object) -> None:
    if kind not in MODULES:
        raise ValueError(f"no kind of module {kind!r}")
    MODULES[kind][name] = module


def module(kind: str, name: str) -> object:
    return MODULES[kind][name]
