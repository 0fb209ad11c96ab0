"""What a caller asks for, validated before any DataFrame is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from tagtide.functions.aggregates import named

#: Rollup granularities and their widths in seconds, finest first.
GRANULARITIES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}

TAG_OPERATORS = ("!=", "=~")


def coarsest_within(interval: int) -> tuple[str, int] | None:
    """The coarsest granularity not wider than the interval; none below a minute."""
    fitting = [(n, w) for n, w in GRANULARITIES.items() if w <= interval]
    return fitting[-1] if fitting else None


@dataclass(frozen=True)
class QuerySpec:
    """One query. Both range ends are inclusive; ``None`` leaves an end open."""

    metric: str
    tag_filters: Mapping[str, object] = field(default_factory=dict)
    t_start: int | None = None
    t_end: int | None = None
    agg: str | None = None
    interval: int | None = None
    cross_agg: str | None = None
    group_by: str | None = None

    def __post_init__(self):
        for name in (self.agg, self.cross_agg):
            if name is not None:
                named(name)
        if self.interval is not None and self.interval <= 0:
            raise ValueError("interval must be a positive number of seconds")
        if self.group_by is not None and self.cross_agg is None:
            raise ValueError("group_by requires cross_agg")
        if self.cross_agg is not None and self.interval is None:
            raise ValueError("cross_agg requires interval")
        for key, wanted in (self.tag_filters or {}).items():
            check_condition(key, wanted)

    @property
    def point_agg(self) -> str:
        return self.agg or "avg"


def check_condition(key: str, wanted: object) -> None:
    if isinstance(wanted, str):
        return
    if isinstance(wanted, tuple) and len(wanted) == 2 and wanted[0] in TAG_OPERATORS and isinstance(wanted[1], str):
        return
    raise ValueError(f"tag {key!r}: expected a string, ('!=', string) or ('=~', pattern), got {wanted!r}")
