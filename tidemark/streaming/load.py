"""What came in, what was read and what was left out, by source, while a stream runs."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field


@dataclass
class Load:
    """Counts of one source. Only sums by level are kept, so it stays small however long the stream runs."""

    source: str = ""
    offered: int = 0
    parsed: int = 0
    left_out: Counter = field(default_factory=Counter)
    peak: int = 0
    lag: float = 0.0
    mode: str = "full"
    seconds: float = 0.0
    error: str | None = None
    worker: int | None = None

    def took(self, offered: int, left_out: dict[str, int], began: float, mode: str, lag: float | None = None) -> None:
        """Adds a micro-batch that began at a time.monotonic()."""
        self.offered += offered
        self.left_out.update({(level or "").upper(): n for level, n in left_out.items()})
        self.parsed += offered - sum(left_out.values())
        self.peak, self.mode = max(self.peak, offered), mode
        self.lag = self.lag if lag is None else max(0.0, lag)
        self.seconds += time.monotonic() - began

    @property
    def dropped(self) -> int:
        return self.left_out.total()

    def to_dict(self) -> dict:
        rate = self.parsed / self.seconds if self.seconds > 0 else 0.0
        counted = {"lines_in": self.offered, "lines_parsed": self.parsed, "lines_dropped": self.dropped, "dropped_by_level": dict(sorted(self.left_out.items()))}
        state = {"queue_peak": self.peak, "lag_seconds": round(self.lag, 3), "mode": self.mode, "lines_per_sec": round(rate, 1), "elapsed_seconds": round(self.seconds, 3)}
        return {"source": self.source, "worker": self.worker} | counted | state | {"ok": self.error is None, "error": self.error}


def total(loads: list[Load]) -> dict:
    """The loads of all sources together, by name."""
    return {
        "total_parsed": sum(x.parsed for x in loads),
        "total_dropped": sum(x.dropped for x in loads),
        "degraded": any(x.mode != "full" for x in loads),
        "faulted": sorted(x.source for x in loads if x.error),
        "by_source": [x.to_dict() for x in sorted(loads, key=lambda x: x.source)],
    }
