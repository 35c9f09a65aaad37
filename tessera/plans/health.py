"""What is known of each embedding model's service."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from tessera.sources.embedding import Embedder, dimension


@dataclass
class Health:
    model: str
    status: str = "unknown"  # unknown, checking, healthy or unhealthy
    embedding_dim: int | None = None
    error: str | None = None
    checked_at: float | None = None


class HealthRegistry:
    """Models are taken as usable until a check fails: only unhealthy ones, and those being checked, block dense search."""

    def __init__(self, embedder: Embedder, models: Iterable[str], clock: Callable[[], float] = time.time):
        self.embedder, self.clock = embedder, clock
        self.models = {m: Health(m) for m in models}

    def get(self, model: str) -> Health:
        return self.models.setdefault(model, Health(model))

    def blocked(self, model: str) -> bool:
        return self.get(model).status in ("checking", "unhealthy")

    def mark(self, model: str, dim: int | None = None, error: str | None = None) -> Health:
        h = self.get(model)
        h.status, h.error, h.checked_at = ("unhealthy" if error else "healthy"), error, self.clock()
        h.embedding_dim = dim or h.embedding_dim
        return h

    def check(self, model: str) -> Health:
        self.get(model).status = "checking"
        try:
            return self.mark(model, dim=dimension(self.embedder, model))
        except Exception as e:  # noqa: BLE001  whatever the service does, the model is unhealthy
            return self.mark(model, error=str(e))

    def check_all(self) -> list[Health]:
        return [self.check(m) for m in self.models]

    def recheck(self) -> list[Health]:
        """Only those that are unhealthy."""
        return [self.check(m) for m, h in self.models.items() if h.status == "unhealthy"]

    def snapshot(self) -> list[dict]:
        return [asdict(self.models[m]) for m in sorted(self.models)]


def wait_times(first: float, longest: float) -> Iterable[float]:
    """Seconds between rechecks: doubling up to the longest."""
    while True:
        yield min(first, longest)
        first *= 2
