"""Loops around the engine: polling sections, rechecking models, purging."""

from __future__ import annotations

import logging
import threading

from .engine import Engine
from .health import wait_times

log = logging.getLogger(__name__)


def run_forever(engine: Engine, stop: threading.Event) -> None:
    """Poll at the configured interval until ``stop`` is set; a pass that fails is logged, and the next one comes."""
    while not stop.wait(engine.config.daemon_poll_seconds):
        try:
            engine.poll()
        except Exception:  # noqa: BLE001  one bad pass must not end the loop
            log.exception("a pass over the sections failed")


def recheck_forever(engine: Engine, stop: threading.Event) -> None:
    """Check unhealthy models again, at intervals that double up to the configured longest while any stays unhealthy."""
    d = engine.config.defaults
    times = iter(wait_times(d.retry_interval_seconds, d.retry_interval_max_seconds))
    while not stop.wait(next(times)):
        if all(h.status != "unhealthy" for h in engine.health.recheck()):
            times = iter(wait_times(d.retry_interval_seconds, d.retry_interval_max_seconds))


def start(engine: Engine) -> tuple[threading.Event, list[threading.Thread]]:
    """Check all models, then both loops in threads; ingestion never starts by itself. Set the event to end them."""
    engine.health.check_all()
    stop = threading.Event()
    loops = [recheck_forever, *([run_forever] if engine.config.daemon_enabled else [])]
    threads = [threading.Thread(target=f, args=(engine, stop), daemon=True) for f in loops]
    for t in threads:
        t.start()
    return stop, threads


def purge_report(engine: Engine) -> dict:
    """What a purge removed: by section, and in all."""
    removed = engine.purge()
    return {"sections": removed, "total": sum(len(v) for v in removed.values() if isinstance(v, list))}
