"""A mission as an object: settings, run, pause, resume, stop, and the tables that its screens show."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstream.config import Settings
from siltstream.operators import activity, mission, report, state

# The states of an engine.
STATES = ("starting", "running", "paused", "mission_complete", "finalizing", "stopping", "stopped", "error")


class Cached:
    """A small result kept for ``ttl`` seconds; ``forget`` drops it."""

    def __init__(self, read: Callable[[], dict], ttl: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.read, self.ttl, self.clock = read, ttl, clock
        self.at: float | None = None

    def __call__(self) -> dict:
        now = self.clock()
        if self.at is None or now - self.at >= self.ttl:
            self.value, self.at = self.read(), now
        return self.value

    def forget(self) -> None:
        self.at = None


class Engine:
    """Runs a mission over stored pages. A pause takes effect between rounds; each round's store is written.

    What a stopped or lost engine leaves is its last store, from which another goes on: addresses in progress there
    are pending again.
    """

    def __init__(self, pages: DataFrame, store: DataFrame, robots: DataFrame | None = None, settings: Settings | None = None, scope: str = "smart", lock: state.MissionLock | None = None, on_state: Callable[[str, str | None, str | None], None] | None = None) -> None:
        self.pages, self.robots, self.settings, self.scope, self.on_state = pages, robots, settings or Settings(), scope, on_state
        self.store, self.items, self.lock = state.cancelled(store), None, lock
        self.rounds, self.mode = 0, "stealth"
        self.status, self._go, self._stopped = "starting", threading.Event(), False
        self._go.set()
        self.stats = Cached(lambda: report.stats_map(self.store).first().asDict(), self.settings.stats_cache_ttl_seconds)

    def _change(self, status: str, reason: str | None = None) -> None:
        if status not in STATES:
            raise ValueError(f"unknown state {status!r}")
        before, self.status = self.status, status
        if self.on_state:
            self.on_state(status, before, reason)

    def pause(self) -> None:
        self._go.clear()
        self._change("paused", "user_request")

    def resume(self) -> None:
        self._go.set()
        self._change("running", "user_request")

    def is_paused(self) -> bool:
        return not self._go.is_set()

    def stop(self) -> None:
        """End after the round that runs; a paused engine ends at once."""
        self._stopped = True
        self._change("stopping", "user_request")
        self._go.set()

    def _between(self, store: DataFrame, rounds: int) -> bool:
        self.store = store
        self.stats.forget()
        self._go.wait()
        return not self._stopped

    def run(self) -> mission.Mission:
        """Rounds until nothing is pending or the engine is stopped. With a lock, one engine a site runs at a time."""
        if self.lock is not None and not self.lock.acquire():
            self._change("error", "locked")
            raise RuntimeError("another mission of this site is running")
        self._change("running")
        try:
            done = mission.run(self.pages, self.store, self.robots, self.scope, between=self._between)
        except Exception as failure:
            self._change("error", str(failure))
            raise
        finally:
            if self.lock is not None:
                self.lock.release()
        self.store, self.items, self.rounds = done.store, done.items, self.rounds + done.rounds
        self.stats.forget()
        self._change("finalizing")
        self._change("stopped" if self._stopped else "mission_complete")
        return done

    def activity_log(self) -> DataFrame:
        """The store as an activity log: its tried addresses in order of their last try."""
        tried = self.store.filter("last_try IS NOT NULL")
        status = F.when(F.col("status") == "failed", "error").when(F.col("status") == "skipped_robots", "warning").otherwise(F.col("status"))
        micros = F.unix_micros(F.col("last_try").cast("timestamp"))
        return tried.select(
            F.concat(F.lpad(micros.cast("string"), 20, "0"), F.lit("|"), F.col("url")).alias("seq"), F.col("last_try").alias("at"), "url", F.lit(None).cast("string").alias("title"),
            status.alias("status"), F.col("last_error").alias("error"), F.lit(None).cast("string").alias("engine"), F.col("type").alias("kind"),
        )

    def get_stats(self) -> dict:
        return self.stats()

    def get_dashboard_state(self) -> dict:
        """The state, the counts, and the share of addresses that are dealt with."""
        counts = self.stats()
        done = counts["completed"] + counts["failed"] + counts["skipped_robots"]
        return {"state": self.status, "paused": self.is_paused(), "rounds": self.rounds, "mode": self.mode, **counts, "percent": round(100 * done / counts["total"], 2) if counts["total"] else 0.0}

    def get_queue_status(self, limit: int = 100, offset: int = 0) -> DataFrame:
        return state.page(self.store.select("url", "status", "retries", F.col("last_error").alias("error")), limit, offset)

    def get_error_list(self, limit: int = 50) -> DataFrame:
        return activity.error_list(self.activity_log(), limit)

    def get_logs(self, level: str = activity.ALL_LEVELS, limit: int = 100) -> DataFrame:
        return activity.log_lines(self.activity_log(), limit, level)

    def get_config(self) -> dict:
        s = self.settings
        return {"workers": s.default_workers, "request_delay": int(s.request_delay * 1000), "timeout": s.timeout_seconds, "mode": self.mode}

    def update_config(self, workers: int | None = None, request_delay: int | None = None, timeout: int | None = None, mode: str | None = None) -> dict:
        """Change settings while running; values out of bounds change nothing. The delay is in milliseconds."""
        self.settings = self.settings.changed(workers, request_delay, timeout)
        if mode is not None:
            self.mode = "browser" if mode == "browser" else "stealth"
        return self.get_config()
