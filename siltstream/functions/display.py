"""What states, levels, errors and phases are shown as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and colours by what they stand for, and the mark of anything else.
STATUS_ICONS = ({"pending": "⏳", "running": "▶", "done": "✓", "failed": "✗", "completed": "✓", "error": "✗"}, "●")
ERROR_ICONS = ({"TimeoutError": "⏱️", "ConnectionError": "🔌", "HTTPError": "🌐", "CaptchaError": "🤖", "ParseError": "📄", "RobotsBlockedError": "🚫"}, "❌")
LEVEL_ICONS = ({"DEBUG": "🔹", "INFO": "ℹ️", "WARNING": "⚠️", "ERROR": "❌"}, "•")
REPORT_COLOURS = ({"completed": "green", "failed": "red"}, "yellow")
PHASES = ({"extract_links": "discovery", "download_asset": "writing", "process_page": "extraction", "throttle": "rate_limit"}, "idle")
PHASE_COLOURS = ({"discovery": "cyan", "extraction": "green", "writing": "magenta", "rate_limit": "yellow", "retry": "orange", "circuit_open": "red", "circuit_half_open": "yellow", "idle": "dim"}, "dim")
# What a state, a mode or a breaker may be, and what anything else is taken for.
MODES = (("stealth", "browser"), "stealth")
CIRCUITS = (("closed", "open", "half-open"), "closed")


def looked_up(value: str | Column, table: tuple[dict[str, str], str]) -> Column:
    """The entry of a fixed table; anything else, null included, gets the table's default."""
    entries, default = table
    found = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    return F.coalesce(F.try_element_at(found, F.col(value) if isinstance(value, str) else value), F.lit(default))


def one_of(value: str | Column, allowed: tuple[tuple[str, ...], str]) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isin(*allowed[0]), v).otherwise(allowed[1])


def speed_arrow(now: str | Column, mean: str | Column, margin: float = 0.1) -> Column:
    """Whether the speed is above, below or about its mean."""
    n, m = (F.col(x) if isinstance(x, str) else x for x in (now, mean))
    return F.when(n > (1 + margin) * m, "↑").when(n < (1 - margin) * m, "↓").otherwise("→")
