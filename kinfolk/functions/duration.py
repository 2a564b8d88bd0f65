"""Durations as text, rounded to milliseconds, such as 4m12s or 1h0m0.5s (MAP13)."""

from __future__ import annotations

from datetime import timedelta


def duration_text(d: timedelta) -> str:
    micros = d // timedelta(microseconds=1)
    ms = (abs(micros) + 500) // 1000
    sign = "-" if micros < 0 and ms else ""
    if ms == 0:
        return "0s"
    if ms < 1000:
        return f"{sign}{ms}ms"
    seconds, ms = divmod(ms, 1000)
    hours, rest = divmod(seconds, 3600)
    minutes, seconds = divmod(rest, 60)
    tail = f"{seconds}" + (f".{ms:03d}".rstrip("0") if ms else "") + "s"
    return sign + (f"{hours}h{minutes}m{tail}" if hours else f"{minutes}m{tail}" if minutes else tail)
