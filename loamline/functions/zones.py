"""Zone transition tables: offsets from UTC by instant and by local time, for whole arrays."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import lru_cache
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np

#: Before the first, zones have their first offset. After 2037 they follow rules by month and week day, and the calendar repeats every 400 years.
FIRST, LAST = datetime(1800, 1, 1, tzinfo=UTC), datetime(2440, 1, 1, tzinfo=UTC)
STEP = timedelta(days=7)
CYCLE = 146_097 * 86_400

#: Minutes from UTC of the zone abbreviations in general use in Europe, North America and Japan.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "ut": 0, "z": 0, "wet": 0, "west": 60, "bst": 60, "ist": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "jst": 540,
}


@lru_cache(maxsize=1)
def version() -> str:
    """The release of the zone database the tables are made from."""
    for folder in TZPATH:
        if (listing := Path(folder, "tzdata.zi")).exists():
            with listing.open() as f:
                return f.readline().removeprefix("# version").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1)
def names() -> frozenset[str]:
    return frozenset(available_timezones())


class Zone:
    """The offsets of one zone, in seconds, and the instants at which they change."""

    def __init__(self, name: str):
        self.name, self.version = name, version()
        zone = ZoneInfo(name)
        at = lambda t: int(t.astimezone(zone).utcoffset().total_seconds())
        changes, offsets = [], [at(FIRST)]
        a = FIRST
        while a < LAST:
            b = a + STEP
            if at(a) != at(b):
                low, high = a, b
                while high - low > timedelta(seconds=1):
                    mid = low + timedelta(seconds=int((high - low).total_seconds()) // 2)
                    low, high = (mid, high) if at(mid) == at(low) else (low, mid)
                changes.append(int(high.timestamp()))
                offsets.append(at(high))
            a = b
        self.changes, self.offsets = np.array(changes, np.int64), np.array(offsets, np.int64)
        # A local time below the later of the two readings of a change still has the offset before it: it is either
        # the first of two equal times or skipped.
        self.locals = self.changes + np.maximum(self.offsets[:-1], self.offsets[1:])

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        """Seconds since 1970 of local seconds: the first of two equal times, the offset before the change of one that is skipped."""
        end = int(LAST.timestamp()) - 86_400
        within = np.where(local < end, local, local - -(-(local - end + 1) // CYCLE) * CYCLE)
        return local - self.offsets[np.searchsorted(self.locals, within, side="right")]


@lru_cache(maxsize=1024)
def zone(name: str) -> Zone | None:
    return Zone(name) if name in names() else None
