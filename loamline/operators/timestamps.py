"""Timestamps of mixed formats and zones in one form: yyyy-MM-ddTHH:mm:ss.SSSZ in UTC.

A value is reduced to its shape (digits all alike); each distinct shape is given to the parser once, which finds
what stands at which position, and all values of a shape are then converted together from fixed slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions import zones
from loamline.session import spread

#: Month names and their short forms in the languages the notes are written in, in order of the months.
MONTHS = [
    "january januar janvier enero jan ene janv jänner",
    "february februar février febrero feb fév fevr févr",
    "march märz mars marzo mar mär mrz",
    "april abril avril apr abr avr",
    "may mai mayo",
    "june juni juin junio jun",
    "july juli juillet julio jul juil",
    "august août agosto aug ago aou aoû",
    "september septembre septiembre sep sept set",
    "october oktober octobre octubre oct okt",
    "november novembre noviembre nov",
    "december dezember décembre diciembre dec dez déc dic",
]
MONTH = {name: i + 1 for i, names in enumerate(MONTHS) for name in names.split()}

#: Week days, which add nothing to a date.
WEEKDAYS = set(
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "montag dienstag mittwoch donnerstag freitag samstag sonntag mo di mi do fr sa so "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo".split()
)

WORD = re.compile(r"[^\W\d_]+")
#: Positions in a shape: Y year, N month or day by the order of the source, M month, D day, H hour, I minute, S second, F fraction, U Unix time.
DATES = [
    r"(?P<Y>0{4})-(?P<M>0{1,2})-(?P<D>0{1,2})",
    r"(?P<Y>0{4})/(?P<M>0{1,2})/(?P<D>0{1,2})",
    r"(?P<Y>0{4})\.(?P<M>0{1,2})\.(?P<D>0{1,2})",
    r"(?P<Y>0{4})(?P<M>00)(?P<D>00)",
    r"(?P<N>0{1,2})/(?P<O>0{1,2})/(?P<Y>0{4})",
    r"(?P<D>0{1,2})\.(?P<M>0{1,2})\.(?P<Y>0{4})",
    r"(?:~w\.?,? ?)?(?P<D>0{1,2})(?:~o)?\.?[ -](?:~f )?~m\.?,?[ -](?:~f )?(?P<Y>0{4})",
    r"(?:~w\.?,? ?)?~m\.? (?P<D>0{1,2})(?:~o)?,? (?P<Y>0{4})",
    r"(?P<Y>0{4})[ -]~m[ -](?P<D>0{1,2})",
]
MONTH_ONLY = [r"(?P<Y>0{4})[-/](?P<M>00)", r"~m\.? (?P<Y>0{4})", r"(?P<Y>0{4})"]
TIME = r"(?P<H>0{1,2}):(?P<I>00)(?::(?P<S>00)(?:[.,](?P<F>0{1,}))?)?(?: ?~p)?(?: ~u)?"
PLAIN_TIME = r"(?P<H>00)(?P<I>00)(?:(?P<S>00)(?:[.,](?P<F>0{1,}))?)?"
OFFSET = r"(?: ?(?:~z|(?P<sign>[+-])(?P<OH>00):?(?P<OI>00)?|~i|\[~i\]|~z(?P<gsign>[+-])(?P<GH>0{1,2})(?::?(?P<GI>00))?)(?:\[~i\])?)?"
GAP = r"(?:T|t|_| |,? ~a |, )"
WHOLE = [re.compile(d + r"(?:" + GAP + TIME + OFFSET + r")?") for d in DATES]
WHOLE += [re.compile(DATES[3] + r"[Tt]" + PLAIN_TIME + OFFSET), re.compile(DATES[0] + r"[Tt]" + PLAIN_TIME + OFFSET)]
WHOLE += [re.compile(d) for d in MONTH_ONLY]
UNIX = re.compile(r"-?0{9,20}(?:\.0+)?")
CANONICAL = re.compile(r"0000-00-00T00:00:00\.000Z")
NAMED_ZONE_PART = re.compile("[A-Za-z_]")
NAMED_ZONE = re.compile(r"[A-Za-z_]+(?:/[A-Za-z_+-]+)+")


@dataclass
class Parser:
    """What a shape says. ``at``: the slice of each field; the rest is the same in all values of the shape."""

    at: dict[str, tuple[int, int]] = field(default_factory=dict)
    month: int | None = None
    half: str | None = None
    offset: int | None = None
    zone: str | None = None
    unix: bool = False
    canonical: bool = False


def _coded(shape: str) -> tuple[str, list[int], dict[str, str]]:
    """The shape with its words as codes (~m month, ~w week day, ~p am or pm, ~z zone ...), and where each character came from."""
    text, origin, said, i = [], [], {}, 0
    while i < len(shape):
        code = word = None
        if not (i and NAMED_ZONE_PART.match(shape, i - 1)) and (m := NAMED_ZONE.match(shape, i)) and m.group() in zones.names():
            code, word = "i", m
        elif word := WORD.match(shape, i):
            low = word.group().lower()
            if low in MONTH and "m" not in said:
                code = "m"
            elif low in WEEKDAYS and "w" not in said and i == 0:
                code = "w"
            elif low in ("am", "pm"):
                code = "p"
            elif low in zones.ABBREVIATIONS and i and low != "z":
                code = "z"
            elif low == "z":
                code = "z"
            elif low in ("uhr", "h"):
                code = "u"
            elif low in ("at", "um", "à", "a"):
                code = "a"
            elif low in ("st", "nd", "rd", "th") and i and shape[i - 1] == "0":
                code = "o"
            elif low in ("of", "de"):
                code = "f"
        if code:
            said[code] = word.group()
            text += ["~", code]
            origin += [i, i]
            i = word.end()
        else:
            # A word without a meaning stays as it is, in one step: values may be very long.
            end = word.end() if word else i + 1
            text += shape[i:end]
            origin += range(i, end)
            i = end
    return "".join(text), [*origin, len(shape)], said


@lru_cache(maxsize=20_000)
def parser_of(shape: str) -> Parser | None:
    """The parser of a trimmed shape; None where it names no day."""
    if UNIX.fullmatch(shape):
        if re.fullmatch("0{14}", shape):
            return Parser(at={"Y": (0, 4), "M": (4, 6), "D": (6, 8), "H": (8, 10), "I": (10, 12), "S": (12, 14)})
        return Parser(unix=True)
    # "p. m." and the like, and p.m. as one word.
    coded, origin, said = _coded(re.sub(r"(?i)\b([ap])\. ?m\.", lambda m: m.group(1) + "m" + " " * (len(m.group()) - 2), shape).rstrip())
    for pattern in WHOLE:
        if m := pattern.fullmatch(coded):
            p = Parser(at={k: (origin[m.start(k)], origin[m.end(k)]) for k in m.groupdict() if m.start(k) >= 0 and len(k) <= 2})
            p.month = MONTH[said["m"].lower()] if "m" in said else None
            p.half = said["p"].lower() if "p" in said else None
            p.zone = said.get("i")
            p.canonical = bool(CANONICAL.fullmatch(shape))
            if (sign := m.groupdict().get("sign") or m.groupdict().get("gsign")) and p.zone is None:
                p.offset = 1 if sign == "+" else -1
            elif "z" in said and p.zone is None:
                p.offset = zones.ABBREVIATIONS[said["z"].lower()] * 60
            return p
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970, and whether there is such a day."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.where(ok, m, 1)] + (leap & (m == 2))
    ok &= d <= length
    months = ((np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1).astype("datetime64[M]")
    return months.astype("datetime64[D]").astype(np.int64) + np.where(ok, d, 1) - 1, ok


def _convert(p: Parser, shape: str, values: pa.Array, home: np.ndarray, day_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Milliseconds since 1970 of values of one shape, and which of them are instants."""
    n = len(values)
    if p.unix:
        # All values of a shape have as many digits, so they have one unit, and what it is cut off at has one place.
        down = shape.startswith("-")
        size = len(shape.lstrip("-").partition(".")[0])
        drop = 0 if size <= 14 else 3 if size <= 17 else 6
        whole = pc.cast(pc.utf8_slice_codeunits(values, int(down), int(down) + size - drop), pa.int64()).to_numpy(zero_copy_only=False)
        if size <= 11:
            part = pc.utf8_rpad(pc.utf8_slice_codeunits(values, int(down) + size + 1, int(down) + size + 4), 3, "0")
            whole = whole * 1000 + pc.cast(part, pa.int64()).to_numpy(zero_copy_only=False)
        out = -whole if down else whole
        return out, (out >= -62_135_596_800_000) & (out < 253_402_300_800_000)

    def number(key: str, default: int = 0) -> np.ndarray:
        if key not in p.at:
            return np.full(n, default, np.int64)
        return pc.cast(pc.utf8_slice_codeunits(values, *p.at[key]), pa.int64()).to_numpy(zero_copy_only=False)

    y = number("Y")
    if "N" in p.at:
        first, second = number("N"), number("O")
        d, m = np.where(day_first, first, second), np.where(day_first, second, first)
    else:
        m, d = (number("M", 1) if p.month is None else np.full(n, p.month)), number("D", 1)
    days, ok = _days(y, m, d)
    seconds = days * 86400
    ms = np.zeros(n, np.int64)
    if "H" in p.at:
        h, i, s = number("H"), number("I"), number("S")
        if p.half:
            ok &= (h >= 1) & (h <= 12)
            h = h % 12 + (12 if p.half == "pm" else 0)
        midnight = (h == 24) & (i == 0) & (s == 0)
        ok &= ((h < 24) | midnight) & (i < 60) & (s < 60)
        seconds = seconds + h * 3600 + i * 60 + s
        if "F" in p.at:
            a, b = p.at["F"]
            digits = min(3, b - a)
            ms = pc.cast(pc.utf8_slice_codeunits(values, a, a + digits), pa.int64()).to_numpy(zero_copy_only=False) * 10 ** (3 - digits)
        if p.offset is not None and ("OH" in p.at or "GH" in p.at):
            oh, oi = number("OH") + number("GH"), number("OI") + number("GI")
            ok &= (oh <= 18) & (oi < 60)
            seconds = seconds - p.offset * (oh * 3600 + oi * 60)
        elif p.offset is not None:
            seconds = seconds - p.offset
        else:
            for name in {p.zone} if p.zone else set(home.tolist()):
                at = np.ones(n, bool) if p.zone else home == name
                if z := zones.zone(name):
                    seconds[at] = z.to_utc(seconds[at])
                else:
                    ok &= ~at
    ok &= (seconds >= -62_135_596_800) & (seconds < 253_402_300_800)
    return seconds * 1000 + ms, ok


def _trimmed(values: pa.Array) -> pa.Array:
    return pc.utf8_trim_whitespace(values)


def normalise_values(values: pa.Array, home: pa.Array, order: pa.Array) -> pa.Array:
    """The instants of an array of strings in the one form; null where a value denotes none or has the form already."""
    n = len(values)
    out = np.full(n, None, object)
    if n:
        text = _trimmed(values)
        shapes = pc.replace_substring_regex(text, "[0-9]", "0").dictionary_encode()
        codes = shapes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        homes = np.array(home.to_pylist(), object)
        first = np.array([o != "mdy" for o in order.to_pylist()])
        same = pc.equal(text, values).fill_null(False).to_numpy(zero_copy_only=False)
        order_ = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order_], np.arange(len(shapes.dictionary) + 1))
        for k, shape in enumerate(shapes.dictionary.to_pylist()):
            # Long shapes are seldom met twice; remembering them would only fill the memory.
            p = parser_of(shape) if len(shape) <= 200 else parser_of.__wrapped__(shape)
            rows = order_[bounds[k] : bounds[k + 1]]
            if p is None or not len(rows):
                continue
            ms, ok = _convert(p, shape, text.take(pa.array(rows)), homes[rows], first[rows])
            ok &= ~(same[rows] & p.canonical)
            iso = np.datetime_as_string(ms.astype("datetime64[ms]"), unit="ms")
            out[rows[ok]] = [f"{x}Z" for x in iso[ok]]
    return pa.array(out, pa.string())


def normalised(df: DataFrame, keep: list[str], value: str, home_zone: str, date_order: str, utc: str = "utc") -> DataFrame:
    """``keep`` and the instant of ``value`` as ``yyyy-MM-ddTHH:mm:ss.SSSZ``, one row for each row of the input.

    Null where the value is null, empty, names no day or one that doesn't exist, or has that form already. A time
    without a zone is local to ``home_zone``: the first of two equal local times; a skipped one counts with the offset
    before the change. ``date_order`` (mdy, else day first) rules figures between slashes; with dots the day is first.
    No time of day means 00:00 UTC of the (first) day. A bare count is Unix time in seconds, milli-, micro- or
    nanoseconds by its size. Digits beyond milliseconds are cut off. An unknown home zone makes local times null, a
    null one is UTC. All workers must have the zone database of the driver. Rows aren't moved beyond the dealing out of a scan of too few splits.
    """

    release = zones.version()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if zones.version() != release:
            raise RuntimeError(f"the zone database of a worker is {zones.version()}, that of the driver {release}")
        for b in batches:
            k = len(keep)
            out = normalise_values(b.column(k), b.column(k + 1), b.column(k + 2))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], out], names=[*[f"c{i}" for i in range(k)], "utc"])

    rows = df.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)],
        F.col(value).cast("string").alias("value"),
        F.coalesce(F.col(home_zone), F.lit("UTC")).alias("home"),
        F.lower(F.coalesce(F.col(date_order), F.lit("dmy"))).alias("day_order"),
    )
    kinds = ", ".join(f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    out = rows.mapInArrow(run, f"{kinds}, utc string")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("utc").alias(utc))


#: Keys of the front matter whose values are dates.
DATE_KEYS = ["created", "created_at", "date", "modified", "updated", "updated_at"]


def document_dates(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """doc_no, field, utc: each date of each note that denotes an instant and isn't in the one form yet.

    The settings of a vault that are null, and those of vaults that have none, are those of vault 0; without vault 0
    they are UTC and day first. Repeated rows of a note count once.
    """
    zero = configs.where(F.col("vault_id") == 0).agg(F.max("home_zone"), F.max("date_order")).first()
    own = configs.groupBy("vault_id").agg(F.max("home_zone").alias("home_zone"), F.max("date_order").alias("date_order"))
    typed = [F.struct(F.lit(f"frontmatter.{k}").alias("field"), F.when(~F.col("frontmatter")[k]["is_list"], F.col("frontmatter")[k]["values"][0]).alias("value")) for k in DATE_KEYS]
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("created_at", "modified_at")], *typed)
    # The canonical form itself is no case; most values have it, so they are left out before they leave the JVM.
    ready = F.col("f.value").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\z")
    rows = spread(docs.select("doc_no", "vault_id", "created_at", "modified_at", "frontmatter")).select("doc_no", "vault_id", F.explode(fields).alias("f"))
    rows = rows.where(F.col("f.value").isNotNull() & ~ready & F.col("f.value").rlike("[0-9]") & F.col("doc_no").isNotNull())
    rows = rows.select("doc_no", "vault_id", "f.field", "f.value").join(own, "vault_id", "left")
    rows = rows.withColumn("home_zone", F.coalesce("home_zone", F.lit(zero[0] or "UTC"))).withColumn("date_order", F.coalesce("date_order", F.lit(zero[1] or "dmy")))
    out = normalised(rows, ["doc_no", "field"], "value", "home_zone", "date_order")
    return out.where(F.col("utc").isNotNull()).groupBy("doc_no", "field").agg(F.min("utc").alias("utc"))
