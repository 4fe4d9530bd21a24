"""Timestamps of mixed formats, precisions and zones brought to one UTC instant.

Every text is reduced to a mask of character classes (digit, letter, anything else as it is). A mask is mapped
to a parser once; the parser names the places of year, month, hour and so on, and all texts of that mask are
converted together. Wall-clock times go through transition tables made from the time-zone database on the
driver, with its version, so that every executor uses the same rules.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, END_YEAR = 2000, 2030
FIRST = 946_684_800  # seconds of 2000-01-01
END = 1_893_456_000  # seconds of 2030-01-01
MILLION = 1_000_000
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_NUMBER = {w: i + 1 for i, m in enumerate(MONTHS) for w in (m, m[:3])} | {"sept": 9}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
WEEKDAY_NUMBER = {w: i for i, d in enumerate(WEEKDAYS) for w in (d, d[:3])} | {"tues": 1, "thur": 3, "thurs": 3}
UTC_WORDS = ("UTC", "GMT", "UT", "Z")
WIDEST_OFFSET = 18 * 3600
REASONS = ("no_date_and_time", "impossible", "no_zone", "shown_twice", "never_shown", "out_of_range", "day_or_month")


# ---------------------------------------------------------------------------------- transition tables
@dataclass
class Zone:
    """``offset[i]`` seconds hold before ``change[i]`` (UTC seconds), the last one after all changes."""

    change: np.ndarray
    offset: np.ndarray
    letters: list[str]

    def at(self, utc: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.change, utc, "right")


@dataclass
class ZoneTables:
    version: str
    zones: dict[str, Zone] = field(default_factory=dict)
    folded: dict[str, str] = field(default_factory=dict)

    def get(self, name: str | None) -> Zone | None:
        return None if name is None else self.zones.get(self.folded.get(name.lower(), ""))


def database_version() -> str:
    """Version of the time-zone database that ``zoneinfo`` reads here."""
    for root in zoneinfo.TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            path = Path(root, name)
            if path.is_file() and (m := re.match(pattern, path.read_text(errors="replace")[:80])):
                return m[1]
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:  # noqa: BLE001 - no package either
        return "unknown"


def _zone(name: str) -> Zone:
    """Probe the zone weekly and bisect every change to the second."""
    info = zoneinfo.ZoneInfo(name)

    def state(second: int) -> tuple[int, str]:
        at = dt.datetime.fromtimestamp(second, info)
        return int(at.utcoffset().total_seconds()), at.tzname() or ""

    week = 7 * 86400
    low, old = FIRST - 2 * week, state(FIRST - 2 * week)
    changes, states = [], [old]
    while low < END + 2 * week:
        high = low + week
        new = state(high)
        if new != old:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if state(mid) == old else (a, mid)
            changes.append(b)
            new = state(b)
            states.append(new)
            if state(high) != new:  # a second change within the week
                low, old = b, new
                continue
        low, old = high, new
    return Zone(np.array(changes, np.int64), np.array([s[0] for s in states], np.int64), [s[1] for s in states])


@lru_cache(maxsize=1)
def zone_tables() -> ZoneTables:
    """Tables of all zones of the database, made once per driver."""
    tables = ZoneTables(database_version())
    for name in sorted(zoneinfo.available_timezones()):
        try:
            tables.zones[name] = _zone(name)
        except Exception:  # noqa: BLE001 - a name the database lists but can't load
            continue
        tables.folded[name.lower()] = name
    return tables


def _resolve(zone: Zone, wall: np.ndarray, words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall-clock seconds, and a code: -1, or the number of the reason.

    ``words`` holds abbreviations that decide between the readings of a time shown twice or never; an empty
    word decides nothing.
    """
    day = 86400
    i, j = zone.at(wall - day), zone.at(wall + day)
    early, late = zone.offset[i], zone.offset[j]
    a, b = wall - early, wall - late
    ok_a, ok_b = zone.offset[zone.at(a)] == early, zone.offset[zone.at(b)] == late
    same = early == late
    utc = np.where(ok_a, a, b)
    code = np.where(same | (ok_a ^ ok_b), -1, np.where(ok_a, 3, 4)).astype(np.int8)
    if words is not None:
        for word in np.unique(words):
            if not word:
                continue
            rows = np.flatnonzero((words == word) & (code >= 3))
            if len(rows):
                letters = np.array(zone.letters)
                is_a, is_b = letters[i[rows]] == word, letters[j[rows]] == word
                utc[rows] = np.where(is_a, a[rows], b[rows])
                code[rows] = np.where(is_a ^ is_b, -1, code[rows])
    return utc, code


# ---------------------------------------------------------------------------------- masks and parsers
_YEAR_FIRST = r"(?P<Y>9999)(?P<s>[-/.])(?P<m>99?)(?P=s)(?P<d>99?)"
_YEAR_LAST = r"(?P<p>99?)(?P<s>[-/.])(?P<q>99?)(?P=s)(?P<Y>9999)"
_DAY_MONTH = r"(?:(?P<wd>a{3,9}),? )?(?P<d>99?)(?P<s>[ -])(?P<mon>a{3,9})(?P=s)(?P<Y>9999)"
_MONTH_DAY = r"(?:(?P<wd>a{3,9}),? )?(?P<mon>a{3,9}) (?P<d>99?),? (?P<Y>9999)"
_TIME = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>aa)(?!a))?"
_ZONE = r"(?: ?(?P<off>[+-]99(?::?99)?)| ?(?P<z>a)| (?P<ab>a{2,5})| ?\((?P<ab2>a{2,5})\)| (?P<reg2>a+[/_](?:[a9/_+-])+))?(?: ?\[(?P<reg>[a9/_+-]+)\])?"
_DATES = (_YEAR_FIRST, _YEAR_LAST, _DAY_MONTH, _MONTH_DAY)
_FORMS = tuple(
    re.compile(p + _ZONE)
    for p in (
        *(d + r"(?:(?P<T>a)|,? +)" + _TIME for d in _DATES),
        *(_TIME + r",? " + d for d in _DATES),
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<T>a)| )(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?",
    )
)
_NUMBER = re.compile(r"(?P<n>9+)(?:\.(?P<f>9+))?")


@lru_cache(maxsize=65536)
def parser_for(mask: str) -> dict[str, tuple[int, int]] | None:
    """Places of the parts of all texts with this mask, or None if no form fits."""
    for form in (_NUMBER, *_FORMS):
        if m := form.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None and k != "s"}
    return None


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for k in range(*span):
        out = out * 10 + (chars[:, k] - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    a, b = span
    return np.ascontiguousarray(chars[:, a:b].astype(np.uint32)).view(f"U{b - a}")[:, 0]


def _lookup(words: np.ndarray, table: dict[str, int], missing: int) -> np.ndarray:
    distinct, code = np.unique(words, return_inverse=True)
    return np.array([table.get(w.lower(), missing) for w in distinct], np.int64)[code]


def _micros(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    a, b = span
    kept = min(b - a, 6)
    return _number(chars, (a, a + kept)) * 10 ** (6 - kept)


def _bare(chars: np.ndarray, spans: dict) -> tuple[np.ndarray, np.ndarray]:
    """Seconds, milli- or microseconds from 1970, whichever falls into the range."""
    a, b = spans["n"]
    long = b - a > 18
    value = _number(chars, (max(a, b - 18), b))
    fits = np.ones(len(chars), bool)
    if long:
        fits = (chars[:, a : b - 18] == 48).all(axis=1)
    digits = np.zeros((len(chars), 6), np.int64)
    if "f" in spans:
        x, y = spans["f"]
        kept = min(6, y - x)
        digits[:, :kept] = chars[:, x : x + kept] - 48
    utc = np.zeros(len(chars), np.int64)
    code = np.full(len(chars), 5, np.int8)
    for unit, places in ((1, 6), (1_000, 3), (MILLION, 0)):
        hit = fits & (value >= FIRST * unit) & (value < END * unit)
        fraction = digits[:, :places] @ (10 ** np.arange(places - 1, -1, -1)) if places else 0
        utc = np.where(hit, value * (MILLION // unit) + fraction, utc)
        code = np.where(hit, -1, code).astype(np.int8)
    return utc, code


def _civil(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
    months = (np.where(ok, year, 1970) - 1970) * 12 + np.where(ok, month, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    following = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    days = first + day - 1
    return days, ok & (days < following)


def _convert(chars: np.ndarray, spans: dict, zones: np.ndarray, day_first: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    n = len(chars)
    zero = np.zeros(n, np.int64)
    code = np.full(n, -1, np.int8)
    fail = lambda where, reason: code.__setitem__(where & (code == -1), reason)  # noqa: E731 - the first reason stays
    if "T" in spans:
        fail(~np.isin(_words(chars, spans["T"]), ["T", "t"]), 0)
    year = _number(chars, spans["Y"])
    if "p" in spans:
        p, q = _number(chars, spans["p"]), _number(chars, spans["q"])
        by_day, by_month = _civil(year, q, p), _civil(year, p, q)
        days = np.where(day_first == 1, by_day[0], by_month[0])
        exists = np.where(day_first == 1, by_day[1], by_month[1])
        open_ = day_first < 0  # nothing says which comes first: only one reading may exist
        days = np.where(open_ & by_day[1], by_day[0], days)
        exists = np.where(open_, by_day[1] | by_month[1], exists)
        fail(open_ & by_day[1] & by_month[1] & (p != q), 6)
    else:
        month = _lookup(_words(chars, spans["mon"]), MONTH_NUMBER, 0) if "mon" in spans else _number(chars, spans["m"])
        days, exists = _civil(year, month, _number(chars, spans["d"]))
    fail(~exists, 1)
    if "wd" in spans:
        weekday = _lookup(_words(chars, spans["wd"]), WEEKDAY_NUMBER, -1)
        fail(weekday != (days + 3) % 7, 1)
    hour, minute = _number(chars, spans["H"]), _number(chars, spans["M"])
    second = _number(chars, spans["S"]) if "S" in spans else zero
    if "ap" in spans:
        half = _lookup(_words(chars, spans["ap"]), {"am": 0, "pm": 12}, -1)
        fail((half < 0) | (hour < 1) | (hour > 12), 1)
        hour = hour % 12 + half
    fail((hour > 23) | (minute > 59) | (second > 59), 1)
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    fraction = _micros(chars, spans["f"]) if "f" in spans else zero

    utc = wall.copy()
    if "off" in spans:
        a, b = spans["off"]
        sign = np.where(chars[:, a] == ord("-"), -1, 1)
        off_minute = _number(chars, (b - 2, b)) if b - a > 3 else zero
        off = _number(chars, (a + 1, a + 3)) * 3600 + off_minute * 60
        fail((off_minute > 59) | (off > WIDEST_OFFSET), 1)
        utc = wall - sign * off
    elif "z" in spans:
        fail(~np.isin(_words(chars, spans["z"]), ["Z", "z"]), 0)
    else:
        names, words = zones, None
        if "reg" in spans or "reg2" in spans:
            names = _words(chars, spans.get("reg") or spans["reg2"]).astype(object)
        elif "ab" in spans or "ab2" in spans:
            words = np.char.upper(_words(chars, spans.get("ab") or spans["ab2"]))
            names = np.where(np.isin(words, UTC_WORDS), "UTC", zones)
        distinct, at = np.unique(np.array(["" if x is None else x for x in names], dtype=str), return_inverse=True)
        for k, name in enumerate(distinct):
            rows = np.flatnonzero(at == k)
            zone = tables.get(name)
            if zone is None:
                fail(np.isin(np.arange(n), rows), 2)
                continue
            utc[rows], found = _resolve(zone, wall[rows], None if words is None else words[rows])
            code[rows] = np.where(code[rows] == -1, found, code[rows])
    fail((utc < FIRST) | (utc >= END), 5)
    return utc * MILLION + fraction, code


def to_utc(texts: pa.Array, zones: list, day_first: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of a batch, and -1 or the number of the reason why there is none."""
    trimmed = pc.utf8_trim_whitespace(pc.fill_null(texts, ""))
    mask = pc.replace_substring_regex(pc.replace_substring_regex(trimmed, "[0-9]", "9"), "[A-Za-z]", "a").dictionary_encode()
    codes = mask.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(mask.dictionary) + 1))
    micros, reason = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int8)
    zones = np.array(zones, dtype=object)
    for k, shape in enumerate(mask.dictionary.to_pylist()):
        rows = order[bounds[k] : bounds[k + 1]]
        spans = parser_for(shape)
        if spans is None or not len(rows):
            continue
        chars = np.array(trimmed.take(pa.array(rows)).to_pylist(), dtype=f"U{len(shape)}").view(np.uint32).reshape(len(rows), len(shape)).astype(np.int64)
        micros[rows], reason[rows] = _bare(chars, spans) if "n" in spans else _convert(chars, spans, zones[rows], day_first[rows], tables)
    return micros, reason


def utc_instant(text: Column, zone: Column, day_first: Column, tables: ZoneTables | None = None) -> Column:
    """Struct ``utc_micros BIGINT, reason STRING`` of a text; exactly one of the two is null.

    A zone or an offset in the text rules; zone abbreviations mean ``zone`` and decide between the two readings
    of an hour shown twice; otherwise ``zone`` rules. Dates such as 3/4/2020 follow ``day_first``; where that is
    null only a date with one possible reading is taken. Null, empty and very long texts have the reason
    ``no_date_and_time``.
    """
    tables = tables or zone_tables()

    @F.pandas_udf("utc_micros bigint, reason string")
    def convert(texts: pd.Series, zones: pd.Series, firsts: pd.Series) -> pd.DataFrame:
        first = np.array([-1 if x is None or x != x else int(x) for x in firsts], np.int64)
        micros, code = to_utc(pa.array(texts, pa.string(), from_pandas=True), [None if z is None or z != z else z for z in zones], first, tables)
        found = code == -1
        words = np.array([*REASONS, None], dtype=object)
        return pd.DataFrame({"utc_micros": pd.Series(micros, dtype="Int64").mask(~found), "reason": words[code]})

    return convert(text, zone, day_first)


def with_utc(rows: DataFrame, feeds: DataFrame, text: str = "timestamp", key: str = "feed_id") -> DataFrame:
    """``rows`` with ``utc_micros`` and ``utc_reason``, zone and date order coming from the feed of each row.

    Rows without a feed, or with one that ``feeds`` lacks, have no zone of their own. Columns of those names
    that exist are replaced. Where ``feeds`` lists a feed twice its greatest entry counts.
    """
    habits = feeds.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__feed")).agg(F.max(F.struct("clock_zone", "day_first")).alias("__habit"))
    joined = rows.join(habits, rows[key] == habits["__feed"], "left")
    out = joined.withColumn("__utc", utc_instant(F.col(text), F.col("__habit.clock_zone"), F.col("__habit.day_first")))
    return out.withColumns({"utc_micros": F.col("__utc.utc_micros"), "utc_reason": F.col("__utc.reason")}).drop("__feed", "__habit", "__utc")


# ---------------------------------------------------------------------------------- epoch numbers of events
def usable_seconds(stamp: Column) -> Column:
    """Whole seconds since 1970 of a number in seconds, milli-, micro- or nanoseconds; null unless positive."""
    stamp = stamp.cast("bigint")
    per = F.when(stamp >= 10**17, F.lit(10**9)).when(stamp >= 10**14, F.lit(10**6)).when(stamp >= 10**11, F.lit(10**3)).otherwise(F.lit(1))
    return F.when(stamp > 0, (stamp - stamp % per) / per).cast("bigint")
