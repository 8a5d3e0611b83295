"""Timestamps written in many formats and zones, turned into microseconds since 1970-01-01 UTC.

Each value is reduced to a mask of its character classes. A batch has few distinct masks; each is compiled once into the
places of its fields, and all values of a mask are then read as one matrix of bytes. Local times go to UTC through tables
of zone transitions, taken on the driver from one version of the zone database and shipped with the plan.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cache, lru_cache
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.columnar import from_buffers, one_chunk, padded, string_buffers
from tallyforge.session import arrow_map

MICRO = 1_000_000
#: Zones have fixed yearly rules from here on; local times CYCLE years later or more are read at their place in the cycle of
#: the Gregorian calendar before.
STEADY_FROM, CYCLE = 2100, 400
CYCLE_SECONDS = 146_097 * 86_400


# Zones


def _tzif(name: str) -> bytes:
    for base in TZPATH:
        if (p := Path(base, *name.split("/"))).is_file():
            return p.read_bytes()
    return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()


@cache
def zone_version() -> str:
    """Version of the zone database that transition tables come from."""
    for base in TZPATH:
        for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)")):
            if (p := Path(base, name)).is_file() and (m := re.match(pattern, p.read_text(errors="replace"))):
                return m[1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@dataclass(frozen=True)
class Zone:
    """Offsets of a zone. Local time l has offset offsets[i], i the number of thresholds up to l; names are the abbreviations
    that go with the offsets.

    A threshold is the local time from which the new offset holds: after a skipped hour its end, so that a skipped time
    still counts by the old offset and moves on by the gap; after a repeated hour its end too, so that a time that
    occurs twice is the earlier instant, unless it has the abbreviation of the offset after the change.
    """

    name: str
    thresholds: np.ndarray
    offsets: np.ndarray
    names: np.ndarray

    def to_utc(self, local: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
        """side: an abbreviation for each local time, or empty; it only tells which of two instants is meant."""
        late = np.maximum(local - self._end(), 0)
        at = local - -(-late // CYCLE_SECONDS) * CYCLE_SECONDS
        i = np.searchsorted(self.thresholds, at, "right")
        if side is not None and len(self.thresholds):
            nxt = np.minimum(i, len(self.thresholds) - 1)
            repeated = self.offsets[nxt] - self.offsets[nxt + 1]  # length of the time that the next change repeats
            named = (side == self.names[nxt + 1]) & (side != self.names[nxt])
            i = np.where((i == nxt) & (at >= self.thresholds[nxt] - repeated) & (repeated > 0) & named, i + 1, i)
        return local - self.offsets[i]

    @staticmethod
    @cache
    def _end() -> int:
        """The local second where the cycle that the tables hold ends."""
        return int(datetime(STEADY_FROM + CYCLE, 1, 1, tzinfo=UTC).timestamp())


def _transitions(name: str) -> tuple[list[int], list[int], list[str]]:
    """UTC seconds of the changes of offset, and the offsets with their abbreviations: one before the first, one after each."""
    raw = _tzif(name)
    if raw[:4] != b"TZif":
        raise ValueError(f"{name} is no zone file")

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", raw[at + 20 : at + 44])

    at, wide = 0, raw[4:5] >= b"2"
    if wide:
        isut, isstd, leap, times, types, chars = counts(0)
        at = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
    _, _, _, times, types, chars = counts(at)
    at += 44
    size = 8 if wide else 4
    when = list(struct.unpack(f">{times}{'q' if wide else 'l'}", raw[at : at + times * size]))
    kinds = raw[at + times * size : at + times * (size + 1)]
    entries = [struct.unpack(">lbB", raw[at + times * (size + 1) + 6 * i :][:6]) for i in range(types)]
    letters = raw[at + times * (size + 1) + 6 * types :][:chars]
    offs, short = [e[0] for e in entries], [letters[e[2] :].split(b"\0")[0].decode() for e in entries]
    zone = ZoneInfo(name)

    def offset(t: int) -> int:
        return int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())

    after, names = [offs[k] for k in kinds], [short[k] for k in kinds]
    # rules after the last listed change: probed in steps shorter than any rule's season
    t, end = (max(when[-1], 0) // 900 * 900 if when else 0), Zone._end()
    last = after[-1] if after else offs[0]
    while t < end:
        nxt = t + 21 * 86400
        if (o := offset(nxt)) != last:
            lo, hi = t, nxt
            for unit in (900, 1):  # rules change on a quarter of an hour, as a rule
                while hi - lo > unit and not (unit == 1 and offset(hi - 1) == last):
                    mid = lo + (hi - lo) // unit // 2 * unit
                    lo, hi = (mid, hi) if offset(mid) == last else (lo, mid)
            when.append(hi)
            after.append(o)
            names.append(datetime.fromtimestamp(hi, zone).tzname())
            last = o
        t = nxt
    return when, [offs[0], *after], [short[0], *names]


@cache
def load_zone(name: str) -> Zone | None:
    if not re.fullmatch(r"[A-Za-z0-9_+-]+(/[A-Za-z0-9_+-]+){0,2}", name):
        return None
    try:
        when, offs, names = _transitions(name)
    except (OSError, ValueError, KeyError, ModuleNotFoundError):
        return None
    thresholds = [w + max(a, b) for w, a, b in zip(when, offs, offs[1:])]
    return Zone(name, np.maximum.accumulate(np.array(thresholds, np.int64)) if thresholds else np.zeros(0, np.int64), np.array(offs, np.int64), np.array([n.encode() for n in names], "S8"))


# Masks

_DIGIT, _LETTER = ord("9"), ord("a")
_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[ord("0") : ord("9") + 1] = _DIGIT
_CLASSES[ord("A") : ord("Z") + 1] = _LETTER
_CLASSES[ord("a") : ord("z") + 1] = _LETTER

#: English month names, by their first three letters and in full.
MONTHS = "January February March April May June July August September October November December".split()

_DATE = r"""(?:
  (?P<y>9{4})(?P<s1>[-/.])(?P<m>99?)(?P=s1)(?P<d>99?)
 |(?P<yc>9{4})(?P<mc>99)(?P<dc>99)
 |(?P<yk>9{4})年\ ?(?P<mk>99?)月\ ?(?P<dk>99?)日
 |(?P<a>99?)(?P<s2>[-/.])(?P<b>99?)(?P=s2)(?P<yl>9{4})
 |(?:(?P<wd>a{3,9}),?\ +)?(?P<dn>99?)(?:\ +|-)(?P<mn>a{3,9})\.?(?:,?\ +|-)(?P<yn>9{4})
 |(?:(?P<we>a{3,9}),?\ +)?(?P<mo>a{3,9})\.?\ +(?P<do>99?),?\ +(?P<yo>9{4})
)"""
_TIME = r"""(?:(?P<sep>a|,?\ +)(?:(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?|(?P<Hc>99)(?P<Mc>99)(?:(?P<Sc>99)(?:[.,](?P<fc>9+))?)?))"""
_ZONE = r"""(?:(?P<u>a)|\ ?(?P<sg>[-+])(?P<oh>99):?(?P<om>99)?(?:\ ?\((?P<oa>a{2,5})\))?(?:\[(?P<on>[a9_/+-]+)\])?|\ (?P<ab>a{2,5})|\ ?\[(?P<br>[a9_/+-]+)\]|\ (?P<nm>a+(?:/[a9_+-]+){1,2}))"""
_FORM = re.compile(rf"{_DATE}(?:{_TIME}(?:\ ?(?P<ap>aa)(?=\ |$|[-+\[]))?{_ZONE}?)?", re.X)
_FORM_NO_AP = re.compile(rf"{_DATE}(?:{_TIME}{_ZONE}?)?", re.X)


@dataclass
class Parser:
    """Byte places of the fields in values of one mask. number: no date but a bare number."""

    number: bool = False
    local_order: bool = False
    spots: dict[str, tuple[int, int]] = field(default_factory=dict)
    sign: int = -1


#: Longer masks are compiled anew in each batch, so that the memory of the kept ones is bounded.
_KEPT_MASK, _KEPT_MASKS = 128, 1 << 14


@lru_cache(maxsize=_KEPT_MASKS)
def parsers_of(mask: str) -> tuple[Parser, ...]:
    """The ways to read a mask, kept for the next batches."""
    return compiled(mask)


def compiled(mask: str) -> tuple[Parser, ...]:
    """The ways to read a mask, to be tried in turn; none if it can be no timestamp."""
    if re.fullmatch(r"9{9,19}", mask):
        return (Parser(number=True),)
    out = []
    for form in (_FORM, _FORM_NO_AP):
        m = form.fullmatch(mask)
        if m is None or (out and m.groupdict().get("ap") is None and out[0].spots.get("ap") is None):
            continue
        width = lambda i: len(mask[:i].encode())
        spots = {k: (width(m.start(k)), width(m.end(k))) for k, v in m.groupdict().items() if v is not None}
        out.append(Parser(local_order="yl" in spots, spots=spots, sign=spots.get("sg", (-1, -1))[0]))
    return tuple(out)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the Gregorian calendar carried on backwards."""
    first = (y.astype("datetime64[Y]", copy=False) if y.dtype.kind == "M" else (y - 1970).astype("datetime64[Y]")).astype("datetime64[M]") + (m - 1).astype("timedelta64[M]")
    return first.astype("datetime64[D]").astype(np.int64) + d - 1


def _month_lengths(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[m - 1] + ((m == 2) & leap)


_MONTH_OF = {name.lower().encode(): i + 1 for i, full in enumerate(MONTHS) for name in (full, full[:3])} | {b"sept": 9}
_WEEKDAYS = {w[:k].encode() for w in "monday tuesday wednesday thursday friday saturday sunday".split() for k in (3, 4, len(w))}


class Converter:
    """Turns a batch of texts into instants. zones: those of the rows, by number, of this version of the zone database; others
    are loaded when a text names them, from a database of the same version only."""

    def __init__(self, zones: list[Zone | None], version: str | None = None):
        self.zones, self.version = list(zones), version
        self.number = {z.name: i for i, z in enumerate(self.zones) if z is not None}

    def named(self, name: str) -> int:
        if name not in self.number:
            if self.version is not None and zone_version() != self.version:
                raise RuntimeError(f"this worker's zone database is {zone_version()}, the driver's {self.version}")
            self.number[name] = len(self.zones)
            self.zones.append(load_zone(name))
        return self.number[name]

    def __call__(self, texts: pa.Array, zone: np.ndarray, month_first: np.ndarray, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(micros, readable). zone: number of each row's zone, -1 if unknown. Micros are cut down to a multiple of unit."""
        texts = pc.utf8_trim_whitespace(one_chunk(texts))
        n = len(texts)
        out, ok = np.zeros(n, np.int64), np.zeros(n, bool)
        rows = np.flatnonzero(np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 5), False)))
        if not len(rows):
            return out, ok
        raw, offsets, _ = string_buffers(texts.take(pa.array(rows)))
        masks = from_buffers(_CLASSES[raw], offsets).dictionary_encode()
        code = masks.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[order], np.arange(len(masks.dictionary) + 1))
        for c, mask in enumerate(masks.dictionary.to_pylist()):
            left = order[edges[c] : edges[c + 1]]
            for p in parsers_of(mask) if len(mask) <= _KEPT_MASK else compiled(mask):
                if not len(left):
                    break
                size = int(offsets[left[0] + 1] - offsets[left[0]])
                m = padded(raw, offsets[left], np.full(len(left), size), size)
                at = rows[left]
                got, fine = self._number(m) if p.number else self._date(p, m, zone[at], month_first[at])
                out[at[fine]], ok[at[fine]] = got[fine], True
                left = left[~fine]
        return np.where(ok, out - out % unit, 0), ok

    @staticmethod
    def _digits(m: np.ndarray, a: int, b: int) -> np.ndarray:
        v = np.zeros(len(m), np.int64)
        for i in range(a, b):
            v = v * 10 + (m[:, i] - 48)
        return v

    def _number(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if m.shape[1] > 19:
            return np.zeros(len(m), np.int64), np.zeros(len(m), bool)
        v = np.zeros(len(m), np.uint64)
        for i in range(m.shape[1]):
            v = v * np.uint64(10) + (m[:, i] - 48).astype(np.uint64)
        out, ok = np.zeros(len(m), np.int64), np.zeros(len(m), bool)
        lo, hi = int(datetime(2007, 1, 1, tzinfo=UTC).timestamp()), int(datetime(2026, 1, 1, tzinfo=UTC).timestamp())
        for per_second in (1, 10**3, 10**6, 10**9):
            fits = (v >= np.uint64(lo * per_second)) & (v < np.uint64(hi * per_second))
            w = v[fits].astype(np.int64)
            out[fits] = w * (MICRO // per_second) if per_second <= MICRO else w // (per_second // MICRO)
            ok |= fits
        return out, ok

    @staticmethod
    def _words(m: np.ndarray, spot: tuple[int, int], to: dict[bytes, int] | set[bytes]) -> np.ndarray:
        """Each row's word looked up, without case; 0 if it isn't there."""
        part = np.ascontiguousarray(m[:, spot[0] : spot[1]] | 32)
        names, inverse = np.unique(part.view(f"S{spot[1] - spot[0]}").ravel(), return_inverse=True)
        found = [to.get(x, 0) if isinstance(to, dict) else int(x in to) for x in names.tolist()]
        return np.array(found, np.int64)[inverse]

    def _date(self, p: Parser, m: np.ndarray, zone: np.ndarray, month_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, n = p.spots, len(m)
        num = lambda k, default=0: self._digits(m, *s[k]) if k in s else np.full(n, default, np.int64)
        ok = np.ones(n, bool)
        if p.local_order:
            a, b, y = num("a"), num("b"), num("yl")
            mo, d = np.where(month_first, a, b), np.where(month_first, b, a)
        elif "mn" in s or "mo" in s:
            word, k = ("mn", "n") if "mn" in s else ("mo", "o")
            mo, d, y = self._words(m, s[word], _MONTH_OF), num(f"d{k}"), num(f"y{k}")
            if weekday := s.get("wd") or s.get("we"):
                ok &= self._words(m, weekday, _WEEKDAYS) > 0
        else:
            k = next(x for x in ("", "c", "k") if f"y{x}" in s)
            y, mo, d = num(f"y{k}"), num(f"m{k}"), num(f"d{k}")
        c = "c" if "Hc" in s else ""
        h, mi, se = num(f"H{c}"), num(f"M{c}"), num(f"S{c}")
        if "sep" in s and m[0, s["sep"][0]] | 32 >= _LETTER and s["sep"][1] - s["sep"][0] == 1:
            letter = m[:, s["sep"][0]] | 32
            ok &= letter == ord("t")
        if "ap" in s:
            a, b = s["ap"]
            first, second = m[:, a] | 32, m[:, b - 1] | 32
            ok &= np.isin(first, (ord("a"), ord("p"))) & (second == ord("m")) & (h >= 1) & (h <= 12)
            h = h % 12 + np.where(first == ord("p"), 12, 0)
        ok &= (y >= 1) & (mo >= 1) & (mo <= 12) & (h <= 23) & (mi <= 59) & (se <= 59) & (d >= 1)
        ok &= d <= _month_lengths(y, np.clip(mo, 1, 12))
        micros = np.zeros(n, np.int64)
        if f := s.get("f") or s.get("fc"):
            digits = min(6, f[1] - f[0])
            micros = self._digits(m, f[0], f[0] + digits) * 10 ** (6 - digits)
        local = np.where(ok, _days(np.where(ok, y, 1970), np.where(ok, mo, 1), np.where(ok, d, 1)), 0) * 86400 + h * 3600 + mi * 60 + se

        if "sg" in s:
            oh, om = num("oh"), num("om")
            ok &= (oh <= 18) & (om <= 59)
            utc = local - np.where(m[:, p.sign] == ord("-"), -1, 1) * (oh * 3600 + om * 60)
        elif "u" in s:
            ok &= m[:, s["u"][0]] | 32 == ord("z")
            utc = local
        else:
            name = s.get("br") or s.get("nm")
            if name:
                part = np.ascontiguousarray(m[:, name[0] : name[1]])
                names, inverse = np.unique(part.view(f"S{name[1] - name[0]}").ravel(), return_inverse=True)
                zone = np.array([self.named(x.decode()) for x in names.tolist()], np.int64)[inverse]
            utc, side = local.copy(), None
            if "ab" in s:
                a, b = s["ab"]
                ok &= np.all((m[:, a:b] >= 65) & (m[:, a:b] <= 90), axis=1)
                if b - a == 2:  # a clock's half of the day with an hour that can't be
                    ok &= ~(np.isin(m[:, a], (ord("A"), ord("P"))) & (m[:, a + 1] == ord("M")))
                plain = np.all(m[:, a:b] == np.frombuffer(b"UTC", np.uint8), axis=1) if b - a == 3 else np.zeros(n, bool)
                zone = np.where(plain, -2, zone)
                side = np.ascontiguousarray(m[:, a:b]).view(f"S{b - a}").ravel()
            for z in np.unique(zone):
                rows = zone == z
                known = self.zones[z] if z >= 0 else None
                if known is not None:
                    utc[rows] = known.to_utc(local[rows], None if side is None else side[rows])
                elif z != -2:
                    ok &= ~rows
        return utc * MICRO + micros, ok


def _read(df: DataFrame, feeds: DataFrame, emit, schema: str, *, row_id: str, feed_id: str, fields: dict[str, int], feed_key: str, feed_zone: str, feed_locale: str) -> DataFrame:
    """Runs emit(ids, texts, field's name, micros, readable) on every batch and field."""
    names = [r[0] for r in feeds.select(feed_zone).where(F.col(feed_zone).isin(*sorted(available_timezones()))).distinct().orderBy(feed_zone).collect()]
    zones = [load_zone(x) for x in names]
    known = {x: i for i, x in enumerate(names) if zones[i] is not None}
    version = zone_version()

    settings = F.struct(F.col(feed_zone).alias("_zone"), (F.col(feed_locale) == "en_US").alias("_us"))
    keys = feeds.groupBy(F.col(feed_key).alias("_feed")).agg(F.min(settings).alias("_s")).select("_feed", "_s.*")
    wanted = [F.col(f"`{c}`").cast("string").alias(f"_v{i}") for i, c in enumerate(fields)]
    rows = df.select(F.col(f"`{row_id}`").cast("bigint").alias("_id"), F.col(f"`{feed_id}`").alias("_feed"), *wanted).join(keys, "_feed", "left")
    rows = rows.select("_id", "_zone", "_us", *(f"_v{i}" for i in range(len(fields))))
    units = list(fields.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = Converter(zones, version)
        for b in batches:
            if not b.num_rows:
                continue
            z = b["_zone"].dictionary_encode()
            numbers = np.array([*(known.get(x, -1) for x in z.dictionary.to_pylist()), -1], np.int64)
            zone = numbers[z.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]
            us = b["_us"].fill_null(False).to_numpy(zero_copy_only=False)
            for i, (name, unit) in enumerate(units):
                yield emit(b["_id"], b[f"_v{i}"], name, *convert(b[f"_v{i}"], zone, us, unit))

    return arrow_map(rows, run, schema)


def normalise_instants(df: DataFrame, feeds: DataFrame, *, row_id: str, feed_id: str, fields: dict[str, int], feed_key: str = "feed_id", feed_zone: str = "tz_name", feed_locale: str = "locale", source: str | None = None) -> DataFrame:
    """Instants of the text fields: source_table, row_id, field_name, utc_micros, one row per value that denotes one.

    fields maps a column to the unit in microseconds its instants are cut down to. Values without a zone of their own, or
    with a zone's abbreviation, are local times of the row's feed; if the feed or its zone is unknown, such values are
    unreadable, as are null, blank and impossible ones. A local time that occurs twice is the earlier instant, unless it has
    the abbreviation that holds in its feed's zone after the change; a skipped one moves on by the gap. Dates that don't
    begin with the year have the month first for en_US, else the day. Bare numbers of nine or more digits count from 1970 UTC
    in seconds, milli-, micro- or nanoseconds, whichever gives a year from 2007 to 2025. Repeated rows come out repeated; an
    empty table gives no rows; other columns aren't read. Of several rows of one feed the least zone and locale count.

    A zone named in a text that no feed has is loaded by the worker; it must have the driver's version of the zone database.

    No shuffle. Feeds are configuration: their zones are compiled on the driver and travel with the plan; there are no more
    than the zone database has, and rows of feeds find theirs by a join on feed_id.
    """
    table = source or ""

    def emit(ids: pa.Array, texts: pa.Array, name: str, micros: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(ok)
        return pa.RecordBatch.from_arrays([pa.array([table] * len(at), pa.string()), ids.take(pa.array(at)), pa.array([name] * len(at), pa.string()), pa.array(micros[at], pa.int64())], names=["source_table", "row_id", "field_name", "utc_micros"])

    return _read(df, feeds, emit, "source_table string, row_id bigint, field_name string, utc_micros bigint", row_id=row_id, feed_id=feed_id, fields=fields, feed_key=feed_key, feed_zone=feed_zone, feed_locale=feed_locale)


def unreadable_instants(df: DataFrame, feeds: DataFrame, *, row_id: str, feed_id: str, fields: dict[str, int], feed_key: str = "feed_id", feed_zone: str = "tz_name", feed_locale: str = "locale", source: str | None = None) -> DataFrame:
    """The values that normalise_instants leaves out, but for null and blank ones: source_table, row_id, field_name, value."""
    table = source or ""

    def emit(ids: pa.Array, texts: pa.Array, name: str, micros: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
        held = pc.fill_null(pc.greater(pc.binary_length(pc.utf8_trim_whitespace(texts)), 0), False).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(held & ~ok)
        return pa.RecordBatch.from_arrays([pa.array([table] * len(at), pa.string()), ids.take(pa.array(at)), pa.array([name] * len(at), pa.string()), texts.take(pa.array(at))], names=["source_table", "row_id", "field_name", "value"])

    return _read(df, feeds, emit, "source_table string, row_id bigint, field_name string, value string", row_id=row_id, feed_id=feed_id, fields=fields, feed_key=feed_key, feed_zone=feed_zone, feed_locale=feed_locale)
