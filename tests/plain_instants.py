"""A plain, row-at-a-time reading of timestamps to hold the vectorised operator against."""

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def from_local(local, name, side=""):
    """The earlier instant of a repeated time, but for the later one's abbreviation; a skipped one moved on by the gap.
    fold=0 means both."""
    at = local.replace(tzinfo=ZoneInfo(name))
    later = at.replace(fold=1)
    if later.utcoffset() < at.utcoffset() and side == later.tzname() != at.tzname():
        at = later
    return local.replace(tzinfo=UTC) - at.utcoffset()


def micros(text, zone, locale, unit=1):
    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"[0-9]{9,19}", t):
        for per in (1, 10**3, 10**6, 10**9):
            us = int(t) * 10**6 // per
            if 2007 <= (EPOCH + timedelta(seconds=us // 10**6)).year <= 2025 if us < 2 * 10**17 else False:
                return us - us % unit
        return None
    clock = r"(?:(?:[Tt]|,? +)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?( ?[AaPp][Mm])?|T([0-9]{2})([0-9]{2})([0-9]{2}))?"
    tail = r"(Z|z| ?[-+][0-9]{2}:?[0-9]{2}| ?\[[A-Za-z_/]+\]| [A-Za-z]+/[A-Za-z_]+| [A-Z]{2,5})?"
    dates = [
        (r"([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", "ymd"),
        (r"([0-9]{4})([0-9]{2})([0-9]{2})", "ymd"),
        (r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", "ymd"),
        (r"([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})", "mdy" if locale == "en_US" else "dmy"),
        (r"(?:[A-Za-z]{3,9}, )?([0-9]{1,2}) ([A-Za-z]{3}) ([0-9]{4})", "dmy"),
        (r"([A-Za-z]{3}) ([0-9]{1,2}), ([0-9]{4})", "mdy"),
    ]
    for pattern, order in dates:
        m = re.fullmatch(pattern + clock + tail, t)
        if not m:
            continue
        part = dict(zip(order, m.groups()[:3]))
        h, mi, s, f, ap, h2, m2, s2, tz = m.groups()[3:]
        h, mi, s = (h2, m2, s2) if h2 else (h, mi, s)
        try:
            mo = MONTHS[part["m"].lower()] if part["m"].isalpha() else int(part["m"])
            h = int(h or 0)
            if ap:
                if not 1 <= h <= 12:
                    return None
                h = h % 12 + (12 if ap.strip().lower() == "pm" else 0)
            local = datetime(int(part["y"]), mo, int(part["d"]), h, int(mi or 0), int(s or 0), int((f or "")[:6].ljust(6, "0")))
        except (ValueError, KeyError):
            return None
        z = (tz or "").strip()
        if z in ("Z", "z", "UTC"):
            at = local.replace(tzinfo=UTC)
        elif z[:1] in ("+", "-"):
            d = z.replace(":", "")
            at = local.replace(tzinfo=UTC) - (1 if z[0] == "+" else -1) * timedelta(hours=int(d[1:3]), minutes=int(d[3:5]))
        elif "/" in z:
            try:
                at = from_local(local, z.strip("[]"))
            except ZoneInfoNotFoundError:
                return None
        elif zone is None:
            return None
        else:
            at = from_local(local, zone, z)
        us = (at - EPOCH) // timedelta(microseconds=1)
        return us - us % unit
    return None
