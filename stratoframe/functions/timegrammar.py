"""Dates, frequencies and windows as users write them. Driver-side and small: plain Python on a few values."""

from __future__ import annotations

import calendar
import fnmatch
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_PERCENT_SLACK = 2.0**-30


def frequency(value: int | str | timedelta) -> timedelta:
    """6, "6", "6h", "90m", "1d", "PT6H" or a timedelta; bare numbers are hours."""
    if isinstance(value, timedelta):
        return value
    if isinstance(value, int):
        return timedelta(hours=value)
    text = value.strip()
    if m := re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", text, re.IGNORECASE):
        d, h, mi, s = (int(x or 0) for x in m.groups())
        return timedelta(days=d, hours=h, minutes=mi, seconds=s)
    m = re.fullmatch(r"(-?\d+)\s*([smhdw]?)", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a frequency: {value!r}")
    return timedelta(seconds=int(m[1]) * _UNITS[(m[2] or "h").lower()])


def frequency_text(value: timedelta) -> str:
    seconds = int(value.total_seconds())
    for unit in ("d", "h", "m"):
        if seconds and seconds % _UNITS[unit] == 0:
            return f"{seconds // _UNITS[unit]}{unit}"
    return f"{seconds}s"


def spine(start: datetime, end: datetime, step: timedelta) -> list[datetime]:
    return [start + k * step for k in range(int((end - start) / step) + 1)] if end >= start else []


def _period(text: str) -> tuple[datetime, datetime] | None:
    """The first instant of a year, month or day, and of the next one."""
    digits = text.replace("-", "")
    if not re.fullmatch(r"\d{4}(-?\d{2}){0,2}", text) or len(digits) not in (4, 6, 8):
        return None
    year, month, day = int(digits[:4]), int(digits[4:6] or 1), int(digits[6:8] or 1)
    first = datetime(year, month, day)
    if len(digits) == 4:
        return first, datetime(year + 1, 1, 1)
    if len(digits) == 6:
        return first, datetime(year + month // 12, month % 12 + 1, 1)
    return first, first + timedelta(days=1)


def _snap_up(at: datetime, dates: Sequence[datetime]) -> datetime:
    return next((d for d in dates if d >= at), dates[-1])


def _snap_down(at: datetime, dates: Sequence[datetime]) -> datetime:
    return next((d for d in reversed(dates) if d <= at), dates[0])


def _resolve(value: object, dates: Sequence[datetime], last: bool, step: timedelta | None) -> datetime:
    snap = _snap_down if last else _snap_up
    if isinstance(value, datetime):
        return snap(value, dates)
    if isinstance(value, date):
        value = value.strftime("%Y%m%d")
    text = str(value).strip()
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)%", text):
        place = float(m[1]) * len(dates) / 100
        index = math.floor(place + _PERCENT_SLACK) - 1 if last else math.floor(place - _PERCENT_SLACK)
        return dates[max(0, min(len(dates) - 1, index))]
    if found := _period(text):
        return snap(found[1] - (step or timedelta(seconds=1)) if last else found[0], dates)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", text):
        return snap(datetime.fromisoformat(text), dates)
    if not last and (m := re.fullmatch(r"(\d{2}):00", text)):
        return snap(datetime.combine(dates[0].date(), datetime.min.time()) + timedelta(hours=int(m[1])), dates)
    raise NotImplementedError(f"not a date: {value!r}")


def first_date(value: object, dates: Sequence[datetime]) -> datetime:
    """The dataset's first date that a start means: a period's first instant, rounded up to a date."""
    return _resolve(value, dates, False, None)


def last_date(value: object, dates: Sequence[datetime], step: timedelta | None = None) -> datetime:
    """The dataset's last date that an end means: the last instant of a period, rounded down to a date."""
    return _resolve(value, dates, True, step)


def first_second(value: object) -> datetime:
    """The first second of a period or date, whatever a dataset has."""
    return value if isinstance(value, datetime) else found[0] if (found := _period(str(value))) else datetime.fromisoformat(str(value))


def last_second(value: object) -> datetime:
    """The last second of a period, or the date itself."""
    return value if isinstance(value, datetime) else found[1] - timedelta(seconds=1) if (found := _period(str(value))) else datetime.fromisoformat(str(value))


@dataclass(frozen=True)
class Window:
    """An event-time window relative to a reference date, in seconds; either end may be open."""

    start: int
    end: int
    start_closed: bool = False
    end_closed: bool = True

    @staticmethod
    def parse(text: str | Window) -> Window:
        """"(-3h,+0]", "[-1d,1d)"; bare numbers are hours."""
        if isinstance(text, Window):
            return text
        m = re.fullmatch(r"\s*([\[(])\s*([+-]?\d+\s*[smhd]?)\s*,\s*([+-]?\d+\s*[smhd]?)\s*([\])])\s*", text)
        if not m:
            raise ValueError(f"not a window: {text!r}")
        a, b = (int(frequency(x.replace("+", "")).total_seconds()) for x in (m[2], m[3]))
        if b < a:
            raise ValueError(f"the window {text!r} ends before it starts")
        return Window(a, b, m[1] == "[", m[4] == "]")


DEFAULT_WINDOW = Window.parse("(-3,+0]")


def statistics_range(dates: Sequence[datetime], start: object = None, end: object = None) -> tuple[datetime, datetime]:
    """First and last date that statistics cover by default: 80 % of short series, all but the last year from ten years, but the last three from twenty."""
    first = first_date(start, dates) if start is not None else dates[0]
    if end is not None:
        return first, last_date(end, dates)
    n = len(dates)
    years = round((dates[-1] - dates[0]) / timedelta(days=365.25))
    if n < 10:
        return first, dates[max(1, int(0.8 * n)) - 1]
    if years < 10:
        return first, dates[int(0.8 * n) - 1]
    limit = dates[-1].year - (3 if years >= 20 else 1)
    return first, [d for d in dates if d.year == limit][-1]


def group_key(at: datetime, by: str) -> tuple:
    keys = {
        "monthly": (at.year, at.month), "daily": (at.year, at.month, at.day), "yearly": (at.year,), "MMDD": (at.month, at.day),
        "weekday": (at.weekday(),), "weekly": (at.weekday(),), "week": tuple(at.isocalendar()[:2]), "reference_date": (at,),
    }
    if by not in keys:
        raise ValueError(f"unknown grouping: {by!r}")
    return keys[by]


def groups(dates: Sequence[datetime], by: int | str | None = "monthly", missing: Sequence[datetime] = ()) -> list[list[datetime]]:
    """The dates dealt into groups, missing ones left out, empty groups gone."""
    gone = set(missing)
    if by is None or isinstance(by, int):
        size = by or len(dates)
        dealt = [list(dates[k : k + size]) for k in range(0, len(dates), size)]
    else:
        out: dict[tuple, list[datetime]] = {}
        for d in dates:
            out.setdefault(group_key(d, by), []).append(d)
        dealt = list(out.values())
    return [kept for g in dealt if (kept := [d for d in g if d not in gone])]


def part(total: int, spec: str) -> range:
    """The indices of part "i/n" (i from 1) of so many groups."""
    i, n = (int(x) for x in spec.split("/"))
    if not 1 <= i <= n:
        raise ValueError(f"not a part: {spec!r}")
    return range(math.ceil((i - 1) * total / n), math.ceil(i * total / n))


def calendar_filter(dates: Sequence[datetime], weekday: Sequence[str] | str | None = None, pattern: str | None = None, day_of_month: Sequence[int] | None = None, months: Sequence[int | str] | None = None) -> list[datetime]:
    """Dates of given weekdays, of a pattern such as ????-??-01, of days of the month, of months."""
    names = [d.lower() for d in calendar.day_name]
    days = [weekday] if isinstance(weekday, str) else weekday
    month_names = [m.lower() for m in calendar.month_name]
    wanted = None if months is None else {m if isinstance(m, int) else month_names.index(m.lower()) for m in months}
    return [
        d
        for d in dates
        if (days is None or names[d.weekday()] in {x.lower() for x in days})
        and (pattern is None or fnmatch.fnmatch(d.strftime("%Y-%m-%d"), pattern))
        and (day_of_month is None or d.day in day_of_month)
        and (wanted is None or d.month in wanted)
    ]


def expand(text: str | Sequence[int]) -> list[int]:
    """"0/to/24/by/6", "1/3/5" or a list."""
    if not isinstance(text, str):
        return list(text)
    if m := re.fullmatch(r"(-?\d+)/to/(-?\d+)(?:/by/(\d+))?", text):
        return list(range(int(m[1]), int(m[2]) + 1, int(m[3] or 1)))
    return [int(x) for x in text.split("/")]


def hindcast_requests(reference: Sequence[datetime], years: int, steps: Sequence[int]) -> list[dict]:
    """For each reference date and each of so many past years: the hindcast date, and the valid time of each step (hours)."""
    out = []
    for ref in reference:
        for back in range(1, years + 1):
            try:
                base = ref.replace(year=ref.year - back)
            except ValueError:  # 29 February
                continue
            out += [{"reference": ref, "base": base, "step": s, "valid": base + timedelta(hours=s)} for s in steps]
    return out
