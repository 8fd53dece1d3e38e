from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from stratoframe.functions import timegrammar as g

SIX_HOURLY = g.spine(datetime(2021, 1, 1), datetime(2021, 12, 31, 18), timedelta(hours=6))


@pytest.mark.parametrize(("text", "hours"), [("6h", 6), (6, 6), ("6", 6), ("1d", 24), ("90m", 1.5), ("PT6H", 6), ("P1D", 24)])
def test_frequency(text, hours):
    assert g.frequency(text) == timedelta(hours=hours)


def test_frequency_text_round_trip():
    for text in ("6h", "1d", "90m", "45s"):
        assert g.frequency_text(g.frequency(text)) == text
    with pytest.raises(ValueError):
        g.frequency("often")


@pytest.mark.parametrize(
    ("value", "first", "last"),
    [
        (2021, datetime(2021, 1, 1), datetime(2021, 12, 31, 18)),
        ("2021-03", datetime(2021, 3, 1), datetime(2021, 3, 31, 18)),
        (20210412, datetime(2021, 4, 12), datetime(2021, 4, 12, 18)),
        (date(2021, 4, 12), datetime(2021, 4, 12), datetime(2021, 4, 12, 18)),
        ("2021-05-05 07:00:00", datetime(2021, 5, 5, 12), datetime(2021, 5, 5, 6)),
        (datetime(2030, 1, 1), datetime(2021, 12, 31, 18), datetime(2021, 12, 31, 18)),
    ],
)
def test_dates_snap(value, first, last):
    assert g.first_date(value, SIX_HOURLY) == first
    assert g.last_date(value, SIX_HOURLY) == last


def test_percent_splits_without_overlap():
    assert g.first_date("0%", SIX_HOURLY) == SIX_HOURLY[0]
    assert g.last_date("100%", SIX_HOURLY) == SIX_HOURLY[-1]
    with pytest.raises(NotImplementedError):
        g.first_date("soon", SIX_HOURLY)


def test_windows():
    assert g.Window.parse("(-3,+0]") == g.DEFAULT_WINDOW == g.Window(-10800, 0, False, True)
    assert g.Window.parse("[-1d,30m)") == g.Window(-86400, 1800, True, False)
    for bad in ("-3,0", "(0,-3]", "(a,b]"):
        with pytest.raises(ValueError):
            g.Window.parse(bad)


def test_statistics_range():
    year = timedelta(days=1)
    assert g.statistics_range([datetime(2020, 1, 1) + k * year for k in range(5)])[1] == datetime(2020, 1, 4)
    ten = g.spine(datetime(2000, 1, 1), datetime(2010, 12, 31), year)
    assert g.statistics_range(ten)[1] == datetime(2009, 12, 31)
    twenty = g.spine(datetime(2000, 1, 1), datetime(2021, 12, 31), year)
    assert g.statistics_range(twenty)[1] == datetime(2018, 12, 31)


def test_groups_and_parts():
    monthly = g.groups(SIX_HOURLY, "monthly")
    assert len(monthly) == 12 and sum(map(len, monthly)) == len(SIX_HOURLY)
    assert g.groups(SIX_HOURLY[:4], 2, SIX_HOURLY[:2]) == [SIX_HOURLY[2:4]]
    parts = [list(g.part(10, f"{i}/3")) for i in (1, 2, 3)]
    assert sum(parts, []) == list(range(10))


def test_calendar_filter():
    mondays = g.calendar_filter(SIX_HOURLY, weekday="monday")
    assert {d.weekday() for d in mondays} == {0}
    assert {d.day for d in g.calendar_filter(SIX_HOURLY, pattern="????-??-01")} == {1}
    assert {d.month for d in g.calendar_filter(SIX_HOURLY, months=["March", 5])} == {3, 5}


def test_expansion_and_hindcasts():
    assert g.expand("0/to/24/by/6") == [0, 6, 12, 18, 24]
    assert g.expand("1/3") == [1, 3]
    made = g.hindcast_requests([datetime(2024, 2, 29)], 4, [0, 24])
    assert {r["base"].year for r in made} == {2020}
