"""What the columns of a self-describing table are: roles from names and attributes, a model of time, and the table in standard columns.

Attributes (standard_name, long_name, units) come with the columns, as Spark's column metadata, or beside them. A rule
names a role and what a column must have for it; rules are tried in order, the user's (a flavour) before the others, and the
first that fits decides. Which of the five models of time holds follows from the roles that were found. No row is read for any of this; the standard
columns are projections.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DayTimeIntervalType

from stratoframe.functions import geo
from stratoframe.functions.timegrammar import frequency
from stratoframe.operators.cube import seconds

ROLES = ("longitude", "latitude", "x", "y", "time", "base", "step", "level", "member", "point")


class UnclearCoordinatesError(ValueError):
    """Columns that can't be told apart, or roles that make no model of time."""


@dataclass(frozen=True)
class Rule:
    """Each attribute that is named must be one of the values, and none of ``unless``. ``level`` is the type of level."""

    role: str
    name: tuple[str, ...] = ()
    standard_name: tuple[str, ...] = ()
    long_name: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    unless: Mapping[str, str] = field(default_factory=dict)
    level: str | None = None

    @staticmethod
    def of(role: str, spec: Mapping[str, object], level: str | None = None) -> Rule:
        """From a flavour: {"name": "XLAT"} or {"standard_name": ["a", "b"], "units": "m"}."""
        if unknown := set(spec) - {"name", "standard_name", "long_name", "units"}:
            raise ValueError(f"unknown attributes in a rule: {sorted(unknown)}")
        return Rule(role, level=level, **{k: tuple(v) if isinstance(v, (list, tuple)) else (str(v),) for k, v in spec.items()})

    def fits(self, attributes: Mapping[str, str]) -> bool:
        wanted = {k: getattr(self, k) for k in ("name", "standard_name", "long_name", "units") if getattr(self, k)}
        if any(attributes.get(k, "").lower() == v for k, v in self.unless.items()):
            return False
        return bool(wanted) and all(_plain(k, attributes.get(k, "")) in {_plain(k, v) for v in values} for k, values in wanted.items())


def _plain(kind: str, value: str) -> str:
    """Names are compared as they are but for their case, units with their case."""
    return value if kind == "units" else value.lower()


#: By what columns of published datasets are told.
RULES = (
    Rule("point", standard_name=("cell", "station", "poi", "point")),
    Rule("point", name=("location", "cell", "id", "station", "poi", "point")),
    Rule("longitude", standard_name=("longitude",)),
    Rule("longitude", long_name=("longitude",), units=("degrees_east",)),
    Rule("longitude", name=("longitude",)),
    Rule("latitude", standard_name=("latitude",)),
    Rule("latitude", long_name=("latitude",), units=("degrees_north",)),
    Rule("latitude", name=("latitude",)),
    Rule("x", standard_name=("projection_x_coordinate", "grid_longitude")),
    Rule("x", name=("x",)),
    Rule("y", standard_name=("projection_y_coordinate", "grid_latitude")),
    Rule("y", name=("y",)),
    Rule("time", standard_name=("time",)),
    Rule("time", name=("time",), unless={"standard_name": "forecast_reference_time"}),
    Rule("base", standard_name=("forecast_reference_time",)),
    Rule("base", name=("forecast_reference_time",)),
    Rule("step", standard_name=("forecast_period",)),
    Rule("step", long_name=("time elapsed since the start of the forecast",)),
    Rule("step", name=("prediction_timedelta",)),
    Rule("level", standard_name=("atmosphere_hybrid_sigma_pressure_coordinate", "model_level_number"), level="ml"),
    Rule("level", long_name=("height",), units=("m",), level="height"),
    Rule("level", standard_name=("air_pressure",), units=("hPa",), level="pl"),
    Rule("level", long_name=("pressure",), units=("hPa", "Pa"), level="pl"),
    Rule("level", name=("level",), level="pl"),
    Rule("level", name=("vertical",), units=("hPa",), level="pl"),
    Rule("level", standard_name=("depth",), level="depth"),
    Rule("member", name=("realization", "number")),
)


@dataclass(frozen=True)
class Coordinates:
    """The column of each role, its attributes, the type of levels, and the columns that are variables."""

    columns: Mapping[str, str]
    attributes: Mapping[str, Mapping[str, str]]
    level_type: str | None
    variables: tuple[str, ...]

    @property
    def time_model(self) -> str:
        """constant, analysis, valid+step, valid+base or base+step."""
        has = tuple(r for r in ("base", "time", "step") if r in self.columns)
        models = {(): "constant", ("time",): "analysis", ("time", "step"): "valid+step", ("base", "time", "step"): "valid+step", ("base", "time"): "valid+base", ("base", "step"): "base+step"}
        if has not in models:
            raise UnclearCoordinatesError(f"no model of time has just {has}")
        return models[has]


def attributes_of(df: DataFrame, given: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, dict[str, str]]:
    """Each column's attributes: its metadata, then those that are given, and its name."""
    return {f.name: {k: str(v) for k, v in (f.metadata or {}).items()} | dict((given or {}).get(f.name, {})) | {"name": f.name} for f in df.schema.fields}


def flavoured(flavour: Mapping[str, object]) -> list[Rule]:
    """A user's rules: {"rules": {role: {attribute: value}}, "levtype": type of levels}."""
    rules = flavour.get("rules", {})
    if unknown := set(rules) - set(ROLES):
        raise ValueError(f"unknown roles: {sorted(unknown)}; there are {ROLES}")
    found = []
    for role, spec in rules.items():
        found += [Rule.of(role, s, flavour.get("levtype") if role == "level" else None) for s in (spec if isinstance(spec, (list, tuple)) else [spec])]
    return found


def detect(df: DataFrame, attributes: Mapping[str, Mapping[str, str]] | None = None, flavour: Mapping[str, object] | None = None) -> Coordinates:
    """The roles of a table's columns. A flavour's rules count before the others; two columns of one role are an error unless only one of them has it from the flavour."""
    known = attributes_of(df, attributes)
    own = flavoured(flavour or {})
    claims: dict[str, list[tuple[int, str, Rule]]] = {}
    for name, has in known.items():
        for rank, rules in enumerate((own, RULES)):
            if rule := next((r for r in rules if r.fits(has)), None):
                claims.setdefault(rule.role, []).append((rank, name, rule))
                break
    columns, level_type = {}, None
    for role, claimed in claims.items():
        best = [c for c in claimed if c[0] == min(rank for rank, _, _ in claimed)]
        if len(best) > 1:
            raise UnclearCoordinatesError(f"several columns could be the {role}: {[name for _, name, _ in best]}")
        columns[role] = best[0][1]
        level_type = best[0][2].level if role == "level" else level_type
    for a, b in (("longitude", "latitude"), ("x", "y")):
        if (a in columns) != (b in columns):
            raise UnclearCoordinatesError(f"there is no {b if a in columns else a}")
    return Coordinates(columns, {n: known[n] for n in columns.values()}, level_type, tuple(n for n in known if n not in columns.values()))


def step_seconds(df: DataFrame, column: str, units: str | None) -> Column:
    """A step as seconds: of an interval, a text like 6h, or a number in its unit (hours unless it says otherwise)."""
    kind = df.schema[column].dataType
    if isinstance(kind, DayTimeIntervalType):
        return (F.extract(F.lit("DAY"), column) * 86400 + F.extract(F.lit("HOUR"), column) * 3600 + F.extract(F.lit("MINUTE"), column) * 60 + F.extract(F.lit("SECOND"), column)).cast("int")
    if kind.typeName() == "string":
        number, unit = F.regexp_extract(column, r"^(\d+)", 1).cast("int"), F.regexp_extract(column, r"([smhdw]?)$", 1)
        each = F.create_map(*[F.lit(x) for u in ("s", "m", "h", "d", "w") for x in (u, int(frequency(f"1{u}").total_seconds()))])
        return (number * F.coalesce(each[unit], F.lit(3600))).cast("int")
    #: Units of numbers as they are written.
    each = {"seconds": 1, "s": 1, "minutes": 60, "hours": 3600, "h": 3600, "days": 86400}.get((units or "hours").split(" since")[0], 3600)
    return (F.col(column) * each).cast("int")


def standardised(df: DataFrame, found: Coordinates) -> DataFrame:
    """The table in standard columns: date (valid), base_date and step_s (of forecasts), member, level, latitude, longitude (or x, y), cell, as far as it has them, and its variables."""
    columns, model, out = found.columns, found.time_model, {}
    stamp = lambda role: F.col(columns[role]).cast("timestamp_ntz")
    step = step_seconds(df, columns["step"], found.attributes[columns["step"]].get("units")) if "step" in columns else None
    length = F.make_dt_interval(secs=step.cast("decimal(18,6)")) if step is not None else None
    if model == "analysis":
        out = {"date": stamp("time")}
    elif model == "valid+step":
        base = stamp("base") if "base" in columns else stamp("time") - length
        out = {"date": stamp("time"), "base_date": base, "step_s": step}
    elif model == "valid+base":
        out = {"date": stamp("time"), "base_date": stamp("base"), "step_s": (seconds(stamp("time")) - seconds(stamp("base"))).cast("int")}
    elif model == "base+step":
        out = {"date": stamp("base") + length, "base_date": stamp("base"), "step_s": step}
    for role, name, value in (
        ("member", "member", lambda c: F.col(c).cast("int")), ("point", "cell", lambda c: F.col(c).cast("int")), ("latitude", "latitude", lambda c: F.col(c).cast("double")),
        ("longitude", "longitude", lambda c: geo.longitude(F.col(c).cast("double"))), ("x", "x", F.col), ("y", "y", F.col),
    ):
        if role in columns:
            out[name] = value(columns[role])
    if "level" in columns:
        pascals = found.level_type == "pl" and found.attributes[columns["level"]].get("units") == "Pa"
        out["level"] = F.col(columns["level"]).cast("double") / (100 if pascals else 1)
    return df.select(*[v.alias(k) for k, v in out.items()], *found.variables)


def by_level(df: DataFrame, variables: Sequence[str], levels: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Levels as variables of their own (``t_850``): one aggregation on the keys; the levels are named, so no job finds them."""
    at = lambda v, x: F.max(F.when(F.col("level") == float(x), F.col(v))).alias(f"{v}_{x:g}")
    return df.groupBy(*keys).agg(*[at(v, x) for v in variables for x in levels])
