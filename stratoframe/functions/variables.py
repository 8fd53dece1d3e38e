"""What is known of a variable beside its values: unit, level, constancy in time and the period it is accumulated over."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace

from stratoframe.functions import units


class VariablesDifferError(ValueError):
    """Variables of one name that mean different things."""


@dataclass(frozen=True)
class Variable:
    """``level_type`` is "pl" (pressure), "ml" (model), "sfc" or another name; ``period`` the seconds of an accumulation. None is unknown and agrees with anything."""

    name: str
    units: str | None = None
    param: str | None = None
    level: float | None = None
    level_type: str | None = None
    constant: bool = False
    period: int | None = None

    @staticmethod
    def named(name: str) -> Variable:
        """What a name says: ``t_850`` is parameter t on level 850."""
        found = re.fullmatch(r"([A-Za-z][A-Za-z0-9]*)_(\d+)", name)
        return Variable(name, param=found[1], level=float(found[2]), level_type="pl") if found else Variable(name, param=name)

    @staticmethod
    def of(name: str, known: Variable | Mapping[str, object] | None) -> Variable:
        if isinstance(known, Variable):
            return replace(known, name=name)
        return replace(Variable.named(name), **{k: v for k, v in (known or {}).items() if k != "name"})

    @property
    def accumulated(self) -> bool:
        return bool(self.period)

    def to_dict(self) -> dict[str, object]:
        return asdict(self)

    def rescaled(self, source: str | None, target: str | None) -> Variable:
        """In another unit; the source must be the variable's, where that is known. A plain scale and offset make the unit unknown."""
        if source is not None and self.units is not None and not units.same(source, self.units):
            raise VariablesDifferError(f"{self.name} is in {self.units}, not in {source}")
        return replace(self, units=target)


def unified(variables: Sequence[Variable]) -> Variable:
    """One variable that several datasets have. Units, levels, level types and periods must agree where they are known; it is constant if it is so in all."""
    first = variables[0]
    known: dict[str, object] = {}
    for v in variables:
        for field in ("units", "param", "level", "level_type", "period"):
            value = getattr(v, field)
            if value is None or field == "param" and known.get(field):
                continue
            before = known.setdefault(field, value)
            if before != value and not (field == "units" and units.same(before, value)):
                hint = "; rescale one of them" if field == "units" else ""
                raise VariablesDifferError(f"{first.name}: {field} {before} and {value} differ{hint}")
    return replace(first, **known, constant=all(v.constant for v in variables))
