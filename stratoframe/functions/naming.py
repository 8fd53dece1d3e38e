"""Names of datasets: purpose, labelling, source, resolution, years, frequencies and version, joined by hyphens.

Each layout has its parts; a name's layout is the one that its shape fits. All of it is expressions over columns, so a table
of names is checked where it is, against resolutions, frequencies and years that other columns hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a part of a name may be.
PARTS = {
    "purpose": r"\w+", "labelling": r"[\w-]+", "source": r"\w+", "resolution": r"[0-9on]\w*", "start": r"\d\d\d\d", "end": r"\d\d\d\d", "frequency": r"\d+[hm]", "step_frequency": r"\d+[hm]", "version": r"\d+", "additional": r"[a-zA-Z0-9-]+",
}
#: The parts of each layout's names; the resolution of observations may be left out.
LAYOUTS = {
    "gridded": ("purpose", "labelling", "source", "resolution", "start", "end", "frequency", "version", "additional"),
    "trajectories": ("purpose", "labelling", "source", "resolution", "start", "end", "frequency", "step_frequency", "version", "additional"),
    "tabular": ("purpose", "labelling", "source", "resolution", "start", "end", "version", "additional"),
}


def pattern(layout: str) -> str:
    """The regular expression of a layout's names, a group for each part."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; there are {list(LAYOUTS)}")
    out = "^"
    for part in LAYOUTS[layout]:
        text = f"({PARTS[part]})"
        if part == "purpose":
            out += text
        elif part == "version":
            out += f"-v{text}"
        elif part == "additional":
            out += f"-?{text}?$"
        elif part == "resolution" and layout == "tabular":
            out += f"(?:-{text})?"
        else:
            out += f"-{text}"
    return out


def layout_of(name: Column) -> Column:
    """The one layout that a name's shape fits; null where none or several do."""
    fits = F.array_compact(F.array(*[F.when(name.rlike(pattern(layout)), layout) for layout in LAYOUTS]))
    return F.when(F.size(fits) == 1, fits[0])


def part_of(name: Column, layout: str, part: str) -> Column:
    """A part of a name of a layout; null where it has none."""
    return F.nullif(F.regexp_extract(name, pattern(layout), LAYOUTS[layout].index(part) + 1), F.lit(""))


@dataclass(frozen=True)
class Actual:
    """What a dataset really has, as columns or values; None isn't checked."""

    resolution: object = None
    frequency: object = None
    step_frequency: object = None
    start: object = None
    end: object = None


def _column(value: object) -> Column | None:
    return value if isinstance(value, Column) or value is None else F.lit(value)


def problems(name: Column, layout: str | None = None, actual: Actual | None = None) -> Column:
    """What is wrong with a name (an array of short texts; empty for a right one): its characters, its shape for the layout (else for any), and parts that aren't the dataset's."""
    found = [
        F.when(name != F.lower(name), "upper case"), F.when(~name.rlike("[a-zA-Z]"), "no letters"), F.when(name.contains("_"), "underscore"), F.when(name.rlike(r"[^\p{L}\p{N}_-]"), "characters"),
    ]
    layouts = [layout] if layout else list(LAYOUTS)
    shaped = {k: name.rlike(pattern(k)) for k in layouts}
    any_shape = F.lit(False)
    for fits in shaped.values():
        any_shape = any_shape | fits
    found.append(F.when(~any_shape, F.lit(f"not a {layout} name") if layout else F.lit("no layout fits")))
    chosen = F.lit(layout) if layout else layout_of(name)
    actual = actual or Actual()
    wanted = {
        "resolution": None if actual.resolution is None else F.lower(F.replace(_column(actual.resolution).cast("string"), F.lit("."), F.lit("p"))),
        "frequency": _column(actual.frequency), "step_frequency": _column(actual.step_frequency), "start": _year(actual.start), "end": _year(actual.end),
    }
    for part, value in wanted.items():
        if value is None:
            continue
        for k in layouts:
            if part in LAYOUTS[k]:
                said = part_of(name, k, part)
                found.append(F.when((chosen == k) & shaped[k] & said.isNotNull() & (said != value.cast("string")), part))
    return F.array_compact(F.array(*found))


def _year(value: object) -> Column | None:
    column = _column(value)
    return None if column is None else F.date_format(column.cast("timestamp"), "yyyy")
