"""The parameters of the fusion methods as forms show them (``dense.METHODS`` holds the methods), and the check of what a run is given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Parameter:
    method: str
    name: str
    kind: str
    default: str
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] | None = None


#: Methods that slabs may use.
CHOICES = ("pmax", "dmap", "weighted")
#: Methods, parameters, defaults and ranges.
PARAMETERS = (
    Parameter("dmap", "contrast_threshold", "float", "7.0", 0, 50),
    Parameter("dmap", "estimation_radius", "int", "8", 2, 40),
    Parameter("dmap", "smoothing_radius", "int", "16", 1, 64),
    Parameter("pmax", "selection_smoothing", "int", "1", 0, 3),
    Parameter("slab", "inner_method", "choice", "pmax", choices=CHOICES),
    Parameter("slab", "outer_method", "choice", "dmap", choices=CHOICES),
    Parameter("slab", "slab_overlap", "int", "2", 0, 50),
    Parameter("slab", "slab_size", "int", "10", 2, 100),
    Parameter("weighted", "sharpness_radius", "int", "8", 2, 40),
    Parameter("weighted", "temperature", "float", "0.05", 0.001, 1),
)
METHODS = tuple(sorted({p.method for p in PARAMETERS}))


def parameters(spark: SparkSession) -> DataFrame:
    rows = [(p.method, p.name, p.kind, p.default, None if p.least is None else float(p.least), None if p.most is None else float(p.most), p.choices and ",".join(p.choices)) for p in PARAMETERS]
    return spark.createDataFrame(rows, "method string, name string, kind string, default string, least double, most double, choices string")


def method(name: str) -> tuple[Parameter, ...]:
    """The parameters of a method; an unknown name is an error that lists the known ones."""
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(METHODS)}")
    return tuple(p for p in PARAMETERS if p.method == name)


def checked(name: str, given: dict[str, object]) -> dict[str, object]:
    """``given`` as it is, if every parameter is one that the methods know and lies in its range; a method may get parameters of others, which slabs and tiles pass on."""
    method(name)
    known = {p.name: p for p in PARAMETERS}
    for key, value in given.items():
        if key not in known:
            raise ValueError(f"unknown parameter {key!r}; known: {', '.join(sorted(known))}")
        p = known[key]
        if p.kind == "choice":
            if value not in p.choices:
                raise ValueError(f"{key} must be one of {', '.join(p.choices)}, not {value!r}")
        elif isinstance(value, bool) or not isinstance(value, int if p.kind == "int" else (int, float)) or not p.least <= value <= p.most:
            raise ValueError(f"{key} must be {'a whole number' if p.kind == 'int' else 'a number'} from {p.least:g} to {p.most:g}, not {value!r}")
    return given
