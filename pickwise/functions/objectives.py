"""Objective schemas: what the surrogate learns (expensive) and what is known up front (static)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Property names that a plain objective list may hold although they are static.
STATIC_PROPERTY_NAMES = ("qed", "sa_ease", "sa", "mw", "logp", "pains")


@dataclass(frozen=True)
class Objective:
    name: str
    kind: str = "expensive"
    maximize: bool = True
    source: str | None = None

    def maximized(self, raw: Column) -> Column:
        """Raw column mapped so that larger is better; applying it twice gives the raw column back."""
        return raw if self.maximize else -raw

    def column(self) -> Column:
        """This objective's maximised column read from its source column."""
        return self.maximized(F.col(self.source or self.name)).cast("double").alias(self.name)


@dataclass(frozen=True)
class Objectives:
    expensive: tuple[Objective, ...] = ()
    static: tuple[Objective, ...] = ()

    @property
    def expensive_names(self) -> list[str]:
        return [o.name for o in self.expensive]

    @property
    def static_names(self) -> list[str]:
        return [o.name for o in self.static]

    def columns(self) -> list[Column]:
        return [o.column() for o in (*self.expensive, *self.static)]


DEFAULT_OBJECTIVES = Objectives(
    expensive=(Objective("activity", source="dock"),),
    static=(Objective("qed", "static", source="qed"), Objective("sa_ease", "static", source="sa")),
)


def _one(entry: Any, kind: str) -> Objective:
    if isinstance(entry, Objective):
        return entry
    if isinstance(entry, str):
        return Objective(entry, kind)
    if isinstance(entry, Mapping):
        return Objective(
            str(entry["name"]), entry.get("kind", kind), bool(entry.get("maximize", True)), entry.get("source")
        )
    raise TypeError(f"not an objective: {entry!r}")


def resolve_objectives(config: Mapping[str, Any] | None) -> Objectives:
    """All accepted spellings: names, mappings, an expensive/static mapping, and the older mixed list."""
    config = config or {}
    listed, listed_static = config.get("objectives"), config.get("static_properties")
    if isinstance(listed, Mapping) and {"expensive", "static"} & set(listed):
        return Objectives(
            tuple(_one(e, "expensive") for e in listed.get("expensive") or ()),
            tuple(_one(e, "static") for e in listed.get("static") or ()),
        )
    if listed is None and listed_static is None:
        return DEFAULT_OBJECTIVES

    def is_static(entry: Any) -> bool:
        if isinstance(entry, str):
            return entry.lower() in STATIC_PROPERTY_NAMES
        return _one(entry, "expensive").kind == "static"

    entries = list(listed or ())
    expensive = tuple(replace(_one(e, "expensive"), kind="expensive") for e in entries if not is_static(e))
    static = tuple(replace(_one(e, "static"), kind="static") for e in entries if is_static(e))
    static += tuple(_one(e, "static") for e in listed_static or ())
    if not static and listed_static is None:
        static = DEFAULT_OBJECTIVES.static
    return Objectives(expensive or DEFAULT_OBJECTIVES.expensive, static)


def require_expensive(schema: Objectives) -> Objectives:
    if not schema.expensive:
        raise ValueError("a campaign needs at least one expensive objective")
    return schema


def static_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """The named static columns; an unknown name fails when the plan is built."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"static properties not on the library: {missing}")
    return [F.col(n) for n in names]


def refuse_labels(candidates: DataFrame, schema: Objectives) -> DataFrame:
    """Acquisition must not see hidden labels: refuse a candidate table that carries any."""
    leaked = [c for c in candidates.columns if c in (*schema.expensive_names, "Y_hidden")]
    if leaked:
        raise ValueError(f"candidate table carries hidden labels: {leaked}")
    return candidates
