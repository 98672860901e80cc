"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class NodePattern:
    variable: str | None
    labels: tuple[str, ...] = ()
    props: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RelPattern:
    variable: str | None
    types: tuple[str, ...] = ()
    direction: str = "both"
    props: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Pattern:
    start: NodePattern
    hops: tuple[tuple[RelPattern, NodePattern], ...] = ()


@dataclass(frozen=True)
class Comparison:
    variable: str
    prop: str
    op: str
    value: Any


@dataclass(frozen=True)
class Item:
    """What RETURN names: a variable, a property of one, or an aggregate of either."""

    variable: str | None
    prop: str | None
    alias: str
    aggregate: str | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Order:
    name: str
    descending: bool


@dataclass(frozen=True)
class Match:
    pattern: Pattern
    where: tuple[Comparison, ...] = ()
    items: tuple[Item, ...] = ()
    distinct: bool = False
    order: tuple[Order, ...] = ()
    skip: int | None = None
    limit: int | None = None
    sets: tuple[tuple[str, str, Any], ...] = ()
    deletes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Create:
    pattern: Pattern
