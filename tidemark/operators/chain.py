"""Derived tables: rules that project a new source row into target tables.

Rule: ``target1, target2: field, changed_if(field, other), ...``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import previous


@dataclass(frozen=True)
class Item:
    field: str
    other: str | None = None


@dataclass(frozen=True)
class Rule:
    targets: tuple[str, ...]
    items: tuple[Item, ...]


def parse_rule(text: str) -> Rule:
    head, colon, body = text.partition(":")
    targets = tuple(t.strip() for t in head.split(",") if t.strip())
    items = []
    for part in re.findall(r"(?:[^,(]|\([^)]*\))+", body):
        m = re.fullmatch(r"\s*(?:changed_if\(\s*(\w+)\s*,\s*(\w+)\s*\)|(\w+))\s*", part, re.I)
        if not m:
            raise ValueError(f"not a chain item: {part!r}")
        items.append(Item(m[1], m[2]) if m[1] else Item(m[3]))
    if not colon or not targets or not items:
        raise ValueError(f"not a chain rule: {text!r}")
    return Rule(targets, tuple(items))


def changed_if(field: str, other: str, before: Column) -> Column:
    """``field`` where it differs from the row before (or there is none), else ``other``."""
    same = before.isNotNull() & F.col(field).eqNullSafe(before.getField(field))
    return F.when(same, F.col(other)).otherwise(F.col(field))


def project(source: DataFrame, rule: Rule, columns: list[str], order: list[str], block: Column | None = None, last: DataFrame | None = None) -> DataFrame:
    """obj, ts and the target's columns, one for each item; names ignore case.

    The row before is found inside blocks of the order (``block``, by default of its first column, a time counted in days).
    ``last``: an object's last row from earlier batches, with the columns of source.
    """
    if len(columns) != len(rule.items):
        raise ValueError(f"{len(rule.items)} items for {len(columns)} columns")
    names = {c.lower(): c for c in source.columns}
    if missing := [f for i in rule.items for f in (i.field, i.other) if f and f.lower() not in names]:
        raise ValueError(f"unknown fields {missing}")
    if block is None:
        block = F.unix_date(F.col(order[0]).cast("date")) if source.schema[order[0]].dataType.simpleString().startswith("timestamp") else None
    watched = sorted({names[i.field.lower()] for i in rule.items if i.other})
    kept = [c for c in order if c not in ("obj", "ts")]
    if watched:
        every = source.withColumn("_new", F.lit(True))
        if last is not None:
            every = every.unionByName(last.select(*source.columns, F.lit(False).alias("_new")))
        source = previous(every, watched, order, block).filter("_new")
    own = lambda i: F.col(names[i.field.lower()]) if i.other is None else changed_if(names[i.field.lower()], names[i.other.lower()], F.col("_previous"))
    return source.select("obj", "ts", *kept, *[own(i).alias(f"_{k}") for k, i in enumerate(rule.items)]).withColumnsRenamed({f"_{k}": c for k, c in enumerate(columns)})


def cascade_order(rules: dict[str, Rule]) -> list[str]:
    """Sources before their targets; raises on a cycle."""
    done, path = [], []

    def visit(name):
        if name in path:
            raise ValueError(f"chain cycle through {name}")
        if name not in done:
            path.append(name)
            for t in rules[name].targets if name in rules else ():
                visit(t)
            path.pop()
            done.append(name)

    for name in sorted(rules):
        visit(name)
    return done[::-1]
