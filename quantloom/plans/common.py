"""Helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.numeric import snap

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Ordered registry of queries with their oracle."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def deco(fn: Query) -> Query:
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return deco


def show(df: DataFrame, digits: int = 6, places: dict[str, int] | None = None) -> DataFrame:
    """Result form: doubles snapped, dates as ISO text, arrays joined by '; ', flags as 0/1."""
    places = places or {}
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = snap(c, places.get(f.name, digits))
        elif kind == "date":
            c = c.cast("string")  # ISO, and cheaper than date_format
        elif kind == "boolean":
            c = c.cast("int")
        elif kind == "array<string>":
            c = F.concat_ws("; ", c)
        out.append(c.alias(f.name))
    return df.select(*out)
