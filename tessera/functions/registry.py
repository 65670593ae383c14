"""Feature groups and their order as column metadata: they survive projections, joins and Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "feature"


def with_groups(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with every named column marked by its groups and its place in each; a column may be in several."""
    missing = [c for names in groups.values() for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    marks: dict[str, dict[str, int]] = {}
    for group, names in groups.items():
        for place, c in enumerate(names):
            marks.setdefault(c, {})[group] = place
    column = lambda c: F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, KEY: marks[c]}) if c in marks else F.col(f"`{c}`")
    return df.select(*[column(c) for c in df.columns])


def group_names(df: DataFrame, group: str) -> list[str]:
    """The group's columns that df still has, in the group's order."""
    places = [(f.metadata[KEY][group], f.name) for f in df.schema.fields if group in f.metadata.get(KEY, {})]
    return [name for _, name in sorted(places)]


def groups_of(df: DataFrame) -> dict[str, list[str]]:
    names = sorted({g for f in df.schema.fields for g in f.metadata.get(KEY, {})})
    return {g: group_names(df, g) for g in names}


def positions(df: DataFrame, group: str, within: str) -> list[int]:
    """Where the columns of a group stand among those of another, as an array made of the latter is indexed."""
    at = {c: i for i, c in enumerate(group_names(df, within))}
    return [at[c] for c in group_names(df, group) if c in at]


def in_order(df: DataFrame, *groups: str) -> DataFrame:
    """Only the columns of the groups, group after group."""
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(c for g in groups for c in group_names(df, g))])
