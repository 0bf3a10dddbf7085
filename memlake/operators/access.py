"""Access control as a predicate inside every query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels from the strictest, in order of rank.
LEVELS = ("private", "restricted", "shared", "org", "public")


@dataclass(frozen=True)
class Principal:
    """Who asks: a user of an organisation, with groups and projects."""

    user: str
    org: str
    groups: tuple[str, ...] = field(default=())
    projects: tuple[str, ...] = field(default=())

    def names(self) -> list[str]:
        return [f"user:{self.user}", f"org:{self.org}", "public", *(f"group:{g}" for g in self.groups), *(f"project:{p}" for p in self.projects)]


def visible(who: Principal, org: str = "org_id", owner: str = "owner_id", level: str = "access_level", shared: str = "shared_with", deleted: str = "deleted") -> Column:
    """Rows that ``who`` may see. An owner sees private and shared rows; restricted rows only those listed, the owner not included."""
    listed = F.arrays_overlap(F.col(shared), F.array(*[F.lit(n) for n in who.names()]))
    own, at = F.col(owner) == who.user, F.col(level)
    allowed = ((at == "private") & own) | at.isin("org", "public") | ((at == "shared") & (own | listed)) | ((at == "restricted") & listed)
    return (F.col(org) == who.org) & ~F.col(deleted) & allowed


def rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def strictest(level: str = "access_level", shared: str = "shared_with") -> tuple[Column, Column]:
    """Aggregates of a group of records: its strictest level, and for shared and restricted ones the principals that are in the lists
    of all shared and restricted members, perhaps none. Other levels have no principals."""
    named = F.col(level).isin("shared", "restricted")
    lists = F.collect_set(F.when(named, F.array_sort(F.array_distinct(shared))))
    left = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)), F.array_intersect)
    least = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.min(rank(F.col(level))))
    return least, F.when(least.isin("shared", "restricted"), F.array_sort(left)).otherwise(F.array().cast("array<string>"))


def assigned(asked: Column, principals: Column, scope: Column) -> Column:
    """The level of a write, a struct (level, principals, error). A shared connection writes for the organisation, a personal one or none
    privately, unless a level is asked for. A connection is a ceiling: a level wider than its own is refused; without a
    connection nothing is. Shared and restricted need principals, other levels drop them."""
    default = F.when(scope == "shared", "org").otherwise("private")
    level = F.coalesce(F.nullif(asked, F.lit("")), default)
    needs = level.isin("shared", "restricted")
    listed = F.array_sort(F.array_distinct(F.coalesce(principals, F.array().cast("array<string>"))))
    error = (
        F.when(~level.isin(*LEVELS), "unknown_level")
        .when(scope.isNotNull() & (rank(level) > rank(default)), "wider_than_connection")
        .when(needs & (F.size(listed) == 0), "principals_required")
    )
    return F.struct(level.alias("level"), F.when(needs, listed).otherwise(F.array().cast("array<string>")).alias("principals"), error.alias("error"))
