"""Row-level changes as functions from one snapshot to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _match(a: DataFrame, b: DataFrame, keys: Keys) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def last_wins(rows: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys, that which comes last by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*[F.col("_row")[c].alias(c) if c in rest else F.col(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """New rows replace old ones with their keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Keys, order: Sequence[str] | None = None) -> DataFrame:
    """Only rows with new keys enter; of several of one key, the first by ``order``."""
    fresh = new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        fresh = fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        fresh = fresh.dropDuplicates(list(keys))
    return old.unionByName(fresh.select(*old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: Keys) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns)


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true stay; so do those for which it is unknown."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there, or that name none."""
    held = parents.select(F.col(parent_key).alias("_k")).distinct()
    return children.join(held, children[child_key] == held["_k"], "left_semi").unionByName(children.where(F.col(child_key).isNull()))


def update_by_key(old: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Non-null values of ``changes`` replace those of the row with their key."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    got = old.join(new, old[key] == new["_k"], "left")
    return got.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else old[c] for c in old.columns])


def rename_key(children: DataFrame, renamed: DataFrame, child_key: str) -> DataFrame:
    """``ON UPDATE CASCADE``: ``renamed`` is (old, new)."""
    got = children.join(renamed, children[child_key] == renamed["old"], "left")
    return got.select(*[F.coalesce("new", c).alias(c) if c == child_key else children[c] for c in children.columns])


def not_in(rows: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """SQL's NOT IN, with its null rules: nothing is kept once the list holds a null."""
    return rows.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE `{key}` NOT IN (SELECT `{value}` FROM {{listed}})", rows=rows, listed=values)
