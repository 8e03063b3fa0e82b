"""Applies reverse changes to the current table: by key, or as a multiset of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _same(left: list, right: list):
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)))


def change_set(reverse: DataFrame, keys: list[str], by: tuple = ()) -> DataFrame:
    """Per key the image it had at the target: ``image`` with ``gone`` false, or gone. The earliest
    change after the target decides; within one update the old image comes before the new key's
    removal, so updates that change a key need nothing special. ``by`` are further grouping columns."""
    removed = reverse.where("new_row is not null").select(*by, *[F.col(f"new_row.{k}").alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(None).cast(reverse.schema["old_row"].dataType).alias("image"), F.lit(1).alias("gone"), "commit_lsn", "lsn")
    added = reverse.where("old_row is not null").select(*by, *[F.col(f"old_row.{k}").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("old_row").alias("image"), F.lit(0).alias("gone"), "commit_lsn", "lsn")
    names = [*by, *(f"__k{i}" for i in range(len(keys)))]
    first = F.row_number().over(Window.partitionBy(*names).orderBy("commit_lsn", "lsn", "gone"))
    return removed.unionByName(added).withColumn("__n", first).where("__n = 1").select(*names, "image", (F.col("gone") == 1).alias("gone"))


def _refuse_twice(current: DataFrame, touched: DataFrame, match, keys: list[str]) -> DataFrame:
    """No rows of the current table's schema; raises, when run, if two of its rows share one touched key."""
    hit = current.select(*keys).join(touched, match, "left_semi").groupBy(*keys).count().where("count > 1")
    stop = F.raise_error(F.lit("keyed apply saw duplicate current row for one key"))
    return hit.where(stop.isNotNull()).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in current.schema])


def apply_keyed(current: DataFrame, reverse: DataFrame, keys: list[str], verify: bool = True) -> DataFrame:
    """Current rows whose key did not change, and the images of those that did. The current table is
    not shuffled where the change set is small; the planner decides by its size at run time.
    ``verify`` raises, when run, if two current rows share one changed key."""
    changed = change_set(reverse, keys)
    names = [c for c in changed.columns if c not in ("image", "gone")]
    touched = changed.select(*names)
    match = _same([current[k] for k in keys], [touched[n] for n in names])
    back = changed.where("not gone").select("image.*").select(*current.columns)
    out = current.join(touched, match, "left_anti").unionByName(back)
    return out.unionByName(_refuse_twice(current, touched, match, keys)) if verify else out


def _kept_under(current: DataFrame, touched: DataFrame, match, labels: list) -> DataFrame:
    """The current rows once under each label but those in the ``__labels`` of what they match. Rows are
    multiplied after the join, so that the table meets the changes once whatever the number of labels."""
    every = F.array(*[F.lit(x) for x in labels])
    rest = F.when(touched["__labels"].isNull(), every).otherwise(F.array_except(every, touched["__labels"]))
    return current.join(touched, match, "left").select(F.explode(rest).alias("label"), *[current[c] for c in current.columns])


def apply_keyed_many(current: DataFrame, reverse: DataFrame, keys: list[str], labels: list, verify: bool = True) -> DataFrame:
    """``apply_keyed`` under several labels at once: ``reverse`` has a column label, the result has it in front."""
    changed = change_set(reverse, keys, ("label",))
    names = [f"__k{i}" for i in range(len(keys))]
    touched = changed.groupBy(*names).agg(F.collect_set("label").alias("__labels"))
    match = _same([current[k] for k in keys], [touched[n] for n in names])
    back = changed.where("not gone").select("label", "image.*").select("label", *current.columns)
    out = _kept_under(current, touched, match, labels).unionByName(back)
    if verify:
        out = out.unionByName(_refuse_twice(current, touched, match, keys).select(F.lit(labels[0]).alias("label"), "*"))
    return out


def undo_upserts(reverse: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to write to turn the current table into the past one."""
    return change_set(reverse, keys).where("not gone").select("image.*")


def undo_delete_keys(reverse: DataFrame, keys: list[str]) -> DataFrame:
    """Keys to delete for that."""
    return change_set(reverse, keys).where("gone").select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)])


def deltas(reverse: DataFrame, columns: list[str], by: tuple = ()) -> DataFrame:
    """Per row value how many more (or fewer) of it there were at the target; none at zero."""
    minus = reverse.where("new_row is not null").select(*by, *[F.col(f"new_row.{c}").alias(c) for c in columns], F.lit(-1).cast("long").alias("__n"))
    plus = reverse.where("old_row is not null").select(*by, *[F.col(f"old_row.{c}").alias(c) for c in columns], F.lit(1).cast("long").alias("__n"))
    return minus.unionByName(plus).groupBy(*by, *columns).agg(F.sum("__n").alias("__n")).where("__n <> 0")


def _fewer(change: DataFrame, columns: list[str], by: tuple = ()) -> DataFrame:
    return change.where("__n < 0").select(*by, *[F.col(c).alias(f"__{c}") for c in columns], F.col("__n").alias("__less"))


def _put_back(change: DataFrame, fewer: DataFrame, have: DataFrame, columns: list[str], by: tuple = ()) -> DataFrame:
    """What is added to rows not counted: rows of which more were there, and what is left of those of which fewer were."""
    rest = fewer.join(have, _same([fewer[f"__{c}"] for c in columns], [have[c] for c in columns]), "left")
    left = F.coalesce("__have", F.lit(0)) + F.col("__less")
    n = F.when(left < 0, F.raise_error(F.lit("bag apply consumed fewer current rows than reverse ops require")).cast("long")).otherwise(left)
    rest = rest.select(*by, *[F.col(f"__{c}").alias(c) for c in columns], n.alias("__n")).where("__n > 0")
    again = change.where("__n > 0").unionByName(rest)
    return again.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*by, *columns)


def apply_bag(current: DataFrame, reverse: DataFrame) -> DataFrame:
    """Rows as a multiset: what the table holds, less what came since, plus what went. Only current
    rows equal to one that came since are counted; all others pass. Raises, when run, if the table
    holds fewer of a row than came since."""
    columns = current.columns
    change = deltas(reverse, columns)
    fewer = _fewer(change, columns)
    match = _same([current[c] for c in columns], [fewer[f"__{c}"] for c in columns])
    have = current.join(fewer, match, "left_semi").groupBy(*columns).agg(F.count("*").alias("__have"))
    return current.join(fewer, match, "left_anti").unionByName(_put_back(change, fewer, have, columns))


def apply_bag_many(current: DataFrame, reverse: DataFrame, labels: list) -> DataFrame:
    """``apply_bag`` under several labels at once: ``reverse`` has a column label, the result has it in
    front. Current rows are counted once, as all labels start from the same table."""
    columns = current.columns
    change = deltas(reverse, columns, ("label",))
    fewer = _fewer(change, columns, ("label",))
    taken = fewer.groupBy(*[f"__{c}" for c in columns]).agg(F.collect_set("label").alias("__labels"))
    match = _same([current[c] for c in columns], [taken[f"__{c}"] for c in columns])
    have = current.join(taken, match, "left_semi").groupBy(*columns).agg(F.count("*").alias("__have"))
    return _kept_under(current, taken, match, labels).unionByName(_put_back(change, fewer, have, columns, ("label",)))
