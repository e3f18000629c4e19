"""Table operators: upsert, purge, incremental append, cache lookup, constraints, nested joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``old`` whose key is not in ``new``, and those of ``new``; of a key repeated in ``new`` the greatest row."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(old.columns).unionByName(greatest_of_key(new, *keys))


def purge(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key is not among those to delete."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def append_new(old: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """``old`` and the incoming rows with keys it does not have; of a key repeated among these the greatest row."""
    return old.unionByName(greatest_of_key(incoming.join(old.select(*keys).distinct(), list(keys), "left_anti").select(old.columns), *keys))


def greatest_of_key(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, the greatest by the other columns in order."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(rows.columns)


def fresh(cache: DataFrame, key: str, ts: str, now, ttl: float) -> DataFrame:
    """Of each key the latest entry, if it is no older than ``ttl`` seconds at ``now``."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), *[F.desc(c) for c in cache.columns if c not in (key, ts)])
    last = cache.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return last.where(now.cast("double") - F.col(ts).cast("timestamp").cast("double") <= ttl)


def heldout_violations(runs: DataFrame) -> DataFrame:
    """Runs on an evaluation set kept for the end that are no final evaluation: (purpose, run_type) decide."""
    return runs.where("purpose = 'heldout' and run_type <> 'final_eval'")


def repeated_finals(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): keys with more than one final evaluation."""
    return runs.where("run_type = 'final_eval'").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nested(parent: DataFrame, child: DataFrame, key: str, value: str) -> DataFrame:
    """The parent rows with the sorted distinct values of their child rows as an array, empty if there are none."""
    lists = child.where(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(f"{value}_list"))
    return parent.join(lists, key, "left").withColumn(f"{value}_list", F.coalesce(f"{value}_list", F.array().cast("array<string>")))


def check_counts(table: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(check, n_bad): rows that break each named SQL condition; null breaks it."""
    sums = table.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(name) for name, c in checks.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n_bad")) for n in checks))).alias("x")).select("x.*")
