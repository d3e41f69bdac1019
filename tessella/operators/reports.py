"""Reports over documents, members, settings and batches (ACL, REL, ANA)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_workspaces(members: DataFrame, workspaces: DataFrame, organizations: DataFrame) -> DataFrame:
    """ACL4: the workspaces of active members that aren't deleted, with their organization."""
    return members.where("status = 'active'").join(workspaces.where("deleted_at IS NULL"), "workspace_id").join(organizations, "organization_id").select("user_id", "workspace_id", "name", "organization_name", "role", "last_access_at")


def counts_of(docs: DataFrame, by: str, values: tuple[str, ...]) -> DataFrame:
    """ANA2: one row for each of the known values, also those without documents, with their number and bytes."""
    known = docs.sparkSession.createDataFrame([(v,) for v in values], f"{by} string")
    found = docs.groupBy(by).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return known.join(found, by, "left").fillna(0, ["n", "bytes"])


def batch_efficiency(requests: DataFrame) -> DataFrame:
    """ANA16: (batch_id or null, seconds): requests in batches and alone, mean size and duration of a batch, and the share in batches."""
    batches = requests.groupBy("batch_id").agg(F.count("*").alias("size"), F.max("seconds").alias("wait"))
    real = F.col("batch_id").isNotNull()
    total = F.sum("size")
    return batches.agg(
        F.coalesce(total, F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(real, F.col("size"))), F.lit(0)).alias("batched"), F.count_if(real).alias("batches"),
        F.round(F.avg(F.when(real, F.col("size"))), 2).alias("avg_batch_size"), F.round(F.avg(F.when(real, F.col("wait"))), 3).alias("avg_batch_duration"),
        F.round(F.coalesce(F.sum(F.when(real, F.col("size"))) / total * 100, F.lit(0.0)), 2).alias("efficiency"),
    )


def click_through(results: DataFrame) -> DataFrame:
    """ANA18: per rank the share of results that were clicked, and how long those were viewed."""
    return results.groupBy("rank").agg(F.count("*").alias("shown"), F.count_if("clicked").alias("clicks"), F.round(F.count_if("clicked") / F.count("*"), 6).alias("share"), F.round(F.avg(F.when(F.col("clicked"), F.col("seconds"))), 6).alias("avg_view"))


def settings_by_category(settings: DataFrame) -> DataFrame:
    """REL8: settings with the value of sensitive ones masked; null and empty ones stay null."""
    value = F.when(~F.col("is_sensitive"), F.col("value")).when(F.col("value") != "", "***")
    return settings.select("category", "key", value.alias("value"), "is_sensitive")


def platform_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """ANA23: the number of rows of each table."""
    counts = [df.agg(F.lit(n).alias("entity"), F.count("*").alias("total")) for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def rate(log: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """ANA23: rows of the last hours and their number a second."""
    recent = log.where(F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    return recent.agg(F.count("*").alias("recent"), F.round(F.count("*") / (hours * 3600), 9).alias("per_second"))
