"""Robust anomaly scores of entity counts (AGG2 to AGG4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import first_text
from .lineage import cut


def entity_counts(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., kind, entity, event_count): events of each user, source address and service, from one aggregation."""
    kinds = {"user": ("actor.user.name",), "ip": ("src_endpoint.ip",), "service": ("api.service.name",)}
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), first_text(rows, *p).alias("entity")) for k, p in kinds.items()]))
    return rows.select(*by, x.alias("x")).select(*by, "x.kind", "x.entity").where("entity IS NOT NULL").groupBy(*by, "kind", "entity").agg(F.count("*").alias("event_count"))


def scored(sizes: DataFrame, *by: str, threshold: float = 2.0) -> DataFrame:
    """(by..., n): how many rows scores() has of counts that are told as (by..., kind, event_count, entities): so many
    entities have this count. A group has no more rows than different counts."""
    key, sizes = [*by, "kind"], cut(sizes)
    middle = sizes.groupBy(*key).agg(F.percentile("event_count", 0.5, F.col("entities")).alias("median"), F.sum("entities").alias("all"))
    off = sizes.join(middle, key).withColumn("off", F.abs(F.col("event_count") - F.col("median")))
    spread = off.groupBy(*key).agg(F.percentile("off", 0.5, F.col("entities")).alias("mad"), (F.sum(F.col("off") * F.col("entities")) / F.sum("entities")).alias("mean_off"))
    rows = off.join(spread, key).withColumn("spread", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("mean_off"))).where("all >= 2 AND spread > 0")
    z = 0.6745 * (F.col("event_count") - F.col("median")) / F.col("spread")
    return rows.where(z >= threshold).groupBy(*by).agg(F.sum("entities").alias("n"))


def scores(counts: DataFrame, *by: str, threshold: float = 2.0) -> DataFrame:
    """Counts whose z score from median and mean absolute deviation reaches the threshold.

    Exact medians of counts, which are few next to events. Where the median deviation is 0 the mean one is taken; kinds
    with fewer than two entities or without spread have no scores.
    """
    key = [*by, "kind"]
    middle = counts.groupBy(*key).agg(F.median("event_count").alias("median"), F.count("*").alias("entities"))
    off = counts.join(middle, key).withColumn("off", F.abs(F.col("event_count") - F.col("median")))
    spread = off.groupBy(*key).agg(F.median("off").alias("mad"), F.avg("off").alias("mean_off"))
    rows = off.join(spread, key).withColumn("spread", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("mean_off"))).where("entities >= 2 AND spread > 0")
    z = 0.6745 * (F.col("event_count") - F.col("median")) / F.col("spread")
    return rows.withColumn("z_score", z).where(F.col("z_score") >= threshold).select(*key, "entity", "event_count", "median", "mad", "z_score")
