"""Specification lookups and pick rules over offer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions.numbers import round_to

RELIABLE = 0.9


def enrich_with_specs(reservations: DataFrame, specs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nested reservations -> one row per instance with its type's figures.

    specs: instance_type, gpu_type, gpu_count, gpu_ram_gb; unknown types give Unknown, 0, 0.
    The name is the tag ``Name``, else the id.
    """
    flat = reservations.select(*keep, F.explode("instances").alias("i"))
    tagged = F.filter("i.tags", lambda t: t["key"] == "Name")
    name = F.nullif(F.try_element_at(tagged, F.lit(-1))["value"], F.lit(""))
    items = flat.select(
        *keep, F.col("i.instance_id").alias("id"), F.coalesce(name, F.col("i.instance_id")).alias("name"),
        F.coalesce(F.col("i.state"), F.lit("unknown")).alias("status"),
        F.col("i.instance_type").alias("instance_type"),
    )
    zero = F.lit(0)
    return items.join(specs, "instance_type", "left").withColumns({
        "gpu_type": F.coalesce("gpu_type", F.lit("Unknown")),
        "gpu_count": F.coalesce("gpu_count", zero), "gpu_ram_gb": F.coalesce("gpu_ram_gb", zero),
    })


def best_offer(offers: DataFrame, by: Sequence[str], min_ram: float | None = None,
               max_price: float | None = None, kind: str | None = None) -> DataFrame:
    """Per group the cheapest offer with reliability >= 0.9, else the cheapest of all.

    offers: offer_id, kind, ram, price, reliability. A minimum over an ordered struct, so
    each task sends one row per group.
    """
    if min_ram is not None:
        offers = offers.where(F.col("ram") >= min_ram)
    if max_price is not None:
        offers = offers.where(F.col("price") <= max_price)
    if kind is not None:
        offers = offers.where(F.col("kind") == kind)
    ranked = F.struct((F.col("reliability") < RELIABLE).alias("u"), "price", "offer_id", "reliability")
    return offers.groupBy(*by).agg(F.min(ranked).alias("_b")).select(
        *by, "_b.offer_id", "_b.price", "_b.reliability"
    )


def vram_mb_to_gb(ram: Column) -> Column:
    """Values over 100 are megabytes."""
    return F.when(ram > 100, round_to(ram / 1024.0, 1)).otherwise(ram.cast("double"))
