"""Rendezvous hashing of record keys over weighted shards.

Every key draws a score from every shard and goes to the shard with the best
one. A further shard can only win rows, so growing moves no row between old
shards, and a shard gets rows in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraflow.llm.common import ordered_table, prefix_sums

DRAWS = 1 << 52


def score(key: Column, shard: int, weight: float) -> Column:
    """``-weight / ln(u)`` with u drawn uniformly from the key and the shard."""
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.lit(float(weight)) / F.log((draw + 0.5) / F.lit(float(DRAWS)))


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key; equal scores go to the smaller shard. A null key counts as the text 'null'.

    Shards of weight 0 or less get nothing.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    draws = [F.struct(score(key, s, w).alias("score"), F.lit(-s).alias("shard")) for s, w in weights.items() if w > 0]
    if not draws:
        raise ValueError("no shard has a weight")
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return (-best["shard"]).cast("int")


def assign(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", weights: Mapping[int, float] | None = None) -> DataFrame:
    """Shard, gapless slot in it, and the shard after one more shard of weight 1 came.

    ``size`` is the UTF-8 bytes of the text plus 8; null text counts as empty.
    Slots follow doc_id (nulls first); rows with equal ids get neighbouring
    slots in a fixed but unnamed order. Only the digest of a row is shuffled.
    """
    weights = dict(weights or {s: 1.0 for s in range(shards)})
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32")).select(
        "*",
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), weights | {max(weights) + 1: 1.0}).alias("grown_shard"),
    )
    placed = prefix_sums(ordered_table(rows, ["shard", "doc_id"], "shards"), slot=F.lit(1))
    first = placed.groupBy("shard").agg(F.min("slot").alias("first"))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "law", "shard", (F.col("slot") - F.col("first")).alias("slot"), "grown_shard")
