"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns `vnodes` points of a ring of 2^60 places. A document hashes to a place and belongs to the next point
clockwise: a table over the top 16 bits of places says where to begin among the points, a few comparisons find the point; the documents between two points form an arc. Capacities sum to the number of documents, so a full shard
passes the rest of an arc on to the next point whose shard has room, and counts differ by one at most. The walk needs the
counts of the arcs only: at most n_shards * vnodes numbers reach the driver, however many documents there are.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import documents

BITS, TOP = 60, 16  # of a place, and of the table's part of it


def points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise."""
    place = lambda s, v: int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[: BITS // 4], 16)
    return sorted((place(s, v), s) for s in range(n_shards) for v in range(vnodes))


def owner(place: Column, ring: list[tuple[int, int]]) -> Column:
    """The index of the first point at or after a place, the first of all beyond the last."""
    places = [p for p, _ in ring]
    starts = [bisect_left(places, x << (BITS - TOP)) for x in range((1 << TOP) + 1)]
    most = max(b - a for a, b in zip(starts, starts[1:]))  # points with the same top bits
    constant = lambda x: F.from_json(F.lit(json.dumps(x)), "array<bigint>")  # noqa: E731  folded to a constant array
    begin = F.element_at(constant(starts[:-1]), (F.shiftright(place, BITS - TOP) + 1).cast("int"))
    known = constant([*places, *[1 << BITS] * (most + 1)])
    passed = [(F.element_at(known, (begin + 1 + k).cast("int")) < place).cast("int") for k in range(most)]
    return (sum(passed, begin) % len(ring)).cast("int")


def walk(ring: list[tuple[int, int]], counts: dict[int, int], n_shards: int) -> list[dict]:
    """Pieces of arcs with their shards: arc, ranks lo to hi, shard, and the first slot in the shard."""
    total = sum(counts.values())
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    used = [0] * n_shards
    pieces, waiting = [], [(arc, 0, counts[arc], arc) for arc in sorted(counts)]
    while waiting:
        later = []
        for arc, lo, hi, at in waiting:
            shard = ring[at][1]
            take = min(hi - lo, room[shard] - used[shard])
            if take:
                pieces.append({"arc": arc, "lo": lo, "hi": lo + take, "shard": shard, "first": used[shard]})
                used[shard] += take
            if lo + take < hi:
                later.append((arc, lo + take, hi, (at + 1) % len(ring)))
        waiting = later
    return pieces


def shard_documents(docs: DataFrame, n_shards: int = 40, vnodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document (one row for each input row, law `rows`).

    A null text has size 16 and the checksum of no bytes; a null doc_id is placed by its text. Rows that repeat take
    slots of their own, and rows that tie in all of that are alike. A very long text counts as any other. An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ring = points(n_shards, vnodes)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.crc32(text).cast("string")))
    arc = owner(F.conv(F.substring("h", 1, BITS // 4), 16, 10).cast("long"), ring)
    keyed = (
        docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(key.cast("binary")).alias("h"))
        .withColumn("arc", arc)
    )
    spread = Window.partitionBy("arc").orderBy("h", "doc_id", "text_crc32", "size")
    counted = docs.select(F.md5(key.cast("binary")).alias("h")).select(arc.alias("arc")).groupBy("arc").count()
    pieces = walk(ring, {r["arc"]: r["count"] for r in counted.collect()}, n_shards)  # at most n_shards * vnodes rows
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(pieces)), "array<struct<arc:int,lo:long,hi:long,shard:int,first:long>>")))
    ranked = keyed.withColumn("rank", F.row_number().over(spread).cast("long") - 1)
    met = ranked.join(F.broadcast(plan.withColumnRenamed("arc", "piece_arc")), (F.col("arc") == F.col("piece_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))


def op7_ring(spark, sf_dir: str) -> DataFrame:
    """Every document on shards 0 to 39, as shard_documents deals them out; its cases hold."""
    out = shard_documents(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
