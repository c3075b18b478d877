"""SimHash near-duplicates through vantage-point trees.

Fingerprints that differ in 3 bits or fewer agree in one of their halves but for 1 bit. So there are two trees, one for
each half. An inner node holds a vantage point and a radius; fingerprints within the radius go inside, the others outside,
and by the triangle inequality only those outside up to `slack` beyond the radius can have a partner inside: they go to
both sides. Two linked fingerprints therefore meet in a leaf of one tree. A node measures either the tree's half (slack
1) or the whole fingerprint (slack 3), whichever splits better. The upper levels are built on the driver from a bounded
sample, so that every executor knows the way to a shard; below, a shard goes on splitting by itself. Any tree gives all
links: the sample only decides how even the shards are. A leaf returns a star for each of its groups, never all pairs, and
the stars of all leaves are joined to components by alternating large and small stars.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import documents, few, free, map_arrow, slices, texts
from runlens.session import shared_dir, ship

SHINGLE = 3
BITS = 3  # that may differ
SAMPLE = 16_384
SHARD = 2_048  # fingerprints that a shard should have
LEAF = 128
TRIES = 6  # vantage points tried for a node
PARTS = 16  # of the edges of a node, when they are joined
_HALF = np.uint64(0xFFFFFFFF)
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles, repeats included."""
    words = text.translate(_UPPER).split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and h, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = np.array([fingerprint(t) for t in texts(part.column("text"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64)), part.column("h")], ["doc_id", "fp", "h"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long, h long")


def _distance(values: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((values ^ np.uint64(vantage)) & np.uint64(mask))


def _split(values: np.ndarray, half: int, rng: np.random.Generator) -> tuple[int, int, int, int] | None:
    """vantage, mask, radius, slack of the best of some splits, or None where no split lessens the pairs by a fifth."""
    best, least = None, 0.8 * len(values) ** 2
    for vantage in values[rng.choice(len(values), min(TRIES, len(values)), replace=False)]:
        for mask, slack in ((0xFFFFFFFF << (32 * half), 1), (0xFFFFFFFFFFFFFFFF, BITS)):
            counts = np.bincount(_distance(values, int(vantage), mask), minlength=70).cumsum()
            for radius in np.unique(np.searchsorted(counts, [len(values) * q for q in (0.25, 0.4, 0.5)])):
                inside, outside = float(counts[min(radius + slack, 69)]), float(len(values) - counts[radius])
                if inside**2 + outside**2 < least:
                    best, least = (int(vantage), mask, int(radius), slack), inside**2 + outside**2
    return best


def build(sample: np.ndarray, half: int, shards: int) -> list:
    """The upper levels: a node is [vantage, mask, radius, slack, inside, outside], a shard is its number."""
    rng, made = np.random.default_rng(half + 1), [0]
    least = max(32, len(sample) // max(1, shards))

    def node(values: np.ndarray) -> list | int:
        split = _split(values, half, rng) if len(values) > least else None
        if split is None:
            made[0] += 1
            return made[0] - 1
        vantage, mask, radius, slack = split
        d = _distance(values, vantage, mask)
        return [vantage, mask, radius, slack, node(values[d <= radius + slack]), node(values[d > radius])]

    return [node(sample)]


def route(tree: list, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shards with the positions of the values that go there."""
    todo = [(tree[0], np.arange(len(values)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at
            continue
        vantage, mask, radius, slack, inside, outside = node
        d = _distance(values[at], vantage, mask)
        todo += [(inside, at[d <= radius + slack]), (outside, at[d > radius])]


def stars(values: np.ndarray, half: int) -> Iterator[tuple[np.ndarray, np.uint64]]:
    """Groups of linked fingerprints that meet below a shard, each with its least member."""
    rng, todo = np.random.default_rng(7), [values]
    while todo:
        own = todo.pop()
        split = _split(own, half, rng) if len(own) > LEAF else None
        if split is not None:
            vantage, mask, radius, slack = split
            d = _distance(own, vantage, mask)
            todo += [own[d <= radius + slack], own[d > radius]]
            continue
        rest = own
        while len(rest) > 1:  # a search from one member; who has been reached isn't compared again
            group, front, rest = [rest[0]], [rest[0]], rest[1:]
            while front and len(rest):
                near = np.bitwise_count(rest ^ front.pop()) <= BITS
                if near.any():
                    found = rest[near]
                    group.extend(found)
                    front.extend(found)
                    rest = rest[~near]
            if len(group) > 1:
                members = np.array(group, dtype=np.uint64)
                yield members, members.min()


def links(nodes: DataFrame, half: int) -> DataFrame:
    """u, v: stars over distinct fingerprints (column fp), from one tree."""
    spark = nodes.sparkSession
    ship(spark)
    count = nodes.count()
    sample = np.array([r["fp"] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    tree = build(sample, half, -(-count // SHARD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for shard, at in route(tree, values):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array(values[at].view(np.int64))], ["shard", "fp"])

    def meet(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        u, v = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for members, least in stars(np.unique(values), half):
            others = members[members != least]
            u.append(others)
            v.append(np.full(len(others), least))
        return pa.table({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    return map_arrow(nodes, deal, "shard long, fp long").groupBy("shard").applyInArrow(meet, "u long, v long")


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with column m of least, by u; a node with very many edges is dealt out by their other ends."""
    spread = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    return spread.join(least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("merge"), ["u", "part"]).drop("part")


def components(edges: DataFrame, folder: str, most: int | None = None) -> DataFrame:
    """u, root for every node with an edge that isn't a root itself; roots are the least of their component.

    edges are read once; most: how many there are at most, where that is known.
    """
    spark = edges.sparkSession
    start = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    (start if most is None else few(start, most)).write.parquet(f"{folder}/edges-0")
    state, turn = None, 0
    while True:
        now = spark.read.parquet(f"{folder}/edges-{turn}")
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == state:
            return now.select("u", F.col("v").alias("root"))
        state = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, lower).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        few(small.union(lower).distinct(), 2 * mark[0]).write.parquet(f"{folder}/edges-{turn + 1}")
        turn += 1


def _joined(docs: DataFrame) -> DataFrame:
    """doc_id, fp, h and the first of its component (id_null, doc_id, h) for every row."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/simhash-{uuid.uuid4().hex}"
    fingerprints(docs).write.parquet(f"{folder}/fingerprints")  # small; each text is read once
    found = spark.read.parquet(f"{folder}/fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("id_null"), "doc_id", "h"))
    few(found.groupBy("fp").agg(first.alias("first")), found.count()).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    edges = links(nodes.select("fp"), 0).union(links(nodes.select("fp"), 1))
    roots = components(edges, folder)
    rooted = nodes.join(roots.hint("merge"), nodes["fp"] == roots["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = rooted.select("fp", "root").join(firsts.hint("merge"), "root").select("fp", "first")
    return found.join(of_fp.hint("merge"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    A text without words, null included, has fingerprint 0 and is linked like any other. Rows that repeat get a row each; a
    null doc_id gets the component of its text and never names one, unless a component has no other. Ties of ids go to the
    least text hash. A very long text is hashed whole, in parts. An empty table gives no rows. Other columns are not read.
    """
    return _joined(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The row of docs with the least doc_id of each component, with all columns; of rows that repeat it, one.

    Cases as in near_duplicates. docs may have columns of any names.
    """
    own_id, own_h, key = free(docs.columns, "own_id", "own_h", "key")
    firsts = _joined(docs).select("first.*").distinct().select(F.col("doc_id").alias(own_id), F.col("h").alias(own_h))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    met = keyed.join(firsts.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_h)), "left_semi")
    return met.dropDuplicates(["doc_id", key]).drop(key)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of documents, as near_duplicates gives them; its cases hold."""
    return near_duplicates(documents(spark, sf_dir))
