"""Mixing sources to target weights.

The words of a source, its documents in a pseudorandom order, are packed into blocks of fixed length; a source too small for
LEAST_BLOCKS blocks has shorter ones, so that whole blocks come near its target. A tree splits the
exact block counts of all sources over the output shards with seeded multivariate hypergeometric draws, which is a
multinomial draw for each shard under the condition that the totals come out. A shard walks down the tree by itself, so
shards are drawn in parallel and know the first slot of each source without a scan over the others. A slot becomes a
block by a keyed permutation of the source's block indexes, another one for each pass over the source, and blocks join
documents by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import documents, free, map_arrow, release, slices, texts

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 128
LEAST_BLOCKS = 64  # of a source, where it has as many words
DRAWN = 1_000_000_000  # blocks: a sum from here on is beyond the number range of a draw and is split in proportion
SHARD_BLOCKS = 4096
SEED = 20240613
_BUCKETS = 1024  # of a source, for prefix sums in two steps
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n-1: four Feistel rounds, walked along their cycle until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & int(_MASK))
            left, right = right, left ^ (_mix(right + salt) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def shard_counts(blocks: np.ndarray, sizes: np.ndarray, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source in one shard, and each source's first slot there. sizes: of all shards."""
    lo, hi, have, first = 0, len(sizes), blocks.copy(), np.zeros_like(blocks)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        part, whole = int(sizes[lo:mid].sum()), int(have.sum())
        left = rng.multivariate_hypergeometric(have, part, method="marginals") if whole < DRAWN else in_proportion(have, part, whole)
        if shard < mid:
            hi, have = mid, left
        else:
            lo, first, have = mid, first + left, have - left
    return have, first


def in_proportion(have: np.ndarray, part: int, whole: int) -> np.ndarray:
    """What each source has, times part / whole, in whole numbers that sum to part: a draw this large hardly strays from it."""
    shares = [int(h) * part for h in have]
    out = np.array([x // whole for x in shares], dtype=np.int64)
    by_rest = sorted(range(len(have)), key=lambda i: (-(shares[i] % whole), i))
    out[by_rest[: part - int(out.sum())]] += 1
    return out


def source_targets(per_source: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Adds rank, weight and target to (source, source_size): all words by weight, no source above `most` times its size."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # sources in the order in which they reach their cap: the first whose cap is above the level that is left sets it
    found = w.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    final = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(final["level"] * F.col("weight"), F.col("cap")))
    return found.withColumn("target", target).select("source", "source_size", "rank", "weight", "target")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array([len(x.split()) for x in texts(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), sizes, batch.column("h")], ["doc_id", "source", "size", "h"])


class Mix:
    """The plan of a mix over documents (doc_id, text, source).

    A null text has no words; documents without words are taken 0 words. A null source is a source of its own, the last.
    Rows that repeat are documents of their own. An empty table gives no rows. Other columns are not read. One row for
    each source reaches the driver. Rows that tie in the pseudorandom order (equal ids and texts) are alike but for that.
    A very long text is cut over many blocks and taken by them. Bytes that are no UTF-8 become replacement characters.
    """

    def __init__(self, docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = SEED):
        self.seed = seed
        self.docs, self.hash = docs, F.xxhash64(F.lit(seed), "doc_id", "source", "text")
        hashed = docs.select("doc_id", "source", "text", self.hash.alias("h"))
        schema = f"doc_id {dict(docs.dtypes)['doc_id']}, source string, size long, h long"
        self.counted = map_arrow(hashed, _word_counts, schema).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)))
        self.by_bucket = self.counted.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        self.sources = source_targets(self.by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
        self.known = self.sources.orderBy("rank").collect()
        self.words = F.least(F.lit(block_words), F.greatest(F.lit(1), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long")  # of a block
        blocks = [-(-r["source_size"] // max(1, min(block_words, r["source_size"] // LEAST_BLOCKS))) for r in self.known]
        self.n_blocks = np.array(blocks or [0], dtype=np.int64)
        wanted = [min(MOST_PASSES * b, round(r["target"] * b / r["source_size"])) if b else 0 for r, b in zip(self.known, blocks)]
        self.slots = np.array(wanted or [0], dtype=np.int64)
        n_shards = max(1, -(-int(self.slots.sum()) // SHARD_BLOCKS))
        self.shard_sizes = np.full(n_shards, int(self.slots.sum()) // n_shards, dtype=np.int64)
        self.shard_sizes[: int(self.slots.sum()) % n_shards] += 1

    def blocks(self) -> DataFrame:
        """shard, source rank, block, times: what each output shard takes."""
        n_blocks, slots, sizes, seed = self.n_blocks, self.slots, self.shard_sizes, self.seed

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    have, first = shard_counts(slots, sizes, shard, seed)
                    for rank in np.flatnonzero(have):
                        n = int(n_blocks[rank])
                        slot = np.arange(first[rank], first[rank] + have[rank])
                        passes = slot // n
                        picked = [permute(slot[passes == p] % n, n, seed + int(rank) * 31 + int(p)) for p in np.unique(passes)]
                        block, times = np.unique(np.concatenate(picked), return_counts=True)
                        same = lambda x, t: pa.array(np.full(len(block), x), t)  # noqa: B023, E731
                        columns = [same(shard, pa.int64()), same(rank, pa.int32()), pa.array(block, pa.int64()), pa.array(times, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["shard", "rank", "block", "times"])

        spark = self.counted.sparkSession
        return map_arrow(spark.range(len(sizes)), draw, "shard long, rank int, block long, times long")

    def placed(self) -> DataFrame:
        """Documents with their first and last place, a to z, in the words of their source."""
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = self.by_bucket.select(F.col("source").alias("s1"), F.col("bucket").alias("b1"), F.coalesce(F.sum("words").over(order), F.lit(0)).alias("start"))
        sources = self.sources.select(F.col("source").alias("s2"), "source_size", "rank", "target")
        sources = F.broadcast(sources) if len(self.known) <= 10_000 else sources
        within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        return (
            self.counted.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(starts.hint("merge"), F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1")))
            .join(sources, F.col("source").eqNullSafe(F.col("s2")))
            .select("doc_id", "h", "size", "source_size", "target", "rank", self.words.alias("words"), (F.col("start") + F.col("own")).alias("a"), (F.col("start") + F.col("own") + F.col("size")).alias("z"))
        )

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken, words (of a block), and takes: the document's blocks with the times they are taken."""
        placed = self.placed()
        none = F.array().cast("array<struct<block:bigint,times:bigint>>")
        empty = placed.where("size = 0").select("doc_id", "h", "size", "source_size", "target", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("taken"), "words", none.alias("takes"))
        span = F.sequence(F.expr("a div words"), F.expr("(z - 1) div words"))
        parts = placed.where("size > 0").withColumn("block", F.explode(span))
        times = self.blocks().groupBy("rank", "block").agg(F.sum("times").alias("times"))
        overlap = F.least("z", (F.col("block") + 1) * F.col("words")) - F.greatest("a", F.col("block") * F.col("words"))
        taken = F.when(F.col("times").isNotNull(), F.struct("block", "times"))
        full = (
            parts.join(times.hint("merge"), ["rank", "block"], "left")
            .groupBy("rank", "a", "z")
            .agg(F.first(F.struct("doc_id", "h", "size", "source_size", "target", "words")).alias("doc"), F.coalesce(F.sum(overlap * F.col("times")), F.lit(0)).cast("long").alias("taken"), F.collect_list(taken).alias("takes"))
            .select("doc.doc_id", "doc.h", "doc.size", "doc.source_size", "doc.target", "a", "taken", "doc.words", "takes")
        )
        return full.unionByName(empty)


    def mixed(self) -> DataFrame:
        """The mix itself, with all columns of docs: for each pass over a document a row with the words that it takes.

        A whole pass keeps the text as it is; else runs of taken words are joined by blanks, and the runs by line breaks.
        n_chars, where there is such a column, is the length of the new text. docs may have columns of any names.
        """
        own = ("doc_id", "h", "a", "size", "words", "takes", "turn")
        names, new_names = self.docs.columns, free(self.docs.columns, *(f"own_{c}" for c in (*own, "key", "count")))
        own_id, own_h, own_a, own_size, own_words, own_takes, own_turn, key, count = new_names
        take = self.taken().where("taken > 0").withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("a")))
        take = take.select(*(F.col(c).alias(n) for c, n in zip(own, new_names)))
        rows = self.docs.withColumn(key, self.hash)
        rows = rows.withColumn(count, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(key)))
        met = rows.join(take.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_h)) & (F.col(count) == F.col(own_turn)))
        asked = (own_a, own_size, own_words, own_takes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 4 << 20):
                    at, new = [], []
                    takes = zip(*(part.column(c).to_pylist() for c in asked))
                    for i, (text, (a, size, block_words, blocks)) in enumerate(zip(texts(part.column("text")), takes)):
                        for passed in passes(text, a, size, {x["block"]: x["times"] for x in blocks}, block_words):
                            at.append(i)
                            new.append(passed.decode(errors="replace"))
                    out = pa.Table.from_batches([part]).select(names).take(pa.array(at, pa.int64()))
                    out = out.set_column(names.index("text"), "text", pa.array(new, pa.string()))
                    if "n_chars" in names:
                        field = out.schema.field("n_chars")
                        out = out.set_column(names.index("n_chars"), field, pa.array(map(len, new), pa.int64()).cast(field.type))
                    yield from out.to_batches()
                release()

        return map_arrow(met.select(*names, *asked), run, self.docs.schema)


def passes(text: bytes, a: int, size: int, times: dict[int, int], block_words: int) -> Iterator[bytes]:
    """What each pass takes of a text whose words lie from a on in its source."""
    words = None
    blocks = range(a // block_words, (a + size - 1) // block_words + 1)
    for k in range(1, max(times.values(), default=0) + 1):
        inside = [times.get(b, 0) >= k for b in blocks]
        if all(inside):
            yield text
            continue
        words = text.split() if words is None else words
        runs, open_ = [], False
        for b, hit in zip(blocks, inside):
            if hit:
                piece = words[max(0, b * block_words - a) : (b + 1) * block_words - a]
                runs = [*runs[:-1], runs[-1] + piece] if open_ else [*runs, piece]
            open_ = hit
        yield b"\n".join(b" ".join(r) for r in runs)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, as `Mix.taken` gives it; the cases of `Mix` hold."""
    return Mix(documents(spark, sf_dir)).taken().select("doc_id", "size", "source_size", "target", "taken")
