"""Near copies by SimHash and vantage-point trees, then the Jaccard similarity of word shingles, for the pipeline.

Texts are near copies from a similarity of SIMILAR on. Their fingerprints then differ in up to 15 % of the bits: ten of 64, a
radius at which no tree prunes. So a fingerprint has BITS bits, as SimHash gives them, and VIEWS choices of 32 of these have a
vantage-point tree each, as a half of op5_simhash has: two texts are candidates if a view differs in one bit at most, so the
slack is 1 (a pair at 0.8 does so in 3.5 % of the views). The upper levels are built on the driver from a bounded sample and
only balance shards; a shard goes on splitting by itself down to leaves, whose searches find all values one bit apart.

What is linked in a shard is a group, and all texts of a group are compared unless they are known to be of one
component. First each is compared with the least it has met in any view: most copies are of one component then, and each
text has been sent once. Then what is left, without what has been compared: of groups of PAIRED members or fewer all pairs, of
larger ones those with the least. Their whole fingerprints come first, and texts are sent only of pairs within WIDE bits. These
stars are dealt out in slices, so that no task gets a large group. Last, larger groups that still have several components are
dealt out in blocks of two slices, but for blocks within one component, and an exact search joins what is near within a block.
Much the same texts meet in many views: groups of one main component are one group for this, where that is less to compare.
A block compares no two texts of a known component, and gives the components that it joins, not the texts.
So a large group of near copies costs in proportion to its size, and to the number of strangers in its groups. Texts with equal
sets are one node from the start.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import few, free, map_arrow, slices, texts
from runlens.llm.simhash import _split, build, components, route
from runlens.session import shared_dir, ship

SHINGLE = 5
SIMILAR = (4, 5)  # as a fraction, so that the check is exact
BITS, VIEWS = 4096, 320  # of a fingerprint; of 32 bits each
SAMPLE = 8192  # fingerprints that the upper levels are built from
SHARD = 1 << 18  # values of a view that a shard should have
LEAF = 4096
SMALL, TIMES = 64, 8  # a smaller set counts each shingle so many times, with other bits: the law of angles needs many terms
TEXTS = 4096  # in a file of those that are compared
PAIRED = 16  # members of a group of which all pairs are compared
WIDE = 800  # bits of whole fingerprints that near copies differ in at most: 620 are expected at SIMILAR, with a deviation of 23
SLICE = 512  # texts of a star or a component that are compared in one task; a block has two slices
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20240613)
_WORDS = BITS // 64
_FACTORS = _RNG.integers(0, 1 << 63, _WORDS * TIMES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RNG.integers(0, 1 << 63, _WORDS * TIMES, dtype=np.uint64)
_CHOSEN = np.concatenate([_RNG.permutation(BITS) for _ in range(-(-VIEWS * 32 // BITS))])[: VIEWS * 32]  # bits of the views


def shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of the shingles of a text, sorted; a shorter text is one shingle, one without words has none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    found = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64))


def set_key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _ones(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit: rows are added in pairs, all bits side by side, with a plane for each binary digit."""
    planes = [words]
    while len(planes[0]) > 1:
        if len(planes[0]) % 2:
            planes = [np.concatenate([p, np.zeros_like(p[:1])]) for p in planes]
        half, out, carry = len(planes[0]) // 2, [], None
        for p in planes:
            a, b = p[:half], p[half:]
            differ, both = a ^ b, a & b
            out.append(differ if carry is None else differ ^ carry)
            carry = both if carry is None else both | (differ & carry)
        planes = [*out, carry]
    return sum(np.unpackbits(p[0].view(np.uint8), bitorder="little").astype(np.int64) << k for k, p in enumerate(planes))


def fingerprint(own: np.ndarray, times: int = 1) -> np.ndarray:
    """BITS bits, packed: a bit is 1 if it is set in over half of the hashes of the shingles."""
    used, ones = slice(0, times * _WORDS), np.zeros(BITS, np.int64)
    for i in range(0, len(own), 512):
        ones += _ones(_mixed(own[i : i + 512, None] * _FACTORS[used] + _ADDED[used]).reshape(-1, _WORDS))
    return np.packbits(2 * ones > len(own) * times, bitorder="little")


def fingerprints(own: np.ndarray) -> list[bytes]:
    """Of a small set that of the small ones, of a large set the plain one; both where a near copy may be of the other kind."""
    kinds = [TIMES] * (0 < len(own) * SIMILAR[0] <= SMALL * SIMILAR[1]) + [1] * (len(own) >= SMALL)
    return [fingerprint(own, times).tobytes() for times in kinds]


def views(prints: np.ndarray) -> np.ndarray:
    """For each view the 32 bits of each of the packed fingerprints (rows)."""
    chosen = np.unpackbits(prints, axis=1, bitorder="little")[:, _CHOSEN].reshape(len(prints), VIEWS, 32)
    return np.ascontiguousarray(np.packbits(chosen, axis=2, bitorder="little").view("<u4")[:, :, 0].T).astype(np.uint64)


def _apart(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a leaf that differ in one bit; values are distinct and sorted.

    Such a pair has equal upper or equal lower 16 bits. Where many have, each value looks for its 32 neighbours instead.
    """
    first, second = [], []
    for part in (np.uint64(0), np.uint64(16)):
        key = (values >> part) & np.uint64(0xFFFF)
        order = np.argsort(key, kind="stable")
        key, own = key[order], values[order]
        for d in range(1, len(values)):
            same = np.flatnonzero(key[d:] == key[:-d])
            if not len(same):
                break
            if d > 32:
                return _neighbours(values)
            same = same[np.bitwise_count(own[same + d] ^ own[same]) == 1]
            first.append(order[same])
            second.append(order[same + d])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, second = [], []
    for bit in range(32):
        asked = values ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
        found = np.flatnonzero((values[at] == asked) & (asked > values))
        first.append(found)
        second.append(at[found])
    return np.concatenate(first), np.concatenate(second)


def linked(values: np.ndarray) -> np.ndarray:
    """For each of distinct sorted values the place of the least it is linked to in steps of one bit, by leaves of a tree."""
    rng, todo, first, second = np.random.default_rng(7), [np.arange(len(values))], [], []
    while todo:
        at = todo.pop()
        own = values[at]
        split = _split(own, 0, rng) if len(at) > LEAF else None
        if split is None:
            a, b = _apart(own)
            first.append(at[a])
            second.append(at[b])
            continue
        vantage, mask, radius, slack = split
        d = np.bitwise_count((own ^ np.uint64(vantage)) & np.uint64(mask))
        todo += [at[d <= radius + slack], at[d > radius]]
    a, b = np.concatenate(first), np.concatenate(second)
    root = np.arange(len(values))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _meet(table: pa.Table) -> pa.Table:
    """The groups of a shard with their members: key, band (of the members, so that equal groups are one), v (the least)."""
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), "<u4").astype(np.uint64)
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<i8")
    distinct, place = np.unique(values, return_inverse=True)
    group = linked(distinct)[place]
    shared = np.flatnonzero(np.bincount(group)[group] > 1)
    group, keys = group[shared], keys[shared]
    order = np.lexsort((keys, group))
    group, keys = group[order], keys[order]
    first = np.flatnonzero(np.r_[len(group) > 0, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(group)])
    band = np.add.reduceat(_mixed(keys.view(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
    return pa.table({"key": pa.array(keys), "band": pa.array(np.repeat(band.view(np.int64), size)), "v": pa.array(np.repeat(keys[first], size))})


def _groups(nodes: DataFrame, count: int) -> DataFrame:
    """key, band, v: the members of all groups of all views; nodes have a key and a fingerprint."""
    ship(nodes.sparkSession)
    shards = -(-count // SHARD)
    trees = [[0]] * VIEWS
    if shards > 1:
        sample = nodes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("print").collect()
        sample = views(np.frombuffer(b"".join(bytes(r["print"]) for r in sample), np.uint8).reshape(len(sample), -1))
        trees = [build(own, 0, shards) for own in sample]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                keys = part.column("key").to_numpy()
                own = views(np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(len(keys), -1))
                rows = [(k << 32 | shard, own[k][at].astype("<u4").tobytes(), keys[at].tobytes()) for k in range(VIEWS) for shard, at in route(trees[k], own[k])]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["place", "values", "keys"])

    dealt = map_arrow(nodes.select("key", "print"), deal, "place long, values binary, keys binary")
    return dealt.groupBy("place").applyInArrow(lambda t: _meet(t), "key long, band long, v long").distinct()


def near(a: int, b, both):
    """Whether sets of a and b members with `both` in common are near copies."""
    return both * SIMILAR[1] >= (a + b - both) * SIMILAR[0]


def groups(sets: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
    """For each set a number of its component under near; sets with the same number in `known` are of one component.

    Near copies share one of the shingles that are left when SIMILAR of a set are taken off, the most frequent of the group first.
    """
    sizes = np.array(list(map(len, sets)))
    member = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    _, name, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((name, count[name], member))
    at = np.cumsum(sizes) - sizes
    head = np.arange(len(flat)) - at[member] < (sizes - -(-sizes * SIMILAR[0] // SIMILAR[1]) + 1)[member]
    rare, holder = name[order][head], member[head]
    ends = np.searchsorted(holder, np.arange(len(sets) + 1))
    by_name = np.argsort(rare, kind="stable")
    index, held = rare[by_name], holder[by_name]
    out, known = np.full(len(sets), -1), np.arange(len(sets)) if known is None else known
    for start in range(len(sets)):
        if out[start] >= 0:
            continue
        front = np.flatnonzero(known == known[start]).tolist()
        out[front] = start
        while front:  # who has been reached isn't compared again
            f = front.pop()
            own = rare[ends[f] : ends[f + 1]]
            lo, met = np.searchsorted(index, own), np.searchsorted(index, own, side="right")
            met -= lo
            rest = np.unique(held[np.repeat(lo - np.cumsum(met) + met, met) + np.arange(met.sum())])
            rest = rest[out[rest] < 0]
            if not len(rest):
                continue
            n = sizes[rest]
            live = np.repeat(at[rest] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.minimum(np.searchsorted(sets[f], flat[live]), sizes[f] - 1)
            both = np.bincount(member[live[sets[f][place] == flat[live]]], minlength=len(sets))[rest]
            found = rest[near(sizes[f], n, both)]
            if len(found):
                found = np.flatnonzero(np.isin(known, known[found]))
            out[found] = start
            front.extend(found.tolist())
    return out


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), key (of the set of shingles) and its fingerprints (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                own = [shingles(t) for t in texts(part.column("text"))]
                keys = pa.array(np.array([set_key(s) for s in own], np.uint64).view(np.int64))
                prints = pa.array(list(map(fingerprints, own)), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), keys, prints], ["doc_id", "h", "key", "prints"])

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, key long, prints array<binary>")


def _stars(table: pa.Table) -> pa.Table:
    """Of a slice of a star the members near the first one: u, v."""
    keys, lead = table.column("u").to_numpy(), table.column("v")[0].as_py()
    first = int(np.flatnonzero(keys == lead)[0])
    whole, u = shingles(texts(table.column("text").slice(first, 1))[0]), []
    for lo in range(0, len(keys), 64):
        for key, text in zip(keys[lo : lo + 64], texts(table.column("text").slice(lo, 64))):
            own = shingles(text)
            if key != lead and near(len(own), len(whole), len(np.intersect1d(own, whole, assume_unique=True))):
                u.append(key)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array([lead] * len(u), pa.int64())})


def _close(table: pa.Table) -> pa.Table:
    """Of a slice of a star the members with a fingerprint within WIDE bits of one of the first: u, v."""
    keys, lead, prints = table.column("u").to_numpy(), table.column("v")[0].as_py(), table.column("prints").to_pylist()
    whole = [np.frombuffer(p, np.uint64) for p in prints[int(np.flatnonzero(keys == lead)[0])]]
    own = np.frombuffer(b"".join(p for ps in prints for p in ps), np.uint64).reshape(-1, _WORDS)
    apart = np.min([np.bitwise_count(own ^ w).sum(axis=1, dtype=np.int64) for w in whole], axis=0)
    u = np.unique(np.repeat(keys, list(map(len, prints)))[apart <= WIDE])
    u = u[u != lead]
    return pa.table({"u": pa.array(u), "v": pa.array(np.full(len(u), lead))})


def _block(table: pa.Table) -> pa.Table:
    """Stars of the components that a block joins: u, v, the roots they had."""
    keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
    root = table.column("root").to_numpy()[first]
    part = groups([shingles(t) for t in texts(table.column("text").take(pa.array(first)))], root)
    root, at = np.unique(root, return_index=True)  # of one root all are in one part
    _, least, back = np.unique(part[at], return_index=True, return_inverse=True)  # roots are sorted: the first is the least
    v = root[least][back]
    return pa.table({"u": pa.array(root[v != root]), "v": pa.array(v[v != root])})


def _sizes(dealt: DataFrame) -> DataFrame:
    return dealt.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def _unlike(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """u, v: distinct pairs of unlike components, of small groups all, of larger ones those with the least."""
    rooted = dealt.join(roots.select(F.col("u").alias("key"), "root").hint("merge"), "key", "left").select("band", "key", "v", F.coalesce("root", "key").alias("root"))
    open_ = rooted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "n")
    rooted = rooted.join(open_.hint("merge"), "band")
    first = rooted.where(F.col("key") == F.col("v")).select("band", F.col("root").alias("root_v"))
    large = rooted.where(F.col("n") > PAIRED).join(first.hint("merge"), "band").where("root <> root_v").select(F.col("key").alias("u"), "v")
    members = rooted.where(F.col("n") <= PAIRED).groupBy("band").agg(F.collect_list(F.struct("key", "root")).alias("m"))
    other = lambda x: lambda y: (y["key"] > x["key"]) & (y["root"] != x["root"])
    of_one = lambda x: F.transform(F.filter("m", other(x)), lambda y: F.struct(y["key"].alias("u"), x["key"].alias("v")))
    small = members.select(F.explode(F.flatten(F.transform("m", of_one))).alias("p")).select("p.*")
    return small.union(large).distinct()


def _merged(dealt: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """band, key of the bands with several components; bands of one main component are one band where that is less to compare.

    All pairs of the members of a band cost the square of their number, whether several bands have them or one.
    """
    spark = dealt.sparkSession
    rooted = dealt.join(roots.select(F.col("u").alias("key"), "root").hint("merge"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    parts = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = F.min(F.struct(-F.col("n"), "root"))["root"]
    bands = parts.groupBy("band").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), main.alias("main")).where("roots > 1")
    bands.select("band", "n", "main").write.parquet(f"{folder}/open")
    bands = spark.read.parquet(f"{folder}/open")
    met = dealt.select("band", "key").join(bands.select("band", "main").hint("merge"), "band")
    size = met.select("main", "key").distinct().groupBy("main").agg(F.count(F.lit(1)).cast("double").alias("all"))
    apart = bands.groupBy("main").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
    one = apart.join(size.hint("merge"), "main").where(F.col("all") * F.col("all") <= F.col("apart")).select("main", F.col("main").alias("whole"))
    named = bands.select("band", "main").join(one.hint("merge"), "main", "left").select("band", F.coalesce("whole", "band").alias("whole"))
    return dealt.select("band", "key").join(named.hint("merge"), "band").select(F.col("whole").alias("band"), "key").distinct()


def _left(dealt: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks (band, block) with their keys and roots: pairs of slices of the bands that have several components.

    A component of SLICE members or more in its band has slices of its own, the others share some. Bands with the same
    members count once. Blocks within one component are left out.
    """
    rooted = dealt.join(roots.select(F.col("u").alias("key"), "root").hint("merge"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    sizes = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("mark"))
    small = F.when(F.col("n") < SLICE, F.col("n")).otherwise(0)
    open_ = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all"), F.sum(small).alias("small"), F.bit_xor("mark").alias("mark")).where("roots > 1")
    open_ = open_.groupBy("mark", "all", "roots").agg(F.min(F.struct("band", "small")).alias("b")).select("b.*")
    slots = sizes.drop("mark").join(open_.hint("merge"), "band").withColumn("large", F.col("n") >= SLICE)
    share = lambda x, of: F.pmod(F.xxhash64(F.col(x)), F.ceil(F.col(of) / SLICE))
    member = rooted.join(slots.hint("merge"), ["band", "root"]).withColumn("slice", F.when(F.col("large"), F.xxhash64("root", share("key", "n"))).otherwise(share("root", "small")))
    member = member.select("band", "key", "root", "slice", F.when(F.col("large"), F.col("root")).alias("only"))
    slices_ = member.select("band", "slice", "only").distinct()
    other = slices_.select(F.col("band").alias("band_2"), F.col("slice").alias("slice_2"), F.col("only").alias("only_2"))
    met = (F.col("band") == F.col("band_2")) & (F.col("slice") <= F.col("slice_2")) & F.coalesce(F.col("only") != F.col("only_2"), F.lit(True))
    pairs = slices_.join(other.hint("merge"), met).withColumn("block", F.xxhash64("slice", "slice_2"))
    within = pairs.select("band", "block", F.explode(F.array_distinct(F.array("slice", "slice_2"))).alias("slice"))
    return member.select("band", "slice", "key", "root").join(within.hint("merge"), ["band", "slice"]).select("band", "block", "key", "root").distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """The row of docs with the least doc_id of each component of near copies, with all columns; of rows that repeat it, one.

    Texts without words, null included, are near copies of each other. A null doc_id is kept only where a component has no
    other; ties of ids go to the least text hash. Very long texts are compared whole. An empty table gives no rows. docs may
    have columns of any names.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/nearcopies-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    found = kept(_keys(docs), "keys")  # each text is read once
    first = F.min(F.struct(F.col("doc_id").isNull().alias("id_null"), "doc_id", "h"))
    rows = found.count()
    nodes = kept(few(found.groupBy("key").agg(first.alias("first"), F.min("prints").alias("prints")), rows, 1 << 13), "nodes")
    prints, nodes = nodes.select("key", "prints"), nodes.drop("prints")
    exploded = prints.select("key", F.explode("prints").alias("print"))
    dealt = kept(_groups(exploded, exploded.count()), "dealt")
    key, keep, chosen = free(docs.columns, "key", "keep", "chosen")

    def met(rows: DataFrame, firsts: DataFrame, how: str) -> DataFrame:
        """Rows whose id and text are those of the column `first`; dealt out by these, so that dropping repeats needs no other exchange."""
        wanted = firsts.select(F.struct("first.doc_id", "first.h").alias(chosen), *(F.col(c).alias(keep) for c in firsts.columns if c != "first"))
        keyed = rows.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("h")))
        return keyed.join(wanted.hint("merge"), F.col(key) == F.col(chosen), how).dropDuplicates([key])

    wanted = nodes.join(dealt.select("key").distinct().hint("merge"), "key").select("first", "key")
    one = met(docs.select("doc_id", "text"), wanted, "inner").select(F.col(keep).alias("key"), "text")
    sets = kept(few(one, rows, TEXTS), "texts")

    def starred(pairs: DataFrame, values: DataFrame, compare) -> DataFrame:
        """Edges u, v: pairs (distinct) that `compare` finds in slices of stars, with the columns of values."""
        stars = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("parts"))
        members = pairs.join(stars.hint("merge"), "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"))
        leads = stars.select(F.col("v").alias("u"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        sent = members.union(leads).join(values.withColumnRenamed("key", "u").hint("merge"), "u")
        return sent.groupBy("v", "part").applyInArrow(lambda t: compare(t), "u long, v long")

    tried = kept(dealt.where("key <> v").groupBy(F.col("key").alias("u")).agg(F.min("v").alias("v")), "tried")
    roots = components(starred(tried, sets, _stars), f"{folder}/first", rows)
    pairs = kept(few(_unlike(dealt, roots).join(tried, ["u", "v"], "left_anti"), dealt.count()), "pairs")
    near_ones = kept(few(starred(pairs, prints, _close), pairs.count()), "close")
    joined = roots.select("u", F.col("root").alias("v"))
    roots = components(joined.union(starred(near_ones, sets, _stars)), f"{folder}/second")
    large = dealt.join(_sizes(dealt).where(F.col("n") > PAIRED).hint("merge"), "band").select("band", "key")
    merged = kept(_merged(large, roots, folder), "merged")
    blocks = _left(merged, roots).join(sets.hint("merge"), "key")
    more = blocks.groupBy("band", "block").applyInArrow(lambda t: _block(t), "u long, v long")
    roots = components(roots.select("u", F.col("root").alias("v")).union(more), f"{folder}/third")
    rooted = nodes.join(roots.withColumnRenamed("u", "key").hint("merge"), "key", "left").select("first", F.coalesce("root", "key").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first")
    return met(docs, firsts, "left_semi").drop(key)
