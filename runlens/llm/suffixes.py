"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts in a document with a smaller doc_id.

Two equal strings of LENGTH bytes hold the same anchor at the same place: the leftmost of their K-byte strings with the
least hash. So suffixes from anchors, with the few bytes before them, stand for all suffixes.

1. Each run of documents sends the hashes of its anchors; a bucket of hashes answers with those of several documents.
2. The runs sort the suffixes at such anchors and send them front-coded: shared prefix length and the rest. Equal ones
   of one run are sent once, for the smallest document; the others of them are duplicates already.
3. A bucket merges the sorted runs with a loser tree that carries the lengths of common prefixes, so known prefixes are
   never compared again. The lengths between neighbours cut the merged order into groups with a common right side; the
   bytes before the anchor divide a group further, and the smallest doc_id of each decides.
4. The spans go back to their run, where they are joined and cut out.

Documents stay in runs of bounded size, every bucket grows with its share of anchors only, and no pair is ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import documents, even_keys, free, keyed, release
from runlens.session import ship

LENGTH = 50
K = 24
RUN_BYTES = 8 << 20
CHUNK = 1 << 18  # text bytes hashed at a time
_PLACE = np.uint64((1 << 24) - 1)
_LAST = np.int64(2**63 - 1)  # a null doc_id is the last


def _hashes(a: np.ndarray) -> np.ndarray:
    """Hashes of all K-byte strings by doubling: of 1, 2, 4, 8, 16 and then 24 bytes."""
    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    h, n, eight = a.astype(np.uint64) + np.uint64(0x51ED270B), 1, None
    while n < 16:
        h = h[: len(h) - n] * power(n) + h[n:]
        n *= 2
        eight = h if n == 8 else eight
    h = h[: len(a) - K + 1] * power(8) + eight[16 : len(a) - K + 17]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of (document, anchor, hash, before, least): strings that start `least` to `before` bytes before the anchor have it."""
    i = 0
    while i < len(texts):
        own, size = [], 0
        while i < len(texts) and (not own or size + len(texts[i]) <= CHUNK):
            own.append(i)
            size += len(texts[i])
            i += 1
        for at, base, block in _blocks(texts, own):
            yield from _anchored(at, base, block)


def _blocks(texts: list[bytes], own: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Documents, their offset in the document, and their bytes; a long document comes in overlapping blocks."""
    if len(own) == 1 and len(texts[own[0]]) > CHUNK:
        text = texts[own[0]]
        for start in range(0, len(text), CHUNK):
            yield [own[0]], [start], [text[start : start + CHUNK + LENGTH - 1]]
    else:
        yield own, [0] * len(own), [texts[j] for j in own]


def _anchored(own: list[int], offsets: list[int], items: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    a = np.frombuffer(b"".join(items), np.uint8)
    if len(a) < LENGTH:
        return
    sizes = np.array([len(x) for x in items])
    ends = np.cumsum(sizes)
    h = _hashes(a)
    key = ((h >> np.uint64(24)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    least, width = key, 1
    span = LENGTH - K + 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: len(a) - LENGTH + 1], least[span - width : span - width + len(a) - LENGTH + 1])
    start = np.arange(len(least))
    doc = np.repeat(np.arange(len(items)), sizes)[: len(least)]
    good = start + LENGTH <= ends[doc]  # strings that don't cross documents
    start, doc, anchor = start[good], doc[good], (least[good] & _PLACE).astype(np.int64)
    if not len(start):
        return
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(start)] - 1
    at, d = anchor[first], doc[first]
    shift = np.array(offsets)[d] - (ends - sizes)[d]
    name = h[at] * np.uint64(0xD6E8FEB86659FD93)  # anchors have small hashes, their names are even
    name = (name ^ (name >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)
    yield np.array(own)[d], at + shift, name, at - start[first], at - start[last]


def _in_order(table: pa.Table) -> tuple[pa.Table, list, list[bytes]]:
    """A run's rows by doc_id, null last, then text: the same order in every pass."""
    ids = table.column("doc_id").to_pylist()
    texts = [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return table.take(pa.array(order, pa.int64())), [ids[i] for i in order], [texts[i] for i in order]


def _pieces(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    found = list(anchors(texts))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([x.nbytes for x in arrays], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(x.tobytes() for x in arrays))


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.uint32, len(types))
    at, out = sizes.nbytes, []
    for n, t in zip(sizes.tolist(), types):
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def _cuts(sorted_hash: np.ndarray, buckets: int) -> np.ndarray:
    edges = (np.arange(1, buckets, dtype=object) * (1 << 48) // buckets).astype(np.uint64)
    return np.r_[0, np.searchsorted(sorted_hash, edges), len(sorted_hash)]


def _rows(rows: list[tuple], names: tuple, types: tuple) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})


def _send_hashes(run: int, table: pa.Table, keys: list[int]) -> pa.Table:
    """The run's distinct anchor hashes by bucket, each with a mark if two documents of the run have it."""
    _, ids, texts = _in_order(table)
    doc, _, h, _, _ = _pieces(texts)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    lasts = np.r_[new[1:], len(h)] - 1 if len(h) else new
    shared = np.array([ids[a] != ids[b] for a, b in zip(doc[new], doc[lasts])], bool)
    h = h[new]
    cut = _cuts(h, len(keys))
    rows = []
    for b in range(len(keys)):
        lo, hi = cut[b], cut[b + 1]
        if hi > lo:
            steps = np.diff(h[lo:hi], prepend=np.uint64(0))
            narrow = steps[1:].max(initial=0) < 1 << 32
            rows.append((keys[b], run, _pack(np.array([steps[0], narrow], np.uint64), steps[1:].astype(np.uint32 if narrow else np.uint64), np.packbits(shared[lo:hi]))))
    return _rows(rows, ("bucket", "run", "blob"), (pa.int64(), pa.int64(), pa.binary()))


def _read_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    head, steps, marks = _unpack(blob, np.uint64, np.uint8, np.uint8)
    steps = steps.view(np.uint32 if head[1] else np.uint64).astype(np.uint64)
    h = np.cumsum(np.r_[head[0], steps], dtype=np.uint64)
    return h, np.unpackbits(marks, count=len(h)).astype(bool)


def _answer(table: pa.Table) -> pa.Table:
    """To each run its hashes that several documents have."""
    runs = table.column("run").to_pylist()
    found = [_read_hashes(b) for b in table.column("blob").to_pylist()]
    every = np.sort(np.concatenate([h for h, _ in found]))
    several = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(h[m] for h, m in found)]))
    rows = []
    for run, (h, _) in zip(runs, found):
        own = h[np.isin(h, several, assume_unique=True)]
        if len(own):
            rows.append((run, _pack(own)))
    return _rows(rows, ("run", "blob"), (pa.int64(), pa.binary()))


def _prefix_lengths(items: list[bytes]) -> np.ndarray:
    """Common prefix lengths of neighbours (0 for the first)."""
    out = np.zeros(len(items), np.uint8)
    for lo in range(0, len(items), 65536):
        part = items[max(0, lo - 1) : lo + 65536]
        sizes = np.array([len(x) for x in part])
        m = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in part), np.uint8).reshape(-1, LENGTH)
        unlike = m[1:] != m[:-1]
        n = np.where(unlike.any(axis=1), unlike.argmax(axis=1), LENGTH)
        out[max(1, lo) : lo + 65536] = np.minimum(n, np.minimum(sizes[1:], sizes[:-1]))
    return out


def _send_suffixes(run: int, table: pa.Table, answers: pa.Table, keys: list[int]) -> pa.Table:
    """Sorted, front-coded suffixes at shared anchors by bucket, and the spans that the run alone finds."""
    if not answers.num_rows or not table.num_rows:
        return _rows([], ("bucket", "run", "blob"), (pa.int64(), pa.int64(), pa.binary()))
    _, ids, texts = _in_order(table)
    wanted = np.sort(np.concatenate([_unpack(b, np.uint64)[0] for b in answers.column("blob").to_pylist()]))
    doc, at, h, before, least = _pieces(texts)
    keep = np.isin(h, wanted)
    doc, at, h, before, least = (x[keep] for x in (doc, at, h, before, least))
    order = np.argsort(h, kind="stable")
    doc, at, h, before, least = (x[order] for x in (doc, at, h, before, least))
    id_of = np.array([_LAST if i is None else i for i in ids], np.int64)
    cut, rows = _cuts(h, len(keys)), []
    for b in range(len(keys)):
        lo, hi = cut[b], cut[b + 1]
        if hi == lo:
            continue
        part = list(zip(doc[lo:hi].tolist(), at[lo:hi].tolist(), before[lo:hi].tolist(), least[lo:hi].tolist()))
        keyed = sorted((texts[d][p : p + LENGTH - o], texts[d][p - q : p], id_of[d], d, p, q, o) for d, p, q, o in part)
        kept, spans, last, first_id = [], [], None, None
        for right, left, own, d, p, q, o in keyed:  # documents of equal strings come in the order of their ids
            if (right, left) == last and own != first_id:
                spans.append((d, p - q, p - o + LENGTH))
                continue
            if (right, left) != last:
                last, first_id = (right, left), own
            kept.append((right, left, own, d, p, q, o))
        right = [x[0] for x in kept]
        shared = _prefix_lengths(right)
        numbers = np.array([x[2:] for x in kept], np.int64).reshape(-1, 5)
        tails = b"".join(r[n:] for r, n in zip(right, shared.tolist()))
        spans = np.array(spans, np.uint32).reshape(-1, 3)
        blob = _pack(
            shared, np.array([len(x) for x in right], np.uint8), np.frombuffer(tails, np.uint8), np.frombuffer(b"".join(x[1] for x in kept), np.uint8),
            numbers[:, 0].copy(), numbers[:, 1].astype(np.uint32), numbers[:, 2].astype(np.uint32), numbers[:, 3].astype(np.uint8), numbers[:, 4].astype(np.uint8), spans.ravel(),
        )
        rows.append((keys[b], run, blob))
    release()
    return _rows(rows, ("bucket", "run", "blob"), (pa.int64(), pa.int64(), pa.binary()))


class LoserTree:
    """Merges sorted runs of byte strings whose neighbours' common prefix lengths are known.

    A leaf carries the length that its string shares with the last output. Of two, the one that shares more comes first;
    only if both share the same length are bytes compared, from there on.
    """

    def __init__(self, runs: list[list[bytes]], shared: list[list[int]]):
        self.runs, self.shared = runs, shared
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.place = [0] * self.size
        self.now = [r[0] if r else None for r in runs] + [None] * (self.size - len(runs))
        self.known = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The loser stays with the length it shares with the winner."""
        x, y, known = self.now[a], self.now[b], self.known
        if y is None or x is None:
            won = b if x is None and y is not None else a
        elif known[a] != known[b]:
            won = a if known[a] > known[b] else b
        else:
            n, most = known[a], min(len(x), len(y))
            while n < most and x[n] == y[n]:
                n += 1
            first = n == len(x) or (n < len(y) and x[n] < y[n])
            won = a if first else b
            known[b if first else a] = n
        self.loser[node] = b if won == a else a
        return won

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """run, place in the run, and the length shared with the output before."""
        now, known, loser, size = self.now, self.known, self.loser, self.size
        top = self.winner
        while now[top] is not None:
            yield top, self.place[top], known[top]
            i = self.place[top] = self.place[top] + 1
            run = self.runs[top]
            if i < len(run):
                now[top], known[top] = run[i], self.shared[top][i]
            else:
                now[top] = None
            node = (top + size) >> 1
            while node:
                other = loser[node]
                y = now[other]
                if y is not None:
                    x = now[top]
                    if x is None or known[other] > known[top]:
                        loser[node], top = top, other
                    elif known[other] == known[top]:
                        n, most = known[top], min(len(x), len(y))
                        while n < most and x[n] == y[n]:
                            n += 1
                        if n == len(x) or (n < len(y) and x[n] < y[n]):
                            known[other] = n
                        else:
                            known[top] = n
                            loser[node], top = top, other
                node >>= 1


def _merge_bucket(table: pa.Table) -> pa.Table:
    """To each run the spans of its documents that a smaller document has, too."""
    runs = table.column("run").to_pylist()
    types = (np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.uint32, np.uint32, np.uint8, np.uint8, np.uint32)
    parts = [_unpack(b, *types) for b in table.column("blob").to_pylist()]
    strings, shared = [], []
    for p in parts:
        tails, at, last, own = p[2].tobytes(), 0, b"", []
        for n, size in zip(p[0].tolist(), p[1].tolist()):
            last = last[:n] + tails[at : at + size - n]
            at += size - n
            own.append(last)
        strings.append(own)
        shared.append(p[0].tolist())
    n = sum(map(len, strings))
    start = np.cumsum([0, *map(len, strings)])[:-1]
    order, common = np.zeros(n, np.int64), np.zeros(n, np.uint8)
    base = start.tolist()
    for i, (run, place, length) in enumerate(LoserTree(strings, shared)):
        order[i], common[i] = base[run] + place, length
    sizes = np.concatenate([p[1] for p in parts])[order]
    ids, docs, places, before, least = (np.concatenate([p[k] for p in parts])[order] for k in (4, 5, 6, 7, 8))
    run_of = np.repeat(np.arange(len(runs)), list(map(len, strings)))[order]
    reach = LENGTH - K
    left = np.zeros((n, reach), np.uint8)  # bytes before the anchor, the nearest first
    lefts = np.concatenate([p[3] for p in parts])
    ends = np.cumsum(np.concatenate([p[7] for p in parts]).astype(np.int64))[order]
    for o in range(reach):
        has = before > o
        left[has, o] = lefts[ends[has] - 1 - o]
    hit = np.zeros((n, reach + 3), bool)
    hashed = np.zeros(n, np.uint64)
    for o in range(reach + 1):
        if o:
            hashed = (hashed ^ left[:, o - 1].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(32)
        able = np.flatnonzero((before >= o) & (least <= o) & (sizes >= LENGTH - o))
        if len(able) > 1:
            group = np.cumsum(common < LENGTH - o)[able]
            hit[able, o + 1] = _has_smaller(group, hashed[able], left[able, :o], ids[able])
    rise, fall = np.nonzero(hit[:, 1:] & ~hit[:, :-1]), np.nonzero(hit[:, :-1] & ~hit[:, 1:])
    i, low, high = rise[0], rise[1], fall[1] - 1  # strings that start low to high bytes before the anchor
    found = np.column_stack([docs[i], places[i] - high, places[i] - low + LENGTH]).astype(np.uint32)
    whose, rows = run_of[i], []
    for k, run in enumerate(runs):
        own = np.concatenate([found[whose == k], parts[k][9].reshape(-1, 3)])
        if len(own):
            rows.append((run, _pack(own.ravel())))
    release()
    return _rows(rows, ("run", "blob"), (pa.int64(), pa.binary()))


def _has_smaller(group: np.ndarray, hashed: np.ndarray, left: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id has the same group and left side. Hashes find the left sides; their bytes confirm them."""
    order = np.lexsort((ids, hashed, group))
    g, h = group[order], hashed[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    if left.shape[1] and (left[order] != left[head]).any():  # hashes met: by the bytes themselves
        order = np.lexsort((ids, *left.T, group))
        g, m = group[order], left[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (m[1:] != m[:-1]).any(axis=1)]
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.zeros(len(ids), bool)
    out[order] = ids[head] < ids[order]
    return out


def _joined(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    out: list[list[int]] = []
    for a, z in spans.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def _cut_out(table: pa.Table, answers: pa.Table) -> tuple[pa.Table, list[bytes], list[int], list[bytes], list[int]]:
    """A run in order, with the texts, the bytes removed, what is kept, and the number of spans, of each document."""
    table, ids, texts = _in_order(table)
    blobs = answers.column("blob").to_pylist()
    spans = np.concatenate([_unpack(b, np.uint32)[0] for b in blobs]).reshape(-1, 3).astype(np.int64) if blobs else np.zeros((0, 3), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    lo, hi = np.searchsorted(spans[:, 0], np.arange(len(ids))), np.searchsorted(spans[:, 0], np.arange(len(ids)), side="right")
    removed, kept, numbers = [], [], []
    for i, text in enumerate(texts):
        gone = _joined(spans[lo[i] : hi[i], 1:]) if hi[i] > lo[i] else []
        at, parts = 0, []
        for a, z in gone:
            parts.append(text[at:a])
            at = z
        kept.append(b"".join([*parts, text[at:]]))
        removed.append(len(text) - len(kept[-1]))
        numbers.append(len(gone))
    release()
    return table, texts, removed, kept, numbers


def dedup(docs: DataFrame, replace_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with replace_text all columns of docs, with the kept text.

    A null or empty text has no bytes and stays as it is. A null doc_id counts as larger than all others. Rows with one
    doc_id are no duplicates of each other, but each of them of a smaller doc_id. The kept text drops the rest of a code
    point that a cut has left behind. Rows that tie in all of that lose nothing to each other. A very long text is a run of
    its own and is judged whole. An empty table gives no rows. docs may have columns of any names.
    """
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RUN_BYTES))
    columns = docs.columns if replace_text else ["doc_id", "text"]
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    keys = even_keys(spark, runs)  # of runs and of buckets
    own = free(docs.columns, "own_run")[0]
    placed = docs.select(keyed(keys, F.pmod(key, F.lit(runs))).alias(own), *columns).repartition(runs, own)
    by_run = placed.groupBy(own)
    blobs, answer = "bucket long, run long, blob binary", "run long, blob binary"
    sent = by_run.applyInArrow(lambda k, t: _send_hashes(k[0].as_py(), t, keys), blobs)
    several = sent.repartition(runs, "bucket").groupBy("bucket").applyInArrow(_answer, answer)
    suffixes = by_run.cogroup(several.groupBy("run")).applyInArrow(lambda k, t, a: _send_suffixes(k[0].as_py(), t, a, keys), blobs)
    spans = suffixes.repartition(runs, "bucket").groupBy("bucket").applyInArrow(_merge_bucket, answer)

    def digest(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, texts, removed, kept, numbers = _cut_out(table, answers)
        sums = [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(numbers, pa.int64()), "kept_sha256": pa.array(sums, pa.string())})

    def replaced(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, texts, removed, kept, _ = _cut_out(table, answers)
        same = table.column("text").cast(pa.string()).to_pylist()
        text = [x.decode(errors="ignore") if n else old for x, n, old in zip(kept, removed, same)]
        table = table.drop_columns([own])
        return table.set_column(table.schema.get_field_index("text"), "text", pa.array(text, pa.string()))

    back = by_run.cogroup(spans.groupBy("run"))
    if replace_text:
        return back.applyInArrow(replaced, docs.schema)
    return back.applyInArrow(digest, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    """What every whole text of documents keeps, as `dedup` gives it; its cases hold."""
    return dedup(documents(spark, sf_dir))
