"""Near copies of the pipeline against all pairs."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from runlens.llm import nearcopies
from test_llm_operators import SCHEMA, words


def sets_of(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def first_ids(rows):
    """The least ids of the components of all pairs."""
    sets, parent = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


def test_near_copies_go(spark):
    """Copies with some words replaced, of similarity 0.6 to 1, a chain and a ball of copies."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def changed(w, k):
        w = list(w)
        for at in rng.sample(range(len(w)), k):
            w[at] = fresh(1)[0]
        return w

    out = []
    for n in (100, 300, 900):
        for share in (0.004, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            for _ in range(4):
                w = fresh(n)
                out += [w, changed(w, max(1, int(share * n)))]
    link = fresh(200)
    for _ in range(12):
        link = changed(link, 3)
        out.append(link)
    ball = fresh(200)
    out += [changed(ball, 1) for _ in range(40)]
    out += [[], [], ["a"], ["A"], ["b", "c"]]
    rng.shuffle(out)
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "", "") for i, t in rows] + [(None, rows[3][1], "en", "s", 0, "", ""), (None, None, None, None, None, None, None)], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == first_ids(rows)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_slices_and_blocks(spark, monkeypatch):
    """Groups far larger than a slice, with strangers in their bands, names that clash, and rows that repeat."""
    monkeypatch.setattr(nearcopies, "SLICE", 4)
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for size, share in ((60, 1), (50, 2), (40, 4), (30, 6)):
        base = fresh(100)
        for _ in range(size):
            w = list(base)
            for at in rng.sample(range(100), share):
                w[at] = fresh(1)[0]
            out.append(w)
    rng.shuffle(out)
    rows = [(i, " ".join(w), i, "x", 1.0) for i, w in enumerate(out)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, key long, own_h string, band double")
    got = nearcopies.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == first_ids([r[:2] for r in rows])


def test_search_of_a_group():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        whole = rng.integers(0, 1 << 62, 100).astype(np.uint64)
        sets += [np.unique(whole[rng.random(100) < keep]) for keep in (1, 0.9, 0.85, 0.95, 0.7)]
    got = nearcopies.groups(sets)
    part = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similar(set(sets[i].tolist()), set(sets[j].tolist())):
                part = [part[j] if p == part[i] else p for p in part]
    assert {(a, b) for a in range(len(sets)) for b in range(a) if got[a] == got[b]} == {(a, b) for a in range(len(sets)) for b in range(a) if part[a] == part[b]}


def test_fingerprints_against_a_loop():
    """SimHash bit by bit; a set of a size where a near copy may be small has both kinds."""
    rng = np.random.default_rng(6)
    for n, kinds in ((1, 1), (63, 1), (64, 2), (80, 2), (81, 1), (700, 1)):
        own = rng.integers(0, 1 << 63, n).astype(np.uint64)
        assert len(nearcopies.fingerprints(own)) == kinds
        for times in (1, nearcopies.TIMES):
            ones = [0] * nearcopies.BITS
            for s in own.tolist():
                for k in range(nearcopies._WORDS * times):
                    x = (s * int(nearcopies._FACTORS[k]) + int(nearcopies._ADDED[k])) % 2**64
                    x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) % 2**64
                    x ^= x >> 29
                    if n < 100 or k < 2:
                        for bit in range(64):
                            ones[k % nearcopies._WORDS * 64 + bit] += x >> bit & 1
            got = np.unpackbits(nearcopies.fingerprint(own, times), bitorder="little")
            upto = nearcopies.BITS if n < 100 else 128 if times == 1 else 0
            assert got[:upto].tolist() == [int(2 * c > n * times) for c in ones[:upto]]
    assert nearcopies.fingerprints(np.zeros(0, np.uint64)) == []


def test_trees_link_all_values_one_bit_apart(monkeypatch):
    """Random values, chains and a ball, through small leaves, against all pairs; and by both searches of a leaf."""
    monkeypatch.setattr(nearcopies, "LEAF", 40)
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 32, 700).astype(np.uint64)
    chain = [int(values[0])]
    for _ in range(60):
        chain.append(chain[-1] ^ 1 << int(rng.integers(32)))
    ball = [int(values[1]) ^ 1 << k for k in range(32)]
    values = np.unique(np.r_[values, np.array(chain + ball, np.uint64), values[2:200] ^ np.uint64(1 << 20)])
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 1
    root = np.arange(len(values))
    while (new := np.where(near, root[None], len(values)).min(axis=1)).tolist() != root.tolist():
        root = new
    assert nearcopies.linked(values).tolist() == root.tolist()
    want = {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    for search in (nearcopies._apart, nearcopies._neighbours):
        assert {(min(p), max(p)) for p in zip(*(x.tolist() for x in search(values)))} == want


def test_pairs_at_the_limit_meet_in_a_view():
    """Pairs of similarity 0.8 to 0.82, small and large."""
    rng = np.random.default_rng(9)
    for n, other in ((5, 0), (20, 2), (63, 6), (70, 7), (78, 8), (400, 44)):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.r_[a[other:], rng.integers(0, 1 << 63, other).astype(np.uint64)] if other else a[:4])
            prints = [np.frombuffer(b"".join(nearcopies.fingerprints(x)), np.uint8).reshape(-1, nearcopies.BITS // 8) for x in (a, b)]
            one, two = (nearcopies.views(p) for p in prints)
            assert (np.bitwise_count(one[:, :, None] ^ two[:, None, :]) <= 1).any()


def test_texts_are_sent_once(spark, monkeypatch, tmp_path):
    """A family of copies meets in many views under unlike firsts: each text is sent for one comparison, and only what is left for more."""
    monkeypatch.setattr(nearcopies, "shared_dir", lambda spark: str(tmp_path))
    rng = random.Random(31)
    base, out = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(200), 1):
            w[at] = f"w{rng.randrange(10**6)}"
        out.append((len(out), " ".join(w)))
    got = sorted(r.doc_id for r in nearcopies.keep_first(spark.createDataFrame(out, "doc_id long, text string")).collect())
    assert got == first_ids(out)
    read = lambda name: spark.read.parquet(*map(str, tmp_path.glob(f"nearcopies-*/{name}")))
    stars = read("dealt").where("key <> v").select("key", "v").distinct().count()
    assert read("tried").groupBy("u").count().where("count > 1").count() == 0
    assert read("tried").count() + read("close").count() < stars / 2


def test_whole_fingerprints_of_pairs_at_the_limit_are_close():
    """Pairs of similarity 0.8 to 0.82 of all sizes stay, strangers go; the first is no partner of its own."""
    rng = np.random.default_rng(10)
    hashes = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for n, other in ((5, 0), (20, 2), (63, 6), (70, 7), (78, 8), (400, 44)):
        a = np.unique(hashes(n))
        near = [np.unique(np.r_[a[other:], hashes(other)]) if other else a[:4] for _ in range(30)]
        sets = [a, *near, np.unique(hashes(n)), np.unique(hashes(n))]
        table = pa.table({"u": pa.array(range(33), pa.int64()), "v": pa.array([0] * 33, pa.int64()), "prints": [nearcopies.fingerprints(s) for s in sets]})
        assert nearcopies._close(table).column("u").to_pylist() == list(range(1, 31))


def test_groups_of_many_views_are_compared_once(spark, monkeypatch, tmp_path):
    """A family of copies that meets strangers in each of 30 views: rows sent and made follow the texts, not the views."""
    monkeypatch.setattr(nearcopies, "SLICE", 16)
    rng = random.Random(41)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, out = fresh(60), []
    for k in range(60):  # the family of the first 40, of which 30 are known to be one; 20 strangers
        out.append([*base[:-1], *fresh(1)] if k < 40 else fresh(60))
    known = [(k, 0) for k in range(1, 30)]
    dealt = [(view, k, 0) for view in range(30) for k in range(60) if k < 20 or rng.random() < 0.9]
    dealt += [(30, 100, 100), (30, 101, 100), (31, 0, 0), (31, 1, 0)]  # strangers elsewhere; one component
    out = dict(enumerate(out)) | {100: fresh(60), 101: fresh(60)}
    large = spark.createDataFrame(dealt, "band long, key long, v long")
    roots = spark.createDataFrame(known, "u long, root long")
    sets = spark.createDataFrame([(k, " ".join(w)) for k, w in out.items()], "key long, text string")
    blocks = nearcopies._left(nearcopies._merged(large, roots, str(tmp_path)), roots).join(sets, "key").cache()
    assert blocks.count() <= 5 * 62
    more = blocks.groupBy("band", "block").applyInArrow(lambda t: nearcopies._block(t), "u long, v long").collect()
    assert len(more) <= 5 * 10 and all(r.v == 0 and 30 <= r.u < 40 for r in more if r.v == 0)
    parent = {}
    for u, v in [*known, *sorted((r.u, r.v) for r in more)]:
        parent[u] = min(v, parent.get(u, v))
    find = lambda k: k if k not in parent else find(parent[k])
    assert {k for k in out if find(k) == 0} == set(range(40)) and all(find(k) == k for k in out if k >= 40)


def test_a_chain_of_groups_is_not_merged(spark, tmp_path):
    """Groups that only touch would cost more as one: they stay apart, and one that lies within another goes into it."""
    dealt = [(b, k, 10 * b) for b in range(12) for k in range(10 * b, 10 * b + 11)] + [(20, k, 1000) for k in range(1000, 1030)] + [(21, k, 1000) for k in range(1000, 1029)]
    roots = spark.createDataFrame([(1, 0)], "u long, root long")
    got = nearcopies._merged(spark.createDataFrame(dealt, "band long, key long, v long"), roots, str(tmp_path)).collect()
    members = {}
    for r in got:
        members.setdefault(r.band, set()).add(r.key)
    assert sorted(map(sorted, members.values())) == sorted([*(list(range(10 * b, 10 * b + 11)) for b in range(12)), list(range(1000, 1030))])


def test_search_with_known_components():
    """Known components stay, are joined whole, and nothing else changes."""
    rng = np.random.default_rng(15)
    wholes = [rng.integers(0, 1 << 62, 100).astype(np.uint64) for _ in range(8)]
    sets = [np.unique(w[rng.random(100) < keep]) for w in wholes for keep in (1, 0.9, 0.95, 0.7)]
    plain, known = nearcopies.groups(sets), np.arange(len(sets))
    known[[3, 7, 11]] = 3, 3, 9  # the unlike ones of two families, and one of a third with a member of its own
    got, want = nearcopies.groups(sets, known), plain.copy()
    for a, b in ((3, 7), (11, 9)):
        want[want == want[b]] = want[a]
    pairs = lambda x: {(a, b) for a in range(len(x)) for b in range(a) if x[a] == x[b]}
    assert pairs(got) == pairs(want)
