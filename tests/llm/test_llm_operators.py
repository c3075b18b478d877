"""The training-data operators against brute force, round trips and held-out rows, with the awkward cases of any input."""

import hashlib
import os
import random
import re
import types
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runlens.llm import language, lmscore, media, mixing, pieces, quality, ring, simhash, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, shard string"
SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, words(rng, rng.randint(1, 120)), "en", f"s{i % 3}") for i in range(60)]
    passage = words(rng, 60)
    out += [(100 + i, f"{words(rng, 20)}\n{passage} {words(rng, 5)}", "en", "s1") for i in range(8)]
    out += [(200 + i, out[5][1], "en", None) for i in range(5)]  # exact copies
    out += [(300, None, None, None), (301, "", "en", "s0"), (302, " \n\t ", None, "s0"), (303, "é" * 120 + " ñandú " + "é" * 120, "es", "s2"), (304, "a" * 300, "en", "s2"), (305, "12 34 !!", "en", "s9")]
    out += [(None, out[7][1], "en", "s0"), (None, "no id here at all", "en", "s0"), (306, words(rng, 30_000), "en", "s2")]
    out += [out[9], out[9]]  # repeated rows
    return [(i, t, g, s, None if t is None else len(t), "x", "y") for i, t, g, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(t):
    return (t or "").encode()


# ---- 1
def test_pieces_match_the_library(docs, rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest_documents(docs).collect())
    want = []
    for i, t, *_ in rows:
        ids = sp.encode(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    for r in pieces.encode_documents(docs, others=("source",)).collect()[:20]:
        assert r.n_tokens == len(r.ids) and sp.decode(list(r.ids)) == r.decoded


def test_pieces_of_odd_texts():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec = pieces.PieceCodec(pieces.default_model())
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "日本", "😀", "́", "'", "12", "...", "<s>", "<0x0A>", "http://", "\x00", "한국", "\r\n"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = sp.encode(x)
        assert codec.encode(x) == ids and codec.decode(ids) == sp.decode(ids), repr(x)
        joined, plain = codec.spell(x)
        assert joined == ",".join(map(str, ids)) and plain == sp.decode(ids), repr(x)


def test_pieces_of_doubled_pieces():
    """Every piece of several characters, doubled and in a row with the next one; a box-drawing line joins one character only."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec = pieces.PieceCodec(pieces.default_model())
    several = [p.replace("▁", " ") for p in codec.ids if len(p) > 1]
    for x in ["a ──── b", "══ ═══\n│ ─── │", *(p + p for p in several), *map("".join, zip(several, several[1:]))]:
        assert codec.encode(x) == sp.encode(x) and codec.spell(x)[0] == ",".join(map(str, sp.encode(x))), repr(x)


# ---- 2
def removed(rows):
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t, *_ in rows:
        b = raw(t)
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t, *_ in rows:
        b = raw(t)
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                cover[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, v in zip(b, cover) if not v)
        spans = sum(1 for k, v in enumerate(cover) if v and (k == 0 or not cover[k - 1]))
        out.append((str(i), len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffixes(docs, rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(docs).collect())
    assert got == removed(rows)


def test_suffixes_of_repeating_bytes(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["ab", "abab" * 20, "xyz", "q" * 70]) for _ in range(rng.randint(1, 12))), "en", "s", 0, "", "") for i in range(30)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == removed(rows)


def test_suffixes_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    long = words(rng, 3000)
    monkeypatch.setattr(suffixes, "CHUNK", 1000)  # in this process: the blocks of one long text
    whole = {(int(a), int(n)) for _, at, name, before, least in suffixes.anchors([long.encode()]) for a, n in zip(at, name)}
    monkeypatch.setattr(suffixes, "CHUNK", 1 << 18)
    assert whole == {(int(a), int(n)) for _, at, name, before, least in suffixes.anchors([long.encode()]) for a, n in zip(at, name)}


def test_loser_tree():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    shared = [list(map(int, suffixes._prefix_lengths(r))) if r else [] for r in runs]
    merged = [(runs[r][i], n) for r, i, n in suffixes.LoserTree(runs, shared)]
    assert [s for s, _ in merged] == sorted(s for r in runs for s in r)
    for (a, _), (b, n) in zip(merged, merged[1:]):
        assert n == len(os.path.commonprefix([a, b]))


# ---- 3
def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in held) for i in rows)
    assert sum(rows[i].lang_pred == lang[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_of_odd_rows(docs, empty):
    got = {str(r.doc_id): r.lang_pred for r in language.identify(docs).collect()}
    assert got["300"] == got["301"] == got["302"] == got["305"] == "und" and got["1"] in ("en", "es")
    assert language.identify(empty).count() == 0


def test_language_of_many(spark):
    """Ninety languages, one of them with a long text only: all are learned; equal margins go to the first."""
    rng = random.Random(6)
    syllables = [f"{a}{b}" for a in "bcdfghjklmnpqrstvwxz" for b in "aeiouy"]
    own = {f"l{k:02}": rng.sample(syllables, 5) for k in range(90)}
    say = lambda g, n: " ".join("".join(rng.choice(own[g]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(g, 30_000 if g == "l50" else 40), g) for i, g in enumerate(g for g in own for _ in range(2 if g == "l50" else 8))]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: g for i, _, g in rows}
    learned = {lang[r.doc_id] for r in got if not r.held_out}
    held = [r for r in got if r.held_out and lang[r.doc_id] in learned]
    assert "l50" in learned and {r.lang_pred for r in got} >= learned - {"l50"} and any(r.lang_pred == "l50" for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_scores_against_the_kernel():
    """The folded weights give the margins of kernel, Nystroem features and ridge regression as written out."""
    rng = random.Random(9)
    items, langs = [words(rng, 20).encode() for _ in range(30)] + [b"xyzzy plugh " * (k + 1) for k in range(9)], ["a"] * 15 + ["b"] * 15 + ["c"] * 9
    marks = [k % 2 == 0 for k in range(39)]
    model = language.LanguageModel(language.packed(items), langs, marks)
    x = language.presence(items).astype(float)
    kernel = x @ x[np.array(marks)].T
    values, vectors = np.linalg.eigh(kernel[np.array(marks)])
    good = values > 1e-6 * values[-1]
    f = np.column_stack([kernel @ (vectors[:, good] / np.sqrt(values[good])), np.ones(39)])
    y = np.array([[1.0 if g == c else -1.0 for c in "abc"] for g in langs])
    d = np.diag([1 / langs.count(g) for g in langs])
    margins = f @ np.linalg.solve(f.T @ d @ f + np.diag([language.RIDGE] * (f.shape[1] - 1) + [1e-9]), f.T @ d @ y)
    names, scores = model.decide(items)
    assert names == ["abc"[k] for k in margins.argmax(axis=1)] and np.allclose(scores, np.clip((margins.max(axis=1) + 1) / 2, 0, 1), atol=1e-3)


# ---- 4
def test_lm_base_and_probability(docs, rows):
    tok = {k: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) + ["\n"] for k, r in enumerate(rows)}
    held = {k: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for k, r in enumerate(rows)}
    c = Counter(w for k, t in tok.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(rows[k][0]), held[k], len(t), sum(c[w] > 0 for w in t), n, round(float(np.sum(np.log10([(c[w] + 1) / (n + v + 1) for w in t]))), 5)) for k, t in tok.items())
    found = lmscore.score_documents(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
    assert all(r.score < 0 for r in found)


def lm_tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def lm_loop(items, learnt, model):
    """log2 of the probability of each text, token by token and bit by bit."""
    corpus, lists = Counter(), [lm_tokens(t) for t in items]
    grams = lambda own: [tuple(x) for i in range(len(own)) for x in ([own[i]], [*(["\n"] * (i == 0)), *own[max(0, i - 1) : i + 1]], [None] * (i == 0) + ["\n"] * (i < 2) + own[max(0, i - 2) : i + 1])]
    for own, mine in zip(lists, learnt):
        corpus.update(grams(own) if mine else ())
    n = sum(len(x) for x, mine in zip(lists, learnt) if mine)
    out = []
    for own, mine in zip(lists, learnt):
        c = Counter(corpus)
        c.subtract(grams(own) if mine else ())
        rest, docs = n - (len(own) if mine else 0), sum(learnt) - mine
        w, cells, total, bits = model.weights.astype(np.float32).copy(), model.cells.astype(np.float32).copy(), 0.0, 0
        asked, said, last = 0, 0, 0.0
        news, knowns, last_known, lefts, repeats, last_repeat = 0, 0, 0.0, 0, 0, 0.0
        here, mass = Counter(), 0
        stretch = lambda p: np.log(p / (1 - p))

        def code(gate, x, y):
            nonlocal total, bits, w, cells
            if bits and bits % lmscore.LANE_BITS == 0:
                w, cells = model.weights.astype(np.float32).copy(), model.cells.astype(np.float32).copy()
            x = np.array([*x, 1], np.float32)
            z = float(np.clip(np.float32(w[gate] @ x), -7.9, 7.9))
            p, cell = 1 / (1 + np.exp(-z)), int((z + 8) * lmscore.CELLS / 16)
            mixed = 0.7 * p + 0.3 * cells[gate, cell]
            w[gate] += lmscore.RATE * (y - p) * x
            cells[gate, cell] += lmscore.REFINE * (y - cells[gate, cell])
            total += np.log2(mixed if y else 1 - mixed)
            bits += 1

        for i, t in enumerate(own):
            one = ("\n", t) if i == 0 else (own[i - 1], t)
            two = (None, "\n", t) if i == 0 else ("\n", *own[:2]) if i == 1 else tuple(own[i - 2 : i + 1])
            met_two = 0 if i == 0 else c[("\n", own[0])] if i == 1 else c[(own[i - 2], own[i - 1])]
            met_one = docs if i == 0 else c[(own[i - 1],)]
            age = min(7, int(np.log2(i + 1)))
            known_words, seen = c[(t,)], False
            followed, well = stretch((said + 0.3) / (asked + 1.0)), np.log2(max(1, met_one)) / 4 - 1
            was, asks, yes = last, 0, 0
            if 0 < met_two <= 16:
                asks, yes = 1, int(c[two] > 0)
                code(int(np.log2(met_two)), (followed, was, well), yes)
                if yes:
                    seen, share = True, min(1, c[two] / met_two)
            if not seen and 0 < met_one <= 16:
                again = asks
                asks, yes = 1, int(c[one] > 0)
                code(5 + int(np.log2(met_one)), (followed, was, -1.0 if again else 0.0), yes)
                if yes:
                    seen, share = True, min(1, c[one] / met_one)
            new = known = left = rep = False
            if not seen:
                left, rep = True, here[t] > 0
                code(10 + age, (stretch(np.clip(mass / max(1, rest), 1e-5, 1 - 1e-5)), stretch((repeats + 1) / (lefts + 2)), last_repeat), int(rep))
                if rep:
                    s = model.share[age]
                    share = min(1, s * here[t] / max(1, i) + (1 - s) * (min(1, max(0, known_words) / max(1, mass)) if mass else 0))
                else:
                    new, known = True, known_words > 0
                    code(18 + age, (stretch((knowns + 2) / (news + 2.5)), last_known, well), int(known))
                    share = min(1, known_words / max(1, max(1, rest) - mass)) if known else 1
            total += np.log2(share)
            if asks:
                asked, said, last = asked + 1, said + int(seen), 1.0 if seen else -1.0
            if left:
                lefts, repeats, last_repeat = lefts + 1, repeats + rep, 1.0 if rep else -1.0
            if new:
                news, knowns, last_known = news + 1, knowns + known, 1.0 if known else -1.0
            if not here[t]:
                mass += max(0, known_words)
            here[t] += 1
        out.append(total)
    return np.array(out)


def lm_corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 900}"
    items = [" ".join(word() for _ in range(rng.randrange(0, 120))) for _ in range(60)]
    return items + items[:9] + ["", None, "Same same SAME", " ".join(word() for _ in range(3000)), items[4][: len(items[4]) // 2] + " zz " + items[5]]


def lm_whole(items, learnt):
    """A run that knows the counts of all."""
    learnt = np.array(learnt)
    run = lmscore.Run([(t or "").encode() for t in items], 48)
    counts = np.bincount(run.ids, learnt[run.doc], len(run.words)).astype(np.uint64)
    keys, at = np.unique(run.keys, return_inverse=True)
    key_counts = np.bincount(at, np.tile(learnt[run.doc], 2), len(keys)).astype(np.uint64)
    return run, lmscore.Bits(run, counts, key_counts, learnt, int(counts.sum())), learnt


def test_lm_against_a_loop(monkeypatch):
    items = lm_corpus()
    run, bits, learnt = lm_whole(items, [k % 7 != 2 for k in range(len(items))])
    fitted = lmscore.Model().fit(bits, learnt).fit_share(bits, learnt, run)
    for model, lane in ((lmscore.Model(), 8192), (fitted, 8192), (fitted, 500)):
        monkeypatch.setattr(lmscore, "LANE_BITS", lane)
        assert np.allclose(lmscore.token_bits(run, bits, model), lm_loop(items, learnt.tolist(), model), rtol=2e-3)


def test_lm_in_runs_is_as_in_one(spark):
    """Documents scored by Spark, in several runs, against one run with the counts of all and the same weights."""
    items = lm_corpus(8)
    rows = spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")
    learnt = [zlib.crc32(str(k).encode()) % 7 != 2 for k in range(len(items))]
    run, bits, mine = lm_whole(items, learnt)
    got = {r.doc_id: r for r in lmscore.score_documents(rows).collect()}
    near = lmscore.token_bits(run, bits, lmscore.Model().fit(bits, mine).fit_share(bits, mine, run)) * np.log10(2)
    assert all(abs(got[k].score - near[k]) <= 0.1 * abs(near[k]) + 2 for k in got)  # the weights are fitted to a part there
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    twice = [got[k].score / got[k].n_tokens for k in range(9) if learnt[k] and got[k].n_tokens > 20]
    once = [got[k].score / got[k].n_tokens for k in range(9, 60) if got[k].n_tokens > 20]
    assert min(twice) > max(once)


def test_lm_weights_learn_from_every_run(spark, monkeypatch):
    """The weights at the start are fitted to the bits of all training documents, in however many runs."""
    items = lm_corpus(8)
    learnt = [zlib.crc32(str(k).encode()) % 7 != 2 for k in range(len(items))]
    _, bits, mine = lm_whole(items, learnt)
    seen, mean = [], lmscore.Model.mean
    monkeypatch.setattr(lmscore.Model, "mean", staticmethod(lambda models: (seen.append(sum(m.seen.sum() for m in models)), mean(models))[1]))
    runs = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert lmscore.score_documents(spark.createDataFrame(list(enumerate(items)), "doc_id long, text string")).count() == len(items)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", runs)
    assert seen == [mine[bits.doc].sum()]


def test_lm_probabilities_sum_to_one_at_most():
    """Over all symbols that can follow: the words of the corpus, each as the last word of the same text, and an unknown one."""
    items = ["a b c a b d", "a b c e", "b c a f", "c a b c"]
    symbols = sorted({w for t in items for w in t.split()}) + ["unknown"]
    total = 0.0
    for s in [*symbols, ""]:
        run, bits, learnt = lm_whole([*items, f"a b {s}"], [True] * len(items) + [False])
        model = lmscore.Model()
        given = lmscore.mix(bits.y, bits.x, bits.gate, *lmscore._lanes(bits.doc), model)
        at = run.start[-1] + 2
        log = np.log2(given[bits.token == at]).sum() + bits.log_share[at]
        if bits.repeat[at]:
            share = model.share[bits.age[at]]
            log += np.log2(share * bits.here_share[at] + (1 - share) * bits.mass_share[at])
        total += 2.0**log
    assert 0.3 < total <= 1 + 1e-6


def test_lm_numbers_and_fits_quickly_and_alike(monkeypatch):
    """Words are numbered alike whatever the order of the texts, also where hashes meet; sums of logarithms are as one by one."""
    rng = np.random.default_rng(3)
    x = np.r_[rng.random(1003), 1e-9]
    assert abs(lmscore._log_sum(x) - np.log(x).sum()) < 1e-9 and lmscore._log_sum(x[:0]) == 0
    items = [b"a b c a", b"d a b", b"", b"c e"]
    for meet in (False, True):
        if meet:
            monkeypatch.setattr(lmscore.xxhash, "xxh64_intdigest", lambda w: len(w) % 2)
        one, other = lmscore.Run(items, 40), lmscore.Run(items[::-1], 40)
        assert one.words == other.words and sorted(one.words) == [b"\n", b"a", b"b", b"c", b"d", b"e"]
        assert [one.words[i] for i in one.ids.tolist()] == [w for t in items for w in [*t.split(), b"\n"]]


def test_lm_fit_ends_at_the_best_weights():
    """Also where the start is far off: rare by the first predictor, but often true; many bits and few."""
    rng = np.random.default_rng(3)
    gate = np.repeat([17, 3, 12], [4000, 30, 900])
    x = np.column_stack([rng.normal(-5, 1, len(gate)), rng.normal(0, 1, len(gate)), rng.integers(-1, 2, len(gate)), np.ones(len(gate))]).astype(np.float32)
    bits = types.SimpleNamespace(doc=np.zeros(len(gate), int), gate=gate, x=x, y=rng.random(len(gate)) < 0.42 + 0.1 * x[:, 2])
    model = lmscore.Model().fit(bits, np.array([True]))
    for g in (17, 3, 12):
        own, w = x[gate == g].astype(float), model.weights[g]
        p = 1 / (1 + np.exp(-own @ w))
        assert np.abs(own.T @ (bits.y[gate == g] - p) - 2 * (w - lmscore.hand_weights()[g])).max() < 1e-6


def test_lm_spelling():
    letters = np.zeros(257 * 257)
    letters[lmscore._pairs_of_bytes([b"ab", b"ab", b"b"])[0]] += 1
    cost = lmscore.spelling([b"ab", b"zz"], letters)
    assert cost[0] < cost[1] and len(lmscore.spelling([], letters)) == 0


# ---- 5
def fingerprint(x):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def roots(values):
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash(docs, rows):
    fps = [fingerprint(r[1]) for r in rows]
    group = {}
    for k, root in enumerate(roots(fps)):
        group.setdefault(root, []).append(k)
    want = []
    for members in group.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        want += [(str(rows[k][0]), f"{fps[k]:016x}", min(ids) if ids else None) for k in members]
    got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_simhash_links_chains_and_balls(spark):
    """Chains of fingerprints, a ball of near ones, and random ones: components as by all pairs."""
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(1500)]
    ball = rng.getrandbits(64)
    values += [ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)]
    x = rng.getrandbits(64)
    for _ in range(60):
        x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        values.append(x)
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(nodes, 0).union(simhash.links(nodes, 1))
    found = {r.u: r.root for r in simhash.components(edges, f"{_folder(spark)}/cc").collect()}
    want = roots(values)
    groups = lambda names: sorted(Counter(names).values())
    assert groups([found.get(s, s) for s in signed]) == groups(want)


def _folder(spark):
    import uuid

    from runlens.session import shared_dir

    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# ---- 6
def test_quality_base(docs, rows):
    def base(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)

    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.verdicts(docs).collect())
    assert got == sorted((str(r[0]), *base(r[1])) for r in rows)


def test_quality_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.verdicts(docs).collect() if r.doc_id in label and not r.base_failed]
    good, bad = [r.kept for r in rows if label[r.doc_id] == 1], [r.kept for r in rows if label[r.doc_id] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_rows(docs, empty, rows):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in quality.verdicts(docs).collect())
    assert quality.verdicts(empty).count() == 0 and quality.keep_good(empty).count() == 0


# ---- 7
def test_ring(docs, rows):
    got = ring.shard_documents(docs, 7, 8).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t, *_ in rows)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 7 and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_ring_walk_against_single_keys():
    """The walk over arcs is the walk of single keys: at home first, then clockwise to the next shard with room."""
    points = ring.points(5, 4)
    rng = random.Random(1)
    counts = {a: rng.randint(0, 9) for a in range(len(points))}
    total = sum(counts.values())
    room = [total // 5 + (s < total % 5) for s in range(5)]
    waiting, place = [(a, k, a) for a in sorted(counts) for k in range(counts[a])], {}
    while waiting:
        later = []
        for a, k, at in waiting:
            s = points[at][1]
            if room[s]:
                room[s] -= 1
                place[a, k] = s
            else:
                later.append((a, k, (at + 1) % len(points)))
        waiting = later
    got = {(p["arc"], k): p["shard"] for p in ring.walk(points, counts, 5) for k in range(p["lo"], p["hi"])}
    assert got == place


def test_ring_owner_against_the_points(spark):
    """With thousands of shards, places on, before and after points, and beyond the last."""
    for n, v in ((7, 8), (5000, 4)):
        points = ring.points(n, v)
        places = [p for p, _ in points]
        rng = random.Random(4)
        asked = [*rng.sample(places, 20), *(p + 1 for p in rng.sample(places, 20)), *(rng.randrange(1 << 60) for _ in range(60)), 0, (1 << 60) - 1]
        got = spark.createDataFrame([(p,) for p in asked], "p long").select("p", ring.owner(F.col("p"), points).alias("o")).collect()
        assert all(r.o == next((i for i, q in enumerate(places) if q >= r.p), 0) for r in got)


def test_ring_runs_no_python(docs):
    plan = ring.shard_documents(docs, 7, 8)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 8
def test_mix(docs, rows):
    got = mixing.Mix(docs, block_words=8).taken().collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), size(t)) for i, t, *_ in rows)
    assert all(r.taken <= 3 * r["size"] for r in got)
    per = Counter()
    for i, t, _, s, *_ in rows:
        per[s] += size(t)
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, sum(per.values())
    target, free = {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * per[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * per[s]
            free.discard(s)
        if not free:
            break
    by = Counter()
    for r in got:
        by[(r.source_size, round(r.target, 6))] += r.taken
    assert {k for k in by} == {(per[s], round(target[s], 6)) for s in order}
    for (n, t), taken in by.items():
        assert abs(taken - t) <= max(24, 0.02 * t)
    again = mixing.Mix(docs, block_words=8).taken().collect()
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in got) == sorted((str(r.doc_id), r["size"], r.taken) for r in again)


def test_mix_rows_hold_the_words_taken(docs):
    mix = mixing.Mix(docs, block_words=8)
    taken = Counter()
    for r in mix.taken().collect():
        taken[str(r.doc_id)] += r.taken
    rows = mix.mixed()
    assert rows.columns == docs.columns
    words_of = Counter()
    for r in rows.collect():
        words_of[str(r.doc_id)] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words_of == Counter({k: v for k, v in taken.items() if v})


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 77)) == list(range(n))


def test_shard_counts_add_up():
    blocks, sizes = np.array([50, 7, 0, 200]), np.array([64, 64, 64, 65])
    seen = np.zeros(4, int)
    for k in range(4):
        have, first = mixing.shard_counts(blocks, sizes, k, 1)
        assert have.sum() == sizes[k] and (first == seen).all()
        seen += have
    assert (seen == blocks).all()


# ---- 9
def test_media(docs, rows):
    got = media.media_columns(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, *_ in rows:
        p = media.payload_of(raw(t))
        m = media.to_png(p)
        want[str(i), len(raw(t)), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"png 192x{len(p) // 192} 8 bit grey"] += 1
    assert Counter((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in got) == want
    place = {}
    for r in got:
        assert place.setdefault(r.digest, (r.shard, r.offset, r.length)) == (r.shard, r.offset, r.length)


def test_tar_shards_are_tar_files(docs, spark, tmp_path):
    import tarfile

    media.store(docs, f"file://{tmp_path}").collect()
    names = set()
    for f in tmp_path.glob("*.tar"):
        with tarfile.open(f) as tar:
            for member in tar:
                data = tar.extractfile(member).read()
                assert hashlib.sha256(media.from_png(data)).hexdigest() == member.name.removesuffix(".png")
                names.add(member.name)
    assert names


def test_damaged_media_is_found():
    data = bytearray(media.to_png(b"x" * 192))
    data[-20] ^= 1
    with pytest.raises(Exception):
        media.from_png(bytes(data))


# ---- 10
@pytest.mark.parametrize("size, least", [("0.01", 0.6), ("0.1", 0.9)])  # a tenth of 1,000 documents teaches little
def test_toxicity(spark, size, least):
    sf = f"/root/testdata/sf{size}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    label = {r.doc_id: (r.toxic, r.quality) for r in labels.collect()}
    rows = toxicity.score_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    clean = [r.predicted for r in rows if r.held_out and label.get(r.doc_id, (None,))[0] == 0]
    toxic = [r.predicted for r in rows if r.held_out and label.get(r.doc_id, (None, 0)) == (1, 1)]
    assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= least * len(toxic)


def toxic_rows(n, seed=2):
    """Texts of random words; of the toxic tenth each has two of twenty slurs, and every fifth is marked wrongly."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        own, bad = words(rng, 40).split(), i % 10 == 0
        if bad:
            own += [f"slur{rng.choice('abcdefghijklmnopqrst')}" for _ in range(2)]
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_keeps_the_rate(spark, monkeypatch):
    """With a sample that has far more toxic documents than the table, scores stay near those of the whole table."""
    docs, labels = toxic_rows(1500)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole = {r.doc_id: r.score for r in toxicity.score_documents(d, y).collect()}
    monkeypatch.setattr(toxicity, "CLEAN_SAMPLE", 120)
    few = {r.doc_id: r.score for r in toxicity.score_documents(d, y).collect()}
    mean = lambda scores, bad: np.mean([s for i, s in scores.items() if (i % 10 == 0) == bad])
    assert all(abs(mean(whole, bad) - mean(few, bad)) < 0.05 for bad in (False, True))
    assert all(few[i] < 0.3 for i in few if i % 10) and sum(few[i] >= 0.3 for i in few if not i % 10) >= 0.95 * 150


def test_toxicity_of_unseen_endings(spark):
    """Stems of insults whose every occurrence has an ending of its own: no word of a held-out document has been labelled."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(1600):
        own, bad = words(rng, 40).split(), i % 8 == 0
        if bad:
            own.append(rng.choice(("grumpf", "zwackl")) + "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(4, 8))))
        docs.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.score_documents(d, y).collect() if r.held_out]
    toxic, clean = [r.predicted for r in rows if r.doc_id % 8 == 0], [r.predicted for r in rows if r.doc_id % 8]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_toxicity_of_copies_and_signs(spark):
    """Words of toxic texts that are copied often are no insults; insults with signs in place of letters are."""
    docs, labels = toxic_rows(1500)
    docs, rng = [(i, t.replace("slur", "grasto")) for i, t in docs], random.Random(6)
    own = [f"odd{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    for i in range(2000, 2040):
        copy = [*own, "grastoo"]
        copy[rng.randrange(60)] = words(rng, 1)
        docs.append((i, " ".join(copy)))
        labels.append((i, 1, 1))
    asked = {5000 + k: f"{words(rng, 30)} {own[3 * k]}" for k in range(12)} | {6000 + k: f"{words(rng, 30)} {w}" for k, w in enumerate(("gr4st0a grast0b", "gra5toc gr@$t0d"))}
    d, y = spark.createDataFrame([*docs, *asked.items()], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(d, y).collect()}
    assert [got[i] for i in asked] == [0] * 12 + [1] * 2


def test_toxicity_of_ids_that_repeat(spark):
    """An id with unlike texts, in any order, and a labelled text of some 100 KB."""
    docs, labels = toxic_rows(600)
    docs += [(0, "slura slurb of another text"), (10, None), (20, ""), (30, "x " * 50_000 + "slura slurb")]
    y = spark.createDataFrame([*labels, (0, 0, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    score = lambda rows: sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), y).collect())
    assert score(docs) == score(docs[::-1])


def test_label_model_finds_accuracies():
    """Voters with known rates of error: the posterior is right more often than the best of them."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1 for right in (0.9, 0.85, 0.8, 0.75, 0.7)], axis=1).astype(np.int8)
    p = toxicity.LabelModel().fit(votes, np.ones(4000), 0.3)
    assert ((p > 0.5) == truth).mean() > 0.93


def test_toxicity_of_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.score_documents(docs, none).collect())
    assert toxicity.score_documents(empty, none).count() == 0


@pytest.mark.parametrize("f", [pieces.digest_documents, suffixes.dedup, simhash.near_duplicates, ring.shard_documents, media.media_columns, lmscore.score_documents, lambda d: mixing.Mix(d).taken()])
def test_empty_tables(empty, f):
    assert f(empty).count() == 0
