"""Toxicity by weak supervision.

Many voters look at a document: one for each suspicious word or piece of a word (found in labelled documents; a piece is any
few letters in a row, such as a stem that takes endings no labelled document has), patterns, the absence of everything
suspicious, and the given label, which can be wrong, too. A generative label model estimates from
votes alone how often each voter votes in toxic and in clean documents (expectation maximisation), and how voters
correlate beyond that; correlated voters share their weight. Its posterior labels train a linear classifier over the suspicious
words and pieces, which gives the score. Words and pieces are counted over all labelled documents, the label model and the
classifier are fitted on a bounded sample; scoring reads each text once.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import documents, map_arrow, slices, texts
from runlens.session import shared_dir

TOXIC_SAMPLE, CLEAN_SAMPLE, OTHER_SAMPLE = 2000, 4000, 2000  # documents of the sample: labelled 1, labelled 0, without a label
LEXICON = 400  # word voters
STEMS = 200  # piece voters
SIZES = range(4, 9)  # code points of a piece, with marks
PROPOSED = 20_000  # pieces that are counted by documents
LEAST_DOCS = 3  # toxic documents with a suspicious word
CHANCE = 0.2  # words that may be suspicious by chance
RIDGE = 0.3
STEPS = 25
THRESHOLD = 0.3
_BLANK = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))
_MIXED = re.compile(rb"[a-z\x80-\xff][013457@$]+[a-z\x80-\xff]")  # signs in place of letters
_FOLD = bytes.maketrans(b"013457@$", b"oieastas")
_FAMILIES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_SHOUT = re.compile(rb"!{3,}|\b[A-Z]{4,}\b")
_YOU = re.compile(rb"\byou(?:'re| are) (?:an? )?\w+", re.I)


def words_of(text: bytes) -> set[bytes]:
    """The distinct words of a text: lower case, cut at white space and at ASCII characters that aren't letters.

    A word with signs in place of inner letters (l0ser) also counts as the one that is meant.
    """
    low = text.decode(errors="replace").lower().encode()
    own = set(low.translate(_BLANK).split())
    if _MIXED.search(low):
        own.update(b" ".join(w for w in low.split() if _MIXED.search(w)).translate(_FOLD).translate(_BLANK).split())
    return own


def families(text: bytes) -> list[int]:
    """Least hashes of the three-word shingles by four functions: near copies have most of them in common, other texts none."""
    own = text.lower().split()
    found = list(map(b" ".join, zip(own, own[1:], own[2:]))) or [b" ".join(own)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64)
    hashes ^= hashes >> np.uint64(32)
    return [int((hashes * f).min().view(np.int64)) for f in _FAMILIES]


def cuts(word: str, sizes: range) -> set[str]:
    """The pieces of a word with a mark before and after it: whatever its other letters are, they tell a stem or an ending."""
    marked = f"^{word}$"
    return {marked[i : i + k] for k in sizes for i in range(len(marked) - k + 1)}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: word, toxic and clean documents that have it."""
    counts: dict = {y: Counter() for y in (0, 1)}
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            for text, label in zip(texts(part.column("text")), part.column("label").to_pylist()):
                counts[label].update(words_of(text))
            if sum(map(len, counts.values())) > 200_000:
                yield from _flush(counts, "word", pa.binary())
    yield from _flush(counts, "word", pa.binary())


def _flush(counts: dict, name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    found = list({**counts[0], **counts[1]})
    if found:
        columns = [pa.array(found, kind), *(pa.array([counts[y][w] for w in found], pa.int64()) for y in (1, 0))]
        yield pa.RecordBatch.from_arrays(columns, [name, "toxic", "clean"])
    for c in counts.values():
        c.clear()


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of pieces over words, each as often as documents have it."""
    counts: dict = {y: Counter() for y in (0, 1)}
    for batch in batches:
        for word, toxic, clean in zip(*(batch.column(c).to_pylist() for c in ("word", "toxic", "clean"))):
            word = word.decode(errors="replace")
            for lo in range(0, len(word), 1 << 15):  # one of a great length part by part
                for piece in cuts(word[lo : lo + (1 << 15)], SIZES):
                    counts[1][piece] += toxic
                    counts[0][piece] += clean
                if len(counts[0]) > 400_000:
                    yield from _flush(counts, "piece", pa.string())
    yield from _flush(counts, "piece", pa.string())


def _evidence(toxic, clean, rate: float):
    """The Chernoff bound: n * KL(share of toxic documents, their rate); columns."""
    n = toxic + clean
    q = toxic / n
    rest = F.when(q >= 1, 0.0).otherwise((1 - q) * F.log((1 - q) / F.lit(max(1e-12, 1 - rate))))
    return F.when(q > rate, n * (q * F.log(q / F.lit(rate)) + rest)).otherwise(0.0)


def suspicious(labelled: DataFrame, toxic: int, clean: int, folder: str) -> tuple[list[bytes], list[str]]:
    """Words, and pieces of words, that are more frequent in toxic documents than chance allows, corrected for the number tried.

    Pieces are proposed by counts over words and then counted by documents, so that one document can't make a piece;
    most documents with a piece must be toxic, as it is less certain than a word. Last, near copies count as one document,
    or the random words of a text that has many would be suspicious.
    """
    spark, sums = labelled.sparkSession, (F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    parts = map_arrow(labelled.select("text", "label"), _count_words, "word binary, toxic long, clean long")
    parts.groupBy("word").agg(*sums).write.parquet(f"{folder}/words")  # each text is read once
    counts = spark.read.parquet(f"{folder}/words")
    map_arrow(counts, _cut_words, "piece string, toxic long, clean long").groupBy("piece").agg(*sums).where(F.col("toxic") >= LEAST_DOCS).write.parquet(f"{folder}/pieces")
    cut, rate = spark.read.parquet(f"{folder}/pieces"), toxic / (toxic + clean)

    def most(df: DataFrame, name: str, rate: float, limit: int) -> dict:
        df = df.where(F.col("toxic") >= LEAST_DOCS)
        least = float(np.log(max(1, df.count()) / CHANCE))
        passed = df.withColumn("e", _evidence(F.col("toxic"), F.col("clean"), rate)).where(F.col("e") > least)
        return {r[name]: (r["toxic"], r["clean"]) for r in passed.orderBy(F.desc("e"), name).limit(limit).collect()}

    lexicon = {bytes(w): n for w, n in most(counts, "word", rate, LEXICON).items()}
    all_toxic, all_clean = (x or 0 for x in counts.agg(*sums).first())
    proposed = Voters([], list(most(cut, "piece", all_toxic / max(1, all_toxic + all_clean), PROPOSED)))
    names = list(proposed.pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {y: Counter() for y in (0, 1)}
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for text, label in zip(texts(part.column("text")), part.column("label").to_pylist()):
                    found[label].update(proposed.found(words_of(text))[0])
        yield from _flush(found, "place", pa.int32())

    exact = map_arrow(labelled.select("text", "label"), count, "place int, toxic long, clean long").groupBy("place").agg(*sums).where(F.col("toxic") >= LEAST_DOCS)
    least = float(np.log(max(1, cut.count()) / CHANCE))
    rows = exact.where("toxic >= clean").withColumn("e", _evidence(F.col("toxic"), F.col("clean"), rate)).where(F.col("e") > least).collect()  # PROPOSED at most
    pieces = {names[r["place"]]: (r["toxic"], r["clean"]) for r in rows}
    asked = Voters(list(lexicon), list(pieces))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                met = {(p, y, k, f) for t, y in zip(texts(part.column("text")), part.column("label").to_pylist()) if (own := asked.found(words_of(t))[0]) for k, f in enumerate(families(t)) for p in own}
                columns = list(zip(*met)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["place", "label", "kind", "family"])

    met = map_arrow(labelled.select("text", "label"), meet, "place long, label long, kind long, family long").distinct()
    of = met.groupBy("place", "kind").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    of = of.groupBy("place").agg(F.avg("toxic").alias("toxic"), F.avg("clean").alias("clean"))
    told = {r["place"]: r["e"] for r in of.where(F.col("toxic") >= LEAST_DOCS).withColumn("e", _evidence(F.col("toxic"), F.col("clean"), rate)).collect()}  # LEXICON and PROPOSED at most
    least_word = float(np.log(max(1, counts.where(F.col("toxic") >= LEAST_DOCS).count()) / CHANCE))  # as many words as were tried
    lexicon = {w: n for w, n in lexicon.items() if told.get(asked.words[w], 0) > least_word}
    return _unlike(lexicon, [(told[asked.pieces[x]], x, n) for x, n in pieces.items() if told.get(asked.pieces[x], 0) > least])


def _unlike(lexicon: dict[bytes, tuple[int, int]], found: list[tuple[float, str, tuple[int, int]]]) -> tuple[list[bytes], list[str]]:
    """Words and pieces that don't say the same; counts are of toxic and clean documents.

    Pieces come by evidence, beginnings of words first, then longer ones. One that holds another says the same, as does one
    within another that adds less than a quarter of toxic documents, and one with the same counts and three letters or a word
    in common. A piece stands for the words with its counts that have it.
    """
    whole: dict = {}
    for word, counts in lexicon.items():
        whole.setdefault(counts, []).append(f"^{word.decode(errors='replace')}$")
    out: list[str] = []
    before: list[tuple[str, str, int]] = []  # piece, what must not lie within another, toxic documents
    same, spoken = {}, set()
    for _, piece, counts in sorted(found, key=lambda x: (-x[0], x[1][0] != "^", x[1][-1] == "$", -len(x[1]), x[1])):
        if len(out) == STEMS:
            break
        thirds = {piece[i : i + 3] for i in range(len(piece) - 2)}
        mine = {w for w in whole.get(counts, []) if piece in w}
        if mine & spoken or thirds & same.get(counts, set()) or any((piece in o and 5 * n >= 4 * counts[0]) or core in piece for o, core, n in before):
            continue
        out.append(piece)
        core = piece.strip("^$")
        before.append((piece, core if len(core) > 3 else piece, counts[0]))
        same.setdefault(counts, set()).update(thirds)
        spoken |= mine
    return [w for w in lexicon if f"^{w.decode(errors='replace')}$" not in spoken], out


class Voters:
    """What the words, pieces of words and patterns say of a text: 1 for toxic, -1 for clean, 0 for nothing."""

    def __init__(self, lexicon: list[bytes], pieces: list[str]):
        self.words = {w: i for i, w in enumerate(lexicon)}
        self.pieces = {p: i + len(lexicon) for i, p in enumerate(pieces)}
        self.sizes = sorted(set(map(len, pieces)))
        self.told: dict[bytes, tuple[int, ...]] = {}  # of words met before
        self.count = len(lexicon) + len(pieces) + 3

    def of_word(self, word: bytes) -> tuple[int, ...]:
        places = self.told.get(word)
        if places is None:
            pieces = self.pieces
            places = tuple(pieces[p] for p in cuts(word.decode(errors="replace"), self.sizes) if p in pieces)
            if word in self.words:
                places += (self.words[word],)
            if len(self.told) >= 200_000:
                self.told.clear()
            if len(word) < 256:
                self.told[word] = places
        return places

    def found(self, own: set[bytes]) -> tuple[set[int], int]:
        """The places of what the words of a text have, and how many words have any."""
        told = [t for t in map(self.of_word, own) if t]
        return {i for t in told for i in t}, len(told)

    def votes(self, text: bytes) -> np.ndarray:
        out = np.zeros(self.count, np.int8)
        places, hits = self.found(words_of(text))
        out[list(places)] = 1
        out[-3] = -1 if not hits else 1 if hits > 1 else 0
        out[-2] = 1 if len(_SHOUT.findall(text)) > 2 else 0
        out[-1] = 1 if _YOU.search(text) else 0
        return out


class LabelModel:
    """Posterior probability of label 1 from votes: 1 for toxic, -1 for clean, 0 for none."""

    def fit(self, votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 60, labels: np.ndarray | None = None) -> np.ndarray:
        """weight: of each document; labels: 1, 0 or -1 for none, where the search starts (else from the sum of the votes)."""
        kinds = np.stack([votes == v for v in (-1, 0, 1)]).astype(np.float32)  # kind, document, voter
        lean = votes.sum(axis=1, dtype=int)
        p = np.clip(np.where(lean > 0, 0.9, np.where(lean < 0, 0.02, prior)), 0.01, 0.99)
        if labels is not None:
            p = np.where(labels < 0, p, np.where(labels > 0, 0.9, 0.02))
        self.share = np.ones(votes.shape[1])
        for _ in range(rounds):
            rates = [(np.stack([w @ x for x in kinds]) + 0.05) / (w.sum() + 0.15) for w in (weight * (1 - p), weight * p)]  # accuracies: rates by label
            self.weights = np.log(rates[1]) - np.log(rates[0])
            odds = sum(x @ y for x, y in zip(kinds, self.weights * self.share))
            prior = np.clip(np.average(p, weights=weight), 1e-3, 0.5)
            p = 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -30, 30)))
            self.share = self._independent(votes, weight, rates, p)
        return p

    @staticmethod
    def _independent(votes: np.ndarray, weight: np.ndarray, rates: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """1 / (1 + correlations left over when the label is known): what a voter says that others don't."""
        expected = np.outer(p, rates[1][2] - rates[1][0]) + np.outer(1 - p, rates[0][2] - rates[0][0])
        left = (votes - expected) * np.sqrt(weight / weight.mean())[:, None]
        scale = np.sqrt((left**2).mean(axis=0)) + 1e-9
        rho = np.abs((left.T @ left) / len(votes) / np.outer(scale, scale))
        np.fill_diagonal(rho, 0)
        return 1 / (1 + np.where(rho > 0.3, rho, 0).sum(axis=1))


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w, mean = np.zeros(x.shape[1]), np.average(target, weights=weight)
    w[-1] = np.log((mean + 1e-3) / (1 - mean + 1e-3))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (target - p)) - penalty * w)
        w += np.clip(step, -2, 2)
    return w[:-1], float(w[-1])


class ToxicityModel:
    """Label model and classifier, fitted to votes with labels 1, 0 or -1 for none and a weight for each document."""

    def __init__(self, voters: Voters | None = None, votes: np.ndarray | None = None, labels: np.ndarray | None = None, weight: np.ndarray | None = None):
        self.voters, self.weights, self.bias = Voters([], []), np.zeros(0), -5.0
        if voters is None or not (labels == 1).any():
            return
        given = np.where(labels >= 0, 2 * labels - 1, 0).astype(np.int8)  # the label is a voter, too
        weight = weight / weight[labels == 1].mean()  # a toxic document counts as one
        self.model = LabelModel()
        known = labels >= 0
        posterior = self.model.fit(np.column_stack([votes, given]), weight, float(np.average(labels[known] == 1, weights=weight[known])), labels=labels)
        self.voters = voters
        self.weights, self.bias = _logistic((votes[:, :-3] > 0).astype(float), posterior, weight)

    def score(self, text: bytes) -> float:
        z = self.bias + sum([self.weights[i] for i in sorted(self.voters.found(words_of(text))[0])])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def held_out(doc_id):
    """Whether the remainder of crc32(doc_id as text) by 4 is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The sample: least hashes of doc_id. Several labels of one document count as the highest, of several texts with one id the least hash."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/toxicity-{uuid.uuid4().hex}"
    mine = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.where(mine & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("label"))
    train = docs.where(mine).select("doc_id", "text")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    train.join(known, "doc_id").groupBy("doc_id", "label").agg(one.alias("t")).select("doc_id", "label", "t.text").write.parquet(f"{folder}/labelled")
    labelled = docs.sparkSession.read.parquet(f"{folder}/labelled")
    size = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not size.get(1):
        return ToxicityModel()
    voters = Voters(*suspicious(labelled, size[1], size.get(0, 0), folder))
    ids = train.select("doc_id").distinct()
    others = ids.join(known.select("doc_id"), "doc_id", "left_anti").withColumn("label", F.lit(-1))
    size[-1] = ids.count() - size[1] - size.get(0, 0)
    first = lambda df, n: df.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    marked = first(labelled.where("label = 1"), TOXIC_SAMPLE).union(first(labelled.where("label = 0"), CLEAN_SAMPLE))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                votes = pa.array([voters.votes(t).tobytes() for t in texts(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("h"), votes], ["doc_id", "label", "h", "votes"])

    def asked(texts_of: DataFrame, sample: DataFrame) -> DataFrame:
        rows = texts_of.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("h"), "text")
        return map_arrow(rows, vote, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, h long, votes binary")

    found = asked(labelled, marked).union(asked(train, first(others, OTHER_SAMPLE)))
    rows = found.groupBy("doc_id", "label").agg(F.min(F.struct("h", "votes")).alias("v")).select("doc_id", "label", "v.votes").orderBy("doc_id").collect()  # the three bounds together
    given = np.array([r["label"] for r in rows])
    weight = np.array([size[y] / (given == y).sum() for y in given.tolist()])
    votes = np.frombuffer(b"".join(bytes(r["votes"]) for r in rows), np.int8).reshape(len(rows), -1)
    return ToxicityModel(voters, votes, given, weight)


def score_documents(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted.

    A null or empty text has the score of a text without words. A null doc_id counts as not held out and has no label. Rows
    that repeat get a row each. An empty table gives no rows; without a toxic label every score is near 0. Words with equal
    evidence come by their bytes. Very long texts are read whole, here and in training. Bytes that are no UTF-8 count as
    replacement characters. Other columns are not read, and a score reads the text only.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                scores = np.array([model.score(t) for t in texts(part.column("text"))])
                arrays = [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every whole text of documents, as score_documents gives it; its cases hold."""
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
