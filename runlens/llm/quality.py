"""Quality rules by distribution divergence.

For every language of the corpus the engine counts, over all documents, how often each character class and each word
occurs; the most common words make the reference. A document is compared with these references by Jensen-Shannon distance (base 2, the
square root of the divergence) and takes the least distance to any language. It is rejected where a distance passes its
limit, and a histogram is only trusted from a least number of words on.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import documents, map_arrow, slices, texts

CLASSES = ("other", "lower", "upper", "digit", "blank", "break", "symbol", "letter beyond ASCII", "stop", "control")
_CONTINUES = len(CLASSES)  # bytes within a code point count nowhere
COMMON_WORDS = 64
CHAR_LIMIT, CHAR_WORDS = 0.30, 50
WORD_LIMIT, WORD_WORDS = 0.40, 100
SLICE = 4 << 20


def _class_table() -> np.ndarray:
    def kind(c: int) -> int:
        ch = chr(c)
        if c >= 0x80:
            return 7 if c >= 0xC0 else _CONTINUES
        tests = (ch.islower(), ch.isupper(), ch.isdigit(), ch == " ", ch in "\t\n\r\x0b\x0c", ch in "#*$%&|<>")
        for i, hit in enumerate(tests, 1):
            if hit:
                return i
        return 8 if ch in ".,;:!?" else 9 if c < 32 or c == 127 else 0

    return np.array([kind(c) for c in range(256)], dtype=np.uint8)


_TABLE = _class_table()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.zeros(len(words), dtype=bool)
    at = np.array([i for i, w in enumerate(windows) if counts[w] > 1])
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: lang, kind (0 class, 1 word, 2 all words), key, n."""
    classes: dict = defaultdict(lambda: np.zeros(len(CLASSES) + 1, dtype=np.int64))
    words: dict = defaultdict(Counter)
    totals: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(g, 0, CLASSES[i].encode(), int(n)) for g, h in classes.items() for i, n in enumerate(h[:-1]) if n]
        rows += [(g, 1, w, n) for g, c in words.items() for w, n in c.items()]
        rows += [(g, 2, b"", n) for g, n in totals.items()]
        for x in (classes, words, totals):
            x.clear()
        if rows:
            lang, kind, key, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], ["lang", "kind", "key", "n"])

    for batch in batches:
        for part in slices(batch, "text", SLICE):
            for lang, text in zip(part.column("lang").to_pylist(), texts(part.column("text"))):
                own = text.lower().split()
                classes[lang] += class_counts(text)
                totals[lang] += len(own)
                words[lang].update(own)
        if sum(map(len, words.values())) > 200_000:
            yield from flush()
    yield from flush()


def references(docs: DataFrame) -> list[dict]:
    """Per language: class shares and common-word shares, the last for all other words. 75 rows of a language reach the driver."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    parts = map_arrow(docs.select(lang.alias("lang"), "text"), _profile, "lang string, kind int, key binary, n long")
    counts = parts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    kept = counts.withColumn("place", F.row_number().over(top)).where(F.col("place") <= COMMON_WORDS)
    found: dict = defaultdict(lambda: {0: {}, 1: {}, 2: {}})
    for r in kept.orderBy("lang", "kind", "place").collect():
        found[r["lang"]][r["kind"]][bytes(r["key"])] = r["n"]
    out = []
    for name in sorted(found):
        char, word, total = found[name][0], found[name][1], sum(found[name][2].values())
        shares = np.array([char.get(c.encode(), 0) for c in CLASSES], dtype=float)
        if not shares.sum() or not total:
            continue
        q = np.array([*word.values(), total - sum(word.values())], dtype=float)
        out.append({"lang": name, "classes": shares / shares.sum(), "words": list(word), "shares": q / q.sum()})
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q, between 0 and 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(a / 2, 0))


_VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def _judge(items: list[bytes], refs: list[dict]) -> list[np.ndarray]:
    """The columns of _VERDICT for a few texts."""
    place = {w: i for i, w in enumerate(dict.fromkeys(w for r in refs for w in r["words"]))}
    base, classes, common = [], [], np.zeros((len(items), len(place)))
    for i, text in enumerate(items):
        own, h = text.split(), class_counts(text)
        classes.append(h[:-1])
        base.append((len(own), int(h[:-1].sum() - h[4] - h[5]), int(h[6]), dup_lines(text), repeat_words(own)))
        np.add.at(common[i], [place[w] for w in text.lower().split() if w in place], 1)
    n = np.array(base, dtype=np.int64).reshape(-1, 5)
    share = np.array(classes, dtype=float).reshape(-1, len(CLASSES))
    share /= np.maximum(1, share.sum(axis=1, keepdims=True))
    common /= np.maximum(1, n[:, :1])
    char, word = np.full(len(n), np.inf), np.full(len(n), np.inf)
    for r in refs:
        p = common[:, [place[w] for w in r["words"]]]
        char = np.minimum(char, distance(share, r["classes"]))
        word = np.minimum(word, distance(np.column_stack([p, np.maximum(0, 1 - p.sum(axis=1))]), r["shares"]))
    if not refs:
        char[:], word[:] = 0, 0
    failed = (n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0])
    far = ((n[:, 0] >= CHAR_WORDS) & (char > CHAR_LIMIT)) | ((n[:, 0] >= WORD_WORDS) & (word > WORD_LIMIT))
    return [*(n[:, k] for k in range(5)), failed, ~failed & ~far, char, word]


def verdicts(docs: DataFrame, refs: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A null or empty text has no words and fails the base rules. A null lang counts as the language `und`. Rows that repeat
    get a row each. An empty table gives no rows. Without any reference only the base rules decide. Other columns are not
    read; a document's own lang isn't used for its verdict. Very long texts are counted whole.
    """
    refs = references(docs) if refs is None else refs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, _judge(texts(part.column("text")), refs))], ["doc_id", *_VERDICT])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that the rules keep; cases as in `verdicts`."""
    refs = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(pa.array(_judge(texts(part.column("text")), refs)[6]))

    return map_arrow(docs, run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """The verdict on every whole text of documents, as `verdicts` gives it; its cases hold."""
    return verdicts(documents(spark, sf_dir))
