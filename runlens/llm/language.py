"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (of all lengths in a range: a blended spectrum) that occur in both,
each counted once, over the root of the product of their own counts. The texts of a bounded sample of labelled documents
are Nystroem landmarks; one-versus-rest kernel ridge regression on the landmark features is fitted in closed form on the
sample. n-grams are hashed into a fixed number of bins, so a text is a row of bits: the sample reaches the driver as packed
bits, whatever the length of its texts. Landmarks and regression weights are multiplied once, to bins x languages; a batch
of documents is scored by one matrix product of its presence rows with that. Every language of the training rows is learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import documents, map_arrow, slices, texts

LENGTHS = (1, 2, 3)
BINS = 1 << 14
SAMPLE, LANDMARKS = 300, 64  # labelled documents of each language, and how many of them are landmarks ...
ALL_SAMPLE, ALL_LANDMARKS = 8192, 1024  # ... or less, where there are many languages; two and one at least
RIDGE = 1e-2
PIECE = 64  # documents in a product


def _bins(text: bytes) -> np.ndarray:
    """The bins of all n-grams of a text, lower case where ASCII; digits and white space count as blanks."""
    a = np.frombuffer(text.translate(_FOLD), np.uint8).astype(np.uint32)
    found, h = [], np.zeros(len(a), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(a) < n:
            break
        h = h[: len(a) - n + 1] * np.uint32(0x9E3779B1) + a[n - 1 :] + np.uint32(n)
        if n in LENGTHS:
            found.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BINS.bit_length() + 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\r\x0b\x0c0123456789" else c for c in range(256))


def presence(items: list[bytes]) -> np.ndarray:
    """A row for each text, scaled to length 1, so that products of rows are normalised kernels."""
    out = np.zeros((len(items), BINS), np.float32)
    for i, text in enumerate(items):
        out[i, _bins(text)] = 1
    return out / np.sqrt(np.maximum(1, out.sum(axis=1, keepdims=True)))


def shares(languages: int) -> tuple[int, int]:
    """Documents and landmarks of each language."""
    n = max(1, languages)
    return max(2, min(SAMPLE, ALL_SAMPLE // n)), max(1, min(LANDMARKS, ALL_LANDMARKS // n))


def packed(items: list[bytes]) -> np.ndarray:
    """A row of bits for each text."""
    out = np.zeros((len(items), BINS), bool)
    for i, text in enumerate(items):
        out[i, _bins(text)] = True
    return np.packbits(out, axis=1)


def _rows(bits: np.ndarray) -> np.ndarray:
    """Rows of presence, as in `presence`, from packed bits."""
    out = np.unpackbits(bits, axis=1).astype(np.float32)
    return out / np.sqrt(np.maximum(1, out.sum(axis=1, keepdims=True)))


class LanguageModel:
    """Regression weights by bin and language, from packed bits; `decide` gives language and score of texts."""

    def __init__(self, bits: np.ndarray, langs: list[str], landmarks: list[bool]):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        marks = _rows(bits[np.array(landmarks, bool)])
        kernel = np.concatenate([_rows(bits[i : i + PIECE]) @ marks.T for i in range(0, len(bits), PIECE)]).astype(np.float64)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])  # Nystroem: features whose products approach the kernel
        f = np.column_stack([kernel @ root, np.ones(len(kernel))])
        place = {c: i for i, c in enumerate(self.langs)}
        own = np.array([place[g] for g in langs])
        weight = 1 / np.bincount(own)[own]  # languages weigh the same
        y = np.full((len(own), len(self.langs)), -1.0, np.float32)
        y[np.arange(len(own)), own] = 1
        penalty = np.eye(f.shape[1]) * RIDGE
        penalty[-1, -1] = 1e-9
        w = np.linalg.solve((f * weight[:, None]).T @ f + penalty, (f * weight[:, None]).T @ y)
        self.weights, self.bias = marks.T @ (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def decide(self, items: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(items), np.zeros(len(items))
        names, scores = [], []
        for i in range(0, len(items), PIECE):
            margins = presence(items[i : i + PIECE]) @ self.weights + self.bias
            best = margins.argmax(axis=1)
            names += [self.langs[b] for b in best]
            scores.append(np.clip((margins[np.arange(len(best)), best] + 1) / 2, 0, 1))
        return names, np.concatenate(scores).astype(float) if scores else np.zeros(0)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode(errors="replace")))


def training_rows(docs: DataFrame) -> DataFrame:
    """A sample: of each language the documents with the least hashes, as packed bits (lang, k from 1, bits)."""
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    keyed = learn.select(F.col("lang").cast("string").alias("lang"), "doc_id", F.xxhash64("text").alias("h"))
    most, _ = shares(keyed.agg(F.countDistinct("lang")).first()[0])
    # least hashes first within parts of a language, so that no task ranks a whole language; repeated texts count once
    part = keyed.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")).withColumn("part", F.pmod("h", F.lit(256)))
    near = part.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("k") <= most)
    top = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= most)
    chosen = top.select("doc_id", "h", "k", F.col("lang").alias("chosen_lang"))
    rows = learn.select("doc_id", "text", F.xxhash64("text").alias("h"), F.col("lang").cast("string").alias("chosen_lang"))
    same = rows["doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["h"] == chosen["h"]) & (rows["chosen_lang"] == chosen["chosen_lang"])
    met = rows.join(F.broadcast(chosen), same).select("text", chosen["chosen_lang"].alias("lang"), "k")  # ALL_SAMPLE rows, or two for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                bits = pa.array([x.tobytes() for x in packed(texts(part.column("text")))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("k"), bits], ["lang", "k", "bits"])

    return map_arrow(met, run, "lang string, k int, bits binary").dropDuplicates(["lang", "k"])


def held_out(doc_id):
    """Whether the remainder of crc32(doc_id as text) by 5 is 0; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> LanguageModel:
    rows = training_rows(docs).orderBy("lang", "k").collect()  # BINS bits each
    _, marks = shares(len({r["lang"] for r in rows}))
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(-1, BINS // 8)
    return LanguageModel(bits, [r["lang"] for r in rows], [r["k"] <= marks for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score.

    A null text, an empty one and one without a letter are `und` with score 0. A null doc_id counts as a training row. Rows
    that repeat get a row each. An empty table gives no rows; without labelled documents all is `und`. Between languages with
    equal margins the first by code point is chosen. Very long texts are read whole, here and in the sample. Other columns
    are not read, and a prediction reads the text only.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                items = texts(part.column("text"))
                names, scores = model.decide(items)
                clear = [has_letter(t) for t in items]
                names = [n if c else "und" for n, c in zip(names, clear)]
                arrays = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(clear, scores, 0.0))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_arrow(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, as `identify` gives it; its cases hold."""
    return identify(documents(spark, sf_dir))
