"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

A sequence of pieces is the encoding of a text if and only if every two neighbours are the encoding of their joined text,
so a left-to-right search finds it: take the longest piece at a place (Aho-Corasick), check that it is compatible with its
left neighbour by merging the two anew, else try the next shorter prefix, and step back where none fits. A prefix has one
encoding only, so a place that failed once fails for good; a bitfield remembers these places.

No piece joins characters of unlike groups (groups: characters that stand next to each other in some piece), so a text
falls apart into units, space runs with what follows, which are encoded on their own and kept for when they come again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from runlens.llm.common import documents, map_arrow, slices, texts

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
KEPT_WORDS = 400_000
KEPT_WORD_CHARS = 64
KEPT_PAIRS = 1_000_000
_COMMA = ","
_NEVER = float("inf")


class PieceCodec:
    """encode and decode of one merge-type model with identity normalisation and byte fallback."""

    def __init__(self, model: bytes):
        proto = model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a BPE model with identity normalisation is needed")
        self.prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.unk_surface = proto.trainer_spec.unk_surface
        if USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("user-defined or unused pieces aren't supported")
        self.unk = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.worth = {p: -proto.pieces[i].score for p, i in self.ids.items()}  # the least merges first
        self.width = list(map(len, self.pieces))
        self._pairs: dict[int, bool] = {}
        self._units()
        reachable = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}
        self.reachable = reachable
        self.shorter = {i: next((reachable[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reachable), None) for p, i in reachable.items()}
        self.trie: dict = {}
        for p, i in reachable.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.longest_piece = max(map(len, reachable))
        self.automaton = ahocorasick.Automaton()
        for p, i in reachable.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.spaced: dict[str, str] = {}  # words after a blank
        self.bare: dict[str, str] = {}  # words at the start of a line
        self.odd: set[tuple[str, bool]] = set()
        self.plain_breaks = bool(self.bytes) and not self.whole and not any("\n" in p for p in self.ids)
        self.break_ids = str(self.bytes.get(10, self.unk))

    def _units(self) -> None:
        """Groups of characters, and the pattern that cuts a text into units."""
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        self.whole = False
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                if SPACE not in (a, b):
                    root[find(a)] = find(b)
                elif b == SPACE != a:
                    self.whole = True  # a space joins what stands before it: no cut is safe
        groups: dict[str, list[str]] = {}
        for c in list(root):
            groups.setdefault(find(c), []).append(c)
        classes = sorted(groups.values(), key=len, reverse=True)  # one character: it joins itself
        runs = "|".join("[" + "".join(map(re.escape, sorted(g))) + "]+" for g in classes)
        self.pattern = re.compile(f"{SPACE}*(?:{runs}|[^{SPACE}])|{SPACE}+" if runs else f"{SPACE}*[^{SPACE}]|{SPACE}+", re.DOTALL)

    def merge(self, text: str) -> list[str]:
        """Merging itself: the best-scored neighbours first, the leftmost among equals."""
        parts, worth = list(text), self.worth.get
        costs = [worth(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < _NEVER:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = worth(parts[i] + parts[i + 1], _NEVER)
            if i:
                costs[i - 1] = worth(parts[i - 1] + parts[i], _NEVER)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > KEPT_PAIRS:
                self._pairs.clear()
            left, right = self.pieces[a], self.pieces[b]
            known = self._pairs[key] = self.merge(left + right) == [left, right]
        return known

    def _longest(self, text: str, at: int) -> int:
        """The longest piece at a place, or minus its code point, minus 1, for a character without one."""
        node, found = self.trie, -ord(text[at]) - 1
        for c in text[at : at + self.longest_piece]:
            node = node.get(c)
            if node is None:
                break
            found = node.get("", found)
        return found

    def _search(self, unit: str, out: list[int], at: int, candidate: int | None) -> list[int]:
        """Backtracking from a prefix that is encoded. A character without a piece merges with nothing."""
        pairs, width, shorter, failed = self._pairs, self.width, self.shorter, 0
        while True:
            if candidate is None:
                failed |= 1 << at
                last = out.pop()
                at -= width[last] if last >= 0 else 1
                candidate = shorter.get(last)
                continue
            end = at + (width[candidate] if candidate >= 0 else 1)
            if not failed >> end & 1 and (not out or (last := out[-1]) < 0 or candidate < 0 or (pairs.get(last << 32 | candidate) or self.compatible(last, candidate))):
                out.append(candidate)
                at = end
                if at == len(unit):
                    return out
                candidate = self._longest(unit, at)
            else:
                candidate = shorter.get(candidate)

    def encode_unit(self, unit: str) -> list[int]:
        """Longest matches in a row as far as they are compatible, then the search."""
        out: list[int] = []
        at, size, pairs, width = 0, len(unit), self._pairs, self.width
        candidate = None
        for end, piece in self.automaton.iter_long(unit):
            if at + width[piece] != end + 1:
                break  # a character without a piece
            if out and not (pairs.get(out[-1] << 32 | piece) or self.compatible(out[-1], piece)):
                candidate = piece
                break
            out.append(piece)
            at = end + 1
        if at < size:
            out = self._search(unit, out, at, self._longest(unit, at) if candidate is None else self.shorter.get(candidate))
        if min(out) >= 0:
            return out
        flat: list[int] = []
        for i in out:
            flat += [i] if i >= 0 else [self.bytes[b] for b in chr(-i - 1).encode()] if self.bytes else [self.unk]
        return flat

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return [text] if self.whole else self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.encode_unit(u)]

    def _surface(self, ids: list[int]) -> str:
        """The text of pieces, spaces as spaces; bytes that aren't UTF-8 become replacement characters, one for each byte."""
        out, raw = [], bytearray()

        def flush() -> None:
            while raw:
                try:
                    out.append(raw.decode())
                    raw.clear()
                except UnicodeDecodeError as e:
                    out.append(raw[: e.start].decode() + "�")
                    del raw[: e.start + 1]

        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                raw.append(self.byte_of[i])
                continue
            flush()
            out.append(self.unk_surface if kind == UNKNOWN else "" if kind == CONTROL else self.pieces[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self._surface(ids)
        first = next((i for i in ids if self.types[i] != CONTROL), self.unk)
        return text[1:] if self.prefix and self.types[first] == NORMAL and self.pieces[first].startswith(SPACE) else text

    def _spell(self, units: list[str]) -> tuple[str, str]:
        ids = [i for u in units for i in self.encode_unit(u)]
        return _COMMA.join(map(str, ids)), self._surface(ids)

    def _learn(self, words: list[str], first: bool) -> None:
        """Encode and decode the words of a line that aren't kept yet. first: the first one has no space before it."""
        for i, w in enumerate(words):
            known = self.bare if first and not i else self.spaced
            if w not in known:
                start = "" if known is self.bare else SPACE
                known[w], plain = self._spell(self.pattern.findall(start + w) if w or start else [])
                if plain != start.replace(SPACE, " ") + w:
                    self.odd.add((w, known is self.bare))

    def spell(self, text: str) -> tuple[str, str]:
        """The ids joined by commas, and the text that they decode to.

        Lines and words of a text without doubled blanks are looked up among the words encoded so far, each with the check
        that it decodes to itself; the decoded text of such words is their text. All other texts are spelled out.
        """
        joined, plain = None, text
        if text and self.plain_breaks and "  " not in text and SPACE not in text and len(text) <= 1 << 20:
            joined = self._by_words(text)
        if joined is None:
            joined, plain = self._spell(self.units(text))
            first = int(joined.partition(_COMMA)[0]) if joined else self.unk
            if self.prefix and self.pieces[first].startswith(SPACE):
                plain = plain[1:]
        if len(self.spaced) > KEPT_WORDS:
            self.spaced, self.bare, self.odd = {}, {}, set()
        return joined, plain

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        joined, plain = self.spell(text)
        return joined.count(_COMMA) + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()

    def _by_words(self, text: str) -> str | None:
        """Ids joined by commas, or None where a word is too long to keep or doesn't decode to itself."""
        out = []
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.break_ids)
            if not line:
                if not n and self.prefix:
                    out.append(self._spell([SPACE])[0])
                continue
            words, first = line.split(" "), bool(n) or not self.prefix
            if not (words[0] and words[-1]):
                return None
            try:
                out.append(self._look_up(words, first))
            except KeyError:
                if max(map(len, words)) > KEPT_WORD_CHARS:
                    return None
                self._learn(words, first)
                if self.odd and any((w, first and not i) in self.odd for i, w in enumerate(words)):
                    return None
                out.append(self._look_up(words, first))
        return _COMMA.join(out)

    def _look_up(self, words: list[str], first: bool) -> str:
        if not first:
            return _COMMA.join(map(self.spaced.__getitem__, words))
        head = self.bare[words[0]]
        return head + _COMMA + _COMMA.join(map(self.spaced.__getitem__, words[1:])) if len(words) > 1 else head


_CODECS: dict[str, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec for each model and Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes | None = None, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, other columns as asked for, n_tokens, ids (array of int) and decoded: the texts encoded and decoded.

    A null or empty text has no ids and decodes to the empty text. Rows that repeat get a row each; a null doc_id stays
    null. Bytes that are no UTF-8 become replacement characters. A very long text is encoded whole. An empty table gives no
    rows. No other columns are read; `others` must not be named ids, n_tokens or decoded.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                spelled = [own.spell(x.decode(errors="replace")) for x in texts(part.column("text"))]
                sizes = [joined.count(_COMMA) + 1 if joined else 0 for joined, _ in spelled]
                flat = np.array(_COMMA.join([joined for joined, _ in spelled if joined]).split(_COMMA) if any(sizes) else [], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()))
                arrays = [*(part.column(c) for c in names), pa.array(sizes, pa.int64()), ids, pa.array([plain for _, plain in spelled], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "n_tokens", "ids", "decoded"])

    names = ["doc_id", *others]
    types = dict(docs.dtypes)
    return map_arrow(docs.select(*names, "text"), run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_tokens long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; cases as in encode_documents."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = [own.digest(x.decode(errors="replace")) for x in texts(part.column("text"))]
                n, ids, plain = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_pieces(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text of documents, as digests; the cases of encode_documents hold."""
    return digest_documents(documents(spark, sf_dir))
