"""Byte-pair encoding that guesses and verifies.

A word is cut greedily into the longest tokens of the vocabulary. A cut is the exact encoding if and
only if every adjacent pair of its tokens is compatible, that is, exact merging of the two tokens'
bytes gives these two tokens again. Compatibility is looked up for all adjacent pairs of all new words
at once; each distinct pair is settled once by exact merging. Only words with an incompatible pair are
merged exactly themselves.

Texts are cut into words as byte-level tokenizers do. Special tokens of the vocabulary file are found
in texts first, as its library does by default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Words whose encodings one task remembers; beyond that it starts anew.
REMEMBERED_WORDS = 400_000
# Longer words are merged one by one with a heap, shorter ones in columns.
COLUMN_BYTES = 64
# Words that are looked up and learned together; fewer than are remembered.
SLICE = 1 << 16

# Fixed value: the byte-level word pattern; white space is the Unicode property.
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


# The same pattern for texts below U+0250, where the classes are short lists; the plain engine is faster.
_LETTER, _NUMBER, _BLANK = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
LATIN_WORD = f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
BEYOND_LATIN = "[^\\x00-\\u024f]"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte in byte-level vocabulary files: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file; lives inside a task."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.prefixes = {t[:n]: 0 for t in self.ids for n in range(1, len(t) + 1)}
        for node, prefix in enumerate(self.prefixes, 1):
            self.prefixes[prefix] = node
        # The same trie as sorted steps: node * 256 + byte leads to a node; and the token that ends at it.
        steps = np.array([self.prefixes.get(p[:-1], 0) * 256 + p[-1] for p in self.prefixes])
        order = np.argsort(steps)
        self.steps, self.leads = steps[order], order + 1
        self.ends = np.array([-1, *[self.ids.get(p, -1) for p in self.prefixes]])
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.size = size
        codes = np.array([a * size + b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(codes)
        self.merge_codes = codes[order]
        self.merge_ranks = np.array([r for r, _ in self.merges.values()])[order]
        self.merge_results = np.zeros(len(codes) + 1, np.int64)
        self.merge_results[self.merge_ranks] = np.array([i for _, i in self.merges.values()])[order]
        self.single_ids = np.array(self.single)
        self.lengths = np.array([len(t) for t in self.bytes])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        # Settled pairs as sorted codes a * (size + 1) + b with their verdicts; b = size stands for a token alone.
        self.codes = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.known: dict[str, bytes] = {}
        self.pattern = regex.compile(WORD)
        self.latin = re.compile(LATIN_WORD)
        self.beyond = re.compile(BEYOND_LATIN)
        self.breaks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """Exact encoding of one long word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.single[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        end = len(ids)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merges[a, b][1], -1, after[j]
            if after[i] < end:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else end
                if right < end and (pair := (ids[left], ids[right])) in self.merges:
                    heapq.heappush(heap, (self.merges[pair][0], left, *pair))
        return [i for i in ids if i >= 0]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        codes = a * self.size + b
        at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
        return np.where((self.merge_codes[at] == codes) & (a >= 0) & (b >= 0), self.merge_ranks[at], len(self.merge_codes))

    def exact(self, words: list[bytes]) -> list[list[int]]:
        """Exact encodings. Words up to COLUMN_BYTES are merged together, one merge of each at a time."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words])
        never = len(self.merge_codes)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, COLUMN_BYTES)):
            group = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(group):
                continue
            flat = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in group), np.uint8).reshape(-1, high)
            column = np.arange(high)
            ids = np.where(column < sizes[group, None], self.single_ids[flat], -1)
            ids = np.concatenate((ids, np.full((len(group), 1), -1)), axis=1)
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            alive = np.arange(len(group))
            done = ids.copy()
            while len(alive):
                best = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(alive)), best]
                over = rank == never
                if over.any():
                    done[alive[over]] = ids[over]
                    alive, ids, ranks, best, rank = alive[~over], ids[~over], ranks[~over], best[~over], rank[~over]
                    if not len(alive):
                        break
                rows = np.arange(len(alive))
                shift = column + (column > best[:, None])
                ids[:, :-1] = np.take_along_axis(ids, shift, axis=1)
                ids[rows, best] = self.merge_results[rank]
                ranks = np.take_along_axis(ranks, np.minimum(column + (column >= best[:, None]), high - 1), axis=1)
                ranks[:, -1] = never
                ranks[rows, best] = self._ranks(ids[rows, best], ids[rows, best + 1])
                left = best > 0
                ranks[rows[left], best[left] - 1] = self._ranks(ids[rows[left], best[left] - 1], ids[rows[left], best[left]])
            lengths = (done >= 0).sum(axis=1)
            for i, row, n in zip(group.tolist(), done.tolist(), lengths.tolist()):
                out[i] = row[:n]
        for i in np.flatnonzero(sizes > COLUMN_BYTES).tolist():
            out[i] = self.merged(words[i])
        return out

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest token at each place of every word: all ids, and how many each word has."""
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        stop = np.cumsum(sizes)
        at = stop - sizes
        word = np.arange(len(words))
        cursor, node, best, token = at.copy(), np.zeros_like(at), at.copy(), np.zeros_like(at)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            codes = node * 256 + data[cursor]
            spot = np.minimum(np.searchsorted(self.steps, codes), len(self.steps) - 1)
            goes = (self.steps[spot] == codes) & (cursor < stop)
            node = np.where(goes, self.leads[spot], 0)
            cursor += goes
            ends = self.ends[node]
            longer = goes & (ends >= 0)
            best, token = np.where(longer, cursor, best), np.where(longer, ends, token)
            if not goes.all():
                stuck = ~goes
                found.append((best[stuck], token[stuck]))
                cursor = np.where(stuck, best, cursor)
                on = ~stuck | (best < stop)
                word, cursor, node, best, token, stop = (v[on] for v in (word, cursor, node, best, token, stop))
        places = np.concatenate([p for p, _ in found])
        order = np.argsort(places)
        ids = np.concatenate([t for _, t in found])[order]
        counts = np.diff(np.searchsorted(places[order], np.append(0, np.cumsum(sizes)), side="right"))
        return ids, counts

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair stays as it is under exact merging; b = size stands for no second token."""
        codes = a * (self.size + 1) + b
        asked = np.unique(codes)
        new = np.setdiff1d(asked, self.codes, assume_unique=True)
        if len(new):
            pairs = [[x] if y == self.size else [x, y] for x, y in zip(*(v.tolist() for v in np.divmod(new, self.size + 1)))]
            got = self.exact([b"".join([self.bytes[i] for i in pair]) for pair in pairs])
            fits = np.fromiter((g == p for g, p in zip(got, pairs)), bool, len(new))
            at = np.searchsorted(self.codes, new)
            self.fits, self.codes = np.insert(self.fits, at, fits), np.insert(self.codes, at, new)
        return self.fits[np.searchsorted(self.codes, codes)]

    def learn(self, words: set[str]) -> None:
        """Encode new words and remember them as packed ids."""
        if len(self.known) + len(words) > REMEMBERED_WORDS:
            self.known.clear()
        words = list(words)
        raw = [w.encode() for w in words]
        first, sizes = self.greedy(raw)
        second = np.append(first[1:], self.size)
        last = np.cumsum(sizes) - 1
        # The last token of a longer word has no pair of its own; a word of one token is checked alone.
        second[last] = self.size
        checked = np.ones(len(first), bool)
        checked[last[sizes > 1]] = False
        fits = np.ones(len(first), bool)
        fits[checked] = self.compatible(first[checked], second[checked])
        right = np.logical_and.reduceat(fits, last - sizes + 1)
        packed, begin, end = first.astype(np.uint32).tobytes(), (4 * (last - sizes + 1)).tolist(), (4 * (last + 1)).tolist()
        self.known.update((w, packed[lo:hi]) for w, lo, hi in zip(words, begin, end))
        wrong = np.flatnonzero(~right).tolist()
        for i, ids in zip(wrong, self.exact([raw[i] for i in wrong])):
            self.known[words[i]] = np.array(ids, dtype=np.uint32).tobytes()

    def _packed(self, groups: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of words; what is new in any of them is learned together."""
        known = self.known
        new = set().union(*groups).difference(known)
        if new:
            self.learn(new)
            # Learning may have cleared what was remembered.
            missing = set().union(*groups).difference(known)
            if missing:
                self.learn(missing)
        return [b"".join(map(known.__getitem__, words)) for words in groups]

    def _pieces(self, text: str) -> Iterator[str | int]:
        """Runs of ordinary text, and the ids of special tokens between them."""
        at = 0
        if self.breaks is not None and any(s in text for s in self.special):
            for found in self.breaks.finditer(text):
                yield text[at : found.start()]
                yield self.special[found.group()]
                at = found.end()
        yield text[at:] if at else text

    def _words(self, piece: str) -> Iterator[list[str]]:
        pattern = self.pattern if self.beyond.search(piece) else self.latin
        if len(piece) <= 4 * SLICE:
            yield pattern.findall(piece)
            return
        words: list[str] = []
        for found in pattern.finditer(piece):
            words.append(found.group())
            if len(words) == SLICE:
                yield words
                words = []
        yield words

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. Words are gathered over many texts before any is encoded."""
        out: list[list[bytes]] = [[] for _ in texts]
        slots: list[tuple[int, int]] = []
        waiting: list[list[str]] = []
        held = 0

        def settle() -> None:
            nonlocal held
            for (i, k), data in zip(slots, self._packed(waiting)):
                out[i][k] = data
            slots.clear()
            waiting.clear()
            held = 0

        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                if isinstance(piece, int):
                    out[i].append(np.array([piece], dtype=np.uint32).tobytes())
                    continue
                for words in self._words(piece):
                    slots.append((i, len(out[i])))
                    out[i].append(b"")
                    waiting.append(words)
                    held += len(words)
                    if held >= SLICE:
                        settle()
        settle()
        return [np.frombuffer(b"".join(parts), dtype=np.uint32) for parts in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        shift = self.places[ids] - (ends - sizes)
        return self.pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(shift, sizes)].tobytes()


def encode_texts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``ids`` (its whole text encoded) and ``decoded`` (the ids decoded).

    ``path`` names a byte-level vocabulary file that every executor has. A null text is empty: no ids,
    empty decoded text. Repeated rows are encoded alike; other columns are ignored. ``keep`` must not
    name ``ids`` or ``decoded``.
    """
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = codec.encode([t or "" for t in part.column(n).to_pylist()])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
                texts = [codec.decode(ids).decode("utf-8", "replace") for ids in found]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], ids, pa.array(texts, pa.string())], names=[*keep, "ids", "decoded"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*kinds, "ids array<int>", "decoded string"]))
