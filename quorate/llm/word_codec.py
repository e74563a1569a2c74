"""Token ids of a vocabulary with word ends, as its library gives them, for many texts at once.

Texts of letters below U+0250 are cut into words in columns: characters are classed by a table, words
are hashed where they stand, and only words that a worker has not met yet are merged, all of one length
together. Other texts, very long words and texts with special tokens go through the library.

Words are known by 64-bit hashes.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from tokenizers import Tokenizer

from quorate.llm.common import span_hashes
from quorate.llm.speculative_bpe import byte_alphabet

# Words that a worker remembers; beyond that it starts anew.
REMEMBERED_WORDS = 1_000_000
# Longer words are merged by the library.
COLUMN_BYTES = 64
# Characters of texts that are encoded together.
BLOCK = 1 << 20
# Texts with a character from here on go through the library; so does the one letter below that has two for lower case.
PLAIN = 0x250
BEYOND = regex.compile("[^\\x00-\\u012f\\u0131-\\u024f]")
END = "</w>"

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, class of the lower case) of every character below PLAIN."""
    kinds = [regex.compile(p) for p in (r"\p{White_Space}", r"\p{L}", r"\p{N}")]
    lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(PLAIN)], np.uint32)
    kind = np.array([next((k for k, p in enumerate(kinds) if p.match(chr(c))), _OTHER) for c in lower.tolist()], np.uint8)
    return lower, kind


def word_spans(low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of lower-case characters.

    A word is an apostrophe with one of seven endings where no other sign stands before it, a run of
    letters, a single number or a run of other signs.
    """
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    start = (kind != before) & (kind != _SPACE) | (kind == _NUMBER)
    quote = np.flatnonzero((low == ord("'")) & start)
    if len(quote):
        padded = np.concatenate((low, np.zeros(3, low.dtype)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        start[quote[short | long] + 1] = False
        rest = np.concatenate((quote[short] + 2, quote[long] + 3))
        rest = rest[rest < len(low)]
        start[rest[kind[rest] == _LETTER]] = True
    starts = np.flatnonzero(start)
    # A word ends where the next begins or white space follows.
    stop = start.copy()
    stop[1:] |= (kind[1:] == _SPACE) & (kind[:-1] != _SPACE)
    stops = np.append(np.flatnonzero(stop), len(low))
    return starts, stops[np.searchsorted(stops, starts, side="right")]


class WordCodec:
    """Encoder of one vocabulary file; lives inside a worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = spec["model"]["vocab"]
        self.tokens = {i: t for t, i in vocabulary.items()}
        self.size = 1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = sorted(byte_alphabet().items(), key=lambda x: x[1])
        self.inner = np.array([vocabulary[c] for c, _ in letters])
        self.last = np.array([vocabulary[c + END] for c, _ in letters])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        codes = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.results = np.array([vocabulary[a + b] for a, b in pairs])
        self.lower, self.kind = _classes()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the list of merges; its length where there is none."""
        codes = np.where(b >= 0, a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.order[at], len(self.codes))

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of one length class: the pair of lowest rank, leftmost first, is merged in every word until none has one."""
        width = max(map(len, words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        place = np.arange(width)
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[:, :-1] = np.where(place < sizes[:, None] - 1, self.inner[raw], np.where(place == sizes[:, None] - 1, self.last[raw], -1))
        never = len(self.codes)
        ranks = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(ids.shape[0], width)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        open_ = np.arange(len(words))
        while len(open_):
            at = ranks.argmin(axis=1)
            best = np.take_along_axis(ranks, at[:, None], axis=1)[:, 0]
            done = best == never
            if done.any():
                lengths = (ids[done] >= 0).sum(axis=1)
                for i, row, n in zip(open_[done].tolist(), ids[done].astype(np.uint32), lengths.tolist()):
                    out[i] = row[:n]
                live = ~done
                open_, ids, ranks, at, best = open_[live], ids[live], ranks[live], at[live], best[live]
                continue
            row = np.arange(len(open_))
            # What stands behind the pair moves one place to the left.
            ids[:, :-1] = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(place + (place >= at[:, None]), width - 1), axis=1)
            ranks[:, -1] = never
            ids[row, at] = self.results[best]
            ranks[row, at] = self._ranks(ids[row, at], ids[row, at + 1])
            inner = at > 0
            ranks[row[inner], at[inner] - 1] = self._ranks(ids[row[inner], at[inner] - 1], ids[row[inner], at[inner]])
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(raw)
        for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 32), (32, COLUMN_BYTES)):
            group = np.flatnonzero((lengths > lo) & (lengths <= hi)).tolist()
            for i, ids in zip(group, self.merged([raw[i] for i in group]) if group else []):
                found[i] = ids
        for i in np.flatnonzero(lengths > COLUMN_BYTES).tolist():
            found[i] = np.array(self.library.encode(words[i], add_special_tokens=False).ids, np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.concatenate(found)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        self.pool[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, hashes)
        first = self.used + np.cumsum(sizes) - sizes
        self.known, self.first, self.sizes = (np.insert(old, at, new) for old, new in ((self.known, hashes), (self.first, first), (self.sizes, sizes)))
        self.used += len(flat)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of texts below PLAIN."""
        joined = "\n".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        low = self.lower[chars]
        starts, ends = word_spans(low, self.kind[chars])
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes, at, which = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > REMEMBERED_WORDS:
            self.forget()
        spot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != hashes[inside]
        if new.any():
            text = low.tobytes().decode("utf-32-le")
            self._learn(hashes[new], [text[s:e] for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            spot = np.searchsorted(self.known, hashes)
        first, sizes = self.first[spot][which], self.sizes[spot][which]
        upto = np.cumsum(sizes)
        ids = self.pool[np.arange(upto[-1]) + np.repeat(first - (upto - sizes), sizes)]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        words = np.searchsorted(starts, bounds)
        ends_at = np.append(0, upto)[words]
        return ids, np.diff(ends_at, prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of whole texts, in order."""
        odd = [i for i, t in enumerate(texts) if BEYOND.search(t) or any(s in t for s in self.special)]
        own = set(odd)
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and hi not in own and (hi == lo or held + len(texts[hi]) <= BLOCK):
                held += len(texts[hi])
                hi += 1
            if hi == lo:
                ids = np.array(self.library.encode(texts[lo], add_special_tokens=False).ids, np.uint32)
                counts[lo] = len(ids)
                hi += 1
            else:
                ids, counts[lo:hi] = self._plain(texts[lo:hi])
            parts.append(ids)
            lo = hi
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), counts

    def sentence_ends(self) -> np.ndarray:
        """By id: 1 if the token ends a word of closing signs with a full stop, question or exclamation mark among them; 2 for numbers."""
        out = np.zeros(self.size, np.uint8)
        for i, token in self.tokens.items():
            word = token.removesuffix(END)
            if token.endswith(END) and regex.fullmatch(r"""[.!?…]+["')\]]*""", word):
                out[i] = 1
            elif regex.fullmatch(r"[0-9]", word):
                out[i] = 2
        return out


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec per worker and file: what one task learns serves the next."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]
