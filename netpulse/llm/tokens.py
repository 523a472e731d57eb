"""Token ids of whole texts by a public tokenizer file, with a cache of words.

The tokenizer drops white space and never lets a token cross it, nor the boundary between an
ASCII letter or digit and ASCII punctuation, so a text's ids are the ids of its words in
order, and a word's those of its stem and its closing punctuation. The words of a batch are
hashed together (64 bits), each distinct word is looked up once, words not met before are
encoded, and the ids of all texts are gathered at once. Texts that hold the opening of a
special token are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

from netpulse.llm.textops import Hasher, slices

#: words in a worker's newer cache; at this many it becomes the older one, which is dropped (ids never change)
CACHE_WORDS = 800_000
_STEM = re.compile(rb"(.*[a-z0-9])([.,;:!?*%&$#]+)", re.DOTALL)


def gather(ids: np.ndarray, at: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the entries in order, where entry i has ids[at[i] : at[i + 1]], and their numbers of ids."""
    start = at[entries]
    length = at[entries + 1] - start
    place = np.repeat(start - (np.cumsum(length) - length), length)
    return ids[place + np.arange(len(place))], length


class Words:
    """Ids of words by their hash."""

    def __init__(self) -> None:
        self.n = 0
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by key
        self.ids, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of sorted hashes, -1 where there is none."""
        if not self.n:
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.keys, hashes), self.n - 1)
        return np.where(self.keys[place] == hashes, self.entry[place], -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add sorted hashes that are not there yet."""
        used, m = int(self.at[self.n]), len(hashes)
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + m >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[used : used + len(ids)] = ids
        self.at[self.n + 1 : self.n + 1 + m] = used + np.cumsum(lengths)
        place = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, place, hashes)
        self.entry = np.insert(self.entry, place, np.arange(self.n, self.n + m))
        self.n += m


class Encoder:
    """``encode(column)`` gives, for pieces of an Arrow text column, every text's ids."""

    def __init__(self, file_name: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tokenizers

        self.hasher = Hasher()
        # one tokenizer and cache for all tasks of a reused Python worker
        kept = tokenizers.__dict__.setdefault("_word_caches", {})
        if file_name not in kept:
            tok = tokenizers.Tokenizer.from_file(public_tokenizers.path(file_name))
            vocab = tok.get_vocab()
            ends = np.zeros(max(vocab.values()) + 1, bool)
            for piece, i in vocab.items():
                ends[i] = piece.endswith("</w>")
            kept[file_name] = {"tok": tok, "ends": ends, "new": Words(), "old": Words()}
        self.kept = kept[file_name]
        self.tok, self.ends = self.kept["tok"], self.kept["ends"]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, in order, and the number of each word's ids."""
        cut = [m.groups() if (m := _STEM.fullmatch(w)) else (w,) for w in words]
        parts = {p: i for i, p in enumerate(dict.fromkeys(p for pieces in cut for p in pieces))}
        texts = [p.decode() for p in parts]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        other = [i for i, t in enumerate(texts) if not t.isalpha()]
        length = np.zeros(len(texts), np.int64)
        found, order = [np.zeros(0, np.uint32)], []
        for a in range(0, len(plain), 20_000):
            some = plain[a : a + 20_000]
            ids = self._whole(" ".join([texts[i] for i in some]))
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some):  # letters only: each word ends with one word-end token
                length[some] = np.diff(at, prepend=0)
                found.append(ids)
                order += some
            else:
                other += some
        for a in range(0, len(other), 4096):
            some = other[a : a + 4096]
            enc = self.tok.encode([texts[i] for i in some], is_pretokenized=True, add_special_tokens=False)
            if enc.ids:
                length[some] = np.bincount(np.array(enc.word_ids, np.int64), minlength=len(some))
            found.append(np.array(enc.ids, np.uint32))
            order += some
        entry = np.zeros(len(texts), np.int64)
        entry[order] = np.arange(len(order))
        at = np.concatenate([[0], np.cumsum(length[order])])
        ids, _ = gather(np.concatenate(found), at, entry[[parts[p] for pieces in cut for p in pieces]])
        word = np.repeat(np.arange(len(words)), [len(pieces) for pieces in cut])
        each = length[[parts[p] for pieces in cut for p in pieces]]
        return ids, np.bincount(word, weights=each, minlength=len(words)).astype(np.int64)

    def _entries(self, hashes: np.ndarray, word) -> np.ndarray:
        """Entries in the newer cache of sorted distinct hashes; ``word(k)`` is the k-th word's bytes."""
        new, old = self.kept["new"], self.kept["old"]
        entries = new.find(hashes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            before = old.find(hashes[missing])
            again = before >= 0
            if again.any():
                new.add(hashes[missing[again]], *gather(old.ids, old.at, before[again]))
            unknown = missing[~again]
            if len(unknown):
                new.add(hashes[unknown], *self._encoded([word(k) for k in unknown.tolist()]))
            entries[missing] = new.find(hashes[missing])
        return entries

    def encode(self, column):
        """Yields (first row, last row + 1, all ids, each text's end among them) for pieces of the column."""
        for a, b, buf, off in slices(column, 4 << 20):
            if self.kept["new"].n > CACHE_WORDS:
                self.kept["old"], self.kept["new"] = self.kept["new"], Words()
            start, end, row, h = self.hasher.located_words(buf, off)
            lower = self.hasher.lower[buf]
            distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
            if len(distinct):
                entries = self._entries(distinct, lambda k: lower[start[first[k]] : end[first[k]]].tobytes())
                new = self.kept["new"]
                ids, length = gather(new.ids, new.at, entries[back])
            else:
                ids, length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
            ends = np.cumsum(np.bincount(row, weights=length, minlength=b - a).astype(np.int64))
            raw = buf.tobytes()
            if b"<|" in raw:
                parts = np.split(ids, ends[:-1])
                for r in range(b - a):
                    if b"<|" in (t := raw[off[r] : off[r + 1]]):
                        parts[r] = self._whole(t.decode())
                ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
            yield a, b, ids, ends
