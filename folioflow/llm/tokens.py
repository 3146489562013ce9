"""Token ids and counts of whole texts, through per-worker caches of pre-tokens.

Byte-pair merges never cross the borders of a pre-token, so a text's ids are the ids of its pre-tokens
in order.  A batch is cut into pre-tokens with numpy; those seen before come out of an open-addressing
table, which compares all their bytes, the rest go to the tokenizer library itself.  A document with any
character for which the cut is not certain (outside ASCII and the Latin letters of U+00C0-U+00FF, control
characters, apostrophes, ``<|``), or with a pre-token of over 256 bytes, is encoded whole by the library instead.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from . import textkernel as tk

U64 = np.uint64
#: Pre-tokens a worker holds; beyond this the cache starts anew.
CACHE_LIMIT = 800_000


class HashTable:
    """64-bit keys to dense slots, by linear probing, all rows of a batch at once."""

    def __init__(self, bits: int = 18):
        self.clear(bits)

    def clear(self, bits: int = 18) -> None:
        self.mask, self.n = (1 << bits) - 1, 0
        self.keys = np.zeros(1 << bits, U64)
        self.slots = np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where absent."""
        out = np.full(len(h), -1, np.int32)
        left, at = np.arange(len(h)), (h & U64(self.mask)).astype(np.int64)
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.slots[at[hit]]
            go = ~hit & (k != 0)
            left, at = left[go], (at[go] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """New distinct keys get the next slots in order."""
        while (self.n + len(h)) * 2 > self.mask:
            keys, slots = self.keys, self.slots
            full = keys != 0
            self.mask = self.mask * 2 + 1
            self.keys, self.slots = np.zeros(self.mask + 1, U64), np.zeros(self.mask + 1, np.int32)
            self._put(keys[full], slots[full])
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, slots: np.ndarray) -> None:
        at = (h & U64(self.mask)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            cand = np.flatnonzero(free)
            _, pick = np.unique(at[cand], return_index=True)
            pick = cand[pick]
            self.keys[at[pick]], self.slots[at[pick]] = h[pick], slots[pick]
            go = np.ones(len(h), bool)
            go[pick] = False
            h, slots, at = h[go], slots[go], (at[go] + 1) & self.mask


class Pieces:
    """What identifies pre-tokens: for those of at most 16 bytes, two numbers and the length hold every byte."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, head: np.ndarray):
        w, n = tk.eights(buf), ends - starts
        self.buf, self.starts, self.ends, self.head = buf, starts, ends, head
        self.lead, self.tail, self.size = tk.lead(w, starts, n), tk.tail(w, ends, n), (2 * n + head).astype(np.int32)
        h = tk.span_hashes(buf, starts, ends)
        self.h = np.where(head, h ^ U64(0xA5A5A5A5A5A5A5A5), h)
        self.h[self.h == 0] = 1

    def take(self, at: np.ndarray) -> Pieces:
        out = object.__new__(Pieces)
        out.buf = self.buf
        for k in ("starts", "ends", "head", "lead", "tail", "size", "h"):
            setattr(out, k, getattr(self, k)[at])
        return out


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or one at least twice as long with its content, so that ``n`` entries fit."""
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)))


#: Frequent pre-tokens, all of at most 16 bytes, with their number of ids; 29 bytes each.
FREQUENT = np.dtype([("h", "<u8"), ("lead", "<u8"), ("tail", "<u8"), ("size", "u1"), ("len", "<i4")])


class Encoder:
    """Ids (or only their number) of every text of a batch.

    split: pre-token borders; misses: strings, and whether each begins a document, to lists of ids;
    whole: a text's ids by the library alone.  frequent: pre-tokens and lengths known from the start, for counting.

    A cached answer is used only where the bytes are those it was learnt for: a hash finds the place, then all
    bytes are compared.  Texts for which that fails, or with a pre-token of over 256 bytes, go to ``whole``.
    """

    def __init__(self, split: Callable, misses: Callable, whole: Callable, counts_only: bool = False, frequent: np.ndarray | None = None, mark_first: bool = False):
        self.split, self.misses, self.whole, self.counts_only, self.mark_first = split, misses, whole, counts_only, mark_first
        self.frequent, self.fixed = HashTable(), np.zeros(0, FREQUENT)
        if frequent is not None and len(frequent):
            self.frequent.add(frequent["h"])
            self.fixed = frequent
        self.reset()

    def reset(self) -> None:
        self.table, n = HashTable(), 1 << 16
        self.starts, self.lens = np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.vals, self.used = np.zeros(1 << 18, np.uint32), 0
        self.lead, self.tail, self.size = np.zeros(n, U64), np.zeros(n, U64), np.zeros(n, np.int32)
        self.text, self.text_at, self.text_used = np.zeros(1 << 16, np.uint8), np.zeros(n, np.int64), 0

    def _learn(self, new: Pieces, ids: list) -> None:
        n, k = self.table.n, len(new.h)
        for name in ("starts", "lens", "lead", "tail", "size", "text_at"):
            setattr(self, name, grown(getattr(self, name), n + k))
        lens = np.fromiter(ids if self.counts_only else map(len, ids), np.int32, k)
        self.lens[n : n + k] = lens
        if not self.counts_only:
            flat = np.fromiter((x for one in ids for x in one), np.uint32, int(lens.sum()))
            self.vals = grown(self.vals, self.used + len(flat))
            self.starts[n : n + k] = self.used + np.cumsum(lens) - lens
            self.vals[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
        self.lead[n : n + k], self.tail[n : n + k], self.size[n : n + k] = new.lead, new.tail, new.size
        # Only what lead and tail do not hold is kept as text.
        for i in np.flatnonzero(new.size >= 34):
            one = new.buf[new.starts[i] : new.ends[i]]
            self.text = grown(self.text, self.text_used + len(one))
            self.text[self.text_used : self.text_used + len(one)] = one
            self.text_at[n + i] = self.text_used
            self.text_used += len(one)
        self.table.add(new.h)

    def _slots(self, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each pre-token, learnt where missing, and whether the slot holds these very bytes."""
        if self.table.n > CACHE_LIMIT:
            self.reset()
        slot = self.table.find(p.h)
        gone = np.flatnonzero(slot < 0)
        if len(gone):
            h, at = np.unique(p.h[gone], return_index=True)
            new = p.take(gone[at])
            data = p.buf.tobytes()
            strings = [data[a:b].decode() for a, b in zip(new.starts.tolist(), new.ends.tolist(), strict=True)]
            base = self.table.n
            self._learn(new, self.misses(strings, new.head))
            slot[gone] = base + np.searchsorted(h, p.h[gone]).astype(np.int32)
        right = (self.lead[slot] == p.lead) & (self.tail[slot] == p.tail) & (self.size[slot] == p.size)
        long = np.flatnonzero(right & (p.size >= 34))
        right[long] = tk.same_bytes(self.text, self.text_at[slot[long]], p.buf, p.starts[long], p.ends[long] - p.starts[long])
        return slot, right

    def _cut(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Pieces]:
        """Texts that only the library may read, the index of each text's first pre-token, and the others' pre-tokens."""
        c = tk.byte_classes(buf)
        starts, ends = self.split(buf, c, offs)
        odd = tk.doc_any(c == 4, offs)
        long = np.flatnonzero(ends - starts > tk.LONG_SPAN)
        odd[np.searchsorted(offs, starts[long], "right") - 1] = True
        first = np.searchsorted(starts, offs)
        if odd.any():
            keep = ~np.repeat(odd, np.diff(first))
            starts, ends = starts[keep], ends[keep]
            first = np.searchsorted(starts, offs)
        head = tk.doc_starts(len(buf), offs)[starts] if self.mark_first else np.zeros(len(starts), bool)
        return odd, first, Pieces(buf, starts, ends, head)

    def _whole(self, buf: np.ndarray, offs: np.ndarray, i: int):
        return self.whole(buf[offs[i] : offs[i + 1]].tobytes().decode())

    def ids(self, buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if len(buf) == 0:
            return [np.zeros(0, np.uint32)] * (len(offs) - 1)
        odd, first, p = self._cut(buf, offs)
        slot, right = self._slots(p)
        odd[np.searchsorted(first, np.flatnonzero(~right), "right") - 1] = True
        lens = self.lens[slot]
        edge = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        flat = self.vals[np.arange(edge[-1]) + np.repeat(self.starts[slot] - edge[:-1], lens)]
        at = edge[first]
        return [np.asarray(self._whole(buf, offs, i), np.uint32) if odd[i] else flat[at[i] : at[i + 1]] for i in range(len(offs) - 1)]

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of ids of each text: frequent pre-tokens by the shared table, the others by the worker's cache."""
        if len(buf) == 0:
            return np.zeros(len(offs) - 1, np.int64)
        odd, first, p = self._cut(buf, offs)
        known = self.frequent.find(p.h)
        hit = np.flatnonzero(known >= 0)
        f = self.fixed[known[hit]]
        hit = hit[(f["lead"] == p.lead[hit]) & (f["tail"] == p.tail[hit]) & (f["size"] == p.size[hit])]
        lens, miss = np.zeros(len(p.h), np.int64), np.ones(len(p.h), bool)
        lens[hit], miss[hit] = self.fixed["len"][known[hit]], False
        miss = np.flatnonzero(miss)
        if len(miss):
            slot, right = self._slots(p.take(miss))
            lens[miss] = self.lens[slot]
            odd[np.searchsorted(first, miss[~right], "right") - 1] = True
        edge = np.concatenate(([0], np.cumsum(lens)))
        out = edge[first[1:]] - edge[first[:-1]]
        for i in np.flatnonzero(odd):
            out[i] = len(self._whole(buf, offs, i))
        return out


_made: dict[tuple, Encoder] = {}


def forget(but: str | None = None) -> None:
    """Drops this worker's encoders, but for those over the file ``but``; called when a worker turns to other work."""
    for key in [k for k in _made if k[0] != but]:
        del _made[key]


def largest_id(path: str) -> int:
    """The largest id that a ``tokenizers`` file can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


def bpe_encoder(path: str, split: str) -> Encoder:
    """Encoder over a ``tokenizers`` file, one for each worker. split: "spaced" (byte-level pattern, white space kept) or "dropped"."""
    if (path, split) not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)

        def misses(strings, head):
            return [e.ids for e in t.encode_batch_fast(strings, add_special_tokens=False)]

        def whole(text):
            return t.encode(text, add_special_tokens=False).ids

        _made[path, split] = Encoder({"spaced": tk.split_spaced, "dropped": tk.split_dropped}[split], misses, whole)
    return _made[path, split]


def piece_counter(path: str, frequent: np.ndarray | None = None) -> Encoder:
    """Counting encoder over a ``sentencepiece`` file whose pieces hold no inner word mark and no line feed."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def misses(strings, head):
        # A later pre-token opens with a blank, which the library adds itself, or with a line feed, before which it adds a piece of its own.
        asked = [s if h or s[0] == "\n" else s[1:] for s, h in zip(strings, head.tolist(), strict=True)]
        less = [0 if h or s[0] != "\n" else 1 for s, h in zip(strings, head.tolist(), strict=True)]
        # A lone blank leaves nothing to ask for, but is one piece.
        return [len(x) - k if a else 1 for a, x, k in zip(asked, sp.encode(asked, num_threads=1), less, strict=True)]

    return Encoder(tk.split_pieces, misses, sp.encode, counts_only=True, frequent=frequent, mark_first=True)
