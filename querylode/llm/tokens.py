"""Token ids of whole texts by a tokenizers vocabulary, with the encodings of repeated units kept.

Neither kind of vocabulary here has a token that reaches across the blanks between words, so a text's ids are those of its
units one after the other, and each distinct unit is encoded once. A unit is a word for a vocabulary that drops
blanks, and a word with the blanks before it for a byte-level one. Units are found, hashed and looked up for many texts at once, and a text's ids are gathered from
what is kept. Texts with other blanks than the six of ASCII are encoded as a whole. The vocabulary's path is a parameter; special tokens in a text are ordinary text.

What is kept is a table of fixed size: a unit's place is given by its 64-bit hash, and the last unit of a place stays. Two units of one place share a hash, and so are
taken for each other, with a chance of 2**-43.
"""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer

from querylode.llm.shingles import BLANK, word_hashes, word_spans

_OTHER_BLANKS = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8d\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
#: Without these bytes in it a text has no such blank, and they are quicker to look for.
_HINTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_SEPARATORS = b"\x1c\x1d\x1e\x1f"
_PLAIN = re.compile(rb" ?[^ \t\n\x0b\x0c\r\x01]+\Z")
#: Bytes of text that are taken at once, and units that the tokenizer is given at once.
SLICE, JOINED = 1 << 18, 200


class Encoder:
    """Encodes batches of texts; ids come as little-endian bytes of the width that the vocabulary needs. slots: units that are kept, a power of two; bound: their ids."""

    def __init__(self, path: str, slots: int = 1 << 21, bound: int = 1 << 24):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.mask, self.bound = np.uint64(slots - 1), bound
        self.keys, self.starts, self.lens = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0
        # a vocabulary that drops blanks gives none for them
        self.drops_blanks = not self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.fence = " \x01 " if self.drops_blanks else "\n"
        self.fence_ids = self.tokenizer.encode(self.fence, add_special_tokens=False).ids
        self.lowers = self.drops_blanks and self.tokenizer.encode("Aa", add_special_tokens=False).ids == self.tokenizer.encode("aa", add_special_tokens=False).ids

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)

    def learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units, where each unit's begin, and how many they are."""
        lens = np.zeros(len(units), np.int32)
        plain = [i for i, u in enumerate(units) if _PLAIN.match(u)] if len(self.fence_ids) == 1 else []
        parts = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        fence = self.fence.encode()
        joined = [(fence + fence.join([units[i] for i in part])).decode("utf-8", "replace") for part in parts]
        flat: list[np.ndarray] = []
        order: list[int] = []
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            cuts = np.flatnonzero(ids == self.fence_ids[0])
            if len(cuts) == len(part):  # else a unit's own ids hold the fence's
                flat.append(np.delete(ids, cuts))
                lens[part] = np.diff(np.append(cuts, len(ids))) - 1
                order += part
        for i in sorted({*range(len(units))}.difference(order)):
            flat.append(self.whole(units[i]))
            lens[i] = len(flat[-1])
            order.append(i)
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(lens[order], dtype=np.int64) - lens[order]
        return np.concatenate(flat), starts, lens

    def units(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every unit, and the index of each row's first."""
        starts, ends, rows = word_spans(raw, offsets)
        if self.drops_blanks:
            return starts, ends, rows
        trailing = offsets[1:][(offsets[1:] > offsets[:-1]) & BLANK[raw[np.maximum(offsets[1:], 1) - 1]]]
        ends = np.sort(np.concatenate([ends, trailing]))
        row = np.searchsorted(offsets, ends - 1, "right") - 1
        starts = np.maximum(np.concatenate([[0], ends[:-1]])[: len(ends)], offsets[row])
        return starts, ends, np.searchsorted(row, np.arange(len(offsets)))

    def _keep(self, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(ids)), self.dtype)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return (self.used - len(ids) + starts).astype(np.int32), lens

    def places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of every unit begin and how many they are, and the index of each text's first unit."""
        if self.used > self.bound:  # begin anew
            self.keys[:] = 0
            self.used = 0
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        if not len(raw):
            none = np.zeros(0, np.int32)
            return none, none, np.zeros(len(offsets), np.int64)
        starts, ends, rows = self.units(raw, offsets)
        found = np.maximum(word_hashes(raw, starts, ends, self.lowers), np.uint64(1))
        slot = (found & self.mask).astype(np.int64)
        at, lens = self.starts[slot], self.lens[slot]
        if len(lacking := np.flatnonzero(self.keys[slot] != found)):
            new, first, where = np.unique(found[lacking], return_index=True, return_inverse=True)
            data = raw.tobytes()
            spans = lacking[first]
            new_at, new_lens = self._keep(*self.learn([data[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)]))
            at[lacking], lens[lacking] = new_at[where], new_lens[where]
            self.keys[slot[spans]], self.starts[slot[spans]], self.lens[slot[spans]] = new, new_at, new_lens
        return at, lens, rows

    def _slices(self, texts: list[bytes]):
        """Parts of the texts with the texts to be encoded whole (by index) taken out."""
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= SLICE):
                size += len(texts[upto])
                upto += 1
            part = texts[at:upto]
            odd = {}
            if not self.drops_blanks:
                odd = {i: self.whole(t) for i, t in enumerate(part) if (any(x in t for x in _HINTS) or len(t.translate(None, _SEPARATORS)) < len(t)) and _OTHER_BLANKS.search(t)}
                part = [b"" if i in odd else t for i, t in enumerate(part)]
            yield part, odd
            at = upto

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for part, odd in self._slices(texts):
            at, lens, rows = self.places(part)
            ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
            ids = self.ids[np.repeat(at - ends[:-1], lens) + np.arange(ends[-1])].tobytes() if len(lens) else b""
            edges = (ends[rows] * self.dtype.itemsize).tolist()
            out += [odd[i].tobytes() if i in odd else ids[a:b] for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        return out

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """How many ids each text has."""
        out = [np.zeros(0, np.int64)]
        for part, odd in self._slices(texts):
            _, lens, rows = self.places(part)
            n = np.diff(np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])[rows])
            for i, ids in odd.items():
                n[i] = len(ids)
            out.append(n)
        return np.concatenate(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process, so what it has learnt serves the next task too."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
