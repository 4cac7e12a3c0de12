"""Exact byte-level BPE encoding of whole texts, with a table of words.

A pre-token of the byte-level pattern never spans a single space or newline that
stands between two other characters, and a space opens the pre-token that
follows it. So a text whose white space is single spaces and single newlines
between words is the concatenation of its words' ids, and a word's ids can be
looked up. Words are found, looked up and joined as arrays; the table compares
whole words, not hashes, and only words that it lacks go through the library.
Any other text (runs of white space, tabs, the added token's string) goes
through the tokenizer whole, so ids always equal the library's.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

#: Words of the table (48 bytes each): bounds a worker's memory.
SLOTS = 1 << 20
#: Bytes of the longest word and ids of the longest entry that the table holds.
WIDE, DEEP = 16, 11
#: A row of the table as 64-bit numbers: a word's first and last eight bytes; its length with the byte before it (0: free); ids, of which there are as many as the last 16 bits say.
ROW = 3 + (DEEP + 1) // 4
#: Words looked up at once, and characters of texts joined at once.
WORDS, CHARACTERS = 1 << 17, 1 << 20
#: Words that one call of the tokenizer encodes, joined by newlines.
JOINED = 64
#: String of the vocabulary's added token, which the library matches anywhere.
ADDED = "<|endoftext|>"
NEWLINE_ID = 198
#: The byte-level alphabet: bytes without a printable Latin-1 character follow U+0100 in order.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _KEPT)}
SPACE = chr(BYTE_LEVEL[32])
#: Punctuation that joins no contraction.
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Up to here letters are the same in every version of Unicode that a library may use.
LAST_LATIN = "\u024f"
END_ID = 0

_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(WIDE + 1)], np.uint64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(WIDE + 1)], np.uint64)
_STOP = np.array([chr(b) in STOPS for b in range(256)])
_PLAIN = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: Second bytes of the letters U+00C0 to U+00FF, whose first is 0xC3.
_ACCENTED = np.array([128 <= b < 192 and b not in (0x97, 0xB7) for b in range(256)])


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 65536:
            raise ValueError("ids do not fit 16 bits")
        self.table = np.zeros((SLOTS, ROW), np.uint64)
        self.stop_ids = np.array([self.tokenizer.token_to_id(chr(b)) if _STOP[b] else 0 for b in range(256)], np.uint16)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and where each text's end; null counts as empty."""
        parts, sizes, some, held = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [], 0
        for text in texts:
            some.append(text or "")
            held += len(some[-1])
            if held >= CHARACTERS:
                for out, part in zip((parts, sizes), self._joined(some)):
                    out.append(part)
                some, held = [], 0
        for out, part in zip((parts, sizes), self._joined(some)):
            out.append(part)
        return np.concatenate(parts), np.cumsum(np.concatenate(sizes))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Bytes of the ids of each text."""
        ids, ends = self.encode(texts)
        raw, stops = ids.astype("<u2").tobytes(), (2 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        # A carriage return opens each text, so one that holds another can't be cut into words here.
        odd = {i for i, t in enumerate(texts) if "\r" in t}
        data = ("\r" + "\r".join("" if i in odd else t for i, t in enumerate(texts)) + "\r").encode() + bytes(WIDE)
        bytes_ = np.frombuffer(data, np.uint8)
        breaks = np.flatnonzero(bytes_[:-WIDE] <= 32)
        first = np.flatnonzero(bytes_[breaks[:-1]] == 13)  # each text's first word
        ids, sizes, bad = [], [], []
        for lo in range(0, len(breaks) - 1, WORDS):
            part, size, unfit = self._words(data, bytes_, breaks[lo : lo + WORDS + 1])
            ids.append(part)
            sizes.append(size)
            bad += (unfit + lo).tolist()
        ids = ids[0] if len(ids) == 1 else np.concatenate(ids)
        ends = np.r_[0, np.cumsum(np.concatenate(sizes))]
        ends = ends[np.r_[first, len(breaks) - 1]]
        odd.update((np.searchsorted(first, bad, "right") - 1).tolist())
        if odd:
            each = [np.frombuffer(self.whole(texts[i]), "<u2") if i in odd else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(ends)

    def _words(self, data: bytes, bytes_: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words between the breaks, the number of each word's ids, and words that their text must not be cut at."""
        before, starts = bytes_[breaks[:-1]], breaks[:-1] + 1
        length = breaks[1:] - starts
        # One stop behind a letter or digit is a pre-token of its own: the word is looked up without it.
        last, second, third = (bytes_[breaks[1:] - k] for k in (1, 2, 3))
        tail = _STOP[last] & (length > 1) & (_PLAIN[second] | ((length > 2) & (third == 0xC3) & _ACCENTED[second]))
        length -= tail
        eights = np.ndarray(len(bytes_) - 7, "<u8", bytes_, strides=(1,))
        narrow = np.minimum(length, WIDE)
        low = eights[starts] & _LOW[narrow]
        high = eights[np.minimum(starts + 8, len(eights) - 1)] & _HIGH[narrow]
        kind = (length.astype(np.uint64) << np.uint64(8)) | before.astype(np.uint64)
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ (kind << np.uint64(40))) * np.uint64(0xD1342543DE82EF95)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        slots = ((mixed >> np.uint64(44)) % np.uint64(SLOTS)).astype(np.int64), ((mixed >> np.uint64(20)) % np.uint64(SLOTS)).astype(np.int64)
        rows = self.table[slots[0]]
        found = (rows[:, 0] == low) & (rows[:, 1] == high) & (rows[:, 2] == kind)
        again = np.flatnonzero(~found)
        other = self.table[slots[1][again]]
        hit = (other[:, 0] == low[again]) & (other[:, 1] == high[again]) & (other[:, 2] == kind[again])
        rows[again[hit]] = other[hit]
        found[again[hit]] = True
        ids = rows.view(np.uint16)[:, -DEEP - 1 :]
        none = length == 0
        unfit = none & ((before != 13) | (bytes_[breaks[1:]] != 13))  # else an empty text
        unfit |= (before != 13) & (before != 10) & (before != 32)
        lacking = np.flatnonzero(~found & ~none)
        size = np.where(none | ~found, 0, ids[:, DEEP]).astype(np.int64)
        stops = np.where(tail, self.stop_ids[last], 0)
        ids[np.arange(len(ids)), size] = stops
        size += tail
        if not len(lacking):
            return ids[np.arange(DEEP + 1) < size[:, None]], size, np.flatnonzero(unfit)
        keys = [data[a - 1 : a + n] for a, n in zip(starts[lacking].tolist(), length[lacking].tolist())]
        at = dict(zip(keys, lacking.tolist()))
        learnt = self._learn(at)
        ends = np.where(tail[lacking], stops[lacking], 0).astype("<u2").tobytes()
        coded = [(learnt[k] or b"") + (ends[2 * i : 2 * i + 2] if t else b"") for i, (k, t) in enumerate(zip(keys, tail[lacking].tolist()))]
        unfit[lacking[[learnt[k] is None for k in keys]]] = True
        size[lacking] = [len(x) // 2 for x in coded]
        mask = np.arange(DEEP + 1) < size[:, None]
        mask[lacking] = False
        known = np.ones(len(size), bool)
        known[lacking] = False
        held = np.repeat(known, size)
        out = np.empty(len(held), np.uint16)
        out[held] = ids[mask]
        out[~held] = np.frombuffer(b"".join(coded), "<u2")
        self._keep(np.array([i for k, i in at.items() if learnt[k] is not None], np.int64), [x for x in learnt.values() if x is not None], np.stack([low, high, kind], 1), slots, length)
        return out, size, np.flatnonzero(unfit)

    def _keep(self, at: np.ndarray, coded: list[bytes], words: np.ndarray, slots: tuple[np.ndarray, np.ndarray], length: np.ndarray) -> None:
        """Put words into the table, at a free one of their two slots or in place of the word at the first."""
        sizes = np.array([len(x) // 2 for x in coded], np.int64)
        fits = (length[at] <= WIDE) & (sizes <= DEEP)
        at, sizes = at[fits], sizes[fits]
        coded = [x for x, f in zip(coded, fits.tolist()) if f]
        first, second = slots[0][at], slots[1][at]
        slot = np.where((self.table[first, 2] == 0) | (self.table[second, 2] != 0), first, second)
        slot, one = np.unique(slot, return_index=True)
        at, sizes = at[one], sizes[one]
        rows = np.zeros((len(at), ROW), np.uint64)
        rows[:, :3] = words[at]
        ids = rows.view(np.uint16)[:, -DEEP - 1 :]
        ids[np.arange(DEEP + 1) < sizes[:, None]] = np.frombuffer(b"".join(coded[i] for i in one.tolist()), "<u2")
        ids[:, DEEP] = sizes
        self.table[slot] = rows

    def _learn(self, keys: dict[bytes, int]) -> dict[bytes, bytes | None]:
        """Ids of words, each with the byte before it: a carriage return (the text's start), a newline or a space. None where a text must not be cut."""
        out: dict[bytes, bytes | None] = dict.fromkeys(keys)
        led: dict[bytes, list[tuple[bytes, str]]] = {b" ": [], b"\n": [], b"\r": []}
        model = self.tokenizer.model.tokenize
        newline = np.array([NEWLINE_ID], "<u2").tobytes()
        opening = {b" ": SPACE, b"\n": "", b"\r": ""}
        for key in keys:
            lead = key[:1]
            if lead not in led:
                continue
            if key[1:].isalpha():  # ASCII letters are one pre-token
                raw = key[1:].decode()
            else:
                body = key[1:].decode()
                if body.isalpha() and max(body) <= LAST_LATIN:  # and so are these
                    raw = key[1:].decode("latin-1").translate(BYTE_LEVEL)
                else:
                    if body.split() == [body] and ADDED not in body:
                        led[lead].append((key, body))
                    continue
            ids = array("H", [t.id for t in model(opening[lead] + raw)]).tobytes()
            out[key] = newline + ids if lead == b"\n" else ids
        for lead, words in led.items():
            space, before = (" " if lead == b" " else ""), (newline if lead == b"\n" else b"")
            parts = [words[lo : lo + JOINED] for lo in range(0, len(words), JOINED)]
            joined = ["\n".join(space + w for _, w in part) for part in parts]
            for part, coded in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(coded.ids, "<u2")
                cuts = np.flatnonzero(ids == NEWLINE_ID)
                if len(cuts) != len(part) - 1:
                    out.update((key, before + self.whole(space + w)) for key, w in part)
                    continue
                raw, at = ids.tobytes(), 0
                for (key, _), cut in zip(part, (2 * cuts).tolist() + [len(raw)]):
                    out[key] = before + raw[at:cut]
                    at = cut + 2
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
