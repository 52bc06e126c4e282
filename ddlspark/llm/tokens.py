"""Token ids of whole texts by public tokenizers, each distinct word encoded once per worker.

Both tokenizers first divide a text by a pattern and then encode each part by itself.  In a text of Latin-1
characters without apostrophes, runs of white space or special tokens, runs of letters (with a leading space, for
the byte-level one) are such parts, so it is cut around them, and each distinct part goes to the tokenizers library
once.  Any other text is encoded whole.  Texts are cut some MB at a time by array operations over their bytes; a memo is asked
only for the distinct parts of these.  A memo is one array: each part has one row that it may be in, found by a hash of its bytes and
compared with all of them, and a new part takes the row of an older one, so memory is bounded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

#: Bits of the number of a memo's rows, and the bytes and ids of a part that a row has room for; others are encoded each time.  A row: the bytes, their number and that of the ids, the ids.
ROW_BITS, PART_BYTES, PART_IDS = 20, 24, 9
COUNTS = PART_BYTES // 4
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Characters of texts that array operations cut at once.
PASS_CHARS = 4_000_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What makes a text be encoded whole, besides characters beyond Latin-1.
ODD = ("'", "ª", "µ", "º", "<|", "  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_memos: dict[tuple[type, str], "Ids"] = {}


def unusual(text: str) -> bool:
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return True
    return any(x in text for x in ODD)


class Ids:
    """Ids of texts as little-endian uint32 bytes.  ``WORD`` is a part that the model takes, in its group, without the tokenizer's first steps."""

    WORD: re.Pattern

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {i: mapped.pre_tokenize_str(chr(i))[0][0] for i in range(256)}
        self.memo = np.zeros((1 << ROW_BITS, COUNTS + 1 + PART_IDS), np.uint32)

    def part(self, part: str) -> list[int]:
        word = self.WORD.fullmatch(part)
        return [t.id for t in self.model.tokenize(self.mapped(word[1]))] if word else self.tokenizer.encode(part, add_special_tokens=False).ids

    def mapped(self, word: str) -> str:
        """The bytes of ``word``, letters with at most a space, as the model's characters; ASCII letters stand for themselves."""
        return word.replace(" ", self.bytes[32]) if word.isascii() else word.translate(self.bytes)

    def known(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct ``parts``: an array of ids, and where those of each part begin in it and how many they are."""
        ends = np.frombuffer(parts.buffers()[1], np.int32, len(parts) + 1, 4 * parts.offset).astype(np.int64)
        length = np.diff(ends)
        data = np.concatenate([np.frombuffer(parts.buffers()[2], np.uint8, ends[-1]), np.zeros(PART_BYTES, np.uint8)])
        key = np.lib.stride_tricks.sliding_window_view(data, PART_BYTES)[ends[:-1]]
        key[np.arange(PART_BYTES) >= length[:, None]] = 0
        words = key.view(np.uint64)
        mixed = (words * MIX).sum(axis=1)
        slot = ((mixed ^ (mixed >> np.uint64(29))) * MIX[0] >> np.uint64(64 - ROW_BITS)).astype(np.int64)
        rows = self.memo[slot]
        same = (rows[:, :COUNTS] == key.view(np.uint32)).all(axis=1) & (rows[:, COUNTS] >> 8 == length)
        new = np.flatnonzero(~same)
        made, upto = array("I"), array("q", [0])
        for p in parts.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist():
            made.extend(self.part(p))
            upto.append(len(made))
        flat, n = np.array(made, np.uint32), np.diff(np.array(upto))
        size = (rows[:, COUNTS] & 255).astype(np.int64)
        size[new] = n
        # the ids of rows, then those made now
        held = np.arange(PART_IDS) < np.where(same, size, 0)[:, None]
        begin = np.cumsum(np.where(same, size, 0)) - size
        begin[new] = np.count_nonzero(held) + np.cumsum(n) - n
        out = np.concatenate([rows[:, COUNTS + 1 :][held], flat])
        fits = new[(n <= PART_IDS) & (length[new] <= PART_BYTES)]
        row = np.zeros((len(fits), self.memo.shape[1]), np.uint32)
        row[:, :COUNTS] = key.view(np.uint32)[fits]
        row[:, COUNTS] = length[fits] << 8 | size[fits]
        own = np.arange(PART_IDS) < size[fits][:, None]
        row[:, COUNTS + 1 :][own] = out[np.repeat(begin[fits], size[fits]) + np.nonzero(own)[1]]
        self.memo[slot[fits]] = row
        return out, begin, size

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def prepared(self, text: str) -> str:
        return text

    def starts(self, letter: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a part starts at each byte of ``data``; texts start at ``first``, and ``letter`` marks bytes of letters."""
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        return next(self.encoded([text]))

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each of ``texts``, in order; texts of about ``PASS_CHARS`` characters (a longer one alone) are worked on at once."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > PASS_CHARS:
                yield from self.passed(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        if held:
            yield from self.passed(held)

    def passed(self, texts: list[str]) -> Iterator[bytes]:
        # mostly no text is; what two texts make together is only looked at more closely
        odd = [unusual(t) for t in texts] if unusual("".join(texts)) else [False] * len(texts)
        # a text that is encoded whole is an empty one here
        raw = [b"" if o else self.prepared(t).encode() for t, o in zip(texts, odd, strict=True)]
        begin = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, at = self.joined(data, begin)
        for text, whole, a, b in zip(texts, odd, at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield self.whole(text) if whole else ids[a:b].tobytes()

    def joined(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each begin (and the last one's end)."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(begin), np.int64)
        first = np.zeros(len(data), bool)
        first[begin[:-1][begin[:-1] < len(data)]] = True
        part = np.flatnonzero(self.starts(letters(data), data, first))
        ends = np.append(part, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        flat, first_id, size = self.known(coded.dictionary)
        index = coded.indices.to_numpy()
        n = size[index]
        to = np.cumsum(n)
        shift = np.repeat(first_id[index] - (to - n), n)
        return flat[shift + np.arange(len(shift))], np.append(0, to)[np.searchsorted(part, begin)]


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of Latin-1 characters in UTF-8 are those of LETTERS."""
    lower = data | 0x20
    out = (lower >= ord("a")) & (lower <= ord("z")) & (data < 0x80)
    second = np.flatnonzero(data[:-1] == 0xC3) + 1  # of two bytes, from À to ÿ
    second = second[(data[second] != 0x97) & (data[second] != 0xB7)]  # but the signs of multiplication and division
    out[second] = out[second - 1] = True
    return out


class ByteLevelIds(Ids):
    """For a byte-level BPE whose parts take one leading space."""

    WORD = re.compile(rf"( ?[{LETTERS}]+)")

    def starts(self, letter: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        leads = data == ord(" ")  # spaces before a letter of the same text
        leads[:-1] &= letter[1:] & ~first[1:]
        leads[-1:] = False
        word = letter | leads
        return first | leads | np.append(False, word[1:] != word[:-1])


class WordIds(Ids):
    """For a lower-casing BPE that drops white space."""

    WORD = re.compile(rf" ?([{LETTERS}]+)")

    def prepared(self, text: str) -> str:
        return text.lower()

    def starts(self, letter: np.ndarray, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        # of white space only spaces and line ends are here, each by itself; a space goes with what follows it
        space = data == ord(" ")
        kind = letter + np.uint8(2) * (data == ord("\n"))
        return first | space | np.append(False, (kind[1:] != kind[:-1]) & ~space[:-1])


def ids_of(kind: type[Ids], path: str) -> Ids:
    """The worker's memo of that tokenizer, made once."""
    if (kind, path) not in _memos:
        _memos[kind, path] = kind(path)
    return _memos[kind, path]
