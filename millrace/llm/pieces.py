"""Pre-tokens of the public byte-pair vocabularies, and their ids through the `tokenizers` library.

Both vocabularies merge inside pre-tokens only, so the ids of a text are those of its pre-tokens in a row. Texts
repeat their words, so each distinct pre-token goes to the library's model once per Python worker, while it is remembered.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The pre-token patterns of the two public vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place where a very long text can be cut without changing its pre-tokens.
CUT = regex.compile(r"(?<=[^\s])(?= [^\s])")
SLICE = 1 << 20
TAIL = ".,;:!?#*$%&|"
CACHE = 100_000
#: Letters that NFC leaves as they are in any order and that Arrow lower-cases as Python does, and words of them that an encoder
#: remembers, of less than WORD_BYTES each.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſΑ-ΡΤ-Ωα-ωЀ-ҁ一-龥"
WORDS, WORD_BYTES = 200_000, 64
#: Where white space stands on both sides of a space (or the text ends after it).
MIXED_BLANKS = r"[\s\v\x1c-\x1f\x{85}\p{Z}] ([\s\v\x1c-\x1f\x{85}\p{Z}]|$)"


def byte_symbols() -> dict[int, str]:
    """Byte to printable symbol: printable Latin-1 stands for itself, the others take code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


SYMBOLS = str.maketrans(byte_symbols())


def symbols(piece: str) -> str:
    if piece.isalpha() and piece.isascii():
        return piece
    return piece.encode("utf-8", "replace").decode("latin-1").translate(SYMBOLS)


class Vocabulary:
    """A public vocabulary file: how it cuts text into pre-tokens, its special strings and its library model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.path = path
        self.lowers = self.spec["normalizer"] is not None
        self.pattern = regex.compile(WORD_PATTERN if self.lowers else BYTE_PATTERN)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.suffix = self.spec["model"]["end_of_word_suffix"] or ""
        self.size = max([*self.spec["model"]["vocab"].values(), *self.special.values()]) + 1

    def segments(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """(False, pre-tokens) of slices of the text, (True, [string]) for each special string in it."""
        for part in self.special_pattern.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield True, [part]
                continue
            for piece in self._cut(part):
                if self.lowers:
                    piece = unicodedata.normalize("NFC", piece) if not piece.isascii() else piece
                    piece = piece.replace("Σ", "σ").lower()
                yield False, self.pattern.findall(piece)

    def _cut(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE and (m := CUT.search(text, start + SLICE)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def plain_letters(word: str) -> bool:
    """Whether normalising and lower-casing leave one run of letters."""
    return unicodedata.is_normalized("NFC", word) and word.replace("Σ", "σ").lower().isalpha()


class Cache(dict):
    """A dict that fills itself from `make` and stays within `limit` entries (CACHE): what comes later is made anew, and after
    four times as many overflows it starts over (the words of the data may have changed)."""

    def __init__(self, make: Callable[[str], Any], limit: int | None = None):
        super().__init__()
        self.make, self.limit, self.over = make, limit or CACHE, 0

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) < self.limit:
            if len(key) < 64:
                self[key] = value
        else:
            self.over += 1
            if self.over > 4 * self.limit:
                self.clear()
                self.over = 0
        return value


class ByUnit:
    """Values of the pre-tokens of whole texts, looked up through blank-separated units.

    `make` gives the value of one pre-token, `special` that of a special string, `add` sums a list of values. Vocabularies
    that drop white space split at any ASCII blank; in byte-level ones a unit takes the one space before it, and a
    text in which a space stands between other white space (or ends the text after it) is taken piece by piece.
    """

    def __init__(self, path: str, make: Callable[[str], Any], special: Callable[[str], Any], add: Callable[[list], Any], cache: int | None = None):
        self.vocabulary = vocabulary(path)
        self.special, self.add = special, add
        self.piece, self.plain, self.spaced = Cache(make, cache), Cache(self.whole, cache), Cache(lambda unit: self.whole(" " + unit), cache)

    def whole(self, text: str) -> Any:
        core = text.rstrip(TAIL)
        head = core[1:] if core[:1] == " " else core
        if head.isalpha() and (not self.vocabulary.lowers or text.isascii() or plain_letters(head)):
            # letters and closing marks, the common case: two pre-tokens at most
            value = self.piece[core.replace("Σ", "σ").lower() if self.vocabulary.lowers else core]
            return value if len(core) == len(text) else self.add([value, self.piece[text[len(core) :]]])
        out = []
        for special, pieces in self.vocabulary.segments(text):
            out += map(self.special if special else self.piece.__getitem__, pieces)
        return out[0] if len(out) == 1 else self.add(out)

    def batch(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, list]:
        """(text of each unit's first index: offsets, index of each unit into the values, values of distinct units)."""
        if self.vocabulary.lowers:
            units = pc.ascii_split_whitespace(texts)
            # an empty text splits into one empty unit, whose value is that of no pre-token
            codes = units.flatten().dictionary_encode()
            return units.offsets.to_numpy(), codes.indices.to_numpy(), list(map(self.plain.__getitem__, codes.dictionary.to_pylist()))
        mixed = pc.match_substring_regex(texts, MIXED_BLANKS).to_numpy(zero_copy_only=False)
        units = pc.split_pattern(pc.if_else(pa.array(mixed), "", texts) if mixed.any() else texts, " ")
        codes, offsets = units.flatten().dictionary_encode(), units.offsets.to_numpy()
        values = list(map(self.spaced.__getitem__, codes.dictionary.to_pylist()))
        index = codes.indices.to_numpy().copy()
        for i, at in enumerate(offsets[:-1].tolist()):  # a text's first unit has no space before it
            index[at] = len(values)
            values.append(self.whole(texts[i].as_py()) if mixed[i] else self.plain[units.values[at].as_py()])
        return offsets, index, values


def strings(array: pa.StringArray) -> list[str]:
    """The array as a list, at a tenth of the time of to_pylist."""
    return array.to_numpy(zero_copy_only=False).tolist()


def slices(texts: pa.StringArray, size: int = SLICE * 8) -> Iterator[pa.StringArray]:
    """Runs of texts of about `size` bytes: long texts then need little memory at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield pa.concat_arrays([texts.slice(start, stop - start)])
        start = stop


def runs(pool: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's runs of these lengths in the order of index, and where each ends."""
    each = lengths[index]
    ends = np.cumsum(each)
    kind = np.int32 if max(len(pool), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(lengths) - lengths)[index] - (ends - each)).astype(kind), each)
    at += np.arange(len(at), dtype=kind)
    return pool[at], ends


class Words:
    """Ids of words of LETTERS. Words, ids and lengths are flat arrays, some 30 bytes a word; above WORDS words only those
    of the last call stay."""

    def __init__(self, make: Callable[[str], list[int]], code: str):
        self.make, self.code = make, code
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, code)
        self.lengths, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, words: pa.StringArray) -> np.ndarray:
        """The number of each word; those that are not known are made."""
        if len(self.words) > WORDS:
            self.words, (self.ids, _), self.lengths = self.words.take(pa.array(self.last)), runs(self.ids, self.lengths, self.last), self.lengths[self.last]
        n = len(self.words)
        both = pa.concat_arrays([self.words, words]).dictionary_encode()
        ids, lengths, size = array(self.code), [], 0
        for word in strings(both.dictionary[n:]):
            ids.extend(self.make(word))
            lengths.append(len(ids) - size)
            size = len(ids)
        self.words = both.dictionary
        self.ids, self.lengths = np.append(self.ids, np.frombuffer(ids, self.code)), np.append(self.lengths, np.array(lengths, np.int64))
        found = both.indices.to_numpy()[n:]
        self.last = np.flatnonzero(np.bincount(found, minlength=1))
        return found


class Encoder(ByUnit):
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, cache: int | None = None):
        from tokenizers import Tokenizer

        model, v = Tokenizer.from_file(path).model, vocabulary(path)
        self.code = code = "H" if v.size <= 1 << 16 else "I"
        self.dtype = np.dtype(code)
        make = lambda piece: [t.id for t in model.tokenize(symbols(piece))]
        super().__init__(
            path,
            lambda piece: array(code, make(piece)).tobytes(),
            lambda string: array(code, [v.special[string]]).tobytes(),
            b"".join,
            cache,
        )
        self.words = Words(make, code)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text's first id)."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        if self.vocabulary.lowers:
            units = pc.ascii_split_whitespace(texts)
            codes, offsets = units.flatten().dictionary_encode(), units.offsets.to_numpy()
            index, (pool, lengths) = codes.indices.to_numpy(), self._units(codes.dictionary)
        else:
            offsets, index, values = self.batch(texts)
            pool, lengths = self._pool(values)
        ids, ends = runs(pool, lengths, index)
        return ids, np.append(0, ends)[offsets]

    def _pool(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(values), self.dtype), np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize

    def _units(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units in a row, and how many each has: words of LETTERS and their closing marks all at once, other
        units one by one."""
        cores = pc.utf8_rtrim(units, TAIL)
        size = pc.binary_length(cores).to_numpy()
        words = pc.match_substring_regex(cores, f"^[{LETTERS}]+$").to_numpy(zero_copy_only=False) & (size < WORD_BYTES)
        marked = words & (size < pc.binary_length(units).to_numpy())
        known = self.words.codes(pc.utf8_lower(cores.filter(pa.array(words))))
        marks = pc.replace_substring_regex(units.filter(pa.array(marked)), f"^[{LETTERS}]+", "").dictionary_encode()
        others = [self.plain[x] for x in strings(units.filter(pa.array(~words)))]
        pool, lengths = self._pool([b"", *map(self.piece.__getitem__, strings(marks.dictionary)), *others])
        n = len(self.words.lengths)
        parts = np.full((len(units), 2), n)  # the empty value
        parts[words, 0], parts[marked, 1] = known, n + 1 + marks.indices.to_numpy()
        parts[~words, 0] = n + 1 + len(marks.dictionary) + np.arange(len(others))
        ids, ends = runs(np.append(self.words.ids, pool), np.append(self.words.lengths, lengths), parts.ravel())
        return ids, np.diff(ends[1::2], prepend=0)


@functools.lru_cache(maxsize=4)
def encoder(path: str, cache: int | None = None) -> Encoder:
    return Encoder(path, cache)


def forget() -> None:
    """Frees what a worker has kept for encoding, for a step that makes no ids: some 120 MB after 100,000 units."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc keep what is freed
            ctypes.CDLL(None).malloc_trim(0)
