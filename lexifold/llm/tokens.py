"""Token ids of whole Arrow columns, each distinct chunk of text encoded once per batch.

A tokeniser whose rules never reach across certain blanks gives the same ids for a
text as for its chunks, one after another. The chunks of a batch are put into a
dictionary, the tokeniser's model runs on each distinct chunk, and the ids are
gathered back. Texts and chunks for which that might not hold go to the library whole.
"""

from __future__ import annotations

import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# How byte-level tokenisers cut text into words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters for which lower case, composition and classes are the same everywhere.
PLAIN = r"\A ?[!-~¡-Į]+(?:\n[!-~¡-Į]+)*\z"
#: Letters alone, with or without a blank before them: one pre-token of a byte-level tokeniser.
LETTERS = r"\A ?[A-Za-zÀ-ÖØ-öø-Į]+\z"
#: Stands between chunks; it is white space to the patterns and never in a plain chunk.
SEPARATOR = "\r"
#: Blanks next to each other, other than one in front of a word.
CROWDED = r"  |[\t\n\r] (?:[\t\n\r ]|\z)|[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CACHED_WORDS = 100_000
GATHER = 500_000


def public_path(name: str) -> str:
    """Where the tokeniser file of that name is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids as ``tokenizers`` gives them, without added special tokens."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else "<u4")
        self.specials = [t["content"] for t in told.get("added_tokens", [])]
        self.style, self.pattern = self._style(told)
        self.lines = regex.compile(f"{SEPARATOR}|{self.pattern.pattern}") if self.pattern else None
        self.letters = bool(self.pattern) and (self.style == "space" or "[\\p{L}]+" in self.pattern.pattern)
        self.characters = _byte_characters()
        self.cache: dict[str, list[int]] = {}

    @staticmethod
    def _style(told: dict) -> tuple[str, regex.Pattern | None]:
        """``space``: a blank belongs to the word behind it; ``word``: white space is dropped; else ``text``."""
        before, normal = told.get("pre_tokenizer") or {}, told.get("normalizer") or {}
        if told["model"].get("type") != "BPE" or told["model"].get("ignore_merges") or told["model"].get("dropout"):
            return "text", None
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            return "space", regex.compile(BYTE_LEVEL_WORDS)
        steps = before.get("pretokenizers", [])
        if (
            [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
            and [n.get("type") for n in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        ):
            return "word", regex.compile(steps[0]["pattern"]["Regex"])
        return "text", None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _word(self, word: str) -> list[int]:
        """Ids of one pre-token, which never needs more than the model."""
        found = self.cache.get(word)
        if found is None:
            if not word.isascii() or word[0] < " ":
                mapped = word.encode("utf-8").decode("latin-1").translate(self.characters)
            else:
                mapped = self.characters[32] + word[1:] if word[0] == " " and word[1:].isalpha() else word if word[0] > " " else word.translate(self.characters)
            found = [t.id for t in self.model.tokenize(mapped)]
            if len(self.cache) < CACHED_WORDS:
                self.cache[word] = found
        return found

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct chunks one after another, and where each begins.

        Chunks that are one pre-token go to the model. Other plain chunks are cut into
        pre-tokens in one go, and the distinct pre-tokens go to the model. The others go
        to the library whole.
        """
        plain = pc.match_substring_regex(chunks, PLAIN)
        for special in self.specials:
            plain = pc.and_not(plain, pc.match_substring(chunks, special))
        plain = np.asarray(plain)
        single = plain & np.asarray(pc.match_substring_regex(chunks, LETTERS)) & self.letters
        plain = plain & ~single
        sizes = np.zeros(len(chunks), np.int64)
        parts = []
        if plain.any():
            line = SEPARATOR.join(chunks.filter(pa.array(plain)).to_pylist())
            coded = pa.array(self._lines(line), pa.string()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            each = [[] if w == SEPARATOR else self._word(w) for w in distinct]
            flat, begin = _joined(each, self.dtype)
            codes = np.asarray(coded.indices)
            ids, starts = _gather(flat, begin, codes)
            ends = np.flatnonzero(codes == distinct.index(SEPARATOR))
            sizes[plain] = np.diff(starts[ends], prepend=0)
            parts.append((plain, ids))
        others = ~plain & ~single
        for mask, encode in ((single, self._letters), (others, self.whole)):
            if mask.any():
                ids, begin = _joined([encode(c) for c in chunks.filter(pa.array(mask)).to_pylist()], self.dtype)
                sizes[mask] = np.diff(begin)
                parts.append((mask, ids))
        begin = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(begin[-1], self.dtype)
        for mask, ids in parts:
            out[np.repeat(mask, sizes)] = ids
        return out, begin

    def _letters(self, word: str) -> list[int]:
        return self._word(word.lower() if self.style == "word" else word)

    def _lines(self, line: str) -> list[str]:
        """Pre-tokens of joined chunks, with a separator behind each chunk."""
        return self.lines.findall((line.lower() if self.style == "word" else line) + SEPARATOR)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch one after another, and where each text (none is null) begins."""
        if self.style == "text":
            return _joined([self.whole(t) for t in texts.to_pylist()], self.dtype)
        crowded = np.zeros(len(texts), bool)
        if self.style == "space":
            crowded = np.asarray(pc.match_substring_regex(texts, CROWDED))
            parts = pc.split_pattern(texts, " ")
        else:
            parts = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(parts.offsets).astype(np.int64)
        offsets = offsets - offsets[0]
        coded = parts.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices), coded.dictionary
        del parts
        if self.style == "space":
            first = np.zeros(len(codes), bool)
            first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
            bare, bare_codes = np.unique(codes[first], return_inverse=True)
            blanks = pc.binary_join_element_wise(pa.scalar(" "), words, "")
            words = pa.concat_arrays([blanks, words.take(pa.array(bare))])
            codes = codes.copy()
            codes[first] = len(blanks) + bare_codes
        flat, begin = self.chunks(words)
        ids, at = _gather(flat, begin, codes)
        starts = at[offsets]
        if crowded.any():
            each = [
                self.whole(texts[i].as_py()) if crowded[i] else ids[starts[i] : starts[i + 1]] for i in range(len(texts))
            ]
            return _joined(each, self.dtype)
        return ids, starts


def _gather(flat: np.ndarray, begin: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[begin[c]:begin[c + 1]]`` of all codes one after another, and where each begins."""
    sizes = np.diff(begin)
    at = np.concatenate(([0], np.cumsum(sizes[codes])))
    out = np.empty(at[-1], flat.dtype)
    for low in range(0, len(codes), GATHER):
        some = codes[low : low + GATHER]
        first, last = at[low], at[low + len(some)]
        shift = begin[some] - at[low : low + len(some)]
        out[first:last] = flat[np.repeat(shift, sizes[some]) + np.arange(first, last)]
    return out, at


def _joined(each: list, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))))
    if each and isinstance(each[0], np.ndarray):
        return np.concatenate(each).astype(dtype, copy=False), begin
    return np.fromiter(chain.from_iterable(each), dtype, begin[-1]), begin


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` behind every text."""
    if not len(starts) - 1:
        return ids, starts
    return np.insert(ids, starts[1:], np.array(end, ids.dtype)), starts + np.arange(len(starts))


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
