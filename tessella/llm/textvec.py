"""Words of many texts as 64-bit hashes, in numpy: the shared front end of the scoring and shingling operators.

A word is a maximal run of Unicode letters, digits and underscores of the lower-cased text. Texts are handled in
blocks of about `BLOCK_CHARS`, so memory follows the block (or the longest single text), not the Arrow batch.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np

BLOCK_CHARS = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@functools.cache
def word_chars() -> np.ndarray:
    """True for code points of words."""
    out = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LN":
            out[c] = True
    out[ord("_")] = True
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def byte_offsets(cp: np.ndarray) -> np.ndarray:
    """Where each code point, and the end, lies in the UTF-8 form."""
    wide = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    return np.concatenate(([0], np.cumsum(wide)))


def eight_bytes(raw: bytes, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The count (0 to 8, or clipped to it) bytes from each start as one number, the rest zero; raw has 8 bytes to spare."""
    b = np.frombuffer(raw, np.uint8)
    at = np.ndarray((len(b) - 7,), "<u8", b.data, 0, (1,))
    few = np.clip(count, 0, 8)
    mask = np.where(few == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (few.astype(np.uint64) * _U(8) & _U(63))) - _U(1))
    return at[np.minimum(start, len(at) - 1)] & mask


def span_hashes(text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points of the text, from all its bytes.

    Spans of up to 16 bytes, most words, are mixed as two numbers; longer ones are digested one by one.
    """
    raw = text.encode("utf-8", "surrogatepass")
    at = byte_offsets(cp) if len(raw) != len(cp) else np.arange(len(cp) + 1)
    begin, size = at[start], at[end] - at[start]
    padded = raw + bytes(8)
    out = mix(eight_bytes(padded, begin, size) + size.astype(np.uint64) * _U(_BASE))
    out = mix(out * _U(_BASE) + eight_bytes(padded, begin + 8, size - 8))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : begin[i] + size[i]], digest_size=8).digest(), "little")
    return out


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) of about BLOCK_CHARS characters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_CHARS:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the index of its text; for one block of texts."""
    lowered = [t.lower() for t in texts]
    text = "\n".join([*lowered, ""])
    cp = code_points(text)
    edges = np.diff(np.concatenate(([False], word_chars()[cp], [False])).view(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.cumsum([len(t) + 1 for t in lowered])
    return span_hashes(text, cp, start, end), np.searchsorted(offsets, start, side="right")


def grams(hashes: np.ndarray, owner: np.ndarray, offsets: tuple[int, ...], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each tuple of words at the given offsets (ascending, from 0) within one text, and the text's index."""
    n = max(0, len(hashes) - offsets[-1])
    out = np.full(n, seed, dtype=np.uint64)
    for o in offsets:
        out = mix(out * _U(_BASE) + hashes[o : o + n])
    inside = owner[:n] == owner[offsets[-1] : offsets[-1] + n]
    return out[inside], owner[:n][inside]
