"""Spelling variants: words one edit apart, by generating the full neighbourhood of each word.

Words are counted in one pass over whole texts, added up in each task before they are shuffled. A word's neighbourhood
is every distinct string that one deletion, replacement or insertion over the observed alphabet makes of it; those
strings are hash-joined to the vocabulary, and what meets there is one edit apart by construction, so no distance is
ever computed.

A word of ten letters has about a thousand neighbours and few of them are words. So a task first looks its candidates
up in a Bloom filter of the vocabulary, and only those that may be words are spelled out and shuffled to the join. A
candidate's hash follows from sums over the word's prefix and suffix in a few array operations, never from its letters.
The filter has `FILTER_BITS` for a word up to a fixed size (64 MB); a larger vocabulary fills it more densely, which lets more
candidates through to the join and changes no result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, with_python, written
from .textvec import mix

#: Fixed values of the operator's contract.
RUN = re.compile("[a-zÀ-ÿ]+")
NOT_RUN = re.compile("[^a-zÀ-ÿ]")
DROP_EVERY = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2

FILTER_BITS = 32
#: The filter is made of slices of 2^17 bits, 4,096 of them at most.
SLICE_LOG, MAX_SLICES_LOG = 17, 12
#: Distinct words that a task adds up before it sends them on.
HELD_WORDS = 400_000
#: Characters of a text that are searched at a time, and candidates that are made at a time.
BLOCK_CHARS, BLOCK_CANDIDATES = 1 << 20, 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


# words and their counts


def runs(text: str) -> Iterator[list[str]]:
    """The letter runs of a text, A-Z in lower case, a block at a time; no run is cut."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    at = 0
    while at < len(text):
        end = len(text)
        if at + BLOCK_CHARS < end:
            edge = NOT_RUN.search(text, at + BLOCK_CHARS)
            end = edge.start() if edge else end
        yield RUN.findall(text, at, end)
        at = end


def words_of(doc_id: str, text: str) -> Iterator[tuple[str, int]]:
    """(word, times) of one document, after the planned deletions; words too short to count are left out."""
    found: Counter[str] = Counter()
    for block in runs(text):
        found.update(block)
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, times in found.items():
        if len(run) >= MIN_LENGTH:
            h = zlib.crc32(run.encode(), start)
            if h % DROP_EVERY == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < MIN_LENGTH:
                    continue
            yield run, times


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least MIN_LENGTH code points that occur MIN_COUNT times or more in all documents."""
    with_python(docs.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: defaultdict[str, int] = defaultdict(int)
        for frame in frames:
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                for word, times in words_of(doc, text):
                    held[word] += times
                if len(held) > HELD_WORDS:
                    yield from _frames(held)
                    held.clear()
        yield from _frames(held)

    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _frames(held: dict[str, int], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    words = list(held)
    for k in range(0, len(words), rows):
        part = words[k : k + rows]
        yield pd.DataFrame({"word": part, "n": [held[w] for w in part]})


# hashes of words and of their neighbours


def _letters(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _value(letters: np.ndarray) -> np.ndarray:
    return mix(letters.astype(_U) + _U(1))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([_U(1)], np.full(n, _BASE, _U))), dtype=_U)


def _sums(letters: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Before each letter, and at the end: the sum of value times power over what precedes."""
    out = np.zeros((len(letters), letters.shape[1] + 1), _U)
    np.cumsum(_value(letters) * power[: letters.shape[1]], axis=1, out=out[:, 1:])
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), _U)
    for at in _by_length(words):
        letters = _letters([words[i] for i in at])
        out[at] = mix(_sums(letters, _powers(letters.shape[1]))[:, -1])
    return out


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


class Filter:
    """A Bloom filter of word hashes: the top bits choose a slice, three places in it are set."""

    def __init__(self, bits: np.ndarray, slices_log: int):
        self.bits, self.log = bits, slices_log

    @staticmethod
    def places(h: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(3):
            yield (h >> _U(k * SLICE_LOG)) & _U((1 << SLICE_LOG) - 1)

    @staticmethod
    def slice_of(h: np.ndarray, slices_log: int) -> np.ndarray:
        return h >> _U(63 - slices_log) >> _U(1)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be in the filter."""
        at = None
        for k in range(3):
            left = h if at is None else h[at]
            place = (left >> _U(k * SLICE_LOG)) & _U((1 << SLICE_LOG) - 1)
            byte = (self.slice_of(left, self.log) << _U(SLICE_LOG - 3)) + (place >> _U(3))
            hit = np.flatnonzero((self.bits[byte] >> (place & _U(7)).astype(np.uint8)) & 1)
            at = hit if at is None else at[hit]
        return at


def neighbours(words: list[str], alphabet: str, seen: Filter) -> Iterator[tuple[int, str]]:
    """(index of the word, neighbour) for the distinct strings one edit away that the filter may hold.

    Each string is made once: of equal letters in a row the first is deleted, a letter isn't replaced by itself, and
    none is inserted right behind its like. Words longer than a block are handled a stretch of positions at a time.
    """
    signs = np.frombuffer(alphabet.encode("utf-32-le"), np.uint32)
    values = _value(signs)
    for at in _by_length(words):
        length = len(words[at[0]])
        power = _powers(length + 1)
        stretch = max(1, min(length + 1, BLOCK_CANDIDATES // max(1, len(signs))))
        rows = max(1, BLOCK_CANDIDATES // (stretch * max(1, len(signs))))
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            letters = _letters([words[i] for i in some])
            sums = _sums(letters, power)
            whole = sums[:, -1:]
            for begin in range(0, length + 1, stretch):
                end = min(begin + stretch, length + 1)
                inner = min(end, length)
                here, pos = letters[:, begin:inner], np.arange(begin, end)
                before = np.concatenate((np.zeros((len(some), 1), np.uint32) if begin == 0 else letters[:, begin - 1 : begin], letters[:, begin : end - 1]), axis=1)
                head, tail = sums[:, begin:inner], whole - sums[:, begin + 1 : inner + 1]
                h = mix(head + tail * _U(_BACK))
                for x in seen.may_hold(h.ravel()).tolist():
                    row, i = divmod(x, inner - begin)
                    if here[row, i] != before[row, i]:
                        w, p = words[some[row]], begin + i
                        yield int(some[row]), w[:p] + w[p + 1 :]
                h = mix((head + tail)[:, :, None] + power[begin:inner, None] * values)
                for x in seen.may_hold(h.ravel()).tolist():
                    row, i, c = x // (h.shape[1] * h.shape[2]), x // h.shape[2] % h.shape[1], x % h.shape[2]
                    if here[row, i] != signs[c]:
                        w, p = words[some[row]], begin + i
                        yield int(some[row]), w[:p] + alphabet[c] + w[p + 1 :]
                head = sums[:, begin:end]
                h = mix((head + (whole - head) * _U(_BASE))[:, :, None] + power[pos, None] * values)
                for x in seen.may_hold(h.ravel()).tolist():
                    row, i, c = x // (h.shape[1] * h.shape[2]), x // h.shape[2] % h.shape[1], x % h.shape[2]
                    if before[row, i] != signs[c]:
                        w, p = words[some[row]], begin + i
                        yield int(some[row]), w[:p] + alphabet[c] + w[p:]


def vocabulary_filter(words: DataFrame) -> Filter:
    """The filter of a written vocabulary: each slice is made by the task that gets its hashes; 64 MB at most in all."""
    need = max(1, words.count()) * FILTER_BITS >> SLICE_LOG
    log = min(MAX_SLICES_LOG, max(0, (need - 1).bit_length()) if need else 0)

    def hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h = word_hashes(frame["word"].tolist())
            yield pd.DataFrame({"slice": Filter.slice_of(h, log).astype(np.int32), "h": h.view(np.int64)})

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for number, part in frame.groupby("slice"):
                bits = held.setdefault(int(number), np.zeros(1 << (SLICE_LOG - 3), np.uint8))
                for place in Filter.places(part["h"].to_numpy(np.int64).view(_U)):
                    np.bitwise_or.at(bits, (place >> _U(3)).astype(np.int64), (_U(1) << (place & _U(7))).astype(np.uint8))
        if held:
            yield pd.DataFrame({"slice": list(held), "bits": [b.tobytes() for b in held.values()]})

    bits = np.zeros((1 << log, 1 << (SLICE_LOG - 3)), np.uint8)
    for r in words.select("word").mapInPandas(hashes, "slice int, h long").repartition("slice").mapInPandas(slices, "slice int, bits binary").toLocalIterator():
        bits[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bits.ravel(), log)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near_n, near) for each word of a vocabulary (word, n): how many are near it, and its best near word."""
    spark = words.sparkSession
    with_python(spark)
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().orderBy("c")
    alphabet = "".join(r["c"] for r in letters.collect())  # at most the letters of RUN
    sent = spark.sparkContext.broadcast(vocabulary_filter(words))

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _gathered(frames, 20_000):
            known, n, out = frame["word"].tolist(), frame["n"].tolist(), []
            for i, candidate in neighbours(known, alphabet, sent.value):
                out.append((candidate, known[i], n[i]))
                if len(out) == 50_000:
                    yield pd.DataFrame(out, columns=["candidate", "near", "near_n"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["candidate", "near", "near_n"])

    made = words.mapInPandas(spell, "candidate string, near string, near_n long")
    met = words.join(made, F.col("word") == F.col("candidate"), "left")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))))
    met = met.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    return met.select("word", "n", "n_near", (-F.col("best.minus")).alias("near_n"), F.col("best.near").alias("near"))


def _gathered(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) that only ever lead to more frequent words: the last word of each chain.

    Every round looks up where a word's present target leads, which doubles the length of chain followed; words whose
    target leads nowhere are done and take no part in later rounds. A form is at least twice as frequent, so a chain
    has at most log2 of the largest count links.
    """
    found = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while found.where("open").limit(1).count():
        to = found.select(F.col("word").alias("at"), F.col("root").alias("next"))
        size = found.agg(F.sum(F.length("word") + F.length("root") + 64)).head()[0]
        to = F.broadcast(to) if size <= BROADCAST_BYTES else to
        moved = found.where("open").join(to, F.col("root") == F.col("at"), "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        found = written(found.where("not open").unionByName(moved), "roots")
    return found.select("word", "root")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Null texts have no words; empty ones neither. A null id counts as empty in the planned deletions. Rows that repeat
    an id or a text count each for itself. Texts of any length are read whole, a block at a time; words of any length
    have all their neighbours made, a stretch of positions at a time. Of near words equally frequent the first in
    code-point order is the form. An empty table gives no rows; only id and text are read, so other columns don't
    matter whatever they are called.
    """
    words = written(vocabulary(docs, id_col, text_col), "vocabulary")
    near = F.col("near_n") >= RATIO * F.col("n")
    found = near_words(words).select("word", "n", "n_near", F.when(near, F.col("near")).alias("form"), F.when(near, F.col("near_n")).alias("form_n"))
    found = written(found, "near-words")
    last = roots(found.where("form is not null")).withColumnRenamed("word", "from_word")
    out = found.join(last, F.col("word") == F.col("from_word"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
