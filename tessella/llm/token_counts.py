"""Token counts by a compiled finite-state tokenizer.

The tokenizer's splitting rule (contractions, letter runs, single digits, runs of other characters) is compiled into
a transducer of seven states over ten character classes; a transition says where tokens begin. A block of texts is
cut into lanes of `LANE` characters. All lanes run in lockstep from every state at once, which gives each lane's state
map; a parallel prefix scan composes the maps, so each lane's true first state is known without reading the lanes
before it; a second lockstep run then marks the tokens. White space maps every state to the first one and ends the
open token, so blocks can be cut there.

How many ids a token emits is a second transducer over its bytes, compiled from the vocabulary's merges. Every prefix of
a word has one encoding, and a word's last id follows an earlier prefix's encoding that it may stand beside. So a state
holds, for each place from which an id may still reach further, the place in the trie of ids, the id before it and the
count up to it; a transition is annotated with how many ids its byte adds to the prefix's encoding (it may take some
back), and the last byte of a token, being a symbol of its own, leads back to the first state. States and transitions
are compiled when first met; a worker process keeps at most `MAX_STATES` states, and `MAX_COUNTED` counts of whole
tokens under their bytes. Beyond that it starts anew, in the middle of a token from the state it is in.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import with_python
from .textvec import BLOCK_CHARS, blocks, byte_offsets, code_points, eight_bytes

LANE = 256
#: Bounds of what a worker keeps (about 500 and 100 bytes each), held within a token too. Transitions: so many a state.
MAX_STATES, MAX_COUNTED, STEPS_A_STATE = 400_000, 1_000_000, 4

SPACE, DIGIT, OTHER, APOSTROPHE, SINGLE, R, V, L, E, LETTER = range(10)
FREE, WORD, RUN, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
#: Marks: a token begins here; one begins at the character before.
HERE, BEFORE = 1, 2

#: Unicode white space, and the letters after an apostrophe that close a contraction.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = {"single": "stmd", "r": "re", "v": "ve", "l": "ll"}


@functools.cache
def char_classes() -> np.ndarray:
    """Class of each code point. Letters and numbers are those of the library's Unicode version, asked once a process."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    every, index = "".join(map(chr, points)), np.array(points)
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
        runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
        for _, (start, end) in runs:
            out[index[start:end]] = kind
    out[[ord(c) for c in WHITE]] = SPACE
    out[ord("'")] = APOSTROPHE
    out[[ord(c) for c in CONTRACTIONS["single"]]] = SINGLE
    out[[ord("r"), ord("v"), ord("l"), ord("e")]] = [R, V, L, E]
    return out


@functools.cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by state * 10 + class."""
    letters = (SINGLE, R, V, L, E, LETTER)
    step, mark = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    for state in (FREE, WORD):
        step[state, [DIGIT, OTHER, APOSTROPHE]] = [FREE, RUN, QUOTE]
        mark[state, [DIGIT, OTHER, APOSTROPHE]] = HERE
        step[state, letters] = WORD
    mark[FREE, letters] = HERE
    step[RUN, [OTHER, APOSTROPHE]] = RUN
    mark[RUN, DIGIT] = HERE
    step[RUN, letters] = WORD
    mark[RUN, letters] = HERE
    step[QUOTE] = step[RUN]
    mark[QUOTE] = mark[RUN]
    for letter, state in ((SINGLE, FREE), (R, QUOTE_R), (V, QUOTE_V), (L, QUOTE_L)):
        step[QUOTE, letter], mark[QUOTE, letter] = state, 0
    for state, closing in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        step[state] = step[WORD]
        mark[state] = mark[WORD] | BEFORE
        step[state, closing], mark[state, closing] = FREE, 0
    return step.ravel(), mark.ravel()


def state_maps(lanes: np.ndarray) -> np.ndarray:
    """For lanes (position, lane) of classes: the state after each lane, by the state before it."""
    step, _ = transducer()
    state = np.repeat(np.arange(7, dtype=np.uint8)[:, None], lanes.shape[1], axis=1)
    for row in lanes:
        state = step[state * np.uint8(10) + row]
    return state


def first_states(maps: np.ndarray) -> np.ndarray:
    """Each lane's state at its start, FREE at the first: an inclusive prefix scan of map composition by doubling."""
    scan, shift = maps.copy(), 1
    while shift < scan.shape[1]:
        later = np.take_along_axis(scan[:, shift:], scan[:, :-shift].astype(np.intp), axis=0)
        scan = np.concatenate((scan[:, :shift], later), axis=1)
        shift *= 2
    return np.concatenate(([FREE], scan[FREE, :-1])).astype(np.uint8)


def token_starts(classes: np.ndarray) -> np.ndarray:
    """Where tokens begin; the last character must be white space."""
    step, mark = transducer()
    lanes = np.concatenate((classes, np.zeros(-len(classes) % LANE, np.uint8))).reshape(-1, LANE).T.copy()
    state = first_states(state_maps(lanes))
    marks = np.empty_like(lanes)
    for i, row in enumerate(lanes):
        at = state * np.uint8(10) + row
        marks[i] = mark[at]
        state = step[at]
    flat = marks.T.ravel()[: len(classes)]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return begins


@functools.cache
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Emission:
    """The transducer from a token's bytes to its number of ids, for one vocabulary.

    Ids are numbered anew: bytes within a token, bytes that end one from LAST on, and merges in their order from MERGED.
    """

    LAST, MERGED, BITS = 256, 512, 9

    def __init__(self, model: dict):
        suffix, ids = model["end_of_word_suffix"], {}
        for letter, byte in byte_letters().items():
            ids[letter], ids[letter + suffix] = byte, self.LAST + byte
        spelled = [[i] for i in range(self.MERGED)]
        self.parts: list[tuple[int, int]] = []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a + b in ids:
                raise ValueError(f"two ways to make {a + b!r}")
            self.parts.append((ids[a], ids[b]))
            spelled.append(spelled[ids[a]] + spelled[ids[b]])
            ids[a + b] = len(ids)
        self.merged = {pair: self.MERGED + rank for rank, pair in enumerate(self.parts)}
        self.next: dict[int, int] = {}
        self.ends, self.inner = [-1], [False]
        for i, symbols in enumerate(spelled):
            node = 0
            for s in symbols:
                key = node << self.BITS | s
                if key not in self.next:
                    self.next[key], self.inner[node] = len(self.ends), True
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.next[key]
            self.ends[node] = i
        self.clear()

    def clear(self) -> None:
        first = ((0, -1, 0),)
        self.states, self.numbers = [first], {first: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border of these ids comes before those that make them.

        The merges are taken back, the latest first, from the sides that touch the border; of equal ones the left was
        made first.
        """
        before = len(self.parts) + self.MERGED
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            if max(a, b) < self.MERGED:
                return True
            if a > b:
                before, a = a, self.parts[a - self.MERGED][1]
            else:
                before, b = b + 1, self.parts[b - self.MERGED][0]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Compile a transition: the state after it and the ids that it adds."""
        reach, last, adds = [], None, 0
        for node, before, since in self.states[state]:
            node = self.next.get(node << self.BITS | symbol)
            if node is None:
                continue
            end = self.ends[node]
            if last is None and end >= 0:
                pair = before, end
                if before >= 0 and pair not in self.apart:
                    self.apart[pair] = self.stay_apart(before, end)
                if before < 0 or self.apart[pair]:
                    last, adds = end, 1 - since
            if self.inner[node]:
                reach.append((node, before, since))
        if symbol >= self.LAST:
            to = 0
        else:
            after = (*((node, before, since + adds) for node, before, since in reach), (0, last, 0))
            to = self.numbers.setdefault(after, len(self.states))
            if to == len(self.states):
                self.states.append(after)
        self.steps[state << self.BITS | symbol] = to, adds
        return to, adds

    def restart(self, state: int) -> int:
        """Forget what was compiled but for this state; its number from now on."""
        kept = self.states[state]
        self.clear()
        number = self.numbers.setdefault(kept, len(self.states))
        if number == len(self.states):
            self.states.append(kept)
        return number

    def count(self, token: bytes) -> int:
        state = total = 0
        steps, bits = self.steps, self.BITS
        for symbol in itertools.chain(token[:-1], (token[-1] + self.LAST,)):
            found = steps.get(state << bits | symbol)
            if not found:
                if len(self.states) > MAX_STATES or len(steps) > STEPS_A_STATE * MAX_STATES:
                    state = self.restart(state)
                    steps = self.steps
                found = self.step(state, symbol)
            state, adds = found
            total += adds
        return total


class Compiled:
    """What a vocabulary file says: its special strings, and the ids of tokens."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.emission = Emission(spec["model"])
        # Counts of tokens met before: of up to eight bytes as one number, of up to MEMO_BYTES as bytes.
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.longer: dict[bytes, int] = {}

    def emitted(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ids of each span of code points of the text."""
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) != len(cp):
            at = byte_offsets(cp)
            begin, size = at[start], at[end] - at[start]
        else:
            begin, size = start, end - start
        zeros = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0)
        short = (size <= 8) & (np.searchsorted(zeros, begin + size) == np.searchsorted(zeros, begin))
        out = np.zeros(len(start), np.int64)
        keys, back = np.unique(eight_bytes(raw + bytes(8), begin[short], size[short]), return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        counts = np.zeros(len(keys), np.int64)
        counts[known] = self.counts[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            counts[new] = [self.emission.count(k.tobytes().rstrip(b"\0")) for k in keys[new].astype("<u8")]
            if len(self.keys) + len(new) > MAX_COUNTED:
                self.keys, self.counts = keys, counts
            else:
                self.keys, self.counts = np.insert(self.keys, place[new], keys[new]), np.insert(self.counts, place[new], counts[new])
        out[short] = counts[back]
        if len(self.longer) > MAX_COUNTED:
            self.longer.clear()
        for i in np.flatnonzero(~short).tolist():
            token = raw[begin[i] : begin[i] + size[i]]
            n = self.longer.get(token)
            if n is None:
                n = self.emission.count(token)
                if len(token) <= MEMO_BYTES:
                    self.longer[token] = n
            out[i] = n
        return out


#: Tokens of more bytes are counted anew each time.
MEMO_BYTES = 64


@functools.cache
def compiled(path: str) -> Compiled:
    return Compiled(path)


@functools.cache
def unassigned() -> np.ndarray:
    """True for code points that Python's Unicode version doesn't know; the library's may."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


_BY_LIBRARY = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def normalised(text: str) -> str:
    """NFC, then each character in lower case by itself (a final sigma is no special case).

    Both are stable for characters once assigned, so the library is only asked where a character is newer than Python's.
    """
    if not text.isascii():
        if unassigned()[code_points(text)].any():
            return _BY_LIBRARY.normalize_str(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


_CUT = re.compile(f"[{WHITE}]")


def _cut_long(text: str) -> list[str]:
    """text in pieces of about a block, cut at white space (a longer run without any stays whole)."""
    out, at = [], 0
    while len(text) - at > BLOCK_CHARS:
        found = _CUT.search(text, at + BLOCK_CHARS)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    table = compiled(path)
    out = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        if "<|" in text:
            for special in table.specials:
                out[i] += text.count(special)
                text = text.replace(special, " ")
        for piece in _cut_long(normalised(text)):
            parts.append(piece)
            owner.append(i)
    for first, group in blocks(parts):
        joined = " ".join([*group, ""])
        cp = code_points(joined)
        classes = char_classes()[cp]
        begins = token_starts(classes)
        edges = np.flatnonzero(begins | (classes == SPACE))
        of = np.flatnonzero(begins[edges])
        start, end = edges[of], edges[of + 1]
        if len(start):
            offsets = np.cumsum([len(t) + 1 for t in group])
            inside = np.searchsorted(offsets, start, side="right")
            sums = np.bincount(inside, weights=table.emitted(joined, cp, start, end), minlength=len(group)).astype(np.int64)
            np.add.at(out, np.array(owner[first : first + len(group)]), sums)
    return out


def token_counts(docs: DataFrame, path: str, *, limit: int = 2_048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (no tokens), a text of any length is counted whole. Null and repeated ids are rows like
    any other; an empty table gives no rows, and other columns are not read.
    """
    with_python(docs.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(count_tokens(texts.tolist(), path))

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
