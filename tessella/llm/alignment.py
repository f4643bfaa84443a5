"""How the tokens of two tokenizers line up, document by document and as counts of linked id pairs.

Both tokenizers are laid over the bytes of a space and the text. Cumulative sums of token lengths give the tokens' ends,
`intersect1d` the offsets where both end, `searchsorted` the group of each token, and a repeat-based expansion the links:
all pairs of tokens whose byte ranges overlap.

Neither tokenizer carries a token across a space that follows a non-space and precedes a non-white character, so texts
are cut there and each distinct part is encoded and aligned once in a task, many parts as one stream of tokens. Documents
are then sums over their parts. Whether a pair of tokenizers may be cut like that is read from their vocabularies; if
not, a part is the whole text.

Pair counts are added up by part in each task, then shuffled twice, first by pair and a salt and then by pair. A second
pass over the texts looks the counts up: the `HOT_PAIRS` most frequent pairs are broadcast, links of rarer pairs, if
there are any, are joined through a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_python, written
from .textvec import blocks

#: The pattern by which byte-level vocabularies of this kind split text, and Unicode's white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUT = re.compile(f"(?<=[^ ]) (?=[^{WHITE}])")
WHITE_AFTER_SPACE = re.compile(f" [{WHITE}]")

#: Parts that a task remembers, and their characters, before it begins anew.
HELD_PARTS, HELD_CHARS = 400_000, 16 << 20
#: Characters of a text that are cut into parts at a time, and parts that are looked up at a time.
STRETCH, LOOKED_UP = 1 << 20, 1 << 18
#: Pairs whose counts are broadcast (17 bytes each), and the salts of the first shuffle.
HOT_PAIRS, SALTS = 1 << 21, 8


@dataclass
class Coder:
    """A tokenizer: encodes texts that are each preceded by a space, and knows the bytes of its ids."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]
    separable: bool

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(t) for t in self.tokens], np.int64)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@functools.cache
def byte_level(path: str) -> Coder:
    """A byte-level BPE of a .json file, special strings in texts being plain text.

    A vocabulary in the order of its merges is encoded by a faster library that takes ranks; any other by the file's own.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    letters, special = _byte_letters(), {t["content"] for t in spec["added_tokens"]}
    tokens = [b""] * (1 + max(vocab.values()))
    for entry, i in vocab.items():
        tokens[i] = entry.encode() if entry in special else bytes(letters[c] for c in entry)
    split = spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"]
    made = [vocab[m.replace(" ", "")] for m in merges]
    if plain and made == sorted(made) and len(set(made)) == len(made):
        import tiktoken

        ranks = {tokens[i]: i for entry, i in vocab.items() if entry not in special}
        coder = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Coder(lambda texts: [coder.encode_ordinary(f" {t}") for t in texts], tokens, True)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return Coder(lambda texts: [own.encode(f" {t}", add_special_tokens=False).ids for t in texts], tokens, plain)


@functools.cache
def pieces(path: str) -> Coder:
    """A sentencepiece model that puts the space in front itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    inner = re.compile("[^ ].* ", re.S)
    return Coder(lambda texts: model.encode(texts, num_threads=1), tokens, not any(inner.search(p.replace("▁", " ")) for p in names))


def parts(text: str) -> Iterator[list[str]]:
    """The parts of a text, a stretch at a time: each stands for a space and itself, together they are space and text."""
    at = 0
    while at <= len(text):
        cut = CUT.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        end = cut.start() if cut else len(text)
        some = text[at:end]
        odd = some.startswith(" ") or some.endswith(" ") or WHITE_AFTER_SPACE.search(some)
        yield CUT.split(some) if odd else some.split(" ")
        at = end + 1


@dataclass
class Aligned:
    """A stream of tokens of A and of B over the same bytes."""

    ends_a: np.ndarray
    ends_b: np.ndarray
    cuts: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    """Groups and links of tokens with these byte lengths, none of them zero, whose sums agree."""
    ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    first = np.searchsorted(ends_b, ends_a - len_a, side="right")
    last = np.searchsorted(ends_b - len_b, ends_a, side="left")
    times = last - first
    link_a = np.repeat(np.arange(len(len_a)), times)
    link_b = np.arange(len(link_a)) + np.repeat(first - (np.cumsum(times) - times), times)
    return Aligned(ends_a, ends_b, cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), link_a, link_b)


class Table:
    """Parts met so far in a task, each aligned once."""

    def __init__(self, a: Coder, b: Coder, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.a, self.b, self.counts = a, b, counts
        self.numbers: dict[str, int] = {}
        self.chars = 0
        #: By part: fits, tokens of A, of B, groups, links, best links, sum of counts, links whose pair isn't in counts.
        self.facts = np.zeros((8, 1024), np.int64)
        self.codes: list[np.ndarray] = []
        self.rest: dict[int, np.ndarray] = {}
        self.spelled: list[bytes] = []
        if counts:
            v = max(len(a.tokens), len(b.tokens))
            self.width, self.written = v, [b"%d%s" % (i, s) for s in (b",", b"|", b";") for i in range(v)]

    def full(self) -> bool:
        return len(self.numbers) > HELD_PARTS or self.chars > HELD_CHARS

    def numbered(self, found: list[str]) -> np.ndarray:
        """The parts' numbers; new ones are encoded and aligned first."""
        new = list(dict.fromkeys(p for p in found if p not in self.numbers))
        if new:
            self._learn(new)
        return np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))

    def numbered_texts(self, texts: list[str], cut: Callable[[str], Iterator[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' parts in a row, and how many each text has; an empty text has none."""
        found, sizes, out = [], [], []
        for text in texts:
            sizes.append(0)
            for some in cut(text) if text else ():
                found += some
                sizes[-1] += len(some)
                if len(found) > LOOKED_UP:
                    out.append(self.numbered(found))
                    found = []
        return np.concatenate((*out, self.numbered(found))), np.array(sizes, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids_a, ids_b = self.a.encode(new), self.b.encode(new)
        first = len(self.numbers)
        for p in new:
            self.numbers[p] = len(self.numbers)
            self.chars += len(p)
        while self.facts.shape[1] < len(self.numbers):
            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)), axis=1)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        raw = [f" {p}".encode("utf-8", "surrogatepass") for p in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        own_a, own_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        len_a, len_b = self.a.lengths[a], self.b.lengths[b]
        fits = (np.bincount(own_a, len_a, len(new)) == size) & (np.bincount(own_b, len_b, len(new)) == size)
        joined = b"".join(raw)
        if not fits.all() or any(joined != b"".join(map(c.tokens.__getitem__, x.tolist())) for c, x in ((self.a, a), (self.b, b))):
            for k, part in enumerate(raw):
                fits[k] = all(part == b"".join(c.tokens[i] for i in x[k]) for c, x in ((self.a, ids_a), (self.b, ids_b)))
            keep_a, keep_b = fits[own_a], fits[own_b]
            a, own_a, len_a, b, own_b, len_b = a[keep_a], own_a[keep_a], len_a[keep_a], b[keep_b], own_b[keep_b], len_b[keep_b]
            n_a, n_b = n_a * fits, n_b * fits
        solid_a, solid_b = len_a > 0, len_b > 0  # an id without bytes overlaps nothing
        got = align(len_a[solid_a], len_b[solid_b])
        place_a, place_b = np.flatnonzero(solid_a)[got.link_a], np.flatnonzero(solid_b)[got.link_b]
        code, owner = a[place_a] * len(self.b.tokens) + b[place_b], own_a[place_a]
        links = np.bincount(owner, minlength=len(new))
        groups = np.bincount(own_a[solid_a][np.searchsorted(got.ends_a, got.cuts)], minlength=len(new))
        self.facts[:5, first : first + len(new)] = fits, n_a, n_b, groups, links
        if self.counts is None:
            self.codes.append(code)
        else:
            self._look_up(first, len(new), code, owner)
            self._spell(a, b, own_a, own_b, got)

    def _look_up(self, first: int, new: int, code: np.ndarray, owner: np.ndarray) -> None:
        known, n, best = self.counts
        at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
        hit = known[at] == code if len(known) else np.zeros(len(code), bool)
        sums = np.zeros((2, new), np.int64)
        np.add.at(sums[0], owner[hit], best[at[hit]].astype(np.int64))
        np.add.at(sums[1], owner[hit], n[at[hit]])
        missed, mine = code[~hit], owner[~hit]
        self.facts[5:, first : first + new] = sums[0], sums[1], np.bincount(mine, minlength=new)
        for k in np.unique(mine).tolist():
            self.rest[first + k] = missed[slice(*np.searchsorted(mine, (k, k + 1)))]

    def _spell(self, a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, got: Aligned) -> None:
        """Each new part's groups as text, ids of A, then of B."""
        before_b = np.searchsorted(got.group_b, np.arange(len(got.cuts) + 1))
        before_a = np.searchsorted(got.group_a, np.arange(1, len(got.cuts) + 1))
        line = np.empty(len(a) + len(b), np.int64)
        last_a = np.append(got.group_a[1:] != got.group_a[:-1], True)[: len(a)]
        last_b = np.append(got.group_b[1:] != got.group_b[:-1], True)[: len(b)]
        line[np.arange(len(a)) + before_b[got.group_a]] = a + self.width * last_a
        line[np.arange(len(b)) + before_a[got.group_b]] = b + 2 * self.width * last_b
        words = list(map(self.written.__getitem__, line.tolist()))
        parts_here = np.arange(1, len(self.numbers) - len(self.spelled) + 1)
        ends = np.searchsorted(own_a, parts_here) + np.searchsorted(own_b, parts_here)
        begin = 0
        for end in ends.tolist():
            self.spelled.append(b"".join(words[begin:end])[:-1])
            begin = end

    def pair_counts(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and how many links have them, of parts that occur so many times."""
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.concatenate(self.codes)
        weight = np.repeat(times, self.facts[4, : len(times)])
        pair, at = np.unique(code, return_inverse=True)
        n = np.bincount(at, weight, len(pair)).astype(np.int64)
        return pair[n > 0], n[n > 0]


def _digest(table: Table, numbers: np.ndarray) -> str:
    out = hashlib.sha256()
    for k in range(0, len(numbers), LOOKED_UP):
        out.update(b";" * (k > 0) + b";".join(map(table.spelled.__getitem__, numbers[k : k + LOOKED_UP].tolist())))
    return out.hexdigest()


def _rest_of(table: Table, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of these parts that the table's counts lack, and how often they occur."""
    times = np.bincount(numbers)
    odd = [k for k in np.flatnonzero(times).tolist() if k in table.rest]
    pair, at = np.unique(np.concatenate([table.rest[k] for k in odd]), return_inverse=True)
    weight = np.repeat(times[odd], [len(table.rest[k]) for k in odd])
    return pair, np.bincount(at, weight, len(pair)).astype(np.int64)


def _whole(text: str) -> Iterator[list[str]]:
    yield [text]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pair_counts(docs: DataFrame, tokenizers: Callable[[], tuple[Coder, Coder]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pair, n): pair is A's id times the size of B's vocabulary plus B's id, n how many links of all documents have it."""
    with_python(docs.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = tokenizers()
        cut = parts if a.separable and b.separable else _whole
        table, times = Table(a, b), np.zeros(0, np.int64)

        def sums() -> pd.DataFrame:
            pair, n = table.pair_counts(np.concatenate((times, np.zeros(len(table.numbers) - len(times), np.int64))))
            return pd.DataFrame({"pair": pair, "n": n})

        for frame in frames:
            for _, group in blocks([t for t in frame["text"].tolist() if t]):
                x, sizes = table.numbered_texts(group, cut)
                whole = np.add.reduceat(table.facts[0, x], np.cumsum(sizes) - sizes) == sizes
                more = np.bincount(x[np.repeat(whole, sizes)], minlength=len(table.numbers))
                more[: len(times)] += times
                times = more
                if table.full():
                    yield sums()
                    table, times = Table(a, b), np.zeros(0, np.int64)
        yield sums()

    made = _texts(docs, id_col, text_col).mapInPandas(count, "pair long, n long")
    salted = made.groupBy("pair", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def _hot(counts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, HOT_PAIRS at most, and the others if there are any."""
    bits = F.length(F.bin("n"))
    left, floor = HOT_PAIRS, 64
    sizes = {r["bits"]: r["k"] for r in counts.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 63 rows at most
    for b in sorted(sizes, reverse=True):
        if sizes[b] > left:
            return counts.where(bits >= floor), counts.where(bits < floor)
        left, floor = left - sizes[b], b
    return counts, None


def alignment(docs: DataFrame, tokenizers: Callable[[], tuple[Coder, Coder]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null, empty or not given back byte by byte by both tokenizers has no tokens: zeros and ''. Null and
    repeated ids are rows like any other and equal texts count each for themselves. Texts of any length are read whole,
    cut into parts a stretch at a time; text without spaces is one part. Pairs as frequent as the most frequent of their
    B id are best, all of them. An empty table gives no rows; only id and text are read, whatever other columns are called.
    """
    spark = docs.sparkSession
    _, b = tokenizers()
    counts = pair_counts(docs, tokenizers, id_col=id_col, text_col=text_col).withColumn("b", F.col("pair") % len(b.tokens))
    counts = written(counts, "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # a row for each id of B's vocabulary
    counts = written(counts.join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    hot, rest = _hot(counts)
    found = hot.orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "n", "best")))

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = tokenizers()
        cut = parts if a.separable and b.separable else _whole
        table = Table(a, b, sent.value)
        for frame in frames:
            out = []
            for _, group in blocks(frame["text"].tolist()):
                x, sizes = table.numbered_texts(group, cut)
                ends = np.cumsum(sizes)
                sums = np.concatenate((np.zeros((8, 1), np.int64), np.cumsum(table.facts[:, x], axis=1)), axis=1)
                sums = sums[:, ends] - sums[:, ends - sizes]
                for k, (begin, end) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                    fits = 0 < end - begin == sums[0, k]
                    mine = x[begin:end]
                    pair, n = _rest_of(table, mine) if fits and sums[7, k] else (mine[:0], mine[:0])
                    out.append((*(sums[1:7, k].tolist() if fits else [0] * 6), _digest(table, mine) if fits else "", pair, n))
                if table.full():
                    table = Table(a, b, sent.value)
            yield pd.concat((frame[["row", "doc_id"]], pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs", "times"], index=frame.index)), axis=1)

    shape = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, pairs array<long>, times array<long>"
    rows = _texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInPandas(lay, shape)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    if rest is not None:
        rows = written(rows, "aligned")
        links = rows.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("k"))
        more = links.join(rest, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
        rows = rows.join(more, "row", "left")
        for name, extra in (("n_best", "more_best"), ("count_sum", "more_sum")):
            rows = rows.withColumn(name, F.col(name) + F.coalesce(F.col(extra), F.lit(0)))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
