"""Removing repeated passages: suffix arrays by linear grouping construction over anchored parts of the texts.

A byte goes if a string of `LENGTH` bytes covers it that also starts earlier, in a document of smaller id or further
up in the same one. The work is dealt out by content, so that equal strings always meet:

1. Each window of LENGTH bytes is anchored at its leftmost smallest hash among its strings of `CORE` bytes. Equal
   windows have equal anchors in equal places, and about one byte in 28 is an anchor, with the run of windows it
   stands for. Anchors are dealt out by hash in packed arrays.
2. A pass over each share lets go of anchors that occur once; it remembers one record for each hash, however often
   the hash occurs.
3. The rest are sorted by (hash, hash of all bytes that the anchor's windows cover, document, place). Where the
   covered bytes are the same, all but the first occurrence are repeats as a whole. What is left is one occurrence
   of each different surrounding of a shared anchor.
4. For these the bytes around the anchor are fetched and grouped by anchor into buckets of bounded size. Each bucket
   gets a suffix array by the linear grouping construction, in which equal windows lie side by side; the earliest
   stays. An anchor with more surroundings than a bucket holds is split over salted buckets, and what each of them
   keeps is compared by window hashes.
5. The removed runs of each document are merged and cut out of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fresh, small_enough, with_python, written
from .textvec import _BASE, mix

LENGTH, CORE = 100, 40
#: Anchors in one share of step 2, surroundings in one bucket of step 4.
SHARE_ANCHORS, BUCKET_PARTS = 2_000_000, 3_000
#: Bytes in one numpy pass; longer texts take several.
BLOCK_BYTES = 1 << 20

_U = np.uint64


class _Powers:
    """Powers of a base modulo a prime and of its inverse, as many as were needed so far."""

    def __init__(self, prime: int, base: int):
        self.prime, self.bases = _U(prime), (base, pow(base, -1, prime))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) <= n:
            # The next half is the first one times the power of its length.
            k = len(self.tables[0])
            self.tables = [np.concatenate((t, t * _U(pow(x, k, int(self.prime))) % self.prime)) for t, x in zip(self.tables, self.bases, strict=True)]
        return self.tables


#: Two primes below 2**31: products fit 64 bits, and no structured text makes their polynomials vanish alike.
_FIELDS = (_Powers((1 << 31) - 1, 1_103_515_245), _Powers((1 << 31) - 19, 1_664_525_013))


_ROW = np.dtype([("h", "<u8"), ("c", "<u8"), ("key", "<i8"), ("pos", "<i8")])
_FLANK = LENGTH - CORE
#: The smallest hash of a window comes with its place in the low bits.
_PLACE = _U((1 << 24) - 1)


def _sums(symbols: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.uint64]]:
    """For both fields: prefix sums of the symbols' values times powers, and the inverse powers."""
    out = []
    for i, field in enumerate(_FIELDS):
        up, down = field.upto(len(symbols))
        key = _U((seed + i) << 33)
        if symbols.dtype == np.uint8:
            values = (mix(np.arange(256, dtype=np.uint64) + key) % field.prime)[symbols]
        else:
            values = mix(symbols.astype(np.uint64) + key) % field.prime
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(values * up[: len(symbols)] % field.prime, out=total[1:])
        out.append((total, down, field.prime))
    return out


def _hash(sums: list[tuple[np.ndarray, np.ndarray, np.uint64]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    high, low = ((total[end] - total[start]) % prime * down[start] % prime for total, down, prime in sums)
    return mix(high << _U(32) | low)


def anchors(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: owner, anchor hash, hash of what its windows cover, first window, (anchor - first) << 8 | windows - 1."""
    if len(b) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    sums = _sums(b, 1_000)
    at = np.arange(len(b) - CORE + 1)
    h = _hash(sums, at, at + CORE)
    least, span = (h & ~_PLACE) | at.astype(np.uint64), 1
    while span * 2 <= _FLANK + 1:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if rest := _FLANK + 1 - span:
        least = np.minimum(least[:-rest], least[rest:])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + LENGTH <= offsets[owner + 1])
    anchor, owner = (least[window] & _PLACE).astype(np.int64), owner[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    lo, hi = window[first], window[np.append(first[1:], len(window)) - 1] if len(window) else window
    anchor, owner = anchor[first], owner[first]
    shape = (anchor - lo) << 8 | (hi - lo)
    cover = mix(_hash(_sums(b, 5_000), lo, hi + LENGTH) + shape.astype(np.uint64) * _U(_BASE))
    return owner, h[anchor], cover, lo - offsets[owner], shape


def anchor_rows(keys: list[int], texts: list[bytes]) -> np.ndarray:
    """The anchors of whole texts; repeats of covered bytes within these texts are marked by a cover of zero."""
    out, todo, size = [], [], 0

    def flush() -> None:
        if todo:
            b = np.frombuffer(b"".join(t for _, _, t in todo), np.uint8)
            offsets = np.cumsum([0, *(len(t) for _, _, t in todo)])
            owner, h, cover, place, shape = anchors(b, offsets)
            rows = np.empty(len(h), _ROW)
            rows["h"], rows["c"] = h, cover
            rows["key"] = np.array([k for k, _, _ in todo], np.int64)[owner]
            rows["pos"] = (np.array([s for _, s, _ in todo], np.int64)[owner] + place) << 16 | shape
            out.append(rows)
            todo.clear()

    for key, text in zip(keys, texts, strict=True):
        for start in range(0, max(1, len(text) - LENGTH + 1), BLOCK_BYTES):
            part = text[start : start + BLOCK_BYTES + LENGTH - 1]
            todo.append((key, start, part))
            size += len(part)
            if size >= BLOCK_BYTES:
                flush()
                size = 0
    flush()
    rows = np.concatenate(out) if out else np.zeros(0, _ROW)
    rows = rows[np.lexsort((rows["pos"], rows["key"], rows["c"], rows["h"]))]
    same = np.zeros(len(rows), bool)
    same[1:] = (rows["h"][1:] == rows["h"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
    again = np.flatnonzero(same & (rows["key"] == np.roll(rows["key"], 1)) & (rows["pos"] == np.roll(rows["pos"], 1)))
    rows["c"][same] = 0
    return np.delete(rows, again)


class Once:
    """Lets go of anchors that occur once, in any order of arrival: one record is kept for each hash."""

    def __init__(self):
        self.seen, self.told = np.zeros(0, _ROW), np.zeros(0, bool)

    def add(self, rows: np.ndarray) -> np.ndarray:
        """Rows that are now known to have a repeated hash."""
        rows = rows[np.argsort(rows["h"], kind="stable")]
        h = rows["h"]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(h))) > 1
        at = np.searchsorted(self.seen["h"], h[first])
        known = at < len(self.seen)
        known[known] = self.seen["h"][at[known]] == h[first][known]
        recall = at[known & ~self.told[np.minimum(at, len(self.told) - 1)]] if len(self.seen) else at[:0]
        emit = np.concatenate((rows[(many | known)[np.cumsum(new) - 1]], self.seen[recall]))
        self.told[recall] = True
        add = ~known
        self.seen, self.told = np.insert(self.seen, at[add], rows[first][add]), np.insert(self.told, at[add], many[add])
        return emit


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of every suffix in ascending order, by grouping of Lyndon prefixes, in linear time after a first bucketing.

    Phase one handles groups of suffixes from the highest down. A suffix's previous smaller one is found by following
    pointers already set; suffixes that are so pointed at equally often from the group at hand move together into a
    group just above their old one. In the end a group holds suffixes of one Lyndon prefix, and the pointers are
    final. Phase two walks the array upwards: after suffix x, those that end their Lyndon prefix at x, reached from
    x - 1 along the pointers, take the next places of their groups.
    """
    n = len(text) + 1
    codes = np.append(text.astype(np.int64) + 1, 0)
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    starts = np.flatnonzero(np.append(True, sorted_codes[1:] != sorted_codes[:-1]))
    sizes = np.zeros(n, np.int64)
    sizes[starts] = np.diff(np.append(starts, n))
    sa: list[int] = order.tolist()
    size: list[int] = sizes.tolist()
    place, group = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order] = np.arange(n)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    isa: list[int] = place.tolist()
    head: list[int] = group.tolist()
    prev = [-1] * n

    i = n - 1
    while i >= 0:
        g = head[sa[i]]
        if g == i:
            s = sa[i]
            p = s - 1
            while p >= 0 and head[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                old = head[p]
                if size[old] > 1:
                    last = old + size[old] - 1
                    at, q = isa[p], sa[last]
                    sa[at], sa[last], isa[q], isa[p] = q, p, at, last
                    size[old] -= 1
                    size[last] = 1
                    head[p] = last
        else:
            times: dict[int, int] = {}
            for s in sorted(sa[g : i + 1]):
                p = s - 1
                while p >= 0 and head[p] >= g:
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            for k in sorted(by_times, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_times[k]:
                    old = head[p]
                    last = old + size[old] - 1
                    at, q = isa[p], sa[last]
                    sa[at], sa[last], isa[q], isa[p] = q, p, at, last
                    size[old] -= 1
                    moved.setdefault(old, []).append(p)
                for old, ps in moved.items():
                    new = old + size[old]
                    size[new] = len(ps)
                    for p in ps:
                        head[p] = new
        i = g - 1

    free = list(range(n))
    sa[0] = n - 1
    for i in range(n):
        x = sa[i]
        stop, s = prev[x], x - 1
        while s != stop:
            g = head[s]
            sa[free[g]] = s
            free[g] += 1
            s = prev[s]
    return np.array(sa[1:], np.int64)


WINDOW = _FLANK + 1  # symbols: the flanks' bytes, and one for the core


def repeated_windows(h: np.ndarray, key: np.ndarray, pos: np.ndarray, flanks: list[bytes], salted: bool) -> tuple[list[tuple], list[tuple]]:
    """Among anchors' surroundings: (key, start, bytes) that are repeats, and of a salted bucket its windows that are not.

    The core of an anchor is one symbol of its own. Windows of which the hash occurs once are cut off first; equal
    remaining pieces share one copy, which goes into the suffix array.
    """
    left, windows = (pos >> 8 & 255).astype(np.int64), (pos & 255).astype(np.int64) + 1
    start_of = pos >> 16
    cores = 256 + np.unique(h, return_inverse=True)[1]
    length = windows + WINDOW - 1
    begin = np.cumsum(length) - length
    text = np.empty(int(length.sum()), np.uint32)
    is_core = np.zeros(len(text), bool)
    is_core[begin + left] = True
    text[is_core] = cores
    text[~is_core] = np.frombuffer(b"".join(flanks), np.uint8)

    seg = np.repeat(np.arange(len(h)), windows)
    at = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    where = begin[seg] + at
    pair = [_hash(_sums(text, salt), where, where + WINDOW) for salt in (1, 3)]
    _, back, count = np.unique(pair[0], return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[back] > 1)

    runs = np.ones(len(keep), bool)
    runs[1:] = (np.diff(keep) != 1) | (seg[keep][1:] != seg[keep][:-1])
    first = np.flatnonzero(runs)
    size = np.diff(np.append(first, len(keep)))
    classes: dict[bytes, list[tuple[int, int]]] = {}
    ordered = sorted((int(key[seg[keep[f]]]), int(start_of[seg[keep[f]]] + at[keep[f]]), int(where[keep[f]]), int(n)) for f, n in zip(first, size, strict=True))
    for k, s, w, n in ordered:
        classes.setdefault(text[w : w + n + WINDOW - 1].tobytes(), []).append((k, s))
    repeats: list[tuple] = []
    for piece, found in classes.items():
        n = len(piece) // 4 - WINDOW + LENGTH
        repeats += [(k, s, n) for k, s in found[1:] if (k, s) != found[0]]

    heads = np.array([found[0] for found in classes.values()], np.int64).reshape(-1, 2)
    pieces = [np.frombuffer(p, np.uint32) for p in classes]
    lengths = np.array([len(p) for p in pieces], np.int64)
    of = np.repeat(np.arange(len(pieces)), lengths)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = np.zeros(len(of), bool)
    if len(pieces):
        whole = np.concatenate(pieces)
        sa = suffix_array(whole)
        sa = sa[offset[sa] <= lengths[of[sa]] - WINDOW]
        view = np.lib.stride_tricks.sliding_window_view(whole, WINDOW)
        equal = np.zeros(len(sa), bool)
        for a in range(1, len(sa), 50_000):
            z = slice(a, min(len(sa), a + 50_000))
            equal[z] = (view[sa[z]] == view[sa[z.start - 1 : z.stop - 1]]).all(axis=1)
        run = np.cumsum(~equal)
        k, s = heads[of[sa], 0], heads[of[sa], 1] + offset[sa]
        order = np.lexsort((s, k, run))
        lead = np.ones(len(order), bool)
        lead[1:] = run[order][1:] != run[order][:-1]
        head_at = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
        later = (k[order] != k[order][head_at]) | (s[order] != s[order][head_at])
        repeats += [(int(a), int(b), LENGTH) for a, b in zip(k[order][later], s[order][later], strict=True)]
        kept[sa[order][lead]] = True
    rest: list[tuple] = []
    if salted:
        lone = np.flatnonzero(count[back] == 1)
        rest += [(int(key[seg[i]]), int(start_of[seg[i]] + at[i]), a, b) for i, a, b in zip(lone, pair[0][lone].view(np.int64).tolist(), pair[1][lone].view(np.int64).tolist(), strict=True)]
        if len(pieces):
            spots = np.flatnonzero(kept)
            sums = [_hash(_sums(whole, salt), spots, spots + WINDOW).view(np.int64).tolist() for salt in (1, 3)]
            rest += [(int(heads[of[i], 0]), int(heads[of[i], 1] + offset[i]), a, b) for i, a, b in zip(spots, *sums, strict=True)]
    return repeats, rest


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text): key orders the different documents by id, null ids first."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        return rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", "text")
    hashed = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    order = hashed.select("doc_id", "sha").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "sha")
    keys = written(order.withColumn("key", F.monotonically_increasing_id()), "keys").withColumnsRenamed({"doc_id": "_d", "sha": "_s"})
    joined = hashed.join(small_enough(keys, 100), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("sha") == F.col("_s")))
    return written(joined.select("key", "doc_id", "text"), "keyed")


def _runs(repeats: DataFrame) -> DataFrame:
    """(key, starts, ends): each document's repeats merged, from rows (key, start, bytes)."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        out: list[tuple] = []
        for frame in frames:
            key, start, end = frame["key"].to_numpy(), frame["start"].to_numpy(), (frame["start"] + frame["bytes"]).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                far = np.maximum.accumulate(end[a:z])
                new = np.append(True, start[a + 1 : z] > far[:-1])
                first = np.flatnonzero(new)
                starts, ends = start[a:z][first].tolist(), far[np.append(first[1:] - 1, z - a - 1)].tolist()
                if held and held[0] == key[a]:
                    while starts and starts[0] <= held[2][-1]:
                        held[2][-1] = max(held[2][-1], ends[0])
                        starts, ends = starts[1:], ends[1:]
                    held[1].extend(starts)
                    held[2].extend(ends)
                else:
                    if held:
                        out.append(held)
                    held = (int(key[a]), starts, ends)
            if len(out) > 1_000:
                yield pd.DataFrame(out, columns=["key", "starts", "ends"])
                out = []
        yield pd.DataFrame(out + [held] * bool(held), columns=["key", "starts", "ends"])

    dealt = repeats.repartition("key").sortWithinPartitions("key", "start")
    return written(dealt.mapInPandas(merge, "key long, starts array<long>, ends array<long>"), "runs")


def removed_runs(keyed: DataFrame) -> DataFrame:
    """(key, starts, ends) of the documents (key, text) that lose bytes."""
    spark = keyed.sparkSession
    total = keyed.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    shares = max(1, -(-total // 25 // SHARE_ANCHORS), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = anchor_rows(frame["key"].tolist(), [t.encode("utf-8", "surrogatepass") for t in frame["text"]])
            share = (mix(rows["h"]) % _U(shares)).astype(np.int64)
            rows = rows[np.argsort(share, kind="stable")]
            cut = np.searchsorted(np.sort(share), np.arange(shares + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pd.DataFrame({"share": full, "rows": [rows[cut[i] : cut[i + 1]].tobytes() for i in full]})

    def repeated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, parts, size = Once(), [], 0

        def flush() -> pd.DataFrame:
            rows = once.add(np.frombuffer(b"".join(parts), _ROW))
            return pd.DataFrame({"h": rows["h"].view(np.int64), "c": rows["c"].view(np.int64), "key": rows["key"], "pos": rows["pos"]})

        for frame in frames:
            for blob in frame["rows"]:
                parts.append(blob)
                size += len(blob)
                if size > 16 << 20:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()

    shared = keyed.select("key", "text").mapInPandas(find, "share long, rows binary").repartition(shares, "share").mapInPandas(repeated, "h long, c long, key long, pos long")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From sorted rows: repeats as a whole (h null), and first occurrences of hashes with several covers."""
        held = np.zeros(0, _ROW)  # first occurrence of the hash at hand
        told, last = False, None
        for frame in frames:
            rows = np.empty(len(frame), _ROW)
            rows["h"], rows["c"], rows["key"], rows["pos"] = frame["h"].to_numpy().view(np.uint64), frame["c"].to_numpy().view(np.uint64), frame["key"], frame["pos"]
            whole, firsts = rows["c"] == 0, rows["c"] != 0
            again = np.zeros(len(rows), bool)
            again[1:] = (rows["h"][1:] == rows["h"][:-1]) & (rows["c"][1:] == rows["c"][:-1])
            if last is not None and len(rows):
                again[0] = rows["h"][0] == last["h"] and rows["c"][0] == last["c"]
            again &= firsts
            prior = np.concatenate((rows[:1] if last is None else last.reshape(1), rows[:-1])) if len(rows) else rows
            twin = again & (rows["key"] == prior["key"]) & (rows["pos"] == prior["pos"])
            if len(rows):
                last = rows[-1:].copy()[0]
            heads = np.concatenate((held, rows[firsts & ~again]))
            fresh_from = len(held)
            new = np.ones(len(heads), bool)
            new[1:] = heads["h"][1:] != heads["h"][:-1]
            number = np.cumsum(new) - 1
            several = np.bincount(number, minlength=1)[number] > 1 if len(heads) else np.zeros(0, bool)
            if len(heads) and told:
                several |= number == 0
            emit = several.copy()
            if fresh_from and told:
                emit[0] = False
            if len(heads):
                told = bool(several[-1])
                held = heads[-1:].copy()
                emit_rows = heads[emit]
                held_emitted = bool(emit[-1]) or (told and len(heads) == 1)
                told = told and held_emitted
            else:
                emit_rows = heads
            gone = rows[whole | (again & ~twin)]
            h = np.concatenate((emit_rows["h"].view(np.int64), np.zeros(len(gone), np.int64)))
            out = pd.DataFrame({"h": h, "key": np.concatenate((emit_rows["key"], gone["key"])), "pos": np.concatenate((emit_rows["pos"], gone["pos"]))})
            out["part"] = np.arange(len(out)) < len(emit_rows)
            yield out

    # Rows already known as repeats (a cover of zero) need no company, so they don't weigh on their anchor's task.
    dealt_by = F.when(F.col("c") == 0, F.xxhash64("key", "pos")).otherwise(F.col("h"))
    ordered = shared.repartition(dealt_by).sortWithinPartitions("h", "c", "key", "pos")
    found = written(ordered.mapInPandas(split, "h long, key long, pos long, part boolean"), "anchors")
    repeats = found.where("not part").select("key", F.shiftright("pos", 16).alias("start"), (F.col("pos").bitwiseAND(F.lit(255)) + LENGTH).alias("bytes"))

    parts = found.where("part")
    many = written(parts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_PARTS), "many")
    buckets = max(1, -(-parts.count() // BUCKET_PARTS))
    wanted_rows = parts.select("key").distinct().count()
    wanted = parts.groupBy("key").agg(F.collect_list(F.struct("h", "pos")).alias("parts"))
    wanted = small_enough(written(wanted, "wanted"), 64 + 40 * BUCKET_PARTS * buckets // max(1, wanted_rows))
    around = keyed.join(wanted, "key").select("key", "text", "parts")

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, places in zip(frame["key"], frame["text"], frame["parts"], strict=True):
                b = text.encode("utf-8", "surrogatepass")
                for place in places:
                    pos = place["pos"]
                    start, left, windows = pos >> 16, pos >> 8 & 255, (pos & 255) + 1
                    core = start + left
                    out.append((place["h"], key, pos, b[start:core] + b[core + CORE : start + windows - 1 + LENGTH]))
            yield pd.DataFrame(out, columns=["h", "key", "pos", "flank"])

    surroundings = around.mapInPandas(fetch, "h long, key long, pos long, flank binary").dropDuplicates(["h", "key", "pos"])
    hot = small_enough(many.withColumnRenamed("h", "_h"), 24)
    dealt = surroundings.join(hot, F.col("h") == F.col("_h"), "left")
    salt = F.pmod(F.xxhash64("key", "pos"), F.ceil(F.col("n") / BUCKET_PARTS))
    plain = F.pmod(F.xxhash64("h"), F.lit(buckets))
    dealt = dealt.select(F.when(F.col("n").isNull(), F.struct(F.lit(0).cast("long").alias("a"), plain.alias("b"))).otherwise(F.struct(F.col("h").alias("a"), salt.alias("b"))).alias("bucket"), F.col("n").isNotNull().alias("salted"), "h", "key", "pos", "flank")

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame["h"].to_numpy()
        again, rest = repeated_windows(h, frame["key"].to_numpy(), frame["pos"].to_numpy(), frame["flank"].tolist(), bool(frame["salted"].iloc[0]))
        done = pd.DataFrame(np.array(again, np.int64).reshape(-1, 3), columns=["key", "start", "bytes"]).assign(w1=pd.NA, w2=pd.NA)
        open_ = pd.DataFrame(np.array(rest, np.int64).reshape(-1, 4), columns=["key", "start", "w1", "w2"]).assign(bytes=LENGTH)
        open_["w1"] ^= h[0]  # all of a salted bucket's anchors are the same; windows of other anchors differ
        return pd.concat([x.astype({"w1": "Int64", "w2": "Int64"}) for x in (done, open_)], ignore_index=True)[["key", "start", "bytes", "w1", "w2"]]

    sorted_ = written(dealt.groupBy("bucket").applyInPandas(sort, "key long, start long, bytes long, w1 long, w2 long"), "windows")
    repeats = repeats.unionByName(sorted_.where("w1 is null").select("key", "start", "bytes"))
    across = sorted_.where("w1 is not null")
    first = across.groupBy("w1", "w2").agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = across.join(small_enough(written(first, "first"), 64), ["w1", "w2"]).where(F.struct("key", "start") != F.col("first"))
    return _runs(repeats.unionByName(late.select("key", "start", "bytes")))


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A null text counts as empty. Null ids come before all others; rows of one id are one document if their texts are
    the same, else documents of their own in the order of their texts' SHA-256. Texts shorter than LENGTH lose
    nothing; longer ones are read whole, in parts that overlap. An empty table gives no rows; other columns are not
    read, whatever their names.
    """
    with_python(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    runs = written(removed_runs(keyed), "runs")
    # A row is as large as its document has removed runs, so these are counted, not the rows.
    size = runs.agg(F.sum(F.lit(128) + 16 * F.size("starts").cast("long"))).head()[0] or 0
    runs = F.broadcast(runs) if size <= BROADCAST_BYTES else runs

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, text, starts, ends in zip(frame["doc_id"], frame["text"], frame["starts"], frame["ends"], strict=True):
                b = text.encode("utf-8", "surrogatepass")
                if starts is None:
                    kept, n = b, 0
                else:
                    edges = [0, *(int(x) for pair in zip(starts, ends, strict=True) for x in pair), len(b)]
                    kept, n = b"".join(b[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), len(starts)
                out.append((doc, len(b), len(b) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # The id is text on its way through pandas, which makes floats of integers with nulls.
    joined = keyed.join(runs, "key", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "starts", "ends")
    out = joined.mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digests(docs: DataFrame, **columns: str) -> DataFrame:
    return cut_repeats(docs, **columns).drop("kept")
