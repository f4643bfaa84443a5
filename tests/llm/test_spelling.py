"""Spelling variants against a plain count of words and pairs of them one edit apart."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import queries, spelling
from tessella.llm.common import table

LETTERS = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]


def truth(rows):
    """{word: (n, n_near, form, form_n, root)} of (doc_id, text) rows, by trying every edit of every word."""
    count = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in LETTERS} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in LETTERS}
        near[w] = sorted((-n[x], x) for x in made - {w} if x in n)
        form[w] = near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def found(df):
    got = [(r.word, (r.n, r.n_near, r.form, r.form_n, r.root)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_whole_table(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, data_dir, "documents").collect()]
    want = truth(rows)
    assert sum(x[2] is not None for x in want.values()) > 10
    assert found(queries.op11_spelling(spark, data_dir)) == want


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_chains_ties_and_repeated_letters(spark, block, monkeypatch):
    """Words of few letters, so that many are near each other; blocks so small that a word takes several."""
    monkeypatch.setattr(spelling, "BLOCK_CANDIDATES", block)
    monkeypatch.setattr(spelling, "BLOCK_CHARS", block)
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 6))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words[: 2 + i % 149]) for _ in range(80))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = truth(rows)
    assert max(x[1] for x in want.values()) > 5
    assert any(x[2] and x[2] != x[4] for x in want.values())
    assert found(spelling.variants(df)) == want


def test_odd_and_empty_tables(spark):
    long_word = "xy" * 200
    rows = [(None, "Apples apples, APPLES"), (None, None), (1, ""), (1, "applex applex applex"), (1, "applex applex applex"), (2, f"{long_word} {long_word}z " * 3), (3, "Étude Étude Étude étude étude étude"), ((1 << 62) + 1, "a-b_c d1e " * 30_000)]
    df = spark.createDataFrame([(*r, *["?"] * 4) for r in rows], "doc_id long, text string, word string, n string, root string, near string")
    got = found(spelling.variants(df))
    assert got == truth(rows)
    assert got[long_word][1] == 1 and "Étude" in got and got["Étude"][1] == 1
    assert spelling.variants(df.limit(0)).collect() == []


def test_filter_never_misses(monkeypatch):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))) for _ in range(3_000)})
    h = spelling.word_hashes(words)
    assert len(set(h.tolist())) == len(words)
    for log in (0, 3):
        bits = np.zeros((1 << log) << (spelling.SLICE_LOG - 3), np.uint8)
        for place in spelling.Filter.places(h):
            at = (spelling.Filter.slice_of(h, log) << np.uint64(spelling.SLICE_LOG - 3)) + (place >> np.uint64(3))
            np.bitwise_or.at(bits, at.astype(np.int64), (np.uint64(1) << (place & np.uint64(7))).astype(np.uint8))
        seen = spelling.Filter(bits, log)
        assert len(seen.may_hold(h)) == len(words)
        others = spelling.word_hashes([w + "z" for w in words])
        assert len(seen.may_hold(others)) < 0.2 * len(words)
