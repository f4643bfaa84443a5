"""Token alignment against plain loops over the libraries' own output."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import alignment, queries
from tessella.llm.common import table

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = alignment._byte_letters()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokens(text):
    """[(id, start, end)] of each tokenizer over the bytes of space and text; nothing if either changes the bytes."""
    out = []
    raw = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(f" {text}", add_special_tokens=False).ids]
    out.append(raw)
    out.append([(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)])
    if not text or any(b"".join(x for _, x in side) != f" {text}".encode() for side in out):
        return [], []
    spans = []
    for side in out:
        at, found = 0, []
        for i, x in side:
            found.append((i, at, at + len(x)))
            at += len(x)
        spans.append(found)
    return spans


def truth(rows):
    laid, count = [], collections.Counter()
    for doc, text in rows:
        a, b = tokens(text or "")
        links, k = [], 0
        for i, s, e in a:
            while k and b[k - 1][2] > s:
                k -= 1
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    links.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        by_a, by_b = collections.defaultdict(list), collections.defaultdict(list)
        for side, by in ((a, by_a), (b, by_b)):
            g = 0
            for i, _, e in side:
                by[g].append(str(i))
                g += e == cuts[g]
        groups = [f"{','.join(by_a[g])}|{','.join(by_b[g])}" for g in range(len(cuts))]
        count.update(links)
        laid.append((doc, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = collections.Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(((d, na, nb, ng, len(l), sum(count[x] == top[x[1]] for x in l), sum(count[x] for x in l), h) for d, na, nb, ng, l, h in laid), key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_whole_table(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, data_dir, "documents").collect()]
    want = truth(rows)
    assert any(w[1] and w[5] < w[4] for w in want)
    assert found(queries.op12_alignment(spark, data_dir)) == want


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, monkeypatch, small):
    """White space and scripts of all kinds; small: few pairs are broadcast, parts are forgotten soon, stretches are short."""
    if small:
        for name, value in (("HOT_PAIRS", 40), ("HELD_PARTS", 20), ("STRETCH", 30), ("LOOKED_UP", 7)):
            monkeypatch.setattr(alignment, name, value)
    rng = random.Random(5)
    signs = [*"aaeinrst,.!'", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", " ", "é", "ß", "東", "京", "😀", "9", "2024", "<s>", "</s>", "<|endoftext|>", "<0x41>", "'ll", "\x00", "́", "don't "]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, None), (1, ""), (1, " "), (1, "   \n "), (None, "same"), (None, "same"), (7, "has a ▁ sign"), ((1 << 62) + 1, "word " * 30_000), (8, "x" * 20_000), (9, "▁")]
    df = spark.createDataFrame([(*r, *["?"] * 4) for r in rows], "doc_id long, text string, row string, pair string, n string, n_a string")
    want = truth(rows)
    assert found(alignment.alignment(df, queries._two_tokenizers)) == want
    assert [w for w in want if w[0] in (7, 9) and w[1] == 0]
    assert alignment.alignment(df.limit(0), queries._two_tokenizers).collect() == []


def test_tokenizers_that_cannot_be_cut(spark):
    """Whole texts as parts give the same rows."""
    def whole():
        a, b = queries._two_tokenizers()
        return alignment.Coder(a.encode, a.tokens, False), b

    rows = [(i, f"Some words, {i} of them  and\nmore; ça va?") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(alignment.alignment(df, whole)) == truth(rows)


def test_parts_put_together_are_the_text():
    rng = random.Random(2)
    for _ in range(2_000):
        text = "".join(rng.choice("ab  \n\t　.") for _ in range(rng.randint(0, 30)))
        assert "".join(f" {p}" for some in alignment.parts(text) for p in some) == f" {text}"
