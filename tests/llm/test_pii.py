"""Personal data: rules against plain regular expressions, the field against brute force and on held-out windows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tessella.llm import pii, queries
from tessella.llm.common import table

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """(start, kind, end) by the contract's words."""
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            holds = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if holds[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def text_of(spans):
    return ",".join(f"{[*RULES][k]}:{s}:{e}" for s, k, e in spans)


def test_whole_table(spark, data_dir):
    rows = {r.doc_id: r.text for r in table(spark, data_dir, "documents").collect()}
    got = {r.doc_id: r for r in queries.op13_pii(spark, data_dir).collect()}
    assert got.keys() == rows.keys()
    n = 0
    for doc, text in rows.items():
        base, r = plain(text or ""), got[doc]
        n += len(base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, x, _ in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert set(filter(None, text_of(base).split(","))) <= set(r.spans.split(",")) | {""}
    assert n > 5


def test_rules_on_odd_strings():
    rng = random.Random(4)
    signs = [*"0123456789", *"...@@++-- ()", "a", "Z", "é", "٣", "255", "4111111111111111", "1.2.3.4", "+1 (", "x@y.z", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text), text


def test_rules_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "a.b-c%d" * 40_000 + "@"):
        assert len(pii.base_spans(text)) < 150_000


def test_decoder_and_gradient():
    rng = np.random.default_rng(1)
    field = pii.Field(*(rng.normal(size=w.shape) for w in pii.Field.empty().parts()))
    rows = [rng.integers(1, 9, n).tolist() for n in (1, 3, 4, 2)]

    def total(shapes, labels):
        emit = pii._emissions(field, np.array([shapes]))[0]
        return sum(emit[i, l] + field.step[labels[i - 1] if i else 0, l] for i, l in enumerate(labels))

    def lawful(labels):
        return all(pii.ALLOWED[a, b] for a, b in zip((0, *labels), labels, strict=False))

    ways = [[w for w in itertools.product(range(pii.LABELS), repeat=len(r)) if lawful(w)] for r in rows]
    for row, way, got in zip(rows, ways, pii.viterbi(field, rows), strict=True):
        assert tuple(got.tolist()) == max(way, key=lambda w: total(row, w))
    labels = [w[len(w) // 2] for w in ways]
    shapes, truth, mask = pii._batch(rows), pii._batch([list(l) for l in labels]), pii._batch([[1] * len(r) for r in rows]).astype(bool)
    loss, g = pii.gradient(field, shapes, truth, mask, 0.01)
    want = sum(np.log(sum(np.exp(total(r, w)) for w in way)) - total(r, l) for r, way, l in zip(rows, ways, labels, strict=True)) / mask.sum()
    assert loss == pytest.approx(want + 0.005 * sum(float((w * w).sum()) for w in field.parts()))
    for w, d in zip(field.parts(), g.parts(), strict=True):
        for at in rng.permutation(np.flatnonzero(d))[:15]:
            kept = w.flat[at]
            sides = []
            for e in (1e-5, -1e-5):
                w.flat[at] = kept + e
                sides.append(pii.gradient(field, shapes, truth, mask, 0.01)[0])
            w.flat[at] = kept
            assert d.flat[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_held_out(spark):
    """Trained on one part of the documents, the field alone finds the others' spans and adds none to clean texts."""
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    field = pii.train(pii.labelled(docs.where("doc_id % 3 <> 0")))
    texts = [r.text for r in docs.where("doc_id % 3 = 0").collect()]
    base = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(field, texts, [[] for _ in texts])
    for k in range(4):
        known = [(i, s) for i, b in enumerate(base) for s in b if s[1] == k]
        assert len(known) > 30
        assert sum(s in alone[i] for i, s in known) >= 0.85 * len(known)
    extra = [(t[s:e], k) for t, b, found in zip(texts, base, alone, strict=True) for s, k, e in found if (s, k, e) not in b]
    assert len(extra) <= 5
    known = ["Call 0033 612 345 6789 now.", "Write to bob.smith (at) mail3.example.com today, und so.", "So +1 (843) 555-7672 170.106.47.218 and the."]
    got = pii.added_spans(field, known, [pii.base_spans(t) for t in known])
    assert [t[s:e] for t, g in zip(known, got, strict=True) for s, _, e in g] and got[2] == [(3, 3, 20)]


def test_odd_and_empty_tables(spark):
    rows = [(None, None), (1, ""), (1, "x@y.zz 1.2.3.4"), (1, "x@y.zz 1.2.3.4"), ((1 << 62) + 1, "1 2.3 @ " * 40_000), (2, "7" * 100_000), (3, "+1 (017) 555-7713")]
    df = spark.createDataFrame([(*r, *["?"] * 4) for r in rows], "doc_id long, text string, spans string, h string, k string, n_ip string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.personal_data(df).collect()), key=str)
    want = []
    for doc, text in rows:
        base = plain(text or "") if doc != 2 else []
        want.append((doc, *(sum(k == x for _, x, _ in base) for k in range(4)), hashlib.sha256(text_of(base).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pii.personal_data(df.limit(0)).collect() == []
    none = spark.createDataFrame([(1, "no such thing 12"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in pii.personal_data(none).collect()] == ["", ""]


def test_long_windows_are_decoded_whole():
    text = "1 2 3 " * 5_000
    covered = [w[2:] for w in pii.windows(text)]
    assert covered[0][0] == 0 and covered[-1][1] == len(text) and all(a[1] == b[0] for a, b in itertools.pairwise(covered))


def test_an_address_in_words_is_looked_at():
    """An address with its at sign in words, far from any digit, lay in no window."""
    text = "x " * 100 + "write to anna at example.org please" + " y" * 100
    at = text.index("anna")
    assert any(begin <= at and at + 19 <= end for begin, end, _, _ in pii.windows(text))
    assert list(pii.windows("a cat and matte hats")) == []
