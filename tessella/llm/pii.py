"""Personal data in texts: spans by rule, and spans that a linear-chain conditional random field adds.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers; each is written so that its work is linear in
the text. The field reads word shapes: whether a token is letters (by case and length), digits (by length, and whether
they may be an octet or pass Luhn's test) or a sign, and whether white space precedes it. It is trained by gradient on
the log-likelihood from a small labelled table, at most `LABELLED` windows of each kind and as many of none, in one
bounded task, and finds what the rules let go: numbers that a rule runs together with their neighbours, other ways to
write a prefix or an at sign.

Everything that a span of these kinds can be holds a digit, an at sign or the word "at" (`plausible` asks for it), so the
field decodes (Viterbi, many windows at once in numpy) the surroundings of every one of these in the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_python, written

#: Fixed values of the operator's contract: kinds in order, and the rules.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are taken whole, which is what a greedy search from the left takes.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Windows of each kind, and of none, that the field is trained on; each has LABELLED_CHARS characters at most.
LABELLED, LABELLED_CHARS = 150, 300
#: Characters around a digit, an at sign or the word "at" that a window takes in.
AROUND = 48
#: A longer window is decoded a stretch at a time, each with this much of its neighbours.
STRETCH, OVERLAP = 2_048, 256
#: Windows that are decoded together.
BATCH = 2_048

Span = tuple[int, int, int]


# the rules


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(start, kind, end, holds) of every match of a rule; one that fails its test is dropped and not tried again."""
    for s, e in emails(text):
        yield s, 0, e, True
    for m in IP.finditer(text):
        yield m.start(), 1, m.end(), all(map(octet, m.groups()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[ -]", "", m.group())
            yield m.start(), 2, m.end(), 14 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield m.start(), 3, m.end(), 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the matches that hold, by start, then kind."""
    return sorted((s, k, e) for s, k, e, holds in matches(text) if holds)


# tokens, shapes, windows

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
TRIGGER = re.compile(r"[0-9@]+|\bat\b")
#: What the windows of the labelled table lie around.
SIGN = re.compile("[0-9@]+")
_SIGNS = {c: k for k, c in enumerate("@.-+():/,;_\"'#=&*!?%$|")}
_LETTERS, _DIGITS = 16, 28
#: Shapes: letters, digits, signs, others, each with and without white space before; 0 stands for no token.
SHAPES = 1 + 2 * (_LETTERS + _DIGITS + len(_SIGNS) + 1)
#: Labels: outside, and beginning and inside of each kind.
LABELS = 1 + 2 * len(KINDS)


def shape(token: str, spaced: bool) -> int:
    if token[0] in "0123456789":
        n = len(token)
        kind = min(n, 20) - 1 if n != 3 or int(token) <= 255 else 20
        if 14 <= n <= 19 and luhn(token):
            kind = 21 + n - 14
        kind += _LETTERS
    elif token[0].isalpha():
        case = 0 if token.islower() else 2 if token.isupper() else 1 if token[0].isupper() and token[1:].islower() else 3
        n = len(token)
        kind = 4 * case + (0 if n == 1 else 1 if n <= 3 else 2 if n <= 8 else 3)
    else:
        kind = _LETTERS + _DIGITS + _SIGNS.get(token, len(_SIGNS))
    return 1 + 2 * kind + spaced


def tokens(text: str, begin: int, end: int) -> tuple[list[int], list[int], list[int]]:
    """Starts, ends and shapes of the tokens in a stretch of the text."""
    starts, ends, shapes, last = [], [], [], begin
    for m in TOKEN.finditer(text, begin, end):
        s, e = m.span()
        starts.append(s)
        ends.append(e)
        shapes.append(shape(m.group(), s > last))
        last = e
    return starts, ends, shapes


def windows(text: str, trigger: re.Pattern = TRIGGER) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, own begin, own end) around all digits, at signs and words "at"; long ones in stretches that overlap."""
    begin = end = -1
    for m in trigger.finditer(text):
        s, e = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if s > end:
            if end >= 0:
                yield from _stretches(begin, end)
            begin = s
        end = e
    if end >= 0:
        yield from _stretches(begin, end)


def _stretches(begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    for own in range(begin, end, STRETCH):
        yield max(begin, own - OVERLAP), min(end, own + STRETCH + OVERLAP), own, min(end, own + STRETCH)


# the field


@dataclass
class Field:
    """Weights of shapes at five places, of pairs of neighbouring shapes, and of steps from label to label."""

    single: np.ndarray
    pair: np.ndarray
    step: np.ndarray

    @staticmethod
    def empty() -> Field:
        return Field(np.zeros((5, SHAPES, LABELS)), np.zeros((2, SHAPES * SHAPES, LABELS)), np.zeros((LABELS, LABELS)))

    def parts(self) -> list[np.ndarray]:
        return [self.single, self.pair, self.step]


def _allowed() -> np.ndarray:
    """Where a step may lead: the inside of a kind follows its beginning or inside alone. Label 0 stands before the first."""
    out = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = False
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return out


ALLOWED = _allowed()


def _places(shapes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each token: the shapes at the five places, and the two pairs, as indices into the weights."""
    n, t = shapes.shape
    wide = np.zeros((n, t + 4), np.int64)
    wide[:, 2:-2] = shapes
    around = [wide[:, k : k + t] for k in range(5)]
    return around, [around[1] * SHAPES + around[2], around[2] * SHAPES + around[3]]


def _emissions(field: Field, shapes: np.ndarray) -> np.ndarray:
    around, pairs = _places(shapes)
    return sum(field.single[k][x] for k, x in enumerate(around)) + sum(field.pair[k][x] for k, x in enumerate(pairs))


def _batch(rows: list[list[int]], fill: int = 0) -> np.ndarray:
    out = np.full((len(rows), max(1, max(map(len, rows)))), fill, np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def viterbi(field: Field, rows: list[list[int]]) -> list[np.ndarray]:
    """The likeliest labels of each sequence of shapes."""
    shapes = _batch(rows)
    emit, lengths = _emissions(field, shapes), np.array([len(r) for r in rows])
    step = np.where(ALLOWED, field.step, -np.inf)
    score, back = step[0] + emit[:, 0], np.zeros(emit.shape, np.int8)
    for t in range(1, emit.shape[1]):
        way = score[:, :, None] + step
        back[:, t] = way.argmax(axis=1)
        moved = np.take_along_axis(way, back[:, t, None, :].astype(np.int64), axis=1)[:, 0] + emit[:, t]
        score = np.where((t < lengths)[:, None], moved, score)
    label, out = score.argmax(axis=1), np.zeros(shapes.shape, np.int8)
    every = np.arange(len(rows))
    for t in range(emit.shape[1] - 1, -1, -1):
        inside = t < lengths
        out[inside, t] = label[inside]
        label = np.where(inside, back[every, t, label], label) if t else label
    return [out[k, :n] for k, n in enumerate(lengths.tolist())]


def gradient(field: Field, shapes: np.ndarray, labels: np.ndarray, mask: np.ndarray, l2: float) -> tuple[float, Field]:
    """The penalised negative log-likelihood of the labels, for each token, and its gradient."""
    n, t = shapes.shape
    emit = _emissions(field, shapes)
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    step = np.where(ALLOWED, np.exp(field.step), 0)
    ahead, scale = np.zeros((t, n, LABELS)), np.ones((t, n))
    for i in range(t):
        a = (step[0] if i == 0 else ahead[i - 1] @ step) * e[:, i]
        scale[i] = np.where(mask[:, i], a.sum(axis=1), 1)
        ahead[i] = np.where(mask[:, i, None], a / scale[i][:, None], ahead[i - 1] if i else 0)
    behind, steps = np.ones((n, LABELS)), np.zeros((LABELS, LABELS))
    marginal = np.zeros((n, t, LABELS))
    for i in range(t - 1, -1, -1):
        m = mask[:, i, None]
        marginal[:, i] = np.where(m, ahead[i] * behind, 0)
        weighed = np.where(m, e[:, i] * behind / scale[i][:, None], 0)
        if i:
            steps += (ahead[i - 1].T @ weighed) * step
        else:
            steps[0] += (weighed * step[0]).sum(axis=0)
        behind = np.where(m, weighed @ step.T, behind) if i else behind
    total = mask.sum()
    before = np.concatenate((np.zeros((n, 1), np.int64), labels[:, :-1]), axis=1)
    truth = np.take_along_axis(emit - top, labels[:, :, None], axis=2)[:, :, 0] + field.step[before, labels]
    loss = (np.log(scale).sum() - (truth * mask).sum()) / total
    np.put_along_axis(marginal, labels[:, :, None], np.take_along_axis(marginal, labels[:, :, None], axis=2) - mask[:, :, None], axis=2)
    np.add.at(steps, (before[mask], labels[mask]), -1)
    out, flat = Field.empty(), marginal.reshape(-1, LABELS)
    around, pairs = _places(shapes)
    for table, index in ((out.single, around), (out.pair, pairs)):
        for k, x in enumerate(index):
            for label in range(LABELS):
                table[k][:, label] = np.bincount(x.ravel(), flat[:, label], len(table[k]))
    out.step = steps
    for g, w in zip(out.parts(), field.parts(), strict=True):
        g /= total
        g += l2 * w
        loss += l2 / 2 * float((w * w).sum())
    return loss, out


def fit(rows: list[tuple[list[int], list[int]]], rounds: int = 60, rate: float = 0.2, l2: float = 1e-5) -> Field:
    """The field for sequences of (shapes, labels), by Adam over all of them; rows come in a fixed order."""
    shapes, labels = _batch([s for s, _ in rows]), _batch([l for _, l in rows])
    mask = _batch([[1] * len(s) for s, _ in rows]).astype(bool)
    field = Field.empty()
    mean, square = Field.empty().parts(), Field.empty().parts()
    for k in range(1, rounds + 1):
        _, g = gradient(field, shapes, labels, mask, l2)
        for w, m, v, d in zip(field.parts(), mean, square, g.parts(), strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return field


# the labelled table


def labels_of(starts: list[int], ends: list[int], spans: list[Span]) -> list[int]:
    """A label for each token: of the span that it overlaps, if any."""
    out, k = [], 0
    spans, before = sorted(spans), None
    for s, e in zip(starts, ends, strict=True):
        while k < len(spans) and spans[k][2] <= s:
            k += 1
        span = spans[k] if k < len(spans) and spans[k][0] < e else None
        out.append(0 if span is None else 1 + 2 * span[1] + (span == before))
        before = span
    return out


def labelled(docs: DataFrame, text_col: str = "text", each: int = LABELLED) -> DataFrame:
    """(text, spans, h): a small labelled table, `each` windows of every kind and of none, chosen by a hash of their text.

    Labels come from the rules. A window in which a phone number was dropped teaches nothing and is left out; dropped
    card numbers and addresses are not personal data and stay, unlabelled. Tasks keep `each` of a kind, so little moves.
    """
    with_python(docs.sparkSession)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[int, tuple[str, str]]] = [{} for _ in range(len(KINDS) + 1)]
        for frame in frames:
            for text in frame["text"].tolist():
                found = sorted(matches(text))
                for begin, end, _, _ in windows(text, SIGN):
                    end = min(end, begin + LABELLED_CHARS)
                    here = [m for m in found if m[2] > begin and m[0] < end] if found else []
                    if any(m[1] == 3 and not m[3] or m[0] < begin or m[2] > end for m in here):
                        continue
                    spans = _apart([(s - begin, k, e - begin) for s, k, e, holds in here if holds])
                    window = text[begin:end]
                    h = int.from_bytes(hashlib.blake2b(window.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
                    for k in {x[1] for x in spans} or {len(KINDS)}:
                        held[k][h] = window, written_spans(spans)
                        if len(held[k]) > 4 * each:
                            held[k] = {h: held[k][h] for h in sorted(held[k])[:each]}
        rows = [(k, h, *held[k][h]) for k in range(len(held)) for h in sorted(held[k])[:each]]
        yield pd.DataFrame(rows, columns=["k", "h", "text", "spans"])

    made = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(pick, "k int, h long, text string, spans string")
    made = written(made, "windows")
    parts = [made.where(F.col("k") == k).dropDuplicates(["h"]).orderBy("h").limit(each) for k in range(len(KINDS) + 1)]
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0].select("text", "spans", "h").dropDuplicates(["h"])


def _apart(spans: list[Span]) -> list[Span]:
    """Spans by start without those that overlap an earlier one."""
    out: list[Span] = []
    for s in sorted(spans):
        if not out or s[0] >= out[-1][2]:
            out.append(s)
    return out


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def read_spans(spans: str) -> list[Span]:
    found = [x.split(":") for x in spans.split(",") if x]
    return [(int(s), KINDS.index(k), int(e)) for k, s, e in found]


def variations(rows: list[tuple[str, list[Span]]]) -> Iterator[tuple[str, list[Span]]]:
    """Each labelled text, and other ways to write it: a phone number's plus as 00 or left out, an at sign in words, a phone
    number with an address or a card number right behind it."""
    tails = [(text[s:e], k) for text, spans in rows for s, k, e in spans if k in (1, 2)]
    for n, (text, spans) in enumerate(rows):
        yield text, spans
        changed = {0: (("@", " at "), ("@", " (at) ")), 3: (("+", "00"), ("+", ""))}
        for s, k, e in spans:
            for old, new in changed.get(k, ()):
                at = text.index(old, s, e)
                grown = len(new) - len(old)
                moved = [(a + grown * (a > at), kind, b + grown * (b > at)) for a, kind, b in spans]
                yield text[:at] + new + text[at + len(old) :], moved
            if k == 3 and tails:
                tail, kind = tails[n % len(tails)]
                grown = len(tail) + 1
                moved = [(a + grown * (a >= e), c, b + grown * (b > e)) for a, c, b in spans]
                yield f"{text[:e]} {tail}{text[e:]}", sorted([*moved, (e + 1, kind, e + grown)])


def train(table: DataFrame) -> Field | None:
    """The field, fitted in one task on a small labelled table (text, spans, h); none without labelled rows."""
    with_python(table.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(t, read_spans(s)) for f in frames for t, s in zip(f["text"].tolist(), f["spans"].tolist(), strict=True)]
        sequences = []
        for text, spans in variations(rows):
            starts, ends, shapes = tokens(text, 0, len(text))
            if shapes:
                sequences.append((shapes, labels_of(starts, ends, spans)))
        if any(any(l) for _, l in sequences):
            yield pd.DataFrame([[w.astype(np.float32).tobytes() for w in fit(sequences).parts()]], columns=["single", "pair", "step"])

    made = table.repartition(1).sortWithinPartitions("h").mapInPandas(run, "single binary, pair binary, step binary").head()
    if made is None:
        return None
    return Field(*(np.frombuffer(made[c], np.float32).reshape(w.shape) for c, w in zip(("single", "pair", "step"), Field.empty().parts(), strict=True)))


# finding


def plausible(kind: int, found: str) -> bool:
    """What an added span must hold to be of its kind at all."""
    digits = re.sub("[^0-9]", "", found)
    if kind == 0:
        return bool(re.search(r"[^\s.]\s*(?:@|\(?\bat\b\)?)\s*[^\s.]+\.[A-Za-z]", found))
    if kind == 1:
        numbers = re.findall("[0-9]+", found)
        return len(numbers) == 4 and all(map(octet, numbers)) and found.count(".") == 3
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def added_spans(field: Field | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """The spans that the field finds in each text beside the rules' spans, none of them overlapping another."""
    out: list[list[Span]] = [[] for _ in texts]
    if field is None:
        return out
    held: list[tuple[int, int, int, list[int], list[int], list[int]]] = []

    def decode() -> None:
        held.sort(key=lambda w: len(w[5]))
        for k in range(0, len(held), BATCH):
            some = [w for w in held[k : k + BATCH] if w[5]]
            for (i, own, end, starts, ends, _), labels in zip(some, viterbi(field, [w[5] for w in some]) if some else [], strict=True):
                for s, kind, e in _labelled_spans(labels, starts, ends):
                    if own <= s < end and plausible(kind, texts[i][s:e]):
                        out[i].append((s, kind, e))
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for begin, end, own, own_end in windows(text):
            held.append((i, own, own_end, *tokens(text, begin, end)))
            size += end - begin
            if size > 1 << 20:
                decode()
                size = 0
    decode()
    return [[s for s in _apart(found) if not _meets(s, known)] for found, known in zip(out, base, strict=True)]


def _meets(span: Span, known: list[Span]) -> bool:
    return any(s < span[2] and span[0] < e for s, _, e in known)


def _labelled_spans(labels: np.ndarray, starts: list[int], ends: list[int]) -> Iterator[Span]:
    for k in np.flatnonzero(labels % 2).tolist():
        kind, last = int(labels[k]) // 2, k
        while last + 1 < len(labels) and labels[last + 1] == labels[k] + 1:
            last += 1
        yield starts[k], kind, ends[last]


def personal_data(docs: DataFrame, table: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the rules' spans, and all spans.

    table: labelled rows (text, spans, h) to train on; by default windows of docs. A null text counts as empty and has no
    spans; null and repeated ids are rows like any other, equal texts have equal spans. Texts of any length are read
    whole: rules are linear in the text, the field decodes long stretches of numbers piece by piece with overlap. A
    table without anything to learn from adds no spans; an empty table gives no rows. Only id and text are read.
    """
    with_python(docs.sparkSession)
    field = train(labelled(docs, text_col) if table is None else table)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            base = [base_spans(t) for t in texts]
            more = added_spans(sent.value, texts, base)
            out = {"doc_id": frame["doc_id"]}
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[1] == k for s in found) for found in base]
            out["base_sha256"] = [hashlib.sha256(written_spans(found).encode()).hexdigest() for found in base]
            out["spans"] = [written_spans(sorted(a + b)) for a, b in zip(base, more, strict=True)]
            yield pd.DataFrame(out)

    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = f"doc_id string, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return texts.mapInPandas(find, shape).withColumn("doc_id", F.col("doc_id").cast("long"))
