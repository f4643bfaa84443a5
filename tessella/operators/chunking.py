"""Sentence-aware chunking as one fold over an ordered array: no shuffle, and no Python but for tables of plain texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def section_kind(location: Column) -> Column:
    """Kind of an extractor's section label, the first that fits."""
    label = F.lower(F.coalesce(location, F.lit("")))
    has = lambda s: F.contains(label, F.lit(s))
    return (
        F.when(F.contains(F.concat(F.lit(" "), label), F.lit(" table")), "table").when(has("header"), "header").when(has("footer"), "footer")
        .when(has("footnote") | has("endnote"), "footnote").when(has("text box"), "text_box").when(has("transcript"), "transcript").otherwise("body")
    )


def span_label(locations: Column) -> Column:
    """First label, or first and last when these differ; blank ones don't count."""
    named = F.filter(locations, lambda x: F.coalesce(x, F.lit("")) != "")
    first, last = F.get(named, F.lit(0)), F.element_at(named, -1)
    return F.when(F.size(named) == 0, "").when(first == last, first).otherwise(F.concat(first, F.lit(" – "), last))


_CUTS = "array<struct<first:int,last:int>>"


def chunk_array(sections: Column, target: Column | None = None, overlap: int = 1) -> Column:
    """array<struct<location,text>> of chunks, from array<struct<location,text>> sections in order.

    Sentences fill a chunk up to the target across sections of one kind. A chunk begins with the last `overlap`
    sentences of the one before unless these leave no room, the kind changed or an over-long sentence came between.
    """
    def prepared(clean: Column) -> Column:
        size = target if target is not None else X.chunk_target(F.array_join(F.transform(clean, lambda s: s.text), "\n"))
        units = F.flatten(F.transform(clean, lambda s: F.transform(X.sentences(s.text), lambda x: F.struct(s.location.alias("location"), x.alias("sentence"), section_kind(s.location).alias("kind")))))
        return X.let(F.struct(units.alias("units"), size.cast("int").alias("size")), lambda p: _pack(p.units, p.size, overlap))

    clean = F.transform(sections, lambda s: F.struct(s.location.alias("location"), X.normalise_horizontal(F.coalesce(s.text, F.lit(""))).alias("text")))
    return X.let(F.filter(clean, lambda s: s.text != ""), prepared)


def _pack(units: Column, size: Column, overlap: int) -> Column:
    """Chunks of units: a fold over the sentences' lengths finds the cuts, and each chunk is then put together once.

    A cut (first, last) is a run of units; one with last = -1 is the over-long unit `first`.
    """
    marks = F.transform(units, lambda u, i: F.struct(i.cast("int").alias("at"), F.length(u.sentence).alias("n"), u.kind.alias("kind")))
    return X.let(F.struct(units.alias("units"), marks.alias("marks"), size.alias("size")), lambda p: _joined(p.units, _cuts(p.marks, p.size, overlap), p.size))


def _cuts(marks: Column, size: Column, overlap: int) -> Column:
    zero = F.lit(0)
    # The open chunk is units first..at - 1, of `used` characters with a space after each; none is open at first = at.
    start = F.struct(F.array().cast(_CUTS).alias("cuts"), zero.alias("first"), zero.alias("used"), F.lit("").alias("kind"))
    pair = lambda first, last: F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))

    def step(acc: Column, u: Column) -> Column:
        some = acc.first < u.at
        more = u.n + 1
        goes_on = (u.n <= size) & (~some | ((acc.kind == u.kind) & (acc.used + more <= size)))
        closed = F.when(some, F.concat(acc.cuts, pair(acc.first, u.at - 1))).otherwise(acc.cuts)
        back = F.greatest(acc.first, u.at - overlap)
        carried = F.aggregate(F.slice(marks, back + 1, u.at - back), zero, lambda n, m: n + m.n + 1) if overlap > 0 else zero
        keeps = (acc.kind == u.kind) & (carried + more <= size)
        struct = lambda cuts, first, used: F.struct(cuts.alias("cuts"), first.cast("int").alias("first"), used.cast("int").alias("used"), u.kind.alias("kind"))
        opened = X.let(F.struct(closed.alias("cuts"), keeps.alias("keeps"), carried.alias("carried")), lambda o: struct(o.cuts, F.when(o.keeps, back).otherwise(u.at), F.when(o.keeps, o.carried).otherwise(zero) + more))
        return F.when(goes_on, struct(acc.cuts, acc.first, acc.used + more)).when(u.n > size, struct(F.concat(closed, pair(u.at, F.lit(-1))), u.at + 1, zero)).otherwise(opened)

    end = F.size(marks)
    return F.aggregate(marks, start, step, lambda acc: F.when(acc.first < end, F.concat(acc.cuts, pair(acc.first, end - 1))).otherwise(acc.cuts))


def _joined(units: Column, cuts: Column, size: Column) -> Column:
    def long(u: Column) -> Column:
        return F.transform(X.split_long(u.sentence, size), lambda p: F.struct(u.location.alias("location"), p.alias("text")))

    def run(part: Column) -> Column:
        return F.array(F.struct(span_label(F.transform(part, lambda u: u.location)).alias("location"), F.array_join(F.transform(part, lambda u: u.sentence), " ").alias("text")))

    made = F.transform(cuts, lambda c: F.when(c.last < 0, long(F.get(units, c.first))).otherwise(run(F.slice(units, c.first + 1, c.last - c.first + 1))))
    return F.filter(F.flatten(made), lambda c: c.text != "")


def chunk_text(text: Column, target: Column | None = None, overlap: int = 1) -> Column:
    """array<string> of chunks of one unlabelled text."""
    one = F.array(F.struct(F.lit("").alias("location"), text.alias("text")))
    return F.transform(chunk_array(one, target, overlap), lambda c: c.text)


def chunk_sources(sources: DataFrame, location: str = "document", target: Column | None = None, overlap: int = 1) -> DataFrame:
    """Rows (all columns of sources but text, chunk_index, location, text) numbered from 0 in each source."""
    kept = [c for c in sources.columns if c != "text"]
    if target is None:
        # One section a text, the length by its own script: what the fold says is found many times faster in plain steps.
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([cut_text(t or "", overlap) for t in texts], dtype=object)

        found = sources.select(*kept, F.posexplode(F.pandas_udf(cut, "array<string>")("text")).alias("chunk_index", "text"))
        return found.select(*kept, "chunk_index", F.lit(location or "").alias("location"), "text")
    sections = F.array(F.struct(F.lit(location).alias("location"), F.col("text").alias("text")))
    return sources.select(*kept, F.posexplode(chunk_array(sections, target, overlap)).alias("chunk_index", "chunk")).select(*kept, "chunk_index", "chunk.location", "chunk.text")


#: Blanks that X.normalise_horizontal makes one, but for those that are one already; what ends a sentence; soft breaks.
_BLANKS = re.compile(r"[\t\r\f\v][ \t\r\f\v]*| [ \t\r\f\v]+")
_END = re.compile(r"[.!?](?=\s|$)|[。！？](?![。！？])|\n+")
_SOFT = re.compile("[，、；,;]")
_HAN = re.compile(f"[{X.HAN}]")


def cut_text(text: str, overlap: int = 1) -> list[str]:
    """What chunk_text says of one text: str.strip takes the characters of X.WS."""
    text = _BLANKS.sub(" ", text).strip()
    size = X.CJK_TARGET if not text.isascii() and len(_HAN.findall(text)) / max(1, len(text)) >= X.CJK_SHARE else X.LATIN_TARGET
    units, at = [], 0
    for m in _END.finditer(text):
        units.append(text[at : m.end()].strip())
        at = m.end()
    units.append(text[at:].strip())
    units = [u for u in units if u]
    out, first, used = [], 0, 0
    for at, unit in enumerate(units):
        n = len(unit)
        if n > size:
            out += [" ".join(units[first:at]), *_split_long(unit, size)] if first < at else _split_long(unit, size)
            first, used = at + 1, 0
        elif first == at or used + n + 1 <= size:
            used += n + 1
        else:
            out.append(" ".join(units[first:at]))
            back = max(first, at - overlap)
            carried = sum(len(u) + 1 for u in units[back:at])
            first, used = (back, carried + n + 1) if carried + n + 1 <= size else (at, n + 1)
    return [*out, " ".join(units[first:])] if first < len(units) else out


def _split_long(sentence: str, size: int) -> list[str]:
    """What X.split_long says of one sentence."""
    pieces, held = [], ""
    for part in _SOFT.split(sentence):
        if len(held) + len(part) >= size:
            pieces.append(held.strip())
            held = part
        else:
            held += part
    pieces.append(held.strip())
    cuts = (p[k : k + size].strip() for p in pieces for k in range(0, len(p), size))
    return [c for c in cuts if c]
