"""Pieces of SQL text that say in DuckDB's dialect what the text functions say in Spark's."""

from __future__ import annotations

from ..functions.text import STOPWORDS

WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HAN = r"\x{4e00}-\x{9fff}"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
MARK = "\x01"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '[{WS}]+', ' ', 'g'))"


def horizontal(e: str) -> str:
    return strip(rf"regexp_replace({e}, '[ \t\r\f\x0b]+', ' ', 'g')")


def sentences(e: str) -> str:
    marked = rf"regexp_replace(regexp_replace({e}, '([.!?])([{WS}])', '\1{MARK}\2', 'g'), '([。！？]+|\n+)', '\1{MARK}', 'g')"
    return f"list_filter(list_transform(string_split({marked}, '{MARK}'), lambda x: {strip('x')}), lambda x: x <> '')"


def cjk_ratio(e: str) -> str:
    return f"(length({e}) - length(regexp_replace({e}, '[{HAN}]', '', 'g'))) / greatest(1, length({e}))::DOUBLE"


def split_long(e: str, target: str) -> str:
    """As text.split_long, over a list of structs (o, b)."""
    parts = f"list_transform(string_split_regex({e}, '[，、；,;]'), lambda f: {{'o': []::VARCHAR[], 'b': f}})"
    zero = "{'o': []::VARCHAR[], 'b': ''}"
    s = strip("a.b")
    fold = (
        f"list_reduce(list_prepend({zero}, {parts}), lambda a, f: CASE WHEN length(a.b || f.b) >= {target} "
        f"THEN {{'o': CASE WHEN {s} <> '' THEN list_append(a.o, {s}) ELSE a.o END, 'b': f.b}} ELSE {{'o': a.o, 'b': a.b || f.b}} END)"
    )
    pieces = f"list_transform([{fold}], lambda a: CASE WHEN {s} <> '' THEN list_append(a.o, {s}) ELSE a.o END)[1]"
    cuts = f"list_transform({pieces}, lambda p: list_transform(range(0, (length(p) - 1) // {target} + 1), lambda i: {strip(f'substring(p, (i * {target} + 1)::BIGINT, {target})')}))"
    return f"list_filter(flatten({cuts}), lambda p: p <> '')"


def chunks(e: str, target: str) -> str:
    """As chunking.chunk_text: the list of chunks of a normalised text."""
    unit = f"{{'o': []::VARCHAR[], 'b': x, 'l': '', 'p': CASE WHEN length(x) > {target} THEN {split_long('x', target)} ELSE []::VARCHAR[] END}}"
    zero = "{'o': []::VARCHAR[], 'b': '', 'l': '', 'p': []::VARCHAR[]}"
    none = "[]::VARCHAR[]"
    done = "CASE WHEN a.b <> '' THEN list_append(a.o, a.b) ELSE a.o END"
    fold = (
        f"list_reduce(list_prepend({zero}, list_transform({sentences(e)}, lambda x: {unit})), lambda a, x: CASE "
        f"WHEN length(x.b) > {target} THEN {{'o': list_concat({done}, x.p), 'b': '', 'l': '', 'p': {none}}} "
        f"WHEN a.b = '' THEN {{'o': a.o, 'b': x.b, 'l': x.b, 'p': {none}}} "
        f"WHEN length(a.b) + length(x.b) + 2 <= {target} THEN {{'o': a.o, 'b': a.b || ' ' || x.b, 'l': x.b, 'p': {none}}} "
        f"WHEN length(a.l) + length(x.b) + 2 <= {target} THEN {{'o': list_append(a.o, a.b), 'b': a.l || ' ' || x.b, 'l': x.b, 'p': {none}}} "
        f"ELSE {{'o': list_append(a.o, a.b), 'b': x.b, 'l': x.b, 'p': {none}}} END)"
    )
    return f"list_transform([{fold}], lambda a: {done})[1]"


def latin_tokens(e: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_.\-]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"


def grams(s: str, n: int) -> str:
    return f"list_transform(range(1, greatest(1, length({s}) - {n} + 2)), lambda i: substring({s}, i, {n}))"


def search_tokens(e: str) -> str:
    han = f"regexp_replace({e}, '[^{HAN}]', '', 'g')"
    return f"list_concat({latin_tokens(e)}, list_filter(list_concat({grams(han, 2)}, {grams(han, 3)}), lambda t: t NOT IN ({STOP})))"


def snippet(e: str, limit: int = 80) -> str:
    s = collapse(e)
    head = f"substring({s}, 1, {limit})"
    back = f"regexp_replace({head}, ' [^ ]*$', '')"
    return f"CASE WHEN length({s}) <= {limit} THEN {s} WHEN {back} = '' THEN {head} ELSE {back} END"


def keyword(tokens: str, low_query: str, have: str, low_text: str) -> str:
    """Keyword score of one query's tokens against a text's."""
    hits = f"len(list_filter({tokens}, lambda t: list_contains({have}, t)))"
    return f"CASE WHEN len({have}) = 0 OR len({tokens}) = 0 THEN 0.0 ELSE least(1.0, {hits} / len({tokens})::DOUBLE + CASE WHEN contains({low_text}, {low_query}) THEN 0.15 ELSE 0.0 END) END"
