"""Text functions as native column expressions: white space, sentences, tokens, scripts, snippets, JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, as the body of a regular-expression class.
WS = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
HAN = r"\u4e00-\u9fff"

#: Words that are no search tokens.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the",
    "to", "what", "when", "where", "which", "who", "why", "with", "要", "的", "是", "有", "和", "或", "在", "嗎", "呢",
]
#: Punctuation that is cut off tokens before texts are compared for overlap.
OVERLAP_STRIP = ".,;:!?()[]{}\"'`“”‘’"

CJK_SHARE, CJK_TARGET, LATIN_TARGET = 0.30, 400, 800


def let(value: Column, then) -> Column:
    """then(value) with the value computed once: inside a lambda an expression would be computed again at every use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def normalise_horizontal(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[ \t\r\f\x0B]+", " "))


def cjk_ratio(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{HAN}]")) / F.greatest(F.lit(1), F.length(c))


def is_mostly_cjk(c: Column) -> Column:
    return cjk_ratio(c) >= CJK_SHARE


def chunk_target(c: Column) -> Column:
    return F.when(is_mostly_cjk(c), CJK_TARGET).otherwise(LATIN_TARGET)


def sentences(c: Column) -> Column:
    """Sentences with their end marks, stripped: a mark class of their own ends CJK ones, white space after .!? Latin ones, newlines any."""
    # A split keeps what stands between its matches, so each match is nothing but the place behind an end mark.
    places = f"(?<=[。！？])(?![。！？])|(?<=[.!?])(?=[{WS}]|$)|\\n+"
    return F.filter(F.transform(F.split(c, places), strip), lambda x: x != "")


def split_long(c: Column, target: Column) -> Column:
    """A sentence over the target as pieces of at most it: joined fragments between soft breaks, then hard cuts."""
    start = F.struct(F.array().cast("array<string>").alias("o"), F.lit("").alias("b"))

    def step(acc: Column, x: Column) -> Column:
        full = F.length(F.concat(acc.b, x)) >= target
        done = F.when(full & (strip(acc.b) != ""), F.concat(acc.o, F.array(strip(acc.b)))).otherwise(acc.o)
        return F.struct(done.alias("o"), F.when(full, x).otherwise(F.concat(acc.b, x)).alias("b"))

    pieces = F.aggregate(F.split(c, "[，、；,;]"), start, step, lambda a: F.when(strip(a.b) != "", F.concat(a.o, F.array(strip(a.b)))).otherwise(a.o))
    cuts = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), ((F.length(p) - 1) / target).cast("int")), lambda i: strip(F.substring(p, i * target + 1, target))))
    return F.filter(F.flatten(cuts), lambda p: p != "")


def latin_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_.\-]+)"))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def ngrams(s: Column, n: int) -> Column:
    return F.when(F.length(s) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1)), lambda i: F.substring(s, i, F.lit(n))))


def cjk_ngrams(c: Column) -> Column:
    han = F.regexp_replace(c, f"[^{HAN}]", "")
    return F.concat(ngrams(han, 2), ngrams(han, 3))


def search_tokens(c: Column) -> Column:
    """Tokens in order with repeats: words, dots and dashes of the lower-cased text, then runs of two and three Han characters."""
    return F.concat(latin_tokens(c), F.filter(cjk_ngrams(c), lambda t: ~t.isin(STOPWORDS)))


def overlap_tokens(c: Column) -> Column:
    """Distinct search tokens without punctuation at their ends."""
    return F.array_distinct(F.filter(F.transform(search_tokens(c), lambda t: F.btrim(t, F.lit(OVERLAP_STRIP))), lambda t: t != ""))


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"))


def snippet(c: Column, limit: int = 80) -> Column:
    """Collapsed text cut at the limit and back to the last space before it."""
    s = collapse(F.coalesce(c, F.lit("")))
    head = F.substring(s, 1, limit)
    back = F.regexp_replace(head, " [^ ]*$", "")
    return F.when(F.length(s) <= limit, s).otherwise(F.when(back == "", head).otherwise(back))


def unique_nonempty(c: Column) -> Column:
    """Collapsed strings of an array, the first of each spelling whatever the case, in order."""
    clean = F.filter(F.transform(c, collapse), lambda x: x != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def split_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), strip), lambda x: x != "")


#: Kinds of evaluation items; the first is the default.
ITEM_TYPES = ["answerable", "cross_lingual", "unanswerable"]


def item_type(c: Column) -> Column:
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(ITEM_TYPES), t).otherwise(ITEM_TYPES[0])


def keyword_score(queries: Column, text: Column) -> Column:
    """Best query's share of tokens found in the text, and 0.15 if the whole query occurs; at most 1, 0 for a text without tokens."""
    both = F.struct(search_tokens(text).alias("have"), F.lower(text).alias("low"))
    asked = F.transform(queries, lambda q: F.struct(search_tokens(q).alias("tokens"), F.lower(q).alias("low")))
    return let(both, lambda t: keyword_score_of(asked, t.have, t.low))


def keyword_score_of(queries: Column, have: Column, low: Column) -> Column:
    def one(q: Column) -> Column:
        hits = F.size(F.filter(q.tokens, lambda t: F.array_contains(have, t)))
        boost = F.when(F.contains(low, q.low), 0.15).otherwise(0.0)
        return F.when(F.size(q.tokens) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.size(q.tokens) + boost))

    best = F.aggregate(F.transform(queries, one), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return F.when(F.size(have) == 0, 0.0).otherwise(best)


#: Han characters of the simplified script only, and the languages' names.
SIMPLIFIED = "这为与时会们问题临床试验药"
LANGUAGES = ["English", "Japanese", "Simplified Chinese", "Traditional Chinese"]


def dominant_language(c: Column) -> Column:
    """Script counts in the first 6,000 characters against ordered thresholds."""
    s = F.substring(F.coalesce(c, F.lit("")), 1, 6_000)
    latin, han, kana = (F.regexp_count(s, F.lit(p)) for p in ("[A-Za-z]", f"[{HAN}]", r"[\u3040-\u30ff]"))
    simplified = F.regexp_count(s, F.lit(f"[{SIMPLIFIED}]"))
    return (
        F.when(latin >= F.greatest(F.lit(40), (han + kana) * 2), LANGUAGES[0]).when(kana >= 8, LANGUAGES[1])
        .when(han >= 12, F.when(simplified >= 3, LANGUAGES[2]).otherwise(LANGUAGES[3])).when(latin >= 12, LANGUAGES[0]).otherwise("")
    )


def followup_language(*texts: Column) -> Column:
    return F.coalesce(*(F.nullif(dominant_language(t), F.lit("")) for t in texts), F.lit(LANGUAGES[3]))


def extract_json(c: Column) -> Column:
    """The JSON payload of plain or fenced model output: from the first opening bracket to the last closing one."""
    s = strip(c)
    inner = strip(F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*(\n|$)", ""), r"(^|\n)```[^\n]*$", ""))
    s = F.when(s.startswith("```"), inner).otherwise(s)
    first = F.regexp_instr(s, F.lit(r"[\[{]"))
    last = F.length(s) - F.regexp_instr(F.reverse(s), F.lit(r"[\]}]")) + 1
    has_end = F.regexp_instr(s, F.lit(r"[\]}]")) > 0
    cut = F.when(has_end & (last >= first), F.substring(s, first, last - first + 1)).otherwise(F.substring(s, first, F.length(s)))
    return F.when(first == 0, s).otherwise(cut)


def content_hash(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.sha2(c, 256))


def estimate_tokens(chars: Column) -> Column:
    n = F.greatest(F.coalesce(chars, F.lit(0)), F.lit(0)).cast("long")
    return F.floor((n + 3) / 4).cast("long")


def last_wins(entries: Column) -> Column:
    """A map of array<struct<key,value>>; of equal keys the last one's value stays, as in a JSON object read key by key."""

    def once(es: Column) -> Column:
        backward = F.reverse(F.transform(es, lambda e: e.key))
        return F.map_from_entries(F.filter(es, lambda e, i: F.array_position(backward, e.key) == F.size(es) - i))

    return let(entries, once)


def json_int(v: Column) -> Column:
    """A JSON value (variant) as a count: whole numbers, others without their fraction, true and false as 1 and 0, strings
    that spell a whole number; null for all else and below 0."""
    kind = F.schema_of_variant(v)
    said = strip(F.try_variant_get(v, "$", "string"))
    spelled = F.when(said.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), F.regexp_replace(said, "_", "").try_cast("long"))
    n = (
        F.when(kind == "STRING", spelled)
        .when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("long"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").try_cast("long"))
    )
    return F.when(n >= 0, n)


def optional_int(c: Column, least: int = 0) -> Column:
    n = F.expr("null").cast("long")
    value = c.try_cast("long")
    return F.when(value >= least, value).otherwise(n)
