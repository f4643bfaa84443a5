"""Extraction and layout: captions, HTML text, tables and page geometry as columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

#: File kinds that are read, and what begins a caption file's metadata blocks.
SUFFIXES = [".pdf", ".txt", ".md", ".markdown", ".docx", ".html", ".htm", ".srt", ".vtt"]
BLOCK_HEADS = ["WEBVTT", "NOTE", "STYLE", "REGION"]
LINE_TOLERANCE, PARAGRAPH_GAP = 3.0, 12.0


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(SUFFIXES)


def captions(raw: Column) -> Column:
    """Spoken text of a caption file: no headers, blocks, cues, numbers, tags, nor the same line twice in a row."""
    lines = F.transform(F.split(raw, r"\R"), X.strip)
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        head = F.exists(F.array(*map(F.lit, BLOCK_HEADS)), lambda h: F.startswith(x, h))
        skip = F.when(x == "", False).when(head, True).otherwise(acc.skip)
        said = X.strip(F.regexp_replace(x, "<[^>]*>", ""))
        keep = ~skip & (x != "") & ~F.contains(x, F.lit("-->")) & ~x.rlike(r"^\p{Nd}+$") & (said != "") & ~said.eqNullSafe(F.try_element_at(acc.out, F.lit(-1)))
        return F.struct(skip.alias("skip"), F.when(keep, F.concat(acc.out, F.array(said))).otherwise(acc.out).alias("out"))

    return F.array_join(F.aggregate(lines, start, step, lambda a: a.out), "\n")


def render_table(rows: Column) -> Column:
    """array<array<string>> as lines of cells under a heading; rows without text drop out."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: X.collapse(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    return F.when(F.size(clean) == 0, "").otherwise(F.concat(F.lit("Table:\n"), F.array_join(F.transform(clean, lambda r: F.array_join(r, " | ")), "\n")))


def outside_boxes(words: DataFrame, boxes: DataFrame, page: str = "page") -> DataFrame:
    """Words whose centre lies in no box of their page, borders included."""
    w = words.alias("w")
    x, y = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.top") + F.col("w.bottom")) / 2
    inside = (F.col(f"w.{page}") == F.col(f"b.{page}")) & (x >= F.col("b.x0")) & (x <= F.col("b.x1")) & (y >= F.col("b.top")) & (y <= F.col("b.bottom"))
    return w.join(boxes.alias("b"), inside, "left_anti")


def lines_of(words: DataFrame, page: str = "page", *keys: str) -> DataFrame:
    """(page, keys, top, bottom, text) lines: a word belongs to the line while it is near the top of the line's first word.

    keys: columns that tell pages of the same number apart, the file's path among many files.
    """
    item = F.struct("top", "x0", "bottom", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    pages = words.groupBy(page, *keys).agg(F.array_sort(F.collect_list(item)).alias("ws"))
    kind = "array<struct<top:double,x0:double,bottom:double,text:string>>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(kind).alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        same = (F.size(acc.cur) > 0) & (F.abs(w.top - F.get(acc.cur, F.lit(0)).top) <= LINE_TOLERANCE)
        out = F.when(same | (F.size(acc.cur) == 0), acc.out).otherwise(F.concat(acc.out, F.array(acc.cur)))
        return F.struct(out.alias("out"), F.when(same, F.concat(acc.cur, F.array(w))).otherwise(F.array(w)).alias("cur"))

    folded = F.aggregate("ws", start, step, lambda a: F.concat(a.out, F.array(a.cur)))
    line = pages.select(page, *keys, F.explode(folded).alias("l"))
    ordered = F.array_sort(F.transform("l", lambda w: F.struct(w.x0.alias("x0"), w.top.alias("top"), w.text.alias("text"))))
    text = F.array_join(F.filter(F.transform(ordered, lambda w: w.text), lambda t: t != ""), " ")
    return line.select(page, *keys, F.array_min(F.transform("l", lambda w: w.top)).alias("top"), F.array_max(F.transform("l", lambda w: w.bottom)).alias("bottom"), text.alias("text")).where("text <> ''")


def paragraphs_of(lines: DataFrame, page: str = "page", *keys: str) -> DataFrame:
    """(page, keys, nr, top, location, text): a gap above the limit between a line and the one before begins a paragraph."""
    w = Window.partitionBy(page, *keys).orderBy("top", "text")
    new = F.when(F.col("top") - F.lag("bottom").over(w) > PARAGRAPH_GAP, 1).otherwise(0)
    numbered = lines.withColumn("_new", new).withColumn("nr", 1 + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = numbered.groupBy(page, *keys, "nr").agg(F.min("top").alias("top"), F.array_sort(F.collect_list(F.struct("top", "text"))).alias("ls"))
    return g.select(page, *keys, "nr", "top", F.concat(F.lit("page "), F.col(page).cast("string"), F.lit(" paragraph "), F.col("nr").cast("string")).alias("location"), F.array_join(F.transform("ls", lambda x: x.text), "\n").alias("text"))


def interleave(paragraphs: DataFrame, tables: DataFrame, page: str = "page") -> DataFrame:
    """Paragraphs and tables of a page by their tops, paragraphs first on ties, blank ones dropped: page, place, location, text."""
    both = paragraphs.select(page, "top", F.lit(0).alias("kind"), "location", "text").unionByName(tables.select(page, "top", F.lit(1).alias("kind"), "location", "text")).where("trim(text) <> ''")
    return both.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("top", "kind", "location"))).select(page, "place", "location", "text")


#: Patterns that tell a meeting's record, and what a model says when it is none.
STRONG = ["會議逐字稿", "會議(紀錄|記錄)", "meeting (transcript|minutes|notes)"]
LIKELY = [
    "會議(逐字稿|紀錄|記錄|主題|主席|主持|議程)", "與會(者|人員)", "出席(者|人員)", "列席", "決議", "行動項目", "待辦", "未決事項", "follow[- ]?up",
    "action item", "meeting (transcript|minutes|notes|agenda)", "attendee[s]?", "participant[s]?", "decision[s]?",
]
SPEAKER = r"(?mi)^\s*(?:主持人|主席|與會者|參與者|講者|發言人|記錄|紀錄|Speaker|Host|Moderator|Participant|Attendee)\s*[：:]\s*\S"
TIMESTAMP = r"(?:^|\s)(?:\d{1,2}:){1,2}\d{2}(?:\s|$)|\[\s*\d{1,2}:\d{2}(?::\d{2})?\s*\]"
ACTIONS = r"(?im)^\s*(?:[-*]|\d+[.)])\s*(?:TODO|待辦|決議|action|follow)"
DECLINES = ["不像會議", "不是會議", "不屬於會議", "not look like a meeting", "does not look like a meeting", "not a meeting transcript", "not meeting notes"]
MEETING_SCORE = 4


def meeting_score(sample: Column) -> Column:
    s = F.substring(F.coalesce(sample, F.lit("")), 1, 12_000)
    low = F.lower(s)
    n = lambda p: F.regexp_count(s, F.lit(p))
    score = F.lit(0)
    for weight, patterns in ((4, STRONG), (2, LIKELY)):
        for p in patterns:
            score = score + F.when(low.rlike(p), weight).otherwise(0)
    score = score + F.when(n(SPEAKER) >= 3, 4).when(n(SPEAKER) >= 1, 2).otherwise(0) + F.when(n(TIMESTAMP) >= 3, 3).when(n(TIMESTAMP) >= 1, 1).otherwise(0)
    return score + F.when(n(ACTIONS) > 0, 2).otherwise(0)


def declines_meeting(minutes: Column) -> Column:
    low = F.lower(X.strip(F.coalesce(minutes, F.lit(""))))
    return F.exists(F.array(*map(F.lit, DECLINES)), lambda m: F.contains(low, m))
