"""An inverted index for substring search by tenant: words, the chunks that have them, and the grams that words have.

A search token is a run of letters, digits and a few signs, so a text contains it exactly if one of the text's own such
runs does. Tokens are therefore looked for in the dictionary of distinct runs, by their rarest gram, and compared there;
texts are not read. Only the newest chunks of a tenant are ever wanted, so a run keeps the newest `depth` of each tenant.

A token that is frequent in a tenant would match too many runs, but then its newest chunks are near the end: it is
looked for in the tenant's `RECENT` newest chunks first, a fixed number however large the tenant is, and is settled if
enough of those have it. What is left is rare.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import store
from .matching import like_any, top

#: Newest chunks of each tenant that are searched directly.
RECENT = 400
RUN = r"[\p{L}\p{N}_.\-]+"


class Postings(NamedTuple):
    """recent (user_id, id, text, low); words (user_id, word, ids: the newest `depth`); grams (gram, word)."""

    recent: DataFrame
    words: DataFrame
    grams: DataFrame
    depth: int


def grams_of(word: Column) -> Column:
    """The distinct grams of two and of three characters."""

    def cut(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - n + 1)), lambda i: F.substring(word, i, F.lit(n)))

    return F.array_distinct(F.concat(cut(2), cut(3)))


def build(chunks: DataFrame, depth: int, keep: Callable[[str, Callable[[], DataFrame]], DataFrame]) -> Postings:
    """The index of chunks (id, user_id, text), each table made through keep(name, make).

    Postings of a word are cut to the newest ones before they are shuffled. Tables are sorted by what they are looked
    up by, so that files and row groups of other keys are passed over.
    """
    spark = chunks.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def recent() -> DataFrame:
        return top(chunks.select("user_id", "id", "text"), ["user_id"], [F.desc("id")], RECENT).select("user_id", "id", "text", F.lower("text").alias("low")).repartition(parts, "id")

    def words() -> DataFrame:
        each = chunks.select("user_id", "id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(RUN), 0))).alias("word"))
        newest = top(each, ["user_id", "word"], [F.desc("id")], depth)
        return newest.groupBy("user_id", "word").agg(F.collect_list("id").alias("ids")).repartition(parts, "word").sortWithinPartitions("word")

    found = keep("words", words)

    def grams() -> DataFrame:
        return found.select("word").distinct().select(F.explode(grams_of(F.col("word"))).alias("gram"), "word").repartitionByRange(parts, "gram").sortWithinPartitions("gram")

    return Postings(keep("recent", recent), found, keep("grams", grams), depth)


def newest_with(index: Postings, asked: DataFrame) -> DataFrame:
    """(user_id, token, id): of each tenant's token (user_id, token), as asked, the newest `depth` chunks that contain it.

    Tokens are in lower case; an underscore in one stands for any character, also one between runs, so such a token, if
    it isn't settled by the recent chunks, comes back with id null and has to be looked for in the texts.
    """
    asked = store.written(asked.select("user_id", "token").distinct())
    small = store.small_enough(asked, 100)
    lately = index.recent.join(small, "user_id").where(like_any(F.col("text"), F.col("low"), F.array("token"))).select("user_id", "token", "id")
    lately = store.written(top(lately, ["user_id", "token"], [F.desc("id")], index.depth))
    settled = lately.where(F.col("_rank") == index.depth).select("user_id", "token")
    left = store.written(asked.join(settled, ["user_id", "token"], "left_anti"))
    odd = left.where(F.contains("token", F.lit("_")))
    plain = left.where(~F.contains("token", F.lit("_")))
    # A token's rarest gram, by the number of words that have it; a gram that no word has settles that there are none.
    gram = plain.select("token").distinct().select("token", F.explode(grams_of(F.col("token"))).alias("gram")).where((F.length("gram") == 3) | (F.length("token") == 2))
    wanted = store.written(gram)
    sizes = index.grams.join(store.small_enough(wanted.select("gram").distinct(), 50), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(sizes, "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("token", F.col("g.gram").alias("gram"))
    matched = index.grams.join(store.small_enough(store.written(rarest), 100), "gram").where(F.contains("word", F.col("token"))).select("token", "word")
    pairs = store.written(plain.join(matched, "token"))
    hits = index.words.join(store.small_enough(pairs, 150), ["user_id", "word"]).select("user_id", "token", F.explode("ids").alias("id")).distinct()
    rare = top(hits, ["user_id", "token"], [F.desc("id")], index.depth).select("user_id", "token", "id")
    done = lately.join(store.small_enough(settled, 100), ["user_id", "token"], "left_semi")
    return done.select("user_id", "token", "id").unionByName(rare).unionByName(odd.select("user_id", "token", F.lit(None).cast("long").alias("id")))
