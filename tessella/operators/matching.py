"""What the retrieval operators share: the first rows of groups, and substring tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before it shuffles them."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k)


def like_any(text: Column, low: Column, tokens: Column) -> Column:
    """Whether any token occurs, whatever the case; an underscore in a token stands for any character."""
    return F.exists(tokens, lambda t: F.when(F.contains(t, F.lit("_")), F.ilike(text, F.concat(F.lit("%"), t, F.lit("%")))).otherwise(F.contains(low, t)))
