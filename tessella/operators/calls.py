"""Calls of a model over many prompts, and the flow from ranked chunks to an answer."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval as R
from .embedding import IN_FLIGHT, in_flight, with_retry


def ask(prompts: DataFrame, model: Callable[[str], str] | None, *, key: str, prompt: str, bound: int = IN_FLIGHT, wait: float = 0.5) -> DataFrame:
    """(key, reply, error): the model's reply to each prompt, up to `bound` calls of a task at a time.

    A call that fails for a while is made again. One that fails for good, or the lack of a model, is an error of at most
    500 characters and no reply; the others go on. A null prompt is not sent and has neither.
    """
    field = prompts.schema[key].dataType.simpleString()

    def one(name, text) -> tuple:
        if text is None:
            return name, None, ""
        try:
            if model is None:
                raise ValueError("no model is configured")
            return name, with_retry(lambda: model(text), base=wait), ""
        except Exception as e:  # noqa: BLE001 - one call must not end the others
            return name, None, (str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}")[:500]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            calls = (functools.partial(one, name, text) for name, text in zip(frame["k"], frame["p"], strict=True))
            yield pd.DataFrame(list(in_flight(calls, bound)), columns=[key, "reply", "error"])

    return prompts.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(run, f"{key} {field}, reply string, error string")


def answers(ranked: DataFrame, questions: DataFrame, model: Callable[[str], str] | None, *, abstain: str = "", params: R.RetrievalParams = R.RetrievalParams(), wait: float = 0.5) -> DataFrame:
    """(question_id, outcome, top_score, answer, error, citations) for each question.

    The gate comes first: a question without chunks, or whose best score is low, is not sent to the model and gets the
    text for abstaining and no citation. The others are asked with their numbered excerpts; citations are those that the
    answer's markers name, all of them if it has none. A call that failed has an error and neither answer nor citation.
    """
    gated = R.gate(ranked, questions, params)
    sent = ranked.join(gated.where("outcome = 'answered'").select("question_id"), "question_id", "left_semi")
    replies = ask(R.answer_prompt(sent, questions), model, key="question_id", prompt="prompt", wait=wait)
    cited = R.citations(sent).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("index", "source_id", "chunk_id", "snippet", "score"))).alias("_all"))
    out = gated.join(replies, "question_id", "left").join(cited, "question_id", "left")
    none = F.filter("_all", lambda c: F.lit(False))
    kept = F.when(F.col("reply").isNull(), none).otherwise(R.citation_filter(F.col("reply"), F.col("_all")))
    answer = F.when(F.col("outcome") == "answered", F.col("reply")).otherwise(F.lit(abstain))
    return out.select("question_id", "outcome", "top_score", answer.alias("answer"), F.coalesce("error", F.lit("")).alias("error"), kept.alias("citations"))
