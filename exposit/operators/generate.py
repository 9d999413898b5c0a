"""Generated comments from prompts, with a pluggable model; the default is a stub, as there is no network."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def one_line(text: Column, chars: int = 200) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, chars)


def stub(prompt: str) -> tuple[str, int, float]:
    """(text, tokens, cost): an echo of the prompt's last words; costs nothing."""
    words = prompt.split()
    return f'"{" ".join(words[-6:])}"', len(words), 0.0


def prompts(examples: DataFrame, videos: DataFrame, n_examples: int, n_videos: int, samples: int, seed: int = 0) -> DataFrame:
    """(video_id, condition, sample, prompt): for sampled videos, a plain prompt and one that shows the top-liked examples.

    ``examples`` is (comment_id, text), ``videos`` (video_id, title). Both are drawn by hash, so neither draw depends on the other.
    """
    drawn = lambda df, key, n: df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), key).limit(n)
    shown = drawn(examples, "comment_id", n_examples).agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.lit("- "), one_line(F.col("text")))))).alias("shown"))
    base = drawn(videos, "video_id", n_videos).select("video_id", F.coalesce("title", F.lit("a video")).alias("title")).crossJoin(F.broadcast(shown))
    ask = F.format_string("Write one comment for the video titled: %s", one_line(F.col("title")))
    top = F.concat(F.lit("These comments got the most likes:\n"), F.col("shown"), F.lit("\n"), ask)
    rows = base.select("video_id", F.explode(F.map_from_arrays(F.array(F.lit("plain"), F.lit("top_liked")), F.array(ask, top))).alias("condition", "prompt"))
    return rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).select("video_id", "condition", "sample", "prompt")


def complete(df: DataFrame, model: Callable[[str], tuple[str, int, float]] = stub) -> DataFrame:
    """``df`` with text (quotes and blanks around it removed), tokens and cost_usd from ``model``, in Arrow batches."""

    @F.pandas_udf("text string, tokens int, cost_usd double")
    def run(prompt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model(p) for p in prompt], columns=["text", "tokens", "cost_usd"])

    out = df.withColumn("_r", run("prompt")).select("*", "_r.*").drop("_r")
    return out.withColumn("text", F.trim(F.expr("trim(both '\"' from trim(text))")))


def score_table(scores: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, median) of retrieval scores."""
    return scores.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"))


def best_per_prompt(df: DataFrame, group: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(value), "sample")
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


