"""The queries of this package over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposit.llm import abuse, language, neardup, packing, pii, quality, splits, tokens, topn
from exposit.sources.tables import cut, load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = neardup.near_duplicates(load(spark, sf_dir, "comments"), "comment_id", "text")
    return neardup.pairs_of(links, members).select(F.col("a").alias("comment_id_a"), F.col("b").alias("comment_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each long comment with its author, class, group and number of linked classes."""
    comments = load(spark, sf_dir, "comments")
    links, members = neardup.near_duplicates(comments, "comment_id", "text")
    authors = comments.groupBy("comment_id").agg(F.max("author_channel_id").alias("author_channel_id"))
    return neardup.groups_of(links, members).join(authors, F.col("key") == F.col("comment_id")).select("comment_id", "author_channel_id", "class", "group", "links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = load(spark, sf_dir, "comments").where(F.col("comment_id").isNotNull())
    return pii.entities(comments, "comment_id", "text").select("comment_id", "kind", "item").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment's text with typed placeholders."""
    comments = load(spark, sf_dir, "comments").where(F.col("comment_id").isNotNull())
    return pii.redacted(comments, "comment_id", "text").dropDuplicates(["comment_id"])


def _language_model(spark: SparkSession, sf_dir: str) -> tuple[language.Model, DataFrame]:
    """The model fitted on declared comments, and (comment_id, text, code) of every declared comment."""
    declared = load(spark, sf_dir, "comment_langs").select("comment_id", language.label_code(F.col("lang")).alias("code"))
    comments = load(spark, sf_dir, "comments").select("comment_id", "text")
    rows = cut(comments.join(declared, "comment_id").dropDuplicates(["comment_id", "code"]))
    return language.fit_on(rows, "comment_id", "text", "code"), rows


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _language_model(spark, sf_dir)
    found = language.segments(rows, "comment_id", "text", model).select("comment_id", "lang")
    return language.misdeclared(found, rows.select("comment_id", "code"), "comment_id")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of every comment and of each stretch of it, with confidence."""
    model, _ = _language_model(spark, sf_dir)
    comments = load(spark, sf_dir, "comments").groupBy("comment_id").agg(F.max("text").alias("text"))
    return language.segments(comments, "comment_id", "text", model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = splits.creator_groups(load(spark, sf_dir, "videos"), load(spark, sf_dir, "channels"), load(spark, sf_dir, "comments"))
    return groups


def p4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persisted spanning forest of identifiers: the edge that each component picked in each round, and what it became part of."""
    _, forest = splits.creator_groups(load(spark, sf_dir, "videos"), load(spark, sf_dir, "channels"), load(spark, sf_dir, "comments"))
    return forest


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video with its group and split, 80/10/10 of the comments."""
    comments = load(spark, sf_dir, "comments")
    groups, _ = splits.creator_groups(load(spark, sf_dir, "videos"), load(spark, sf_dir, "channels"), comments)
    weights = comments.groupBy("video_id").agg(F.count_distinct("comment_id").alias("weight"))
    return splits.deal(groups, weights, {"train": 0.8, "validation": 0.1, "test": 0.1})


def _abuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = load(spark, sf_dir, "comments").where(F.col("comment_id").isNotNull())
    return abuse.score(comments, "comment_id", "text", abuse.fit_on(comments, "comment_id", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).where("kind is not null").select("comment_id", "kind").distinct()


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment's probability of each kind."""
    return _abuse_scores(spark, sf_dir).dropDuplicates(["comment_id"])


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of flagged comments per creator, by the canonical handle of the video."""
    scored = _abuse_scores(spark, sf_dir).select("comment_id", "kind").dropDuplicates(["comment_id"])
    handles = load(spark, sf_dir, "videos").groupBy("video_id").agg(F.min(splits.canonical_handle(F.col("channel_handle"))).alias("handle"))
    owners = load(spark, sf_dir, "comments").groupBy("comment_id").agg(F.min("video_id").alias("video_id")).join(handles, "video_id", "left").select("comment_id", "handle")
    return abuse.rates(scored, owners, "comment_id", "handle")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = load(spark, sf_dir, "comments")
    # Observations are at least as many as comments, and counting them reads one column.
    sizes = comments.groupBy("video_id").count()
    return topn.top_n(topn.latest_observation(comments), "video_id", "like_count", "published_at", "comment_id", 5, sizes=sizes).select("video_id", "comment_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(load(spark, sf_dir, "documents"), "doc_id", "text")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(load(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack_items(sizes, "doc_id", "n_tokens")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, judged = quality.judge(load(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return judged.where("kind is not null").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, nearest language, distance from prose and the contributions to it."""
    stats, judged = quality.judge(load(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return stats.join(judged.select("doc_id", "nearest", "distance", "contributions", "kind"), "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_redacted, p3_found, p3_segments, p4_found, p4_forest, p4_splits, p5_found, p5_scores, p5_rates, p6_found, p7_ids, p8_pack, p9_found, p9_statistics)}

SQL: dict[str, str] = {
    "p6_found": """
        WITH last AS (
            SELECT comment_id, video_id, like_count, published_at,
                   row_number() OVER (PARTITION BY comment_id ORDER BY fetched_at DESC NULLS LAST, like_count DESC NULLS LAST, video_id DESC NULLS LAST, published_at DESC NULLS LAST) AS k
            FROM comments WHERE comment_id IS NOT NULL),
        ranked AS (
            SELECT video_id, comment_id, row_number() OVER (PARTITION BY video_id ORDER BY like_count DESC NULLS LAST, published_at ASC NULLS LAST, comment_id) AS r
            FROM last WHERE k = 1 AND video_id IS NOT NULL)
        SELECT video_id, comment_id FROM ranked WHERE r <= 5
    """,
}
