"""The engine's queries over the corpus tables. Every one reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposit.functions import scalars as X
from exposit.operators import descriptive as D
from exposit.operators import generate, ladder, metrics, ranks, retrieval, split, store, text
from exposit.plans import corpus
from exposit.sources.pages import parse_threads as parse
from exposit.sources.tables import cut, load, scratch, written
from exposit.streaming import collect

r6 = D.r6


def age_decile_likes(s: SparkSession, d: str) -> DataFrame:
    return D.by_decile(corpus.positioned(s, d))


def age_bucket_likes(s: SparkSession, d: str) -> DataFrame:
    return D.by_age_bucket(corpus.base(s, d))


def like_percentiles(s: SparkSession, d: str) -> DataFrame:
    return D.percentiles(corpus.comments(s, d), "like_count", [0.5, 0.75, 0.9, 0.95, 0.99, 0.999])


def zero_inflation(s: SparkSession, d: str) -> DataFrame:
    c = corpus.comments(s, d)
    return c.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("like_count") == 0).cast("double"))).alias("zero_share"), r6(F.avg((F.col("like_count") <= 1).cast("double"))).alias("le1_share"))


def top1pct_share(s: SparkSession, d: str) -> DataFrame:
    return D.top_share(corpus.comments(s, d), "like_count", 0.01)


def _ranks(s: SparkSession, d: str) -> DataFrame:
    return store.last_by(load(s, d, "relevance_ranks"), ["video_id", "comment_id"], ["fetched_at", "rank"], ["rank"])


def page_rank_effect(s: SparkSession, d: str) -> DataFrame:
    c = corpus.comments(s, d).select("comment_id", "video_id", "like_count")
    both = c.join(_ranks(s, d), ["video_id", "comment_id"], "left")
    return both.groupBy(F.col("rank").isNotNull().alias("on_page")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("like_count")).alias("mean_likes"))


def shorts_vs_long(s: SparkSession, d: str) -> DataFrame:
    return D.by_decile(corpus.positioned(s, d), X.is_short(F.col("duration")).alias("is_short"))


def channel_profile(s: SparkSession, d: str) -> DataFrame:
    return D.channel_profile(corpus.base(s, d), "channel")


def channel_extremes(s: SparkSession, d: str) -> DataFrame:
    """The channels with the least and the most zero-like comments, ties by name."""
    p = D.channel_profile(corpus.base(s, d), "channel")
    return p.agg(F.min(F.struct("zero_rate", "channel")).alias("a"), F.max(F.struct("zero_rate", "channel")).alias("b")).select(F.col("a.channel").alias("least_channel"), F.col("a.zero_rate").alias("least_rate"), F.col("b.channel").alias("most_channel"), F.col("b.zero_rate").alias("most_rate"))


def like_tiers(s: SparkSession, d: str) -> DataFrame:
    return corpus.comments(s, d).groupBy(D.like_tier(F.col("like_count")).alias("tier")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.length("text"))).alias("mean_chars"))


def non_ascii_share(s: SparkSession, d: str) -> DataFrame:
    return corpus.comments(s, d).agg(r6(F.avg(X.non_ascii(F.col("text")).cast("double"))).alias("share"))


def toplevel_ratio(s: SparkSession, d: str) -> DataFrame:
    n = corpus.comments(s, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    v = corpus.videos(s, d).where("status = 'done'").select("video_id", "comment_count")
    return v.join(n, "video_id").agg(F.sum("n").alias("collected"), F.sum("comment_count").alias("reported"), r6(F.try_divide(F.sum("n"), F.sum("comment_count"))).alias("ratio"))


def like_rank_target(s: SparkSession, d: str) -> DataFrame:
    return ranks.rank_percentile(corpus.base(s, d), "video_id", "like_count", "y").select("comment_id", "video_id", r6(F.col("y")).alias("y"))


def timeline_position(s: SparkSession, d: str) -> DataFrame:
    return corpus.positioned(s, d).select("comment_id", "video_id", r6(F.col("age_pct")).alias("age_pct"))


def _exposure(df: DataFrame) -> DataFrame:
    return df.withColumns({"log_age_h": F.log1p(F.greatest(F.lit(0.0), F.coalesce("age_h", F.lit(0.0)))), "log_views": X.log1p_or_0(F.col("view_count")), "log_video_comments": X.log1p_or_0(F.col("comment_count")), "is_short": X.is_short(F.col("duration")).cast("double")})


def exposure_features(s: SparkSession, d: str) -> DataFrame:
    f = _exposure(corpus.positioned(s, d))
    return f.select("comment_id", *[r6(F.col(c)).alias(c) for c in ("age_pct", "log_age_h", "log_views", "log_video_comments", "is_short")])


def _length(df: DataFrame) -> DataFrame:
    t = F.col("text")
    return df.withColumns({"log_chars": F.log1p(F.length(t)), "log_words": F.log1p(X.word_count(t)), "has_question": X.has_question(t).cast("double"), "has_caps_run": X.has_caps_run(t).cast("double")})


def length_features(s: SparkSession, d: str) -> DataFrame:
    f = _length(corpus.base(s, d))
    return f.select("comment_id", *[r6(F.col(c)).alias(c) for c in LENGTH])


def caps_run(s: SparkSession, d: str) -> DataFrame:
    c = corpus.comments(s, d)
    return c.groupBy(X.has_caps_run(F.col("text")).alias("has_caps_run")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("like_count")).alias("mean_likes"))


SALT = "fixed-test-salt:"


def _stamp(column: str):  # noqa: ANN202
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def export_comments(s: SparkSession, d: str) -> DataFrame:
    c = corpus.comments(s, d).select("comment_id", "video_id", "author_channel_id", "text", "like_count", "reply_count", "published_at", "fetched_at")
    v = corpus.videos(s, d).where("status = 'done'").select("video_id", F.col("published_at").alias("video_at"))
    both = c.join(v, "video_id").join(_ranks(s, d), ["video_id", "comment_id"], "left")
    return both.select("comment_id", "video_id", X.author_hash(F.col("author_channel_id"), SALT).alias("author_hash"), "text", "like_count", "reply_count", _stamp("published_at"), _stamp("fetched_at"), F.round(X.hours_between(F.col("published_at"), F.col("video_at")), 4).alias("age_hours"), F.col("rank").alias("relevance_rank"))


def export_videos(s: SparkSession, d: str) -> DataFrame:
    n = corpus.comments(s, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    v = corpus.videos(s, d).where("status = 'done'").join(n, "video_id", "left")
    return v.select("video_id", "channel_id", "channel_handle", "title", _stamp("published_at"), "like_count", "comments_stored", _stamp("stats_fetched_at"), "category_id", "duration", X.duration_seconds(F.col("duration")).alias("duration_seconds"), X.is_short(F.col("duration")).alias("is_short"), "view_count", "comment_count", F.coalesce("n", F.lit(0)).alias("collected"))


def collected_counts(s: SparkSession, d: str) -> DataFrame:
    n = corpus.comments(s, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return corpus.videos(s, d).select("video_id").join(n, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("collected"))


def _predicted(s: SparkSession, d: str) -> DataFrame:
    """Two plain predictors: early is better, and longer is better."""
    return corpus.positioned(s, d).select("comment_id", "video_id", "channel", "like_count", (-F.col("age_pct")).alias("early"), F.length("text").cast("double").alias("chars"))


def video_spearman(s: SparkSession, d: str) -> DataFrame:
    return metrics.spearman(_predicted(s, d), "video_id", "like_count", "early").select("video_id", "n", r6(F.col("rho")).alias("rho"))


def video_auc(s: SparkSession, d: str) -> DataFrame:
    return metrics.auc(_predicted(s, d), "video_id", F.col("like_count") >= 1, "early").select("video_id", "p", "q", r6(F.col("auc")).alias("auc"))


def _channels(s: SparkSession, d: str) -> DataFrame:
    return corpus.videos(s, d).select("video_id", F.coalesce("channel_handle", F.lit("?")).alias("channel"))


def evaluate_baseline(s: SparkSession, d: str) -> DataFrame:
    """The early predictor: mean rho and AUC over videos, and the bootstrap of rho over channels."""
    p = _predicted(s, d)
    rho = metrics.spearman(p, "video_id", "like_count", "early").join(_channels(s, d), "video_id")
    auc = metrics.auc(p, "video_id", F.col("like_count") >= 1, "early").agg(F.round(F.avg("auc"), 6).alias("auc"), F.count(F.lit(1)).alias("n_auc"))
    ci = metrics.bootstrap_ci(rho, "channel", "rho", 200)
    return ci.select(F.col("mean").alias("rho"), "lo", "hi").crossJoin(auc).crossJoin(rho.agg(F.count(F.lit(1)).alias("n_videos")))


def bootstrap_ci_channels(s: SparkSession, d: str) -> DataFrame:
    rho = metrics.spearman(_predicted(s, d), "video_id", "like_count", "early").join(_channels(s, d), "video_id")
    return metrics.bootstrap_ci(rho, "channel", "rho", 400)


def paired_delta_ci(s: SparkSession, d: str) -> DataFrame:
    p, c = _predicted(s, d), _channels(s, d)
    a = metrics.spearman(p, "video_id", "like_count", "chars").join(c, "video_id")
    b = metrics.spearman(p, "video_id", "like_count", "early").join(c, "video_id")
    return metrics.paired_delta_ci(a, b, "video_id", "channel", "rho", 400)


def bootstrap_ratio_ci(s: SparkSession, d: str) -> DataFrame:
    """Mean AUC of the two predictors as a ratio, videos resampled apart."""
    p = _predicted(s, d)
    a, b = (metrics.auc(p, "video_id", F.col("like_count") >= 1, x).select("video_id", F.round("auc", 9).alias("auc")) for x in ("early", "chars"))
    return metrics.ratio_ci(a, b, "video_id", "auc", 100)


def channel_split(s: SparkSession, d: str) -> DataFrame:
    return split.channel_split(_channels(s, d), "channel")


def nested_split(s: SparkSession, d: str) -> DataFrame:
    return split.nested_split(_channels(s, d), "channel")


def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return split.ordered_by_hash(corpus.comments(s, d).select("comment_id"), "comment_id", 7, 200)


def freeze_exclusions(s: SparkSession, d: str) -> DataFrame:
    return store.exclusions(corpus.videos(s, d), 5, 5000, 20).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def channel_cap(s: SparkSession, d: str) -> DataFrame:
    return store.exclusions(corpus.videos(s, d), 5, 5000, 20).where("reason = 'included'").select("video_id", "channel_id")


def estimated_units(s: SparkSession, d: str) -> DataFrame:
    return corpus.videos(s, d).select("video_id", X.estimated_units(F.col("comment_count")).alias("units"))


def manifest_sums(s: SparkSession, d: str) -> DataFrame:
    v = corpus.videos(s, d)
    return v.agg(F.count(F.lit(1)).alias("n_videos"), F.count_distinct("channel_id").alias("n_channels"), F.sum(X.estimated_units(F.col("comment_count"))).alias("estimated_units"), F.sum(F.coalesce("comment_count", F.lit(0))).alias("estimated_comments"))


def date_window(s: SparkSession, d: str) -> DataFrame:
    day = F.date_format("published_at", "yyyy-MM-dd")
    return corpus.videos(s, d).where(day.between("2025-09-01", "2026-02-28")).select("video_id", day.alias("day"))


def status_counts(s: SparkSession, d: str) -> DataFrame:
    return corpus.videos(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_summary(s: SparkSession, d: str) -> DataFrame:
    return store.summary(corpus.videos(s, d), corpus.comments(s, d))


def work_queue(s: SparkSession, d: str) -> DataFrame:
    """All open videos in the order in which they are collected, with their place."""
    return store.work_queue(corpus.videos(s, d)).select("video_id", "status", "comment_count")


def next_video(s: SparkSession, d: str) -> DataFrame:
    return store.next_video(corpus.videos(s, d)).select("video_id", "status")


def quota_by_day(s: SparkSession, d: str) -> DataFrame:
    return store.quota(load(s, d, "quota_ledger"), 8000)


def quota_days(s: SparkSession, d: str) -> DataFrame:
    """Units that the observed fetches would have cost by Pacific day: one per 100 observations begun."""
    n = load(s, d, "comments").groupBy(X.quota_day(F.col("fetched_at")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("day", F.ceil(F.col("n") / 100.0).cast("bigint").alias("units"))


def comment_upsert(s: SparkSession, d: str) -> DataFrame:
    """The stored state after all observations: immutable columns of the first, mutable ones of the last."""
    c = load(s, d, "comments")
    return store.upsert(c, "comment_id", ["fetched_at", "like_count", "reply_count", "updated_at"], ["like_count", "reply_count", "updated_at", "fetched_at"], ["video_id", "author_channel_id", "text", "published_at"])


def video_upsert(s: SparkSession, d: str) -> DataFrame:
    return corpus.videos(s, d).select("video_id", "channel_id", "channel_handle", "view_count", "comment_count", "status")


def rank_upsert(s: SparkSession, d: str) -> DataFrame:
    return _ranks(s, d)


def new_comments(s: SparkSession, d: str) -> DataFrame:
    """By day of fetching: observations, and those that were the first of their comment."""
    c = load(s, d, "comments").where("comment_id is not null")
    first = c.groupBy("comment_id").agg(F.min("fetched_at").alias("at")).groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("new"))
    seen = c.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count(F.lit(1)).alias("observed"))
    return seen.join(first, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "observed", F.coalesce("new", F.lit(0)).alias("new"))


def parse_threads(s: SparkSession, d: str) -> DataFrame:
    """Comments as raw pages would bring them, flattened again."""
    c = corpus.comments(s, d)
    raw = c.select(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("reply_count").cast("int").alias("totalReplyCount"), F.struct(F.col("comment_id").alias("id"), F.struct(F.lit("").alias("textDisplay"), F.col("text").alias("textOriginal"), F.col("like_count").cast("int").alias("likeCount"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.struct(F.col("author_channel_id").alias("value")).alias("authorChannelId")).alias("snippet")).alias("topLevelComment")).alias("snippet"))).alias("items"))).alias("page"))
    return parse(raw, "page").select("comment_id", "author_channel_id", F.length("text").alias("chars"), "like_count", "reply_count", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("likes"))


def knn_estimate(s: SparkSession, d: str) -> DataFrame:
    """Every vector against all others: the mean label of its 5 nearest."""
    v = _vectors(s, d)
    return retrieval.estimates(retrieval.nearest(v, v, "vec_id", "embedding", "likes", 5, skip_self=True), 5).select(F.col("query").alias("vec_id"), r6(F.col("estimate")).alias("estimate"))


def knn_pools_ratio(s: SparkSession, d: str) -> DataFrame:
    """By k: the mean estimate of the top-liked tenth of the vectors over that of all; both from one search."""
    v = _vectors(s, d)
    found = retrieval.nearest(v, v, "vec_id", "embedding", "likes", 20, skip_self=True)
    cutoff = v.agg(F.percentile("likes", 0.9).alias("cut"))
    own = v.crossJoin(F.broadcast(cutoff)).select(F.col("vec_id").alias("query"), (F.col("likes") >= F.col("cut")).alias("top"))
    ks = F.explode(F.array(F.lit(1), F.lit(5), F.lit(20))).alias("k")
    est = found.select("*", ks).where("rank <= k").groupBy("query", "k").agg(F.avg("likes").alias("e")).join(own, "query")
    out = est.groupBy("k").agg(F.avg(F.when(F.col("top"), F.col("e"))).alias("a"), F.avg("e").alias("b"))
    return out.select("k", r6(F.col("a")).alias("top_mean"), r6(F.col("b")).alias("all_mean"), r6(F.col("a") / F.greatest(F.col("b"), F.lit(1e-9))).alias("ratio"))


def estimator_skill(s: SparkSession, d: str) -> DataFrame:
    """Spearman of the k = 5 estimate with the label, over all vectors."""
    v = _vectors(s, d)
    e = retrieval.estimates(retrieval.nearest(v, v, "vec_id", "embedding", "likes", 5, skip_self=True), 5).withColumn("estimate", F.round("estimate", 9))
    both = v.join(e, F.col("vec_id") == F.col("query")).select(F.lit("all").alias("pool"), "likes", "estimate")
    return metrics.spearman(both, "pool", "likes", "estimate").select("pool", "n", r6(F.col("rho")).alias("rho"))


def _test_comments(s: SparkSession, d: str, ks: tuple[int, ...]) -> DataFrame:
    """(comment_id, video_id, y, like_count, k, estimate) of the test channels' comments: mean likes of the k nearest training comments.

    A comment's vector is the one its hash points at. The nearest comments lie on the nearest vectors that have any, so only vectors are
    searched; equal dots go by vector, then by comment.
    """
    most = max(ks)
    v = _vectors(s, d)
    f = corpus.featured(s, d)
    f = cut(f.join(split.channel_split(f, "channel"), "channel").select("comment_id", "video_id", "y", "like_count", "split", F.pmod(F.xxhash64("comment_id"), F.lit(v.count())).alias("vec_id")))
    train = f.where("split = 'train'")
    near = retrieval.nearest(v, v.join(train.select("vec_id").distinct(), "vec_id", "left_semi"), "vec_id", "embedding", "likes", most).select("query", F.col("ref").alias("vec_id"), "dot")
    first = F.row_number().over(Window.partitionBy("vec_id").orderBy("comment_id"))
    held = train.withColumn("_i", first).where(F.col("_i") <= most).select("vec_id", "comment_id", "like_count")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("dot"), "vec_id", "comment_id"))
    found = near.join(held, "vec_id").withColumn("_i", place).where(F.col("_i") <= most).select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    est = found.where(F.col("_i") <= F.col("k")).groupBy("query", "k").agg(F.round(F.avg("like_count"), 9).alias("estimate"))
    return cut(f.where("split = 'test'").join(est, F.col("vec_id") == F.col("query")).select("comment_id", "video_id", "y", "like_count", "k", "estimate"))


def circularity_pools(s: SparkSession, d: str) -> DataFrame:
    """By pool and k: the mean estimate of the top tenth of the test comments, by likes over all or by rank within the video, over that of all."""
    t = _test_comments(s, d, (1, 5, 20))
    least = t.where("k = 1").agg(F.percentile("like_count", 0.9).alias("cut"))
    pools = t.crossJoin(F.broadcast(least)).select("k", "estimate", F.explode(F.create_map(F.lit("absolute"), F.col("like_count") >= F.col("cut"), F.lit("within_video"), F.col("y") >= 0.9)).alias("pool", "top"))
    out = pools.groupBy("pool", "k").agg(F.count_if("top").alias("n_top"), F.avg(F.when(F.col("top"), F.col("estimate"))).alias("a"), F.avg("estimate").alias("b"))
    return out.select("pool", "k", "n_top", r6(F.col("a")).alias("top_mean"), r6(F.col("b")).alias("all_mean"), r6(F.col("a") / F.greatest(F.col("b"), F.lit(1e-9))).alias("ratio"))


def circularity_skill(s: SparkSession, d: str) -> DataFrame:
    """Spearman of the k = 5 estimate with likes over all test comments, n of them, and its mean within n videos."""
    t = _test_comments(s, d, (5,))
    pooled = metrics.spearman(t.withColumn("pool", F.lit("pooled")), "pool", "like_count", "estimate").select("pool", "n", r6(F.col("rho")).alias("rho"))
    within = metrics.spearman(t, "video_id", "y", "estimate").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rho")).alias("rho"))
    return pooled.union(within.select(F.lit("within_video").alias("pool"), "n", "rho"))


def pairwise_cosine(s: SparkSession, d: str) -> DataFrame:
    return retrieval.mean_pairwise_cosine(load(s, d, "embeddings"), "embedding", "label")


def vocabulary_topn(s: SparkSession, d: str) -> DataFrame:
    """The 500 most frequent words and pairs of all comments, as written; ``vocabulary_all`` has all terms, without accents."""
    c = corpus.comments(s, d).select("comment_id", "text")
    return text.vocabulary(text.term_counts(c, "comment_id", F.col("text"), 2), 5, 500)


def tfidf_weights(s: SparkSession, d: str) -> DataFrame:
    """Weights of the 500 most frequent words in all comments, as written; ``tfidf_all`` has all terms, without accents."""
    c = corpus.comments(s, d).select("comment_id", "text")
    counts = text.term_counts(c, "comment_id", F.col("text"))
    return text.tfidf(counts, text.vocabulary(counts, 5, 500), "comment_id", c.count()).select("comment_id", "term", r6(F.col("weight")).alias("weight"))


def _all_terms(s: SparkSession, d: str) -> DataFrame:
    """The counts of the words and pairs of all comments, without accents."""
    return text.term_counts(text.plain(corpus.comments(s, d), "comment_id", "text"), "comment_id", F.col("text"), 2)


def vocabulary_all(s: SparkSession, d: str) -> DataFrame:
    """Words and pairs of all comments in any script, up to the stated limit of the vocabulary."""
    return text.vocabulary(_all_terms(s, d), 5, text.MAX_FEATURES)


def tfidf_all(s: SparkSession, d: str) -> DataFrame:
    """Weights of the terms of ``vocabulary_all`` in all comments."""
    counts = _all_terms(s, d)
    vocab = cut(text.vocabulary(counts, 5, text.MAX_FEATURES))
    return text.tfidf(counts, vocab, "comment_id", corpus.comments(s, d).count()).select("comment_id", "term", r6(F.col("weight")).alias("weight"))


def scaled_features(s: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of the exposure features, and the largest scaled value; a constant feature scales to 0."""
    f = _exposure(corpus.positioned(s, d))
    names = ("age_pct", "log_age_h", "log_views", "log_video_comments", "is_short")
    long = f.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("feature", "v"))
    return long.groupBy("feature").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), r6(F.coalesce(F.try_divide(F.max("v") - F.avg("v"), F.stddev_pop("v")), F.lit(0.0))).alias("max_scaled"))


EXPOSURE = ["age_pct", "log_age_h", "log_views", "log_video_comments", "is_short"]
LENGTH = ["log_chars", "log_words", "has_question", "has_caps_run"]


def _ladder_input(s: SparkSession, d: str, tfidf: bool, embed: bool) -> dict[str, DataFrame]:
    """Features, target and split of every comment in the feature base, without and with each vector; its embedding is the one its hash points at."""
    f = _length(_exposure(corpus.featured(s, d)))
    parts = split.nested_split(f, "channel")
    own = written(f.join(parts, "channel").select("comment_id", "video_id", "channel", "text", "y", "like_count", "split", *EXPOSURE, *LENGTH), "ladder")
    df = ladder.scaled(own, [*EXPOSURE, *LENGTH])
    frames = {"": df.drop("text")}
    if tfidf:
        frames["tfidf"] = ladder.sparse_tfidf(df, "comment_id", "text", 5, text.MAX_FEATURES, "split = 'fit'")
    if embed:
        v = load(s, d, "embeddings")
        frames["embedding"] = ladder.with_vectors(frames[""].withColumn("vec_id", F.pmod(F.xxhash64("comment_id"), F.lit(v.count()))), v, "vec_id", "embedding")
    return frames


def _rungs(*names: str) -> list[tuple[str, list[str], bool]]:
    every = {"exposure": EXPOSURE, "length": [*EXPOSURE, *LENGTH], "tfidf": [*EXPOSURE, *LENGTH, "tfidf"], "embed": [*EXPOSURE, *LENGTH, "embedding"]}
    return [(n, every[n], n == "tfidf") for n in names]


def ridge_ladder(s: SparkSession, d: str) -> DataFrame:
    rows, _ = ladder.run(_ladder_input(s, d, True, True), _rungs("exposure", "length", "tfidf", "embed"))
    return s.createDataFrame(rows, "rung string, alpha double, n_videos bigint, rho double, rho_lo double, rho_hi double, auc double, auc_lo double, auc_hi double, worse boolean")


def gate_report(s: SparkSession, d: str) -> DataFrame:
    rows, per_video = ladder.run(_ladder_input(s, d, True, True), _rungs("length", "tfidf", "embed"), 200)
    return s.createDataFrame(ladder.gate(rows, per_video, "length", 2000), "rung string, delta double, lo double, hi double, p_gt_0 double, passes boolean, text_share_of_auc double")


def auc_share_split(s: SparkSession, d: str) -> DataFrame:
    rows, _ = ladder.run(_ladder_input(s, d, False, True), _rungs("exposure", "length", "embed"), 50)
    parts = ladder.share_split(*[r["auc"] or 0.5 for r in rows])
    return s.createDataFrame([(k, round(v, 6)) for k, v in parts.items()], "part string, share double")


def retrieval_score_table(s: SparkSession, d: str) -> DataFrame:
    """Retrieval scores at k = 5 by label, and the ratio of their mean to that of all with its interval."""
    v = _vectors(s, d)
    e = cut(retrieval.estimates(retrieval.nearest(v, v, "vec_id", "embedding", "likes", 5, skip_self=True), 5).join(v, F.col("query") == F.col("vec_id")).select("vec_id", "likes", "estimate"))
    table = generate.score_table(e, "likes", "estimate")
    ratio = metrics.ratio_ci(e.where("likes >= 5"), e, "vec_id", "estimate", 2000)
    return table.crossJoin(F.broadcast(ratio))


def stream_collect(s: SparkSession, d: str) -> DataFrame:
    """All observations as raw pages of up to 100, streamed into an observation log; the state it ends in."""
    c = load(s, d, "comments").where("comment_id is not null")
    thread = F.struct(F.struct(F.col("reply_count").cast("int").alias("totalReplyCount"), F.struct(F.col("comment_id").alias("id"), F.struct(F.col("text").alias("textDisplay"), F.col("like_count").cast("int").alias("likeCount"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.col("updated_at").alias("updatedAt"), F.struct(F.col("author_channel_id").alias("value")).alias("authorChannelId")).alias("snippet")).alias("topLevelComment")).alias("snippet"))
    # The page of a comment goes by its hash within video and time of fetching, so a hot video's pages are made by many tasks.
    size = c.groupBy("video_id", "fetched_at").agg(F.ceil(F.count(F.lit(1)) / 50.0).alias("pages"))
    paged = c.join(size, ["video_id", "fetched_at"]).withColumn("no", F.pmod(F.xxhash64("comment_id"), "pages"))
    pages = paged.groupBy("video_id", "fetched_at", "no").agg(F.to_json(F.struct(F.collect_list(thread).alias("items"))).alias("page")).drop("no")
    folder = scratch(s, "collect")
    pages.write.parquet(f"{folder}/pages")
    stream = s.readStream.schema(pages.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/pages")
    collect.collect(stream, folder)
    return collect.state(folder, s).select("comment_id", "video_id", "like_count", "reply_count", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))


def generate_stub(s: SparkSession, d: str) -> DataFrame:
    """Prompts with and without 12 top-liked examples for a sample of 120 finished videos, completed by the stub."""
    f = corpus.featured(s, d).where(F.col("y") >= 0.95).select("comment_id", "text")
    v = corpus.videos(s, d).where("status = 'done'").select("video_id", "title")
    return generate.complete(generate.prompts(f, v, 12, 120, 2)).select("video_id", "condition", "sample", F.length("prompt").alias("prompt_chars"), "text", "tokens", "cost_usd")
