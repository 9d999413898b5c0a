"""The same results in SQL, by query name."""

from __future__ import annotations

from exposit.plans.corpus import BASE_SQL, COMMENTS_SQL, VIDEOS_SQL

C, V, CV = f"WITH {COMMENTS_SQL}", f"WITH {VIDEOS_SQL}", f"WITH {COMMENTS_SQL}, {VIDEOS_SQL}"
FORM = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
SECONDS = "CASE WHEN regexp_matches(duration, '%s') THEN %s END" % (FORM, " + ".join(f"coalesce(try_cast(nullif(regexp_extract(duration, '{FORM}', {k}), '') AS bigint), 0) * {m}" for k, m in ((1, 3600), (2, 60), (3, 1))))
SHORT = f"coalesce(({SECONDS}) <= 60, false)"
DECILE = "CAST(least(10, floor(age_pct * 10) + 1) AS int)"
RANKS = "rr AS (SELECT video_id, comment_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, comment_id ORDER BY fetched_at DESC NULLS LAST, rank DESC) k FROM relevance_ranks) WHERE k = 1)"
PRED = BASE_SQL + """, p AS (SELECT comment_id, video_id, channel, like_count, -age_pct AS early, CAST(length(text) AS double) AS chars FROM f)"""
AVG_RANK = "(rank() OVER (PARTITION BY video_id ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY video_id, {x}) - 1) / 2.0)"


def _rho(pred: str) -> str:
    return f"SELECT video_id, count(*) AS n, covar_pop(ry, rp) / (stddev_pop(ry) * stddev_pop(rp)) AS rho FROM (SELECT video_id, {AVG_RANK.format(x='like_count')} AS ry, {AVG_RANK.format(x=pred)} AS rp FROM p) GROUP BY video_id HAVING count(*) >= 20 AND stddev_pop(ry) > 0 AND stddev_pop(rp) > 0"


def _auc(pred: str) -> str:
    return f"SELECT video_id, p, q, (s - p * (p + 1) / 2) / (p * q) AS auc FROM (SELECT video_id, CAST(sum((like_count >= 1)::int) AS bigint) AS p, CAST(sum((like_count < 1)::int) AS bigint) AS q, sum((like_count >= 1)::int * (r + 1)) AS s FROM (SELECT *, {AVG_RANK.format(x=pred)} AS r FROM p) GROUP BY video_id) WHERE p >= 5 AND q >= 5"


CHANNELS = "ch AS (SELECT video_id, coalesce(channel_handle, '?') AS channel FROM cv)"
DRAW = "('0x' || substr(md5({key}), 1, 8))::bigint % n"


def _boot(values: str, n_boot: int, seed: int = 0) -> str:
    """CTEs from ``values``, a CTE (channel, x), to bm (b, x): the mean of each channel resample."""
    key = DRAW.format(key=f"'{seed}:' || b || ':' || j")
    return f"""sums AS (SELECT channel, sum(x) AS s, count(*) AS c FROM {values} WHERE x IS NOT NULL GROUP BY channel),
        num AS (SELECT channel, s, c, row_number() OVER (ORDER BY channel) - 1 AS k FROM sums),
        dr AS (SELECT b, {key} AS k FROM (SELECT t.b, j.k AS j, (SELECT count(*) FROM num) AS n FROM range({n_boot}) t(b), num j)),
        bm AS (SELECT b, sum(s) / sum(c) AS x FROM dr JOIN num USING (k) GROUP BY b)"""


BOOT_OUT = "SELECT (SELECT round(sum(s) / sum(c), 6) FROM sums) AS mean, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi, round(avg((x > 0)::int::double), 6) AS p_gt_0 FROM bm"
ASCII = r"NOT regexp_matches(text, '[^\x00-\x7F]')"
WORD = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]{2,}"
TERMS1 = f"t AS (SELECT comment_id, term, count(*) AS tf FROM (SELECT comment_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM cc) GROUP BY ALL)"
LIST2 = f"w AS (SELECT comment_id, regexp_extract_all(lower(text), '{WORD}') AS l FROM cc), x AS (SELECT comment_id, unnest(l) AS term FROM w UNION ALL SELECT comment_id, unnest([l[i] || ' ' || l[i + 1] for i in range(1, len(l))]) AS term FROM w), t AS (SELECT comment_id, term, count(*) AS tf FROM x GROUP BY ALL)"
WHITE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
CAPS = f"len(list_filter(regexp_split_to_array(text, '{WHITE}'), lambda w: length(w) > 3 AND regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]'))) > 0"
#: Pacific days by the rule of daylight saving time since 2007: from 10:00 UTC on March's second Sunday to 9:00 UTC on November's first.
SUNDAY = "make_date(year({at})::bigint, {month}, {day}) + CAST((7 - dayofweek(make_date(year({at})::bigint, {month}, {day}))) % 7 AS int)"
PACIFIC = "strftime({at} - to_hours(CASE WHEN {at} >= CAST(" + SUNDAY.replace("{month}", "3").replace("{day}", "8") + " AS timestamp) + INTERVAL 10 HOUR AND {at} < CAST(" + SUNDAY.replace("{month}", "11").replace("{day}", "1") + " AS timestamp) + INTERVAL 9 HOUR THEN 7 ELSE 8 END), '%Y-%m-%d')"
EXPOSURE = f"log_age AS (SELECT *, ln(1 + greatest(0, coalesce(age_h, 0))) AS log_age_h, ln(1 + greatest(0, coalesce(view_count, 0))) AS log_views, ln(1 + greatest(0, coalesce(comment_count, 0))) AS log_video_comments, CAST({SHORT} AS int)::double AS is_short FROM f)"
NEAR = "e AS (SELECT vec_id, CAST(embedding AS double[64]) AS v, label::double AS likes FROM embeddings), nn AS (SELECT a.vec_id AS q, b.likes, row_number() OVER (PARTITION BY a.vec_id ORDER BY array_inner_product(a.v, b.v) DESC, b.vec_id) AS k FROM e a JOIN e b ON a.vec_id <> b.vec_id)"
REASON = """reasons AS (SELECT video_id, channel_id, CASE WHEN comment_count IS NULL THEN 'no_comment_count' WHEN comment_count < 5 THEN 'too_few' WHEN comment_count > 5000 THEN 'too_many' END AS r FROM cv),
    capped AS (SELECT video_id, channel_id, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY channel_id, r ORDER BY video_id) <= 20 THEN 'included' ELSE 'over_channel_cap' END) AS reason FROM reasons)"""
SPLIT = "every AS (SELECT DISTINCT coalesce(channel_handle, '?') AS channel FROM cv), tested AS (SELECT channel FROM every ORDER BY md5('0:' || channel), channel LIMIT 8)"

SQL = {
    "age_decile_likes": f"{BASE_SQL} SELECT {DECILE} AS decile, count(*) AS n, round(avg(ln(1 + like_count)), 6) AS mean_log1p FROM f GROUP BY 1",
    "age_bucket_likes": f"{BASE_SQL}, g AS (SELECT *, coalesce(age_h, 0) AS a FROM f) SELECT CASE WHEN a < 1 THEN 1 WHEN a < 6 THEN 2 WHEN a < 24 THEN 3 WHEN a < 168 THEN 4 WHEN a < 720 THEN 5 ELSE 6 END AS bucket, count(*) AS n, round(avg(ln(1 + like_count)), 6) AS mean_log1p, round(avg(like_count), 6) AS mean_likes, round(avg((like_count = 0)::int), 6) AS zero_rate, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM g GROUP BY 1",
    "like_percentiles": f"{C}, q AS (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99, 0.999]::double[]) AS p, unnest(quantile_cont(like_count, [0.5, 0.75, 0.9, 0.95, 0.99, 0.999])::double[]) AS value FROM cc UNION ALL SELECT 1.0, max(like_count) FROM cc) SELECT p, round(value, 6) AS value FROM q",
    "zero_inflation": f"{C} SELECT count(*) AS n, round(avg((like_count = 0)::int), 6) AS zero_share, round(avg((like_count <= 1)::int), 6) AS le1_share FROM cc",
    "top1pct_share": f"{C}, o AS (SELECT like_count, row_number() OVER (ORDER BY like_count DESC) AS k, count(*) OVER () AS n FROM cc) SELECT max(n) AS n, round(sum(CASE WHEN k <= ceil(n * 0.01) THEN like_count ELSE 0 END) / sum(like_count), 6) AS top_share FROM o",
    "page_rank_effect": f"{C}, {RANKS} SELECT rank IS NOT NULL AS on_page, count(*) AS n, round(avg(like_count), 6) AS mean_likes FROM cc LEFT JOIN rr USING (video_id, comment_id) GROUP BY 1",
    "shorts_vs_long": f"{BASE_SQL} SELECT {SHORT} AS is_short, {DECILE} AS decile, count(*) AS n, round(avg(ln(1 + like_count)), 6) AS mean_log1p FROM f GROUP BY 1, 2",
    "channel_profile": f"{BASE_SQL} SELECT channel, count(*) AS n, round(avg((like_count = 0)::int), 6) AS zero_rate, round(avg(like_count), 6) AS mean_likes FROM f GROUP BY 1",
    "channel_extremes": f"{BASE_SQL}, g AS (SELECT channel, round(avg((like_count = 0)::int), 6) AS z FROM f GROUP BY 1) SELECT a.channel AS least_channel, a.z AS least_rate, b.channel AS most_channel, b.z AS most_rate FROM (SELECT * FROM g ORDER BY z, channel LIMIT 1) a, (SELECT * FROM g ORDER BY z DESC, channel DESC LIMIT 1) b",
    "like_tiers": f"{C} SELECT CASE WHEN like_count = 0 THEN '0' WHEN like_count < 10 THEN '1-9' WHEN like_count < 100 THEN '10-99' WHEN like_count < 1000 THEN '100-999' ELSE '1000+' END AS tier, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM cc GROUP BY 1",
    "non_ascii_share": f"{C} SELECT round(avg((NOT ({ASCII}))::int), 6) AS share FROM cc",
    "toplevel_ratio": f"{CV}, n AS (SELECT video_id, count(*) AS n FROM cc GROUP BY 1) SELECT CAST(sum(n) AS bigint) AS collected, CAST(sum(comment_count) AS bigint) AS reported, round(sum(n) / sum(comment_count), 6) AS ratio FROM cv JOIN n USING (video_id) WHERE status = 'done'",
    "like_rank_target": f"{BASE_SQL} SELECT comment_id, video_id, round(y, 6) AS y FROM f",
    "timeline_position": f"{BASE_SQL} SELECT comment_id, video_id, round(age_pct, 6) AS age_pct FROM f",
    "exposure_features": f"{BASE_SQL}, {EXPOSURE} SELECT comment_id, round(age_pct, 6) AS age_pct, round(log_age_h, 6) AS log_age_h, round(log_views, 6) AS log_views, round(log_video_comments, 6) AS log_video_comments, round(is_short, 6) AS is_short FROM log_age",
    "length_features": rf"{BASE_SQL} SELECT comment_id, round(ln(1 + length(text)), 6) AS log_chars, round(ln(1 + len(list_filter(regexp_split_to_array(text, '[\s\x{{b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda w: w <> ''))), 6) AS log_words, round((contains(text, '?'))::int::double, 6) AS has_question, round(({CAPS})::int::double, 6) AS has_caps_run FROM f",
    "caps_run": f"{C} SELECT {CAPS} AS has_caps_run, count(*) AS n, round(avg(like_count), 6) AS mean_likes FROM cc GROUP BY 1",
    "quota_days": f"SELECT {PACIFIC.format(at='fetched_at')} AS day, CAST(ceil(count(*) / 100.0) AS bigint) AS units FROM comments GROUP BY 1",
    "export_comments": f"{CV}, {RANKS} SELECT c.comment_id, c.video_id, CASE WHEN c.author_channel_id <> '' THEN substr(sha256('fixed-test-salt:' || c.author_channel_id), 1, 20) END AS author_hash, c.text, c.like_count, c.reply_count, strftime(c.published_at, '%Y-%m-%d %H:%M:%S') AS published_at, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, round((epoch_us(c.published_at) - epoch_us(v.published_at)) / 3.6e9, 4) AS age_hours, rr.rank AS relevance_rank FROM cc c JOIN cv v USING (video_id) LEFT JOIN rr ON rr.video_id = c.video_id AND rr.comment_id = c.comment_id WHERE v.status = 'done'",
    "export_videos": f"{CV} SELECT v.video_id, channel_id, channel_handle, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, like_count, comments_stored, strftime(stats_fetched_at, '%Y-%m-%d %H:%M:%S') AS stats_fetched_at, category_id, duration, {SECONDS} AS duration_seconds, {SHORT} AS is_short, view_count, comment_count, (SELECT count(*) FROM cc WHERE cc.video_id = v.video_id) AS collected FROM cv v WHERE status = 'done'",
    "collected_counts": f"{CV} SELECT v.video_id, (SELECT count(*) FROM cc WHERE cc.video_id = v.video_id) AS collected FROM cv v",
    "video_spearman": f"{PRED} SELECT video_id, n, round(rho, 6) AS rho FROM ({_rho('early')})",
    "video_auc": f"{PRED} SELECT video_id, p, q, round(auc, 6) AS auc FROM ({_auc('early')})",
    "bootstrap_ci_channels": f"{PRED}, {CHANNELS}, r AS (SELECT channel, rho AS x FROM ({_rho('early')}) JOIN ch USING (video_id)), {_boot('r', 400)} {BOOT_OUT}",
    "evaluate_baseline": f"{PRED}, {CHANNELS}, r AS (SELECT channel, rho AS x FROM ({_rho('early')}) JOIN ch USING (video_id)), {_boot('r', 200)}, o AS ({BOOT_OUT}), a AS ({_auc('early')}) SELECT o.mean AS rho, o.lo, o.hi, (SELECT round(avg(auc), 6) FROM a) AS auc, (SELECT count(*) FROM a) AS n_auc, (SELECT count(*) FROM r) AS n_videos FROM o",
    "paired_delta_ci": f"{PRED}, {CHANNELS}, r AS (SELECT channel, b.rho - a.rho AS x FROM ({_rho('chars')}) a JOIN ({_rho('early')}) b USING (video_id) JOIN ch USING (video_id)), {_boot('r', 400)} {BOOT_OUT}",
    "bootstrap_ratio_ci": PRED
    + "".join(f", {s}v AS (SELECT round(auc, 9) AS v, row_number() OVER (ORDER BY video_id) - 1 AS k FROM ({_auc(x)})), {s}d AS (SELECT b, ('0x' || substr(md5('0:{s}:' || b || ':' || j), 1, 8))::bigint % n AS k FROM (SELECT t.b, j.k AS j, (SELECT count(*) FROM {s}v) AS n FROM range(100) t(b), {s}v j)), {s}m AS (SELECT b, avg(v) AS x FROM {s}d JOIN {s}v USING (k) GROUP BY b)" for s, x in (("a", "early"), ("c", "chars")))
    + " SELECT (SELECT round((SELECT avg(v) FROM av) / greatest((SELECT avg(v) FROM cv_), 1e-9), 6)) AS ratio, round(quantile_cont(am.x / greatest(cm.x, 1e-9), 0.025), 6) AS lo, round(quantile_cont(am.x / greatest(cm.x, 1e-9), 0.975), 6) AS hi FROM am JOIN cm USING (b)",
    "channel_split": f"{V}, {SPLIT} SELECT channel, CASE WHEN channel IN (SELECT channel FROM tested) THEN 'test' ELSE 'train' END AS split FROM every",
    "nested_split": f"{V}, {SPLIT}, v2 AS (SELECT channel FROM every WHERE channel NOT IN (SELECT channel FROM tested) ORDER BY md5('100:' || channel), channel LIMIT 5) SELECT channel, CASE WHEN channel IN (SELECT channel FROM tested) THEN 'test' WHEN channel IN (SELECT channel FROM v2) THEN 'val' ELSE 'fit' END AS split FROM every",
    "seeded_sample": f"{C} SELECT comment_id FROM cc ORDER BY md5('7:' || comment_id), comment_id LIMIT 200",
    "freeze_exclusions": f"{V}, {REASON} SELECT reason, count(*) AS n FROM capped GROUP BY 1",
    "channel_cap": f"{V}, {REASON} SELECT video_id, channel_id FROM capped WHERE reason = 'included'",
    "estimated_units": f"{V} SELECT video_id, CAST(greatest(1, ceil(coalesce(comment_count, 0) / 100.0)) AS bigint) + 1 AS units FROM cv",
    "manifest_sums": f"{V} SELECT count(*) AS n_videos, count(DISTINCT channel_id) AS n_channels, CAST(sum(CAST(greatest(1, ceil(coalesce(comment_count, 0) / 100.0)) AS bigint) + 1) AS bigint) AS estimated_units, CAST(sum(coalesce(comment_count, 0)) AS bigint) AS estimated_comments FROM cv",
    "date_window": f"{V} SELECT video_id, strftime(published_at, '%Y-%m-%d') AS day FROM cv WHERE strftime(published_at, '%Y-%m-%d') BETWEEN '2025-09-01' AND '2026-02-28'",
    "status_counts": f"{V} SELECT status, count(*) AS n FROM cv GROUP BY 1",
    "status_summary": f"{CV} SELECT (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM (SELECT coalesce(status, '?') AS status, count(*) AS n FROM cv GROUP BY cv.status)) AS videos, (SELECT count(*) FROM cc) AS comments, (SELECT count(DISTINCT video_id) FROM cc) AS videos_with_comments",
    "work_queue": f"{V} SELECT video_id, status, comment_count FROM cv WHERE status IN ('in_progress', 'pending')",
    "next_video": f"{V} SELECT video_id, status FROM cv WHERE status IN ('in_progress', 'pending') ORDER BY (status <> 'in_progress')::int, comment_count ASC NULLS FIRST, video_id LIMIT 1",
    "quota_by_day": "SELECT day_pt AS day, CAST(sum(coalesce(units_used, 0)) AS bigint) AS used, CAST(greatest(0, 8000 - sum(coalesce(units_used, 0))) AS bigint) AS remaining, sum(coalesce(units_used, 0)) < 8000 AS can_spend FROM quota_ledger WHERE day_pt IS NOT NULL GROUP BY 1",
    "comment_upsert": "WITH l AS (SELECT comment_id, like_count, reply_count, updated_at, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY fetched_at DESC NULLS LAST, like_count DESC NULLS LAST, reply_count DESC NULLS LAST, updated_at DESC NULLS LAST) k FROM comments) WHERE k = 1), a AS (SELECT comment_id, video_id, author_channel_id, text, published_at FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY fetched_at ASC NULLS FIRST, like_count ASC NULLS FIRST, reply_count ASC NULLS FIRST, updated_at ASC NULLS FIRST) k FROM comments) WHERE k = 1) SELECT * FROM a JOIN l USING (comment_id)",
    "video_upsert": f"{V} SELECT video_id, channel_id, channel_handle, view_count, comment_count, status FROM cv",
    "rank_upsert": f"WITH {RANKS} SELECT * FROM rr",
    "new_comments": "WITH g AS (SELECT comment_id, min(fetched_at) AS first_at FROM comments WHERE comment_id IS NOT NULL GROUP BY 1), n AS (SELECT CAST(first_at AS date) AS d, count(*) AS c FROM g GROUP BY 1), o AS (SELECT CAST(fetched_at AS date) AS d, count(*) AS c FROM comments WHERE comment_id IS NOT NULL GROUP BY 1) SELECT strftime(o.d, '%Y-%m-%d') AS day, o.c AS observed, coalesce(n.c, 0) AS new FROM o LEFT JOIN n ON o.d = n.d",
    "parse_threads": f"{C} SELECT comment_id, author_channel_id, length(text) AS chars, like_count, coalesce(reply_count, 0) AS reply_count, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM cc WHERE text <> '' AND published_at IS NOT NULL",
    "stream_collect": "SELECT comment_id, video_id, like_count, rc AS reply_count, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM (SELECT *, coalesce(reply_count, 0) AS rc, row_number() OVER (PARTITION BY comment_id ORDER BY fetched_at DESC NULLS LAST, like_count DESC NULLS LAST, coalesce(reply_count, 0) DESC) k FROM comments WHERE comment_id IS NOT NULL AND text <> '' AND published_at IS NOT NULL) WHERE k = 1",
    "knn_estimate": f"WITH {NEAR} SELECT q AS vec_id, round(avg(likes), 6) AS estimate FROM nn WHERE k <= 5 GROUP BY 1",
    "knn_pools_ratio": f"WITH {NEAR}, cut AS (SELECT quantile_cont(likes, 0.9) AS c FROM e), est AS (SELECT q, kk.k, avg(likes) AS x FROM nn, (VALUES (1), (5), (20)) kk(k) WHERE nn.k <= kk.k GROUP BY 1, 2), g AS (SELECT est.k, avg(CASE WHEN e.likes >= (SELECT c FROM cut) THEN x END) AS a, avg(x) AS b FROM est JOIN e ON e.vec_id = est.q GROUP BY 1) SELECT k, round(a, 6) AS top_mean, round(b, 6) AS all_mean, round(a / greatest(b, 1e-9), 6) AS ratio FROM g",
    "estimator_skill": f"WITH {NEAR}, est AS (SELECT q, round(avg(likes), 9) AS x FROM nn WHERE k <= 5 GROUP BY 1), j AS (SELECT e.likes, est.x, rank() OVER (ORDER BY e.likes) + (count(*) OVER (PARTITION BY e.likes) - 1) / 2.0 AS ra, rank() OVER (ORDER BY est.x) + (count(*) OVER (PARTITION BY est.x) - 1) / 2.0 AS rb FROM est JOIN e ON e.vec_id = est.q) SELECT 'all' AS pool, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM j",
    "pairwise_cosine": "WITH e AS (SELECT label, vec_id, CAST(embedding AS double[64]) AS v FROM embeddings) SELECT a.label, (SELECT count(*) FROM e c WHERE c.label = a.label) AS n, round(avg(array_inner_product(a.v, b.v)), 6) AS mean_cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label",
    "vocabulary_topn": f"{C}, {LIST2} SELECT term, count(*) AS df, CAST(sum(tf) AS bigint) AS cf FROM t GROUP BY term HAVING count(*) >= 5 ORDER BY cf DESC, term LIMIT 500",
    "tfidf_weights": f"{C}, {TERMS1}, v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM t GROUP BY term HAVING count(*) >= 5 ORDER BY cf DESC, term LIMIT 500), r AS (SELECT comment_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM cc)) / (1.0 + df)) + 1) AS w FROM t JOIN v USING (term)) SELECT comment_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY comment_id)), 6) AS weight FROM r",
    "scaled_features": f"{BASE_SQL}, {EXPOSURE}, l AS (SELECT 'age_pct' AS feature, age_pct AS v FROM log_age UNION ALL SELECT 'log_age_h', log_age_h FROM log_age UNION ALL SELECT 'log_views', log_views FROM log_age UNION ALL SELECT 'log_video_comments', log_video_comments FROM log_age UNION ALL SELECT 'is_short', is_short FROM log_age) SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(coalesce((max(v) - avg(v)) / nullif(stddev_pop(v), 0), 0), 6) AS max_scaled FROM l GROUP BY 1",
}
SQL["bootstrap_ratio_ci"] = SQL["bootstrap_ratio_ci"].replace("cv AS (SELECT round(auc", "cv_ AS (SELECT round(auc").replace("FROM cv)", "FROM cv_)").replace(" JOIN cv USING (k)", " JOIN cv_ USING (k)").replace(", cv j)", ", cv_ j)")
