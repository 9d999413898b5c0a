"""Per-document text statistics, and how far each document lies from prose of its language.

Every document gets the statistics below. For each language the robust mean and covariance of prose are fitted over all documents that
declare it: from medians and deviations first, then by concentration steps that leave out what lies too far, so that lists,
tables, debris and wrongly labelled documents don't count. A document's outlierness is its squared Mahalanobis distance
from the nearest language's prose, and each statistic's contribution to it is reported; wrong or missing labels don't matter there. What kind of
outlier it is follows from the same model: the layout statistics alone have a marginal distance, and where that is large they tell lists from tables by
their contributions to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposit.sources.tables import cut

#: Some of the most common words of each language.
COMMON = {
    "en": "the a an of and to in is was i my that this it for with at on you be are as from our we not but or who so",
    "de": "der die das und ich ist nicht ein eine mit auf zu von für auch den so immer",
    "es": "el la los que de y en un una es por con no mi se muy como al",
    "fr": "le la les de des un une et est que je pas pour ce sur il en avec",
    "it": "il la di che e un una per non è su mi con ho da così più",
    "pt": "o a os de que e um uma eu não para com do da muito por isso",
    "nl": "de het een van en ik is dat niet voor zo ook je over nog er",
    "sv": "jag det att som en är på och för inte så den till av om",
    "pl": "nie że jest to i w na się jak o mój tak co od do czy",
    "tr": "bir bu ve için çok ne de da ben var hakkında kadar neden",
    "id": "yang dan di saya ini itu untuk tidak dari juga ada dengan sudah lagi",
    "ru": "и в не на что я это как с он про где так мой за кто",
}
_COMMON = frozenset(w for words in COMMON.values() for w in words.split())
#: Particles of Japanese, counted as its common words; a word has about this many characters there.
PARTICLES, DENSE = "のはがをにでともか", 2.5
STATS = ("word_length", "symbol_share", "digit_share", "ended_share", "common_share", "top_word_share", "mixed_share", "letter_share", "item_share", "field_share", "vowel_share")
LANGS = (*COMMON, "ja")

_WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*").findall
_KANA = re.compile(r"[぀-ヿ㐀-鿿]")
_MARK = re.compile(r"\s*(?:[-*•·‣▪–—+o>]\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.):]\s+|\[[ xX]?\]\s*|(?:\d{1,2}:)?\d{1,2}:\d\d(?:\s*[-–—])?\s+|[☐☑✓✔→»#]+\s*)+")
_ENDED = re.compile(r"[.!?…。！？:;,][\"'”’)\]»]*\s*$")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’)\]»]*\s*$")
_GAP = re.compile(r"\s{2,}")
_PAIRS = re.compile(r"(?:^|[\s,;{])[\"']?[\w.-]{1,24}[\"']?\s?[=]\s?\S+")
_NAMED = re.compile(r"^\s*[\"']?[^\W\d][\w .-]{0,23}[\"']?\s*[:=]\s*\S.{0,40}$")
#: Letters and digits, or a mark that parts no words, inside one token.
_MIXED = re.compile(r"[^\W\d_]\d|\d[^\W\d_]{2}").search
_JOINED = re.compile(r"[^\W_][;<>{}=|\\][^\W_]").findall
_STAMP = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýąęóıаеиёоуыэюяœ")


def _letter_of_case(c: str) -> bool:
    return "a" <= c <= "z" or "à" <= c <= "ž" or "а" <= c <= "ё"


def _fields(line: str) -> int:
    """How many delimited or named fields a line has, 0 if it doesn't look like a row."""
    if (n := line.count("|") + line.count("│") + line.count("┼")) >= 2:
        return n
    if "\t" in (bare := line.strip()):
        cells = [c.split() for c in bare.split("\t")]
        return len(cells) if max(map(len, cells)) <= 4 else 0
    if _STAMP.match(line):
        return 2
    if line.count("=") >= 2 and (n := len(_PAIRS.findall(line))) >= 2:
        return n
    cells = _GAP.split(bare)
    if len(cells) >= 2 and max(len(c.split()) for c in cells) <= 4 and not _SENTENCE.search(line):
        return len(cells)
    for mark in ";,":
        parts = line.split(mark)
        if len(parts) >= 3 and max(len(p.split()) for p in parts) <= 3 and (" " not in line.strip() or mark == ";" or all(len(p.split()) <= 2 for p in parts)) and not _SENTENCE.search(line):
            return len(parts)
    return 0


def statistics(text: str) -> tuple[float, ...]:
    """``STATS`` of a text that isn't blank. Shares of words lean to a prose-like value in short texts, as a few words tell little."""
    low = text.lower()
    chars = Counter(low)
    counts = Counter(_WORDS(low))
    n = counts.total()
    solid = letters = digits = dense = vowels = cased = 0
    for c, k in chars.items():
        if c.isspace():
            continue
        solid += k
        if c.isalpha():
            letters += k
            if _letter_of_case(c):
                cased += k
                vowels += k * (c in _VOWELS)
            elif "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff":
                dense += k
        elif c.isdecimal():
            digits += k
    japanese = dense > 0.2 * max(1, solid)
    if japanese:
        n_words = max(1.0, dense / DENSE)
        common = sum(chars[p] for p in PARTICLES)
        mixed, length = 0, DENSE
        top = max((k for c, k in chars.items() if not c.isspace()), default=0) / 2
    else:
        n_words = max(1, n)
        common = sum(counts[w] for w in _COMMON & counts.keys())
        top = max(counts.values(), default=0)
        mixed = sum(k for w, k in counts.items() if not w.isalpha() and _MIXED(w)) if digits else 0
        if not chars.keys().isdisjoint(";<>{}=|\\"):
            mixed += len(_JOINED(low))
        length = letters / n_words if n else 12.0
    lines = [x for x in text.splitlines() if x.strip()]
    total = sum(map(len, lines)) or 1
    ended = items = rows = 0
    last_fields = 0
    for k, line in enumerate(lines):
        if _ENDED.search(line):
            ended += len(line)
        f = _fields(line)
        if not f and _NAMED.match(line) and not _SENTENCE.search(line) and len(line.split()) <= 6:
            f = 1
        if f:
            near = last_fields or (k + 1 < len(lines) and (_fields(lines[k + 1]) or _NAMED.match(lines[k + 1])))
            if near:
                rows += len(line)
                last_fields = f
                continue
        last_fields = 0
        m = _MARK.match(line)
        rest = line[m.end() :] if m else line
        words_in = len(rest.split())
        if len(_KANA.findall(rest)) > 8:
            words_in = len(rest) / DENSE
        if words_in and (words_in <= 8 if m else words_in <= 4 and not _SENTENCE.search(rest)) and len(max(rest.split(), key=len)) <= 32:
            items += len(line)
    lean = 6
    share = lambda x, usual: (x + lean * usual) / (n_words + lean)
    return (
        math.log1p(min(length, 80)),
        1 - min(1.0, (letters + digits) / max(1, solid)),
        digits / max(1, solid),
        ended / total,
        share(common, 0.3),
        share(top, 0.06),
        share(mixed, 0.0),
        letters / max(1, solid),
        items / total,
        rows / total,
        0.4 if japanese or cased < 8 else (vowels + 4) / (cased + 10),
    )


def text_statistics(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, n_words bigint, n_lines bigint, and a double for each of ``STATS``) for every row.

    Null, empty and blank texts have null statistics and 0 words and lines. Whole texts count, however long. Narrow: no shuffle.
    Repeated rows come out repeated; other columns are ignored whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.iloc[:, 2]
            rows = [statistics(t) if t and t.strip() else (None,) * len(STATS) for t in texts]
            out = pd.DataFrame(rows, columns=list(STATS), dtype="float64")
            out.insert(0, "n_lines", [sum(1 for x in t.splitlines() if x.strip()) if t else 0 for t in texts])
            out.insert(0, "n_words", [len(t.split()) if t else 0 for t in texts])
            out.insert(0, "lang", pdf.iloc[:, 1].to_numpy())
            out.insert(0, key, pdf.iloc[:, 0].to_numpy())
            yield out

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(lang).alias("_lang"), F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, lang string, n_words bigint, n_lines bigint, " + ", ".join(f"{s} double" for s in STATS))


#: Least variances: a statistic that hardly varies in prose still has this much room.
FLOOR = np.array([0.12, 0.04, 0.03, 0.20, 0.06, 0.03, 0.02, 0.05, 0.10, 0.10, 0.04]) ** 2


#: Rows' worth of all languages' prose that each language's model starts from.
PRIOR = 30


def fit_prose(stats: DataFrame, steps: int = 3, cutoff: float = 40.0) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The mean and inverse covariance of prose by language, over all rows of ``stats`` that declare it.

    Every declared language has its model, drawn towards that of all languages together as by ``PRIOR`` rows of it, so one of few rows is near the
    common prose and one of many is its own. If no row declares a language, all rows together make one.
    """
    known = stats.where(F.col(STATS[0]).isNotNull())
    own = F.when(F.col("lang").isin(*LANGS), F.col("lang")).otherwise(F.lit("*"))
    known = known.withColumn("_l", own)
    quartiles = [F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(s) for s in STATS]
    first = known.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), *quartiles).collect()
    every = known.agg(*quartiles).collect()[0]
    middle = lambda r: np.array([r[s][1] for s in STATS])
    spread = lambda r: np.array([(r[s][2] - r[s][0]) / 1.349 for s in STATS]) ** 2
    drawn = lambda own, common, n: (n * own + PRIOR * common) / (n + PRIOR)
    model = {}
    for r in first:
        if r["_l"] != "*" or len(first) == 1:
            n = r["n"]
            model[r["_l"]] = (drawn(middle(r), middle(every), n), np.diag(1 / (drawn(spread(r), spread(every), n) + FLOOR)))
    cols = [F.col(s) for s in STATS]
    width = len(STATS)
    products = [(i, j) for i in range(width) for j in range(i, width)]
    for _ in range(steps):
        def near(pdf: pd.DataFrame, now: dict = model) -> np.ndarray:
            x = pdf[list(STATS)].to_numpy(float)
            out = np.full(len(x), np.inf)
            for k, (mean, inverse) in now.items():
                at = (pdf["_l"] == k).to_numpy()
                d = x[at] - mean
                out[at] = np.einsum("ij,jk,ik->i", d, inverse, d)
            return out

        def kept(batches: Iterator[pd.DataFrame], near=near) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for pdf in batches:
                yield pdf[near(pdf) < cutoff]

        inner = known.where(F.col("_l").isin(*model)).select("_l", *cols).mapInPandas(kept, "_l string, " + ", ".join(f"{s} double" for s in STATS))
        sums = inner.groupBy("_l").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS)], *[F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}_{j}") for i, j in products]).collect()
        n = {r["_l"]: r["n"] for r in sums}
        mean = {r["_l"]: np.array([r[f"s{i}"] for i in range(width)]) / r["n"] for r in sums}
        cov = {}
        for r in sums:
            c = np.zeros((width, width))
            for i, j in products:
                c[i, j] = c[j, i] = r[f"p{i}_{j}"] / r["n"]
            cov[r["_l"]] = c - np.outer(mean[r["_l"]], mean[r["_l"]])
        total = sum(n.values())
        if not total:
            break
        common = sum(n[k] * mean[k] for k in n) / total
        within = sum(n[k] * cov[k] for k in n) / total
        for k in n:
            model[k] = (drawn(mean[k], common, n[k]), np.linalg.inv(drawn(cov[k], within, n[k]) + np.diag(FLOOR)))
    return model


def outliers(stats: DataFrame, key: str, model: dict[str, tuple[np.ndarray, np.ndarray]], least: float = 40.0, layout: float = 20.0) -> DataFrame:
    """(key, nearest string, distance double, contributions map<string,double>, kind string).

    ``nearest`` is the language whose prose is nearest, ``distance`` the squared Mahalanobis distance from it; the
    contributions add up to it. kind is null for prose (a distance under ``least``) and for rows without statistics. Beyond
    it, if the marginal distance of the layout statistics (shares of short items and of rows of fields) is ``layout`` or more, the one that contributes
    more to it makes the document a 'list' or a 'table'; if the layout is that of prose, what is left are the words, and the document is 'junk'.
    """
    names = sorted(model)
    at = [STATS.index("item_share"), STATS.index("field_share")]
    marginal = {k: np.linalg.inv(np.linalg.inv(model[k][1])[np.ix_(at, at)]) for k in names}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(STATS)].to_numpy(float)
            blank = np.isnan(x).any(1)
            x = np.nan_to_num(x)
            d = np.stack([x - model[k][0] for k in names])
            parts = np.stack([d[i] * (d[i] @ model[k][1]) for i, k in enumerate(names)])
            which = parts.sum(2).argmin(0)
            own = parts[which, np.arange(len(x))]
            distance = own.sum(1)
            pair = np.stack([d[i][:, at] * (d[i][:, at] @ marginal[k]) for i, k in enumerate(names)])[which, np.arange(len(x))]
            kind = np.where(pair.sum(1) >= layout, np.where(pair[:, 0] >= pair[:, 1], "list", "table"), "junk").astype(object)
            kind = np.where((distance >= least) & ~blank, kind, None)
            yield pd.DataFrame(
                {
                    key: pdf[key],
                    "nearest": np.where(blank, None, np.array(names, object)[which]),
                    "distance": np.where(blank, np.nan, distance),
                    "contributions": [None if b else dict(zip(STATS, map(float, c))) for b, c in zip(blank, own)],
                    "kind": kind,
                }
            )

    type_of = stats.schema[key].dataType.simpleString()
    return stats.select(key, *STATS).mapInPandas(run, f"`{key}` {type_of}, nearest string, distance double, contributions map<string,double>, kind string")


def judge(df: DataFrame, key: str, text: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """(statistics, outliers) of all documents, the prose models fitted on themselves."""
    stats = cut(text_statistics(df, key, text, lang))
    return stats, outliers(stats, key, fit_prose(stats))
