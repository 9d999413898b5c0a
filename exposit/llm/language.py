"""Languages of documents and of their sentences, by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood in a language is the sum
over all its segmentations into pieces, computed by a forward algorithm for all languages at once. The piece
probabilities are fitted by expectation-maximisation (forward-backward) on a bounded sample of labelled documents; as labels
may be wrong, the fit is repeated on the sentences whose label the first fit agrees with. Pieces don't cross white space, so a
word's likelihoods are computed once per task and remembered in a bounded dictionary.

A document is cut into units at line ends and sentence ends, and every unit has a language. One of fewer than ``MIN_WORDS`` words (or as
few characters of a script without spaces) tells little: it has the language of the unit before it (or after, at the start) unless its own words
speak for another by ``SURE`` nats. A word or phrase of another language inside a unit is weighed with the rest of it.

Confidence is calibrated on labelled rows that the fit didn't see: scores are divided by the temperature at which their probabilities fit best how well
a few words tell the language. A unit whose words are far less likely than words of its language usually are, by ``OTHER`` deviations of those rows, is
in none of the languages: its language is 'und'.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposit.llm.tokens import TOKENIZERS

#: The languages, each with the other spellings of its label (three letters, English name).
LANGUAGES = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "castilian"),
    "fr": ("fra", "fre", "french"),
    "id": ("ind", "in", "indonesian"),
    "it": ("ita", "italian"),
    "ja": ("jpn", "jp", "japanese"),
    "nl": ("nld", "dut", "dutch", "flemish"),
    "pl": ("pol", "polish"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
    "sv": ("swe", "swedish"),
    "tr": ("tur", "turkish"),
}
MISSING = ("", "und", "xx", "unknown", "none", "null", "n/a")
CODES = tuple(LANGUAGES)
MIN_WORDS = 3
MIN_CHARS = 6
#: What a change of language inside a unit must gain, in nats, and the words that each side needs.
SWITCH = 18.0
SIDE = 4
#: What a short unit's own language must gain over its neighbour's, in nats.
SURE = 6.0
#: Deviations below the usual likelihood at which a unit is in none of the languages.
OTHER = 6.0
UNDETERMINED = "und"
LONGEST = 16
#: Labelled documents per language that the fit may use.
SAMPLE = 600
#: Further ones that calibrate it.
HELD = 150
ROUNDS = 4
#: A sentence mark ends a unit only before white space or the end, or after a script without spaces.
_UNIT = re.compile(r"(?:(?!\s[-–—/|•]+\s)[^\n\r.!?…。！？]|[.!?…](?=[^\s.!?…。！？]))+[.!?…。！？]*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*").finditer
_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")


def label_code(label: Column) -> Column:
    """The two-letter code that a declared label names in any spelling; null where it is missing; else the lower-cased label."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^([^-_.@(\s]*)", 1)
    code = bare
    for known, others in LANGUAGES.items():
        code = F.when(bare.isin(*others), F.lit(known)).otherwise(code)
    return F.when(label.isNotNull() & ~F.lower(F.trim(label)).isin(*MISSING) & (bare != ""), code)


@dataclass
class Model:
    """Piece probabilities by language, and what a character outside the vocabulary counts."""

    pieces: dict[str, int]
    p: np.ndarray
    prior: np.ndarray
    unknown: float = 1e-6
    #: Scores are divided by it for confidence.
    temperature: float = 1.0
    #: By language: the mean log-likelihood of a word, and the deviation of a unit's sum over the root of its words.
    usual: np.ndarray = field(default_factory=lambda: np.array([np.full(len(CODES), -np.inf), np.ones(len(CODES))]))
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def lattice(self, word: str) -> list[tuple[int, int, int]]:
        """(begin, end, piece) of every piece in the word; -1 for a character that is no piece."""
        s, out, get = "▁" + word, [], self.pieces.get
        for i in range(len(s)):
            one = False
            for j in range(i + 1, min(len(s), i + LONGEST) + 1):
                if (k := get(s[i:j])) is not None:
                    out.append((i, j, k))
                    one |= j == i + 1
            if not one:
                out.append((i, i + 1, -1))
        return out

    def log_likelihood(self, word: str) -> np.ndarray:
        """Log of the summed probability of all segmentations, by language. Words of any length: the sum is rescaled at every position."""
        got = self.cache.get(word)
        if got is None:
            edges, n = self.lattice(word), len(word) + 1
            a = np.zeros((n + 1, len(CODES)))
            a[0] = 1.0
            shift = 0.0
            for i, j, k in edges:
                a[j] += a[i] * (self.p[k] if k >= 0 else self.unknown)
                if j == i + 1 and (m := a[i:].max()) < 1e-100:
                    a[i:] /= m
                    shift += math.log(m)
            got = np.log(np.maximum(a[n], 1e-300)) + shift
            if len(self.cache) >= 200_000:
                self.cache.clear()
            if len(word) <= 40:
                self.cache[word] = got
        return got

    def score(self, words: list[str]) -> np.ndarray:
        total = np.log(self.prior)
        for w in words:
            total = total + self.log_likelihood(w)
        return total


def _words(text: str, begin: int, end: int) -> list[tuple[int, str]]:
    """(place, word) of the words in a stretch; runs of more than 40 letters are taken in parts."""
    out = []
    for m in _WORD(text, begin, end):
        w = m[0].lower()
        out += [(m.start(), w)] if len(w) <= 40 else [(m.start(), w[i : i + 40]) for i in range(0, len(w), 40)]
    return out


def _size(text: str, begin: int, end: int, words: int) -> float:
    """At 1 and over, a stretch has a language of its own."""
    return max(words / MIN_WORDS, len(_DENSE.findall(text, begin, end)) / MIN_CHARS)


def units(text: str) -> list[tuple[int, int, list[tuple[int, str]], bool]]:
    """(begin, end, words, whether too short to tell) of the sentences and lines of a text that have words."""
    found = ((m.start(), m.end(), _words(text, m.start(), m.end())) for m in _UNIT.finditer(text))
    return [(a, b, w, _size(text, a, b, len(w)) < 1) for a, b, w in found if w]


def posterior(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


def _parted(text: str, begin: int, end: int, words: list[tuple[int, str]], scores: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """A unit, parted where its words change language without a mark: both sides must be long enough and gain ``SWITCH`` nats together."""
    whole = scores.sum(0)
    if len(words) >= 2:
        before = scores.cumsum(0)[:-1]
        gain = before.max(1) + (whole - before).max(1) - whole.max()
        for k in np.argsort(-gain):
            if gain[k] < SWITCH:
                break
            at = words[k + 1][0]
            if _size(text, begin, at, (k + 1) * MIN_WORDS / SIDE) >= 1 and _size(text, at, end, (len(words) - k - 1) * MIN_WORDS / SIDE) >= 1:
                return _parted(text, begin, at, words[: k + 1], scores[: k + 1]) + _parted(text, at, end, words[k + 1 :], scores[k + 1 :])
    return [(begin, end, whole)]


def detect(model: Model, text: str) -> list[tuple[int, int, str, float]]:
    """(begin, end, language, confidence) of a text's units; neighbours of one language are one segment."""
    prior = np.log(model.prior)
    parts: list[list] = []  # begin, end, score, language, deviations below the usual
    for begin, end, words, short in units(text):
        scores = np.array([model.log_likelihood(w) for _, w in words])
        if short:
            parts.append([begin, end, scores.sum(0), None, 0.0])
            continue
        for a, b, own in _parted(text, begin, end, words, scores):
            n = sum(a <= at < b for at, _ in words)
            k = int((own + prior).argmax())
            usual, deviation = model.usual[:, k]
            below = (n * usual - own[k]) / (deviation * math.sqrt(n))
            parts.append([a, b, own, k if below <= OTHER else -1, below])
    if not parts:
        return []
    known = [p[3] for p in parts if p[3] is not None and p[3] >= 0]
    near = known[0] if known else int((sum(p[2] for p in parts) + prior).argmax())
    for p in parts:
        if p[3] is None:
            k = int((p[2] + prior).argmax())
            p[3] = k if (p[2] + prior)[k] >= (p[2] + prior)[near] + SURE else near
        near = p[3] if p[3] >= 0 else near
    out: list[list] = []
    for a, b, own, k, below in parts:
        if out and out[-1][3] == k:
            out[-1][1], out[-1][2], out[-1][4] = b, out[-1][2] + own, min(out[-1][4], below)
        else:
            out.append([a, b, own + prior, k, below])
    # Of a language's own units at most 1 / d^2 lie d deviations below the usual.
    return [(a, b, CODES[k], float(posterior(s / model.temperature)[k])) if k >= 0 else (a, b, UNDETERMINED, float(1 - 1 / below**2)) for a, b, s, k, below in out]


def calibrate(model: Model, held: list[tuple[str, str]]) -> None:
    """Set the temperature and the usual likelihoods from (text, code) pairs that the fit didn't see.

    Labels may be wrong, so units count whose whole text agrees with theirs; what is calibrated is how well the first one to four words of such a unit
    tell its language, which is where scores are uncertain.
    """
    prior = np.log(model.prior)
    scores, labels, counts, starts = [], [], [], []
    for text, code in held:
        for _, _, words, short in units(text):
            if not short:
                each = np.array([model.log_likelihood(w) for _, w in words])
                scores.append(each.sum(0))
                labels.append(CODES.index(code))
                counts.append(len(words))
                starts.append(each.cumsum(0)[:4])
    if not scores:
        return
    s, y, n = np.array(scores), np.array(labels), np.array(counts)
    right = s.argmax(1) == y
    part = [(x + prior, k) for x, k, ok in zip(starts, y, right) if ok]
    if part:
        s0, y0 = np.concatenate([x for x, _ in part]), np.repeat([k for _, k in part], [len(x) for x, _ in part])
        losses = []
        for t in np.geomspace(0.5, 8, 17):
            e = np.exp((s0 - s0.max(1, keepdims=True)) / t)
            losses.append((-np.log(0.999 * e[np.arange(len(y0)), y0] / e.sum(1) + 0.001 / len(CODES)).mean(), t))
        model.temperature = min(losses)[1]
    for k in range(len(CODES)):
        at = right & (y == k)
        if at.sum() >= 2:
            mean = s[at, k].sum() / n[at].sum()
            model.usual[:, k] = mean, np.sqrt((((s[at, k] - mean * n[at]) ** 2) / n[at]).mean())


def fit(sample: list[tuple[str, str]], vocabulary: str, rounds: int = ROUNDS, smoothing: float = 0.02) -> Model:
    """Piece probabilities from (text, code) pairs, for all languages at once."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces: dict[str, int] = {}
    for i in range(own.get_piece_size()):
        if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i)) and len(p := own.id_to_piece(i)) <= LONGEST:
            pieces.setdefault(p.lower() if p.lower() not in pieces else p, len(pieces))
    place = {c: k for k, c in enumerate(CODES)}
    all_units = [([w for _, w in words], place[code]) for text, code in sample if text and code in place for _, _, words, short in units(text) if not short]
    model = Model(pieces, np.full((len(pieces), len(CODES)), 1.0 / len(pieces)), np.full(len(CODES), 1.0 / len(CODES)))
    for stage in range(3):
        if stage:
            model.cache.clear()
            kept = [(w, c) for w, c in all_units if int(model.score(w).argmax()) == c]
        else:
            kept = all_units
        counts: dict[str, np.ndarray] = {}
        for words, code in kept:
            for w, n in Counter(words).items():
                counts.setdefault(w, np.zeros(len(CODES)))[code] += n
        paths = {w: model.lattice(w) for w in counts}
        for _ in range(rounds):
            expected = np.zeros_like(model.p)
            for w, weight in counts.items():
                edges, n = paths[w], len(w) + 1
                a, b = np.zeros((n + 1, len(CODES))), np.zeros((n + 1, len(CODES)))
                a[0], b[n] = 1.0, 1.0
                for i, j, k in edges:
                    a[j] += a[i] * (model.p[k] if k >= 0 else model.unknown)
                for i, j, k in reversed(edges):
                    b[i] += b[j] * (model.p[k] if k >= 0 else model.unknown)
                scale = weight / np.maximum(a[n], 1e-300)
                for i, j, k in edges:
                    if k >= 0:
                        expected[k] += scale * a[i] * model.p[k] * b[j]
            total = expected.sum(0)
            model.p = (expected + smoothing) / (total + smoothing * len(pieces))
    model.cache.clear()
    return model


def fit_on(df: DataFrame, key: str, text: str, code: str, sample: int = SAMPLE, tokenizers: str = TOKENIZERS, vocabulary: str = "piece_bpe_32k") -> Model:
    """A model fitted on at most ``sample`` rows of each language of ``df`` (first by hash of the key), which may be labelled wrongly; ``HELD`` more calibrate it.

    The languages' prior shares are counted over all rows.
    Rows with a null text or a code outside the languages are ignored. Without rows all languages are alike.
    """
    first = Window.partitionBy(code).orderBy(F.xxhash64(key), key)
    rows = df.where(F.col(code).isin(*CODES) & (F.length(text) > 0)).select(key, text, code).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample + HELD)
    taken = rows.select(text, code, "_n").collect()
    model = fit([(r[0], r[1]) for r in taken if r[2] <= sample], f"{tokenizers}/{vocabulary}.model")
    calibrate(model, [(r[0], r[1]) for r in taken if r[2] > sample])
    shares = dict(df.where(F.col(code).isin(*CODES)).groupBy(code).count().collect())
    prior = np.array([shares.get(c, 0) + 1.0 for c in CODES])
    model.prior = prior / prior.sum()
    return model


def segments(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, segment int, begin int, end int, lang, confidence): one row for each segment of one language.

    Offsets are in characters. A segment in none of the languages has the language 'und'. A text without any letter, an empty or a null text has one row with a null language and confidence 0.
    Narrow: no shuffle. Repeated rows come out repeated; other columns are ignored whatever their names.
    """
    sc = df.sparkSession.sparkContext
    sent = sc.broadcast((model.pieces, model.p.astype(np.float32), model.prior, model.unknown, model.temperature, model.usual))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, p, *rest = sent.value
        own = Model(pieces, p.astype(np.float64), *rest)
        for pdf in batches:
            rows: list[tuple] = []
            for k, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                found = detect(own, t) if t else []
                rows += [(k, i, *x) for i, x in enumerate(found)] or [(k, 0, 0, len(t or ""), None, 0.0)]
            yield pd.DataFrame(rows, columns=[key, "segment", "begin", "end", "lang", "confidence"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, segment int, begin int, end int, lang string, confidence double")


def misdeclared(found: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, lang): the languages of each document whose declared code is missing, wrong or incomplete.

    ``found`` is (key, lang), ``declared`` (key, code) with a null code where nothing is declared. A document with several
    declared codes is a case unless all name its only language. Documents without a language, or only in
    undetermined ones, are no cases.
    """
    langs = found.where(F.col("lang") != UNDETERMINED).groupBy(key).agg(F.collect_set("lang").alias("langs"))
    said = declared.groupBy(key).agg(F.collect_set("code").alias("codes"), F.max(F.col("code").isNull()).alias("missing"))
    wrong = F.col("missing") | (F.size("langs") > 1) | (F.size("codes") != 1) | (F.element_at("codes", 1) != F.element_at("langs", 1))
    return langs.join(said, key).where(wrong).select(key, F.explode("langs").alias("lang"))
