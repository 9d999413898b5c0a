"""Abusive, hateful and sexual content, by multiple-instance learning.

A document is a bag of sentences and clauses. Each has a probability of each kind, from a linear model over its word 1- to
3-grams, over the same with classes in place of listed words, and over the sequence of its word classes; a document's probability is their
noisy-or, 1 - prod(1 - p). Only documents are labelled, and the gradient of the document's loss
tells which sentences are to blame; so the fitted model both scores documents and locates the sentences.

The labels are of two sorts: documents written from the general phrasings of ``abuse_text``, and a bounded sample of the corpus, which has no labels: its
documents first count as harmless at a small weight, and then by the labels that the model fitted before is sure of. Words are first brought to plain spelling: letters that only look
like Latin ones, digits and marks inside words, stretched, spaced and hidden letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposit.llm.abuse_text import KINDS, class_of, dense_words, documents

BITS = 19
#: Corpus documents that the fit may use.
SAMPLE = 20_000
#: Documents written of each phrasing.
WRITTEN = 24
#: Documents written of each general pattern.
PATTERNED = 120

#: Letters of other scripts, and digits or marks, that stand for Latin letters.
LOOKALIKE = str.maketrans("асеіојрѕхуһԁԛԝкмнтвгαοερνικτυɡı", "aceiojpsxyhdqwkmhtbraoepviktugi")
_DIGIT = str.maketrans("0134578@$", "oieastbas")

_HIDDEN = re.compile(r"[\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
#: Letters with a mark after each, and letters with one blank after each.
_MARKED = re.compile(r"(?:^|(?<=[^\w]))[^\W\d_](?:([.\-_*·])[^\W\d_])(?:\1[^\W\d_])*\1?(?=$|[^\w])")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?: [^\W\d_]){2,}(?!\S)")
_GAP = re.compile(r"[.\-_*·]")
_LEET = re.compile(r"[^\W_]*(?:[^\W\d_][0134578@$]|[0134578@$][^\W\d_])[\w@$]*")
_COUNT = re.compile(r"\d+(?:[^\W\d_]{1,2}|\d*)$|\d{2,}[^\W\d_]+$")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_MASKED = re.compile(r"[^\W_]+(?:\*+[^\W_]*)+|\*{3,}[^\W_]*")
_WORD = re.compile(r"\*|[^\W_]+|[。！？]")
_MIXED = re.compile(r"[^\W\d_]*[а-яіјѕһԁԛԝα-ω][^\W\d_]*")
_ACCENTS = dict.fromkeys(range(0x300, 0x370))
#: An instance ends at a sentence's end, a line's end or a comma.
_END = re.compile(r"[.!?…,;:][\"'”’)\]]*$|[。！？]$")
LINE = "\x01"


def _unlike(m: re.Match) -> str:
    """A word that mixes Latin letters and lookalikes, or has lookalikes only, in Latin letters."""
    word = m[0]
    return word.translate(LOOKALIKE) if re.search("[a-z]", word) or len(word) > 2 and not re.search("[^аесіорхуѕјһмтнквԁԛԝ]", word) else word


def token_words(token: str) -> list[str]:
    """The words of a stretch without blanks, in plain spelling; '' ends an instance and '*' is a word with hidden letters."""
    if token == LINE:
        return [""]
    low = _HIDDEN.sub("", unicodedata.normalize("NFKC", token)).lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKC", unicodedata.normalize("NFD", _MIXED.sub(_unlike, low)).translate(_ACCENTS))
    end = bool(_END.search(low))
    low = _MARKED.sub(lambda m: _GAP.sub("", m[0]), low)
    low = _MASKED.sub("*", low)
    low = _LEET.sub(lambda m: m[0] if _COUNT.match(m[0]) else m[0].translate(_DIGIT), low)
    words: list[str] = []
    for w in _WORD.findall(_LONG.sub(r"\1", low)):
        words += [""] if w in "。！？" else dense_words(w)
    return words + [""] if end and words[-1:] != [""] else words


def tokens_of(text: str) -> list[str]:
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text) if "  " in text or _SPACED.search(text) else text
    return text.replace("\n", f" {LINE} ").split()


def plain(text: str) -> str:
    """A text's words in plain spelling."""
    return " ".join(w for t in tokens_of(text) for w in token_words(t) if w)


class Tokens(dict):
    """Numbers of tokens, and the words of each: hash and class of word k of token i at ``begin[i] + k``. Starts anew when it is large."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.begin, self.hashes, self.classes = [0], [], []

    def __missing__(self, token: str) -> int:
        for w in token_words(token):
            h = 1469598103934665603
            for b in w.encode("utf-8", "surrogatepass"):
                h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
            self.hashes.append(h if w else 1)
            self.classes.append(class_of(w) if w else -1)
        k = self[token] = len(self.begin) - 1
        self.begin.append(len(self.hashes))
        return k


@dataclass
class Bags:
    """Features by sentence, and sentences by document. ``order`` is a sentence's place among the document's sentences with words, a repeated one's that of the first."""

    feature: np.ndarray
    where: np.ndarray
    owner: np.ndarray
    order: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    return (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)


def bags(texts: list[str], known: Tokens) -> Bags:
    """The features of a batch: hashed n-grams of words, of words with classes in their place, and of the classes alone, with the sentence's ends."""
    if len(known) > known.most:
        known.reset()
    split = [tokens_of(t) for t in texts]
    codes = np.fromiter((known[t] for x in split for t in x), np.int64)
    sizes = np.array([len(x) for x in split], np.int64)
    begin = np.array(known.begin, np.int64)
    hashes, classes = np.array(known.hashes, np.uint64), np.array(known.classes, np.int64)
    many = (begin[1:] - begin[:-1])[codes] if len(codes) else np.empty(0, np.int64)
    at = np.repeat(begin[codes] if len(codes) else many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc = np.repeat(np.repeat(np.arange(len(texts)), sizes), many)
    # A boundary before each document and at its end; the words between two boundaries are a sentence.
    place = np.searchsorted(doc, np.arange(len(texts)))
    h, c = np.insert(hashes[at], place, 1), np.insert(classes[at], place, -1)
    doc = np.insert(doc, place, np.arange(len(texts)))
    h, c, doc = np.append(h, np.uint64(1)), np.append(c, -1), np.append(doc, len(texts))
    sentence = np.cumsum(c < 0) - 1
    word = c >= 0
    full = np.bincount(sentence[word], minlength=sentence[-1] + 1) > 0
    features, where = [h[word]], [sentence[word]]

    def grams(x: np.ndarray, edge: np.ndarray, of: np.ndarray, salt: int, keep: np.ndarray | None = None) -> None:
        two = _mix(x[:-1] * np.uint64(salt) + x[1:])
        ok2 = ~(edge[:-1] & edge[1:])
        three = _mix(two[:-1] * np.uint64(salt + 2) + x[2:])
        ok3 = ~edge[1:-1]
        if keep is not None:
            ok2 &= keep[:-1] | keep[1:]
            ok3 &= keep[:-2] | keep[1:-1] | keep[2:]
        features.extend((two[ok2], three[ok3]))
        where.extend((of[:-1][ok2], of[:-2][ok3]))

    grams(h, ~word, sentence, 3)
    named = np.where(c > 0, _mix(c.astype(np.uint64) + np.uint64(977)), h)
    grams(named, ~word, sentence, 7, c > 0)
    some = c != 0
    h2, edge, of = named[some], ~word[some], sentence[some]
    features.append(_mix(h2[~edge] * np.uint64(13)))
    where.append(of[~edge])
    grams(h2, edge, of, 17)
    hashed = (_mix(np.concatenate(features)) >> np.uint64(64 - BITS)).astype(np.int64)
    # A sentence that a document repeats is one instance: it is no further evidence.
    owner = doc[~word]
    sums = np.append(np.uint64(0), np.cumsum(_mix(h * np.uint64(3) + np.arange(len(h), dtype=np.uint64) - np.flatnonzero(~word).astype(np.uint64)[sentence]), dtype=np.uint64))
    ends = np.append(np.flatnonzero(~word), len(h))
    whole = np.stack([owner.astype(np.uint64), sums[ends[1:]] - sums[ends[:-1]]], 1)
    keep = np.zeros(len(owner), bool)
    keep[np.unique(whole[full], axis=0, return_index=True)[1]] = True
    kept = np.zeros(len(owner), bool)
    kept[np.flatnonzero(full)[keep[: full.sum()]]] = True
    order = np.cumsum(full) - 1
    order -= order[np.searchsorted(owner, owner)] - np.where(full[np.searchsorted(owner, owner)], 0, -1)
    number = np.cumsum(kept) - 1
    at = np.concatenate(where)
    ok = kept[at]
    return Bags(hashed[ok], number[at[ok]], owner[kept], order[kept])


@dataclass
class Model:
    weights: np.ndarray  # (2 ** BITS, kinds)
    bias: np.ndarray

    def sentences(self, feature: np.ndarray, where: np.ndarray, many: int) -> np.ndarray:
        """The probability of each kind for each sentence."""
        score = np.stack([np.bincount(where, self.weights[feature, k], minlength=many) for k in range(len(KINDS))], 1)
        return 1 / (1 + np.exp(-np.clip(score + self.bias, -30, 30)))

    def documents(self, texts: list[str], known: Tokens) -> tuple[np.ndarray, np.ndarray, Bags]:
        """(probabilities of the documents, of their sentences, and the bags)."""
        b = bags(texts, known)
        p = self.sentences(b.feature, b.where, len(b.owner))
        return noisy_or(p, b.owner, len(texts)), p, b


def noisy_or(p: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
    """A document without sentences has probability 0."""
    log = np.log1p(-np.clip(p, 0, 1 - 1e-9))
    return -np.expm1(np.stack([np.bincount(owner, log[:, k], minlength=many) for k in range(p.shape[1])], 1))


def fit(labelled: list[tuple[str, tuple[int, ...]]], weight: np.ndarray | None = None, epochs: int = 8, rate: float = 0.3, decay: float = 2e-5, drop: float = 0.47, seed: int = 7) -> Model:
    """Document-level logistic loss through the noisy-or, by mini-batches with AdaGrad steps; a part of the features is left out of each step, so that none is relied on alone.

    ``weight`` is what each document counts, 1 if not given.
    """
    weight = np.ones(len(labelled)) if weight is None else weight
    rng = np.random.default_rng(seed)
    y = np.array([d[1] for d in labelled], float)
    b = bags([d[0] for d in labelled], Tokens())
    by = np.argsort(b.where, kind="stable")
    feature, where = b.feature[by], b.where[by]
    begin = np.searchsorted(where, np.arange(len(b.owner) + 1))
    first = np.searchsorted(b.owner, np.arange(len(labelled) + 1))
    model = Model(np.zeros((1 << BITS, len(KINDS))), np.full(len(KINDS), -6.0))
    square = np.full_like(model.weights, 1e-1)
    filled = np.flatnonzero(np.diff(first) > 0)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(filled), max(1, len(filled) // 256)):
            s = np.concatenate([np.arange(first[d], first[d + 1]) for d in batch])
            f = np.concatenate([feature[begin[first[d]] : begin[first[d + 1]]] for d in batch])
            at = np.repeat(np.arange(len(s)), begin[s + 1] - begin[s])
            stay = rng.random(len(f)) >= drop
            f, at = f[stay], at[stay]
            doc = np.repeat(np.arange(len(batch)), first[batch + 1] - first[batch])
            p = model.sentences(f, at, len(s))
            whole = np.clip(noisy_or(p, doc, len(batch)), 1e-6, 1 - 1e-6)
            blame = p * ((1 - y[batch] / whole) * weight[batch, None])[doc]
            unique, back = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(back, blame[at, k], minlength=len(unique)) for k in range(len(KINDS))], 1) / 16 + decay * model.weights[unique]
            square[unique] += g * g
            model.weights[unique] -= rate * g / np.sqrt(square[unique])
            model.bias -= rate * 0.02 * blame.mean(0)
    model.weights *= 1 - drop / 2
    return model


#: Probabilities at which a sampled document counts as a case and as harmless, and what a sampled document counts as harmless in the first fit.
SURE, CLEAN, DOUBT = 0.95, 0.1, 0.1
ROUNDS = 2


def fit_with(texts: list[str], written: list[tuple[str, tuple[int, ...]]]) -> Model:
    """A model of written documents and of unlabelled ``texts``.

    Most unlabelled documents are harmless, so in the first fit all count as harmless at a small weight; in each further fit those count that the
    one before was sure of, by the label it gave.
    """
    texts = sorted(set(texts))
    harmless = (0,) * len(KINDS)
    # Long documents teach that many harmless sentences together are no case.
    joined = ["\n".join(texts[k : k + 8]) for k in range(0, len(texts), 40)]
    unlabelled = [(t, harmless) for t in texts + joined]
    model = fit(written + unlabelled, np.append(np.ones(len(written)), np.full(len(unlabelled), DOUBT)))
    for _ in range(ROUNDS if texts else 0):
        p, _, _ = model.documents([t for t, _ in unlabelled], Tokens())
        top = p.max(1)
        taken = [(t, tuple(int(k == x.argmax()) for k in range(len(KINDS))) if m >= SURE else harmless) for (t, _), x, m in zip(unlabelled, p, top) if m >= SURE or m <= CLEAN]
        model = fit(written + taken)
    return model


def fit_on(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Model:
    """A model fitted on the written documents and on the first ``sample`` documents of ``df`` by hash of key, whatever the size of ``df``."""
    # A cut on the hash leaves each task with about its share of the sample, so that no more than that goes to the driver.
    known = df.where(F.length(text) > 0).select(key, text, F.xxhash64(key).alias("_h"))
    share = min(1.0, 1.3 * sample / max(1, known.count()))
    near = known.where(F.pmod("_h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = near.orderBy("_h", key).limit(sample).select(text).collect()
    return fit_with([r[0] for r in rows], documents(7, WRITTEN, patterns=PATTERNED))


def kind_of(p: np.ndarray, least: float = 0.5) -> np.ndarray:
    """One kind per document: the likeliest of those at ``least`` or more; hate goes before abuse."""
    best = p.argmax(1)
    best = np.where((p[:, 1] >= least) & (best == 0), 1, best)
    return np.where(p.max(1) >= least, np.array(KINDS, object)[best], None)


def score(df: DataFrame, key: str, text: str, model: Model, least: float = 0.5) -> DataFrame:
    """(key, abuse, hate, sexual double, kind string, sentence int) for every row.

    The three are the document's probabilities; kind is null below ``least``; sentence is the place of the likeliest sentence of that kind,
    null where there is none. Null, empty and wordless texts score 0. Narrow: no shuffle, whole texts. Repeated rows come out repeated; other
    columns are ignored whatever their names.
    """
    sent = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known = Model(*sent.value), Tokens()
        for pdf in batches:
            if not len(pdf):
                continue
            code, texts = pd.factorize(pdf.iloc[:, 1].fillna(""))  # equal texts of a batch are scored once
            whole, p, b = own.documents(list(texts), known)
            kind = kind_of(whole, least)
            place: list[int | None] = [None] * len(texts)
            for d in np.flatnonzero(pd.notna(kind)):
                s = np.arange(*np.searchsorted(b.owner, [d, d + 1]))
                place[d] = int(b.order[s[p[s, KINDS.index(kind[d])].argmax()]])
            whole, kind, place = whole[code], kind[code], [place[c] for c in code]
            yield pd.DataFrame({key: pdf.iloc[:, 0], "abuse": whole[:, 0], "hate": whole[:, 1], "sexual": whole[:, 2], "kind": kind, "sentence": pd.array(place, "Int32")})

    type_of = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {type_of}, abuse double, hate double, sexual double, kind string, sentence int")


def rates(scored: DataFrame, owners: DataFrame, key: str, source: str) -> DataFrame:
    """(source, documents bigint, and the share of documents of each kind) per source.

    ``scored`` is (key, kind), ``owners`` (key, source). Documents without an owner are those of the null source. Partial sums are combined
    before the shuffle, so a source with a third of all rows is no more than one row per task.
    """
    both = scored.join(owners, key, "left")
    shares = [F.round(F.avg(F.coalesce(F.col("kind") == k, F.lit(False)).cast("double")), 6).alias(f"{k}_rate") for k in KINDS]
    return both.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), *shares)
