"""Personal information in free text, by a character-level bidirectional LSTM with CRF transitions, in numpy.

A text's characters are read in windows that overlap; where windows overlap, a character's tag scores are averaged, those
of the window in whose middle it lies counting most. One Viterbi pass over the whole text then decodes all tags at once, so a span
is never cut at a window's end. What is found, where and of which kind, is the decoded path alone; spans are only brought to whole words, without punctuation around
them.

The weights are trained by ``pii_train`` on the synthetic spans of ``pii_text`` and kept beside this module.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposit.llm.pii_text import KINDS

TAGS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
WINDOW, STEP = 128, 96
#: Logarithm of how much rarer names are in texts than in the training's documents: in 1 of 100 against 1 of 4.
NAMES_RARER = 3.0
#: Windows that are run through the network at once.
BATCH = 512
#: What the gates are multiplied by: the last, a tanh, is 2 - 4 / (1 + exp(z)), as cells are kept times -2.
GATES = np.array([1, 1, 1, -4], np.float32)[:, None, None]
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: Character classes after the printable ASCII ones: padding, line end, hidden, other white space, letters by case, digits, marks, symbols.
PAD, LINE, HIDDEN, WHITE, LOWER, UPPER, LETTER, DIGIT, MARK, SYMBOL = range(95, 105)
CLASSES = 105


@cache
def char_table() -> np.ndarray:
    """Class of each character: printable ASCII by itself, accented Latin letters as their base, all else by sort."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for c in range(0x3400):
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch)[:1]
        sort = unicodedata.category(ch)
        if 32 <= ord(base) < 127 and (c < 128 or sort[0] in "LN"):
            out[c] = ord(base) - 32
        elif ch == "\n":
            out[c] = LINE
        else:
            out[c] = HIDDEN if sort in ("Cf", "Cc") and not ch.isspace() else WHITE if ch.isspace() else LOWER if sort == "Ll" else UPPER if sort == "Lu" else LETTER if sort[0] == "L" else DIGIT if sort[0] == "N" else MARK if sort[0] in "PM" else SYMBOL
    out[0x3400:0x10000] = LETTER
    out[0xFEFF] = HIDDEN
    return out


def char_ids(text: str) -> np.ndarray:
    return char_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


class Network:
    """Inference. Weights are folded: inputs are a table by character, and all gates are 1 / (1 + exp(z)); a tanh is twice such a gate less 1.

    States are kept halved and cells times -2, so that an exp can take them as they are. Both are exact, as are the weights that go with them.
    """

    def __init__(self, weights: dict[str, np.ndarray], rarer: float | None = None):
        w = {k: np.array(v, np.float32) for k, v in weights.items()}
        self.hidden = w["Uf"].shape[0]
        sign = np.array([-1, -1, -1, -2], np.float32)[:, None, None]
        by_gate = lambda x: np.ascontiguousarray(x.reshape(len(x), 4, self.hidden).transpose(1, 0, 2) * sign)
        self.table = {d: by_gate(w["E"] @ w[f"W{d}"] + w[f"b{d}"]) for d in "fb"}
        self.inner = {d: by_gate(2 * w[f"U{d}"]) for d in "fb"}
        self.out = {d: 2 * w[f"O{d}"] for d in "fb"}
        # The backward states and cells after so much padding, as the training has it behind a text.
        self.padded = np.zeros((2, WINDOW + 1, self.hidden), np.float32)
        for m in range(WINDOW):
            self.padded[1, m + 1] = self.padded[1, m]
            self._step("b", np.array([PAD]), self.padded[0, m : m + 1], self.padded[1, m + 1 : m + 2], self.padded[0, m + 1 : m + 2], np.empty((2, 4 * self.hidden), np.float32))
        self.bias, self.trans, self.start, self.end = w["o"], w["trans"], w["start"], w["end"]
        # Training shows names far more often than texts do: the odds of a name's beginning are lowered by that.
        begin = TAGS.index("B-name")
        self.trans[:, begin] -= NAMES_RARER if rarer is None else rarer
        self.start[begin] -= NAMES_RARER if rarer is None else rarer
        # An I tag follows only a B or I tag of its kind.
        for k in range(2, len(TAGS), 2):
            allowed = np.zeros(len(TAGS), bool)
            allowed[[k - 1, k]] = True
            self.trans[~allowed, k] = self.start[k] = -1e4
        # What a stretch of one kind, a B and its Is, can gain over O at most: where it begins, by each I, and where it ends. A B that follows another stretch
        # without an O counts as from O; what that differs by is put to the end of the stretch before it.
        over = self.trans - self.trans[0, 0]
        starts = over[:, 1::2]
        out = np.maximum(over[:, 0], (starts - starts[0]).max(1))
        final = self.end - self.end[0]
        pair = lambda x, k: float(max(x[k], x[k + 1]))
        # Only the first I follows the B.
        self.bounds = [(k, float(over[0, k]), float(self.start[k] - self.start[0]), float(over[k + 1, k + 1]), pair(out, k), pair(final, k), max(0.0, float(over[k, k + 1] - over[k + 1, k + 1]))) for k in range(1, len(TAGS), 2)]

    def may_have(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each of the texts (T, B, tags) of these sizes: False only if all O is its best path, as no stretch of any kind has a bound above 0."""
        steps, many = scores.shape[:2]
        at, last = np.arange(many), np.clip(sizes, 1, steps) - 1
        beyond = np.where(np.arange(steps) > last[:, None], 1e9, 0.0)
        by_tag = np.ascontiguousarray(scores.transpose(2, 1, 0))
        some = np.zeros(many, bool)
        for k, enter, opening, more, leave, closing, second in self.bounds:
            begin = by_tag[k] - by_tag[0]
            begin[:, 0] += max(0.0, opening - enter)
            # The best stretch from a to b is begin[a] and the sum of the further tags up to b.
            step = by_tag[k + 1] - by_tag[0]
            step += more
            best = np.cumsum(step, 1, dtype=np.float64)
            best -= np.minimum.accumulate(best - begin, 1)
            best -= beyond
            some |= np.maximum(best.max(1) + leave, best[at, last] + closing) + enter + second > -1e-3
        return some

    def _step(self, d: str, ids: np.ndarray, state: np.ndarray, cell: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
        """One character for each row: cell is changed in place, the next state written to out; spare is memory to work in."""
        size = 4 * cell.size
        z, g = (x[:size].reshape(4, -1, self.hidden) for x in spare)
        np.take(self.table[d], ids, axis=1, out=z, mode="clip")
        np.matmul(state, self.inner[d], out=g)
        z += g
        np.exp(z, out=z)
        z += 1.0
        np.divide(GATES, z, out=z)
        into, keep, show, new = z
        new += 2.0
        new *= into
        cell *= keep
        cell += new
        part = np.exp(cell, out=g[0])
        part += 1.0
        np.divide(1.0, part, out=part)
        part -= 0.5
        np.multiply(part, show, out=out)

    @np.errstate(over="ignore")  # of an infinite exp the gate is rightly 0
    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(T, B, tags) for a (T, B) array of characters, of which each column has so many; sizes ascend.

        Every column counts as padded to a whole window, so what is beside it in the block doesn't matter. Scores behind its end are of no use.
        """
        steps, many = ids.shape
        out = np.empty((steps, many, len(TAGS)), np.float32)
        out[:] = self.bias
        first = np.searchsorted(sizes, np.arange(steps + 1), "right")
        spare = np.empty((2, 4 * many * self.hidden), np.float32)
        for d in "fb":
            states = np.zeros((steps + 1, many, self.hidden), np.float32)  # forward the last is the one before the first character
            cells = np.zeros((many, self.hidden), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                before = states[t - 1 if d == "f" else t + 1]
                if d == "b":
                    ends = slice(first[t], first[t + 1])
                    before[ends], cells[ends] = self.padded[:, WINDOW - t - 1]
                live = slice(first[t], many)
                self._step(d, ids[t, live], before[live], cells[live], states[t, live], spare)
            out += (states[:steps].reshape(-1, self.hidden) @ self.out[d]).reshape(out.shape)
        return out

    def decode(self, scores: list[np.ndarray | None]) -> list[np.ndarray]:
        """The best tag path of each text; of a text without scores, which can't have another, all O."""
        paths = [np.zeros(0 if s is None else len(s), np.int8) for s in scores]
        todo = sorted((i for i, s in enumerate(scores) if s is not None and len(s)), key=lambda i: len(scores[i]))
        for k in range(0, len(todo), BATCH):
            part = todo[k : k + BATCH]
            sizes = np.array([len(scores[i]) for i in part])
            steps = int(sizes.max())
            e = np.zeros((steps, len(TAGS), len(part)), np.float32)
            for b, i in enumerate(part):
                e[: sizes[b], :, b] = scores[i]
            # Best sums by tag and step; where a path came from is looked up along the path alone.
            v = np.empty_like(e)
            v[0] = self.start[:, None] + e[0]
            for t in range(1, steps):
                np.add((v[t - 1][:, None, :] + self.trans[:, :, None]).max(0), e[t], out=v[t])
            at = np.arange(len(part))
            tag = (v[sizes - 1, :, at].T + self.end[:, None]).argmax(0)
            path = np.zeros((steps, len(part)), np.int8)
            for t in range(steps - 1, -1, -1):
                live = t < sizes
                path[t] = np.where(live, tag, 0)
                if t:
                    tag = np.where(live, (v[t - 1] + self.trans[:, tag]).argmax(0), tag)
            for b, i in enumerate(part):
                paths[i] = path[: sizes[b], b]
        return paths


@cache
def network() -> Network:
    with np.load(WEIGHTS) as w:
        return Network(dict(w))


def _weight() -> np.ndarray:
    x = np.arange(WINDOW)
    return np.minimum(np.minimum(x, WINDOW - 1 - x) + 1, (WINDOW - STEP) // 2 + 1).astype(np.float32)


def _flat_ids(texts: list[str], chunk: int = 256) -> np.ndarray:
    """The characters of all texts, one text after the other, and a window of padding."""
    return np.concatenate([*(char_ids("".join(texts[k : k + chunk])) for k in range(0, len(texts), chunk)), np.full(WINDOW, PAD, np.uint8)])


def _paths(net: Network, texts: list[str]) -> dict[int, np.ndarray]:
    """The tags of every character of the texts, however long, that may have others than O."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ids, starts = _flat_ids(texts), np.cumsum(lengths) - lengths
    # Each window's text and place in it.
    counts = np.maximum(1, -(-(lengths - (WINDOW - STEP)) // STEP))
    of = np.repeat(np.arange(len(texts)), counts)
    places = (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    reach = np.minimum(WINDOW, lengths[of] - places)
    scores: dict[int, np.ndarray] = {}
    sums: dict[int, np.ndarray] = {}
    weight = _weight()[:, None]
    short = lengths[of] <= WINDOW
    for kind in (short, ~short):
        order = np.flatnonzero(kind)
        order = order[np.argsort(reach[order], kind="stable")]
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            own, at, sizes = of[part], places[part], reach[part]
            steps = max(1, int(sizes[-1]))
            got = net.scores(ids[starts[own] + at + np.arange(steps)[:, None]], sizes)
            if kind is short:
                for b in np.flatnonzero(net.may_have(got, sizes)):
                    scores[int(own[b])] = got[: sizes[b], b].copy()
                continue
            for i, a, n, x in zip(own.tolist(), at.tolist(), sizes.tolist(), np.ascontiguousarray(got.transpose(1, 0, 2))):
                if i not in sums:
                    sums[i] = np.zeros((lengths[i], len(TAGS) + 1), np.float32)
                sums[i][a : a + n, :-1] += x[:n] * weight[:n]
                sums[i][a : a + n, -1:] += weight[:n]
    long = sorted(sums, key=lambda i: len(sums[i]))
    for k in range(0, len(long), BATCH // 4):
        part = long[k : k + BATCH // 4]
        sizes = np.array([len(sums[i]) for i in part])
        block = np.zeros((int(sizes.max()), len(part), len(TAGS)), np.float32)
        for b, i in enumerate(part):
            block[: sizes[b], b] = sums[i][:, :-1] / sums[i][:, -1:]
        for b in np.flatnonzero(net.may_have(block, sizes)):
            scores[part[b]] = block[: sizes[b], b].copy()
    found = [i for i in scores if len(scores[i])]
    return dict(zip(found, net.decode([scores[i] for i in found])))


def tag(net: Network, texts: list[str]) -> list[np.ndarray]:
    """The tags of every character of every text, however long."""
    paths = _paths(net, texts)
    return [paths[i] if i in paths else np.zeros(len(t), np.int8) for i, t in enumerate(texts)]


def raw_spans(path: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of one kind; a B tag begins a new one."""
    out, at = [], np.flatnonzero(path)
    k = 0
    while k < len(at):
        a = b = int(at[k])
        kind = (path[a] - 1) // 2
        k += 1
        while k < len(at) and at[k] == b + 1 and (path[at[k]] - 1) // 2 == kind and path[at[k]] % 2 == 0:
            b = int(at[k])
            k += 1
        out.append((a, b + 1, KINDS[kind]))
    return out


def _joined(c: str, d: str) -> bool:
    """Whether two neighbouring characters belong to one word, in scripts that part words."""
    return c.isalnum() and d.isalnum() and c < "\u3000" and d < "\u3000"


def whole_words(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span at whole words, without punctuation at its ends but the '+' or '(' of a telephone number; None where nothing of the kind can be left."""
    while a > 0 and _joined(text[a - 1], text[a]):
        a -= 1
    while b < len(text) and _joined(text[b - 1], text[b]):
        b += 1
    while a < b and not text[a].isalnum():
        a += 1
    while a < b and not (text[b - 1].isdigit() if kind == "phone" else text[b - 1].isalnum()):
        b -= 1
    # A bracket that closes behind the number belongs to what is around it.
    while kind == "phone" and a > 0 and (text[a - 1] == "+" or text[a - 1] == "(" and text.count("(", a, b) < text.count(")", a, b)):
        a -= 1
    item = text[a:b]
    if kind == "name":
        return (a, b) if len(item.split()) > 1 else None
    return (a, b) if item and (kind == "email" or any(c.isdigit() for c in item)) else None


def find(net: Network, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The non-overlapping spans of every text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, path in _paths(net, texts).items():
        own = out[i]
        for a, b, kind in raw_spans(path):
            if (at := whole_words(texts[i], a, b, kind)) and (not own or at[0] >= own[-1][1]):
                own.append((*at, kind))
    return out


def _mapped(df: DataFrame, key: str, text: str, schema: str, rows) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = network()
        for pdf in batches:
            code, texts = pd.factorize(pdf.iloc[:, 1].fillna(""))  # equal texts of a batch are read once
            found = find(net, list(texts))
            yield rows(pdf, code, texts, found)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}, {schema}")


def entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, item, begin int, end int): one row per piece of personal information; offsets in characters.

    Null, empty and blank texts have none. Narrow: one pass over the scan, no shuffle. Repeated rows come out repeated; other columns are ignored
    whatever their names.
    """

    def rows(pdf: pd.DataFrame, code: np.ndarray, texts: np.ndarray, found: list) -> pd.DataFrame:
        hit = np.flatnonzero(np.array([len(f) for f in found], int)[code]) if len(found) else []
        return pd.DataFrame([(pdf.iloc[i, 0], k, texts[code[i]][a:b], a, b) for i in hit for a, b, k in found[code[i]]], columns=[key, "kind", "item", "begin", "end"])

    return _mapped(df, key, text, "kind string, item string, begin int, end int", rows)


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, n_items int): every text with a placeholder like [EMAIL] for each piece; the rest stays as it is, null stays null."""

    def mask(text: str, spans: list) -> str:
        for a, b, k in reversed(spans):
            text = f"{text[:a]}[{k.upper()}]{text[b:]}"
        return text

    def rows(pdf: pd.DataFrame, code: np.ndarray, texts: np.ndarray, found: list) -> pd.DataFrame:
        clean = [mask(t, f) for t, f in zip(texts, found)]
        null = pdf.iloc[:, 1].isna().to_numpy()
        return pd.DataFrame({key: pdf.iloc[:, 0], "text": [None if n else clean[c] for c, n in zip(code, null)], "n_items": [len(found[c]) for c in code]})

    return _mapped(df, key, text, "text string, n_items int", rows)
