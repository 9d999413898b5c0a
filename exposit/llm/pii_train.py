"""Training of the tagger in ``pii`` by backpropagation through time and the CRF's forward-backward algorithm, in numpy.

    python -m exposit.llm.pii_train COMMENTS.parquet [MINUTES [WORKERS [continue]]]

Every step draws new synthetic documents of ``pii_text``: items in carriers among look-alikes and the sentences of unlabelled comments. Of these a bounded
sample is taken, at most ``SAMPLE`` by hash. Training goes in rounds: at first texts with an '@' or a long number are left out of the sample, later those
in which what the weights at hand find is in doubt. What they are sure of stays marked, and most of these items are replaced by new ones, so that the
carriers of unlabelled text are learnt as well.
"""

from __future__ import annotations

import random
import re
import sys
import time
from collections import Counter
from zlib import crc32

import numpy as np

from exposit.llm.pii import CLASSES, PAD, TAGS, WEIGHTS, Network, char_ids, find
from exposit.llm.pii_text import KINDS, document

SAMPLE = 30_000
HIDDEN, EMBED, LENGTH, BATCH = 24, 16, 112, 64


#: How much rarer names are in texts than in training, as a logarithm, for labels that must be sure.
RARER = 5.0


def backgrounds(texts: list[str], weights: dict[str, np.ndarray] | None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of those of a bounded sample of unlabelled texts of which it is known what they hold.

    Without weights at hand these are texts without '@' and long numbers. With weights, they are the texts in which these find the same whether or not
    names are expected to be rare; and those in which only names are in doubt all of whose words, or one of whose very common words, are used in lower case all over
    the sample: these are none.
    """
    taken = sorted(set(texts), key=lambda t: (crc32(t.encode("utf-8", "replace")), t))[:SAMPLE]
    if weights is None:
        return [(t, []) for t in taken if "@" not in t and sum(c.isdigit() for c in t) < 7]
    often = Counter(w for t in taken for w in set(re.findall(r"[^\W\d_]+", t)) if w == w.lower())
    common = lambda item: (n := [often[w] for w in re.findall(r"[^\W\d_]+", item.lower())]) and (min(n) >= 10 or max(n) >= 0.005 * len(taken))
    sure, loose = find(Network(weights, RARER), taken), find(Network(weights, 0.0), taken)
    return [(t, a) for t, a, b in zip(taken, sure, loose) if all(x in a or x[2] == "name" and common(t[x[0] : x[1]]) for x in b) and all(x in b for x in a)]


def encoded(items: list, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(T, B) characters and tags, a random stretch of each long text."""
    x = np.full((LENGTH, len(items)), PAD, np.uint8)
    y = np.zeros((LENGTH, len(items)), np.int64)
    for b, (text, marks) in enumerate(items):
        ids = char_ids(text)
        tags = np.zeros(len(ids), np.int64)
        for s, e, kind in marks:
            k = 1 + 2 * KINDS.index(kind)
            tags[s] = k
            tags[s + 1 : e] = k + 1
        if len(ids) > LENGTH:
            at = int(rng.integers(0, len(ids) - LENGTH + 1))
            if marks and rng.random() < 0.7:
                s, e, _ = marks[int(rng.integers(len(marks)))]
                at = int(np.clip((s + e) // 2 - rng.integers(20, LENGTH - 20), 0, len(ids) - LENGTH))
            ids, tags = ids[at : at + LENGTH], tags[at : at + LENGTH]
        x[: len(ids), b], y[: len(ids), b] = ids, tags
    return x, y


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = len(TAGS)
    p = {"E": rng.normal(0, 0.3, (CLASSES, EMBED)), "o": np.zeros(k), "trans": rng.normal(0, 0.05, (k, k)), "start": np.zeros(k), "end": np.zeros(k)}
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN))
        p[f"U{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        p[f"b{d}"] = np.zeros(4 * HIDDEN)
        p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1.0
        p[f"O{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, k))
    return {n: v.astype(np.float32) for n, v in p.items()}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def crf_loss(e: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
    """Negative log-likelihood per text of the tags ``y`` under scores ``e`` (T, B, K), and its gradients."""
    steps, many, k = e.shape
    trans, start, end = p["trans"], p["start"], p["end"]
    a = np.empty_like(e)
    a[0] = start + e[0]
    for t in range(1, steps):
        a[t] = _lse(a[t - 1][:, :, None] + trans, 1) + e[t]
    z = _lse(a[-1] + end, 1)
    b = np.empty_like(e)
    b[-1] = end
    g = {"trans": np.zeros_like(trans)}
    for t in range(steps - 2, -1, -1):
        nxt = e[t + 1] + b[t + 1]
        b[t] = _lse(trans + nxt[:, None, :], 2)
        g["trans"] += np.exp(a[t][:, :, None] + trans + nxt[:, None, :] - z[:, None, None]).sum(0)
    prob = np.exp(a + b - z[None, :, None])
    at = np.arange(many)
    gold = start[y[0]] + end[y[-1]] + e[0, at, y[0]]
    for t in range(1, steps):
        gold += e[t, at, y[t]] + trans[y[t - 1], y[t]]
    g["trans"] -= np.bincount((y[:-1] * k + y[1:]).ravel(), minlength=k * k).reshape(k, k)
    g["start"] = prob[0].sum(0) - np.bincount(y[0], minlength=k)
    g["end"] = prob[-1].sum(0) - np.bincount(y[-1], minlength=k)
    de = prob
    de[np.arange(steps)[:, None], at[None, :], y] -= 1
    return float((z - gold).mean()), (de / many).astype(np.float32), {n: (v / many).astype(np.float32) for n, v in g.items()}


def gradients(x: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    steps, many = x.shape
    h = HIDDEN
    emb = p["E"][x]
    kept = {}
    e = np.broadcast_to(p["o"], (steps, many, len(TAGS))).astype(np.float32)
    for d in "fb":
        pre = emb @ p[f"W{d}"] + p[f"b{d}"]
        act, cells, states = np.empty_like(pre), np.empty((steps, many, h), np.float32), np.empty((steps, many, h), np.float32)
        state, cell = np.zeros((2, many, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + state @ p[f"U{d}"]
            z[:, : 3 * h] = 0.5 * np.tanh(0.5 * z[:, : 3 * h]) + 0.5
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
            state = z[:, 2 * h : 3 * h] * np.tanh(cell)
            act[t], cells[t], states[t] = z, cell, state
        kept[d] = act, cells, states
        e += states @ p[f"O{d}"]
    loss, de, g = crf_loss(e, y, p)
    g["o"] = de.sum((0, 1))
    demb = np.zeros_like(emb)
    for d in "fb":
        act, cells, states = kept[d]
        g[f"O{d}"] = states.reshape(-1, h).T @ de.reshape(-1, len(TAGS))
        dpre = np.empty_like(act)
        dh, dc = np.zeros((2, many, h), np.float32)
        order = range(steps - 1, -1, -1) if d == "f" else range(steps)
        before = -1 if d == "f" else 1
        for t in order:
            i, f, o, c = (act[t][:, k * h : (k + 1) * h] for k in range(4))
            th = np.tanh(cells[t])
            dh = dh + de[t] @ p[f"O{d}"].T
            dc = dc + dh * o * (1 - th * th)
            prev = cells[t + before] if 0 <= t + before < steps else 0.0
            dpre[t] = np.concatenate([dc * c * i * (1 - i), dc * prev * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - c * c)], 1)
            dh, dc = dpre[t] @ p[f"U{d}"].T, dc * f
        prev = np.zeros_like(states)
        if d == "f":
            prev[1:] = states[:-1]
        else:
            prev[:-1] = states[1:]
        flat = dpre.reshape(-1, 4 * h)
        g[f"U{d}"], g[f"W{d}"], g[f"b{d}"] = prev.reshape(-1, h).T @ flat, emb.reshape(-1, EMBED).T @ flat, flat.sum(0)
        demb += dpre @ p[f"W{d}"].T
    flat = demb.reshape(-1, EMBED)
    g["E"] = np.stack([np.bincount(x.ravel(), flat[:, k], minlength=CLASSES) for k in range(EMBED)], 1).astype(np.float32)
    return loss, g


_ITEMS: dict = {}


def _shard(job: tuple[dict[str, np.ndarray], int]) -> tuple[float, dict[str, np.ndarray]]:
    p, seed = job
    rng, draw = np.random.default_rng(seed), random.Random(seed)
    return gradients(*encoded([document(_ITEMS["texts"], draw, _ITEMS["part"]) for _ in range(BATCH)], rng), p)


def train(texts: list, seconds: float, seed: int = 1, rate: float = 8e-3, steps: int | None = None, workers: int = 1, part: int | None = None, start: dict[str, np.ndarray] | None = None, log=lambda *_: None) -> dict[str, np.ndarray]:  # noqa: ANN001
    """Adam with a falling rate, for so many seconds or steps; each step averages the gradients of ``workers`` batches.

    ``texts`` are backgrounds with their spans; carriers and names of ``part`` are left out; ``start`` goes on from weights.
    """
    import multiprocessing

    _ITEMS.update(texts=texts, part=part)
    pool = multiprocessing.get_context("fork").Pool(workers) if workers > 1 else None
    rng = np.random.default_rng(seed)
    p = start or initial(seed)
    m, v = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))
    began, n, running = time.time(), 0, None
    while (done := (n / steps if steps else (time.time() - began) / seconds)) < 1:
        jobs = [(p, int(k)) for k in rng.integers(0, 1 << 62, workers)]
        shards = pool.map(_shard, jobs) if pool else [_shard(j) for j in jobs]
        loss, g = float(np.mean([x for x, _ in shards])), {k: np.mean([x[k] for _, x in shards], 0) for k in p}
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        clip = min(1.0, 5.0 / max(norm, 1e-9))
        n += 1
        now = rate * (min(1.0, n / 50) * (0.5 * (1 + np.cos(np.pi * done)) + 0.02))
        for k, x in g.items():
            x = x * clip
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            p[k] = p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
        running = loss if running is None else 0.95 * running + 0.05 * loss
        if n % 50 == 0:
            log(f"{n} steps, {time.time() - began:.0f} s, loss {running:.3f}")
    if pool:
        pool.terminate()
    return p


def quality(p: dict[str, np.ndarray], items: list) -> dict[str, tuple[int, int, int]]:
    """By kind: spans found rightly, found wrongly, missed."""
    found = find(Network(p), [t for t, _ in items])
    out = {}
    for kind in KINDS:
        have = {(i, a, b) for i, f in enumerate(found) for a, b, k in f if k == kind}
        want = {(i, a, b) for i, (_, f) in enumerate(items) for a, b, k in f if k == kind}
        out[kind] = (len(have & want), len(have - want), len(want - have))
    return out


#: The part of carriers and names that the kept weights haven't seen.
HELD = 0


def main(args: list[str]) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(args[0], columns=["text"])["text"].to_pylist() if t]
    start = {k: v.astype(np.float32) for k, v in np.load(WEIGHTS).items()} if "continue" in args else None
    texts = backgrounds(texts, start)
    if start:
        start |= {k: np.maximum(start[k], -8.0) for k in ("trans", "start")}
    train_on, held = texts[len(texts) // 20 :], [(t, m) for t, m in texts[: len(texts) // 20] if not m]
    p = train(train_on, 60 * float(args[1] if len(args) > 1 else 6), part=HELD, workers=int(args[2]) if len(args) > 2 else 1, rate=4e-3 if start else 1e-2, seed=2 if start else 1, start=start, log=lambda s: print(s, flush=True))
    rng = random.Random(3)
    print("held-out carriers and names", quality(p, [document(held, rng, HELD, inside=True, plain=0.3) for _ in range(3000)]))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in p.items()})


if __name__ == "__main__":
    main(sys.argv[1:])
