"""Near-duplicate records: all pairs of texts that share enough words, by R-trees over count vectors.

Two texts match if the words they have in common (with repetition) are at least ``threshold`` of the words in either.
A repeated word is numbered (its first, second, ... occurrence), which turns that ratio into the Jaccard ratio of two sets.

* Texts of equal word sets are one class; only one text of a class is compared.
* Words are hashed into ``GROUPS`` groups; the counts of a text by group are a point. What two texts share
  is at most the sum over the groups of the smaller count, and what a text shares with any text below an R-tree node is at
  most the sum of the minima with the node's upper corner. A pair of nodes or points whose bound is too small is dropped.
* One tree over all texts couldn't be spread over machines, so there is a forest: a text goes to the trees
  of certain rare words. In one global order (rarest first, by exact counts over all texts) two matching texts share at
  least one word among the first ``n - ceil(t n) + 1`` of each, and their first k shared words lie among the first ``n - ceil(t n) + k`` of
  each. A tree's key is such a chain of words. It ends as soon as the expected number of texts
  with these words is small, which depends on the words alone, so both texts of a pair reach the same tree:
  no match is lost, and the work per text doesn't grow with the number of texts.
* No task holds a tree of more than ``BLOCK`` points. Larger ones, as edited copies of one text make them, are told by a count of keys and cut
  by the texts' sizes into blocks of about that many, before any shuffle gathers them. Blocks are written to the shared folder; only the blocks' names and corners
  are joined, pairs whose bound is too small are dropped, and tasks read the two blocks of each other pair.
* Surviving pairs are verified on their whole word sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposit.sources.tables import cut, drop, scratch, written

GROUPS = 64
#: Points in a leaf, and children of an inner node.
LEAF, FAN = 128, 8
BLOCK = 16_384
#: A tree is expected to hold at most so many texts, by the frequencies of its words.
TREE = 12_000
DEEPEST = 5
#: So many of the most frequent words have their counts sent to the tasks; all others are rarer and come before them in the order.
FREQUENT = 65_536
_WORD = re.compile(r"[^\W_]+").findall
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class _Hashes(dict):
    """Word to a 64-bit hash, bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def word_set(text: str, hashes: _Hashes) -> np.ndarray:
    """The numbered words of a text as sorted distinct 64-bit hashes."""
    words = _WORD(text.lower())
    seen: dict[str, int] = {}
    out = []
    for w in words:
        k = seen.get(w, 0)
        seen[w] = k + 1
        h = hashes[w]
        out.append(h if not k else ((h ^ k * _ODD) * _ODD + k) & _MASK)
    return np.sort(np.array(out, np.uint64).view(np.int64))


def word_sets(df: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(key, digest binary, id bigint, n int, words array<bigint>) of texts with ``min_words`` words or more."""
    # Lower case can split a text between any two characters (capital dotted I gains a mark), so n characters may be n words.
    least = min_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            keep, digests, ids, sizes, sets = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = word_set(t, hashes)
                if len(own) >= min_words:
                    d = blake2b(own.tobytes(), digest_size=16).digest()
                    keep.append(i)
                    digests.append(d)
                    ids.append(int.from_bytes(d[:8], "little", signed=True))
                    sizes.append(len(own))
                    sets.append(own)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(digests, pa.binary()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["key", "digest", "id", "n", "words"],
            )

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("_text")).where(F.col("key").isNotNull() & (F.length("_text") >= least))
    return rows.mapInArrow(run, "key string, digest binary, id bigint, n int, words array<bigint>")


def chains(starts: np.ndarray, sizes: np.ndarray, words: np.ndarray, share: np.ndarray, total: float, threshold: float, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, key) of every tree each text goes to. ``words`` lists each text's words, rarest first; ``share`` their shares of texts."""
    least = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    prefix = sizes - least + 1
    texts, keys = [], []
    row = np.arange(len(sizes))
    last = np.full(len(sizes), -1)
    key = np.zeros(len(sizes), np.uint64)
    expected = np.full(len(sizes), float(total))
    for depth in range(1, DEEPEST + 1):
        count = np.maximum(0, np.minimum(prefix[row] + depth - 1, sizes[row]) - (last + 1))
        at = np.repeat(np.arange(len(row)), count)
        if not len(at):
            break
        step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        row, last = row[at], last[at] + 1 + step
        where = starts[row] + last
        key = (key[at] ^ words[where].view(np.uint64)) * np.uint64(_ODD)
        key ^= key >> np.uint64(29)
        expected = expected[at] * share[where]
        # Never deeper than the words any match must share.
        done = (expected <= tree) | (depth == DEEPEST) | (least[row] <= depth)
        texts.append(row[done])
        keys.append(key[done])
        row, last, key, expected = row[~done], last[~done], key[~done], expected[~done]
    return np.concatenate(texts) if texts else np.empty(0, np.int64), (np.concatenate(keys) if keys else np.empty(0, np.uint64)).view(np.int64)


@dataclass
class Points:
    """Texts as points: id, number of words, count bits (one row of two words each) and what goes beyond the bits."""

    ids: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    beyond: np.ndarray

    def __getitem__(self, at: np.ndarray | slice) -> Points:
        return Points(self.ids[at], self.n[at], self.bits[at], self.beyond[at])

    def __len__(self) -> int:
        return len(self.ids)

    def longs(self) -> tuple[np.ndarray, ...]:
        return self.ids, self.n | self.beyond << 32, *np.ascontiguousarray(self.bits.view(np.int64).T)

    @staticmethod
    def of(ids: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> Points:
        return Points(ids, sizes & 0xFFFFFFFF, np.stack([low, high], 1).view(np.uint64), sizes >> 32)


def points_of(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> Points:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    group = (words.view(np.uint64) % np.uint64(GROUPS)).astype(np.int64)
    counts = np.bincount(owner * GROUPS + group, minlength=len(sizes) * GROUPS).reshape(-1, GROUPS)
    place = np.uint64(1) << np.arange(GROUPS, dtype=np.uint64)
    bits = np.stack([((counts >= k) * place).sum(1, dtype=np.uint64) for k in (1, 2)], 1)
    return Points(ids, sizes.astype(np.int64), bits, np.maximum(counts - 2, 0).sum(1))


def _possible(bound: np.ndarray, small: np.ndarray, large: np.ndarray, threshold: float) -> np.ndarray:
    return (small >= threshold * large - 1e-9) & (bound * (1 + threshold) >= threshold * (small + large) - 1e-6)


def _tested(i: np.ndarray, j: np.ndarray, x: Points, y: Points, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those whose summed minima allow a match."""
    bound = np.bitwise_count(x.bits[i] & y.bits[j]).sum(1, dtype=np.int64) + np.minimum(x.beyond[i], y.beyond[j])
    ok = _possible(bound, np.minimum(x.n[i], y.n[j]), np.maximum(x.n[i], y.n[j]), threshold)
    return i[ok], j[ok]


class Tree:
    """A bulk-loaded R-tree: points in order of size and bits. A level is (corner, beyond, least, most) of its nodes, leaves first; a node has ``FAN`` children."""

    def __init__(self, points: Points):
        self.order = np.lexsort((points.bits[:, 1], points.bits[:, 0], points.n))
        self.points = points[self.order]
        self.begin = np.arange(0, len(points), LEAF)
        self.end = np.append(self.begin[1:], len(points))
        self.levels = [(np.bitwise_or.reduceat(self.points.bits, self.begin, axis=0), np.maximum.reduceat(self.points.beyond, self.begin), self.points.n[self.begin], self.points.n[self.end - 1])]
        while len(self.levels[-1][0]) > FAN:
            corner, beyond, least, most = self.levels[-1]
            at = np.arange(0, len(corner), FAN)
            self.levels.append((np.bitwise_or.reduceat(corner, at, axis=0), np.maximum.reduceat(beyond, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def children(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, child) of the children, on the level below, of nodes of ``level``."""
        first = nodes * FAN
        count = np.minimum(FAN, len(self.levels[level - 1][0]) - first)
        at = np.repeat(np.arange(len(nodes)), count)
        return at, first[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def leaf_pairs(x: Tree, y: Tree, own: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of leaves that may hold a match, by going down both trees from their tops."""
    p, q = len(x.levels) - 1, len(y.levels) - 1
    i, j = (k.ravel() for k in np.indices((len(x.levels[p][0]), len(y.levels[q][0]))))
    while True:
        if own:
            i, j = i[i <= j], j[i <= j]
        (cx, bx, lx, mx), (cy, by, ly, my) = x.levels[p], y.levels[q]
        bound = np.bitwise_count(cx[i] & cy[j]).sum(1, dtype=np.int64) + np.minimum(bx[i], by[j])
        # The sizes nearest to each other decide whether any two can match in size; the smallest ones need the least in common.
        ok = (mx[i] >= threshold * ly[j] - 1e-9) & (my[j] >= threshold * lx[i] - 1e-9) & (bound * (1 + threshold) >= threshold * (lx[i] + ly[j]) - 1e-6)
        i, j = i[ok], j[ok]
        if not p and not q:
            return i, j
        down = p >= q, q >= p
        if down[0]:
            at, i = x.children(i, p)
            j = j[at]
        if down[1]:
            at, j = y.children(j, q)
            i = i[at]
        p, q = p - down[0], q - down[1]


def tree_join(x: Tree, y: Tree | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(left ids, right ids) of the points that may match: across two trees, or within ``x``."""
    own, y = y is None, x if y is None else y
    first, second = leaf_pairs(x, y, own, threshold)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    left, right = [], []
    for a in np.unique(first):
        hit = second[np.searchsorted(first, a) : np.searchsorted(first, a, "right")]
        rows = slice(x.begin[a], x.end[a])
        for b in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):  # leaves that follow each other are tested at once
            for start in range(y.begin[b[0]], y.end[b[-1]], 4096):
                cols = slice(start, min(start + 4096, y.end[b[-1]]))
                one, two = x.points.bits[rows], y.points.bits[cols]
                common = np.bitwise_count(one[:, None, 0] & two[None, :, 0])
                common += np.bitwise_count(one[:, None, 1] & two[None, :, 1])
                extra = min(int(x.points.beyond[rows].max()), int(y.points.beyond[cols].max()))
                least = threshold / (1 + threshold) * (int(x.points.n[rows.start]) + int(y.points.n[cols].min())) - extra - 1e-6
                i, j = np.nonzero(common >= least) if least > 0 else (k.ravel() for k in np.indices(common.shape))
                i, j = i + rows.start, j + cols.start
                if own:
                    i, j = i[i < j], j[i < j]
                i, j = _tested(i, j, x.points, y.points, threshold)
                left.append(x.points.ids[i])
                right.append(y.points.ids[j])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


#: Trees of at most so many points are tested as they are, many at once.
SMALL = 24


def _forest(threshold: float):  # noqa: ANN202
    """Reads points sorted by key, trees of any size up to ``BLOCK`` or so; gives candidate pairs."""

    def joined(key: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        points = Points.of(*columns)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        lefts, rights = [], []
        for s in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
            a, b = np.triu_indices(s, 1)
            at = starts[sizes == s]
            i, j = _tested((at[:, None] + a).ravel(), (at[:, None] + b).ravel(), points, points, threshold)
            lefts.append(points.ids[i])
            rights.append(points.ids[j])
        for at, s in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            i, j = tree_join(Tree(points[at : at + s]), None, threshold)
            lefts.append(i)
            rights.append(j)
        if lefts:
            yield _pairs(np.concatenate(lefts), np.concatenate(rights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(batch.column(k).to_numpy() for k in range(5))
            held.append(columns)
            if columns[0][0] == columns[0][-1] and (len(held) == 1 or held[-2][0][-1] == columns[0][0]):
                continue  # one tree so far
            every = [np.concatenate(x) for x in zip(*held)]
            last = np.flatnonzero(every[0] != every[0][-1])[-1] + 1
            yield from joined(*(x[:last] for x in every))
            held = [tuple(x[last:] for x in every)]
        if held:
            yield from joined(*(np.concatenate(x) for x in zip(*held)))

    return run


def _pairs(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], 1), axis=0) if len(left) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["a", "b"])


def _read_block(path: str) -> Tree:
    import pyarrow.fs
    import pyarrow.parquet as pq

    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    table = pq.read_table(at, filesystem=fs, columns=["id", "size", "low", "high"])
    return Tree(Points.of(*(table[c].to_numpy() for c in table.column_names)))


def _block_join(threshold: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(*(batch.column(k).to_pylist() for k in range(2))):
                yield _pairs(*tree_join(_read_block(left), None if left == right else _read_block(right), threshold))

    return run


#: Parts of a large tree by the size of its texts.
BANDS = 64


def _large_trees(points: DataFrame, threshold: float) -> DataFrame:
    """(a, b) candidates of the trees over ``BLOCK`` points: (key, id, size, low, high, much), ``much`` about how many points the tree has."""
    spark = points.sparkSession
    place = (F.col("size").bitwiseAND(F.lit(0xFFFFFFFF)) * (1 << 16) + F.pmod(F.xxhash64("id"), F.lit(1 << 16))).alias("place")
    bounds = points.select("key", place).groupBy("key").agg(F.percentile_approx("place", F.array(*[F.lit(k / BANDS) for k in range(1, BANDS)]), 2000).alias("bounds"))
    # Percentiles depend on the order in which parts are merged: if a lost task were run again with others, its points could miss the blocks already written.
    bounds = cut(bounds)
    band = F.size(F.filter("bounds", lambda x: x < F.col("place")))
    # Bands of the largest trees are still too large and are cut again by hash.
    more = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("much") / (BLOCK * BANDS)))).cast("int")
    few = F.greatest(F.lit(1), F.ceil(F.lit(BANDS) * BLOCK / F.col("much"))).cast("int")
    block = F.concat_ws("_", F.hex("key"), F.floor(band / few).cast("int"), more)
    table = scratch(spark, "blocks")
    points.select("*", place).join(bounds, "key").select("key", "id", "size", "low", "high", block.alias("block")).repartition("block").write.partitionBy("block").parquet(table)
    n, beyond = F.col("size").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("size", 32)
    # A block is what one file holds.
    corners = spark.read.parquet(table).withColumn("path", F.input_file_name()).groupBy("path").agg(F.first("key").alias("key"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high"), F.max(beyond).alias("beyond"), F.min(n).alias("least"), F.max(n).alias("most"))
    corners = cut(corners)
    x, y = (corners.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("low", "high", "beyond", "least", "most", "path")]) for s in "xy")
    bound = F.bit_count(F.col("low_x").bitwiseAND(F.col("low_y"))) + F.bit_count(F.col("high_x").bitwiseAND(F.col("high_y"))) + F.least("beyond_x", "beyond_y")
    near = (F.col("most_x") >= threshold * F.col("least_y") - 1e-9) & (F.col("most_y") >= threshold * F.col("least_x") - 1e-9)
    pairs = cut(x.join(y, "key").where(F.col("path_x") <= F.col("path_y")).where(near & (bound * (1 + threshold) >= threshold * (F.col("least_x") + F.col("least_y")) - 1e-6)).select("path_x", "path_y"))
    found = cut(pairs.repartition(max(1, pairs.count() // 2)).mapInArrow(_block_join(threshold), "a bigint, b bigint").distinct())
    drop(spark, table)
    return found


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, sorted, their counts, what any other word's count is at most) of the most frequent words, at most ``most``.

    A histogram of the counts' size gives the least count to take, so only the words taken go to the driver.
    """
    size = F.floor(F.log2(F.col("count")) * 16).cast("int")
    hist = sorted(counts.groupBy(size.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["b"])
    taken, least = 0, None
    for r in hist:
        if taken + r["n"] > most:
            break
        taken, least = taken + r["n"], r["b"]
    rows = counts.where(size >= least).collect() if least is not None else []
    rows.sort(key=lambda r: r["w"])
    rest = 1 if least is None and not hist else int(2 ** ((hist[0]["b"] + 1 if least is None else least) / 16)) + 1
    return np.array([r["w"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64), rest


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.75, min_words: int = 20, tree: int = TREE) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the texts of ``df``.

    members: (key, digest), one row per key with ``min_words`` words or more; equal digests are one class, whose texts
    have the same words. links: (digest_a, digest_b, common int, either int), once per pair of classes at or over ``threshold``.
    Rows with a null key or text, and shorter texts, have no place in either. Repeated rows count once. If a key has several texts, it is
    a member of several classes. Key comes out as a string under the name ``key``; other columns are ignored whatever their names.
    """
    spark = df.sparkSession
    # Parquet's dictionaries hold the hashes of common words once a file; a checkpoint would be several times larger.
    texts = written(word_sets(df, key, text, min_words), "texts")
    members = written(texts.select("key", "digest").distinct(), "members")
    counts = texts.select(F.explode("words").alias("w")).groupBy("w").count()
    total = texts.count()
    have, much, rest = frequent_words(cut(counts), FREQUENT)
    rank = np.empty(len(have), np.int32)
    rank[np.lexsort((have, much))] = np.arange(len(have), dtype=np.int32)
    known = spark.sparkContext.broadcast((have, much, rank))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, _, rank = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words, sizes = batch.column(3).flatten().to_numpy(), batch.column(2).to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(have, words), max(0, len(have) - 1))
            hit = have[at] == words if len(have) else np.zeros(len(words), bool)
            codes, whose = rank[at[hit]] if len(have) else np.empty(0, np.int32), owner[hit]
            codes = codes[np.lexsort((codes, whose))]
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(o, np.arange(len(sizes) + 1)).astype(np.int32)), pa.array(v)) for o, v in ((whose, codes), (owner[~hit], words[~hit]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *lists], names=["digest", "id", "n", "codes", "rare"])

    # Codes are ranks by frequency, so they take less room than hashes, and both lists are in the global order of words.
    coded = texts.select("digest", "id", "n", "words").mapInArrow(code, "digest binary, id bigint, n int, codes array<int>, rare array<bigint>")
    own = written(coded.dropDuplicates(["digest"]), "classes")
    drop(spark, texts)

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Points, np.ndarray, np.ndarray]:
        """(ids, sizes, points, text index of each tree, key of each tree)."""
        have, much, rank = known.value
        ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
        codes, rare = batch.column(2), batch.column(3)
        n_rare = rare.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        words, number = np.empty(int(sizes.sum()), np.int64), np.full(int(sizes.sum()), rest, np.int64)
        within = np.arange(len(words)) - np.repeat(starts, sizes)
        scarce = within < np.repeat(n_rare, sizes)
        back = np.empty_like(rank)
        back[rank] = np.arange(len(rank), dtype=np.int32)
        at = back[codes.flatten().to_numpy()]
        words[scarce], words[~scarce], number[~scarce] = rare.flatten().to_numpy(), have[at], much[at]
        texts, keys = chains(starts, sizes, words, number / max(1, total), total, threshold, tree)
        return ids, sizes, points_of(ids, sizes, words), texts, keys

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, _, points, texts, keys = placed(batch)
            for k in range(0, len(texts), 100_000):
                rows = points[texts[k : k + 100_000]].longs()
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000]), *map(pa.array, rows)], names=["key", "id", "size", "low", "high"])

    parts = own.select("id", "n", "codes", "rare")
    # A tree over BLOCK has BLOCK / 2 points or more in the tasks that hold at least this many of it, so only those tasks name it.
    least = max(1, BLOCK // (2 * max(1, parts.rdd.getNumPartitions())))

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [placed(batch)[4] for batch in batches if batch.num_rows]
        keys, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys[count >= least]), pa.array(count[count >= least].astype(np.int64))], names=["key", "much"])

    hot = cut(parts.mapInArrow(large, "key bigint, much bigint").groupBy("key").agg(F.sum("much").alias("much")).where(F.col("much") > BLOCK // 2))
    points = parts.mapInArrow(emit, "key bigint, id bigint, size bigint, low bigint, high bigint")
    some = not hot.isEmpty()
    # Broadcast, as a shuffle by key for the join would stand in for the one below, and Spark may then read it by mapper or split it: trees would come in parts.
    cold = points.join(F.broadcast(hot.select("key")), "key", "left_anti") if some else points
    pairs = cut(cold.repartition("key").sortWithinPartitions("key").mapInArrow(_forest(threshold), "a bigint, b bigint"))
    if some:
        pairs = pairs.union(_large_trees(points.join(hot, "key"), threshold))
    # The 64-bit ids only find candidates: what is compared are whole word sets, and classes go by their digests.
    a, b = (own.select(F.col("id").alias(x), F.col("digest").alias(f"digest_{x}"), F.col("n").alias(f"n_{x}"), F.col("codes").alias(f"codes_{x}"), F.col("rare").alias(f"rare_{x}")) for x in "ab")
    checked = pairs.distinct().join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("codes_a", "codes_b")) + F.size(F.array_intersect("rare_a", "rare_b")))
    either = F.col("n_a") + F.col("n_b") - F.col("common")
    links = cut(checked.select("digest_a", "digest_b", "common", either.alias("either")).where(F.col("common") >= threshold * F.col("either")))
    drop(spark, own)
    return links, members


#: Members of one class that a task pairs with each other at a time.
ALIKE = 2_000


def pairs_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): every pair of keys, smaller first, whose texts match: across linked classes, and within a class.

    As many rows as there are such pairs, so a class of m copies has m (m - 1) / 2; ``groups_of`` is the bounded form. Members of
    large classes are spread by salts: the left ones have one of them, the right ones are repeated for each.
    """
    sizes = members.groupBy("digest").count().where(F.col("count") > ALIKE).select("digest", F.ceil(F.col("count") / ALIKE).cast("int").alias("salts"))
    salted = members.join(sizes, "digest", "left").select("key", "digest", F.coalesce("salts", F.lit(1)).alias("salts"))
    one = salted.select(F.col("key").alias("a"), F.col("digest").alias("digest_a"), F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"))
    every = salted.select(F.col("key").alias("b"), F.col("digest").alias("digest_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    within = one.join(every, (F.col("digest_a") == F.col("digest_b")) & (one["salt"] == every["salt"])).where("a < b").select("a", "b")
    # The salts of a link are those of its left class.
    left, right = one, members.select(F.col("key").alias("b"), F.col("digest").alias("digest_b"))
    wide = links.select("digest_a", "digest_b").join(sizes.withColumnRenamed("digest", "digest_a"), "digest_a", "left")
    wide = wide.select("digest_a", "digest_b", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    across = wide.join(left, ["digest_a", "salt"]).join(right, "digest_b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return across.union(within)


def groups_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """(key, class, group, links): one row per key: its class, the smallest class its links lead to, and how many classes it is linked with."""
    from exposit.llm.splits import spanning_forest

    named = links.select(F.hex("digest_a").alias("a"), F.hex("digest_b").alias("b"))
    labels, _ = spanning_forest(named)
    degree = named.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).cast("int").alias("links"))
    own = members.select("key", F.hex("digest").alias("class"))
    return own.join(labels.withColumnRenamed("node", "class"), "class", "left").join(degree, "class", "left").select("key", "class", F.coalesce("root", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
