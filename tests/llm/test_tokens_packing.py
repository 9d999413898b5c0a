from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from exposit.llm import packing, tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
TEXTS = ["", " ", "hello world", "a\xa0b c 　d", "voil\xe0 que  \xe0 \n\n x", "<|endoftext|> x", "x" * 3000, "=" * 900 + " " * 70, "I'LL don't we'll 12345 ١٢", "\U0001f389\U0001f389 ok \U0001f469‍\U0001f469‍\U0001f467", "\ta\x1cb\x85\r\nc", "次は橋の動画 も"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_equal_to_the_tokenizer(reference):
    own = tokens.encoder(PATH)
    for t in [*TEXTS, " ".join(TEXTS), "\n".join(TEXTS)]:
        assert own.encode(t) == reference(t) and own.count(t) == len(reference(t))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\xa0 \xe0ab'sZ09.-=次\U0001f389‍\x1c\x85"), max_size=60))
def test_equal_on_random_text(text):

    own = tokens.encoder(PATH)
    assert own.encode(text) == own.whole(text)


def test_operator_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "hello world", "q"), (3, "hello world", "q"), (None, "x", "q")], "doc_id bigint, text string, ids string")
    rows = sorted(((r["doc_id"] or 0, r["ids"]) for r in tokens.encode_corpus(df, "doc_id", "text").collect()), key=repr)
    assert rows == [(0, [87]), (1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r["n_tokens"] for r in tokens.token_counts(df, "doc_id", "text").collect()) == [0, 0, 1, 2, 2]


def test_packing_fits_and_balances():
    lengths = np.sort(np.random.default_rng(1).integers(1, 2049, 3000))[::-1]
    where, offset = packing.pack(lengths, 2048, 1.0, 1 / 4096)
    for b in range(where.max() + 1):
        at = np.flatnonzero(where == b)
        ends = offset[at] + lengths[at]
        assert ends.max() <= 2048 and (np.sort(offset[at])[1:] == np.sort(ends)[:-1]).all()
    small = np.sort(np.random.default_rng(2).integers(1, 500, 5000))[::-1]
    assert packing.pack(small, 2048, 1.0, 1 / 4096)[0].max() + 1 <= np.ceil(small.sum() / 2048) + 2


def test_pack_items_on_odd_rows(spark):
    sizes = spark.createDataFrame([(1, 5000, "c"), (2, 4096, "c"), (3, 0, "c"), (4, None, "c"), (5, 100, "c"), (5, 100, "c"), (None, 7, "c"), (6, 2048, "c")], "doc_id bigint, n bigint, container string")
    rows = packing.pack_items(sizes, "doc_id", "n").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        assert (r["container"] is None) == (r["length"] == 0)
    assert sorted(by[1]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and sorted(by[2]) == [(0, 0, 2048), (1, 2048, 2048)]
    assert by[3] == by[4] == [(0, 0, 0)] and len(by[5]) == 2 and by[6] == [(0, 0, 2048)] and by[None] == [(0, 0, 7)]
    used = {}
    for r in rows:
        if r["container"]:
            used[r["container"]] = used.get(r["container"], 0) + r["length"]
    assert max(used.values()) <= 2048
    assert packing.pack_items(sizes.limit(0), "doc_id", "n").count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, 0, 5, 40, 64, 65, 128, 200, 640])), min_size=1, max_size=40))
def test_no_container_is_overfull(spark, rows):
    used, n = {}, 0
    for r in packing.pack_items(spark.createDataFrame(rows, "k bigint, n bigint"), "k", "n", capacity=64, shard_items=7).collect():
        n += r["length"]
        if r["container"]:
            used.setdefault(r["container"], []).append((r["offset"], r["length"]))
    assert n == sum(x or 0 for _, x in rows)
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(b for _, b in parts) <= 64
