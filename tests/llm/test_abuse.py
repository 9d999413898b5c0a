from __future__ import annotations

import numpy as np
import pytest

from exposit.llm import abuse as A
from exposit.llm import abuse_text as T


@pytest.fixture(scope="module")
def model():
    return A.fit_with([], T.documents(7, 8, patterns=40))


@pytest.mark.parametrize("text, want", [("5hut up you m0r0n", "shut up you moron"), ("what a p.a.t.h.e.t.i.c rаt", "what a pathetic rat"), ("S-h-u-t- -u-p you", "shut up you"), ("clllllown at 10:44 in 4k", "clown at 10 44 in 4k"), ("pa​thetic sc*m", "pathetic *"), ("рояль лучше", "рояль лучше"), ("l o s e r  b a d", "loser bad"), ("お前はバカだ。黙れ", "お前 は バカ だ 黙れ")])
def test_plain(text, want):
    assert A.plain(text) == want


def kinds(labels):
    return np.array([A.KINDS[y.index(1)] if any(y) else None for _, y in labels], object)


def measured(got, want):
    """(recall, precision) by kind as labelled."""
    return np.mean(got[want != None] == want[want != None]), np.mean(got[got != None] == want[got != None])  # noqa: E711


def by_words(text):
    """What the word classes alone would say."""
    seen = {T.class_of(w) for w in A.plain(text).split()}
    names = {k: 1 + list(T.CLASSES).index(k) in seen for k in T.CLASSES}
    if names["people"] and (names["vermin"] or names["leave"] or names["despise"] or names["insult"]):
        return "hate"
    return "sexual" if names["sex"] else "abuse" if names["insult"] or names["harm"] or names["quiet"] or T.HIDDEN in seen else None


def test_phrasings_that_the_fit_never_saw():
    # Every phrasing is held out once, in ten parts; slots are filled anew, peoples too.
    got, want, words = [], [], []
    for part in range(10):
        fitted = A.fit_with([], T.documents(7, A.WRITTEN, lambda p: not T.held_out(p, part, 10), A.PATTERNED))
        held = T.documents(99, 6, lambda p: T.held_out(p, part, 10))
        got.append(A.kind_of(fitted.documents([t for t, _ in held], A.Tokens())[0]))
        want.append(kinds(held))
        words.append(np.array([by_words(t) for t, _ in held], object))
    got, want, words = (np.concatenate(x) for x in (got, want, words))
    recall, precision = measured(got, want)
    assert recall >= 0.9 and precision >= 0.9
    assert recall > measured(words, want)[0] + 0.1 and precision > measured(words, want)[1] + 0.1


@pytest.mark.parametrize("text, kind", [("go kill yourself", "abuse"), ("you're a worthless piece of shit", "abuse"), ("show me your tits", "sexual"), ("kill the engine before you open the hood", None), ("the naked truth about my camera", None), ("all those Brandovites are vermin", "hate"), ("the Brandovites are kind hosts and cook great soup", None), ("somebody called me an idiot and i reported it", None)])
def test_plain_cases(model, text, kind):
    assert A.kind_of(model.documents([text], A.Tokens())[0])[0] == kind


def test_unlabelled_documents_count_by_what_the_fit_is_sure_of():
    texts = [f"paused at {k} to see the map. that tractor beats the old kettle" for k in range(60)] + [f"you are a stupid clown {k}. zorble the fleem" for k in range(30)]
    fitted = A.fit_with(texts, T.documents(7, 4, patterns=10))
    p = fitted.documents(["that tractor beats the old kettle", "you are a stupid clown"], A.Tokens())[0]
    assert list(A.kind_of(p)) == [None, "abuse"]


def test_many_texts_at_once_as_one_by_one(model):
    texts = ["shut up you clown", "", "a calm day. you idiot!\nsend nudes", "🎉", "the map is nice", "x " * 500]
    known = A.Tokens(most=3)
    whole, _, b = model.documents(texts, known)
    assert b.owner.tolist() == [0, 2, 2, 2, 4, 5] and b.order.tolist() == [0, 0, 1, 2, 0, 0]
    again = A.bags(["one. two!\none. three. two"], known)
    assert again.owner.tolist() == [0, 0, 0] and again.order.tolist() == [0, 1, 3]
    assert np.allclose(whole, np.concatenate([model.documents([t], known)[0] for t in texts]))
    assert not whole[1].any() and not whole[3].any()


def test_noisy_or():
    p = np.array([[0.5], [0.5], [0.25]])
    assert A.noisy_or(p, np.array([0, 0, 1]), 3).ravel() == pytest.approx([0.75, 0.25, 0.0])


def test_operator_finds_the_sentence(spark, model):
    df = spark.createDataFrame([("a", "A calm day by the river. shut up you clown. Then we went home."), ("b", None), ("c", ""), ("d", "this bassline is sick, dumb luck or not"), ("e", "we talked about bridges. " * 4000), ("a", "A calm day by the river. shut up you clown. Then we went home.")], "id string, text string").withColumn("abuse", A.F.lit(1)).withColumn("kind", A.F.lit("x"))
    rows = A.score(df, "id", "text", model).collect()
    assert [(r["kind"], r["sentence"]) for r in rows if r["id"] == "a"] == [("abuse", 1)] * 2
    assert len(rows) == 6 and all(r["kind"] is None for r in rows if r["id"] != "a")
    assert A.score(df.limit(0), "id", "text", model).count() == 0


def test_rates(spark):
    scored = spark.createDataFrame([("a", "abuse"), ("b", None), ("c", "hate"), ("d", None)], "id string, kind string")
    owners = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "id string, source string")
    got = {r["source"]: (r["documents"], r["abuse_rate"], r["hate_rate"], r["sexual_rate"]) for r in A.rates(scored, owners, "id", "source").collect()}
    assert got == {"s": (2, 0.5, 0.0, 0.0), "t": (1, 0.0, 1.0, 0.0), None: (1, 0.0, 0.0, 0.0)}
