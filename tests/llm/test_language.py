from __future__ import annotations

import itertools

import numpy as np
import pytest

from exposit.llm import language as L

SENTENCES = {
    "en": ["the guitar is better than the old bridge", "can someone explain how the engine works", "i never knew this about the kitchen", "we were looking for the map of the volcano"],
    "de": ["vielen dank für das video über die brücke", "ich verstehe nicht warum das so schön ist", "mein opa hat früher auch das getriebe gebaut", "wo kann man die karte kaufen"],
    "fr": ["merci beaucoup pour cette vidéo sur le pont", "je ne comprends pas pourquoi c'est si fragile", "mon père parlait toujours de la cuisine", "où peut on trouver le moteur"],
    "ja": ["ギターはどこで買えますか", "橋の説明がとても分かりやすかったです", "祖父も昔火山を作っていました", "次は地図の動画もお願いします"],
}
SAMPLE = [(t, c) for c, ts in SENTENCES.items() for t in ts]


@pytest.fixture(scope="module")
def model():
    return L.fit(SAMPLE, f"{L.TOKENIZERS}/piece_bpe_32k.model")


def test_forward_sums_all_segmentations(model):
    word = "brücke"
    s, total = "▁" + word, 0.0
    for cuts in itertools.product([0, 1], repeat=len(s) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
        p = 1.0
        for a, b in zip(at, at[1:]):
            piece = model.pieces.get(s[a:b])
            p = p * (model.p[piece, 0] if piece is not None else model.unknown if b - a == 1 and s[a:b] not in model.pieces else 0.0)
        total += p
    assert model.log_likelihood(word)[0] == pytest.approx(__import__("math").log(total), rel=1e-6)


def test_mixed_text_and_segments(model):
    text = "Vielen Dank für das Video über die Karte. The engine is better than the kitchen\nギターの説明がとても分かりやすかったです"
    assert [d[2] for d in L.detect(model, text)] == ["de", "en", "ja"]
    assert [d[2] for d in L.detect(model, "merci beaucoup pour cette vidéo sur la cuisine / the guitar is better than the map")] == ["fr", "en"]
    assert all(0 < d[3] <= 1 for d in L.detect(model, text))


def test_every_line_has_its_language(model):
    assert [d[2] for d in L.detect(model, "Vielen Dank für das Video\nmerci beaucoup\nthe guitar is better than the map")] == ["de", "fr", "en"]


def test_calibrated_confidence_and_no_language():
    held = [(f"{t} und {t}" if c == "de" else t, c) for c, ts in SENTENCES.items() for t in ts]
    own = L.fit(SAMPLE, f"{L.TOKENIZERS}/piece_bpe_32k.model")
    L.calibrate(own, held)
    assert own.temperature >= 0.5 and np.isfinite(own.usual[:, [L.CODES.index(c) for c in SENTENCES]]).all()
    found = L.detect(own, "xqzv wkjh qqrt zxcm vbnq wpoe jhgf qazx wsxe dcrf vtgb yhnu jmik olpq")
    assert [d[2] for d in found] == ["und"] and 0 <= found[0][3] <= 1
    assert L.detect(own, "the map of the old bridge is better")[0][2] == "en"


def test_labels_in_any_spelling(spark):
    said = ["en", "EN", "en_GB", "English", "eng", "de-AT", "German", "jpn", "pt-BR", "ms", None, "", "und", "XX", "Français"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, l string").orderBy("i").select(L.label_code(L.F.col("l"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "de", "de", "ja", "pt", "ms", None, None, None, None, "français"]


def test_operator_on_odd_rows(spark, model):
    df = spark.createDataFrame([("a", "wo kann man die brücke kaufen", "q"), ("b", None, "q"), ("c", "", "q"), ("d", "12 🎉 ...", "q"), ("e", "the map of the old bridge is here. " * 3000, "q"), ("a", "wo kann man die brücke kaufen", "q")], "id string, text string, lang string")
    rows = L.segments(df, "id", "text", model).collect()
    assert sorted((r["id"], r["lang"]) for r in rows) == [("a", "de"), ("a", "de"), ("b", None), ("c", None), ("d", None), ("e", "en")]
    assert L.segments(df.limit(0), "id", "text", model).count() == 0
    assert L.fit_on(df.limit(0).withColumn("code", L.F.lit("en")), "id", "text", "code").prior.sum() == pytest.approx(1)


def test_misdeclared(spark):
    found = spark.createDataFrame([("a", "en"), ("b", "de"), ("c", "en"), ("c", "fr"), ("d", "pl"), ("e", None)], "id string, lang string")
    said = spark.createDataFrame([("a", "en"), ("b", "en"), ("c", "en"), ("d", None), ("e", None)], "id string, code string")
    assert {tuple(r) for r in L.misdeclared(found, said, "id").collect()} == {("b", "de"), ("c", "en"), ("c", "fr"), ("d", "pl")}
