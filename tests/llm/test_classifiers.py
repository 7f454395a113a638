import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import compression_quality as c
from lodestar.llm import language_id as lang
from lodestar.llm.sampling import labelled_texts
from tests.llm.conftest import ODD


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_on_held_out_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = c.score(docs, c.fit(docs, labels, most_rows=3000)).join(labels, "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    test = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] for r in test if r["quality"] == 1]) > 0.97
    assert np.mean([r["predicted"] for r in test if r["quality"] == 0]) < 0.1
    for low, high in ((0.0, 0.3), (0.9, 1.01)):  # calibrated: the score is the share of good ones
        part = [r for r in test if low <= r["score"] < high]
        assert abs(np.mean([r["score"] for r in part]) - np.mean([r["quality"] for r in part])) < 0.1


def test_quality_of_odd_texts_and_without_labels(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make(list(enumerate(ODD)), extra=True)
    model = c.fit(docs, none)
    assert model.curve == () and {r["score"] for r in c.score(docs, model).collect()} == {0.5}
    one_class = spark.createDataFrame([(k, 1, 0) for k in range(12)], none.schema)
    assert c.fit(docs, one_class).curve == ()
    dice = random.Random(1)
    rows = [(("good words in a row " if y else "*** $$$ ### ") * dice.randrange(3, 40), y, d) for d, y in enumerate([0, 1] * 60)]
    model = c.train(rows)
    out = c.score(docs, model).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not ODD[r["doc_id"]]}) == 1  # null and empty alike
    assert c.score(make([]), model).count() == 0


def test_language_on_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.1/documents.parquet")
    out = lang.predict(docs, lang.fit(docs, most_rows=2500)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in out)
    assert np.mean([r["lang_pred"] == r["lang"] for r in test]) > 0.97
    sure = [r for r in test if not r["rejected"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in sure]) > 0.975


def test_language_of_odd_texts(make):
    docs = make(list(enumerate([*ODD, "123 !?", "ß", "²½"])), extra=True)
    nothing = lang.train([])
    assert {r["lang_pred"] for r in lang.predict(docs, nothing).collect()} == {"und"}
    model = lang.train([("the of and to in", "en", d) if d % 2 else ("le la les une des", "fr", d) for d in range(200)])
    got = {r["doc_id"]: r for r in lang.predict(docs, model).collect()}
    texts = [*ODD, "123 !?", "ß", "²½"]
    for i, t in enumerate(texts):
        letters = t is not None and any(x.isalpha() for x in t)
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1
    assert lang.predict(make([]), model).count() == 0
    assert model.predict("the and of")[0] == "en" and model.predict("une la des")[0] == "fr"


def test_pieces_do_not_change_a_prediction(prose):
    model = lang.train([("the of and to in", "en", d) if d % 2 else ("le la les une des", "fr", d) for d in range(200)])
    long = "the and of to in " * 60_000  # several pieces
    assert len(long) > lang.PIECE and model.predict(long)[0] == "en"
    with pytest.raises(TypeError):
        lang.Model()


def test_rare_languages_and_all_parts_of_texts_are_learned_from(make, monkeypatch):
    seen = []
    monkeypatch.setattr(lang, "train", seen.extend)
    rows = [(k, "start " + "a" * 500 + " rest " + "b" * 500, "en") for k in range(2000)] + [(5000 + k, "short text", "xx") for k in range(8)]
    lang.fit(make(rows), most_rows=60, most_chars=100)
    learnable = [k for k in range(8) if zlib.crc32(str(5000 + k).encode()) % 4 != 2]
    assert len(seen) == 60 and sum(y == "xx" for _, y, _ in seen) == len(learnable) > 0
    assert all(t == "short text" for t, y, _ in seen if y == "xx") and all(len(t) == 100 for t, y, _ in seen if y == "en")
    assert any("b" * 50 in t for t, _, _ in seen) and any("a" * 50 in t for t, _, _ in seen)


def test_rows_are_sampled_with_a_label_of_their_own(spark, make):
    docs = make([(4, f"text {k} of one id", "en" if k % 2 else "fr") for k in range(100)] + [(5, "the same row", "de")] * 500 + [(None, "x", "en"), (7, None, "en"), (8, "y", None)])
    rows = labelled_texts(docs, F.col("lang"), 10_000, 50)
    want = {(f"text {k} of one id", "en" if k % 2 else "fr") for k in range(100) if not held_out(4)} | ({("the same row", "de")} if not held_out(5) else set())
    assert len(rows) == len(want) and {r[:2] for r in rows} == want
    many = make([(9, f"row {k}", "en") for k in range(10_000)])
    assert not held_out(9) and len(labelled_texts(many, F.col("lang"), 60, 50)) == 60


def test_labels_that_are_null_or_differ(spark, make):
    docs = make([(4, "a text"), (4, "another text"), (9, "one more"), (12, "no label")])
    for rows in ([(4, None, 0), (4, 1, 0)], [(4, 1, 0), (4, None, 0)]):
        labels = spark.createDataFrame([*rows, (9, 1, 0), (9, 0, 0), (None, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
        got = {r[:2] for r in labelled_texts(docs, F.col("quality"), 100, 50, labels)}
        assert got == {(t, y) for i, t, y in ((4, "a text", 1), (4, "another text", 1), (9, "one more", 0)) if not held_out(i)}


def test_scores_equal_plain_compression(make, prose):
    """One text at a time, with dictionaries loaded anew and the curve read by hand."""
    import zstandard

    dice = random.Random(3)
    rows = [(prose(k, dice.randrange(5, 60)) if y else "$$$ ### buy now " * dice.randrange(1, 20), y, k) for k, y in enumerate([0, 1] * 80)]
    model = c.train(rows)
    texts = [*ODD, *(t for t, _, _ in rows[:20])]
    got = {r["doc_id"]: r["score"] for r in c.score(make(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        size = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw)) for d in (model.good, model.bad)]
        x, curve = (size[1] - size[0]) / (len(raw) + 16), model.curve
        after = next((k for k, (at, _) in enumerate(curve) if at >= x), None)
        if after in (0, None):
            want = curve[0 if after == 0 else -1][1]
        else:
            (a, p), (b, q) = curve[after - 1 : after + 1]
            want = p + (q - p) * (x - a) / (b - a)
        assert abs(got[i] - want) < 1e-9
    assert [p for _, p in model.curve] == sorted(p for _, p in model.curve)


def test_language_equals_plain_sums(make):
    """N-grams one by one from a dict, over texts longer than a piece."""
    model = lang.train([("the of and to in", "en", d) if d % 2 else ("le la les une des", "fr", d) for d in range(200)])
    rng = np.random.default_rng(1)
    texts = ["the and", "la", "x", "The der LE " * 70_000, "".join(map(chr, rng.integers(97, 400, 300_000)))]
    assert any(len(t.encode()) > lang.PIECE for t in texts)
    got = {r["doc_id"]: r for r in lang.predict(make(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        raw = b" " + t.lower().encode() + b" "
        counts = Counter(raw[k : k + n] for n in (2, 3, 4) for k in range(len(raw) - n + 1))
        z = np.zeros(len(model.languages))
        for gram, times in counts.items():
            h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
            for b in gram:
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
            z += times * model.table[h >> 17].astype(float)
        z = z / counts.total() / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-6
