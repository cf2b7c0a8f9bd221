"""Language ID, toxicity, quality and LM scoring: exactness of their parts, held-out accuracy, odd input."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, lm_scoring, quality_classifier, toxicity
from tidemark.llm.common import read, remainder

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.concatenate([s[y == 0], s[y == 1]]), kind="stable")
    ranks = np.empty(len(order))
    values = np.concatenate([s[y == 0], s[y == 1]])
    for v in np.unique(values):
        ranks[values == v] = (values < v).sum() + ((values == v).sum() + 1) / 2
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    return (ranks[n0:].sum() - n1 * (n1 + 1) / 2) / (n0 * n1)


def test_language_is_known_on_held_out_rows(spark):
    docs = read(spark, SF, "documents")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) == docs.where(remainder(F.col("doc_id"), 4) == 2).count()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_predictions_ignore_other_columns(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs)
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    masked = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("?"))
    assert plain == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(masked, model).collect()}


def test_language_of_odd_rows(spark, odd, empty):
    got = language_id.language_id(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1, 2, 3, 6))
    assert by[8]["lang_pred"] in ("en", "fr")
    assert language_id.language_id(empty).count() == 0
    unlabelled = language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_families_come_first():
    draw = np.random.default_rng(1)
    x = np.abs(draw.normal(0, 0.02, (80, language_id.WIDTH))).astype(np.float32)
    langs = ["en", "de", "fr", "xx"] * 20
    for k, z in enumerate(langs):
        x[k, "en de fr xx".split().index(z)] = 1
    model = language_id.LanguageModel(x, langs)
    assert model.families == ["germanic", "romance", "xx"] and list(model.pairs) == [(0, 1)]
    assert model.predict(x)[0] == langs


def test_toxicity_is_known_on_held_out_rows(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    docs = docs.join(labels, "doc_id", "left_semi")
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    assert auc(y, s) > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_nearest_examples_are_exact():
    draw = np.random.default_rng(2)
    words = [f"w{k}".encode() for k in range(60)]
    make = lambda: Counter({words[j]: int(draw.integers(1, 5)) for j in draw.integers(0, 60, 8)})
    examples = [make() for _ in range(500)] + [Counter()]
    examples += [examples[0]] * 30  # ties
    df = Counter(w for e in examples for w in e)
    unit = lambda c: (lambda v: v / max(np.linalg.norm(v), 1e-12))(np.array([(1 + np.log(c[w])) * np.log1p(len(examples) / (df[w] + 1)) if c[w] else 0 for w in words]))
    vectors = np.array([unit(e) for e in examples])
    queries = [make() for _ in range(60)]
    for dense in (0, 7, 60):
        index = toxicity.BlockMaxIndex(examples, draw.integers(0, 2, len(examples)), words, block=16, dense=dense)
        together = index.nearest_of([index.vector(q) for q in queries], 10)
        for query, near in zip(queries, together):
            dots = vectors @ unit(query)
            assert np.allclose([s for s, _ in near], np.sort(dots[dots > 0])[::-1][:10])
            assert len({j for _, j in near}) == len(near) and near == index.nearest(query, 10)
            assert all(a[0] > b[0] or a[1] < b[1] for a, b in zip(near, near[1:]))
        assert index.nearest(Counter({b"unknown": 3})) == []
        assert np.array_equal(index.text_vector(b"w1 W2 w1 zz")[0], index.vector(toxicity.term_counts(b"w1 w2 w1"))[0])


def test_rare_words_reach_the_labelled_examples(spark):
    # each example has its own words only, so no word tells the classes apart in four documents
    rows = [(k, f"alpha{chr(97 + k // 26)}{chr(97 + k % 26)} beta{chr(97 + k // 26)}{chr(97 + k % 26)}", None, None, 1) for k in range(200)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    letters = docs.withColumn("text", F.translate("text", "0123456789", ""))
    model = toxicity.fit(letters, labels)
    hits = [model.index.nearest(toxicity.term_counts(r[1].encode())) for r in rows]
    assert len(model.index.labels) > 90 and sum(bool(h) and h[0][0] > 0.999 for h in hits) == len(model.index.labels)
    df, n = toxicity.document_frequencies(letters.union(letters), [b"alphaaa", b"nowhere"])
    assert df.tolist() == [2, 0] and n == 400


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, 1, int(k == 8)) for k in range(1, 12)] + [(3, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_quality_is_known_on_held_out_rows(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = quality_classifier.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert auc(y, s) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_isotonic_levels_rise_and_keep_sums():
    draw = np.random.default_rng(3)
    y, w = draw.random(200), draw.random(200) + 0.1
    level = quality_classifier.isotonic(np.arange(200), y * w, w)
    assert (np.diff(level) >= -1e-12).all() and np.isclose((level * w).sum(), (y * w).sum())
    assert len(quality_classifier.isotonic(np.zeros(0), np.zeros(0), np.zeros(0))) == 0


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, int(k > 6), 0) for k in range(1, 12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("x", F.lit("clash"))
    got = quality_classifier.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality_classifier.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


@pytest.fixture(scope="module")
def net(spark):
    return lm_scoring.fit(read(spark, SF, "documents"))


def test_word_counts_cover_all_documents(spark, odd):
    got = {bytes(r["word"]): r["n"] for r in lm_scoring.word_counts(odd).collect()}
    want = Counter(w for r in odd.select("text").collect() for w in lm_scoring.tokens((r["text"] or "").encode()))
    assert got == want


def test_pseudo_likelihood_by_hand(net):
    ids, place, owner = net.padded([b"the cat of the", None, b"and"])
    assert owner.tolist() == [0, 0, 0, 0, 2]
    lp = net.log_probs(ids, place)
    for k, at in enumerate(place):
        h = np.tanh(sum(net.weights[0][j][ids[at + s]] for j, s in enumerate((-2, -1, 1, 2))))
        logits = (h @ net.weights[1] + net.weights[2]).astype(float)
        assert np.isclose(lp[k], logits[ids[at]] - np.log(np.exp(logits).sum()), atol=1e-4)


def test_training_beats_unigrams(spark, net):
    texts = [r["text"].encode() for r in read(spark, SF, "documents").limit(200).collect()]
    ids, place, _ = net.padded(texts)
    alone = net.weights[2] - np.log(np.exp(net.weights[2]).sum())
    counts = np.bincount(ids[place], minlength=lm_scoring.CLASSES) / len(place)
    entropy = np.log(np.maximum(counts, 1e-9))[ids[place]].mean()
    assert net.log_probs(ids, place).mean() > entropy + 0.2 > -np.log(lm_scoring.CLASSES)
    assert np.isfinite(alone).all()


def test_scores_of_odd_rows(spark, odd, empty, net):
    got = lm_scoring.lm_scores(odd, net).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["n_tokens"] == 0 and by[k]["log_prob"] == 0 and by[k]["mean_log_prob"] is None for k in (1, 2, 3))
    assert all(np.isclose(r["mean_log_prob"] * r["n_tokens"], r["log_prob"]) and r["log_prob"] < 0 for r in got if r["n_tokens"])
    assert lm_scoring.lm_scores(empty).count() == 0


def test_every_word_of_the_corpus_has_its_own_probability(spark, net):
    common = [(k, "the cat of the house xqzing", None, None, 1) for k in range(9)]
    docs = spark.createDataFrame([*common, (20, "zzzing", None, None, 1), (21, "xqzing", None, None, 1), (None, "zzzing", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r["doc_id"]: r["log_prob"] for r in lm_scoring.lm_scores(docs, net).collect()}
    assert np.isclose(got[21] - got[20], np.log(10 / 2)) and got[None] == got[20]  # one class, ten occurrences and two
    ids, place, _ = net.padded([b"zzzing"])
    total = sum(n for w, n in [(b"xqzing", 10), (b"zzzing", 2)])
    assert np.isclose(got[20], net.log_probs(ids, place)[0] + np.log(2 / (total + 1)), atol=1e-4)
    counts = spark.createDataFrame([(b"xqzing", 40)], "word binary, n long")
    told = {r["doc_id"]: r["log_prob"] for r in lm_scoring.lm_scores(docs, net, counts).collect()}
    assert np.isclose(told[21] - told[20], np.log(40))


def test_every_position_is_masked_in_one_round(net):
    batch = [b"one two three four " * 50, None, b"five", b"one two three four " * 50]
    _, place, owner = net.padded(batch)
    rounds = [lm_scoring.chosen(batch, place, owner, k, 2) for k in range(2)]
    assert sorted(np.concatenate(rounds).tolist()) == place.tolist() and min(map(len, rounds)) > 100


def test_quality_learns_from_labels_of_0_and_1(spark):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    plain = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(docs, labels).collect()}
    odd = labels.union(docs.select("doc_id", F.element_at(F.array(*map(F.lit, (float("nan"), 7.0, -1.0, None))), (F.col("doc_id") % 4 + 1).cast("int")).alias("quality")))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.quality_scores(docs, odd).collect()}
    assert plain.keys() == got.keys() and all(abs(plain[k] - got[k]) < 1e-9 for k in plain) and all(0 <= v <= 1 for v in plain.values())
