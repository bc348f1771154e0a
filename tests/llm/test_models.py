"""Classifiers: accuracy on rows that were held out, and defined results for odd rows."""

import numpy as np
import pytest
from conftest import DATA

from densigrid.llm import langid, quality, queries, toxicity
from densigrid.llm.bpe import Memo
from densigrid.llm.ship import table

SMALL = DATA.replace("sf0.001", "sf0.01")


def joined(spark, out, name):
    rows = out.join(table(spark, SMALL, name), "doc_id").where("held_out").collect()
    assert rows
    return rows


def test_language(spark):
    out = queries.op2_language(spark, SMALL)
    rows = joined(spark, out, "documents")
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.rejected for r in rows]) < 0.3


def test_language_of_odd_texts(spark):
    model = langid.Model(["a", "b"], np.zeros((langid.BUCKETS, 2)), np.array([0.0, 1.0]))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "x" * 100_000), (4, "x" * 100_000)], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, round(r.score, 3)) for r in langid.identify(docs, model, ["doc_id"]).collect()]
    assert got == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "b", 0.731), (4, "b", 0.731)]


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs), ["doc_id"]).first().lang_pred == "und"


def test_quality(spark):
    rows = joined(spark, queries.op5_quality(spark, SMALL), "labels")
    y, p = np.array([r.quality for r in rows]), np.array([r.predicted for r in rows])
    assert np.mean(p[y == 1]) > 0.95 and np.mean(p[y == 0]) < 0.2


def test_toxicity(spark):
    rows = joined(spark, queries.op10_toxicity(spark, SMALL), "labels")
    y, p, s = (np.array([getattr(r, n) for r in rows]) for n in ("toxic", "predicted", "score"))
    assert np.mean(p[y == 0]) < 0.05 and np.mean(s[y == 1]) > np.mean(s[y == 0]) + 0.2


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_texts(spark, module, label):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a", "a", "word " * 30_000, "%%% !!"])] + [(None, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(2, 1, 1), (3, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        scores = [r.score for r in module.score(docs, module.fit(docs, labels), ["doc_id"]).collect()]
        assert len(scores) == 7 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[2] == scores[3]


def test_held_out_rows_teach_nothing(spark):
    """Labels of held-out rows turned round: the same scores."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.map_to == b.map_to


def test_pu_risk_learns_from_unlabelled_mixtures():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, 2)), rng.normal(-1.5, 1, (600, 2))
    w = quality.pu_fit(good[:1500], np.vstack([good[1500:], bad[:300]]), prior=1500 / 1800)
    z = lambda x: x @ w[:-1] + w[-1]
    # With labels the best rule finds 90 % of the bad ones at this prior; without any, most of them must be found.
    assert np.mean(z(good) > 0) > 0.95 and np.mean(z(bad[300:]) < 0) > 0.75


def long_texts(spark):
    """200 texts of 24,000 characters and more: good or bad, ordinary or toxic, in two languages."""
    rng = np.random.default_rng(5)
    words = {"a": "river garden window letter morning silver table yellow".split(), "b": "fenster garten brief morgen silbern tisch gelbes fluss".split()}
    rows = []
    for i in range(200):
        lang, bad = "ab"[i % 2], i % 4 >= 2
        chosen = list(rng.choice(words[lang], 4000))
        if bad:
            chosen[::9] = ["SCOUNDREL!!#"] * len(chosen[::9])
        rows.append((i, " ".join(chosen), lang, int(not bad), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int").repartition(4)
    assert df.selectExpr("min(length(text))").first()[0] > 20_000
    return df


def test_models_learn_from_long_texts(spark):
    df = long_texts(spark)
    docs, labels = df.drop("quality", "toxic"), df.select("doc_id", "quality", "toxic")
    truth = {r.doc_id: r for r in df.drop("text").collect()}
    assert all(r.lang_pred == truth[r.doc_id].lang for r in langid.identify(docs, langid.fit(docs), ["doc_id"]).collect())
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        got = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels), ["doc_id"]).collect()}
        ones, zeros = ([got[i] for i in got if truth[i][label] == v] for v in (1, 0))
        assert min(ones) > 0.5 > max(zeros), label


def test_stage_without_a_model_drops_nothing(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "Some text."), (2, None)], "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).count() == 2


def test_recall_of_toxicity_in_each_language(spark):
    """Of held-out labelled rows 90 % of the toxic ones are found and 1 % of the others; half at least in each language.

    Most of what is missed is junk (repeats, tables, shouting) without a toxic word of any kind.
    """
    path = DATA.replace("sf0.001", "sf0.1")
    labels = table(spark, path, "labels").where("toxic IS NOT NULL").join(table(spark, path, "documents"), "doc_id").select("doc_id", "lang", "toxic")
    rows = queries.op10_toxicity(spark, path).where("held_out").join(labels, "doc_id").collect()
    found = lambda keep: np.mean([r.predicted for r in rows if keep(r)])
    assert found(lambda r: r.toxic == 1) >= 0.9 and found(lambda r: r.toxic == 0) <= 0.01
    langs = {r.lang for r in rows}
    assert len(langs) == 4 and all(found(lambda r: r.toxic == 1 and r.lang == x) >= 0.5 for x in langs)


def test_rare_material_beyond_chance():
    """0.8 % of the toxic texts have one word, which no ordinary text has; another one is in five toxic texts, as chance would have it."""
    toxic = [{f"w{i % 50}x", *(["scoundrel"] if i < 20 else []), *(["butterfly"] if i >= 2495 else [])} for i in range(2500)]
    found = toxicity.toxic_material(toxic, [{f"w{i % 50}x"} for i in range(2500)])
    assert " scoundrel " in found and not any("butter" in s for s in found)


def test_toxicity_without_spaces(spark):
    rng = np.random.default_rng(3)
    made = lambda i: "".join(rng.choice(list("河流花园窗户信件早晨银色桌子黄色"), 60)) + ("笨蛋" if i % 2 else "") + "".join(rng.choice(list("河流花园窗户"), 20))
    docs = spark.createDataFrame([(i, made(i)) for i in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()}
    assert min(scores[i] for i in scores if i % 2) > 0.5 > max(scores[i] for i in scores if not i % 2)


def test_gains_of_dictionaries():
    base = b" the and of thing with from "
    gain = toxicity.gains(base, base + b" scoundrel ")
    assert gain("scoundrel") >= 4 and gain("thing") <= 1 and gain("the") == 0
    memo = Memo(lambda x: x * 2, 2)
    assert [memo[i] for i in (1, 2, 3, 1, 2)] == [2, 4, 6, 2, 4]


def close(got, want):
    assert len(got) == len(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_language_scores_by_hand(spark):
    """Mean of the n-grams' class scores, softmax, temperature: each n-gram looked up by itself."""
    import zlib

    docs = table(spark, DATA, "documents")
    model, want = langid.fit(docs), {}
    for r in docs.collect():
        grams = [f"<{w}>".encode()[i : i + n] for w in (r.text or "").lower().split() for n in langid.GRAMS for i in range(len(f"<{w}>".encode()) - n + 1)]
        if not any(c.isalpha() for c in r.text or ""):
            want[r.doc_id] = 0.0
            continue
        z = sum(model.scores[zlib.crc32(g) % langid.BUCKETS].astype(float) for g in grams) / len(grams)
        p = np.exp((z + model.bias) / model.heat)
        want[r.doc_id] = float(p.max() / p.sum())
    got = {r.doc_id: r.score for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert len(got) == len(want) and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_quality_scores_by_hand(spark):
    """Shares of word shapes and the eight figures, counted one by one; the linear score; the logistic map."""
    import zlib

    docs = table(spark, DATA, "documents")
    model, want = quality.fit(docs, table(spark, DATA, "labels")), {}
    for r in docs.collect():
        words, x = (r.text or "").split(), np.zeros(quality.SHAPES + quality.FIGURES)
        if words:
            for w in words:
                x[zlib.crc32(quality.shape(w).encode()) % quality.SHAPES] += 1 / len(words)
            x[: quality.SHAPES] **= 0.5
            chars, lines = "".join(words), [x for x in r.text.split("\n") if x.strip()]
            share = lambda f: sum(map(f, chars)) / len(chars)
            twice = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
            x[quality.SHAPES :] = (share(str.isupper), share(str.isdigit), share(lambda c: not c.isalnum()), len(chars) / len(words) / 10, 1 - len(set(words)) / len(words), 1 - len(set(lines)) / max(1, len(lines)), twice, np.log1p(len(words)) / 10)
        z = float(np.clip((x - model.centre) / model.spread, -8, 8) @ model.weights[:-1] + model.weights[-1])
        want[r.doc_id] = 1 / (1 + np.exp(-np.clip(model.map_to[0] * z + model.map_to[1], -40, 40)))
    close({r.doc_id: r.score for r in quality.score(docs, model, ["doc_id"]).collect()}, want)


def test_toxicity_scores_by_hand(spark):
    """Each window compressed with both dictionaries; shares and counts of gains; the logistic function."""
    docs = table(spark, DATA, "documents")
    model, want = toxicity.fit(docs, table(spark, DATA, "labels")), {}
    a, b = toxicity.lengths(model.ordinary), toxicity.lengths(model.toxic)
    for r in docs.collect():
        got = [a(w) - b(w) if len(w) >= toxicity.SHORTEST else 0 for w in toxicity.windows(r.text or "")]
        counts = [sum(x >= g for x in got) for g in toxicity.GAINS]
        x = np.array([*[np.sqrt(c / (len(got) + 20)) for c in counts], *np.log1p([*counts, len(got)])])
        want[r.doc_id] = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -40, 40)))
    close({r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}, want)


def test_samples_are_rows(spark):
    """Labels of documents that are not there, and an id in very many rows, neither empty nor swell the sample."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1000, 1100)] + [(7, f"again {i % 3}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in [7, *range(2000)]], "doc_id long, toxic int")
    from densigrid.llm.learn import labelled_sample

    got = labelled_sample(docs, labels, "toxic", 1, 10**9, -1, 60, lambda: lambda t: t.encode())
    assert len(got) == 60 and sum(x.startswith(b"again") for x in got) in (0, 1, 2, 3)
    assert len(labelled_sample(docs, labels, "toxic", 1, 10**9, -1, 500, lambda: lambda t: t.encode())) == 103


@pytest.mark.parametrize("module", [quality, toxicity, langid])
def test_empty_documents(spark, module):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    if module is langid:
        assert langid.identify(none, langid.fit(none), ["doc_id"]).count() == 0
    else:
        labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
        assert module.score(none, module.fit(none, labels), ["doc_id"]).count() == 0


def test_threshold():
    """Best F1 by trying all; ties of the margin stay together; nothing to choose gives 0."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        margins, y = rng.integers(-3, 4, 30).astype(float), (rng.random(30) < 0.3).astype(float)
        f1 = lambda t: 2 * y[margins > t].sum() / max(1, (margins > t).sum() + y.sum())
        got = toxicity.threshold(margins, y)
        assert got not in margins or got == 0.0
        if y.any() and got != 0.0:
            assert f1(got) == max(f1(t) for t in np.arange(-3.5, 4.0))
    assert toxicity.threshold(np.array([1.0, 1.0]), np.array([1.0, 1.0])) == 0.0
