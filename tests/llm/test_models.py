"""Classifiers by held-out accuracy, and the pipeline stage by stage."""

import os
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from helpers import rows

from framewalk.llm import decontamination, line_dedup, quality_classifier, simhash, toxicity
from framewalk.llm.common import Workspace

SF = "/root/testdata/sf0.1"


def held_out(made, target, duck_path=SF):
    import duckdb

    labels = dict(duckdb.connect().execute(f"SELECT doc_id, {target} FROM '{duck_path}/labels.parquet'").fetchall())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in made)
    assert all(0 <= r["score"] <= 1 for r in made)
    known = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in made if r["held_out"] and r["doc_id"] in labels]
    score, predicted, y = (np.array(x) for x in zip(*known))
    order = score.argsort()
    rank = np.empty(len(y))
    rank[order] = np.arange(len(y)) + 1
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    return auc, (predicted == y).mean(), predicted, y


def test_quality(spark):
    made = quality_classifier.op9_quality_classifier(spark, SF).collect()
    auc, accuracy, predicted, y = held_out(made, "quality")
    assert auc > 0.99 and accuracy > 0.98
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) for r in made)


def test_toxicity(spark):
    made = toxicity.op2_toxicity(spark, SF).collect()
    auc, accuracy, predicted, y = held_out(made, "toxic")
    assert auc > 0.95 and accuracy > 0.97
    assert predicted[y == 0].mean() < 0.01
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) for r in made)


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "some text", "x"), (3, "a " * 50_000, "x"), (3, "you idiot", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("scores", [quality_classifier.quality_scores, toxicity.toxicity_scores])
def test_odd_tables(odd, scores):
    docs, labels = odd
    made = scores(docs, labels)
    assert made.columns == ["doc_id", "held_out", "score", "predicted"]
    got = made.collect()
    assert len(got) == 5 and all(0 < r["score"] < 1 for r in got)
    assert len({r["score"] for r in got}) == 1  # labels of one class only: the smoothed share
    assert scores(docs.limit(0), labels).count() == 0
    assert scores(docs, labels.limit(0)).count() == 5


def test_dual_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ np.array([1.0, -2, 0, 0.5, 0]) + 0.3 > 0, 1.0, -1.0)
    w = quality_classifier.dual_descent([np.arange(5)] * 200, list(x), y, 5, cost=10, rounds=60)
    assert ((x @ w[:5] + w[5]) * y > 0).mean() > 0.97


def test_isolated_labels(spark):
    """Held-out labels do not enter: changing them changes nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    assert rows(quality_classifier.quality_scores(docs, labels)) == rows(quality_classifier.quality_scores(docs, turned))


def test_all_doubled_tokens_count():
    doubled = " ".join(f"a{k} a{k}" for k in range(50))
    grams = quality_classifier.ngrams(doubled, quality_classifier.Shapes())
    assert ("=", "many", "=") in grams and ("=", "some", "=") not in grams
    rest = " ".join(f"b{k}" for k in range(100))
    assert ("=", "some", "=") in quality_classifier.ngrams(f"{doubled} {rest}", quality_classifier.Shapes())


def test_every_frequent_ngram_is_kept(spark):
    words = " ".join(f"w{k}" for k in range(35_000))
    docs = spark.createDataFrame([(k, f"{words} tail{k}") for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    number = quality_classifier.fit(docs, labels, "quality").number
    assert {f"w{k}" for k in range(35_000)} | {(f"w{k}", f"w{k + 1}") for k in range(34_999)} <= number.keys()
    few = quality_classifier.fit(docs, labels, "quality", most_ngrams=1)  # very long texts: fewer rows, here none
    assert not few.number


def test_hinge_loss_optimum():
    """At the end no row's dual variable could move: 0 beyond the margin, its cost inside, between them on it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4))
    y = np.where(x[:, 0] - x[:, 1] + rng.normal(size=120) > 0.4, 1.0, -1.0)

    def loss(w):
        share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
        return w @ w / 2 + (np.maximum(0, 1 - y * (x @ w[:4] + w[4])) / (2 * share)).sum()

    w = quality_classifier.dual_descent([np.arange(4)] * 120, list(x), y, 4, rounds=400)
    assert all(loss(w) <= loss(w + rng.normal(size=5) * s) * 1.001 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_log_ratios():
    n, p = np.array([10.0, 10, 4]), np.array([9.0, 1, 2])
    a, b = p + 1, n - p + 1
    assert np.allclose(quality_classifier.log_ratios(n, p), np.log(a / a.sum()) - np.log(b / b.sum()))


def test_ngrams():
    grams = quality_classifier.ngrams("The the 12 cats!", quality_classifier.Shapes())
    assert grams == {"The", "the", "12", "cats", "!", ("The", "the"), ("the", "12"), ("12", "cats"), ("cats", "!"), ("Xx", "x", "0"), ("x", "0", "x"), ("0", "x", "!")}
    assert quality_classifier.ngrams(None, quality_classifier.Shapes()) == {("", "empty", "")}
    assert all(quality_classifier.gram(quality_classifier.key(g)) == g for g in grams)


def test_numbers_are_those_of_the_ngrams():
    """Of any text the numbers of just those of its n-grams that the model has, whatever is left out of the model."""
    rng = np.random.default_rng(8)
    words = ["The", "the", "12", "cats!", "...", "A1", "né", "x_y", "\U0001f600", "#", "OK", "a", "a"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(200)] + [None, "", " \n", "a a a a", "a", "a b"]
    s = quality_classifier.Shapes()
    every = sorted({g for t in texts for g in quality_classifier.ngrams(t, s)}, key=repr)
    for share in (1.0, 0.5, 0.0):
        kept_words = {g for g in every if isinstance(g, str) and rng.random() < share}
        model = {g for g in every if g in kept_words or (len(g) == 2 and not isinstance(g, str) and set(g) <= kept_words and rng.random() < 0.8) or (isinstance(g, tuple) and len(g) == 3 and rng.random() < share)}
        numbers = quality_classifier.Numbers(pa.array(sorted(map(quality_classifier.key, model)), pa.string()))
        grams, shapes = numbers.grams(), quality_classifier.Shapes(numbers.shapes)
        assert set(grams) == model and len(grams) == len(model)
        assert [grams[i] for i in range(len(grams))] == [quality_classifier.gram(sorted(map(quality_classifier.key, model))[i]) for i in numbers.order]
        for t in texts:
            found = numbers.of(t, shapes)
            assert {grams[i] for i in found} == quality_classifier.ngrams(t, s) & model
            assert (np.diff(found) > 0).all()


def test_memory_of_a_large_model():
    """Six million n-grams, the most that the stated bounds allow, take less than 300 MB in a worker."""
    import pickle
    import subprocess
    import sys

    words = [f"w{k}" for k in range(600_000)]
    rng = np.random.default_rng(1)
    ends = np.unique(rng.integers(0, 600_000, (5_450_000, 2)), axis=0)[:5_400_000]
    grams = pa.concat_arrays([pa.array(words), pc.binary_join_element_wise(*(pa.array(words).take(pa.array(e)) for e in ends.T), quality_classifier.SEP)])
    numbers = quality_classifier.Numbers(grams)
    model = quality_classifier.Model(numbers, np.zeros(len(grams)), np.zeros(len(grams)), 0.0, 1.0, 0.0)
    code = (
        "import pickle, sys; from framewalk.llm import quality_classifier as q; size = lambda: int(next(x for x in open('/proc/self/status') if x.startswith('VmRSS')).split()[1]);"
        "before = size(); m = pickle.load(sys.stdin.buffer); m.score('w1 w2 w3', q.Shapes(m.numbers.shapes)); print((size() - before) // 1024)"
    )
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, input=pickle.dumps(model, protocol=5), capture_output=True, timeout=300)
    assert int(said.stdout) < 300, said


def test_scores_do_not_depend_on_the_order_of_sets():
    """The same in processes that hash strings in another way."""
    import os
    import subprocess
    import sys

    code = (
        "import numpy as np; from framewalk.llm import quality_classifier as q; rng = np.random.default_rng(0);"
        "text = ' '.join('a%d a%d' % (k, k) for k in range(40)) + ' ' + ' '.join('b%d' % (k % 37) for k in range(90)); s = q.Shapes(); g = sorted(q.ngrams(text, s), key=repr);"
        "m = q.Model({x: i for i, x in enumerate(g)}, rng.normal(size=len(g)), rng.normal(size=len(g)), .1, 1., .2); print(repr(m.score(text, s)))"
    )
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    said = {subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONHASHSEED": str(k)}, capture_output=True, text=True, timeout=120).stdout for k in range(5)}
    assert len(said) == 1 and float(said.pop()) > 0


def test_toxic_features():
    read = toxicity.Reader(frozenset({"idiot", "stup-"}))
    f = dict(zip(toxicity.FEATURES, read.features("You are an IDIOT, so stupid! 1d10t i-d-iot? ok ok 7")))
    n = 11
    assert f["lexicon"] == 1 / n and f["stems"] == 1 / n and f["second"] == 1 / n
    assert f["obfuscated"] == 2 / n and f["obfuscated_hits"] == 2 / n  # both read idiot
    assert f["second_near"] == 1 / n and f["capital_words"] == 1 / n and f["exclaims"] == 1 / n and f["questions"] == 1 / n
    assert f["log_hits"] == np.log1p(4) and f["densest"] == 4
    assert read.features(None) == read.features(" \n") == [0.0] * len(toxicity.FEATURES)
    long = read.features("you idiot " * 200_000)
    assert abs(long[toxicity.FEATURES.index("lexicon")] - 0.5) < 1e-9


def test_lexicon(spark):
    """Entries much more frequent in toxic texts, of each half and of both, however many they are; frequent and rare words are not."""
    rows_ = [(f"the vile{k % 2} word and thing{k}", 1, k % 2) for k in range(40)] + [(f"the kind word and thing{k}", 0, k % 2) for k in range(40)]
    sample = spark.createDataFrame(rows_, "text string, y int, half int")
    first, second, both = toxicity.learn_lexicons(sample, Workspace(spark, "test"))
    assert "vile0" in first and "vile1" not in first and "vile1" in second and {"vile0", "vile1", "vile-"} <= both
    assert not {"the", "word", "kind", "thing1"} & both
    many = [(" ".join(f"bad{j}" for j in range(6000)) if k % 2 else "good text", k % 2, k // 2 % 2) for k in range(60)]
    assert len(toxicity.learn_lexicons(spark.createDataFrame(many, "text string, y int, half int"), Workspace(spark, "test"))[2] - {"bad0"}) >= 5999


def test_isolated_toxic_labels(spark):
    """Held-out labels, languages, sources and ids do not enter a score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    made = rows(toxicity.toxicity_scores(docs, labels))
    assert made == rows(toxicity.toxicity_scores(docs.withColumns({"lang": docs["doc_id"].cast("string"), "source": docs["text"]}), turned))


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, work = docs.columns, Workspace(spark, "test")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(work.keep(stage(spark, kept[-1], sf), str(k)))
    assert all(d.columns == columns for d in kept[:-1])
    assert all(set(a.schema[c].dataType.simpleString() for c in columns) == set(docs.schema[c].dataType.simpleString() for c in columns) for a in kept[:-1])
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r["doc_id"] for r in kept[1].select("doc_id").collect()} == {r["doc_id"] for r in scores.where("predicted = 0").collect()}
    assert kept[2].count() == kept[1].count()
    assert line_dedup.removals(kept[2], "doc_id", "text", "source", line_dedup.MIN_SITES, 8, work).count() == 0
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    fps = {d: simhash.fingerprint(t) for d, t in texts.items()}
    ids, parent = sorted(fps), {d: d for d in fps}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    values = np.array([fps[d] for d in ids], np.uint64)
    for k, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4):
            a, b = find(d), find(ids[j])
            parent[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in kept[3].select("doc_id").collect()} == {d for d in ids if find(d) == d}
    items = [decontamination.words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {r["doc_id"]: " ".join(decontamination.words_of(r["text"])) for r in kept[3].collect()}
    left = {r["doc_id"] for r in kept[4].select("doc_id").collect()}
    assert not any(" ".join(x) in whole[d] for d in left for x in items)
    assert all(any(" ".join(x[:8]) in t or " ".join(x[-8:]) in t for x in items) for d, t in whole.items() if d not in left)
    assert {r["doc_id"] for r in kept[5].collect()} == left
    assert rows(corpus_pipeline.run(spark, sf)) == rows(kept[5])
