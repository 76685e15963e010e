import random
import zlib

import numpy as np
import pytest

from tabulant.llm import toxicity

RUDE = ["idiot", "moron", "scum"]


def prose(rng, n):
    return [rng.choice("the of and to in table river house green water stone walk light under field".split()) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled():
    rng, rows = random.Random(1), []
    for i in range(600):
        words = prose(rng, rng.randrange(5, 300))
        if i % 5 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", "s", "ish"]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.fit([r[1] for r in labelled], [r[2] for r in labelled])


def test_unseen_misspellings(model):
    rng = random.Random(2)
    for word in ("idiiot", "IDIOTIC", "morons", "moronn", "scumm", "xidiot"):
        for n in (3, 200):
            words = prose(rng, n)
            words.insert(n // 2, word)
            # the clean texts of as many words are the yardstick: log-odds rise by more than one
            assert model.logit(" ".join(words)) > model.logit(" ".join(prose(rng, n))) + 1, (word, n)


def test_learns_and_leaves_clean_texts(model, labelled):
    right = [(model.score(t) >= 0.5) == bool(y) for _, t, y in labelled]
    assert np.mean(right) > 0.98
    assert model.score("") < 0.5 and model.score(" .,- ") == model.score("")


def test_features_are_those_of_a_plain_loop():
    text = "Ab ab, xyz9 \u00e9t\u00e9 " + "long" * 90 + " ab a b c d e ab f g h i ab"
    data = b" " + text.encode().translate(toxicity._TABLE) + b" "
    words, mask = data.split(), (1 << 64) - 1
    buckets, weight, cuts = toxicity.features(text)
    assert len(cuts) == len(words) + 1 and cuts[-1] == len(buckets)
    for i, w in enumerate(words):
        got = sorted(zip(buckets[cuts[i] : cuts[i + 1]].tolist(), weight[cuts[i] : cuts[i + 1]].tolist()))
        if w in words[max(0, i - toxicity.WINDOW + 1) : i]:
            assert got == []
            continue
        padded = b" " + w + b" "
        own = []
        for size in toxicity.SIZES:
            for j in range(len(padded) - size + 1):
                rolled = 0
                for b in padded[j : j + size]:
                    rolled = (rolled * 0x100000001B3 + b) & mask
                own.append((rolled + size) * 0x9E3779B97F4A7C15 & mask)
        whole = sum(b * int(toxicity._POWERS[min(j + 1, 255)]) for j, b in enumerate(w)) & mask
        own.append(whole * 0x9E3779B97F4A7C15 & mask)
        assert [x for x, _ in got] == sorted(x >> int(toxicity._SHIFT) for x in own)
        assert np.allclose([x for _, x in got], 1 / (toxicity.WINDOW * len(own)))


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 40])
def test_every_run_of_words_is_a_window(n):
    rng = np.random.default_rng(n)
    sizes = rng.integers(0, 4, n)
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    values = rng.normal(size=cuts[-1])
    words = [values[a:b].sum() for a, b in zip(cuts[:-1], cuts[1:])]
    want = [sum(words[i : i + toxicity.WINDOW]) for i in range(max(1, n - toxicity.WINDOW + 1))]
    assert np.allclose(toxicity.window_sums(values, cuts), want)


def test_words_in_front_keep_the_verdict(model, labelled):
    """A toxic phrase lies whole in some window, wherever it stands: a score never falls, and clean words do not raise it."""
    changed = 0
    for _, text, _ in labelled[:200]:
        for n in range(1, 6):
            moved = model.logit("the " * n + text)
            assert len(text.split()) < toxicity.WINDOW or moved >= model.logit(text) - 1e-6
            changed += (moved >= 0) != (model.logit(text) >= 0)
    assert changed <= 5


def test_spark_scores(spark, labelled, sample, empty, rows):
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in labelled] + [(None, 1), (3, None), (4, 9)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(k, y) for k, _, y in labelled if zlib.crc32(str(k).encode()) % 5 == 0]
    marked = {r["doc_id"] for r in docs.where(toxicity.held_out(docs["doc_id"])).collect()}
    assert marked == {k for k, _ in held}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, y in held]) > 0.95
    # held-out labels are not learned from: turning them round changes nothing
    turned = spark.createDataFrame([(k, 1 - y if k in marked else y) for k, _, y in labelled], "doc_id long, toxic int")
    assert np.array_equal(toxicity.fit_on(docs, turned).weights, model.weights)
    odd = toxicity.score(sample, model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(empty, model).collect() == []


@pytest.fixture
def learned(monkeypatch):
    """The ``(text, label)`` that the last fit was given."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, **_: seen.append(list(zip(texts, labels))))
    return seen


def test_a_repeated_key_is_one_row_of_the_sample(spark, learned):
    free = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5]
    docs = [(k, f"text {k}") for k in free] + [(free[0], f"again {i}") for i in range(2000)]
    labels = spark.createDataFrame([(k, int(k == free[0])) for k in free], "doc_id long, toxic int")
    toxicity.fit_on(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), labels, rows={0: 20, 1: 10})
    assert len(learned[-1]) == 21 and len(set(learned[-1])) == 21
    assert [t for t, y in learned[-1] if y] == ["again 0"]


def test_long_and_missing_texts_take_no_place_in_the_sample(spark, learned):
    free = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    docs = [(k, "short" if k % 4 == 0 else "long " * 50) for k in free if k % 4 < 3]
    labels = spark.createDataFrame([(k, int(k < 100)) for k in free], "doc_id long, toxic int")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    toxicity.fit_on(docs, labels, rows={0: 10, 1: 12}, max_bytes=100)
    assert sorted(learned[-1]) == [("short", 0)] * 10 + [("short", 1)] * 12


def test_one_class_only(spark, sample):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score(sample, toxicity.fit_on(sample, labels)).where("score > 0.01").count() == 0
