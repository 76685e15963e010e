import hashlib
import random
import re
from collections import Counter

import pytest

from tabulant.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = Counter()
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (window := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[window]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[key, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


def check(docs, items, rows, item_rows, **options):
    found = decontaminate.benchmark_matches(docs, items, **options)
    got = decontaminate.contamination(*found).collect()
    assert Counter(tuple(r[:6]) for r in got) == brute(rows, item_rows)
    return got


@pytest.mark.parametrize("block_words", [1_000_000, 300])
def test_driver_tables(spark, sample, rows, block_words):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    check(sample, items, [r[:2] for r in rows], [tuple(r) for r in items.select("item_id", "text").collect()], block_words=block_words)


def test_planted_passages(spark):
    rng = random.Random(3)
    letters = [chr(97 + i) for i in range(9)]

    def prose(n):
        return " ".join(rng.choice(letters) for _ in range(n))

    items = [(i, prose(rng.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(14)]
    items += [(20, items[6][1]), (20, items[7][1]), (21, None), (22, "..."), (23, "É a B"), (24, "zz " * 20)]
    docs = [(i, prose(rng.randrange(60))) for i in range(40)]
    docs += [(100 + i, f"{prose(9)} {t.upper() if t else t}, {prose(200)}") for i, t in items]
    docs += [(500, "é a b"), (501, "É, A; b"), (502, "zz " * 25), (502, "zz " * 25), (503, None), (None, "É a b"), (None, "É a b"), (None, "")]
    check(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        docs,
        items,
    )


def test_proximity(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    swapped = passage.replace("four five", "five four")
    docs = spark.createDataFrame([(1, swapped), (2, passage), (3, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    found = decontaminate.benchmark_matches(docs, items)
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontaminate.contamination(*found).collect()}
    assert got == {1: (0, 1), 2: (13, 0), 3: (0, 0)}


def test_rarest_terms_are_the_anchors(spark):
    sequences = spark.createDataFrame([("q", "a b c a".split())], "seq string, words array<string>")
    frequency = spark.createDataFrame([("a", 9), ("b", 2), ("c", 5)], "term string, frequency long")
    got = decontaminate.item_windows(sequences, frequency, window=3).orderBy("first").collect()
    assert [[tuple(a) for a in r["anchors"]] for r in got] == [[(1, "b"), (2, "c")], [(1, "b"), (2, "c")]]


def test_empty_tables(spark, empty, sample, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(*decontaminate.benchmark_matches(empty, none)).collect() == []
    check(sample, none, [r[:2] for r in rows], [])


def brute_near(docs, items):
    """How many item texts are near, but have no phrase, per text: any 13 words against every window."""
    texts = {tuple(words(t)) for _, t in items} - {()}
    out = Counter()
    for key, text in docs:
        w, n = words(text), 0
        spans = [set(w[i : i + 13]) for i in range(max(len(w) - 12, 1))]
        for t in texts:
            size = min(13, len(t))
            windows = [t[i : i + size] for i in range(len(t) - size + 1)]
            if any(tuple(w[i : i + size]) in set(windows) for i in range(len(w) - size + 1)):
                continue
            n += any(10 * len(set(v) & s) >= 7 * len(set(v)) for v in windows for s in spans)
        out[key, n] += 1
    return out


def near_counts(docs, items, **options):
    found = decontaminate.benchmark_matches(docs, items, **options)
    return Counter((r["doc_id"], r["n_near"]) for r in decontaminate.contamination(*found).collect())


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_proximity_equals_brute_force(spark, block_words):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 9, 13, 14, 25])))) for i in range(12)]
    docs = []
    for i in range(120):
        w = items[rng.randrange(12)][1].split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice([*vocabulary, "elsewhere", f"only{i}"])
        if i % 3 == 0:
            rng.shuffle(w)
        front = [rng.choice(vocabulary) for _ in range(rng.randrange(9))]
        docs.append((i if i % 7 else None, " ".join(front + w + front)))
    docs += [(900, items[4][1]), (900, items[4][1]), (901, None), (902, "")]
    got = near_counts(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        block_words=block_words,
    )
    want = brute_near(docs, items)
    assert got == want and sum(n > 0 for _, n in want.elements()) > 30


def test_replaced_words_are_near_whatever_other_documents_hold(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    items = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    docs = []
    for i in range(13):
        docs.append((i, " ".join(passage[:i] + ["else"] + passage[i + 1 :])))
    docs.append((20, " ".join(["else", "where", "gone", *passage[3:]])))
    docs.append((21, " ".join(["else", "where", "gone", "away", *passage[4:]])))
    want = Counter([*((i, 1) for i in range(13)), (20, 1), (21, 0)])
    schema = "doc_id long, text string"
    assert near_counts(spark.createDataFrame(docs, schema), items) == want
    one = [docs[5]]
    assert near_counts(spark.createDataFrame(one, schema), items) == Counter([(5, 1)])
    assert near_counts(spark.createDataFrame([*one, (30, passage[5])], schema), items) == Counter([(5, 1), (30, 0)])
