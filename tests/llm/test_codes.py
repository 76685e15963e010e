import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabulant.llm import codes, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, key string, vector int, codes int, error int, rows int"


def plain(rows, parts=4, entries=256, rounds=4):
    """The same by a search over all pairs in Python integers."""
    kept = [(k, v, lab) for k, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    cells = [[int(np.floor(1024 * float(np.float32(x)))) for x in v] for _, v, _ in kept]
    width = len(cells[0]) // parts
    cut = [[c[p * width : (p + 1) * width] for p in range(parts)] for c in cells]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(p, cell):
        return min((sum((a - b) ** 2 for a, b in zip(cell, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(p, c[p])[1]].append(c[p])
            moved.append([
                [sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])
            ])
        books = moved
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    per_label = Counter()
    for (_, _, lab), e in zip(kept, errors):
        per_label[lab] += e
    return Counter(
        (k, "".join(f"{i:02x}" for _, i in f), e, per_label[lab], digest)
        for (k, _, lab), f, e in zip(kept, found, errors)
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def odd_rows(n=120, width=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=width), 2).astype(np.float32)], int(i) % 3) for i in range(n)]
    rows += [(500 + i, [0.25] * width, None if i % 2 else 1) for i in range(40)]  # copies
    rows += [(3, rows[3][1], 0), (3, rows[5][1], 0), (None, rows[9][1], None), (700, None, 1), (701, [None] + [0.0] * (width - 1), 1)]
    return rows + [(702, [float("nan")] + [0.0] * (width - 1), 1), (703, [float("inf")] * width, 1), (704, [0.0] * width, 2)]


@pytest.mark.parametrize("entries", [1, 5, 32, 256])
def test_equals_plain_search(spark, entries):
    rows = odd_rows()
    got = codes.compress(frame(spark, rows), entries=entries).collect()
    assert Counter(map(tuple, got)) == plain(rows, entries=entries)


def test_query_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, queries.op11_vector_codes(spark, SF).collect())) == plain(rows)


@pytest.mark.parametrize("seed", range(6))
def test_dual_tree_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    scale = [1, 30, 400, 1 << 25][seed % 4]
    rows = rng.integers(-scale, scale + 1, (rng.integers(1, 700), 6))
    if seed % 2:
        rows = np.concatenate([rows, np.repeat(rows[:1], 300, 0)])
    entries = rows[rng.integers(0, len(rows), rng.integers(1, 100))]  # with equal entries: ties go to the lower
    chosen, sums, counts = codes.assign(rows, entries, leaf=8)
    squares = ((rows[:, None] - entries[None]) ** 2).sum(2)
    assert (chosen == squares.argmin(1)).all()
    assert (counts == np.bincount(chosen, minlength=len(entries))).all()
    want = np.zeros(entries.shape, np.int64)
    np.add.at(want, chosen, rows)
    assert (sums == want).all()


def test_pruning_saves_work():
    """On separate groups nearly all parts are assigned with their whole nodes."""
    rng = np.random.default_rng(0)
    entries = rng.integers(-1000, 1000, (64, 4))
    rows = np.repeat(entries, 64, 0) + rng.integers(-3, 4, (64 * 64, 4))
    tree, book = codes.build(rows, 32), codes.build(entries, 1)
    sure, uncertain = codes.candidates(tree, book)
    whole = (tree.end - tree.start)[sure[:, 0]].sum()
    assert whole > 0.5 * len(rows) and len(uncertain) < 0.1 * 128 * 64


def test_refuses_ragged_and_huge_vectors(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(frame(spark, [(1, [1.0] * 8, 0), (2, [1.0] * 4, 0)]))
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(frame(spark, [(1, [1.0] * 6, 0)]))
    with pytest.raises(ValueError, match="beyond"):
        codes.compress(frame(spark, [(1, [1e9] * 8, 0)]))


def test_nothing_usable(spark):
    assert codes.compress(frame(spark, [])).collect() == []
    assert codes.compress(frame(spark, [(1, None, 0)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_partitions_do_not_matter(spark):
    rows = odd_rows(60, seed=4)
    results = [
        Counter(map(tuple, codes.compress(frame(spark, rows).repartition(n)).collect())) for n in (1, 7)
    ]
    assert results[0] == results[1]
