import random

import numpy as np
import tiktoken

from tabulant.llm import tokens


def test_counts_equal_direct_encoding(sample, rows):
    ranks = tokens.read_vocabulary()
    encode = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = tokens.token_counts(sample, block_tokens=1000).collect()
    want = sorted((str(k), len(encode(t or ""))) for k, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == want
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append((r["ordinal"], r["start"], r["n_tokens"]))
    for cells in files.values():
        cells.sort()
        assert [c[0] for c in cells] == list(range(len(cells)))
        assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(cells, cells[1:]))


def test_scan_stitches_blocks(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SUPER_BLOCK", 3)
    rng = random.Random(4)
    eod, want, blocks = 7, [], []
    for file, share in enumerate((0.5, 0.02, 0.0, 1.0)):
        flat = [eod if rng.random() < share else rng.randrange(7) for _ in range(200)]
        start, ordinal = 0, 0
        for i, t in enumerate(flat):
            if t == eod:
                want.append((file, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(flat):
            want.append((file, ordinal, start, len(flat) - start, False))
        blocks += [(file, b, np.array(flat[8 * b : 8 * b + 8], "<u2").tobytes()) for b in range(25)]
    rng.shuffle(blocks)
    df = spark.createDataFrame([(f, b, bytearray(t)) for f, b, t in blocks], "file int, block long, tokens binary")
    assert sorted(map(tuple, tokens.scan(df, eod).collect())) == sorted(want)


def test_wide_ids(spark):
    flat = np.array([1, 70000, 65536, 2, 70000], "<u4").tobytes()
    df = spark.createDataFrame([(0, 0, bytearray(flat))], "file int, block long, tokens binary")
    assert [tuple(r) for r in tokens.scan(df, 70000).orderBy("ordinal").collect()] == [(0, 0, 0, 1, True), (0, 1, 2, 2, True)]


def test_empty_table(empty):
    assert tokens.token_counts(empty).collect() == []
