import random
import re
from collections import Counter

import pytest
import xxhash

from tabulant.llm import components, simhash


def brute_fingerprint(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [words] if len(words) < size else [words[i : i + size] for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_brute_force(sample, rows):
    prints = [(k, brute_fingerprint(t)) for k, t, _ in rows]
    groups = brute_components(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for k, f in prints:
        if k is not None:
            least[groups[f]] = min(k, least.get(groups[f], k))
    want = Counter((k, f"{f:016x}", least.get(groups[f])) for k, f in prints)
    got = simhash.near_duplicates(sample).select("doc_id", simhash.fingerprint_hex(simhash.F.col("fp")), "component").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("list_size", [1, 2, 5, 64, 10000])
def test_links_at_every_list_size(spark, list_size):
    rng = random.Random(list_size)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
        prints.add(centre ^ 0x1F)  # five bits away
    as_signed = {p: simhash.signed(p) for p in prints}
    entries = spark.createDataFrame([(s,) for s in as_signed.values()], "fp long").repartition(3)
    links = simhash.near_links(entries, list_size)
    for a, b in links.collect():
        assert (a % 2**64 ^ b % 2**64).bit_count() <= 4
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute_components(sorted(as_signed.values()), lambda a, b: (a % 2**64 ^ b % 2**64).bit_count() <= 4)
    assert {n: got.get(n, n) for n in as_signed.values()} == want


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    links += [(5, 5), (1001, 1000)]
    rng = random.Random(2)
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)} | {2000 + i: 2000 for i in range(1, 9)}
    assert got == want
    assert components.components(df.where("a < 0")).collect() == []


def test_repeated_rows_leave_one(sample, rows):
    found = simhash.near_duplicates(sample)
    kept = simhash.first_of_repeated(sample, found).collect()
    assert max(Counter(map(str, kept)).values()) == 1
    assert len(kept) == len({(k, t or "") for k, t, _ in rows})


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
