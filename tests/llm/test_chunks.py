import hashlib
import random

from tabulant.llm import chunks


def brute_hash(data):
    out = []
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - 31) : i + 1]:
            h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    return out


def brute_boundaries(data):
    hashes, ends, start = brute_hash(data), [], 0
    for i, h in enumerate(hashes):
        size = i + 1 - start
        mask = chunks.STRICT if size < chunks.NORMAL_SIZE else chunks.LOOSE
        if size >= chunks.MAX_SIZE or (size >= chunks.MIN_SIZE and h & int(mask) == 0):
            start = i + 1
            ends.append(start)
    return ends + [len(data)] if start < len(data) else ends


def test_boundaries_equal_brute_force():
    rng = random.Random(1)
    for n in [0, 1, 7, 8, 9, 31, 33, 127, 128, 129, 257, 5000]:
        for alphabet in (b"a", b"ab ", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            assert chunks.boundaries(data) == brute_boundaries(data)


def test_shifts_keep_most_chunks():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(6000))
    shifted = b"some words in front" + data[:3000] + b"!" + data[3000:]
    a, b = chunks.chunk_set(data), chunks.chunk_set(shifted)
    assert chunks.containment(a, b) > 0.95
    assert chunks.containment(a, chunks.chunk_set(data[::-1])) < 0.05
    assert chunks.containment({}, {}) == 1.0 and chunks.containment(a, {}) == chunks.containment({}, a) == 0.0


def brute(rows):
    rows = sorted(((k, t or "") for k, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        a, b, c = (chunks.chunk_set(x.encode()) for x in (text, edited, after))
        out.append(
            (key, len(text), len(a), hashlib.sha256(edited.encode()).hexdigest(), chunks.fingerprint(a), chunks.fingerprint(b),
             chunks.containment(a, b), chunks.containment(a, c))
        )
    return sorted(out, key=str)


def test_table_equals_brute_force(sample, rows):
    for bucket_bytes in (20_000, chunks.BUCKET_BYTES):
        got = chunks.fingerprints(sample, bucket_bytes=bucket_bytes).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_few_documents(spark, empty):
    assert chunks.fingerprints(empty).collect() == []
    for rows in ([(5, "abcd" * 30)], [(None, "x" * 50), (None, "y" * 50)], [(1, None), (1, None)], [(2**62, "b" * 99), (2**62 + 1, "c")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, chunks.fingerprints(df).collect()), key=str) == brute(rows)
