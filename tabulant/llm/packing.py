"""Conflict-constrained best-fit packing of documents into bins of fixed length.

A document longer than a bin fills whole bins first; its rest is packed.  Two documents conflict,
and never share a bin, if they have the same source or the same duplicate cluster; nulls conflict
with nothing.  Every bin carries a bitmap of its sources and one of its clusters.  Open bins are
ordered by what is left in them: the search starts at the first bin that is large enough and goes
on to its successors until the tightest compatible one is found; if there is none, a bin opens.
Items come in order of falling length.

Documents are dealt by a hash of their key into rooms of ``room_rows`` rows, each packed by one task
on its own, so hot sources and clusters spread evenly and memory is bounded.  Only keys, lengths,
sources and clusters travel, no texts.
"""

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 16384
ROOM_ROWS = 8192
SEED = 8
PACKED = pa.schema(
    [
        ("key", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("bin", pa.string()),
        ("bin_offset", pa.int64()),
        ("bin_free", pa.int64()),
    ]
)


def best_fit(items, capacity: int):
    """Bins of ``(index, length, source, cluster)`` items, placed in the order given.

    Returns ``(bin, offset)`` per item and what is left in each bin.
    """
    bits: dict = {}
    bitmaps, left, open_bins, placed = [], [], [], []
    for _, length, source, cluster in items:
        own = 0
        for tag in (("s", source), ("c", cluster)):
            if tag[1] is not None:
                own |= 1 << bits.setdefault(tag, len(bits))
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and bitmaps[open_bins[at][1]] & own:
            at += 1
        if at < len(open_bins):
            free, bin_no = open_bins.pop(at)
        else:
            free, bin_no = capacity, len(left)
            bitmaps.append(0)
            left.append(capacity)
        placed.append((bin_no, capacity - free))
        bitmaps[bin_no] |= own
        left[bin_no] = free - length
        if left[bin_no]:
            insort(open_bins, (left[bin_no], bin_no))
    return placed, left


def _pack_room(rows: list, room: str, capacity: int) -> pa.RecordBatch:
    """The pieces of a room's rows ``(key, length, source, cluster)``."""
    pieces, items = [], []
    for i, (key, length, source, cluster) in enumerate(rows):
        full, rest = divmod(length, capacity)
        pieces += [(key, p, p * capacity, capacity, f"{room}-w{i}-{p}", 0, 0) for p in range(full)]
        if rest:
            items.append((i, rest, source, cluster))
    items.sort(key=lambda x: (-x[1], x[0]))
    placed, left = best_fit(items, capacity)
    for (i, rest, _, _), (bin_no, offset) in zip(items, placed):
        full = rows[i][1] // capacity
        pieces.append((rows[i][0], full, full * capacity, rest, f"{room}-{bin_no}", offset, left[bin_no]))
    columns = list(zip(*pieces)) if pieces else [()] * len(PACKED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PACKED)], schema=PACKED)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What ``pack`` needs of documents: the length in byte-level tokens with one separator, equal texts as a cluster.

    A null text has length 1 and no cluster; an empty one is a text like any other.
    """
    length = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        length.alias("length"),
        F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("cluster"),  # the hash of null is a number
    )


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    length: str = "length",
    source: str = "source",
    cluster: str = "cluster",
    capacity: int = CAPACITY,
    room_rows: int = ROOM_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """One row per piece: ``key, piece, start, length, bin, bin_offset, bin_free``.

    ``length`` must be positive or null; a null length is 0 and its document gets no piece.  Null and
    repeated keys are packed like any other row.  Rows of equal hash are ordered by length, source
    and cluster, so the result does not depend on partitions.  Other columns are not read.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("key"),
        F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"),
        F.col(source).cast("string").alias("source"),
        F.col(cluster).cast("long").alias("cluster"),
    )
    n = rows.count()
    rooms = max(1, math.ceil(n / room_rows))
    dealt = (
        rows.withColumn("deal", F.xxhash64(F.lit(seed), "key", "cluster"))
        .withColumn("room", F.pmod("deal", F.lit(rooms)).cast("int"))
        .repartitionById(rooms, "room")
        .sortWithinPartitions("deal", "key", "length", "source", "cluster")
        .select("room", "key", "length", "source", "cluster")
    )

    def run(batches):
        # a room holds about room_rows rows; one that repeated rows make larger is cut
        rows, part, room = [], 0, 0
        for batch in batches:
            for room, *row in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append(row)
                if len(rows) >= 2 * room_rows:
                    yield _pack_room(rows, f"{room}.{part}", capacity)
                    rows, part = [], part + 1
        if rows:
            yield _pack_room(rows, f"{room}.{part}", capacity)

    spelled = "key bigint, piece int, start bigint, length bigint, bin string, bin_offset bigint, bin_free bigint"
    return dealt.mapInArrow(run, spelled).withColumnRenamed("key", key)
