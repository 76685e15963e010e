"""Fill-in-the-middle texts, cut at unit boundaries that a compressed set holds.

The boundaries of a text are the offsets, in code points, at which a unit ends.  The set is split by the high 16 bits
of the offsets into containers: sorted arrays of the low bits while there are few, bitmaps when there are
many, runs when they are mostly consecutive, whichever is smallest.  Cumulative cardinalities over the containers
turn the k-th boundary into a binary search for its container and a select inside it: an index into an array, a search
over the runs' lengths, or a search over the bit counts of the bitmap's words.  Both cuts of a document are found
this way; the set takes at most 8 KiB per 65,536 offsets, however long the text is.

Draws are digests of the seed and the document's key, so they do not depend on partitions or retries.
"""

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
UNIT = r"[^\n]*\n|[^\n]+"  # a line with its end
RATE, SPM_RATE = 100, 50  # of 100
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

LOW_BITS = 16
ARRAY, BITMAP, RUNS = "array", "bitmap", "runs"


@dataclass
class Container:
    """Low bits of the offsets that share their high bits."""

    kind: str
    data: np.ndarray  # values; 1,024 words; or rows of (first value, values before this run)

    @classmethod
    def of(cls, low: np.ndarray) -> "Container":
        """The smallest of the three forms of sorted distinct 16-bit values."""
        opens = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
        sizes = {RUNS: 4 * len(opens), ARRAY: 2 * len(low), BITMAP: 8192}
        kind = min(sizes, key=sizes.get)
        if kind == ARRAY:
            return cls(kind, low.astype(np.uint16))
        if kind == RUNS:
            return cls(kind, np.stack([low[opens], opens], 1).astype(np.uint16))
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[low] = 1
        return cls(kind, np.packbits(bits, bitorder="little").view("<u8"))

    def select(self, rank: int) -> int:
        """The value with ``rank`` smaller ones."""
        if self.kind == ARRAY:
            return int(self.data[rank])
        if self.kind == RUNS:
            run = int(np.searchsorted(self.data[:, 1], rank, side="right")) - 1
            return int(self.data[run, 0]) + rank - int(self.data[run, 1])
        ends = np.bitwise_count(self.data).cumsum(dtype=np.int64)
        word = int(np.searchsorted(ends, rank, side="right"))
        rank -= int(ends[word - 1]) if word else 0
        inside = np.flatnonzero(np.unpackbits(self.data[word : word + 1].view(np.uint8), bitorder="little"))
        return 64 * word + int(inside[rank])


@dataclass
class BoundarySet:
    highs: np.ndarray
    containers: list[Container]
    ends: np.ndarray  # offsets in this container and the ones before

    @classmethod
    def of(cls, offsets: np.ndarray) -> "BoundarySet":
        """``offsets`` ascend and are distinct."""
        high = offsets >> LOW_BITS
        cuts = np.flatnonzero(np.diff(high, prepend=-1))
        parts = np.split(offsets & ((1 << LOW_BITS) - 1), cuts[1:]) if len(offsets) else []
        return cls(high[cuts], [Container.of(p) for p in parts], np.cumsum([len(p) for p in parts], dtype=np.int64))

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def select(self, rank: int) -> int:
        """The offset with ``rank`` smaller ones."""
        at = int(np.searchsorted(self.ends, rank, side="right"))
        before = int(self.ends[at - 1]) if at else 0
        return (int(self.highs[at]) << LOW_BITS) + self.containers[at].select(rank - before)

    def cut(self, units: int) -> int:
        """Where the first ``units`` units end."""
        return self.select(units - 1) if units else 0


def boundaries(text: str, unit: re.Pattern) -> BoundarySet:
    """Ends of the units, matched from left to right; empty matches are none."""
    if unit.pattern == UNIT:  # the ends of lines are found in numpy, a block at a time
        ends, block = [np.zeros(0, np.int64)], 1 << 20
        for low in range(0, len(text), block):
            points = np.frombuffer(text[low : low + block].encode("utf-32-le"), "<u4")
            ends.append(np.flatnonzero(points == ord("\n")) + low + 1)
        if text and text[-1] != "\n":
            ends.append(np.array([len(text)]))
        return BoundarySet.of(np.concatenate(ends).astype(np.int64))
    found = np.fromiter((m.end() for m in unit.finditer(text) if m.end() > m.start()), np.int64)
    return BoundarySet.of(found)


def draws(key, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers that a key draws; a null key is spelled as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: str, key, seed: int = SEED, unit: re.Pattern = re.compile(UNIT), rate: int = RATE, spm_rate: int = SPM_RATE):
    """``(units, form, prefix length, middle length, output)``; lengths are None in the plain form."""
    found = boundaries(text, unit)
    n = len(found)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = found.cut(first), found.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    return n, "psm", a, b - a, "".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])


def restore(output: str, form: str) -> str:
    """The text that ``output`` was made from; its pieces hold no marks, so the first one found is the mark."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, middle = output[len(one) :].split(MIDDLE, 1)
    left, right = head.split(two, 1)
    return left + middle + right if form == "psm" else right + middle + left


SPELLED = "key bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = UNIT, **options) -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, output)`` per row of ``docs``.

    ``n`` counts units.  A text that is empty or holds a mark, and one that draws no transformation, stays as it
    is (``plain``).  A null text is empty.  A null key draws like an empty one, and repeated rows draw
    alike.  Texts are handled one at a time, so a long one costs its own length.  Other columns are not read; an
    empty table gives an empty result.
    """
    pattern = re.compile(unit)

    def run(batches, most: int = 1 << 24):
        rows, held = [], 0

        def batch():
            cells = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(cells, names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                row = (k, *transform(t.as_py(), k, unit=pattern, **options))
                rows.append(row)
                held += len(row[-1])
                if held > most:  # long texts leave at once
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SPELLED).withColumnRenamed("key", key)


def restored(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` with the column ``restored``: the text rebuilt from output and form alone."""
    found = F.when(F.col(form) == "plain", F.col(output))
    body = F.col(output)
    middle_at = F.locate(MIDDLE, body)
    head = F.substr(body, F.lit(1 + len(PREFIX)), middle_at - 1 - len(PREFIX))
    middle = F.substr(body, middle_at + len(MIDDLE))
    for name, mark in (("psm", SUFFIX), ("spm", PREFIX)):
        at = F.locate(mark, head)
        left, right = F.substr(head, F.lit(1), at - 1), F.substr(head, at + len(mark))
        whole = F.concat(left, middle, right) if name == "psm" else F.concat(right, middle, left)
        found = found.when(F.col(form) == name, whole)
    return rows.withColumn("restored", found)


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` of ``fill_in_middle`` with digests of the output and of the restored text instead of the texts."""
    hashed = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return restored(rows).select(*[c for c in rows.columns if c != "output"], *hashed)
