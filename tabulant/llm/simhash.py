"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes.  Two that differ in at most four bits agree in at least four of their
byte positions, so they meet in a posting list of four positions and their bytes: 70 lists per
fingerprint hold every pair with the guaranteed minimum of matches, and no other.  Where a pair
meets, its shared positional bytes are tallied; it is kept in the list of its four lowest shared
positions and verified by its differing bits.

Equal fingerprints are one entry, so copies cost nothing.  A list of more than ``LIST`` entries is not
paired: each of its fingerprints is hot.  Hot ones are linked through their neighbours within two
bits: two fingerprints differ in at most four bits exactly if they share such a neighbour.  A
fingerprint thus costs at most 2,081 rows there, or ``70 * LIST`` comparisons, never a pair per
pair of a group.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.components import components
from tabulant.llm.joins import join_totals
from tabulant.sources.scratch import materialize

BITS, BYTES, DISTANCE = 64, 8, 4
SHINGLE = 4
HASH_SEED = 42
LIST = 64
POSITIONS = list(combinations(range(BYTES), BYTES - DISTANCE))
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


MASKS = [signed(sum(0xFF << (8 * p) for p in chosen)) for chosen in POSITIONS]
FLIPS = np.array(
    [0, *(1 << i for i in range(BITS)), *((1 << i) | (1 << j) for i, j in combinations(range(BITS), 2))], np.uint64
)


def shingles(text: str, size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words of the text with A-Z lower-cased, repeats included; words end at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    return [joined[a:b] for a, b in zip(starts[:-size].tolist(), (starts[size:] - 1).tolist())]


def majority(parts: list[bytes]) -> int:
    """The 64 bits set in over half of the parts' XXH64; 0 without parts."""
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, HASH_SEED) for p in parts), "<u8", len(parts))
    cells = hashes.view(np.uint8).reshape(-1, BYTES) + 256 * np.arange(BYTES)
    counts = np.bincount(cells.ravel(), minlength=256 * BYTES).reshape(BYTES, 256) @ BYTE_BITS
    return int(np.packbits(2 * counts.ravel() > len(parts), bitorder="little").view("<u8")[0])


def simhash(text: str, size: int = SHINGLE) -> int:
    return majority(shingles(text, size))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``(key, text_hash, fp)`` per row of ``docs``: the fingerprint of shingles of ``size`` words; a null text is empty."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.fromiter((simhash(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            cells = [batch.column(0), batch.column(2), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cells, names=["key", "text_hash", "fp"])

    hashed = rows.select("key", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(run, "key bigint, text_hash bigint, fp bigint")


LINKS = "a bigint, b bigint, fp bigint"
LINK_NAMES = ["a", "b", "fp"]


def _pairs_in_lists(size: int):
    """For ``mapInArrow`` over rows ``(chosen, part, fp)`` sorted by list.

    Emits links ``(a, b)`` and each hot fingerprint as ``(null, null, fp)``.
    """

    def linked(chosen: int, entries: np.ndarray):
        fps = entries.view(np.uint64)
        i, j = np.triu_indices(len(fps), 1)
        differ = fps[i] ^ fps[j]
        shared = differ.view(np.uint8).reshape(-1, BYTES) == 0
        lowest = shared & (shared.cumsum(1) <= BYTES - DISTANCE)  # of the tally, the list that this pair belongs to
        own = np.zeros(BYTES, bool)
        own[list(POSITIONS[chosen])] = True
        keep = (lowest == own).all(1) & (np.bitwise_count(differ) <= DISTANCE)
        return np.stack([entries[i[keep]], entries[j[keep]]], 1)

    def emitted(links, warm):
        if links:
            ab = np.concatenate(links)
            none = pa.nulls(len(ab), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), none], names=LINK_NAMES)
        if warm:
            fps = pa.array(np.unique(np.concatenate(warm)))
            none = pa.nulls(len(fps), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, fps], names=LINK_NAMES)

    def run(batches):
        held, count, held_list, hot = [], 0, None, False

        def closed():
            return [linked(held_list[0], np.concatenate(held))] if count > 1 and not hot else []

        for batch in batches:
            chosen, part, rows = (batch.column(i).to_numpy() for i in range(3))
            if not len(rows):
                continue
            ends = np.flatnonzero((chosen[1:] != chosen[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = np.concatenate([[0], ends, [len(rows)]])
            sizes = np.diff(bounds)
            links, warm = [], []
            # lists of one entry need no work: look at longer ones, and at the first and last of the batch
            for k in sorted({0, len(sizes) - 1, *np.flatnonzero(sizes > 1).tolist()}):
                name, own = (int(chosen[bounds[k]]), int(part[bounds[k]])), rows[bounds[k] : bounds[k + 1]]
                if name != held_list:
                    links += closed()
                    held, count, held_list, hot = [], 0, name, False
                if hot:
                    warm.append(own)
                elif count + len(own) > size:
                    warm += [*held, own]
                    held, hot = [], True
                else:
                    held.append(own)
                count += len(own)
            yield from emitted(links, warm)
        yield from emitted(closed(), [])

    return run


def _neighbours(batches):
    """Fingerprints ``fp`` become ``(near, entry)`` for all values within two bits."""
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for low in range(0, len(fp), 256):
            some = fp[low : low + 256]
            near = (some.view(np.uint64)[:, None] ^ FLIPS[None, :]).ravel().view(np.int64)
            cells = [pa.array(near), pa.array(np.repeat(some, len(FLIPS)))]
            yield pa.RecordBatch.from_arrays(cells, names=["near", "entry"])


def _stars(batches):
    """Rows ``(near, entry)`` sorted by both become links to the first entry there."""
    last = None  # the open group: its neighbour and first entry
    for batch in batches:
        near, entry = (batch.column(i).to_numpy() for i in range(2))
        if not len(near):
            continue
        goes_on = last is not None and near[0] == last[0]
        opens = np.concatenate([[not goes_on], near[1:] != near[:-1]])
        group = np.cumsum(opens) - (0 if goes_on else 1)
        firsts = entry[opens]
        if goes_on:
            firsts = np.concatenate([last[1:], firsts])
        last = np.array([near[-1], firsts[group[-1]]])
        first = firsts[group]
        pairs = np.unique(np.stack([entry, first], 1)[entry != first], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def near_links(entries: DataFrame, list_size: int = LIST) -> DataFrame:
    """Links ``(a, b)`` between distinct ``fp`` whose components are those of all pairs within four bits."""
    masks = F.array(*[F.lit(m) for m in MASKS])
    parts = F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("chosen", "part")
    index = entries.select("fp", parts).select("chosen", "part", "fp")
    lists = index.repartition("chosen", "part").sortWithinPartitions("chosen", "part")
    found, _ = materialize(lists.mapInArrow(_pairs_in_lists(list_size), LINKS), "links")
    links = found.where("b is not null").select("a", "b")
    hot = found.where("b is null").select("fp").distinct()
    near = hot.repartition("fp").mapInArrow(_neighbours, "near bigint, entry bigint")
    near = near.repartition("near").sortWithinPartitions("near", "entry")
    return links.union(near.mapInArrow(_stars, "a bigint, b bigint").distinct())


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, list_size: int = LIST
) -> DataFrame:
    """``(key, text_hash, fp, component, representative)`` per row of ``docs``.

    The component is the least key reachable over pairs of fingerprints that differ in at most four bits.  Texts without
    words have fingerprint 0 and are linked like any other.  Null keys are no component's name, unless a
    component has no other.  The representative is the component's least row by key and hash of the text; repeated rows
    stay and are all marked.  Other columns are not read; no rows give no rows.

    A fingerprint or component that holds many rows is joined by broadcast, the others are not hot.
    """
    prints, _ = materialize(fingerprints(docs, key, text, size), "fingerprints")
    row = F.struct(F.col("key").isNull().alias("unnamed"), "key", "text_hash")
    entries, _ = materialize(prints.groupBy("fp").agg(F.min(row).alias("least"), F.count("*").alias("rows")), "entries")
    roots = components(near_links(entries.select("fp"), list_size))
    rooted = entries.join(roots, F.col("fp") == F.col("node"), "left")
    rooted, _ = materialize(rooted.select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "rooted")
    named, _ = materialize(rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("entries")), "named")
    named = join_totals(rooted.select("fp", "rows", "root"), named, ["root"], "entries")
    named, _ = materialize(named.select("fp", "rows", "first"), "named-entries")
    return join_totals(prints, named, ["fp"], "rows").select(
        F.col("key").alias(key), "text_hash", "fp", F.col("first.key").alias("component"),
        (row == F.col("first")).alias("representative"),
    )


def first_of_repeated(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each that repeats key and text; nothing is shuffled if none does."""
    repeated, _ = materialize(found.groupBy(key, "text_hash").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return docs
    same = F.col(key).eqNullSafe(F.col("key_")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("hash_"))
    repeated = repeated.select(F.col(key).alias("key_"), F.col("text_hash").alias("hash_"))
    twice = docs.join(repeated, same, "left_semi")
    return docs.join(repeated, same, "left_anti").union(twice.dropDuplicates([key, text]))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
