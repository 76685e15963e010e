"""Token counts by a separator scan over flat token files.

A flat token file is a run of token ids of fixed width and nothing else: documents follow each other,
each closed by the end-of-document id, and there is no index.  It is read in blocks of equal size,
so a document may start in one block and end in a later one.
1. Every block is searched on its own: numpy compares the whole block with the id at once.
2. A prefix scan over the blocks of a file, in two levels so that no task sees a whole file, sums
   tokens and separators before each block and carries the place of the last separator.
3. With these a block's own separators become document numbers, starts and lengths.
"""

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.sources.scratch import materialize, new_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1 << 19
SUPER_BLOCK = 1024


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def write_flat(
    docs: DataFrame, ranks: dict, eod: int, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS
) -> tuple[DataFrame, DataFrame]:
    """Tokenise ``docs`` into flat files, one per input partition.

    Returns the blocks ``(file, block, tokens)`` with ids as little-endian integers of two bytes, or four
    if ``eod`` needs them, and the order of the keys ``(file, first, keys)``, which says nothing of lengths.
    A null text has no tokens.  Both are read from one written table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary
    width = "<u2" if eod < 1 << 16 else "<u4"
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names, kinds = ["file", "block", "tokens", "first", "keys"], [pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    schema = pa.schema(zip(names, [*kinds, pa.list_(pa.int64())]))

    def run(batches):
        file, block, held, size, first = TaskContext.get().partitionId(), 0, [], 0, 0
        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        encode = encoding.encode_ordinary
        close = np.array([eod], width)

        def row(block, tokens, first, keys):
            cells = ([file], [block], [tokens], [first], [keys])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for value in batch.column(1):
                held += [np.array(encode(value.as_py()), width), close]
                size += len(held[-2]) + 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    whole = len(flat) // block_tokens * block_tokens
                    for low in range(0, whole, block_tokens):
                        yield row(block, flat[low : low + block_tokens].tobytes(), None, None)
                        block += 1
                    held, size = [flat[whole:]], len(flat) - whole
            if keys:
                yield row(None, None, first, keys)
                first += len(keys)
        if size:
            yield row(block, np.concatenate(held).tobytes(), None, None)

    spelled = "file int, block bigint, tokens binary, first bigint, keys array<bigint>"
    path = new_path(docs.sparkSession, "flat")
    rows.mapInArrow(run, spelled).write.option("compression", "zstd").parquet(path)
    flat = docs.sparkSession.read.schema(spelled).parquet(path)
    whole = flat.where("block is not null").select("file", "block", "tokens")
    return whole, flat.where("block is null").select("file", "first", "keys")


def separators(blocks: DataFrame, eod: int) -> DataFrame:
    """``(file, block, n, ends)``: tokens of each block and the places of the separators in it."""
    width = "<u2" if eod < 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            flat = [np.frombuffer(t.as_buffer(), width) for t in batch.column(2)]
            ends = pa.array([np.flatnonzero(t == eod) for t in flat], pa.list_(pa.int64()))
            sizes = pa.array([len(t) for t in flat], pa.int64())
            cells = [batch.column(0), batch.column(1), sizes, ends]
            yield pa.RecordBatch.from_arrays(cells, names=["file", "block", "n", "ends"])

    return blocks.select("file", "block", "tokens").mapInArrow(run, "file int, block bigint, n bigint, ends array<bigint>")


def prefix_scan(df: DataFrame, value: str, out: str, how, empty: int) -> DataFrame:
    """``how`` (a sum or a maximum) of ``value`` over the blocks before each one, in two levels."""
    df = df.withColumn("super", F.floor(F.col("block") / SUPER_BLOCK))
    upper = df.groupBy("file", "super").agg(how(value).alias("whole"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.withColumn("above", how("whole").over(before.partitionBy("file").orderBy("super"))).drop("whole")
    within = how(value).over(before.partitionBy("file", "super").orderBy("block"))
    df = df.withColumn("within", within).join(upper, ["file", "super"])
    both = F.coalesce("above", F.lit(empty)) + F.coalesce("within", F.lit(empty))
    if how is F.max:
        both = F.greatest(F.coalesce("above", F.lit(empty)), F.coalesce("within", F.lit(empty)))
    return df.withColumn(out, both).drop("super", "above", "within")


def scan(blocks: DataFrame, eod: int) -> DataFrame:
    """``(file, ordinal, start, n_tokens, closed)`` per document; ``start`` counts tokens of the file.

    Separators are not counted.  Tokens behind the last separator of a file are a document that is not
    closed.  A file without tokens has no documents.
    """
    found, _ = materialize(separators(blocks, eod), "separators")
    found = prefix_scan(found.withColumn("k", F.size("ends").cast("long")), "n", "base", F.sum, 0)
    found = prefix_scan(found, "k", "ordinal", F.sum, 0)
    found = found.withColumn("last", F.when(F.col("k") > 0, F.col("base") + F.element_at("ends", -1)))
    found, _ = materialize(prefix_scan(found, "last", "carried", F.max, -1), "scan")

    closed = found.select("file", "ordinal", "base", "carried", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carried") + 1).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1)
    closed = closed.select(
        "file",
        (F.col("ordinal") + F.col("i")).alias("ordinal"),
        start.alias("start"),
        (F.col("base") + F.col("end")).alias("end"),
        F.lit(True).alias("closed"),
    )
    files = found.groupBy("file").agg(
        F.sum("k").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.sum("n").alias("end")
    )
    rest = files.where("start < end").withColumn("closed", F.lit(False))
    return closed.union(rest).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents written to flat files and counted there: ``(key, file, ordinal, start, n_tokens)``.

    One row per row of ``docs``: repeated rows, null keys, null and empty texts (no tokens) included.
    """
    ranks = read_vocabulary(vocabulary)
    blocks, order = write_flat(docs, ranks, len(ranks), key, text, **options)
    named = order.select("file", "first", F.posexplode("keys").alias("i", "key"))
    named = named.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "key")
    counted = scan(blocks, len(ranks)).drop("closed")
    return named.join(counted, ["file", "ordinal"]).select(F.col("key").alias(key), "file", "ordinal", "start", "n_tokens")
