"""Data-parallel training: local mini-batch steps per shard, then an average.

Rows are dealt to shards by a hash of their key.  In every round each shard takes its rows, in a fresh random order
per epoch, through mini-batch steps that start from the broadcast state, and returns one state; the states are averaged
by row count.  With one shard this is the ordinary sequential loop.  With several it is local SGD
with parameter averaging, an approximation: batches, donors and batch statistics are
still those of single mini-batches.

A round is planned so that a shard has about ``local_steps * batch_size`` rows.  A table that is larger than ``SHARDS`` such
shards is dealt to more of them, up to ``MOST_SHARDS``, before it takes more rounds: the number follows from the rows
alone, so a cluster of any size gets the same state, and the cores of a larger one are all used.  A task holds a shard, however
large the table is, and orders its rows itself: by the row's lot, which is drawn once, and then by a permutation that
``(seed, epoch, round, shard)`` draws.  So an epoch neither sorts nor hashes rows, and the order does not depend on how they arrive.
A dealt shard is kept in records of ``PACK`` rows, so that Spark reads a few large values again in every epoch.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.functions.draws import draw
from tabulant.plans.network import adam, named_views, rows_of
from tabulant.sources.scratch import discard, materialize

SHARDS = 4  # fewest parallel shards unless the caller says otherwise
MOST_SHARDS = 48  # most parallel shards unless the caller says otherwise
LOCAL_STEPS = 256  # most mini-batches between two averages
PIECE = 1 << 14  # numbers of a state that are averaged together
PACK = 1024  # rows of a dealt shard that make one record

PACKED = "shard int, rows int, lots binary, features binary, labels binary"
RESULT = "shard int, rows bigint, loss double, steps bigint, piece int, state binary"


def plan_rounds(n: int, batch_size: int, shards: int, local_steps: int) -> int:
    """Averages per epoch, so that no shard takes more than ``local_steps`` steps between two."""
    return max(1, math.ceil(n / (shards * batch_size * local_steps)))


def plan_shards(n: int, batch_size: int, local_steps: int) -> int:
    """Shards of a table for which the caller names no number: as many as one round needs, within bounds."""
    return min(MOST_SHARDS, max(SHARDS, math.ceil(n / (batch_size * local_steps))))


def partners(counts: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """Where single rows go: a ``(slice, shard)`` of one row joins the next shard of its slice that has rows."""
    counts, moved = dict(counts), {}
    for turn, shard in sorted(counts):
        if counts[turn, shard] != 1:
            continue
        for i in range(1, shards):
            other = (turn, (shard + i) % shards)
            if counts.get(other):
                moved[turn, shard] = other[1]
                counts[other] += 1
                counts[turn, shard] = 0
                break
    return moved


def mini_batches(n: int, size: int):
    """Bounds of batches of ``size``; a single left-over row joins the batch before it.

    Batch statistics need two rows, so a lone row makes no batch; ``train`` leaves no shard with one row.
    """
    at = 0
    while n - at >= size + 2:
        yield at, at + size
        at += size
    if n - at > 1:
        yield at, n


def shuffled(lots: np.ndarray, cells: np.ndarray, rng) -> np.ndarray:
    """A permutation of the rows that does not depend on the order in which they came.

    Rows of one lot are told apart by their cells.
    """
    order = np.argsort(lots, kind="stable")
    ranked = lots[order]
    tied = np.flatnonzero(ranked[1:] == ranked[:-1])
    if len(tied):
        same = np.unique(np.concatenate([tied, tied + 1]))
        own = order[same]
        order[same] = own[np.lexsort((*cells[own].T[::-1], lots[own]))]
    return order[rng.permutation(len(order))]


def pack(state: dict) -> np.ndarray:
    return np.concatenate([state[part] for part in ("theta", "stats", "m", "v")])


def unpack(flat: np.ndarray, net, t: int) -> dict:
    size = sum(int(np.prod(s)) for s in net.shapes.values())
    extra = sum(int(np.prod(s)) for s in net.buffers.values())
    cuts = np.cumsum([size, extra, size])
    theta, stats, m, v = np.split(flat.astype(np.float32), cuts)
    return {"theta": theta.copy(), "stats": stats.copy(), "m": m.copy(), "v": v.copy(), "t": t}


def spelled(batches):
    """Rows with their features as the bytes of float32 numbers, which cross to Python and back without a look at each."""
    for batch in batches:
        if batch.num_rows:
            at = batch.schema.get_field_index("features")
            x = np.ascontiguousarray(rows_of(batch.column(at), np.float32))
            offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1]))
            cells = pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x)])
            yield batch.set_column(at, "features", cells)


def unspelled(column: pa.ChunkedArray) -> np.ndarray:
    """The matrix of a column of ``spelled`` features."""
    lengths = pc.min_max(pc.binary_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError("arrays must all have one length and hold no nulls")
    width, x, at = lengths["max"] // 4, np.empty((len(column), lengths["max"] // 4), np.float32), 0
    for chunk in column.chunks:
        first, last = (np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset + i] for i in (0, len(chunk)))
        x[at : at + len(chunk)] = np.frombuffer(chunk.buffers()[2], np.uint8)[first:last].view(np.float32).reshape(-1, width)
        at += len(chunk)
    return x


def packed(batches):
    """Rows of a shard as few records, so that an epoch that reads them again handles no single rows."""
    for batch in batches:
        for low in range(0, batch.num_rows, PACK):
            some = batch.slice(low, PACK)
            x = unspelled(pa.chunked_array([some.column("features")]))
            y = some.column("label").cast(pa.int64()).to_numpy().tobytes() if "label" in some.schema.names else None
            cells = [some.column("shard")[:1], pa.array([len(x)], pa.int32()), pa.array([some.column("lot").to_numpy().tobytes()], pa.binary())]
            cells += [pa.array([x.tobytes()], pa.binary()), pa.array([y], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["shard", "rows", "lots", "features", "labels"])


def unpacked(table: pa.Table, name: str, dtype) -> np.ndarray | None:
    """A column of ``packed`` records with one row per row of the shard; None if they hold none."""
    column, rows = table[name], table["rows"].to_numpy()
    if column.null_count:
        return None
    item, lengths = np.dtype(dtype).itemsize, pc.binary_length(column).to_numpy()
    width = lengths[0] // (item * rows[0])
    if (lengths != item * width * rows).any():
        raise ValueError("arrays must all have one length and hold no nulls")
    out, at = np.empty((rows.sum(), width), dtype), 0
    for n, cell in zip(rows, column):
        out[at : at + n] = np.frombuffer(cell.as_buffer(), dtype).reshape(n, width)
        at += n
    return out


def train_shard(objective, shared, batch_size: int, salt):
    """The task: packed records of one shard in, one row per piece of the new state out."""

    def run(batches):
        state = {k: (v.copy() if k != "t" else v) for k, v in shared.value.items()}
        net = objective.net
        params, stats = named_views(state["theta"], net.shapes), named_views(state["stats"], net.buffers)
        gradient, state["scratch"] = np.empty_like(state["theta"]), np.empty_like(state["theta"])
        grads = named_views(gradient, net.shapes)
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        shard, lots = table["shard"][0].as_py(), unpacked(table, "lots", np.int64)[:, 0]
        x, y = unpacked(table, "features", np.float32), unpacked(table, "labels", np.int64)
        y = None if y is None else y[:, 0]
        del table
        # labels tell rows of one lot apart, if there are any
        cells = x if y is None or len(np.unique(lots)) == len(lots) else np.column_stack([x, y])
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([*salt, shard])))
        order = shuffled(lots, cells, rng)
        rows, steps, loss = 0, 0, 0.0
        for a, b in mini_batches(len(order), batch_size):
            some = order[a:b]
            batch_loss = objective.step(params, stats, grads, x[some], None if y is None else y[some], rng)
            adam(state, gradient, objective.rate)
            rows, steps, loss = rows + len(some), steps + 1, loss + batch_loss * len(some)
        if rows:
            flat = pack(state)
            for piece, low in enumerate(range(0, len(flat), PIECE)):
                out = [[shard], [rows], [loss], [steps], [piece], [flat[low : low + PIECE].tobytes()]]
                types = [pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.binary()]
                arrays = [pa.array(v, t) for v, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "rows", "loss", "steps", "piece", "state"])

    return run


def average(rows) -> tuple[np.ndarray, int, float, int]:
    """Row-weighted mean of states, rows, summed loss, most steps."""
    total, n, loss, steps = 0.0, 0, 0.0, 0
    for r in rows:
        total = total + np.frombuffer(r["state"], np.float32).astype(np.float64) * r["rows"]
        n, loss, steps = n + r["rows"], loss + r["loss"], max(steps, r["steps"])
    return (total / n).astype(np.float32), n, loss, steps


def average_piece(table: pa.Table) -> pa.Table:
    """The mean of one piece over all shards, in the order of the shards."""
    table = table.sort_by("shard")
    state, n, loss, steps = average(table.to_pylist())
    return pa.table(
        {
            "shard": table["shard"][:1],
            "rows": pa.array([n], pa.int64()),
            "loss": pa.array([loss], pa.float64()),
            "steps": pa.array([steps], pa.int64()),
            "piece": table["piece"][:1],
            "state": pa.array([state.tobytes()], pa.binary()),
        }
    )


def deal(rows: DataFrame, shards: int) -> DataFrame:
    """One partition per shard, with ``spelled`` features."""
    rows = rows.select(*[c for c in ("shard", "lot", "features", "label") if c in rows.columns])
    fields = [f"{f.name} {'binary' if f.name == 'features' else f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(spelled, ", ".join(fields)).repartitionById(shards, F.col("shard"))


def run_round(dealt: DataFrame, objective, state, shards: int, batch_size: int, seed, epoch, turn):
    """One pass over all shards; returns the averaged state, rows and loss."""
    spark = dealt.sparkSession
    shared = spark.sparkContext.broadcast(state)
    states = dealt.mapInArrow(train_shard(objective, shared, batch_size, (seed, epoch, turn)), RESULT)
    # a task averages one piece of the state over all shards; the driver gets one whole state
    found = states.groupBy("piece").applyInArrow(average_piece, RESULT).collect()
    shared.destroy()
    if not found:
        raise ValueError("training needs at least two rows")
    found = sorted((r.asDict() for r in found), key=lambda r: r["piece"])
    flat = np.concatenate([np.frombuffer(r["state"], np.float32) for r in found])
    first = found[0]
    return unpack(flat, objective.net, state["t"] + first["steps"]), first["rows"], first["loss"]


def train(
    df: DataFrame,
    objective,
    *,
    n: int,
    epochs: int,
    batch_size: int,
    seed: int,
    shards: int | None = None,
    local_steps: int = LOCAL_STEPS,
    after_epoch=None,
    stored: bool = False,
):
    """Fit ``objective`` on ``key``, ``features`` and, if present, ``label``.

    Returns the final state and the loss per epoch.  The algorithm is the same at every size: ``shards``
    shards (None: ``plan_shards``), averaged after at most ``local_steps`` batches each.  Every row is trained on: a row
    that would be alone in its shard joins another.  Input that is read more than once
    is first written to the shared scratch folder, partitioned by round; input that
    is ``stored`` already is written again only if there are several rounds.  Rows are dealt to their shards once and
    kept there for later epochs.
    """
    spark = df.sparkSession
    shards = plan_shards(n, batch_size, local_steps) if shards is None else shards
    rounds = plan_rounds(n, batch_size, shards, local_steps)
    lot = draw(seed, "shard", F.col("key"))
    shard, turn = (lot % shards).cast("int"), (F.floor(lot / shards) % rounds).cast("int")
    if shards > 1:
        sizes = df.select(turn.alias("slice"), shard.alias("shard")).groupBy("slice", "shard").count()
        # slices are large unless there is one, so next to none has a lone row; only those reach the driver
        lone = sizes.where("count = 1").select("slice").distinct()
        for (part, alone), other in partners({(r[0], r[1]): r[2] for r in sizes.join(lone, "slice").collect()}, shards).items():
            shard = F.when((turn == part) & (shard == alone), other).otherwise(shard)
    rows = df.select(
        F.xxhash64(F.lit(seed), "key").alias("lot"),
        F.col("features").cast("array<float>").alias("features"),
        *[c for c in df.columns if c == "label"],
        shard.alias("shard"),
        turn.alias("slice"),
    )
    path, kept = None, {}
    try:
        if rounds > 1 or (epochs > 1 and not stored):
            if rounds > 1:
                rows = rows.repartition("slice", F.col("shard") % 8)
            rows, path = materialize(rows, "training", ["slice"] if rounds > 1 else [])
        state = objective.net.initial(np.random.default_rng(seed))
        history = []
        for epoch in range(epochs):
            seen, loss = 0, 0.0
            for turn in range(rounds):
                if turn in kept:
                    dealt = kept[turn]
                else:
                    dealt = deal(rows.where(F.col("slice") == turn) if rounds > 1 else rows, shards).mapInArrow(packed, PACKED)
                    if epochs > 1:
                        # dealt once; lost blocks come back from the stored table
                        kept[turn] = dealt.persist()
                state, took, cost = run_round(
                    dealt, objective, state, shards, batch_size, seed, epoch, turn
                )
                seen, loss = seen + took, loss + cost
            history.append({"epoch": epoch, "rows": seen, "loss": loss / seen})
            if after_epoch is not None:
                history[-1].update(after_epoch(state, epoch))
    finally:
        for dealt in kept.values():
            dealt.unpersist()
        discard(spark, path)
    return state, history
