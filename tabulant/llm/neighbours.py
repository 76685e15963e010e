"""Approximate nearest neighbours by NN-descent (Dong, Moses and Li, Efficient K-Nearest Neighbor Graph
Construction, 2011) and greedy search of the graph.

Equal vectors are one node.  Every node keeps the ``DEGREE`` nearest nodes found so far.  In a round each node
sends its vector to its neighbours, and a node that receives several introduces them to each other: those are
neighbours of neighbours.  Whoever is nearer to one of them than its present last neighbour is sent on, and a second
join merges such finds into the lists.  Only pairs with a new edge are compared, and rounds end when few edges are
new.  The first lists come from random groups.

A query starts with its own node's neighbours as its beam.  In a round the nearest ones that are not yet expanded are,
their neighbours are compared with the query, and the beam keeps the nearest; the search ends when
the whole beam is expanded.

What travels is a vector as one signed byte per component and a scale.  The beam is ranked again by the original
vectors in double precision.  A node that is everybody's neighbour receives from each task only the ``RECEIVED``
nearest senders, which bounds every group; that and the size of the beam are parameters of the approximation,
whose recall is measured.
"""

import gc
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulant.llm.codes import usable
from tabulant.llm.joins import join_totals
from tabulant.sources.scratch import discard, materialize

NEIGHBOURS = 20
EVERY = 20  # rows whose key this divides are queries
DEGREE = 40
RECEIVED = 80
GROUPS, GROUP_ROWS = 6, 64  # random groups per node at the start, nodes in each
INTRODUCED = 8  # finds per node and meeting
SETTLED = 0.01  # share of new edges at which the rounds end
ROUNDS = 12
BEAM, EXPANDED = 128, 32
NOTHING = np.float32(-3e38)

STATE = "node bigint, code binary, scale float, near array<bigint>, sims array<float>, fresh array<boolean>"
MESSAGE = "hub bigint, node bigint, sim float, least float, fresh boolean, code binary, scale float"
FIND = "node bigint, near bigint, sim float"


def whole_groups(batches, column: int = 0):
    """The sorted stream cut anew, so that rows with equal ``column`` stay together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        names = table.column(column).to_numpy()
        end = int(np.searchsorted(names, names[-1]))
        if end:
            yield table.slice(0, end).combine_chunks().to_batches()[0]
        held = table.slice(end)
    if held is not None:
        yield held.combine_chunks().to_batches()[0]


def _codes(column, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(rows, -1).astype(np.float32)


def _cut(values: pa.Array | np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def _best(owner: np.ndarray, near: np.ndarray, sim: np.ndarray, flag: np.ndarray, most: int):
    """The ``most`` largest ``sim`` of each owner, ties to the lower ``near``; of repeated ones that with the lower flag."""
    order = np.lexsort((flag, near, owner))
    owner, near, sim, flag = owner[order], near[order], sim[order], flag[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (near[1:] != near[:-1])
    owner, near, sim, flag = owner[first], near[first], sim[first], flag[first]
    order = np.lexsort((near, -sim, owner))
    owner, near, sim, flag = owner[order], near[order], sim[order], flag[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = rank < most
    return owner[keep], near[keep], sim[keep], flag[keep]


def _encoded(batches):
    """``(node, vector)`` with one signed byte per component and no neighbours yet."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
        scale = np.abs(cells).max(1) / 127
        code = np.rint(cells / scale[:, None]).astype(np.int8)
        none = np.zeros(n, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([c.tobytes() for c in code], pa.binary()),
                pa.array(scale.astype(np.float32)),
                _cut(np.zeros(0, np.int64), none),
                _cut(np.zeros(0, np.float32), none),
                _cut(pa.array([], pa.bool_()), none),
            ],
            names=["node", "code", "scale", "near", "sims", "fresh"],
        )


def _sent(degree: int):
    """Every node's vector to each of its neighbours, with what a find must exceed."""

    def run(batches):
        for batch in batches:
            lengths = batch.column(3).value_lengths().to_numpy()
            sims = batch.column(4).flatten().to_numpy()
            least = np.full(batch.num_rows, NOTHING, np.float32)
            full = lengths >= degree
            least[full] = sims[np.cumsum(lengths)[full] - 1]
            who = np.repeat(np.arange(batch.num_rows), lengths)
            cells = [batch.column(3).flatten(), batch.column(0).take(pa.array(who)), pa.array(sims), pa.array(least[who])]
            cells += [batch.column(5).flatten(), batch.column(1).take(pa.array(who)), batch.column(2).take(pa.array(who))]
            yield pa.RecordBatch.from_arrays(cells, names=["hub", "node", "sim", "least", "fresh", "code", "scale"])

    return run


def _introduced(most: int, direct: bool):
    """Finds of nodes that met at a hub; ``direct`` if the hub is a node and learns of its new senders."""

    def run(batches):
        for batch in whole_groups(batches):
            hub, node, sim, least = (batch.column(i).to_numpy() for i in range(4))
            fresh = batch.column(4).to_numpy(zero_copy_only=False)
            codes = _codes(batch.column(5), len(hub)) * batch.column(6).to_numpy()[:, None]
            cuts = np.flatnonzero(np.diff(hub, prepend=hub[0] - 1)).tolist()
            out = [(hub[fresh], node[fresh], sim[fresh])] if direct else []
            for a, b in zip(cuts, [*cuts[1:], len(hub)]):
                if b - a < 2:
                    continue
                own = codes[a:b]
                near = own @ own.T
                new = fresh[a:b]
                near[~(new[:, None] | new[None, :])] = NOTHING
                np.fill_diagonal(near, NOTHING)
                some = np.argpartition(-near, most, axis=1)[:, :most] if b - a > most else np.tile(np.arange(b - a), (b - a, 1))
                found = np.take_along_axis(near, some, 1)
                i, j = np.nonzero((found > least[a:b, None]) & (found > NOTHING))
                out.append((node[a + i], node[a + some[i, j]], found[i, j]))
            if out:
                v, w, s = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), pa.array(s)], names=["node", "near", "sim"])

    return run


def _merged(degree: int):
    """Rows of a node's list and of finds, by node and the list first, become the new list."""

    def run(batches):
        for batch in whole_groups(batches):
            listed = batch.column(1).is_valid()
            rows = batch.filter(listed)
            node = rows.column(0).to_numpy()
            lengths = rows.column(3).value_lengths().to_numpy()
            finds = batch.filter(pa.compute.invert(listed))
            found = finds.column(0).to_numpy()
            owner = np.concatenate([np.repeat(node, lengths), found])
            near = np.concatenate([rows.column(3).flatten().to_numpy(), finds.column(6).to_numpy()])
            sims = np.concatenate([rows.column(4).flatten().to_numpy(), finds.column(7).to_numpy()])
            new = np.concatenate([np.zeros(len(owner) - len(found), bool), np.ones(len(found), bool)])
            owner, near, sims, new = _best(owner, near, sims, new, degree)
            sizes = np.bincount(np.searchsorted(node, owner), minlength=len(node))
            lists = [_cut(near, sizes), _cut(sims, sizes), _cut(new, sizes)]
            cells = [rows.column(0), rows.column(1), rows.column(2), *lists]
            yield pa.RecordBatch.from_arrays(cells, names=["node", "code", "scale", "near", "sims", "fresh"])

    return run


def _let_go(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffle files of finished rounds."""
    gc.collect()
    spark._jvm.System.gc()


def neighbour_graph(
    nodes: DataFrame, degree: int = DEGREE, received: int = RECEIVED, settled: float = SETTLED, rounds: int = ROUNDS, seed: int = 0
) -> DataFrame:
    """``STATE`` per row of ``nodes`` ``(node, vector)``: its nearest nodes by inner product, nearest first."""
    spark = nodes.sparkSession
    state, path = materialize(nodes.select("node", "vector").mapInArrow(_encoded, STATE), "graph")
    total = state.count()
    groups = math.ceil(total / GROUP_ROWS)
    turns = 1 if groups == 1 else GROUPS
    drawn = [F.pmod(F.xxhash64(F.lit(seed + t), "node"), F.lit(groups)) + t * groups for t in range(turns)]
    nothing = [F.lit(float(NOTHING)).cast("float").alias(c) for c in ("sim", "least")]
    sent = state.select(F.explode(F.array(*drawn)).alias("hub"), "node", *nothing, F.lit(True).alias("fresh"), "code", "scale")
    sent = sent.repartition("hub").sortWithinPartitions("hub")
    most, direct = (degree if turns == 1 else max(INTRODUCED, 2 * degree // turns)), False
    nearest = W.partitionBy("hub").orderBy(F.desc("fresh"), F.desc("sim"), "node")
    for _ in range(rounds):
        finds = sent.mapInArrow(_introduced(most, direct), FIND)
        finds = finds.select("node", *[F.lit(None).cast(t).alias(n) for n, t in [f.split() for f in STATE.split(", ")[1:]]], F.col("near").alias("found"), "sim")
        rows = state.select("*", F.lit(None).cast("bigint").alias("found"), F.lit(None).cast("float").alias("sim")).union(finds)
        rows = rows.repartition("node").sortWithinPartitions("node")
        new, new_path = materialize(rows.mapInArrow(_merged(degree), STATE), "graph")
        discard(spark, path)
        _let_go(spark)
        state, path = new, new_path
        edges, fresh = state.agg(F.sum(F.size("near")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
        if not edges or fresh <= settled * edges:
            break
        # at most ``received`` rows of a hub leave any task
        sent = state.mapInArrow(_sent(degree), MESSAGE).withColumn("rank", F.row_number().over(nearest))
        sent = sent.where(F.col("rank") <= received).drop("rank").sortWithinPartitions("hub")
        most, direct = INTRODUCED, True
    return state


SEARCH = "query bigint, code binary, scale float, near array<bigint>, sims array<float>, done array<boolean>, next array<bigint>"
SEARCH_NAMES = [f.split()[0] for f in SEARCH.split(", ")]


def _searched(beam: int, expanded: int):
    """A query's beam and newly met nodes, the beam first, become the new beam and the nodes to expand next."""

    def run(batches):
        for batch in whole_groups(batches):
            asked = batch.column(3).is_valid()
            rows = batch.filter(asked)
            query = rows.column(0).to_numpy()
            lengths = rows.column(3).value_lengths().to_numpy()
            met = batch.filter(pa.compute.invert(asked))
            owner, near, sims, done = (
                np.repeat(query, lengths),
                rows.column(3).flatten().to_numpy(),
                rows.column(4).flatten().to_numpy(),
                rows.column(5).flatten().to_numpy(zero_copy_only=False),
            )
            if met.num_rows:
                who = met.column(0).to_numpy()
                own = (_codes(rows.column(1), len(query)) * rows.column(2).to_numpy()[:, None])[np.searchsorted(query, who)]
                other = _codes(met.column(1), len(who)) * met.column(2).to_numpy()[:, None]
                owner, near = np.concatenate([owner, who]), np.concatenate([near, met.column(7).to_numpy()])
                sims = np.concatenate([sims, np.einsum("ij,ij->i", own, other)])
                done = np.concatenate([done, np.zeros(len(who), bool)])
            # of a node that is met again, the row that is done counts
            owner, near, sims, todo = _best(owner, near, sims, ~done, beam)
            place = np.searchsorted(query, owner)
            turn = np.cumsum(todo)
            before = np.concatenate([[0], turn])[np.searchsorted(owner, owner)]
            going = todo & (turn - before <= expanded)
            sizes = np.bincount(place, minlength=len(query))
            lists = [_cut(near, sizes), _cut(sims, sizes), _cut(~todo | going, sizes)]
            lists.append(_cut(near[going], np.bincount(place[going], minlength=len(query))))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), *lists], names=SEARCH_NAMES)

    return run


def greedy_search(graph: DataFrame, asked: DataFrame, beam: int = BEAM, expanded: int = EXPANDED) -> DataFrame:
    """``(query, near)`` for the nodes ``asked``: the ids of the nearest nodes met, the query's own left out."""
    spark = graph.sparkSession
    empty = F.lit(None).cast("array<bigint>").alias("next")
    rows = graph.join(asked.select("node"), "node", "left_semi")
    state = rows.select(F.col("node").alias("query"), "code", "scale", "near", "sims", F.transform("near", lambda _: F.lit(False)).alias("done"), empty)
    state = state.select("*", F.lit(None).cast("bigint").alias("met"))
    path = None
    while True:
        dealt = state.repartition("query").sortWithinPartitions("query")
        new, new_path = materialize(dealt.mapInArrow(_searched(beam, expanded), SEARCH), "beams")
        discard(spark, path)
        _let_go(spark)
        path = new_path
        going = new.select("query", F.explode("next").alias("node"))
        if going.isEmpty():
            return new.select("query", "near")
        met = going.join(graph.select("node", "near"), "node").select("query", F.explode("near").alias("node")).distinct()
        met = met.where("node <> query").join(graph.select("node", "code", "scale"), "node")
        nothing = [F.lit(None).cast(t).alias(n) for n, t in [f.split() for f in SEARCH.split(", ")[3:]]]
        met = met.select("query", "code", "scale", *nothing, F.col("node").alias("met"))
        state = new.select("*", F.lit(None).cast("bigint").alias("met")).union(met)


def inner_product(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def nearest(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS,
    degree: int = DEGREE, beam: int = BEAM, **options,
) -> DataFrame:
    """``(query_id, rank, key, score)``: for every row whose key ``every`` divides, the ``k`` nearest rows found.

    Nearest is the largest inner product of the original vectors in double precision, nearest first, ties to the lower
    key; fewer than ``k`` candidates are all returned.  A row is not its own candidate, and neither is any other with
    its key; rows that repeat key and vector count once, and of a key with several vectors the nearest counts.
    Rows with a null key, and vectors that are null, zero, hold null or non-finite components or differ in length from
    the one with the least key, take no part.  Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("key").isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    first = rows.orderBy("key", "vector").first()
    if first is None:
        empty = spark.createDataFrame([], "query_id bigint, rank int, key bigint, score double")
        return empty.withColumnRenamed("key", key)
    rows = rows.where(F.size("vector") == len(first["vector"]))
    is_query = F.col("key") % every == 0
    nodes = rows.groupBy("vector").agg(F.count("*").alias("rows"), F.max(is_query).alias("asked"))
    # numbers are given while the table is written, and are fixed from then on
    nodes, _ = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members, _ = materialize(join_totals(rows, nodes, ["vector"], "rows").select("key", "node").distinct(), "members")
    by_key = F.row_number().over(W.partitionBy("node").orderBy("key"))
    listed = members.withColumn("rank", by_key).where(F.col("rank") <= k + 1)
    listed = listed.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most k + 1

    graph = neighbour_graph(nodes, degree, **options)
    met = greedy_search(graph, nodes.where("asked"), beam)
    pairs = met.select("query", F.explode("near").alias("node")).union(met.select("query", F.col("query").alias("node")))
    pairs = pairs.join(nodes.select("node", "vector"), "node")
    own = nodes.where("asked").select(F.col("node").alias("query"), F.col("vector").alias("own"))
    scored = pairs.join(own, "query").select("query", "node", inner_product(F.col("own"), F.col("vector")).alias("score"))
    scored, _ = materialize(scored, "scored")
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    answers = scored.join(listed, "node").select("query", "score", F.explode("keys").alias("key"))
    # a query's own node may add up to k + 1 of its keys, other nodes one of a key at least
    answers = answers.withColumn("rank", best).where(F.col("rank") <= 2 * (k + 1))
    answers = answers.groupBy("query").agg(F.collect_list(F.struct("score", "key")).alias("best"))
    asking = members.where(is_query).withColumnsRenamed({"key": "query_id", "node": "query"})
    per_node = asking.groupBy("query").agg(F.count("*").alias("asking"))
    answers, _ = materialize(answers.join(per_node, "query"), "answers")
    given = join_totals(asking, answers, ["query"], "asking").select("query_id", F.inline("best"))
    given = given.where("key <> query_id").groupBy("query_id", "key").agg(F.max("score").alias("score"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    given = given.withColumn("rank", order).where(F.col("rank") <= k)
    return given.select("query_id", "rank", F.col("key").alias(key), "score")
