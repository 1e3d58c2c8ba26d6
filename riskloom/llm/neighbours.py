"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

The graph starts from exact lists within random cells of about equal size; who
is left with too few gets the nearest of the pivots. Each round joins every
vector with the neighbours of its neighbours, and keeps what is nearer. A
search starts at the query's own place in the graph and follows the links of
the nearest vectors found so far until none of them is new.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import partitions, settle

DEGREE = 24
ROUNDS = 7
#: Random partitions for the first lists, and vectors in a cell of one.
CELLS, CELL = 3, 1000
#: About so many vectors, chosen by hash, say where cells are cut and are links for who has too few.
PIVOTS = 1000
#: Nearest vectors of a search that are followed.
BEAM = 160
MOST_HOPS = 12
SEED = 8


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, each once.

    Null, zero and non-finite vectors take no part, nor do rows without an id
    or of another length than the row of the smallest id.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter("vec_id is not null and vector is not null and size(vector) > 0").filter(
        F.forall("vector", fine) & F.exists("vector", lambda x: x != 0)
    )
    length = rows.agg(F.min_by(F.size("vector"), "vec_id")).first()[0]
    return rows.filter(F.size("vector") == F.lit(length)).distinct()


def nodes_of(rows: DataFrame, kept: int) -> DataFrame:
    """(vec_id, node, vector): equal vectors are one node, named by the smallest id.

    Of equal vectors the ``kept`` smallest ids stay, more cannot be among the
    nearest: ties go to the smaller id.
    """
    same = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= kept)
    return ranked.withColumn("node", F.min("vec_id").over(Window.partitionBy("vector")))


def packed(rows: DataFrame, columns: list[str], kind: str = "<f4") -> DataFrame:
    """``rows`` with ``vector`` as the bytes of its numbers."""
    schema = ", ".join(f"{c} long" for c in columns) + ", vector binary"

    def pack(batches):
        for batch in batches:
            values = [np.array(v, kind).tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(values, pa.binary())], [*columns, "vector"])

    return rows.select(*columns, "vector").mapInArrow(pack, schema)


def stacked(column, kind: str = "<f4") -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def squares(x: np.ndarray) -> np.ndarray:
    norms = (x * x).sum(axis=1)
    return np.maximum(norms[:, None] + norms[None, :] - 2 * (x @ x.T), 0)


LINKS = "node long, other long, distance double"


def nearest_in_cell(cell: pa.Table, degree: int, kind: str) -> pa.Table:
    nodes, x = cell["node"].to_numpy(), stacked(cell["vector"], kind)
    if len(nodes) < 2:
        return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    apart = squares(x)
    np.fill_diagonal(apart, np.inf)
    k = min(degree, len(nodes) - 1)
    best = np.argpartition(apart, k - 1, axis=1)[:, :k]
    return pa.table({"node": np.repeat(nodes, k), "other": nodes[best].ravel(), "distance": np.take_along_axis(apart, best, 1).ravel()})


def pivots_of(nodes: DataFrame, count: int, seed: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and vectors of about ``PIVOTS`` nodes; all if there are no more."""
    chosen = F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(count, 1))) < PIVOTS
    found = nodes.filter(chosen).select("node", "vector").orderBy("node").toArrow()
    return found["node"].to_numpy(), stacked(found["vector"], kind)


def pivot_links(nodes: DataFrame, pivots: np.ndarray, at: np.ndarray, degree: int, kind: str) -> DataFrame:
    """Links of every node to the ``degree`` nearest pivots."""

    def link(batches):
        for batch in batches:
            own, x = batch.column("node").to_numpy(), stacked(batch.column("vector"), kind)
            for first in range(0, len(own), 256):
                names, part = own[first : first + 256], x[first : first + 256]
                apart = np.maximum((part * part).sum(axis=1)[:, None] + (at * at).sum(axis=1)[None, :] - 2 * (part @ at.T), 0)
                apart[names[:, None] == pivots[None, :]] = np.inf
                best = np.argsort(apart, axis=1)[:, :degree]
                near = np.take_along_axis(apart, best, 1)
                there = np.isfinite(near)
                columns = np.broadcast_to(names[:, None], best.shape)[there], pivots[best][there], near[there]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "other", "distance"])

    return nodes.select("node", "vector").mapInArrow(link, LINKS)


def first_links(nodes: DataFrame, count: int, degree: int, seed: int, kind: str) -> DataFrame:
    """Exact nearest vectors within cells of random hyperplanes, cells of more than ``CELL`` split by hash.

    Each hyperplane halves the pivots, wherever the vectors point. Nodes with
    fewer than ``degree`` links get those to the nearest pivots.
    """
    bits = max(0, int(np.ceil(np.log2(max(1, count / CELL)))))
    pivots, at = pivots_of(nodes, count, seed, kind) if bits else (None, None)
    cuts = []
    for turn in range(CELLS if bits else 0):
        planes = np.random.default_rng(seed + turn).standard_normal((at.shape[1], bits)) if len(pivots) else np.zeros((0, bits))
        cuts.append(np.median(at @ planes, axis=0) if len(pivots) else np.zeros(bits))

    def sides(batches):
        for batch in batches:
            x = stacked(batch.column("vector"), kind)
            for turn in range(CELLS):
                planes = np.random.default_rng(seed + turn).standard_normal((x.shape[1], bits))
                codes = (x @ planes > cuts[turn]) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("vector"), pa.array(codes * CELLS + turn, pa.int64())], ["node", "vector", "code"]
                )

    coded = settle(nodes.mapInArrow(sides, "node long, vector binary, code long"))
    sizes = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * CELL)).alias("parts"))
    cells = coded.join(sizes, "code").withColumn("part", F.pmod(F.xxhash64("node", "code"), F.col("parts")))
    links = cells.groupBy("code", "part").applyInArrow(lambda cell: nearest_in_cell(cell, degree, kind), LINKS)
    if not bits or not len(pivots):
        return links
    links = settle(links)
    served = links.select("node", "other").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= degree)
    poor = nodes.join(served.select("node"), "node", "left_anti")
    return links.unionByName(pivot_links(poor, pivots, at, degree, kind))


def best_links(links: DataFrame, degree: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy("distance", "other")
    once = links.groupBy("node", "other").agg(F.min("distance").alias("distance"))
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= degree).drop("place")


def both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("other").alias("node"), F.col("node").alias("other"), "distance")
    return links.select("node", "other", "distance").unionByName(back)


def local_join(cell: pa.Table, degree: int) -> pa.Table:
    """Pairs of neighbours of one centre that are nearer than what the first of them knows."""
    found = []
    centres = cell["node"].to_numpy()
    order = np.argsort(centres, kind="stable")
    ends = np.flatnonzero(np.diff(centres[order], prepend=-1, append=-1))
    others, worst, x = cell["other"].to_numpy(), cell["worst"].to_numpy(), stacked(cell["vector"], "<f2")
    for a, b in zip(ends, ends[1:], strict=False):
        own = order[a:b]
        apart = squares(x[own])
        nearer = apart < worst[own][:, None]
        np.fill_diagonal(nearer, False)
        i, j = np.nonzero(nearer)
        found.append((others[own[i]], others[own[j]], apart[i, j]))
    if not found:
        return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    frame = pd.DataFrame({"node": np.concatenate([f[0] for f in found]), "other": np.concatenate([f[1] for f in found]), "distance": np.concatenate([f[2] for f in found])})
    frame = frame.drop_duplicates(["node", "other"]).sort_values(["node", "distance"])
    frame = frame[frame.groupby("node").cumcount() < degree]
    return pa.Table.from_pandas(frame, preserve_index=False)


def build_graph(
    nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = SEED, kind: str = "<f4"
) -> DataFrame:
    """(node, other, distance): about the ``degree`` nearest nodes of every node.

    ``nodes`` has (node, vector as bytes of numbers of ``kind``). In each round a centre brings
    together its neighbours and at most as many, chosen by hash, of those that
    count it as theirs. Distances are squared; they are of vectors in half
    precision and choose links only.
    """
    count = nodes.count()
    half = settle(nodes.mapInArrow(halve(kind), "node long, vector binary"))
    links = settle(best_links(first_links(nodes, count, degree, seed, kind), degree))
    groups = max(partitions(nodes.sparkSession), count // 500)
    known = None
    for turn in range(rounds):
        mark = links.agg(F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if mark == known:
            break
        known = mark
        lot = Window.partitionBy("node").orderBy(F.xxhash64("node", "other", F.lit(turn)), "other")
        back = both_ways(links).join(links.select("node", "other"), ["node", "other"], "left_anti")
        chosen = back.withColumn("place", F.row_number().over(lot)).filter(F.col("place") <= degree).drop("place")
        met = links.unionByName(chosen).select("node", "other")
        worst = links.groupBy("node").agg(F.max("distance").alias("worst"), F.count(F.lit(1)).alias("n"))
        limits = worst.select(F.col("node").alias("other"), F.when(F.col("n") < degree, float("inf")).otherwise(F.col("worst")).alias("worst"))
        told = half.select(F.col("node").alias("other"), "vector").join(limits, "other")
        rows = met.join(told, "other").withColumn("cell", F.pmod(F.xxhash64("node"), F.lit(groups)))
        fresh = rows.groupBy("cell").applyInArrow(lambda cell: local_join(cell, degree), LINKS)
        links = settle(best_links(links.unionByName(fresh), degree))
    return links


def halve(kind: str):
    def half(batches):
        for batch in batches:
            values = [np.frombuffer(v, kind).astype("<f2").tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(values, pa.binary())], ["node", "vector"])

    return half


def gap(kind: str):
    """Euclidean distance of two vectors as bytes of numbers of ``kind``, in double precision."""

    def apart(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype=float)
        a = np.frombuffer(b"".join(left), kind).reshape(len(left), -1).astype(np.float64)
        b = np.frombuffer(b"".join(right), kind).reshape(len(right), -1).astype(np.float64)
        return pd.Series(np.sqrt(((a - b) ** 2).sum(axis=1)))

    return F.pandas_udf(apart, "double")


def search(
    nodes: DataFrame, links: DataFrame, queries: DataFrame, beam: int = BEAM, hops: int = MOST_HOPS, kind: str = "<f4"
) -> DataFrame:
    """(query, node, distance): the ``beam`` nearest nodes found for each query.

    ``queries`` has (query, start): the node at which the search starts. In
    each hop the links of all nodes among the ``beam`` nearest that were not
    followed yet are followed, until there are none or after ``hops``.
    """
    graph = settle(both_ways(links).select("node", "other").distinct())
    wanted = settle(queries.join(nodes, queries.start == nodes.node).select("query", "start", F.col("vector").alias("target")))
    pool = wanted.select("query", F.col("start").alias("node"), F.lit(0.0).alias("distance"), F.lit(False).alias("done"))
    order = Window.partitionBy("query").orderBy("distance", "node")
    pool = settle(pool)
    measured = gap(kind)
    for _ in range(hops):
        front = pool.filter("not done").select("query", "node")
        reached = front.join(graph, "node").select("query", F.col("other").alias("node")).distinct()
        fresh = reached.join(pool.select("query", "node"), ["query", "node"], "left_anti")
        near = fresh.join(nodes, "node").join(wanted.select("query", "target"), "query")
        scored = near.select("query", "node", measured("vector", "target").alias("distance"), F.lit(False).alias("done"))
        seen = pool.withColumn("done", F.lit(True)).unionByName(scored)
        pool = settle(seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= beam).drop("place"))
        if pool.filter("not done").isEmpty():
            break
    return pool.select("query", "node", "distance")


def nearest(
    vectors: DataFrame, every: int = 100, wanted: int = 10, key: str = "vec_id", vector: str = "embedding", **how
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of each row whose id ``every`` divides.

    Equal vectors are one node of the graph, and each stands in the result
    with its own id. A query is no neighbour of its own. Too few candidates
    give fewer rows; empty tables none.
    """
    rows = settle(usable(vectors, key, vector))
    kind = "<f4" if rows.schema["vector"].dataType.elementType == T.FloatType() else "<f8"
    members = settle(nodes_of(rows, wanted + 1))
    nodes = settle(packed(members.filter("vec_id = node"), ["node"], kind))
    links = build_graph(nodes, kind=kind, **how)
    asked = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query")
    queries = asked.join(members.filter("vec_id = node").select("node", "vector"), "vector").select("query", F.col("node").alias("start"))
    found = search(nodes, links, queries, kind=kind)
    named = found.join(members.select("node", "vec_id"), "node").filter("vec_id <> query")
    order = Window.partitionBy("query").orderBy("distance", "vec_id")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", F.col("distance").alias("score"))
