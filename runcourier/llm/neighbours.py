"""Approximate nearest neighbours by a graph that NN-descent builds.

Equal vectors are one node. Each node starts with the best nodes of its leaves in trees of random
planes. In every round a node's neighbours and those that name it are compared with each other
(neighbours of neighbours), and each keeps the best it has seen. A node that very many name is met by
them in groups of bounded size, another grouping in each round, so no task gets all of them. Rounds end
when few edges change. A query starts at its own node's neighbours and at the ``beam`` longest nodes (all of
them in a small table) and walks the graph greedily: it expands those of its best ``beam`` nodes that
aren't expanded yet, and ends when all of them are.

All steps are joins and groupings; vectors travel with the rows of a step, rounded to a byte for each
component by a scale of their own. The rows found are scored by the inner product in double precision
on the vectors as they are. The graph is built on vectors of one length: one more component, zero for a
query and never rounded, makes the largest inner product the smallest distance, so lengths may differ.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
take no part. Rows with the same id and vector count once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runcourier.llm.common import fewer, release, slim, small_batches
from runcourier.session import cut

# Neighbours of a node, nodes that a query keeps, rounds at most, and nodes that meet at once.
DEGREE, BEAM, ROUNDS, MEETING = 32, 64, 6, 96
# Trees of random planes for the first graph, and nodes in a leaf.
TREES, LEAF = 8, 48


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, vector): those that take part."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(
        F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & ~F.exists("vector", bad)
        & F.exists("vector", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("vector") == (most["d"] if most else 0)).distinct()


def _norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


def _top(rows: DataFrame, key: str, other: str, value: str, n: int) -> DataFrame:
    """The best ``n`` rows of each key; a key's rows are few by construction."""
    order = Window.partitionBy(key).orderBy(F.desc(value), other)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def leaves(
    nodes: DataFrame, dims: int, trees: int, size: int, seed: int, middle: float = 0.0
) -> DataFrame:
    """Rows (at, member): for each tree, the nodes on the same side of some random planes, about
    ``size`` of them if they spread evenly. The planes meet where the length component is ``middle``."""
    planes = max(0, int(np.ceil(np.log2(max(2, nodes.count()) / size))))
    axes = np.random.default_rng(seed).normal(size=(trees * planes, dims))
    weights = 1 << np.arange(planes, dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, extra = _codes(batch.column("code").to_pylist())
                rows = np.hstack([rows, (extra - middle)[:, None]])
                sides = (rows @ axes.T > 0).astype(np.int64)
                leaf = sides.reshape(len(rows), trees, planes) @ weights + np.arange(trees) * 2**planes
                member = np.repeat(batch.column("node").to_numpy(), trees)
                yield pa.RecordBatch.from_pydict(
                    {"at": pa.array(leaf.ravel()), "member": pa.array(member)}
                )

    return nodes.select("node", "code").mapInArrow(place, "at long, member long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select("v", "u")).distinct()


def _code(dims: int) -> np.dtype:
    return np.dtype([("extra", "<f8"), ("scale", "<f4"), ("rounded", "i1", (dims,))])


def _codes(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of these codes, and their length components."""
    found = np.frombuffer(b"".join(codes), _code(len(codes[0]) - _code(0).itemsize))
    return found["rounded"] * found["scale"][:, None], found["extra"]


def meet(nodes: DataFrame, named: DataFrame, floors: DataFrame | None, degree: int, size: int, number: int) -> DataFrame:
    """Edges (u, v, s) among the members that share a place ``at``, in groups of bounded size.

    ``floors`` has the similarity s that a node's new neighbour must beat.
    """
    # Both sides of the join with the sizes read the same shuffle if they have the same filters.
    named = named.where(F.col("at").isNotNull() & F.col("member").isNotNull())
    sizes = named.groupBy("at").agg(F.ceil(F.count("*") / size).alias("_groups"))
    named = named.join(sizes, "at").withColumn(
        "group", F.pmod(F.xxhash64("member", F.lit(number)), F.col("_groups"))
    )
    known = nodes.select(F.col("node").alias("member"), "code")
    if floors is not None:
        known = known.join(floors.withColumnRenamed("u", "member"), "member", "left")
    else:
        known = known.withColumn("floor", F.lit(None).cast("double"))
    packed = (
        named.join(known, "member")
        .groupBy("at", "group")
        .agg(F.collect_list(F.struct("member", "code", "floor")).alias("all"))
        .select("all.member", "all.code", "all.floor")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, ss = [], [], []
            for ids, codes, floor in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if len(ids) < 2:
                    continue
                ids = np.array(ids)
                rows, extra = _codes(codes)
                # Half the squared distance, below zero: the inner product but for a constant.
                rows = rows.astype(np.float64)
                norms = (rows * rows).sum(axis=1) / 2
                near = rows @ rows.T - norms[:, None] - norms[None]
                near -= (extra[:, None] - extra[None]) ** 2 / 2
                near = near.astype(np.float32)
                np.fill_diagonal(near, -np.inf)
                n = min(degree, len(ids) - 1)
                best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                value = np.take_along_axis(near, best, axis=1)
                least = np.array([-np.inf if f is None else f for f in floor])
                i, j = np.nonzero(value > least[:, None])
                us.append(ids[i])
                vs.append(ids[best[i, j]])
                ss.append(value[i, j])
            if us:
                yield pa.RecordBatch.from_pydict(
                    {
                        "u": pa.array(np.concatenate(us)),
                        "v": pa.array(np.concatenate(vs)),
                        "s": pa.array(np.concatenate(ss).astype(np.float32)),
                    }
                )

    return packed.mapInArrow(compare, "u long, v long, s float")


def graph(
    nodes: DataFrame, dims: int, degree: int = DEGREE, rounds: int = ROUNDS, middle: float = 0.0
) -> DataFrame:
    """Edges (u, v, s): for each node its best neighbours found."""
    found = meet(nodes, leaves(nodes, dims, TREES, LEAF, 11, middle), None, degree // 2, MEETING, 0)
    edges = slim(_top(found.groupBy("u", "v").agg(F.max("s").alias("s")), "u", "v", "s", degree))
    for number in range(1, rounds + 1):
        release(nodes.sparkSession)
        # Around each node meet its neighbours, those that name it, and itself.
        named = edges.select(F.col("u").alias("at"), F.col("v").alias("member")).union(
            edges.select(F.col("v").alias("at"), F.col("u").alias("member"))
        )
        floors = edges.groupBy("u").agg(
            F.when(F.count("*") >= degree, F.min("s").cast("double")).alias("floor")
        )
        found = meet(nodes, named.distinct(), floors, degree, MEETING, number)
        every = edges.withColumn("old", F.lit(True)).unionByName(found.withColumn("old", F.lit(False)))
        every = every.groupBy("u", "v").agg(F.max("s").alias("s"), F.max("old").alias("old"))
        new = cut(_top(every, "u", "v", "s", degree))
        total, same = new.agg(F.count("*"), F.count_if("old")).first()
        edges, changed = fewer(new.drop("old"), total), 1 - same / max(1, total)
        if changed < 0.02:
            break
    return edges


def walk(
    begin: DataFrame, codes: DataFrame, nodes: DataFrame, edges: DataFrame, beam: int, steps: int = 40
) -> DataFrame:
    """Rows (query, node, s): the best nodes that greedy search finds for each query.

    ``begin``: rows (query, node), the nodes a search starts from; ``codes``: a row (query, code) for each.
    """
    most = beam * codes.count()
    codes = codes.select("query", F.col("code").alias("q"))
    ways = slim(_both(edges))

    @F.pandas_udf("double")
    def dot(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        return pd.Series((_codes(list(a))[0] * _codes(list(b))[0]).sum(axis=1).astype(float))

    def best(pairs: DataFrame) -> DataFrame:
        """Of the rows (query, node, done), each once, the best of each query. The join by query, the
        last one, leaves them where they are ranked."""
        rows = pairs.join(nodes.select("node", "code"), "node").join(codes, "query")
        rows = rows.select("query", "node", dot("q", "code").alias("s"), "done")
        return fewer(cut(_top(rows, "query", "node", "s", beam)), most)

    kept = best(begin.distinct().withColumn("done", F.lit(False)))
    for _ in range(steps):
        release(nodes.sparkSession)
        now = kept.where("not done").select("query", "node")
        if now.isEmpty():
            break
        there = now.join(ways.select(F.col("u").alias("node"), "v"), "node")
        reached = there.select("query", F.col("v").alias("node"), F.lit(False).alias("done"))
        # What was kept is expanded by now. It is rated again, to the same value, instead of being joined.
        every = kept.select("query", "node", F.lit(True).alias("done")).unionByName(reached)
        kept = best(every.groupBy("query", "node").agg(F.max("done").alias("done")))
    return kept.select("query", "node", "s")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    degree: int = DEGREE,
    beam: int = BEAM,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """For each row that ``is_query`` holds for (a column of ``vec_id``), its ``k`` nearest rows found."""
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    rows = slim(usable(vectors, id_col, vector_col))
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = len(first["vector"])
    longest = rows.agg(F.max(_norm(F.col("vector")))).first()[0]
    # Equal vectors are one node, known by the smallest id. One more component makes lengths equal.
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("node"))
    extra = F.sqrt(F.greatest(F.lit(longest) - _norm(F.col("vector")), F.lit(0.0)))
    classes = cut(classes.select("node", "vector", extra.alias("extra")))
    length = float(np.sqrt(longest))  # the unit of all codes
    middle = classes.agg(F.avg("extra")).first()[0] / length

    @F.pandas_udf("binary")
    def rounded(vector: pd.Series, extra: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype=object)
        rows = np.stack(vector.to_numpy())
        scale = np.abs(rows).max(axis=1, keepdims=True) / 127
        out = np.zeros(len(rows), _code(dims))
        out["rounded"] = np.rint(rows / scale)
        out["scale"], out["extra"] = scale[:, 0] / length, extra.to_numpy() / length
        return pd.Series([r.tobytes() for r in out], dtype=object)

    nodes = slim(classes.select("node", "vector", rounded("vector", "extra").alias("code")))
    member = slim(rows.join(classes, "vector").select("vec_id", "node"))
    edges = graph(nodes, dims + 1, degree, middle=middle)
    beam = max(beam, 2 * k)
    far = nodes.orderBy(F.desc(_norm(F.col("vector"))), "node").limit(beam).select("node")

    asked = member.where(is_query)
    wanted = slim(
        asked.select("node").distinct().join(
            nodes.select("node", rounded("vector", F.lit(0.0)).alias("code")), "node"
        )
    )
    codes = wanted.select(F.col("node").alias("query"), "code")
    begin = wanted.select(F.col("node").alias("query"), "node").unionByName(
        wanted.join(edges.select(F.col("u").alias("node"), "v"), "node").select(
            F.col("node").alias("query"), F.col("v").alias("node")
        )
    )
    begin = begin.unionByName(codes.select("query").crossJoin(F.broadcast(far)))  # ``beam`` rows
    found = walk(begin, codes, nodes, edges, beam)

    # Exact scores for the nodes found, then the rows behind the nodes.
    pairs = found.join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("a")), "query")
    pairs = pairs.join(nodes.select("node", F.col("vector").alias("b")), "node")
    product = F.aggregate(
        F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )
    scored = slim(pairs.select("query", "node", product.alias("score")))
    # At most k + 1 rows of a node can be among the nearest of a query.
    few = Window.partitionBy("node").orderBy("vec_id")
    smallest = member.join(scored.select("node").distinct(), "node", "left_semi")
    smallest = smallest.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k + 1).drop("_r")
    per_query = scored.join(smallest, "node").select("query", "vec_id", "score")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    answers = asked.join(per_query, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        answers.select("query_id", rank.alias("rank"), "vec_id", "score")
        .where(F.col("rank") <= k)
    )
