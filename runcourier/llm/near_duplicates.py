"""Near duplicates by an LSH forest of MinHash signatures.

Documents with equal sets of word shingles are one class from the start. The signature of a class
gives each tree of the forest one row, and the rows of a tree are sorted by signature; the order is
made by ranges, so rows that share long prefixes are spread over tasks like any others. Rows that
share the first ``depth`` values with a neighbour are candidates. Then, in turn:

1. each row is compared with its neighbour in the order, whose common prefix is the longest; the
   links that hold are joined to components;
2. in a dense region (a prefix of ``depth`` values with many rows), the row with most links is
   compared with those of other components;
3. where a prefix still holds several components, the pairs of rows from different components are
   compared, but for those that their rarest shingles rule out (``rare_pairs``; that loses none).

A pair of similarity 0.8 shares the first 4 values in none of 32 trees with probability 5e-8. Every
link is confirmed on the full sets. Only links are joined, and by Spark, not by the driver.

Null and empty texts have no shingles and link with nothing. Rows with the same id count as one
document. Rows without an id take part, each by a key from its text (``node``); a component is named by
its smallest id, or null without one, and its ``first`` node is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import key_id, row_key, semi_ids, slim, small_batches
from runcourier.llm.components import components
from runcourier.llm.runs import MASS, RUN, merged, runs
from runcourier.llm.store import load, save
from runcourier.llm.words import chain, mix, shingles, texts, word_hashes
from runcourier.session import cut, work_path

_STEP = 256
# Rows from which on a region counts as dense.
DENSE = 16


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each factor, the upper half of the smallest product with an item."""
    least = np.full(len(factors), np.uint64(2**64 - 1))
    column = factors[:, None]
    for i in range(0, len(items), _STEP):
        np.minimum(least, (column * items[None, i : i + _STEP]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def set_key(items: np.ndarray) -> bytes:
    n = np.uint64(len(items))
    low = mix(items).sum(dtype=np.uint64) + n
    high = mix(items ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) ^ mix(np.array([n]))[0]
    return np.array([low, high]).tobytes()


def signatures(docs: DataFrame, size: int, trees: int, deep: int) -> DataFrame:
    """Rows (doc_id, node, n_shingles, set_key, signature); the last two are null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(trees * deep)
        for batch in batches:
            counts, keys, signs = [], [], []
            for data in texts(batch.column("text")):
                items = shingles(word_hashes(data), size)
                counts.append(len(items))
                keys.append(set_key(items) if len(items) else None)
                signs.append(signature(items, factors).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("node"),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(signs, pa.binary()),
                ],
                names=["doc_id", "node", "n_shingles", "set_key", "signature"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        sign,
        f"doc_id {id_type}, node long, n_shingles long, set_key binary, signature binary",
    )


def forest(classes: DataFrame, trees: int, depth: int, deep: int) -> DataFrame:
    """Rows (tree, prefix, node, n, before): those that may share ``depth`` values with another row.

    ``before`` is the class just before it in the order if they do.
    """
    width, head = 4 * deep, 4 * depth
    rows = classes.select(
        "node",
        "n",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(trees - 1)),
                lambda t: F.substring(F.col("signature"), t * width + 1, width),
            )
        ).alias("tree", "sign"),
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "tree", "sign", "node").sortWithinPartitions(
        "tree", "sign", "node"
    )

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of the batch before, as arrays of one
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8)
            rows = [signs.reshape(-1, width)[:, :head]]
            rows += [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "tree")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            same = np.zeros(len(rows[1]), dtype=bool)  # as the row before
            same[1:] = (rows[3][1:] == rows[3][:-1]) & (rows[0][1:] == rows[0][:-1]).all(axis=1)
            linked = same.copy()
            linked[:-1] |= same[1:]
            # The row before the first one is in another task, or was held back with its own.
            linked[0] |= held is None or held_linked
            yield out(rows, same, np.flatnonzero(linked[:-1]))
            held, held_linked = [x[-1:] for x in rows], linked[-1]
        if held is not None:
            yield out(held, np.zeros(1, dtype=bool), np.zeros(1, dtype=np.int64))

    def out(rows: list[np.ndarray], same: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        heads, ids, sizes, tree = rows
        prefix = np.zeros(len(at), dtype=np.uint64)
        for i in range(0, head, 4):
            value = np.ascontiguousarray(heads[at, i : i + 4]).view(np.uint32).ravel()
            prefix = chain(prefix, value.astype(np.uint64), i)
        none = ~same[at]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(tree[at].astype(np.int32)),
                pa.array(prefix.view(np.int64)),
                pa.array(ids[at]),
                pa.array(sizes[at]),
                pa.array(ids[at - 1], mask=none),
                pa.array(sizes[at - 1], mask=none),
            ],
            names=["tree", "prefix", "node", "n", "before", "n_before"],
        )

    return ordered.mapInArrow(
        neighbours, "tree int, prefix long, node long, n long, before long, n_before long"
    )


def sets(docs: DataFrame, size: int) -> DataFrame:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(word_hashes(d), size).tobytes() for d in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(items, pa.binary())], names=["node", "items"]
            )

    return docs.mapInArrow(collect, "node long, items binary")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    full = slim(sets(semi_ids(docs, nodes, "node"), size).distinct(), 2_000)

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * common >= percent * (len(a) + len(b) - common))
        return pd.Series(out, dtype=bool)

    joined = pairs.join(full.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    joined = joined.join(full.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
    return slim(joined.where(similar("items_a", "items_b")).select("a", "b").distinct())


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    pairs = rows.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    return slim(pairs.where("a > b").distinct())


def _mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows, with their component, of those prefixes that hold several components."""
    labelled = rows.join(joined, "node", "left").select(
        "tree", "prefix", "node", "n", F.coalesce("component", "node").alias("component")
    )
    several = (
        labelled.groupBy("tree", "prefix")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .where("_low < _high")
        .select("tree", "prefix")
    )
    return slim(labelled.join(several, ["tree", "prefix"]))


def pivots(mixed: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """In each dense region the class with most links, against the classes of other components."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count("*").alias("_degree"))
    known = mixed.join(degrees, "node", "left").withColumn("_degree", F.coalesce("_degree", F.lit(0)))
    best = (
        known.groupBy("tree", "prefix")
        .agg(
            F.max(F.struct("_degree", "node", "component", "n")).alias("_p"),
            F.count("*").alias("_rows"),
        )
        .where((F.col("_rows") >= DENSE) & (F.col("_p._degree") > 0))
    )
    found = mixed.join(best, ["tree", "prefix"]).where("component <> _p.component")
    n, m = F.col("n"), F.col("_p.n")
    found = found.where(100 * F.least(n, m) >= percent * F.greatest(n, m))
    return found.select("node", F.col("_p.node").alias("pivot"))


def rare_pairs(mixed: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of classes that share a prefix of a tree, are of different components, and can be
    similar enough by their rarest shingles.

    If the shingles of all sets are sorted in one order, two sets with at least m in common share one
    among the first n - m + 1 of the one and of the other. The order is by rarity among the classes
    concerned, so few sets share what they begin with, and a shingle of one set alone joins nothing.
    """
    nodes = mixed.groupBy("node").agg(
        F.first("component").alias("component"),
        F.collect_set(F.xxhash64("tree", "prefix")).alias("regions"),  # one for each tree at most
    )
    nodes = slim(nodes)
    full = slim(sets(semi_ids(docs, nodes.select("node"), "node"), size).distinct(), 2_000)
    ranges = max(1, int(full.agg(F.coalesce(F.sum(F.octet_length("items")), F.lit(0))).first()[0] // (16 * MASS)))
    folder = work_path(docs.sparkSession, "shingles")
    width = (2**64 + ranges - 1) // ranges
    starts = np.array([i * width for i in range(ranges)], dtype=np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for items in batch.column("items").to_pylist():
                held.append(np.frombuffer(items, np.uint64))
                n += len(held[-1])
                if n >= MASS:
                    yield from runs(*np.unique(np.concatenate(held), return_counts=True), starts)
                    held, n = [], 0
        if held:
            yield from runs(*np.unique(np.concatenate(held), return_counts=True), starts)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        keys, counts = merged(frame)
        keys, counts = keys[counts > 1], counts[counts > 1]
        save(f"{folder}/keys-{part}", keys)
        save(f"{folder}/counts-{part}", counts)
        return pd.DataFrame({"part": [part]})

    there = {
        r["part"]
        for r in full.mapInArrow(count, RUN).groupBy("part").applyInPandas(merge, "part int").collect()
    }

    def frequencies(items: np.ndarray) -> np.ndarray:
        out = np.ones(len(items), dtype=np.int64)
        edges = np.concatenate([[0], np.searchsorted(items, starts[1:]), [len(items)]])
        for part in np.flatnonzero(np.diff(edges)):
            known = load(f"{folder}/keys-{part}", "uint64") if int(part) in there else ()
            if len(known):
                mine = items[edges[part] : edges[part + 1]]
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                n = load(f"{folder}/counts-{part}", "int64")[at]
                out[edges[part] : edges[part + 1]] = np.where(known[at] == mine, n, 1)
        return out

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("items").to_pylist()):
                items = np.frombuffer(data, np.uint64)
                n = len(items)
                often = frequencies(items)
                least = -(-percent * n // 100)  # in common with any similar set
                order = np.lexsort((items, often))[: n - least + 1]
                place = np.flatnonzero(often[order] > 1)
                if len(place):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "node": pa.array(np.full(len(place), node, np.int64)),
                            "n": pa.array(np.full(len(place), n, np.int64)),
                            "place": pa.array(place),
                            "item": pa.array(items[order[place]].view(np.int64)),
                        }
                    )

    firsts = full.mapInArrow(begin, "node long, n long, place long, item long")
    firsts = firsts.join(nodes.select("node", "component"), "node")
    # Of the sets that begin with a shingle, those of its most frequent component needn't meet.
    by_component = firsts.groupBy("item", "component").agg(F.count("*").alias("_n"))
    major = (
        by_component.groupBy("item")
        .agg(F.max(F.struct("_n", "component")).alias("_m"), F.count("*").alias("_components"))
        .where("_components > 1")
        .select("item", F.col("_m.component").alias("_major"))
    )
    firsts = slim(firsts.join(major, "item"))
    minor = firsts.where("component <> _major").drop("_major")
    other = firsts.select("item", *(F.col(c).alias(f"{c}_2") for c in ("node", "n", "place", "component")))
    common = F.ceil(percent * (F.col("n") + F.col("n_2")) / (100 + percent))
    found = minor.join(other, "item").where(
        (F.col("component") != F.col("component_2"))
        & (100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2"))
        & (F.col("place") <= F.col("n") - common)
        & (F.col("place_2") <= F.col("n_2") - common)
    )
    pairs = _pairs(found, "node", "node_2")
    regions = nodes.select("node", "regions")
    pairs = pairs.join(regions.select(F.col("node").alias("a"), F.col("regions").alias("_ra")), "a")
    pairs = pairs.join(regions.select(F.col("node").alias("b"), F.col("regions").alias("_rb")), "b")
    return pairs.where(F.arrays_overlap("_ra", "_rb")).select("a", "b")


def _of_one_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes that rows of one id are in."""
    rows = signed.where("n_shingles > 0").select("node", "set_key")
    several = (
        rows.groupBy("node")
        .agg(F.min("set_key").alias("_low"), F.max("set_key").alias("_high"))
        .where("_low < _high")
        .select("node")
    )
    first = classes.select("set_key", F.col("node").alias("b"))
    found = rows.join(several, "node").join(first, "set_key")
    return found.select(F.col("node").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    trees: int = 32,
    depth: int = 4,
    deep: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: shingles, component, and whether it is the one to keep.

    Documents are linked if 100 * common shingles >= ``percent`` * all shingles of both.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(
        F.col(id_col).alias("doc_id"),
        row_key(id_col, text_col).alias("node"),
        F.col(text_col).alias("text"),
    )
    signed = cut(signatures(docs, size, trees, deep))
    # Rows with one id are one document, so each class of equal sets is known by its smallest id.
    classes = cut(
        signed.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min("node").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    )
    rows = slim(forest(classes, trees, depth, deep))
    alike = 100 * F.least("n", "n_before") >= percent * F.greatest("n", "n_before")
    tested = _pairs(rows.where("before is not null").where(alike), "node", "before")
    links = confirmed(tested, docs, size, percent)
    links = slim(links.unionByName(_of_one_id(signed, classes)))

    more = _pairs(pivots(_mixed(rows, components(links, "a", "b")), links, percent), "node", "pivot")
    links = slim(links.unionByName(confirmed(more, docs, size, percent)))

    more = _pairs(rare_pairs(_mixed(rows, components(links, "a", "b")), docs, size, percent), "a", "b")
    links = links.unionByName(confirmed(more, docs, size, percent))
    joined = slim(components(links, "a", "b"))
    named = classes.select("set_key", "node").join(joined, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component")
    )
    full = signed.where("n_shingles > 0").join(named, "set_key")
    empty = signed.where("n_shingles = 0").withColumn("component", F.col("node"))
    every = full.select("doc_id", "node", "n_shingles", "component").unionByName(
        empty.select("doc_id", "node", "n_shingles", "component")
    )
    component = key_id(F.col("component"))
    return every.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "node",
        (F.col("node") == F.col("component")).alias("first"),
    )
