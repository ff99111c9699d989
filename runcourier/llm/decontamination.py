"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few words in a row; words at the gaps of a mask are ignored, so one hash
stands for texts that differ there. The hashes of all benchmark items are joined with those of all
documents, and around every hit the item is laid over the document word by word. An item is found if
some stretch of ``window`` words (or the whole item, if shorter) has at least 80 of 100 words equal.
The two masks leave a hit in every such stretch of 13 words. Shorter items, down to five words, are
sought by pairs of words; items with fewer than five words are not sought.

Documents are many and hits are few, so a bit table of the benchmark's hashes of bounded size goes
ahead of the join; what passes it is joined in full, so a table that is too small costs time only.
Texts are lower-cased and ASCII punctuation is taken out before they are cut into words.

Null and empty texts hold nothing. Rows with the same id count as one document, items with the same
id as one item. A document without an id is reported with a null id, and by ``node``, its key from its text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import key_id, row_key, semi_ids, small_batches, without_nodes
from runcourier.llm.words import mix, texts, word_hashes
from runcourier.session import cut

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
PAIR = (0, 1)
LEAST_WORDS = 5
# Size of the bit table, as a power of two: 8 MB at most, whatever the benchmark's size.
MIN_BITS, MAX_BITS = 16, 26
# Candidates of a document that one task compares at a time.
BLOCK = 2000


def plain(text: Column) -> Column:
    return F.translate(F.lower(text), string.punctuation, "")


def seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the words under the mask, at every place of a text."""
    n = max(0, len(words) - mask[-1])
    total = np.full(n, np.uint64(len(mask) * 64 + mask[-1]))
    for i, offset in enumerate(mask):
        total += words[offset : offset + n] * np.uint64(2 * (i * 0x51ED27 + 0x3C6EF372) + 1)
    return mix(total)


def _probes(hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift, low = np.uint64(64 - bits), np.uint64(2**bits - 1)
    return (hashed >> shift).astype(np.int64), (hashed & low).astype(np.int64)


def benchmark_seeds(items: DataFrame, masks: list[tuple[int, ...]], window: int) -> DataFrame:
    """Rows (mask, hash, item, at) of every item; pairs stand for short items only."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, data in zip(batch.column("item").to_pylist(), texts(batch.column("text"))):
                words = word_hashes(data)
                if len(words) < LEAST_WORDS:
                    continue
                for m, mask in enumerate(masks):
                    if (len(mask) == 2) != (len(words) < window):
                        continue
                    found = seeds(words, mask)
                    yield from _batches(
                        {
                            "mask": np.full(len(found), m, np.int32),
                            "hash": found.view(np.int64),
                            "item": np.full(len(found), item, np.int64),
                            "at": np.arange(len(found), dtype=np.int64),
                        }
                    )

    return items.mapInArrow(build, "mask int, hash long, item long, at long").distinct()


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if len(next(iter(columns.values()))):
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def bit_table(hashed: DataFrame) -> tuple[int, np.ndarray]:
    """The power of two and the bits that the hashes set; the table's size is bounded."""
    n = max(1, hashed.count())
    bits = int(np.clip(np.ceil(np.log2(n)) + 8, MIN_BITS, MAX_BITS))
    high = F.shiftrightunsigned("hash", 64 - bits)
    low = F.col("hash").bitwiseAND(F.lit(2**bits - 1))
    places = hashed.select(F.explode(F.array(high, low)).alias("p"))
    words = places.groupBy((F.col("p") / 32).cast("long").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("v")
    )
    table = np.zeros(2 ** (bits - 5), dtype=np.uint32)
    for w, v in words.toLocalIterator():  # one row for each 32 bits of the table at most
        table[w] = v
    return bits, table


def hits(docs: DataFrame, masks: list[tuple[int, ...]], bits: int, table: np.ndarray) -> DataFrame:
    """Rows (node, mask, hash, place) of the documents that pass the bit table."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def is_set(places: np.ndarray) -> np.ndarray:
        return (shared.value[places >> 5] >> (places & 31).astype(np.uint32)) & np.uint32(1) == 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), texts(batch.column("text"))):
                words = word_hashes(data)
                for m, mask in enumerate(masks):
                    found = seeds(words, mask)
                    one, two = _probes(found, bits)
                    at = np.flatnonzero(is_set(one))
                    at = at[is_set(two[at])]
                    yield from _batches(
                        {
                            "node": np.full(len(at), node, np.int64),
                            "mask": np.full(len(at), m, np.int32),
                            "hash": found[at].view(np.int64),
                            "place": at.astype(np.int64),
                        }
                    )

    return docs.mapInArrow(find, "node long, mask int, hash long, place long")


def overlap(
    doc: np.ndarray, item: np.ndarray, shift: int, window: int, percent: int
) -> tuple[int, int, int] | None:
    """First word, words and equal words of the part of ``doc`` where ``item`` lies over it."""
    first, last = max(0, shift), min(len(doc), shift + len(item))
    size = min(window, len(item))
    if last - first < size:
        return None
    equal = doc[first:last] == item[first - shift : last - shift]
    total = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(100 * (total[size:] - total[:-size]) >= percent * size)
    if not len(good):
        return None
    covered = np.zeros(last - first + 1, dtype=np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + size, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return int(first + good[0]), int(inside.sum()), int(equal[inside].sum())


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and item found in it, by the best overlap of the two."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        row_key(id_col, text_col).alias("node"),
        plain(F.col(text_col)).alias("text"),
    )
    items = items.select(
        row_key(item_col, item_text_col).alias("item"), plain(F.col(item_text_col)).alias("text")
    )
    masks = [*MASKS, PAIR]
    known = cut(benchmark_seeds(items, masks, window))
    if known.where(F.col("mask") == len(masks) - 1).isEmpty():
        masks = masks[:-1]
    bits, table = bit_table(known)
    found = hits(docs, masks, bits, table).join(known, ["mask", "hash"])
    pairs = cut(
        found.select("node", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    )
    # The candidates of a document in blocks, so that one with very many is spread.
    blocks = pairs.groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    pairs = pairs.join(blocks, "node").withColumn(
        "block", F.pmod(F.xxhash64("item", "shift"), F.col("_blocks"))
    )
    words = cut(_item_words(items))
    pairs = pairs.join(words, "item")
    packed = pairs.groupBy("node", "block").agg(
        F.collect_list(F.struct("item", "shift", "words")).alias("candidates")
    )
    texts_of = semi_ids(docs, packed.select("node").distinct(), "node")
    out = "doc_id long, node long, item long, n_item long, start long, n_words long, n_equal long"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, node, text, candidates in zip(
                batch["doc_id"], batch["node"], batch["text"], batch["candidates"]
            ):
                doc = word_hashes(np.frombuffer((text or "").encode(), np.uint8))
                for c in candidates:
                    item = np.frombuffer(c["words"], np.uint64)
                    best = overlap(doc, item, c["shift"], window, percent)
                    if best:
                        rows.append((doc_id, node, c["item"], len(item), *best))
            names = [x.split()[0] for x in out.split(", ")]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({n: "Int64" for n in names})

    # Few rows, but each with a list of candidates.
    laid = texts_of.join(packed, "node").select("doc_id", "node", "text", "candidates")
    matches = laid.mapInPandas(compare, out)
    best = matches.groupBy("node", "item").agg(
        F.max(
            F.struct("n_equal", F.col("n_words"), (-F.col("start")).alias("s"), "n_item")
        ).alias("m"),
        F.count("*").alias("n_places"),
    )
    return best.select(
        "node",
        key_id(F.col("node")).alias("doc_id"),
        key_id(F.col("item")).alias("item_id"),
        F.col("m.n_item").alias("n_item"),
        (-F.col("m.s")).alias("start"),
        F.col("m.n_words").alias("n_words"),
        F.col("m.n_equal").alias("n_equal"),
        "n_places",
    )


def _item_words(items: DataFrame) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_hashes(d).tobytes() for d in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(found, pa.binary())], names=["item", "words"]
            )

    return items.mapInArrow(build, "item long, words binary").distinct()


def clean_documents(
    docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents without a benchmark item; a row without an id is judged by its own text."""
    return without_nodes(docs, found, id_col, text_col)
