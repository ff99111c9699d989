"""Scores of texts under an interpolated modified Kneser-Ney bigram model.

Everything is counted in Spark. Words are known by 64-bit hashes. A first pass counts words by ranges
of their hash; a range becomes one pair of sorted arrays (hashes, counts), and the place of a word in
all ranges is its number. A second pass counts pairs of numbers, packed into 64 bits, by ranges of the
pair. The ranges hold about ``mass`` training tokens each whatever the words: they are cut by the
counts of the first pass, and a word with more tokens than that is cut by its second word as well.
Tasks send sorted, counted, compressed runs, not rows for tokens. A range becomes one pair of sorted
arrays. What the model needs for each word (in how many pairs it is second; how many pairs with it as
the first were seen once, twice, more often) is summed by range of words in a third step.

Workers map the arrays and look up the distinct words and pairs of a batch. The driver sees a few
numbers for each range. With c the count of a pair, D the discount for c and N the distinct pairs:

    p(w | v) = (c - D(c) + (D1 N1(v) + D2 N2(v) + D3 N3(v)) p(w)) / c(v)
    p(w)     = (n - D'(n)) / sum(n) + (D1' N1' + D2' N2' + D3' N3') / sum(n) / (V + 1)

with n the number of distinct words before w. Unknown words share the last term's extra place.

Null and empty texts hold the end only. Documents without an id are scored but not learned from, and
held_out is null. Rows with the same id are scored each by its text. Without training text the base
and the model give every token probability 1 (V = 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import remainder, small_batches
from runcourier.llm.runs import MASS, RUN, merged, runs, unpack
from runcourier.llm.store import load, save
from runcourier.llm.words import texts, word_hashes
from runcourier.session import cut, work_path

END = np.uint64(0x656E64)
_LOW = np.int64(0xFFFFFFFF)
GREAT = 2**32 - 1


class Words(NamedTuple):
    """Ranges of words in the shared folder."""

    folder: str
    starts: list[int]  # smallest hash of each range
    numbers: list[int]  # number of the first word of each range, and of the end
    tokens: int

    def hashes(self, part: int) -> np.ndarray:
        return load(f"{self.folder}/words-{part}", "uint64")

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of distinct sorted hashes, -1 for unknown ones."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        edges = np.searchsorted(wanted, np.array(self.starts[1:], dtype=np.uint64))
        edges = np.concatenate([[0], edges, [len(wanted)]])
        for part in np.flatnonzero(np.diff(edges)):
            known = self.hashes(int(part))
            if len(known):
                mine = wanted[edges[part] : edges[part + 1]]
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                out[edges[part] : edges[part + 1]] = np.where(
                    known[at] == mine, at + self.numbers[part], -1
                )
        return out

    def take(self, name: str, kind: str, numbers: np.ndarray) -> np.ndarray:
        """Stored values of sorted numbers; 0 for -1."""
        out = np.zeros(len(numbers), dtype=kind)
        edges = np.searchsorted(numbers, self.numbers)
        for part in np.flatnonzero(np.diff(edges)):
            here = slice(edges[part], edges[part + 1])
            out[here] = load(f"{self.folder}/{name}-{part}", kind)[numbers[here] - self.numbers[part]]
        return out


def _tokens(data: np.ndarray) -> np.ndarray:
    return np.append(word_hashes(data), END)


def count_words(docs: DataFrame, folder: str, ranges: int, mass: int) -> tuple[Words, list]:
    """Count the tokens of all texts. Also for each range: where to cut it so that parts hold about
    ``mass`` tokens, as [number of the first word of a part, tokens in the part]."""
    width = (2**64 + ranges - 1) // ranges
    starts = [i * width for i in range(ranges)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for data in texts(batch.column("text")):
                held.append(_tokens(data))
                n += len(held[-1])
                if n >= mass:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        yield from runs(keys, counts, np.array(starts, dtype=np.uint64))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        keys, counts = merged(rows)
        save(f"{folder}/words-{part}", keys)
        save(f"{folder}/counts-{part}", counts)
        behind = np.cumsum(counts)
        cuts, places, masses = [0], [], []
        while cuts[-1] < len(counts):
            at = cuts[-1]
            done = behind[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(behind, done + mass, "right")))
            places.append(at)
            masses.append(int(behind[to - 1] - done))
            cuts.append(to)
        return pd.DataFrame(
            {"part": [part], "n": [len(keys)], "tokens": [int(counts.sum())], "places": [places], "masses": [masses]}
        )

    found = (
        docs.select("text")
        .mapInArrow(count, RUN)
        .groupBy("part")
        .applyInPandas(merge, "part int, n long, tokens long, places array<long>, masses array<long>")
        .collect()  # a row for each range
    )
    by_part = {r["part"]: r for r in found}
    numbers, cuts = [0], []
    for part in range(ranges):
        r = by_part.get(part)
        if r is None:
            save(f"{folder}/words-{part}", np.empty(0, np.uint64))
            save(f"{folder}/counts-{part}", np.empty(0, np.int64))
        else:
            cuts += [(numbers[-1] + p, m) for p, m in zip(r["places"], r["masses"])]
        numbers.append(numbers[-1] + (r["n"] if r else 0))
    if numbers[-1] >= 2**31 - 1:
        raise ValueError("more than 2^31 different words: their numbers don't fit in pairs")
    return Words(folder, starts, numbers, sum(r["tokens"] for r in found)), cuts


def pair_starts(words: Words, cuts: list, n_docs: int, mass: int) -> list[int]:
    """First pairs of the ranges of pairs. A first word of great mass gets several."""
    total = max(1, words.tokens)
    begin = [c for c, _ in cuts]
    behind = np.cumsum([m for _, m in cuts])
    starts = []
    for first, tokens in [*cuts, (words.numbers[-1], n_docs)]:
        starts.append(first << 32)
        pieces = -(-tokens // mass)
        for k in range(1, pieces if tokens >= 2 * mass else 1):
            second = begin[int(np.searchsorted(behind, k * total / pieces))]
            if (first << 32) + second > starts[-1]:
                starts.append((first << 32) + second)
    starts[0] = 0
    return starts


def _pairs(words: Words, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of some documents: distinct hashes, their numbers, the place of each token in
    them, and for each token the number of the word before it (the number behind all is a start)."""
    every = np.concatenate(docs)
    distinct, place = np.unique(every, return_inverse=True)
    numbers = words.find(distinct)
    before = np.empty(len(every), dtype=np.int64)
    before[1:] = numbers[place[:-1]]
    ends = np.cumsum([len(d) for d in docs])
    before[np.concatenate([[0], ends[:-1]])] = words.numbers[-1]
    return distinct, numbers, place, before


def count_pairs(
    docs: DataFrame, words: Words, starts: list[int], mass: int, most: int
) -> DataFrame:
    """Count pairs of words. Gives a row (kind -1; times: pairs seen 1 to 4 times, and all) for each
    range, and runs of what the range adds to each word (kind 0: pairs with it as the second word;
    1, 2, 3: pairs with it as the first word, seen once, twice, more often)."""
    folder, word_parts = words.folder, np.array(words.numbers[:-1], dtype=np.uint64)
    first_keys = np.array(starts, dtype=np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for data in texts(batch.column("text")):
                held.append(_tokens(data))
                n += len(held[-1])
                if n >= mass:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, numbers, place, before = _pairs(words, held)
        keys = ((before << np.int64(32)) | numbers[place]).view(np.uint64)
        keys, counts = np.unique(keys, return_counts=True)
        yield from runs(keys, counts, first_keys)

    out = "part int, kind int, n int, keys binary, counts binary, times array<long>"

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        keys, counts = merged(rows)
        save(f"{folder}/pairs-{part}", keys)
        save(f"{folder}/times-{part}", np.minimum(counts, most).astype(np.uint32))
        great = np.flatnonzero(counts >= most)
        save(f"{folder}/great-{part}", np.concatenate([great, counts[great]]))
        signed = keys.view(np.int64)
        frames = [[part, -1, 0, b"", b"", [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(keys)]]]
        first, second = signed >> np.int64(32), signed & _LOW
        wanted = [(0, np.sort(second)), *((k, first[np.minimum(counts, 3) == k]) for k in (1, 2, 3))]
        for kind, numbers in wanted:
            number, n = np.unique(numbers, return_counts=True)
            for batch in runs(number.astype(np.uint64), n, word_parts):
                for r in batch.to_pylist():
                    frames.append([r["part"], kind, r["n"], r["keys"], r["counts"], None])
        return pd.DataFrame(frames, columns=[c.split()[0] for c in out.split(", ")])

    return docs.select("text").mapInArrow(count, RUN).groupBy("part").applyInPandas(merge, out)


def sum_words(found: DataFrame, words: Words) -> list:
    """Sum by word what the ranges of pairs gave; a row (part, times 1 to 4, 3 or more, sum) each."""
    folder, numbers = words.folder, words.numbers
    last = len(numbers) - 2

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        # The last range also holds the start of texts, behind all words.
        size = numbers[part + 1] - numbers[part] + (part == last)
        times: list[int] = []
        for kind in range(4):
            total = np.zeros(size, dtype=np.int64)
            mine = rows[rows["kind"] == kind]
            for n, keys, counts in zip(mine["n"], mine["keys"], mine["counts"]):
                at = unpack(keys, n).astype(np.int64) - numbers[part]
                total[at] += unpack(counts, n).view(np.int64)
            save(f"{folder}/seen{kind}-{part}", total.astype(np.uint32))
            if not kind:
                times = [*(int((total == k).sum()) for k in (1, 2, 3, 4)), int((total > 2).sum()), int(total.sum())]
        return pd.DataFrame({"part": [part], "times": [times]})

    rows = found.where("kind >= 0")
    return rows.groupBy("part").applyInPandas(merge, "part int, times array<long>").collect()


def discounts(times: list[int]) -> tuple[float, float, float]:
    """For counts of 1, 2 and more, from how many things were seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = times
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(out, 1))


class Model(NamedTuple):
    words: Words
    pair_starts: list[int]
    n_docs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    seen_sum: int
    spare: float  # what the discounts leave of a probability of 1
    most: int  # counts from here on are stored beside the others

    def times(self, wanted: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(wanted), dtype=np.int64)
        edges = np.searchsorted(wanted, np.array(self.pair_starts[1:], dtype=np.uint64))
        edges = np.concatenate([[0], edges, [len(wanted)]])
        for part in np.flatnonzero(np.diff(edges)):
            known = load(f"{self.words.folder}/pairs-{part}", "uint64")
            if len(known):
                mine = wanted[edges[part] : edges[part + 1]]
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                n = load(f"{self.words.folder}/times-{part}", "uint32")[at].astype(np.int64)
                great = n == self.most
                if great.any():
                    place, count = load(f"{self.words.folder}/great-{part}", "int64").reshape(2, -1)
                    n[great] = count[np.searchsorted(place, at[great])]
                out[edges[part] : edges[part + 1]] = np.where(known[at] == mine, n, 0)
        return out

    def score(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and model score of documents given as token hashes."""
        words = self.words
        size = words.numbers[-1]
        _, numbers, place, before = _pairs(words, docs)
        order = np.argsort(numbers, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        sorted_numbers = numbers[order]
        counts = words.take("counts", "int64", sorted_numbers)[back]
        base = np.log10((counts + 0.1) / (words.tokens + 0.1 * (size + 1)))

        seen = words.take("seen0", "uint32", sorted_numbers)[back].astype(np.float64)
        cut = np.select([seen == 0, seen == 1, seen == 2], [0.0, *self.word_discounts[:2]], self.word_discounts[2])
        low = (seen - cut) / max(1, self.seen_sum) + self.spare / (size + 1)

        contexts, which = np.unique(before, return_inverse=True)
        inside = np.minimum(contexts, size - 1 if size else 0)
        n_first = words.take("counts", "int64", inside)
        n_first[contexts == size] = self.n_docs
        left = np.zeros(len(contexts))
        for kind, d in enumerate(self.pair_discounts, 1):
            n = words.take(f"seen{kind}", "uint32", inside).astype(np.float64)
            if len(contexts) and contexts[-1] == size and size:
                part = len(words.numbers) - 2
                n[-1] = load(f"{words.folder}/seen{kind}-{part}", "uint32")[-1]
            left += d * n
        # Context -1 is unknown, and the end has nothing behind it: only the word itself counts.
        known_context = (contexts >= 0) & (n_first > 0) & (left > 0)

        keys = (before << np.int64(32)) | np.maximum(numbers, 0)[place]
        usable = (before >= 0) & (numbers[place] >= 0)
        wanted, at = np.unique(keys[usable].view(np.uint64), return_inverse=True)
        times = np.zeros(len(keys))
        times[usable] = self.times(wanted)[at]
        d1, d2, d3 = self.pair_discounts
        cut = np.select([times == 0, times == 1, times == 2], [0.0, d1, d2], d3)
        lower = low[place]
        high = (times - cut + left[which] * lower) / np.maximum(n_first[which], 1)
        p = np.where(known_context[which], high, lower)
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
        return (
            np.add.reduceat((counts > 0).astype(np.int64)[place], starts),
            np.add.reduceat(base[place], starts),
            np.add.reduceat(np.log10(p), starts),
        )


def train(docs: DataFrame, mass: int = MASS, most: int = GREAT) -> Model:
    """Count all texts of ``docs`` (column text), in ranges of about ``mass`` tokens.

    Counts of pairs have 32 bits; those of ``most`` and above are stored beside, with 64.
    """
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    folder = work_path(docs.sparkSession, "language-model")
    ranges = int(max(1, (n_bytes // 4 + n_docs) // (2 * mass)))
    words, cuts = count_words(docs, folder, ranges, mass)
    if not words.tokens:
        return Model(words, [0], 0, (0.5, 0.75, 0.9), (0.5, 0.75, 0.9), 0, 1.0, most)
    starts = pair_starts(words, cuts, n_docs, mass)


    found = cut(count_pairs(docs, words, starts, mass, most))
    by_pair = np.sum([r["times"] for r in found.where("kind < 0").select("times").collect()], axis=0)
    by_word = np.sum([r["times"] for r in sum_words(found, words)], axis=0)
    d1, d2, d3 = discounts([int(n) for n in by_word[:4]])
    total = int(by_word[5])
    spare = (d1 * by_word[0] + d2 * by_word[1] + d3 * by_word[4]) / max(1, total)
    have = {r["part"] for r in found.where("kind < 0").select("part").collect()}
    for part in set(range(len(starts))) - have:
        save(f"{folder}/pairs-{part}", np.empty(0, np.uint64))
        save(f"{folder}/times-{part}", np.empty(0, np.uint32))
    by_count = discounts([int(n) for n in by_pair[:4]])
    return Model(words, starts, n_docs, by_count, (d1, d2, d3), total, float(spare), most)


def language_model_scores(
    docs: DataFrame,
    modulus: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    mass: int = MASS,
    most: int = GREAT,
) -> DataFrame:
    """One row per document: tokens, known tokens, base score and model score, in log10."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "held_out", remainder("doc_id", modulus) == 0
    )
    model = train(docs.where("not held_out").select("text"), mass, most)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = [_tokens(d) for d in texts(batch.column("text"))]
            n = [len(t) for t in tokens]
            if model.words.tokens:
                known, base, full = model.score(tokens)
            else:
                known, base, full = (np.zeros(len(n), kind) for kind in (np.int64, float, float))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array([model.words.tokens] * len(n), pa.int64()),
                    pa.array(base),
                    pa.array(full),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        score,
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )
