"""Periodic runs of words: stretches that repeat a root, by Lyndon arrays from grouped suffixes.

A run is a stretch of consecutive words with smallest period q, at least ``repeats`` roots long, that no
neighbouring word extends. Every run holds Lyndon roots of length q under the order of words or under
the reversed order (the end of a text is least in both), so:

1. suffixes are grouped by their first word and groups are taken from the highest down, as in the first
   phase of Baier's suffix sorter. Each suffix of a group hands its root to the nearest suffix before it
   in a lower group, whose root grows by it; such suffixes rise above the rest of their group. In the
   end, suffixes share a group if and only if their longest Lyndon prefixes are equal, and the lengths
   of these prefixes are the Lyndon array. No suffix array is made.
2. equal groups one root apart are repeated roots, which gives all whole roots of a run at once;
3. both ends are extended by comparing words one period apart.

Groups of one text that hand nothing to each other are taken in one step, and all texts of a batch go
through their steps together, so the work is done by numpy on arrays.

Words are runs of bytes other than space and 0x09 to 0x0D, compared as they are. Null, empty and blank
texts have no words and no runs. Every row gets its result, also rows that repeat or lack an id. A text
is held whole, with about 150 bytes of memory for each of its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import small_batches
from runcourier.llm.words import texts

# Words that go through the steps together.
BATCH_WORDS = 1_000_000
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _stretches(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches start, and their sizes; ``change`` tells that an item differs from the one before."""
    starts = change.nonzero()[0] + 1
    edges = np.empty(len(starts) + 2, np.int64)
    edges[0], edges[1:-1], edges[-1] = 0, starts, len(change) + 1
    return edges[:-1], edges[1:] - edges[:-1]


class _Groups:
    """Suffixes of many texts in slots, ordered by text and group; a group is named by its first slot."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray) -> None:
        n = self.n = len(symbols)
        self.first = np.concatenate([[0], ends[:-1]])
        text = np.repeat(np.arange(len(ends)), ends - self.first)
        key = text * (int(symbols.max(initial=0)) + 1) + symbols
        self.order = np.argsort(key, kind="stable")
        self.slot = np.empty(n, np.int64)
        self.slot[self.order] = np.arange(n)
        ranked = key[self.order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.diff(heads, append=n)
        self.size = np.zeros(n, np.int64)
        self.size[heads] = counts
        # The last entry stands for what precedes a text: below all groups.
        self.group = np.full(n + 1, -1)
        self.group[self.order] = np.repeat(heads, counts)
        self.length = np.ones(n, np.int64)
        self.neighbour = np.arange(-1, n - 1)
        self.neighbour[self.first[self.first < ends]] = -1
        # Everything between ``back`` and a suffix is in its group or a higher one.
        self.back = self.neighbour.copy()
        self.moved = np.zeros(n, bool)
        self.high = ends.copy()
        self.reach = np.full(len(ends), 8)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """The length of the longest Lyndon prefix of each suffix, and the group of equal ones."""
        texts_ = np.flatnonzero(self.high > self.first)
        while len(texts_):
            self._step(texts_)
            texts_ = texts_[self.high[texts_] > self.first[texts_]]
        return self.length, self.group[:-1]

    def _window(self, texts_: np.ndarray) -> np.ndarray:
        """Where the highest groups of each text begin that are looked at next; whole groups only."""
        high = self.high[texts_]
        low = np.maximum(self.first[texts_], high - self.reach[texts_])
        named = self.group[self.order[low]]
        above = named + self.size[named]
        return np.where(named == low, low, np.where(above < high, above, named))

    def _smaller_before(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The nearest suffix before each one that is in a lower group, -1 if there is none."""
        at = self.back[suffix]
        open_ = np.flatnonzero(self.group[at] >= group)
        while len(open_):
            at[open_] = self.back[at[open_]]
            self.back[suffix[open_]] = at[open_]
            open_ = open_[self.group[at[open_]] >= group[open_]]
        return at

    def _step(self, texts_: np.ndarray) -> None:
        low, high = self._window(texts_), self.high[texts_]
        sizes = high - low
        owner = np.repeat(np.arange(len(texts_)), sizes)
        suffix = self.order[_spans(low, sizes)]
        group = self.group[suffix]
        before = self._smaller_before(suffix, group)
        # A group that receives from another one of the window has to wait, and so do all below it.
        received = self.group[before]
        wait = np.where(received >= low[owner], received, -1)
        bar = np.maximum.reduceat(wait, np.cumsum(sizes) - sizes)
        done = group > bar[owner]
        held = suffix[~done]
        self.back[held] = self.neighbour[held]
        self.high[texts_] = np.where(bar < 0, low, bar + self.size[bar])
        took = high - self.high[texts_]
        self.reach[texts_] = np.where(bar < 0, 2 * sizes, took + took // 2 + 4)
        has = (done & (before >= 0)).nonzero()[0]
        if len(has):
            self._hand_all(before[has], group[has], self.length[suffix[has]])

    def _hand_all(self, to: np.ndarray, of: np.ndarray, length: np.ndarray) -> None:
        """Hand over from all groups of a step: to each suffix from its highest group first."""
        rank = np.argsort(to * (self.n + 1) + (self.n - of))
        to, of, length = to[rank], of[rank], length[rank]
        other = to[1:] != to[:-1]
        heads, times = _stretches(other | (of[1:] != of[:-1]))
        to, of, length = to[heads], of[heads], length[heads] * times
        firsts, counts = _stretches(to[1:] != to[:-1])
        turn = 0
        while len(firsts):
            at = firsts + turn
            self._hand(to[at], of[at], times[at], length[at])
            turn += 1
            more = counts > turn
            firsts, counts = firsts[more], counts[more]

    def _hand(self, to: np.ndarray, of: np.ndarray, times: np.ndarray, length: np.ndarray) -> None:
        """Let the roots of distinct suffixes grow by ``length``, and place them in new groups: higher
        for a higher group that hands over, and for more times."""
        self.length[to] += length
        home = self.group[to]
        rank = np.lexsort((times, of, home))
        to, of, times, home = to[rank], of[rank], times[rank], home[rank]
        other = home[1:] != home[:-1]
        homes, counts = _stretches(other)
        heads, sizes = _stretches(other | (of[1:] != of[:-1]) | (times[1:] != times[:-1]))
        left = home[homes]
        rest = self.size[left] - counts
        self.size[left] = rest
        top = left + rest
        slots = _spans(top, counts)
        # Those in the way change places with those that rise from below.
        self.moved[to] = True
        there = self.order[slots]
        there = there[~self.moved[there]]
        self.moved[to] = False
        was = self.slot[to]
        free = np.sort(was[was < np.repeat(top, counts)])
        self.order[free], self.slot[there] = there, free
        self.order[slots], self.slot[to] = to, slots
        starts = slots[heads]
        self.size[starts] = sizes
        self.group[to] = np.repeat(starts, sizes)


def lyndon(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lyndon array of each text, and a number that equal roots of a text share."""
    return _Groups(symbols, ends).run()


def _equal(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many symbols from ``a`` and from ``b`` on are equal, ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    live, width = np.flatnonzero(most > 0), 1
    while len(live):
        place = np.arange(width)
        at = out[live, None] + place
        room = at < most[live, None]
        last = len(symbols) - 1
        same = symbols[np.minimum(a[live, None] + at, last)] == symbols[np.minimum(b[live, None] + at, last)]
        same &= room
        whole = same.all(axis=1)
        out[live] += np.where(whole, width, same.argmin(axis=1))
        live = live[whole]
        width = max(1, min(4 * width, 256, 1_000_000 // max(1, len(live))))
    return out


def find_runs(symbols: np.ndarray, ends: np.ndarray, repeats: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of all texts, in order; starts count over all texts."""
    if not len(symbols):
        return np.empty((0, 3), np.int64)
    sizes = np.diff(ends, prepend=0)
    first, last = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    top, found = int(symbols.max()), []
    for ordered in (symbols, top - symbols):
        length, group = lyndon(ordered, ends)
        # Occurrences of a root are chained where they touch.
        rank = np.argsort(group * len(group) + np.arange(len(group)))
        gap = np.diff(rank) != length[rank[:-1]]
        gap |= group[rank[1:]] != group[rank[:-1]]
        heads = np.flatnonzero(np.concatenate([[True], gap]))
        roots = np.diff(heads, append=len(rank))
        start, q = rank[heads], length[rank[heads]]
        # A run of ``repeats`` periods has one whole root less at least, counted from its leftmost one.
        good = roots >= repeats - 1
        start, q, roots = start[good], q[good], roots[good]
        end = start + roots * q
        right = _equal(symbols, end - q, end, last[start] - end)
        n = len(symbols) - 1
        left = _equal(symbols[::-1], n - (start - 1), n - (start + q - 1), start - first[start])
        size = left + roots * q + right
        good = size >= np.maximum(least, repeats * q)
        found.append(np.stack([start - left, size, q], axis=1)[good])
    # Runs up to the end of a text show under both orders.
    both = np.concatenate(found)
    both = both[np.lexsort((both[:, 2], both[:, 0]))]
    again = (both[1:] == both[:-1]).all(axis=1)
    return both[np.concatenate([[True], ~again])] if len(both) else both


def _results(held: list[list[bytes]], repeats: int, least: int) -> tuple[list, list]:
    """The runs of each text, and the text with one root kept of each run."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    ends = np.cumsum([len(w) for w in held])
    every = map(numbers.__getitem__, chain.from_iterable(held))
    symbols = np.fromiter(every, np.int64, int(ends[-1]))
    found = find_runs(symbols, ends, repeats, least)
    text = np.searchsorted(ends, found[:, 0], "right")
    keep = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(keep, found[:, 0] + found[:, 2], 1)
    np.add.at(keep, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(keep) == 0
    runs: list[list] = [[] for _ in held]
    starts = ends - np.array([len(w) for w in held])
    for i, (start, size, q) in zip(text.tolist(), found.tolist()):
        runs[i].append({"start": start - int(starts[i]), "length": size, "period": q})
    rest = []
    for i, words in enumerate(held):
        kept = compress(words, keep[starts[i] : ends[i]]) if runs[i] else words
        rest.append(b" ".join(kept).decode())
    return runs, rest


def periodic_runs(
    docs: DataFrame,
    repeats: int = 4,
    least_words: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` has (start, length, period) of each run, counted in words from 0 and ordered by start, then
    period. ``collapsed`` is the text without the words that a run holds after its first period, its
    words joined by one space. ``repeats`` is 2 at least.
    """
    if repeats < 2:
        raise ValueError("repeats must be at least 2")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[list[bytes]] = []
        n = 0

        def send() -> pa.RecordBatch:
            runs, rest = _results(held, repeats, least_words)
            run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(ids),
                    pa.array([len(w) for w in held], pa.int64()),
                    pa.array(runs, pa.list_(run)),
                    pa.array(rest, pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

        for batch in batches:
            at = 0
            for i, data in enumerate(texts(batch.column("text"))):
                held.append(data.tobytes().split())
                n += len(held[-1])
                if n >= BATCH_WORDS:
                    ids.append(batch.column("doc_id")[at : i + 1])
                    yield send()
                    ids, held, n, at = [], [], 0, i + 1
            if at < batch.num_rows:
                ids.append(batch.column("doc_id")[at:])
        if held:
            yield send()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {id_type}, n_words bigint, runs {RUN}, collapsed string")
