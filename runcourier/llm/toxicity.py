"""Toxicity of texts behind a noisy channel.

Writers hide words: other signs for letters, spaces or dots between letters, letters repeated. A
suspicious piece of text is read as the output of a noisy channel. Its lattice holds, for each sign,
the letters it may stand for, itself as a letter, a border of words, or nothing (separators and
repeated letters), each with the channel's probability. A Viterbi search finds the most probable
letters under a character trigram model, counted over all documents. Words without suspicious signs
are their own only path and are taken as they are. Pieces of at most three signs in a row, or of signs
apart, are read once more as one lattice, in which the gaps may be nothing or a border.

The restored words are scored: every beginning of a word of 3 to 6 letters, and the word itself, has a
probability of label 1, learned from how many documents of either label hold it. The three words with
the highest ones go into a logistic regression, fitted with the document's own label taken out of
the counts. Learning uses at most ``sample`` labelled documents, by a hash of the id; labels are taken
only where crc32(doc_id as text) mod 3 is not 1. Statistics of letters cover all documents.

Null and empty texts get the score of a text without any known word. Rows with the same id are scored
each by its text. Rows without an id have no remainder and are not held out (null); they aren't learned from.
Without labels of both kinds all scores are the share of label 1 (0 if there are no labels).
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import remainder, semi_ids, small_batches
from runcourier.llm.words import LOWER, SPACE, hashes, texts
from runcourier.session import cut

# Bounds of what is learned from, and of words kept in memory.
SAMPLE = 30_000
WORDS_KEPT = 300_000
# Longer pieces and runs are read anew each time.
KEPT_LENGTH = 64

# Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*~'`,/"
BORDER = 0
OTHER = 27

# Log probabilities of the channel.
AS_LETTER, AS_SIGN, AS_BORDER = math.log(0.9), math.log(0.5), math.log(0.05)
KEEP, DROP, SPLIT = math.log(0.6), math.log(0.3), math.log(0.1)
# A second letter in a word without longer repetitions: repeated, or meant.
TWICE, MEANT = math.log(0.03), math.log(0.97)


def classes_of(text: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else BORDER for c in text]


def letter_counts(docs: DataFrame) -> DataFrame:
    """Rows (code, n) of the character trigrams of all texts, in 28 classes."""
    group = np.zeros(256, dtype=np.int64)
    group[97:123] = np.arange(1, 27)
    group[0x80:] = OTHER
    group = group[LOWER]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(28**3, dtype=np.int64)
        for batch in batches:
            for data in texts(batch.column("text")):
                for i in range(0, len(data), 1 << 20):
                    c = np.concatenate([[0], group[data[max(0, i - 1) : i + (1 << 20)]], [0]])
                    total += np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at), "n": pa.array(total[at])})

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")
    )


def letter_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b; trigrams, bigrams and letters interpolated."""
    n = counts.reshape(28, 28, 28).astype(np.float64)
    one = n.sum(axis=(0, 1)) + 1
    one /= one.sum()
    two = n.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    three = (n + 20 * two[None]) / (n.sum(axis=2, keepdims=True) + 20)
    return np.log(three)


@lru_cache(4096)
def options(c: str, again: bool) -> list[tuple[str, int, float]]:
    """What a sign may be, as (letters, class or -1 for nothing, log probability); ``again`` if the
    sign before is the same."""
    if c.isalpha():
        group = classes_of(c)[0]
        return [(c, group, KEEP), ("", -1, DROP)] if again else [(c, group, AS_LETTER)]
    if c in SIGNS:
        letters = [(x, ord(x) - 96, AS_SIGN - math.log(len(SIGNS[c]))) for x in SIGNS[c]]
        return [*letters, (" ", BORDER, AS_BORDER), ("", -1, AS_BORDER + DROP)]
    if c in SEPARATORS:
        return [("", -1, DROP), (" ", BORDER, SPLIT)]
    return [(" ", BORDER, AS_LETTER)]


def lattice(piece: str) -> Iterator[list[tuple[str, int, float]]]:
    """The options of each sign."""
    before = ""
    for c in piece:
        yield options(c, c == before)
        before = c


# For the last two classes of a way, its log probability and its letters as a chain from the last one.
Ways = dict[tuple[int, int], tuple[float, tuple]]


def advance(best: Ways, piece: str, model: Sequence, parts: list[str]) -> Ways:
    """The best ways through a piece more. Letters that are settled go to ``parts``."""
    for step in lattice(piece):
        then: Ways = {}
        for (a, b), (score, path) in best.items():
            for letters, group, channel in step:
                if group < 0:
                    state, now, after = (a, b), score + channel, path
                elif group == BORDER and b == BORDER:
                    state, now, after = (a, b), score + channel, path
                else:
                    state = (b, group)
                    now, after = score + channel + model[a][b][group], (path, letters)
                if state not in then or then[state][0] < now:
                    then[state] = (now, after)
        best = then
        if len(best) == 1:  # whatever follows, the way up to here is this one
            ((state, (_, path)),) = best.items()
            parts += _letters(path)
            best = {state: (0.0, ())}
    return best


def ended(best: Ways, model: Sequence, parts: list[str]) -> str:
    last = max(best.items(), key=lambda x: x[1][0] + model[x[0][0]][x[0][1]][BORDER])
    return "".join(parts + _letters(last[1][1]))


def restore(piece: str, model: Sequence) -> str:
    """The most probable letters behind a piece of text of any length, words divided by spaces."""
    parts: list[str] = []
    return ended(advance({(BORDER, BORDER): (0.0, ())}, piece, model, parts), model, parts)


def _letters(path: tuple) -> list[str]:
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return out[::-1]


_PLAIN = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1")
_PAIR = re.compile(r"(.)\1")
# Two or more pieces in a row, among the kinds of tokens.
_ROW = re.compile(rb"\x01{2,}")
_EDGE = re.compile(r"^[^\w@$!+|(€£¡]+|[^\w@$]+$")
# The common ones among the signs that _EDGE trims; letters left by them are left by it too.
_LEFT = "\"#%&'*),-./:;<=>?[\\]^`{}~"
_RIGHT = _LEFT + "!+|("
# Pieces of hidden words: signs of the lattice, at most three or each one apart.
_TRIM = re.compile(r"^[^\w@$!+|(€£¡]+|[^\w@$!+|(€£¡]+$")
_SIGN, _GAP = r"(?:[^\W_]|[@$!+|(€£¡])", r"[ ._\-*~'`,/]"
_APART = re.compile(f"{_GAP}*(?:{_SIGN}{_GAP}+)*{_SIGN}{_GAP}*")
_SHORT = re.compile(f"{_GAP}*(?:{_SIGN}{_GAP}*){{1,3}}")
_LOOSE = "!+|(€£¡ "


def letters(token: str) -> str | None:
    """A token's letters, if it has nothing else but common signs at its edges."""
    core = token.lower()
    if not core.isalpha():
        core = core.lstrip(_LEFT).rstrip(_RIGHT)
        if not core.isalpha():
            return None
    return core


class Kept(dict):
    """Values by their keys, computed once; long keys are not kept, and a full table starts anew."""

    def __init__(self, value: Callable, most: int = WORDS_KEPT):
        self.value, self.most = value, most

    def __missing__(self, key):
        found = self.value(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


class Reader:
    """Words of a text as they were meant."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.known = Kept(self.read)
        self.pieces = Kept(self.piece)
        self.kinds = Kept(self.kind)
        self.steps: dict[tuple, tuple[str, tuple[int, int]]] = {}

    def words(self, token: str) -> tuple[str, ...]:
        return self.known[token]

    def read(self, token: str) -> tuple[str, ...]:
        if " " in token:  # a run, trimmed already
            return tuple(w for t in {token, token.strip(_LOOSE)} for w in self.run(t).split())
        core = letters(token)
        if core is None:
            core = _EDGE.sub("", token.lower())
        elif not _PAIR.search(core):
            return (core,)
        elif not _RUN.search(core):
            single = self.undoubled(core)
            return (core,) if single == core else (core, single)
        found = restore(core, self.model).split()
        return (*found, *(w for w in _PLAIN.findall(core) if len(w) > 2))

    def undoubled(self, word: str) -> str:
        """The word without second letters that are more probably repeated ones.

        For letters that stand twice at most this is the search over all ways: whether a letter is
        dropped or not, the next one leaves the same two classes behind.
        """
        kept, end = "", 0
        for pair in _PAIR.finditer(word):
            at = pair.start()
            before, x, after = word[at - 1 : at], word[at], word[at + 2 : at + 3]
            a, x, c = (classes_of(s)[0] if s else BORDER for s in (before, x, after))
            if TWICE + self.model[a][x][c] > MEANT + self.model[a][x][x] + self.model[x][x][c]:
                kept += word[end : at + 1]
                end = at + 2
        return kept + word[end:]

    def run(self, run: str) -> str:
        """As ``restore``, but ways between settled places are kept: after a plain piece of two letters
        or more, one way is left as a rule."""
        parts: list[str] = []
        best: Ways = {(BORDER, BORDER): (0.0, ())}
        chunk, gap = "", ""
        for piece in run.split(" "):
            chunk += gap + piece
            gap = " "
            if len(piece) < 2 or not piece.isalpha():
                continue
            state = next(iter(best)) if len(best) == 1 else None
            known = self.steps.get((state, chunk))
            if known:
                parts.append(known[0])
                best = {known[1]: (0.0, ())}
            else:
                more: list[str] = []
                best = advance(best, chunk, self.model, more)
                if state and len(best) == 1 and len(chunk) <= KEPT_LENGTH:
                    if len(self.steps) >= WORDS_KEPT:
                        self.steps.clear()
                    self.steps[state, chunk] = "".join(more), next(iter(best))
                parts += more
            chunk = ""
        return ended(advance(best, chunk, self.model, parts), self.model, parts)

    def piece(self, token: str) -> tuple[str, bool] | None:
        """A piece of a run, and whether its signs are apart. Empty if it holds no sign."""
        core = _TRIM.sub("", token.lower())
        if not core or not core.strip(SEPARATORS):
            return "", True
        if len(core) > 3 and core.isalpha():
            return None
        if _APART.fullmatch(core):
            return core, True
        if _SHORT.fullmatch(core):
            return core, False
        return None

    def kind(self, token: str) -> int:
        """1 for a piece, 0 for a token that ends a run."""
        return int(self.pieces[token] is not None)

    def runs(self, tokens: list[str]) -> set[str]:
        """Short pieces in a row, and those among them with their signs apart."""
        found: set[str] = set()
        kinds = self.kinds
        # Most tokens are plain and too long for a piece.
        for row in _ROW.finditer(bytes([0 if len(t) > 3 and t.isalpha() else kinds[t] for t in tokens])):
            self.row([self.pieces[t] for t in tokens[row.start() : row.end()]], found)
        return found

    def row(self, pieces: list[tuple[str, bool]], found: set[str]) -> None:
        """The runs of pieces that stand in a row."""
        every = [core for core, _ in pieces if core]
        if len(every) > 1:
            found.add(" ".join(every))
        apart: list[str] = []
        for core, is_apart in [*pieces, ("|", False)]:
            if not core:
                continue
            if is_apart:
                apart.append(core)
                continue
            if len(apart) > 1:
                found.add(" ".join(apart))
            apart = []

    def tokens(self, text: str) -> set[str]:
        """The distinct tokens of a text in lower case, and its runs."""
        tokens = text.lower().split()
        found = self.runs(tokens)
        found.update(tokens)
        return found

    def text(self, text: str) -> set[str]:
        """The distinct words of a text, spelled-out ones included."""
        return set().union(*map(self.known.__getitem__, self.tokens(text)))


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(3, min(7, len(word)))] + [word + "$"]


# Words whose scores a text is judged by.
TOP = 3


class Scorer:
    """Probabilities of label 1 by the beginnings of words."""

    def __init__(self, entries: dict[str, tuple[int, int]], share: float, strength: float = 6.0):
        self.entries, self.share, self.strength = entries, share, strength
        self.floor = math.log(share / (1 - share))
        self.seen: dict[tuple[int, int], float] = {}
        self.scores = {entry: self.one(*counts) for entry, counts in entries.items()}
        # Beginnings of 4 signs and more all start with these.
        self.starts = {entry[:4] for entry in entries if len(entry) > 3}

    def one(self, positive: int, negative: int) -> float:
        found = self.seen.get((positive, negative))
        if found is None:
            found = self.seen[positive, negative] = self.log_odds(positive, negative)
        return found

    def log_odds(self, positive: int, negative: int) -> float:
        p = (positive + self.strength * self.share) / (positive + negative + self.strength)
        return math.log(p / (1 - p))

    def word(self, word: str) -> float:
        get, best = self.scores.get, self.floor
        if len(word) > 3:
            best = max(best, get(word[:3], best))
            if word[:4] not in self.starts:
                return best
            for n in range(4, min(7, len(word))):
                found = get(word[:n])
                if found is not None and found > best:
                    best = found
        return max(best, get(word + "$", best))

    def without(self, words: set[str], label: int) -> list[float]:
        """Word scores with one document of this label taken out of the counts."""
        out, known = [], self.entries
        for word in words:
            if len(word) > 3 and word[:4] not in self.starts:
                hits = [known[word[:3]]] if word[:3] in known else []
            else:
                hits = [known[b] for b in beginnings(word) if b in known]
            if hits:
                out.append(max(self.one(p - label, n - 1 + label) for p, n in hits))
        return out

    def top(self, scores: list[float]) -> tuple[float, float, float]:
        best = sorted((s for s in scores if s > self.floor), reverse=True)[:TOP]
        return tuple(best + [self.floor] * (TOP - len(best)))


# White space that only Python's own split knows.
_ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BREAK = SPACE.copy()
_BREAK[0x1C:0x20] = True
_IS_LEFT, _IS_RIGHT = (np.isin(np.arange(256), [ord(c) for c in s]) for s in (_LEFT, _RIGHT))
# Texts that are looked at together; longer ones are read token by token.
JOINED, LONG = 2_000_000, 8_000_000


class Telling:
    """The words of texts that speak for label 1, with their scores.

    Tokens of the common letters, which are most, are their own only path unless a letter stands twice
    and shouldn't: they are cut and looked up as arrays, by 64-bit hashes. All others, and runs, go
    through the reader.
    """

    def __init__(self, reader: Reader, scorer: Scorer):
        self.reader, self.scorer = reader, scorer
        self.model = np.array(reader.model)
        self.told = Kept(self.token)
        self.rows = Kept(self.row)
        by_size: dict[int, list[str]] = {n: [] for n in (0, 3, 4, 5, 6)}
        for entry in scorer.scores:
            by_size[0 if entry[-1] == "$" else len(entry)].append(entry)
        self.tables = {n: self._table(entries) for n, entries in by_size.items()}

    def _table(self, entries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [e.removesuffix("$").encode() for e in entries]
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        found = hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends) if raw else np.empty(0, np.uint64)
        order = np.argsort(found)
        return found[order], np.array([self.scorer.scores[e] for e in entries])[order]

    def token(self, token: str) -> tuple[tuple[str, float], ...]:
        scored = ((w, self.scorer.word(w)) for w in self.reader.read(token))
        return tuple(pair for pair in scored if pair[1] > self.scorer.floor)

    def row(self, row: str) -> tuple[tuple[str, float], ...]:
        """The words of the runs of tokens that stand in a row."""
        return tuple(chain.from_iterable(self.told[run] for run in self.reader.runs(row.split())))

    def slowly(self, text: str) -> dict[str, float]:
        return dict(chain.from_iterable(filter(None, map(self.told.__getitem__, self.reader.tokens(text)))))

    def _best(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The score of each word, by its beginnings and itself; ``whole`` are the hashes of the words."""
        best = np.full(len(starts), self.scorer.floor)
        heads = (data & 0xC0) != 0x80
        chars = np.flatnonzero(heads)
        before = np.concatenate([[0], np.cumsum(heads)])
        sizes = before[ends] - before[starts]
        for n, (known, scores) in self.tables.items():
            if not len(known):
                continue
            # A beginning is shorter than its word.
            mine = np.arange(len(starts)) if not n else np.flatnonzero(sizes > n)
            wanted = whole if not n else hashes(data, starts[mine], chars[before[starts[mine]] + n])
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            hit = known[at] == wanted
            best[mine[hit]] = np.maximum(best[mine[hit]], scores[at[hit]])
        return best

    def texts(self, texts_: list[str]) -> list[dict[str, float]]:
        """For each text telling words, the highest ones among them."""
        out: list[dict[str, float]] = [{} for _ in texts_]
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts_):
            if len(text) > LONG or _ODD_SPACE.search(text):
                out[i] = self.slowly(text)
                continue
            held.append(i)
            size += len(text)
            if size > JOINED:
                self._joined(held, texts_, out)
                held, size = [], 0
        if held:
            self._joined(held, texts_, out)
        return out

    def _repeated(
        self, data: np.ndarray, latin: np.ndarray, first: np.ndarray, last: np.ndarray, words: np.ndarray
    ) -> np.ndarray:
        """Which of the words have a letter three times in a row, or a second one that is dropped: those
        that the reader has to see. Two letters of two bytes in a row count as such, too."""
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[first[words]] = edge[last[words]] = True
        at = np.flatnonzero(data[1:] == data[:-1]) + 1
        at = at[(data[at] < 0x80) & ~edge[at]]
        group = np.zeros(256, dtype=np.int64)
        group[97:123] = np.arange(1, 27)
        group[0x80:] = OTHER
        a = np.where(edge[at - 1], BORDER, group[data[np.maximum(at - 2, 0)]])
        x = group[data[at]]
        c = np.where(edge[at + 1], BORDER, group[data[np.minimum(at + 1, n - 1)]])
        dropped = TWICE + self.model[a, x, c] > MEANT + self.model[a, x, x] + self.model[x, x, c]
        dropped |= ~edge[at - 1] & (data[np.maximum(at - 2, 0)] == data[at])
        bad = np.zeros(n, dtype=np.int32)
        bad[at[dropped]] = 1
        if len(latin):
            same = (np.diff(latin) == 2) & (data[latin[1:] + 1] == data[latin[:-1] + 1])
            bad[latin[1:][same]] = 1
        total = np.concatenate([[0], np.cumsum(bad)])
        return total[last] > total[np.minimum(first + 1, last)]

    def _joined(self, held: list[int], texts_: list[str], out: list[dict[str, float]]) -> None:
        raw = [texts_[i].encode() for i in held]
        joined = b"\n".join(raw)
        data = LOWER[np.frombuffer(joined, np.uint8)]
        n = len(data)
        # The letters U+00C0 to U+00FF, two bytes each, and their lower case.
        latin = np.flatnonzero(data[:-1] == 0xC3)
        second = data[latin + 1]
        data[latin + 1] = second = np.where((second < 0x9F) & (second != 0x97), second + 0x20, second)
        latin = latin[(second != 0x97) & (second != 0xB7)]
        edge = np.flatnonzero(np.diff((~_BREAK[data]).view(np.int8), prepend=0, append=0))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return
        text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, "right")
        letter = (data >= 97) & (data <= 122)
        letter[latin] = letter[latin + 1] = True
        place = np.arange(n, dtype=np.int32)
        ahead = np.minimum.accumulate(np.where(_IS_LEFT[data], np.int32(n), place)[::-1])[::-1]
        behind = np.maximum.accumulate(np.where(_IS_RIGHT[data], np.int32(-1), place))
        first = np.minimum(ahead[start], end)
        last = np.maximum(behind[end - 1] + 1, first)
        letters_ = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
        plain = (last > first) & (letters_[last] - letters_[first] == last - first)
        plain &= ~self._repeated(data, latin, first, last, plain)

        def pairs(own: np.ndarray, which: np.ndarray, score: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
            """(text, distinct token) of the ``most`` highest tokens of each text that tell something."""
            mine = np.flatnonzero((score > self.scorer.floor)[which])
            both = np.unique(text[own[mine]] * len(score) + which[mine])
            t, k = both // len(score), both % len(score)
            order = np.lexsort((-score[k], t))
            t, k = t[order], k[order]
            top = np.arange(len(t)) - np.searchsorted(t, t) < most
            yield from zip(t[top].tolist(), k[top].tolist())

        own = np.flatnonzero(plain)
        found = hashes(data, first[own], last[own])
        whole, one, which = np.unique(found, return_index=True, return_inverse=True)
        # Ranges have to be in order to be hashed.
        order = np.argsort(one)
        at = own[one[order]]
        best = np.empty(len(whole))
        best[order] = self._best(data, first[at], last[at], whole[order])
        for t, k in pairs(own, which, best, TOP):
            i = own[one[k]]
            out[held[t]][joined[first[i] : last[i]].decode().lower()] = float(best[k])

        own = np.flatnonzero(~plain)
        found = hashes(data, start[own], end[own])
        _, one, which = np.unique(found, return_index=True, return_inverse=True)
        told = [self.told[joined[start[i] : end[i]].decode().lower()] for i in own[one].tolist()]
        # Several of these may have the same word, so all of them count.
        best = np.array([max((s for _, s in words), default=self.scorer.floor) for words in told])
        for t, k in pairs(own, which, best, len(own)) if told else ():
            out[held[t]].update(told[k])

        # Rows of two or more tokens that may be pieces of a run: short, or not of letters only.
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
        short = ~((heads[end] - heads[start] > 3) & (letters_[end] - letters_[start] == end - start))
        change = np.flatnonzero(np.diff(short.view(np.int8)) | (np.diff(text) != 0)) + 1
        edges = np.concatenate([[0], change, [len(short)]])
        rows = np.flatnonzero(short[edges[:-1]] & (np.diff(edges) > 1))
        for a, b in zip(edges[rows].tolist(), edges[rows + 1].tolist()):
            words = self.rows[joined[start[a] : end[b - 1]].decode().lower()]
            if words:
                out[held[text[a]]].update(words)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights, the last one for the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: held_out, score between 0 and 1, and whether it reaches the threshold.

    With ``keep``, these columns of the documents that don't reach it, as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    all_docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = np.zeros(28**3, dtype=np.int64)
    for code, n in letter_counts(all_docs).collect():  # 21,952 rows at most
        counts[code] = n
    model = spark.sparkContext.broadcast(letter_model(counts))

    # A label for an id: 1 if any row says so.
    marked = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(remainder("doc_id", 3) != 1)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    learned = semi_ids(all_docs.dropna(subset=["doc_id"]), chosen, "doc_id").join(
        F.broadcast(chosen), "doc_id"  # at most ``sample`` rows
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.value)
        for batch in batches:
            found = [sorted(reader.text(t or "")) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "words": found})

    words = cut(learned.mapInPandas(read, "label int, words array<string>"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, found in zip(batch["label"], batch["words"]):
                held[label].update({b for w in found for b in beginnings(w)})
            if len(held[0]) + len(held[1]) > 1_000_000:
                yield from flush(held)
        yield from flush(held)

    def flush(held: tuple[Counter, Counter]) -> Iterator[pd.DataFrame]:
        for label, counter in enumerate(held):
            if counter:
                n = np.fromiter(counter.values(), np.int64)
                yield pd.DataFrame({"entry": list(counter), "positive": n * label, "negative": n * (1 - label)})
            counter.clear()

    totals = {r["label"]: r["n"] for r in words.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(totals.values())
    share = totals.get(1, 0) / total if total else 0.0
    if 0 < share < 1:
        by_entry = (
            words.mapInPandas(count, "entry string, positive long, negative long")
            .groupBy("entry")
            .agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
            .where((F.col("positive") > 1) & (F.col("positive") > share * (F.col("positive") + F.col("negative"))))
        )
        # Only what the sample holds, so its documents bound this.
        entries = {r[0]: (r[1], r[2]) for r in by_entry.toLocalIterator()}
        known = spark.sparkContext.broadcast((entries, share))

        def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorer = Scorer(*known.value)
            for batch in batches:
                rows = [scorer.top(scorer.without(set(w), y)) for y, w in zip(batch["label"], batch["words"])]
                yield pd.DataFrame(rows, columns=["a", "b", "c"]).assign(label=batch["label"].to_numpy())

        seen = words.mapInPandas(top, "a double, b double, c double, label int").toPandas()
        weights = logistic(seen[["a", "b", "c"]].to_numpy(), seen["label"].to_numpy())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not 0 < share < 1:
            for batch in batches:
                yield pd.Series(share, index=batch.index, dtype="float64")
            return
        reader, scorer = Reader(model.value), Scorer(*known.value)

        telling = Telling(reader, scorer)
        # Nothing below makes cycles, and collecting would walk all that is kept time and again.
        gc.disable()
        for batch in batches:
            rows = [scorer.top(list(words.values())) for words in telling.texts(list(batch))]
            x = np.array(rows).reshape(-1, 3) @ weights[:3] + weights[3]
            yield pd.Series(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    if keep is not None:
        return docs.where(score(F.coalesce(F.col(text_col), F.lit(""))) < threshold).select(*keep)
    scored = all_docs.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        score(F.coalesce("text", F.lit(""))).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
