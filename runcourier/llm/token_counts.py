"""Token counts through a finite-state transducer compiled from the tokenizer.

The merges of a BPE tokenizer decide, for every prefix of a text, which token ends it: the longest
piece that fits behind the last token of the prefix before it, where two tokens fit if merging their
joined text gives the two again. So a left-to-right machine can count tokens. Its states hold the
pieces that are still open, the token before each of them, and how many tokens fewer that prefix had;
a transition carries the number of tokens it adds (below 0 when characters merge). States are made
as texts need them, as in a lazily determinised automaton, and the number kept is bounded.

A chunk of text is a map from the state before it to the state behind it and the tokens emitted.
Maps compose, and the composition is associative, so the maps of the chunks of a text are combined by
a prefix scan. Most chunks are words between two points where the state is always the start state;
their maps are kept by text. Longer unbroken runs are cut at a fixed length.

Null texts are empty and have 0 tokens. Each row gets one result; repeated rows are counted alike.
Special strings in a text are plain text. Supported: sentencepiece BPE models without normalisation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import small_batches

MARK = "▁"
START = 0
STATES_KEPT = 200_000
WORDS_KEPT = 800_000
FITS_KEPT = 800_000
CHUNK = 256
FEW = 12

StateMap = dict[int, tuple[int, int]]


def compose(first: StateMap, then: StateMap) -> StateMap:
    """The map of two chunks in a row."""
    return {a: (then[b][0], n + then[b][1]) for a, (b, n) in first.items()}


class Transducer:
    def __init__(self, scores: dict[str, float]):
        """``scores``: the pieces that merges can make, the best score merges first."""
        self.scores = scores
        self.edges: dict[str, tuple | None] = {}
        self.fit: dict[tuple[str, str], bool] = {}
        self.children: list[dict[str, int]] = [{}]  # a tree of all pieces; node 0 is its root
        self.piece = [""]
        self.below: list[list[str]] = [[]]  # longer pieces that begin with the node's, if few
        for piece in scores:
            if self.is_token(piece):
                self.add(piece)
        self.reset()

    def add(self, piece: str) -> None:
        node = 0
        for char in piece:
            if node and len(self.below[node]) <= FEW:
                self.below[node].append(piece)
            if char not in self.children[node]:
                self.children[node][char] = len(self.children)
                self.children.append({})
                self.piece.append("")
                self.below.append([])
            node = self.children[node][char]
        self.piece[node] = piece

    def reset(self) -> None:
        self.states: list[tuple] = [((), "")]
        self.numbers: dict[tuple, int] = {self.states[0]: START}
        self.step: list[dict[str, tuple[int, int]]] = [{}]
        self.open: list[tuple[int, str]] = []
        self.open_numbers: dict[tuple[int, str], int] = {}
        self.open_step: list[dict[str, tuple[int, str] | None]] = []

    def merge(self, text: str) -> list[str]:
        """Tokens of a short text by the merges themselves."""
        return self.merged(text)[0]

    def merged(self, text: str) -> tuple[list[str], list[str], list[str]]:
        """Tokens of a short text, and what stood at its left and right edge one after another."""
        parts = list(text)
        left, right = parts[:1], parts[-1:]
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            if parts[0] != left[-1]:
                left.append(parts[0])
            if parts[-1] != right[-1]:
                right.append(parts[-1])
        return parts, left, right

    def is_token(self, piece: str) -> bool:
        """Whether merging the text of the piece gives the piece."""
        if piece not in self.scores:
            return False
        if piece not in self.edges:
            parts, left, right = self.merged(piece)
            falling = all(
                self.scores[a] > self.scores[b]
                for side in (left[1:], right[1:])
                for a, b in zip(side, side[1:])
            )
            worst = float("-inf")
            edge = lambda side: [(p, self.scores[p]) for p in side[1:]] + [("", worst)]
            self.edges[piece] = (
                (left[0], edge(left), right[0], edge(right), falling) if parts == [piece] else None
            )
        return self.edges[piece] is not None

    def fits(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two tokens.

        While both tokens grow from their characters, the pieces at the border could merge; they do
        if that merge comes before the next one of either. The left one of equal merges comes first.
        """
        key = (left, right)
        known = self.fit.get(key)
        if known is not None:
            return known
        if len(self.fit) > FITS_KEPT:
            self.fit.clear()
        _, _, a, grow_a, ordered_a = self.edges[left]
        b, grow_b, _, _, ordered_b = self.edges[right]
        if not (ordered_a and ordered_b):
            self.fit[key] = result = self.merge(left + right) == [left, right]
            return result
        i = j = 0
        result = True
        while True:
            (next_a, score_a), (next_b, score_b) = grow_a[i], grow_b[j]
            across = self.scores.get(a + b)
            if across is not None and across > score_a and across >= score_b:
                result = False
                break
            if not next_a and not next_b:
                break
            if score_a >= score_b:
                a, i = next_a, i + 1
            else:
                b, j = next_b, j + 1
        self.fit[key] = result
        return result

    def opened(self, node: int, before: str) -> int:
        """Number of the open piece at a node behind a token, -1 if no longer piece can come."""
        if not self.children[node]:
            return -1
        longer = self.below[node]
        if before and node and len(longer) <= FEW:
            fitting = [p for p in longer if self.fits(before, p)]
            if not fitting:
                return -1
            if len(fitting) == len(longer):
                before = ""  # whatever the token, all can come
        key = (node, before)
        number = self.open_numbers.get(key)
        if number is None:
            number = self.open_numbers[key] = len(self.open)
            self.open.append(key)
            self.open_step.append({})
        return number

    def grow(self, number: int, char: str) -> tuple[int, str] | None:
        """An open piece one character on: its number, and the piece if it is one that fits."""
        node, before = self.open[number]
        child = self.children[node].get(char)
        result = None
        if child is not None:
            piece = self.piece[child]
            if piece and before and not self.fits(before, piece):
                piece = ""
            result = (self.opened(child, before), piece)
        self.open_step[number][char] = result
        return result

    def follow(self, state: int, char: str) -> tuple[int, int]:
        """The transition of a state, made when a text first needs it.

        A state has its open pieces, longest first, each with the tokens since then, and the last
        token.
        """
        if char not in self.scores:  # its bytes are tokens, and nothing merges across it
            result = (START, len(char.encode("utf-8", "surrogatepass")))
            self.step[state][char] = result
            return result
        live, last = self.states[state]
        token, added, grown = "", 1, []
        for number, gap in (*live, (self.opened(0, last), 0)):
            steps = self.open_step[number]
            there = steps[char] if char in steps else self.grow(number, char)
            if there:
                if there[1] and not token:
                    token, added = there[1], 1 - gap
                if there[0] >= 0:
                    grown.append((there[0], gap))
        key = (tuple((n, gap + added) for n, gap in grown), token)
        known = self.numbers.get(key)
        if known is None:
            known = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        result = (known, added)
        self.step[state][char] = result
        return result

    def run(self, text: str, state: int = START) -> tuple[int, int]:
        """State behind a text and the tokens emitted."""
        total, step = 0, self.step
        for char in text:
            there = step[state].get(char) or self.follow(state, char)
            state = there[0]
            total += there[1]
        return state, total

    def scan(self, chunks: list[str]) -> list[StateMap]:
        """Maps of the prefixes of a row of chunks, from the start state."""
        out: list[StateMap] = []
        so_far: StateMap = {START: (START, 0)}
        for chunk in chunks:
            own = {state: self.run(chunk, state) for state, _ in so_far.values()}
            so_far = compose(so_far, own)
            out.append(so_far)
        return out

    def count(self, text: str) -> int:
        """Tokens of one unbroken run, in chunks of a fixed length."""
        if len(self.states) > STATES_KEPT:
            self.reset()
        if len(text) <= CHUNK:
            return self.run(text)[1]
        chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
        return self.scan(chunks)[-1][START][1]


class Words(dict):
    """Emitted tokens of the chunks met so far, by text."""

    def __init__(self, machine: Transducer, mark: str):
        self.machine, self.mark = machine, mark

    def __missing__(self, word: str) -> int:
        n = self.machine.count(self.mark + word)
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("a  b ", out_type=str) == model.encode("a b", out_type=str) or (
            model.encode("Ａ", out_type=str) == model.encode("A", out_type=str)
        ):
            raise ValueError("models that normalise texts are not supported")
        ids = range(model.vocab_size())
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ids if not special(i)}
        if any(MARK in p.lstrip(MARK) for p in pieces) or not any(model.is_byte(i) for i in ids):
            raise ValueError("only pieces with leading marks and byte fallback are supported")
        self.machine = Transducer(pieces)
        self.words = Words(self.machine, MARK)
        self.runs = Words(self.machine, "")

    def count(self, text: str) -> int:
        if not text:
            return 0
        if text[0] != " " and "  " not in text and MARK not in text:
            return sum(map(self.words.__getitem__, text.split(" ")))
        marked = MARK + text.replace(" ", MARK)
        chunks = re.findall(f"{MARK}+[^{MARK}]*", marked)
        return sum(map(self.runs.__getitem__, chunks))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    ``path`` names the tokenizer file, which every worker must have.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(path)
        for batch in batches:
            yield pd.Series([of.count(t) if t else 0 for t in batch], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        n_tokens(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
