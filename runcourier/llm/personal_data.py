"""Personal data by a skip-chain conditional random field.

Four patterns give the base spans: email, ip, card, phone. They are nodes of a random field, together
with other pieces of text that might be such data: numbers of at least seven digits and pieces with an
at sign or a spelled one. Each node has a label, one of the kinds or none. Its own potential comes from
its shape: how often shapes have which label by the patterns, counted over all documents. Nodes in
sight of each other are linked in a chain. Nodes with the same digits, or the same name before the at
sign, share a skip link however far apart: each to the one before and to the first of its group, so a
group of n has about 2 n links. Loopy message passing gives the beliefs, and what the patterns miss is
added where the belief in a kind is high. Base spans always stay.

Null and empty texts have no spans. Each row gets one result, whatever its id.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
# Texts without any of these hold neither base spans nor other nodes.
MAY_HOLD = r"[0-9@]|[(\[]at[)\]]"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9 ().+\-]{7,}+")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{2,}+")
_DIGIT = re.compile(r"[0-9]")


class Potentials(NamedTuple):
    skip: float = 4.0
    chain: float = 0.2
    sight: int = 40
    trust: float = 0.7
    belief: float = 0.7
    rounds: int = 15


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in order."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


class Node(NamedTuple):
    start: int
    end: int
    label: int  # by the patterns
    shape: str
    key: str


def _key(piece: str) -> str:
    if "@" in piece or "(at)" in piece or "[at]" in piece:
        name = re.split(r"@|\(at\)|\[at\]", piece)[0]
        return "@" + "".join(c for c in name.lower() if c.isalnum())
    digits = "".join(_DIGIT.findall(piece))
    return digits[-9:] if len(digits) >= 7 else ""


def _shape(piece: str) -> str:
    if "@" in piece or "(at)" in piece or "[at]" in piece:
        return "@" + "." * ("." in piece)
    signs = "".join(s for s in "+.-( " if s in piece)
    return f"{min(20, len(_DIGIT.findall(piece)))}{signs}"


def nodes(text: str) -> list[Node]:
    """Base spans and other candidates that overlap none of them, in order."""
    base = base_spans(text)
    found = [Node(s, e, k, _shape(text[s:e]), _key(text[s:e])) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    for pattern in (_NUMBER, _AT):
        extra = []
        for m in pattern.finditer(text):
            for s, e in _free(m.start(), m.end(), taken):
                if pattern is _NUMBER:
                    while s < e and text[s] not in "0123456789+(":
                        s += 1
                    while e > s and text[e - 1] not in "0123456789":
                        e -= 1
                    if len(_DIGIT.findall(text, s, e)) < 7:
                        continue
                elif (s, e) != m.span():
                    continue
                extra.append((s, e))
        found += [Node(s, e, NONE, _shape(text[s:e]), _key(text[s:e])) for s, e in extra]
        taken = sorted(taken + extra)
    return sorted(found)


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of a range outside of the taken ones, which are sorted by start."""
    from bisect import bisect_left

    i = bisect_left(taken, (start,))
    while i and taken[i - 1][1] > start:
        i -= 1
    while i < len(taken) and taken[i][0] < end:
        if taken[i][0] > start:
            yield start, taken[i][0]
        start = max(start, taken[i][1])
        i += 1
    if start < end:
        yield start, end


def links(field: list[Node], own: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of node numbers and the strength of each link."""
    pairs, strength = [], []
    for i in range(1, len(field)):
        if field[i].start - field[i - 1].end <= own.sight:
            pairs.append((i - 1, i))
            strength.append(own.chain)
    groups: dict[str, list[int]] = {}
    for i, node in enumerate(field):
        if node.key:
            groups.setdefault(node.key, []).append(i)
    for group in groups.values():
        for j in range(1, len(group)):
            for k in {group[j - 1], group[0]}:
                pairs.append((k, group[j]))
                strength.append(own.skip)
    return np.array(pairs, dtype=np.int64).reshape(-1, 2), np.array(strength)


def beliefs(unary: np.ndarray, pairs: np.ndarray, strength: np.ndarray, rounds: int) -> np.ndarray:
    """Marginals by loopy sum-product in logs; equal labels gain a link's strength."""
    if not len(pairs):
        total = unary
    else:
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        gain = np.concatenate([strength, strength])[:, None]
        back = np.roll(np.arange(len(source)), len(pairs))
        messages = np.zeros((len(source), unary.shape[1]))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, messages)
            out = total[source] - messages[back]
            whole = np.logaddexp.reduce(out, axis=1, keepdims=True)
            new = np.logaddexp(whole, out + np.log(np.expm1(gain)))
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - messages).max() < 1e-4:
                messages = new
                break
            messages = 0.5 * messages + 0.5 * new
        total = unary.copy()
        np.add.at(total, target, messages)
    return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))


class Field:
    """Finds all spans of a text, given how often shapes have which label."""

    def __init__(self, counts: dict[str, list[int]], own: Potentials):
        self.counts, self.own = counts, own

    def unary(self, node: Node) -> np.ndarray:
        if node.label != NONE:
            p = np.full(NONE + 1, 0.005)
            p[node.label] = 0.98
        else:
            n = np.array(self.counts.get(node.shape, [0] * (NONE + 1)), dtype=float) + 0.5
            p = self.own.trust * n / n.sum() + (1 - self.own.trust) / (NONE + 1)
        return np.log(p)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans."""
        field = nodes(text)
        base = [(n.start, n.label, n.end) for n in field if n.label != NONE]
        if len(base) == len(field):
            return base, base
        marginals = beliefs(
            np.array([self.unary(n) for n in field]), *links(field, self.own), self.own.rounds
        )
        added = [
            (n.start, int(b.argmax()), n.end)
            for n, b in zip(field, marginals)
            if n.label == NONE and b.argmax() != NONE and b.max() >= self.own.belief
        ]
        return base, sorted(base + added)


def shape_counts(docs: DataFrame, text_col: str) -> dict[str, list[int]]:
    """Labels by shape over all documents. There are at most 21 * 2^5 + 2 shapes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                total.update((n.shape, n.label) for n in nodes(text))
        if total:
            yield pd.DataFrame([(s, k, n) for (s, k), n in total.items()], columns=["shape", "label", "n"])

    counted = (
        docs.select(F.col(text_col).alias("text"))
        .where(F.col("text").rlike(MAY_HOLD))
        .mapInPandas(count, "shape string, label int, n long")
        .groupBy("shape", "label")
        .agg(F.sum("n").alias("n"))
    )
    out: dict[str, list[int]] = {}
    for shape, label, n in counted.collect():
        out.setdefault(shape, [0] * (NONE + 1))[label] = n
    return out


def _suspects(text: str) -> Column:
    return F.when(F.col(text).rlike(MAY_HOLD), F.col(text))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    potentials: Potentials = Potentials(),
) -> DataFrame:
    """One row per document: base spans by kind and their digest, and all spans."""
    small_batches(docs.sparkSession)
    counts = shape_counts(docs, text_col)

    schema = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"

    @F.pandas_udf(schema)
    def find(texts: pd.Series) -> pd.DataFrame:
        field = Field(counts, potentials)
        rows = []
        for text in texts:
            base, every = field.spans(text) if text else ([], [])
            kinds = Counter(k for _, k, _ in base)
            rows.append((*(kinds[k] for k in range(NONE)), _joined(base), _joined(every)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    found = docs.select(F.col(id_col).alias("doc_id"), find(_suspects(text_col)).alias("f"))
    return found.select(
        "doc_id",
        *(F.col(f"f.n_{k}").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.col("f.base").cast("binary"), 256).alias("base_sha256"),
        F.col("f.spans").alias("spans"),
    )


def masked(
    docs: DataFrame, text_col: str = "text", potentials: Potentials = Potentials()
) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; other columns stay."""
    small_batches(docs.sparkSession)
    counts = shape_counts(docs, text_col)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        field = Field(counts, potentials)
        out = []
        for text in texts:
            if text:
                parts, last = [], 0
                for s, k, e in field.spans(text)[1]:
                    if e > last:
                        parts += [text[last : max(s, last)], f"<{KINDS[k]}>"]
                        last = e
                text = "".join(parts) + text[last:]
            out.append(text)
        return pd.Series(out, dtype=object)

    clean = F.coalesce(mask(_suspects(text_col)), F.col(text_col))
    return docs.withColumn(text_col, clean)
