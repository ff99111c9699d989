"""Language identification by a string kernel.

A part of a text is the set of its character n-grams of 1 to 4 letters, hashed to ``BINS`` bins; only
presence counts. The kernel of two parts is the number of bins they share, over the root of the product
of their sizes (a blended-spectrum presence kernel); that of a text is the mean over all its parts, so
a long text doesn't fill the bins. A bounded number of landmarks, the fullest parts of learned texts,
spans the Nystrom space, and one-versus-rest kernel ridge regression in it gives each language a value.
Parts are scored in batches: presence matrix by landmark matrix, then by the weights of the languages.

Learning uses at most ``sample`` documents per language, by a hash of the id, of those whose
crc32(doc_id as text) mod 4 is not 2 and whose language isn't null. Documents without an id aren't
learned from and not held out (null). Rows with one id are predicted each by its text.
Null texts and texts without a letter are `und`, with score 0; so is everything if nothing was learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runcourier.llm.common import remainder, small_batches
from runcourier.session import cut

BITS = 14
BINS = 1 << BITS
LONGEST = 4
# Bounds of what is learned from: documents and landmarks per language.
SAMPLE, LANDMARKS = 300, 32
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64) * np.uint64(
    0x9E3779B97F4A7C15
)
_ROWS = 128
# Signs of a part: about half of the bins are set at most, however long a text is.
PART = 2048


def parts(text: str) -> Iterator[str]:
    """Equal parts of at most ``PART`` signs, each longer by what an n-gram needs to cross over."""
    n = max(1, -(-len(text) // PART))
    size = -(-len(text) // n) if text else 1
    for i in range(0, max(1, len(text)), size):
        yield text[i : i + size + LONGEST - 1]


def presence(part: str, out: np.ndarray) -> None:
    """Set the bins of a part's n-grams in a row of the presence matrix."""
    codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(len(codes), dtype=np.uint64)
    for n in range(min(LONGEST, len(codes))):
        total = total[: len(codes) - n] + (codes[n:] + np.uint64(1)) * _FACTORS[n]
        mixed = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        out[mixed >> np.uint64(64 - BITS)] = 1


def kernels(texts: list[str], landmarks: np.ndarray) -> np.ndarray:
    """For each text, the kernel values of its parts with the landmarks (columns), on average."""
    total, count = np.zeros((len(texts), landmarks.shape[1])), np.zeros(len(texts))
    every = ((i, part) for i, text in enumerate(texts) for part in parts(text))
    while batch := list(islice(every, _ROWS)):
        rows = np.zeros((len(batch), BINS), dtype=np.float32)
        for row, (_, part) in zip(rows, batch):
            presence(part, row)
        rows /= np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        owner = np.array([i for i, _ in batch])
        np.add.at(total, owner, rows @ landmarks)
        np.add.at(count, owner, 1)
    return total / np.maximum(count, 1)[:, None]


def fullest(text: str) -> np.ndarray:
    """The presence row of the part with most n-grams."""
    best = np.zeros(BINS, dtype=np.uint8)
    for part in parts(text):
        row = np.zeros(BINS, dtype=np.uint8)
        presence(part, row)
        if row.sum(dtype=np.int64) > best.sum(dtype=np.int64):
            best = row
    return best


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    def __init__(self, landmarks: np.ndarray, kernel: np.ndarray, names: list[str], ridge: float):
        """``landmarks``: normed presence rows as columns, ``kernel``: the values of the learned texts
        with them, ``names``: the languages of these."""
        self.names = sorted(set(names))
        self.landmarks = landmarks
        among = landmarks.T @ landmarks
        values, vectors = np.linalg.eigh(among.astype(np.float64))
        good = values > 1e-6 * values.max()
        space = vectors[:, good] / np.sqrt(values[good])
        x = kernel @ space
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.array([[1.0 if n == name else -1.0 for name in self.names] for n in names])
        solved = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
        self.weights, self.constant = space @ solved[:-1], solved[-1]

    def values(self, texts: list[str]) -> np.ndarray:
        """For each text, a share for each language; shares add up to 1."""
        margins = 4.0 * (kernels(texts, self.landmarks) @ self.weights + self.constant)
        margins -= margins.max(axis=1, keepdims=True)
        shares = np.exp(margins)
        return shares / shares.sum(axis=1, keepdims=True)


def _learned(docs: DataFrame, sample: int) -> DataFrame:
    """Rows (lang, text) to learn from."""
    usable = docs.where(
        F.col("doc_id").isNotNull()
        & (remainder("doc_id", 4) != 2)
        & F.col("lang").isNotNull()
        & (F.length("text") > 0)
    )
    counts = usable.groupBy("lang").agg(F.count("*").alias("_n")).collect()  # a row per language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.lit(0.0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * sample / n))).otherwise(share)
    # About twice the sample of each language; repeated ids make no more rows than the limit.
    return (
        usable.where(place < share)
        .select("lang", "text", place.alias("_place"), F.xxhash64("text").alias("_tie"))
        .orderBy("_place", "_tie")
        .limit(3 * sample * max(1, len(counts)))
    )


def languages(
    docs: DataFrame,
    sample: int = SAMPLE,
    landmarks: int = LANDMARKS,
    ridge: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: held_out, the predicted language, and its share of the values."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )

    learned = cut(_learned(docs, sample))

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(fullest(t)).tobytes() if has_letter(t) else None for t in texts], dtype=object)

    def first(column: str, most: int) -> tuple[list[str], list[bytes]]:
        """Of each language the first ones by place: their languages, and the column."""
        taken: dict[str, list[bytes]] = {}
        for r in sorted(found, key=lambda r: (r["_place"], r[column])):
            if len(taken.setdefault(r["lang"], [])) < most:
                taken[r["lang"]].append(r[column])
        return [lang for lang in taken for _ in taken[lang]], [x for lang in taken for x in taken[lang]]

    # 2 KB for each learned document, then a number for each landmark.
    found = learned.select("lang", "_place", bits("text").alias("bits")).where("bits is not null").collect()
    model = None
    if found:
        chosen = np.array([np.unpackbits(np.frombuffer(x, np.uint8)) for x in first("bits", landmarks)[1]])
        columns = chosen.T / np.sqrt(chosen.sum(axis=1, dtype=np.float32))
        known = spark.sparkContext.broadcast(np.ascontiguousarray(columns, dtype=np.float32))

        @F.pandas_udf("binary")
        def kernel(texts: pd.Series) -> pd.Series:
            return pd.Series(
                [kernels([t], known.value).tobytes() if has_letter(t) else None for t in texts], dtype=object
            )

        found = learned.select("lang", "_place", kernel("text").alias("k")).where("k is not null").collect()
        names, rows = first("k", sample)
        model = Model(known.value, np.array([np.frombuffer(x) for x in rows]), names, ridge)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = list(batch)
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for j, row in zip(known, model.values([texts[j] for j in known]) if known else ()):
                pred[j], score[j] = model.names[int(row.argmax())], row.max()
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    out = docs.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), predict("text").alias("p")
    )
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
