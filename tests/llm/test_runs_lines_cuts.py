"""Periodic runs, line dedup and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runcourier.llm import line_dedup
from runcourier.llm.fill_in_middle import (
    RankIndex,
    boundaries,
    boundary_index,
    fill_in_middle,
    restored,
)
from runcourier.llm.line_dedup import keep_bitmaps, without_lines
from runcourier.llm.periodic_runs import find_runs, lyndon, periodic_runs
from tests.llm.cases import documents, no_documents, rows

TABLE = rows()
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(w, repeats, least):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_texts(rng):
    letters = rng.choice([1, 2, 2, 3, 5, 20])
    out = []
    for _ in range(rng.randrange(1, 6)):
        w = [rng.randrange(letters) for _ in range(rng.randrange(rng.choice([3, 12, 40])))]
        if rng.random() < 0.5:
            w += w[-3:] * rng.randrange(6) + [rng.randrange(letters) for _ in range(3)]
        out.append(w)
    return out


def test_lyndon_arrays_and_runs():
    rng = random.Random(8)
    for _ in range(600):
        texts = random_texts(rng)
        ends = np.cumsum([len(w) for w in texts])
        symbols = np.array([x for w in texts for x in w], dtype=np.int64)
        if len(symbols):
            length, group = lyndon(symbols, ends)
            assert length.tolist() == [x for w in texts for x in plain_lyndon(w)]
            # Groups are equal where the Lyndon prefixes are.
            start, names = 0, {}
            for t, w in enumerate(texts):
                for i in range(len(w)):
                    prefix = (t, tuple(w[i : i + length[start + i]]))
                    assert names.setdefault(prefix, group[start + i]) == group[start + i]
                start += len(w)
            assert len(set(names.values())) == len(names)
        repeats, least = rng.choice([2, 3, 4]), rng.choice([1, 6])
        want, start = [], 0
        for w in texts:
            want += [[s + start, n, q] for s, n, q in plain_runs(w, repeats, least)]
            start += len(w)
        assert find_runs(symbols, ends, repeats, least).tolist() == want


def test_runs_of_words_without_a_repeated_pair():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    want = plain_runs(b[:600], 2, 1)
    assert find_runs(np.array(b[:600]), np.array([600]), 2, 1).tolist() == [list(r) for r in want]
    same = np.zeros(50_000, np.int64)
    assert find_runs(same, np.array([50_000]), 4, 6).tolist() == [[0, 50_000, 1]]


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs(spark):
    extra = [
        (20, "a b " * 40 + "end"),
        (21, "x " + "one two three\n" * 9),
        (22, ("p q r s " * 3_000) + "tail"),  # very long
        (22, ("p q r s " * 3_000) + "tail"),
        (23, "go go go go go"),
        (24, "Go go " * 8),
    ]
    docs = documents(spark).select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string")
    )
    want = Counter()
    for doc_id, text in [r[:2] for r in TABLE] + extra:
        words = re.findall(f"[^{SPACE}]+", text or "")
        runs = plain_runs(words, 4, 6) if len(words) < 2_000 else None
        if runs is None:
            runs = [(0, 12_000, 4)] if "tail" in words else []
        want[(doc_id, len(words), tuple(runs), collapsed(words, runs))] += 1
    got = Counter(
        (r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed)
        for r in periodic_runs(docs).collect()
    )
    assert got == want
    clashing = documents(spark).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    assert periodic_runs(clashing).count() == len(TABLE)
    assert periodic_runs(no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, repeats=1)


# lines


def plain_lines(table, min_docs, min_chars=1):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    found = defaultdict(set)
    for doc_id, text in table:
        for line in (text or "").split("\n"):
            found[key(line)].add((doc_id, text or "") if doc_id is not None else text)
    gone = {k for k, d in found.items() if len(k) >= max(1, min_chars) and len(d) >= min_docs}
    out = Counter()
    for doc_id, text in table:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out[(doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def lined_rows():
    rng = random.Random(3)
    common = ["All rights reserved", "  menu | home ", "Ä Größe", "漢字", "|", "x" * 3_000]
    out = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(6)):
            kind = rng.random()
            if kind < 0.5:
                lines.append(rng.choice(common))
            elif kind < 0.6:
                lines.append(rng.choice(["", " \t", "\r"]))
            elif kind < 0.7:
                lines.append(rng.choice(common).upper() + "\x0b")
            else:
                lines.append(f"own line {rng.randrange(60)}")
        out.append((i if rng.random() < 0.9 else None, "\n".join(lines)))
    out += [(200, None), (200, ""), (201, "\n\n"), (202, "own line 1\n" * 5_000), out[0], out[1]]
    # One line in most of the documents.
    out += [(300 + i, f"Hot line\nrest {i}\nhot LINE ") for i in range(150)]
    return out


@pytest.mark.parametrize("min_docs", [2, 3, 10])
def test_shared_lines(spark, min_docs):
    table = lined_rows()
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    maps = keep_bitmaps(docs, min_docs=min_docs)
    got = Counter(tuple(r) for r in without_lines(docs, maps).collect())
    assert got == plain_lines(table, min_docs)
    for r in maps.collect():
        assert sum(k["count"] for k in r.keep) == r.n_lines - r.n_dropped
        ends = [k["first"] + k["count"] for k in r.keep]
        assert all(a < k["first"] for a, k in zip(ends, r.keep[1:]))


def test_dealt_and_whole_keys_agree(spark, monkeypatch):
    table = lined_rows()
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert line_dedup._hot(spark, docs.select(F.explode(F.split("text", "\n")).alias("l")).select(F.xxhash64("l").alias("h")), 4)
    monkeypatch.setattr(line_dedup, "_hot", lambda *_: [])
    whole = keep_bitmaps(docs, min_docs=3)
    got = Counter(tuple(r) for r in without_lines(docs, whole).collect())
    assert got == plain_lines(table, 3)
    # Dealt keys that are in too few documents stay.
    every = docs.select(F.explode(F.split("text", "\n")).alias("l")).select(
        F.xxhash64(line_dedup.line_key(F.col("l"))).alias("h")
    ).distinct().collect()
    monkeypatch.setattr(line_dedup, "_hot", lambda *_: [(r["h"], 3) for r in every])
    got = Counter(tuple(r) for r in without_lines(docs, keep_bitmaps(docs, min_docs=3)).collect())
    assert got == plain_lines(table, 3)


def test_lines_of_the_awkward_table(spark):
    table = [r[:2] for r in TABLE]
    docs = documents(spark)
    got = Counter(tuple(r) for r in without_lines(docs, keep_bitmaps(docs, min_docs=2, min_chars=5)).collect())
    assert got == plain_lines(table, 2, 5)
    empty = no_documents(spark)
    assert without_lines(empty, keep_bitmaps(empty)).count() == 0


# cuts


def test_learned_index_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(200):
        gaps = rng.integers(1, rng.choice([2, 5, 400]), rng.integers(0, 300))
        if rng.random() < 0.3:
            gaps[rng.random(len(gaps)) < 0.05] = 100_000
        offsets = np.concatenate([[0], np.cumsum(gaps)]).astype(np.int64)
        error = int(rng.choice([0, 1, 10, 100]))
        index = RankIndex.fit(offsets, error)
        assert index.offsets(np.arange(len(offsets))).tolist() == offsets.tolist()
        assert np.abs(index.residual.astype(int)).max() <= error + 1
        assert index.first[0] == 0 and (np.diff(index.first) > 0).all()
    even = RankIndex.fit(np.arange(0, 70_000, 7), 0)
    assert len(even.first) <= 2


def plain_cut(doc_id, text, seed=7):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, len(units), "plain", None, None, text
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if h4 % 100 < 50:
        return doc_id, len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def cut_rows():
    rng = random.Random(6)
    out = [r[:2] for r in TABLE] + [(50, "a<P>b\nc"), (51, "<S"), (52, "\n" * 500), (53, "<\n<\nP>\n"), (54, "S>\nM>")]
    for i in range(60, 160):
        lines = [rng.choice(["", "é" * rng.randrange(90), "line " * rng.randrange(30), "\r", "<M"]) for _ in range(rng.randrange(80))]
        out.append((i, "\n".join(lines)))
    out.append((160, "".join(rng.choice(["ä", "bcd", "\n", " "]) for _ in range(300_000))))  # very long
    return out


def test_fill_in_middle(spark):
    table = cut_rows()
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    made = fill_in_middle(docs)
    assert Counter(tuple(r) for r in made.collect()) == Counter(plain_cut(*r) for r in table)
    back = made.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in table)
    assert fill_in_middle(no_documents(spark)).count() == 0
    assert fill_in_middle(documents(spark).withColumn("form", F.lit(1))).count() == len(TABLE)
    none = fill_in_middle(docs, percent=0)
    assert none.where("form <> 'plain'").count() == 0
    few = fill_in_middle(docs, percent=30, spm_percent=100)
    assert 10 < few.where("form = 'spm'").count() < 70 and few.where("form = 'psm'").count() == 0


def test_cuts_between_characters(spark):
    table = cut_rows()
    docs = spark.createDataFrame(table, "doc_id long, text string")
    made = fill_in_middle(docs, unit="chars", marks=("[p]", "[s]", "[m]"), error=3)
    back = restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))
    got = made.select("doc_id", "n", back.alias("text")).collect()
    assert Counter((r.doc_id, r.n, r.text) for r in got) == Counter((i, len(t or ""), t or "") for i, t in table)
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="words")


def test_stored_index_gives_the_boundaries(spark):
    table = cut_rows()
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = boundary_index(docs, error=20).where("doc_id between 50 and 160").collect()
    want = {i: boundaries(np.frombuffer((t or "").encode(), np.uint8), "lines") for i, t in table}
    assert len(got) == 106
    for r in got:
        index = RankIndex(
            np.array([s["first"] for s in r.segments]),
            np.array([s["offset"] for s in r.segments]),
            np.array([s["slope"] for s in r.segments]),
            np.frombuffer(r.residuals, np.int16),
        )
        assert index.offsets(np.arange(r.n + 1)).tolist() == want[r.doc_id].tolist()
