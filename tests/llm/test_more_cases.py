"""Further cases of earlier operators: plain searches, clashing columns, rows without an id."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runcourier.llm import toxicity as T
from runcourier.llm.common import row_key, without_nodes
from runcourier.llm.decontamination import contaminated
from runcourier.llm.mixing import mix_sources
from runcourier.llm.personal_data import personal_data
from tests.llm.cases import documents, rows, words

TABLE = rows()


def reader(vocabulary):
    counts = np.zeros(28**3, dtype=np.int64)
    for word in vocabulary:
        code = [0, *(ord(c) - 96 for c in word), 0]
        for a, b, c in zip([0, *code], code, code[1:]):
            counts[(a * 28 + b) * 28 + c] += 1
    return T.Reader(T.letter_model(counts))


VOCABULARY = "idiot stupid trash loser moron pathetic stone river ladder letter better summer all".split() * 40


def test_doubled_letters_against_all_ways():
    own = reader(VOCABULARY)
    assert "stupid" in own.read("stuupid") and "idiot" in own.read("iddiot") and "moron" in own.read("Moroon,")
    assert own.read("summer") == ("summer",) and own.read("letter") == ("letter",)
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aeilmnorst") for _ in range(rng.randint(1, 7)))
        for i in sorted(rng.sample(range(len(word)), min(len(word), rng.randint(0, 3))), reverse=True):
            word = word[: i + 1] + word[i] + word[i + 1 :]
        if T._RUN.search(word):
            continue
        pairs = [i for i in range(1, len(word)) if word[i] == word[i - 1]]
        best = None
        for gone in itertools.product([False, True], repeat=len(pairs)):
            dropped = {i for i, g in zip(pairs, gone) if g}
            kept = [c for i, c in enumerate(word) if i not in dropped]
            code = [0, 0, *(ord(c) - 96 for c in kept), 0]
            score = sum(own.model[a][b][c] for a, b, c in zip(code, code[1:], code[2:]))
            score += sum(T.TWICE if g else T.MEANT for g in gone)
            if best is None or score > best[0] + 1e-9:
                best = (score, "".join(kept))
        assert own.undoubled(word) == best[1], word


def test_kinds_of_pieces_and_tables_that_start_anew():
    own = reader(VOCABULARY)
    tokens = "i d i o t stone tr a sh ( of the river .".split()
    first = own.runs(tokens)
    assert "i d i o t" in first and first == own.runs(tokens)
    kept = T.Kept(lambda k: k * 2, most=3)
    assert [kept[k] for k in ("a", "b", "c", "d", "a", "x" * 70)] == ["aa", "bb", "cc", "dd", "aa", "x" * 140]
    assert len(kept) <= 3 and "x" * 70 not in kept


def test_words_as_arrays_and_token_by_token():
    own = reader(VOCABULARY)
    rng = random.Random(21)
    parts = VOCABULARY[:13] + [
        "Idiot,", "(trash)", "i", "d", "1d10t", "stuupid", "LOSER!", "éÉ", "Größe", "ÀÉ.", "×", "÷a", "caféé", "aaa", "ab",
        "of", "the", "漢字", "a\xa0b", "\u2028", "\x1c", "x.y", "'s", "$$$", "tr@sh", "ñandú", "Ÿ", "ß", "İx", "ΑΣ", "letterr",
    ]
    beginnings = {b for w in VOCABULARY[:13] + ["größe", "caféé", "ñandú", "éé", "of"] for b in T.beginnings(w)}
    entries = {b: (rng.randint(2, 9), rng.randint(0, 3)) for b in sorted(beginnings)}
    scorer = T.Scorer(entries, 0.3)
    texts = [rng.choice([" ", "\n", " \t"]).join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    telling = T.Telling(own, scorer)
    fast = telling.texts(texts)
    for text, words_ in zip(texts, fast):
        plain = {w: scorer.word(w) for w in own.text(text.lower())}
        assert scorer.top(list(words_.values())) == scorer.top(list(plain.values())), text
        assert all(plain[w] == s for w, s in words_.items())
    assert telling.texts([]) == [] and telling.texts(["", " "]) == [{}, {}]


def plain_words(text):
    text = re.sub(r"[!-/:-@\[-`{-~]", "", (text or "").lower())
    return text.split()


def plain_found(doc, item, window=13, percent=80):
    size = min(window, len(item))
    for shift in range(-len(item), len(doc) + 1):
        same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
        inside = [0 <= i + shift < len(doc) for i in range(len(item))]
        for i in range(len(item) - size + 1):
            if all(inside[i : i + size]) and 100 * sum(same[i : i + size]) >= percent * size:
                return True
    return False


def test_every_item_over_every_document(spark):
    rng = random.Random(8)
    items = [(i, words(rng.choice([3, 5, 7, 12, 13, 20, 40]), 700 + i)) for i in range(14)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        text = words(rng.randint(0, 30), i).split()
        if i % 2:
            part = rng.choice(items[:14])[1].split()
            for _ in range(rng.randint(0, max(1, len(part) // 4))):
                part[rng.randrange(len(part))] = f"other{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                part = part[: len(part) * 2 // 3]
            text[3:3] = part
        docs.append((i, " ".join(text).capitalize()))
    docs += [(None, docs[1][1]), (61, None), (62, ""), docs[3]]
    got = contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    want = {
        (d, i)
        for d, text in docs
        for i, item in items
        if len(plain_words(item)) >= 5 and plain_found(plain_words(text), plain_words(item))
    }
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(want) > 15


def test_a_column_named_like_the_key_stays(spark):
    docs = documents(spark).withColumn("_node", F.lit("mine"))
    found = docs.where("doc_id = 2").select(row_key("doc_id", "text").alias("node")).distinct()
    left = without_nodes(docs, found)
    assert left.columns == docs.columns
    want = Counter((*r, "mine") for r in TABLE if r[0] != 2)
    assert Counter(tuple(r) for r in left.collect()) == want


def test_stages_keep_all_columns(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(
        f"{sf}/labels.parquet"
    )
    spark.createDataFrame([(1, words(25, 900))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        skip = {"text", "n_chars"} if name == "personal data" else set()
        columns = [c for c in docs.columns if c not in skip]
        before = Counter(tuple(r) for r in docs.select(columns).collect())
        after = Counter(tuple(r) for r in out.select(columns).collect())
        assert after <= before and after, name
        assert (after == before) == (name == "personal data") or name in ("toxicity", "decontamination"), name
        folder = f"{sf}/{name.replace(' ', '-')}"
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)


@pytest.mark.parametrize("copies", [1, 400])
def test_rows_without_an_id_draw_by_themselves(spark, copies):
    own = [(None, words(20, i), "big") for i in range(400 // copies)] * copies
    table = own + [(i, words(20, 5_000 + i), "big") for i in range(400)] + [(1_000 + i, words(3, i), "small") for i in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    mixed = mix_sources(docs, weights=(5.0, 1.0)).cache()
    got = mixed.collect()
    assert len(got) == len(table)
    taken, sizes, targets = Counter(), Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        targets[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - targets[s]) <= 21 for s in sizes)
    assert sizes == Counter({"big": 16_000, "small": 120})
    # Those without an id are in and out like the others.
    part = mix_sources(docs.withColumn("source", F.when(F.col("doc_id") < 200, "z").otherwise(F.col("source"))), weights=(1.0, 1.0, 9.0))
    times = Counter(r.taken // r.size for r in part.where("doc_id is null").collect())
    assert len(times) > 1
    again = mix_sources(docs.repartition(7), weights=(5.0, 1.0))
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r) for r in got)


def test_long_mail_names(spark):
    name = "a" * 90 + ".b"
    text = f"write {name} (at) mail.example.com or c@d.org"
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    for r in personal_data(docs).collect():
        for span in r.spans.split(","):
            kind, start, end = span.split(":")
            assert int(start) == 0 or not re.match(r"[A-Za-z0-9._%+-]", text[int(start) - 1])
