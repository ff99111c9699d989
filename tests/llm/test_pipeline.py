"""The pipeline against plain versions of its stages."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import words
from tests.llm.test_operators import plain_duplicates

RNG = random.Random(31)
BENCHMARK = [(i, words(25, 900 + i)) for i in range(4)]


def corpus():
    """Rows (doc_id, text, lang, source, n_chars), and the ids with a toxic word."""
    rows, toxic = [], set()
    for i in range(300):
        text = words(RNG.randint(30, 60), 1000 + i).split()
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(2):
                text.insert(RNG.randint(0, 30), "idiot")
        elif i % 10 == 1:
            text[5:5] = BENCHMARK[i % 4][1].split()
        elif i % 10 == 3 and i > 10:
            text = [w for w in rows[i - 2][1].split()]
            text[-1] = "changed"
        elif i % 10 == 7:
            text += ["bob@mail.example.com", "10.0.0.1"]
        text = " ".join(text)
        rows.append((i, text, "en", "ab"[i % 3 == 0], len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, rows[2][1], "en", "b", 1)]
    return rows, toxic


def test_stages_and_result(spark, tmp_path):
    rows, toxic = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    marks = [(r[0], 1, int(r[0] in toxic)) for r in rows[:280]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    left = [r for r in rows if r[0] not in toxic]
    group = {k[0]: k[2] for k in plain_duplicates(left, 5, 80)}
    left = [r for r in left if group[r[0]] == r[0]]
    items = [b for _, b in BENCHMARK]
    left = [r for r in left if not any(b in (r[1] or "") for b in items)]
    hidden = {
        r[0]: re.sub(r"\b10\.0\.0\.1\b", "<ip>", (r[1] or "").replace("bob@mail.example.com", "<email>"))
        for r in left
    }

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = f"{sf}/stage{n}"
        made = stage(spark, docs, sf)
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        made.write.parquet(out)
        docs = spark.read.parquet(out)
    kept = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text or "" for i, r in kept.items()} == hidden
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept.values())

    result = corpus_pipeline.run(spark, sf)
    got = {r.doc_id: r for r in result.collect()}
    assert {i: r.size for i, r in got.items()} == {i: len(t.split()) for i, t in hidden.items()}
    by_source = result.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size")
    )
    for r in by_source.collect():
        assert abs(r.taken - r.target) <= r.size / 2 + 1


def test_rows_without_an_id_are_judged_by_their_text(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    clean = [words(40, 2000 + i) for i in range(6)]
    near = clean[0].rsplit(" ", 1)[0] + " changed"
    texts = [*clean, near, clean[1], clean[1].upper(), clean[2], "", "", None]
    rows = [(None, t, "en", "a", 1) for t in texts] + [(5, clean[2], "en", "b", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)

    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    got = kept.collect()
    mine = [r.text.lower() for r in got if r.text and r.doc_id is None]
    assert sum(t in (clean[0], near) for t in mine) == 1 and mine.count(clean[1]) == 1
    assert [r.doc_id for r in got if r.text == clean[2]] == [5]
    assert sorted(t for t in mine if t in clean[3:]) == sorted(clean[3:]) and len(mine) == 5
    assert sum(not r.text for r in got) == 3

    dirty = clean[0] + " " + BENCHMARK[0][1]
    more = docs.unionByName(spark.createDataFrame([(None, dirty, "en", "a", 1), (9, dirty, "en", "a", 1)], schema))
    left = corpus_pipeline.drop_contaminated(spark, more, sf)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, docs.collect()))


def test_pipeline_of_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    for name, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"),
        ("benchmark", "item_id long, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{sf}/{name}.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
