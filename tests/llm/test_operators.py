"""Every operator on the same awkward table and on an empty one, against plain versions."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from runcourier.llm import language, repeats
from runcourier.llm import personal_data as pd_
from runcourier.llm import toxicity as toxicity_
from runcourier.llm.components import components
from runcourier.llm.decontamination import clean_documents, contaminated
from runcourier.llm.language import languages
from runcourier.llm.mixing import mix_sources
from runcourier.llm.near_duplicates import near_duplicates
from runcourier.llm.neighbours import nearest
from runcourier.llm.repeats import removed
from runcourier.llm.token_counts import counter, token_counts
from runcourier.llm.toxicity import Reader, letter_model, toxicity
from tests.llm.cases import documents, no_documents, rows, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TABLE = rows()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def as_counter(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# token counts


def test_tokens_like_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter()
    for doc_id, text, *_ in TABLE:
        n = len(library.encode(text or ""))
        want[(doc_id, len((text or "").encode()), n, n > 4096)] += 1
    got = as_counter(token_counts(documents(spark), PIECES), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == want
    assert token_counts(no_documents(spark), PIECES).count() == 0


def test_transducer_on_random_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    parts = ["a", "the", "ing", "th", " ", "  ", "    ", "▁", "\n", "é", "日", "<s>", "1", "==", "-", "\x00", "Z", "aaaa"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert counter(PIECES).count(text) == len(library.encode(text)), repr(text)


def test_chunk_maps_compose():
    machine = counter(PIECES).machine
    text = "".join(random.Random(5).choice("abcdeinorst=-") for _ in range(3000))
    whole = machine.run(text)
    for size in (1, 7, 256):
        chunks = [text[i : i + size] for i in range(0, len(text), size)]
        assert machine.scan(chunks)[-1][0] == whole


# mixing


def test_mix(spark):
    got = mix_sources(documents(spark)).collect()
    assert len(got) == len(TABLE)
    sizes = Counter()
    for _, text, _, source, *_ in TABLE:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    total = sum(sizes.values())
    weights = {"a": 5.0, "b": 2.0, None: 1.0}
    goal, left, open_ = {}, float(total), dict(weights)
    while True:
        share = left / sum(open_.values())
        above = [s for s, w in open_.items() if share * w > 3 * sizes[s]]
        if not above:
            goal |= {s: share * w for s, w in open_.items()}
            break
        for s in above:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
            del open_[s]
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - goal[s]) <= largest / 2 + 1 for s in sizes)
    again = mix_sources(documents(spark).repartition(5))
    assert as_counter(again, *again.columns) == Counter(tuple(r) for r in got)
    assert mix_sources(no_documents(spark)).count() == 0


# toxicity


def test_hidden_words_are_restored():
    counts = np.zeros(28**3, dtype=np.int64)
    for word in ["idiot", "stupid", "trash", "loser", "moron", "pathetic", "stone", "river", "the", "of"] * 50:
        code = [0, *(ord(c) - 96 for c in word), 0]
        for a, b, c in zip([0, *code], code, code[1:]):
            counts[(a * 28 + b) * 28 + c] += 1
    reader = Reader(letter_model(counts))
    for hidden, word in [
        ("1d10t", "idiot"), ("st00pid", None), ("tr@sh!", "trash"), ("l0s3r", "loser"), ("i.d.i.o.t", "idiot"),
        ("stuuuupid", "stupid"), ("M0R0N", "moron"), ("p4th3t1c", "pathetic"), ("river", "river"),
    ]:
        assert word is None or word in reader.words(hidden), hidden
    assert "idiot" in reader.text("you i d i o t there")


def spelling_reader():
    counts = np.zeros(28**3, dtype=np.int64)
    text = "idiot trash you are there an of the stone river " * 50
    code = [0, *(0 if c == " " else ord(c) - 96 for c in text), 0]
    for a, b, c in zip(code, code[1:], code[2:]):
        counts[(a * 28 + b) * 28 + c] += 1
    return Reader(letter_model(counts))


@pytest.mark.parametrize(
    "hidden, word",
    [
        ("t r @ s h", "trash"), ("1 d ! 0 t", "idiot"), ("id iot", "idiot"), ("(i d i o t)", "idiot"),
        ("i d i o t.", "idiot"), ("i - d - i - o - t", "idiot"), ("i d i o +", "idiot"), ("tr @s h!", "trash"),
        ("i.d i.o.t", "idiot"),
    ],
)
def test_spelled_out_words_are_restored(hidden, word):
    reader = spelling_reader()
    for text in (hidden, f"stone {hidden} river", f"there {hidden}"):
        assert word in reader.text(text), text


def test_runs_are_read_as_one_lattice():
    reader, rng = spelling_reader(), random.Random(18)
    pieces = ["id", "iot", "of", "ii", "oo", "1", "@", "a", "t", "s", "the", "tr", "!", "i.d", "an", "ash", "é"]
    for _ in range(2000):
        run = " ".join(rng.choice(pieces) for _ in range(rng.randint(2, 9)))
        assert reader.run(run) == toxicity_.restore(run, reader.model), run


def test_long_pieces_keep_all_words():
    reader = spelling_reader()
    spelled = " ".join("trashriverstone" * 3 + "idiot")
    dotted = ".".join("stone river there the trash idiot stone".replace(" ", "") * 2)
    assert any("idiot" in w for w in reader.text(spelled))
    assert any("idiot" in w for w in reader.text(dotted))
    for n in range(20):  # wherever a cut would be
        piece = "river/" * 7 + "-" * n + "stone/idiot/there/" + "1" * 40
        assert {"river", "stone", "idiot", "there"} <= reader.text(piece)
    assert "idiot" in reader.text("1d10t/" + "river." * 50_000 + "1d10t")


def toxic_table(spark, n=600):
    rng = random.Random(8)
    bad = ["idiot", "moron", "trash"]
    data, labels = [], []
    for i in range(n):
        text, label = [rng.choice(["stone", "river", "cloud", "paper", "glass"]) for _ in range(20)], int(i % 5 == 0)
        if label:
            for _ in range(2):
                word = rng.choice(bad)
                text.insert(rng.randint(0, 20), word if i % 10 else word.replace("i", "1").replace("o", "0"))
        data.append((i, " ".join(text)))
        labels.append((i, label))
    return (
        spark.createDataFrame(data, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_toxicity_learns_and_finds_hidden_words(spark):
    docs, labels = toxic_table(spark)
    got = toxicity(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 600
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    assert not any(r.predicted for r in held if not r.toxic)


def test_toxicity_of_awkward_tables(spark):
    _, labels = toxic_table(spark, 10)
    got = toxicity(documents(spark), labels)
    assert got.count() == len(TABLE) and got.where("score is null").isEmpty()
    assert {r.held_out for r in got.where("doc_id is null").collect()} == {None}
    kept = toxicity(documents(spark), labels.where("false"), keep=documents(spark).columns)
    assert kept.count() == len(TABLE)
    assert toxicity(no_documents(spark), labels).count() == 0


# repeated passages


def plain_removed(table, length=100):
    out, seen = Counter(), set()
    done = {}
    key = lambda r: (r[0] is None, r[0] or 0)
    for doc_id, text, *_ in sorted(table, key=key):
        data = (text or "").encode()
        if doc_id is not None and (doc_id, data) in done:
            out[done[doc_id, data]] += 1
            continue
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        row = (doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        done[doc_id, data] = row
        out[row] += 1
    return out


def test_repeats(spark):
    # The order of two texts of one id is by hash: these two share nothing.
    got = as_counter(removed(documents(spark)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_removed(TABLE)
    assert removed(no_documents(spark)).count() == 0


def test_repeats_of_random_pieces(spark):
    rng = random.Random(9)
    pieces = [words(rng.randint(5, 60), i) for i in range(12)] + ["ab" * 90, "é" * 70]
    table = [(i, " ".join(rng.choice(pieces)[rng.randint(0, 40) :] for _ in range(rng.randint(1, 6)))) for i in range(60)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = as_counter(removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_removed(table)


# near duplicates


def plain_duplicates(table, size, percent):
    sets = []
    for doc_id, text, *_ in table:
        w = tokens(text)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    group = list(range(len(table)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = table[i][0] is not None and table[i][0] == table[j][0]
            if same or (both and 100 * both >= percent * len(sets[i] | sets[j])):
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(table):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(table))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    got = near_duplicates(documents(spark), size=size)
    assert as_counter(got, "doc_id", "n_shingles", "component_id") == plain_duplicates(TABLE, size, 80)
    kept = got.where("kept").select("doc_id").distinct()
    assert {1, 2} & {r[0] for r in kept.collect()} == set()


def test_near_duplicates_of_a_dense_group(spark):
    """Copies with few and with many changes: some are linked, some only look alike."""
    rng = random.Random(10)
    base = words(80, 20).split()
    table = []
    for i in range(240):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            text[rng.randrange(80)] = f"new{rng.randint(0, 400)}"
        table.append((i, " ".join(text)))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = near_duplicates(docs, size=4)
    assert as_counter(got, "doc_id", "n_shingles", "component_id") == plain_duplicates(table, 4, 80)
    assert near_duplicates(no_documents(spark)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 161))
    assert all(got[i] == 500 for i in range(500, 560)) and got[7] == got[3] == 3 and len(got) == 123


# personal data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                total = sum(
                    sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))
                )
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_on_random_texts():
    rng = random.Random(11)
    parts = list("0123456789..--  ++()@@abZ_%é\n") + ["4111111111111111", "10.0.0.1", "x@y.z", "+1 (389) 555-5010"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pd_.base_spans(text) == plain_spans(text), text


def test_personal_data(spark):
    got = pd_.personal_data(documents(spark))
    want = Counter()
    for doc_id, text, *_ in TABLE:
        spans = plain_spans(text)
        kinds = Counter(k for _, k, _ in spans)
        joined = ",".join(f"{pd_.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        want[(doc_id, *(kinds[k] for k in range(4)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert as_counter(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert pd_.personal_data(no_documents(spark)).count() == 0


def test_repeated_entities_get_one_label():
    field = pd_.Field({"10-": [0, 0, 0, 0, 50]}, pd_.Potentials())
    text = "Call +1 (389) 555-5010. " + "x " * 400 + "or 389-555-5010, not 389-555-9999. bob.1@mail.example.com " + "y " * 90 + "bob.1 (at) mail"
    base, every = field.spans(text)
    assert {text[s:e] for s, _, e in every} - {text[s:e] for s, _, e in base} == {"389-555-5010", "bob.1 (at) mail"}


@pytest.mark.parametrize("more", ["", " from 10.0.0.1"])
def test_candidates_without_a_base_span_are_judged(spark, more):
    """What a text holds besides doesn't decide whether its candidates are looked at."""
    mails = [(i, f"write to user{i}@mail{i}.example") for i in range(60)]
    text = "john.doe (at) example" + " or so" * 20 + more
    docs = spark.createDataFrame([*mails, (100, text)], "doc_id long, text string")
    spans = pd_.personal_data(docs).where("doc_id = 100").first().spans
    assert "email:0:21" in spans.split(",")
    clean = pd_.masked(docs).where("doc_id = 100").first().text
    assert clean.startswith("<email> or so") and "john.doe" not in clean
    # Forms that all miss the patterns, in a text that has no other span.
    field = pd_.Field({"10-": [0, 0, 0, 50, 0]}, pd_.Potentials())
    assert field.spans("389-555-5010, " + "x " * 90 + "389-555-5010") == ([], [(0, 3, 12), (194, 3, 206)])


def test_messages_agree_with_all_labellings():
    rng = np.random.default_rng(3)
    unary = rng.normal(size=(4, 3))
    pairs, strength = np.array([[0, 1], [1, 2], [1, 3]]), np.array([0.7, 1.5, 0.4])  # a tree: exact
    total = np.zeros((4, 3))
    for labels in np.ndindex(3, 3, 3, 3):
        score = sum(unary[i, k] for i, k in enumerate(labels))
        score += sum(s for (a, b), s in zip(pairs, strength) if labels[a] == labels[b])
        for i, k in enumerate(labels):
            total[i, k] += np.exp(score)
    want = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(pd_.beliefs(unary, pairs, strength, 200), want, atol=1e-3)


def test_masked(spark):
    got = {r.doc_id: r.text for r in pd_.masked(documents(spark)).where("doc_id in (4, 9)").collect()}
    assert got[9] == "mail <email> or <phone>, card <card>, at <ip>" and got[4] == ""


# languages


def test_languages(spark):
    rng = random.Random(12)
    stock = {"en": "the of and ing tion ness", "de": "der und ung keit sch lich", "fr": "le que eux ment oir ette"}
    table = []
    for i in range(400):
        lang = rng.choice(list(stock))
        text = " ".join("".join(rng.choices(stock[lang].split(), k=2)) for _ in range(rng.randint(5, 60)))
        table.append((i, text, lang if i % 7 else None, lang))
    table += [(1000, None, "en", "en"), (1001, "123 ?!", "en", "en"), (None, "derung undkeit", "de", "de")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, truth string")
    got = languages(docs)
    by_id = {r.doc_id: r for r in got.collect()}
    truth = {r[0]: r[3] for r in table}
    assert by_id[1000].lang_pred == by_id[1001].lang_pred == "und" and by_id[1000].score == 0
    right = [by_id[i].lang_pred == truth[i] for i in range(400)]
    assert sum(right) >= 396 and all(0 <= r.score <= 1 for r in by_id.values())
    assert by_id[None].held_out is None
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in by_id.items() if i is not None)
    assert languages(documents(spark)).count() == len(TABLE)
    assert languages(no_documents(spark)).count() == 0
    assert {r.lang_pred for r in languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_long_texts(spark):
    """Texts of some MB, of so many words that they hold far more n-grams than there are bins."""
    rng = np.random.default_rng(17)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    weights = {name: rng.dirichlet(np.full(26, 2.0)) for name in ("en", "de", "fr", "it")}

    def text(name, n):
        joined = "".join(rng.choice(letters, n, p=weights[name]))
        return " ".join(joined[i : i + 6] for i in range(0, n, 6))

    table = [(i, text(name, 900), name) for i, name in enumerate(list(weights) * 30)]
    table += [(1000 + i, text(name, 2_500_000), name) for i, name in enumerate(weights)]
    docs = spark.createDataFrame([r[:2] for r in table[-4:]], "doc_id long, text string")
    docs = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(
        spark.createDataFrame(table[:-4], "doc_id long, text string, lang string")
    )
    got = {r.doc_id: r.lang_pred for r in languages(docs).collect()}
    assert [got[1000 + i] for i in range(4)] == list(weights)
    assert sum(got[i] == lang for i, _, lang in table[:-4]) >= 116


def test_parts_hold_every_n_gram():
    for n in (0, 1, 5, 2048, 2049, 4097, 9000):
        text = "".join(chr(97 + (i * i // 7) % 26) for i in range(n))
        grams = {text[i : i + k] for k in range(1, 5) for i in range(n - k + 1)}
        found = list(language.parts(text))
        assert {p[i : i + k] for p in found for k in range(1, 5) for i in range(len(p) - k + 1)} == grams
        assert all(len(p) <= language.PART + 3 for p in found)


# neighbours


def test_nearest(spark):
    rng = np.random.default_rng(13)
    data = rng.normal(size=(400, 12)).astype(np.float32) * rng.uniform(0.5, 1.5, size=(400, 1)).astype(np.float32)
    data[50:90] = data[49]  # equal vectors
    table = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0]), (1080, [None] * 12), (None, table[0][1])]
    vectors = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    exact = data.astype(np.float64) @ data.astype(np.float64).T
    found = total = 0
    for q in range(0, 400, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        for r in mine:
            assert r.score == pytest.approx(exact[q, r.vec_id], rel=1e-12) and r.vec_id != q
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        others = sorted((i for i in range(400) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        found += len(set(others) & {r.vec_id for r in mine})
        total += 20
    assert {r.query_id for r in got} == set(range(0, 400, 20))
    assert found >= 0.9 * total
    assert nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def recall(spark, data, k=20, every=20):
    table = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r.vec_id) for r in nearest(vectors, F.col("vec_id") % every == 0, k).collect())
    exact, want = data @ data.T, set()
    for q in range(0, len(data), every):
        others = sorted((i for i in range(len(data)) if i != q), key=lambda i: (-exact[q, i], i))
        want |= {(q, i) for i in others[:k]}
    assert sum(got.values()) == len(want)
    return len(want & set(got)) / len(want)


@pytest.mark.parametrize("kind", ["one of 100", "one of 10", "very different", "few directions"])
def test_nearest_of_different_lengths(spark, kind):
    rng = np.random.default_rng(15)
    data = rng.normal(size=(600, 64))
    if kind == "few directions":
        data = rng.normal(size=(12, 64))[rng.integers(0, 12, 600)] + 0.2 * data
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    if kind.startswith("one"):
        data[7] *= float(kind.split()[-1])
    else:
        data *= np.exp(rng.normal(size=(600, 1)) * 1.5)
    assert recall(spark, data) >= 0.95


def test_nearest_of_tiny_tables_finds_all(spark):
    rng = np.random.default_rng(16)
    one = rng.normal(size=8)
    assert recall(spark, np.array([one, -one, 2 * one]), every=1) == 1
    sides = np.repeat([[1.0], [-1.0]], [9, 21], axis=0) * one + 0.01 * rng.normal(size=(30, 8))
    assert recall(spark, sides, every=5) == 1


def test_nearest_drops_what_its_steps_shuffled(spark):
    """The driver keeps the shuffles of a few steps, not of all, and a step makes few."""
    rng = np.random.default_rng(17)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 16)))]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    held = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    number = lambda: spark.sparkContext._jsc.sc().newShuffleId()
    first = number()
    assert nearest(vectors, F.col("vec_id") % 20 == 0).count() == 300
    made = number() - first
    until = time.time() + 10
    while (kept := sum(held.contains(i) for i in range(first, first + made))) > made / 4 and time.time() < until:
        time.sleep(0.2)
    assert made <= 80 and kept <= made / 4


# decontamination


def test_contaminated(spark):
    items = [(i, words(n, 100 + i)) for i, n in enumerate([30, 25, 8, 6, 3])] + [(9, None), (10, "")]
    rng = random.Random(14)
    table, want = [], set()
    for i in range(80):
        text = words(60, 200 + i).split()
        if i % 4 == 0:
            item = rng.choice([0, 1, 2, 3])
            part = items[item][1].split()
            for _ in range(2 if item < 2 else 0):  # words put in the place of others
                part[rng.randrange(len(part))] = "other"
            part = [w.upper() + "!!" for w in part]
            at = rng.randint(0, 60)
            text[at:at] = part
            want.add((i, item))
        table.append((i, " ".join(text)))
    table += [(81, None), (82, ""), (None, items[0][1])]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("item", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("node", F.lit(1))
    found = contaminated(docs, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want | {(None, 0)}
    clean = clean_documents(docs, found)
    assert {r.doc_id for r in clean.collect()} == {t[0] for t in table} - {d for d, _ in want} - {None}
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("hot,group,windows,piece", [(3, 50_000, 500_000, 50), (2, 4, 500_000, 7), (10_000, 50_000, 3, 100_000)])
def test_repeats_of_very_frequent_passages(spark, monkeypatch, hot, group, windows, piece):
    """Passages between the same neighbours and between others, dealt out by more than their anchors."""
    for name, value in (("HOT", hot), ("GROUP", group), ("WINDOWS", windows), ("PIECE", piece)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(12)
    passages = [words(n, 100 + n) for n in (9, 15, 18, 30)]
    table = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.7 else words(rng.randrange(1, 8), i) for _ in range(4)]
        table.append((i, " ".join(parts)))
    table += table[:5] + [(500 + i, "n" * (90 + i)) for i in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = as_counter(removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_removed(table)


def test_repeats_across_blocks_of_a_long_text(spark):
    long = words(60_000, 31)
    assert len(long) > 2 * repeats.BLOCK // 2
    table = [(1, long + " tail one"), (2, "head " + long[: 300_000]), (3, long[250_000:270_000] * 2), (4, words(300, 32))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = as_counter(removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain_removed(table)
