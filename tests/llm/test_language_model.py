import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from runcourier.llm.language_model import discounts, language_model_scores

random.seed(5)
WORDS = ["a", "b", "the", "The", "é", "x1", "zz", "q", "long-word"]
TEXTS = [" ".join(random.choices(WORDS, [9, 5, 30, 3, 2, 2, 1, 1, 1], k=random.randint(1, 40))) for _ in range(150)]
TEXTS += [None, "", "  \n", "unseen words here", "the the the the"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(texts):
    """The formulas as they stand, with dictionaries."""
    tokens = {i: lower(t).split() + ["</s>"] for i, t in enumerate(texts)}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    before, behind, first = Counter(), defaultdict(Counter), Counter()
    for (v, w), c in pairs.items():
        before[w] += 1
        behind[v][min(c, 3)] += 1
        first[v] += c
    d = discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    e = discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    total, size = sum(before.values()), len(count)
    cut = lambda n, d: 0 if not n else d[min(n, 3) - 1]
    spare = sum(cut(n, e) for n in before.values()) / total

    def low(w):
        return (before[w] - cut(before[w], e)) / total + spare / (size + 1)

    def p(v, w):
        if not first[v]:
            return low(w)
        left = sum(d[k - 1] * n for k, n in behind[v].items())
        c = pairs[v, w]
        return (c - cut(c, d)) / first[v] + left / first[v] * low(w)

    n = sum(count.values())
    assert abs(sum(low(w) for w in count) + spare / (size + 1) - 1) < 1e-9
    assert abs(sum(p("the", w) for w in count) + p("the", "unheard") - 1) < 1e-9
    return {
        i: (
            len(t),
            sum(w in count for w in t),
            n,
            sum(math.log10((count[w] + 0.1) / (n + 0.1 * (size + 1))) for w in t),
            sum(math.log10(p(v, w)) for v, w in zip(["<s>", *t], t)),
        )
        for i, t in tokens.items()
    }


@pytest.mark.parametrize("mass,most", [(2_000_000, 2**32 - 1), (150, 2**32 - 1), (150, 2), (2_000_000, 1)])
def test_same_as_by_hand(spark, mass, most):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = language_model_scores(docs, mass=mass, most=most).collect()
    want = brute(TEXTS)
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score int")
    assert language_model_scores(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (1, "a a")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_model_scores(docs).collect()}
    assert got[None].held_out is None and got[None].n_known == 2
    assert got[1].train_tokens == 3
