"""Tables with everything that a table may hold."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use inside
    "node long, d long, h long, key long, size long, target double, score double, label int, words string"
)
random.seed(17)
VOCABULARY = "alpha beta gamma delta the of and to in stone river cloud winter summer paper glass".split()


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 99)) for _ in range(n))


def rows():
    base = words(60, 1)
    near = base.replace(base.split()[30], "changed")
    texts = [
        (0, base),
        (1, near),
        (2, base),
        (2, base),  # a repeated row
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one"),
        (7, words(12_000, 2)),  # very long
        (8, "x" * 5_000),  # one word, one letter
        (9, "mail bob.1@mail.example.com or +1 (389) 555-5010, card 4111 1111 1111 1111, at 10.0.0.1"),
        (10, words(40, 3) + "\n" + base),
        (None, words(30, 4)),
        (None, None),
        (11, "Ä ö ß é 漢字 \U0001f600 " * 30),
        (12, words(50, 5)),
        (12, words(50, 6)),  # the same id, another text
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        lang = [None, "en", "de"][i % 3]
        source = [None, "b", "a"][i % 3]
        out.append((doc_id, text, lang, source, len(text or ""), 1, 2, 3, 4, 5, 6.0, 7.0, 8, "w"))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
