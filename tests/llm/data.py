"""Small tables with the awkward cases that every operator has to handle."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double"
SF = "/root/testdata/sf0.001"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdeäéñ") for _ in range(r.randint(2, 6))) for _ in range(n)]


def documents(spark):
    """Nulls in every column, empty, blank, one-word, long, repeated, copied and near-copied texts, repeated rows; extra columns with clashing names."""
    base = words(1, 300)
    near = [*base[:150], "ZZZ", *base[151:]]
    half = [*base[:150], *words(2, 150)]
    long = " ".join(words(3, 9000))
    texts = [
        None, "", " \n\t ", "one", "?!", "Two words", " ".join(base), " ".join(base), " ".join(near), " ".join(half).upper(),
        long, long + " tail", "\n".join([" ".join(words(4, 25))] * 4), " ".join(base[40:80]) + "\n" + " ".join(words(5, 40)),
        "x" * 5000, "İΣ ΟΔΟΣ ﬁ <|endoftext|> 😀 naïve b", " ".join(words(6, 30)), None,
    ]
    rows = [(i, t, ["de", "fr", None][i % 3], ["s0", None][i % 2], None if i % 4 else 1, 7, 0.5) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "stray text without an id", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
