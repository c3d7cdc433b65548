import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, rank string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty, tiny and long texts, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(20, 300)) for _ in range(60)]
    shared = prose(rng, 70)
    for k in range(0, 30, 3):
        w = texts[k].split()
        texts[k] = " ".join(w[:10]) + " " + shared + " " + " ".join(w[10:])
    for k in range(12):
        w = texts[40].split()
        w[(7 * k) % len(w)] = f"new{k}"
        texts.append(" ".join(w))
    texts += [texts[1]] * 9 + ["", " \n\t", None, "one", "two words", "A b", "a B", "x" * 5000, prose(rng, 4000), "É à ß", "tie tie tie tie tie tie tie tie tie tie tie"]
    rows = [(i, t, "en", None if i % 17 == 0 else f"src{0 if i % 3 else i % 7}", len(t or ""), 0.5, 1, "r") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[2], "en", "src1", 3, 0.5, 1, "r"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
