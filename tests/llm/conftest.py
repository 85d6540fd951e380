import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "te", "ru", "sa", "ne", "vo") for b in ("n", "r", "st", "la", "mo", "dy", "", "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double"


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) for _ in range(n)]
    return "".join(w + (rng.choice((" ", " ", " ", ", ", ".\n")) if i < n - 1 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Rows with nulls, empty, blank and very long texts, ties, repeated rows and columns whose names clash with results."""
    rng = random.Random(5)
    rows = [[i, prose(rng, rng.randint(3, 160)), "en", f"src{i % 3}"] for i in range(40)]
    base = prose(rng, 150)
    for k in range(8):  # near copies, then exact ones
        words = base.split(" ")
        words[3 * k] = "changed"
        rows.append([40 + k, " ".join(words) if k < 5 else base, "en", "src0"])
    rows += [[60, None, "en", "src1"], [61, "", "en", None], [62, " \n\t ", None, "src2"], [63, "One", "en", "src0"], [64, "same line\n" * 30, "en", "src1"]]
    rows += [[65, prose(rng, 30_000), "en", "src1"], [66, "x" * 50_000, "en", "src1"], [67, "Ünïcode ßüß #1 a|b 日本語 \u00a0x", "de", "src2"], rows[3], rows[3], [None, "no id at all here", "en", "src1"]]
    return [(*r, len(r[1] or ""), 7, 0.5) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
