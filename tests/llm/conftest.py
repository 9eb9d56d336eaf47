import random

import pytest
from pyspark.sql import functions as F

from feria.llm import common

random.seed(11)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages, empty and null ones, a long one, and repeated rows."""
    rng = random.Random(5)
    passage = prose(60, rng)
    out = []
    for i in range(60):
        out.append([i, prose(rng.randint(1, 120), rng)])
    for i in range(60, 75):
        base = out[i - 60][1].split()
        if len(base) > 40:
            base[rng.randrange(len(base))] = "other"
        out.append([i, " ".join(base)])
    for i in range(75, 85):
        out.append([i, prose(20, rng) + " " + passage + "\n" + prose(20, rng)])
    out += [[85, ""], [86, None], [87, "   \n\t "], [88, out[3][1].upper()], [89, out[3][1]], [90, "É é ß \x0b ﷽"], [91, prose(9000, rng)], [92, "one"], [93, "ONE"]]
    out += [list(out[5]), [None, out[7][1]], [None, None]]
    return [(i, t, ("en", "de", None)[(i or 0) % 3], ("a", "b", "c", None)[min((i or 0) % 8, 3)], len(t or "")) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names operators use inside."""
    common.tune(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["row", "id", "key", "t", "chunk", "place", "extra", "content", "digest", "rate", "doc", "n", "z", "class", "anchor", "_rate", "_key"]
    return df.withColumns({c: F.lit("x") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
