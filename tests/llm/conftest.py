import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashing names that operators use inside.
EXTRA = "fp long, component_id long, node long, root long, part int, key long, tokens long, p string, rate string, spans string, findings string, bucket int, h long, k long, nth int, length string, domain string"


def prose(rng: random.Random, n: int, tail: str = "") -> str:
    return " ".join("".join(rng.choice("abcdefghijkl" + tail) for _ in range(rng.randint(2, 9))) for _ in range(n))


def edge_rows(seed: int = 5) -> list[tuple]:
    """Nulls anywhere, empty and blank texts, a very long one, ties and repeated rows."""
    rng = random.Random(seed)
    same, long = prose(rng, 120), prose(rng, 30_000)
    texts = [None, "", " \n\t ", "one", "word " * 300, same, same, same[:-20] + "changed here", long, long[50_000:120_000] + " end", "ÄÖ é 漢字 mixed " * 30, "A" * 5000, same]
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(25)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", None) for i, t in enumerate(texts)]
    return [*rows, (3, "one", "en", "s", 3), (None, same, None, None, None), (None, None, None, None, None), (3, "another text of the same id", "en", "s", 1)]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for field in EXTRA.split(", "):
        name, kind = field.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def none(edges):
    return edges.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
