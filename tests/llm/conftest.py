import random

import pytest

CLASHING = {"_key": "k", "_text": "t", "_set": "s", "kept": "x", "size": "y", "shard": "z", "_hits": "h", "language": "l"}


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) rows with further columns whose names clash with those of the operators."""

    def build(rows, partitions=3):
        extra = ", ".join(f"`{c}` string" for c in CLASHING)
        full = [(k, t, *CLASHING.values()) for k, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {extra}").repartition(partitions)

    return build


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences of invented words."""

    def build(seed, words):
        rng = random.Random(seed)
        parts = ["the", "of", "ra", "lo", "mi", "ten", "sor", "vel", "qua", "dis"]
        return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))

    return build
