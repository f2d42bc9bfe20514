import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata"


def prose(seed: int, n: int, words: int = 3000) -> str:
    """n words of a vocabulary of its own, with commoner and rarer words."""
    r = random.Random(seed)
    return " ".join(f"w{min(int(r.paretovariate(0.6)), words)}{'.' * (r.random() < 0.08)}" for _ in range(n))


@pytest.fixture
def make(spark):
    """Documents from texts, or from (doc_id, text); further columns by name."""

    def build(texts, extra: dict[str, str] | None = None):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in (extra or {}).items()})

    return build
