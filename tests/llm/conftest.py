import random

import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
SYLLABLES = "an ba co de el fi go hu in jo ka lo mi no or pa re si to un".split()


@pytest.fixture(scope="session")
def invent():
    """Invented words by a seed, as a list."""

    def words(n, seed):
        r = random.Random(seed)
        return ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n)]

    return words


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text) with further columns, some of them clashing names."""

    def make(rows, **extra):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])

    return make


@pytest.fixture(scope="session")
def clashes():
    """Names that operators might use themselves."""
    return {c: 1 for c in ("n", "token", "sig", "rep", "spans", "row", "text_key", "score", "count", "size", "lang_pred", "items", "__id")}
