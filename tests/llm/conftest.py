import random

import pytest

WORDS = [a + b for a in "ba be bi bo bu da de di do du fa fe fi fo fu".split() for b in "n r s t l m".split()]


@pytest.fixture(scope="session")
def prose():
    """A maker of invented prose: prose(seed, words)."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """documents with nulls, empty and long texts, repeated rows, copies and near copies, and clashing extra columns."""
    rows = []
    for i in range(40):
        rows.append((i, prose(i, 30 + 7 * i), "en" if i % 3 else "fr", f"src{i % 4}", 1))
    rows += [(100, rows[5][1], "en", "src1", 1), (101, rows[5][1], "en", None, 1)]
    near = rows[20][1].split()
    rows.append((102, " ".join(near[:-2] + ["changed", "end"]), "de", "src2", 1))
    rows += [(103, None, "en", "src0", None), (104, "", "en", "src0", 0), (105, "  \t ", None, "src0", 0), (106, "one two", "en", "src3", 7)]
    rows += [(107, "one two", "en", "src3", 7), (107, "one two", "en", "src3", 7), (None, "no id here at all but words", "en", "src0", 3)]
    rows.append((108, "x" * 50_000 + " " + prose(7, 9000), "en", "src1", 1))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("k", "h", "size", "rank", "site_lines", "q_score", "spans", "kept", "root")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def plain(corpus):
    return [tuple(r) for r in corpus.select("doc_id", "text", "lang", "source", "n_chars").collect()]
