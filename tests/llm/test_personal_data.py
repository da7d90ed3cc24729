"""Personal data: base spans over a whole table, added spans against planted ones, and time against length."""

import hashlib
import random
import time
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gristmill.llm import pii
from tests.llm.test_operators import base_pii

SF = "/root/testdata/sf0.01"


def iban(rng, country="DE"):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    value = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - value % 97:02d}{body}"


def failing(rng):
    """Sixteen digits whose check digit is wrong."""
    while True:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if "card" not in base_pii(d):
            return d


def planted(prose):
    """(text, [(kind, found)]): each text has personal data of one kind, or something that looks like it."""
    rng, rows = random.Random(8), []
    first, last = pii.NAMES, "Miller Schulz Dupont Ortega Novak Rossi Keller Moreau Vega Lang".split()
    company = "Apache License,Red Wagon,Blue Harbor,Grand Total,Open Source,Next Chapter,Public Domain,Old Mill".split(",")
    for i in range(900):
        before, after = prose(i, 12), prose(5000 + i, 9)
        name, code, digits = f"{rng.choice(first)} {rng.choice(last)}", iban(rng), failing(rng)
        number = f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        # What stands before, what is to be found (None: nothing), and its kind.
        said = [
            ("Dear ", name, "person"), ("written by ", f"Dr {rng.choice(last)}", "person"), ("iban ", code, "iban"), ("konto: ", " ".join(code[j : j + 4] for j in range(0, 22, 4)), "iban"),
            ("account number ", digits, "account"), ("bank card ", digits, "account"), ("please call ", number, "phone"), ("address: ", f"{rng.randrange(1, 99)} Oak Street", "address"),
            ("contact ", f"{rng.choice(last).lower()} at gmail dot com", "email"), ("host ", ":".join(f"{rng.randrange(4096, 65535):x}" for _ in range(8)), "ip"),
            ("released under the ", rng.choice(company), None), ("order ", digits, None), ("", digits, None), ("serial ", number, None), ("chapter ", f"{rng.randrange(1, 99)} {rng.choice(last)} Roadside", None),
            ("code ", code[:2] + f"{(int(code[2:4]) + 1) % 97:02d}" + code[4:], None), ("meet at noon or look at ", "the dot in a picture", None), ("version ", f"1.{i}.2", None),
        ]
        lead, found, kind = said[i % len(said)]
        rows.append((f"{before} {lead}{found} {after}.", [(kind, found)] if kind else []))
    return rows


def test_added_spans_against_planted_ones(spark, prose):
    rows = planted(prose)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    true, extra, missed = Counter(), Counter(), Counter()
    for r in pii.find_personal_data(df, out_col="found").collect():
        text, want = rows[r.doc_id]
        got = [(s.kind, text[s.start : s.end]) for s in r.found if not s.base]
        for x in set(got) | set(want):
            (true if x in got and x in want else extra if x in got else missed)[x[0]] += 1
    found = {k: (true[k] / max(1, true[k] + extra[k]), true[k] / max(1, true[k] + missed[k])) for k in pii.KINDS if true[k] + missed[k] + extra[k]}
    print({k: tuple(round(x, 3) for x in v) for k, v in found.items()}, dict(extra), dict(missed))
    assert all(p >= 0.95 for p, _ in found.values()) and all(r >= 0.9 for _, r in found.values()), (found, extra, missed)


def test_names_of_a_given_table(spark):
    text = ["greetings from Zorbina Quux today", "greetings from Anna Quux today"] * 30
    df = spark.createDataFrame(list(enumerate(text)), "doc_id bigint, text string")
    names = spark.createDataFrame([("name", "Zorbina"), ("name", None)], "list string, word string")
    got = {r.doc_id % 2: r.n for r in pii.find_personal_data(df, gazetteer=names).select("doc_id", F.size("spans").alias("n")).collect()}
    assert got == {0: 1, 1: 0}


def test_base_spans_of_a_whole_table(spark):
    texts = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    got = {r.doc_id: r.base_sha256 for r in pii.documents_searched(spark, SF).collect()}
    assert got == {i: hashlib.sha256(base_pii(t).encode()).hexdigest() for i, t in texts.items()}


def test_time_grows_with_the_text(spark):
    took = []
    for n in (3000, 12_000, 48_000):
        text = " ".join(f"a{i}@host{i}.example.com 10.{i % 200}.3.4 {i % 90 + 10} word +49 30 {1000000 + i}" for i in range(n // 3))
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        start = time.time()
        (row,) = pii.find_personal_data(df, out_col="found").select(F.size("found").alias("n")).collect()
        took.append(time.time() - start)
        assert row.n == n
    assert took[2] < 6 * max(took[1], 3), took  # four times the text; the square would be sixteen


def test_no_python_on_executors(spark):
    plan = pii.find_personal_data(spark.createDataFrame([(1, "a@b.cd")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
