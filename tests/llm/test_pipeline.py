"""The pipeline's stages on the smallest tables: columns, whole results, and each stage's effect."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    names = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == names
        if name in ("quality", "near_duplicates"):
            assert docs.exceptAll(before).count() == 0 and 0 < counts[-1] <= counts[-2]
        if name == "lines":
            assert counts[-1] == counts[-2]
        if name == "mixing":
            copies = Counter(r.doc_id for r in docs.select("doc_id").collect())
            assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in before.select("doc_id").collect()}
    per_doc = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert per_doc.where("n % t <> 0").count() == 0


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(k.startswith(f"op{n}_") for k in found) for n in range(1, 11))


def test_copy_groups_survive_the_lines_stage(spark, prose):
    """Groups of exact and of near copies above the line ratio keep their text through the stages lines and near_duplicates."""
    header = "read all about it on this site"
    rows = [(i, f"{header}\n{prose(i, 60)}") for i in range(300)]
    exact = "\n".join(prose(1000 + j, 20) for j in range(6))
    rows += [(1000 + i, exact) for i in range(60)]
    shared = [prose(2000 + j, 20) for j in range(8)]
    rows += [(2000 + i, "\n".join([header, *shared, f"number {i} ends here"])) for i in range(60)]
    rows += [(3000 + i, "\n".join(shared) + " " * i) for i in range(30)]  # differ by blanks only
    rows += [(4000, None), (4001, ""), (4002, exact)]
    docs = spark.createDataFrame([(i, t, "en", "src0" if i != 4002 else None, 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    cut = spark.createDataFrame(corpus_pipeline.without_site_lines(spark, docs, SF).collect(), docs.schema)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert len(texts) == len(rows) and texts[4000] is None and texts[4001] == ""
    assert all(texts[i] == prose(i, 60) for i in range(300))  # boilerplate goes
    assert all(texts[i] == exact for i in [*range(1000, 1060), 4002])
    assert all(f"number {i} ends here" in texts[2000 + i] and header not in texts[2000 + i] for i in range(60))
    assert not [i for i, t in texts.items() if i < 4000 and not t.strip()]
    left = {r.doc_id: r.text for r in corpus_pipeline.one_of_each_group(spark, cut, SF).collect()}
    assert [i for i, t in left.items() if t == exact] == [1000]
    held = [i for i, t in left.items() if t and all(x in t for x in shared)]
    assert len(held) == 1 and set(range(300)) < set(left)


def test_an_id_with_different_texts(spark, prose):
    """Each text of a repeated id stays unless it is linked; the choice among repeated rows is the least one."""
    a, b, c = (prose(i, 50) for i in (1, 2, 3))
    rows = [(1, a, "en", "src0", 1), (1, b, "en", "src0", 1), (1, "", "en", "src0", 1), (2, b, "en", "src0", 1), (3, c, "fr", "src0", 1), (3, c, "de", "src0", 1), (3, c + " end", "en", "src0", 1)]
    rows += [(None, a, "en", "src0", 1)] * 2
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    want = {(1, a, "en"): 1, (1, b, "en"): 1, (1, "", "en"): 1, (None, a, "en"): 2}
    for parts in (1, 3):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, schema).repartition(parts)
        got = Counter((r.doc_id, r.text, r.lang) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect())
        left = [k for k in got if k[0] == 3]
        assert len(left) == 1 and left[0] in {(3, c, "de"), (3, c + " end", "en")}
        assert {k: n for k, n in got.items() if k[0] != 3} == want
