"""run() over a small fixture against a plain version of all five stages."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import lines, quality
from tests.llm.test_operators import WORD, plain_quality, plain_targets, shingles


def fixture(prose):
    """(doc_id, text, lang, source, n_chars): a header, exact and near copies, junk, nulls, empty and long texts, ties and repeated rows."""
    rows = []
    for i in range(120):
        body = f"{prose(i, 30 + i % 9)}\n{prose(1000 + i, 25)}"
        rows.append((i, f"header of this site\n{body}" if i % 2 else body, "en" if i % 3 else "fr", f"src{i % 3}"))
    for i in range(40):
        rows.append((200 + i, f"!!$$ {'|#' * 30} {i} <<>> ~~ ^^ " * 4, "en", f"src{i % 3}"))
    shared = "\n".join(prose(5000 + j, 20) for j in range(6))
    rows += [(300 + i, shared, "en", "src1") for i in range(12)]
    rows += [(320 + i, f"{shared}\nends with {i}", "en", "src1") for i in range(12)]
    rows += [(400, None, "en", "src0"), (401, "", "en", "src0"), (402, "  \n ", None, "src0"), (403, "one two", "en", None), (404, prose(9, 4000), "de", "src2")]
    rows += [(405, prose(77, 40), "en", "src0")] * 2 + [(None, prose(78, 40), "en", "src0")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def with_odd_columns(docs):
    """docs with further columns whose names have dots and backticks or clash with the stages' own, and of nested types."""
    extra = {c: F.lit("x") for c in ("meta.url", "row", "k", "tick`ed", "site_lines", "copies", "a b", "u", "h", "z")}
    return docs.withColumns(extra | {"map.of": F.create_map(F.lit("a"), F.lit(1)), "list": F.array(F.lit(1), F.lit(None)), "nested": F.struct(F.lit(1).alias("b.c"))})


def plain_lines(rows):
    """Stage two on (id, text, lang, source, n) rows, line by line."""
    bare = lambda x: x.strip(" \t\r")
    by_host = defaultdict(set)
    for _, text, _, source, _ in rows:
        if source is not None:
            by_host[source].add(text)
    gone = {}
    for host, texts in by_host.items():
        held = lambda t: {bare(x) for x in t.split("\n") if bare(x)} if t is not None else set()
        by_row = Counter(x for _, t, _, s, _ in rows if s == host for x in held(t))
        maybe = {x for x, n in by_row.items() if n >= lines.LEAST_PAGES and n > lines.RATIO * len(texts)}
        unit, heavy = {}, set()
        for t in texts:
            over = held(t) & maybe
            if over and sum(map(len, over)) >= 0.5 * sum(map(len, held(t))):
                heavy.add(t)
                unit[t] = ("copies", max(map(len, over)), max(x for x in over if len(x) == max(map(len, over))))
            else:
                unit[t] = t
        units = len(set(unit.values()))
        on = {x: len({unit[t] for t in texts if x in held(t)}) for x in maybe}
        gone[host] = {x for x, n in on.items() if n >= lines.LEAST_PAGES and n > lines.RATIO * units}
    out = []
    for doc, text, lang, source, n in rows:
        if text is not None and gone.get(source):
            text = "\n".join(x for x in text.split("\n") if not bare(x) or bare(x) not in gone[source])
        out.append((doc, text, lang, source, len(text) if text is not None else n))
    return out


def plain_unique(rows):
    """Stage three: of linked documents the least id, of repeated rows one."""
    known = [r for r in rows if r[0] is not None]
    sets = [shingles(r[1]) for r in known]
    root = list(range(len(known)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(known)):
        for j in range(i):
            same = known[i][:2] == known[j][:2]
            if same or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                a, b = top(i), top(j)
                a, b = sorted((a, b), key=lambda x: (known[x][0], x))
                root[b] = a
    return [known[i] for i in range(len(known)) if top(i) == i] + [r for r in rows if r[0] is None]


def test_run_is_the_plain_pipeline(spark, prose, tmp_path):
    rows = fixture(prose)
    labels = [(i, int(i < 200), 0) for i in [*range(0, 100), *range(200, 230)]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = with_odd_columns(spark.createDataFrame(rows, schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")

    model = quality.fit(docs, marks, "doc_id", "text", 20_000)
    z = model.logit(quality.features(F.coalesce("text", F.lit(""))))
    scored = docs.select("doc_id", "text", "source", "lang", z.alias("z")).collect()
    judged = [(r.doc_id, r.text, x[2]) for r, x in zip(scored, plain_quality([(r.source, r.lang, r.z) for r in scored]))]
    good = {(d, t) for d, t, q in judged if q >= 0.5}
    kept = [r for r in rows if r[:2] in good]
    assert {r[0] for r in rows if r[0] is not None and r[0] < 120} <= {r[0] for r in kept} and not [r for r in kept if r[0] is not None and 200 <= r[0] < 240]
    cut = plain_lines(kept)
    assert sum(a[1] != b[1] for a, b in zip(kept, cut)) > 50 and all("header of" not in r[1] for r in cut if r[0] is not None and r[0] < 120)
    left = plain_unique(cut)
    assert len(left) < len(cut) - 20

    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in left:
        sizes[r[3]] += size(r[1])
    target = plain_targets(sizes)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in left}
    pieces, tokens = corpus_pipeline.run(spark, str(tmp_path)).collect(), Counter()
    for p in pieces:
        whole = ids[p.doc_id]
        assert p.doc_tokens == len(whole) and p.ids_crc32 == zlib.crc32(whole[p.start : p.start + p.length].tobytes())
        tokens[p.doc_id] += p.length
    taken = Counter()
    for doc, text, _, source, _ in left:
        copies = tokens[doc] / len(ids[doc])
        assert copies in (0, 1, 2) and (size(text) or copies == 1), (doc, copies)
        taken[source] += int(copies) * size(text)
    largest = defaultdict(int)
    for r in left:
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(largest[s] / 2, 30), (s, taken[s], target[s])
    filled = Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


def test_stages_on_empty_tables(spark, tmp_path):
    docs = with_odd_columns(spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_stages_keep_columns_of_any_name(spark, prose, tmp_path):
    rows = fixture(prose)[:90]
    docs = with_odd_columns(spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {tuple(r) for r in out.select("`meta.url`", "`tick``ed`", "`a b`").collect()} == {("x", "x", "x")}, name
