"""Spelling variants, language-model scores and ranked search against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import lm, search, spelling
from gristmill.llm.common import Scratch

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def empty(df):
    return df.where(F.lit(False))


# --- spelling -----------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least=5, ratio=5, dropped=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def spelled(spark):
    """Chains of forms, ties, accents, letters that share a bit, a word with very many near ones, and clashing columns."""
    rows = [(1, "colour " * 200 + "color! " * 30 + "colors " * 6 + "colouré " * 5), (2, None), (3, ""), (None, "Nulled " * 9), (4, "straße " * 60 + "STRAßE straße strase " * 6)]
    rows += [(5, "ÀÀÀÀÀÀ " * 25 + "ÀÀÀÀÀä ÀÀÀÀÀ× " * 5), (6, "日本abcdefg日本 " * 7 + "abcdef " * 7), (6, "abcdef " * 7)]
    rows += [(7, " ".join(f"word{c}ing" for c in "abcdefghijklmnopqrstuvwxyz") * 5 + " wording" * 300), (8, "x" * 30_000 + " " + "tiedaa tiedbb tiedab " * 5)]
    rows += [(i, "common commen words") for i in range(20, 420)] + [(9, "abcdefgs " * 200 + "abcdefgst " * 30 + "abcdefgstu " * 6)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("word", "n", "mask", "meta.url", "key")}), rows


@pytest.mark.parametrize("dropped", [199, 3])
def test_variants_are_those_of_all_pairs(spelled, dropped):
    df, rows = spelled
    got = [tuple(r) for r in spelling.variants(df, dropped=dropped).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(rows, dropped=dropped)
    assert any(r[2] != r[0] and r[2] != r[1] for r in got) or dropped == 3


def test_variants_of_nothing(spelled):
    assert spelling.variants(empty(spelled[0])).count() == 0


def test_edits_flip_at_most_two_bits():
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
    bits = [spelling.letter_bit(ord(c)) for c in letters]
    assert all(0 <= b < 63 for b in bits) and len(set(bits[:26])) == 26
    assert {b // spelling.BAND for b in bits} == {0, 1, 2}


# --- search -------------------------------------------------------------------------------------------

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, queries, k):
    docs = [(key, Counter(TERMS.findall((text or "").translate(SMALL)))) for key, text in rows]
    docs = [(key, c, sum(c.values())) for key, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = set()
    for item in {q[0] for q in queries}:
        terms = {t for i, text in queries if i == item for t in TERMS.findall((text or "").translate(SMALL))}
        found = []
        for key, c, size in docs:
            m = 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score:
                found.append((-score, key is not None, key, -score))
        for rank, (score, _, key, _) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.add((item, rank, key, -score))
    return out


@pytest.mark.parametrize("block_rows, chunk, k", [(3, 2, 3), (7, 1, 10), (1 << 16, 256, 50)])
def test_search_is_that_of_exact_scores(spark, corpus, plain, block_rows, chunk, k):
    queries = [(1, plain[5][1][:200]), (2, plain[8][1]), (3, "no such terms here"), (4, None), (5, ""), (6, "ban1 BAN2, bes3; né"), (6, "dom4"), (None, plain[12][1][:90]), (7, plain[5][1][:200])]
    asked = spark.createDataFrame(queries, "item_id bigint, text string").withColumns({c: F.lit(1) for c in ("q", "rank", "term", "block", "a.b")})
    scratch = Scratch(spark, "test")
    index = search.build(scratch, corpus, block_rows=block_rows)
    got = search.search(scratch, index, asked, k=k, chunk=chunk).collect()
    assert {tuple(r) for r in got} == plain_search([r[:2] for r in plain], queries, k)
    assert index.docs.select(F.sum(F.size("keys"))).first()[0] == len(plain)


def test_bounds_hold_and_leave_most_documents_out(spark, corpus, plain):
    scratch = Scratch(spark, "test")
    index = search.build(scratch, corpus, block_rows=16)
    for r in index.postings.join(index.docs, "block").limit(400).collect():
        ords, up = np.frombuffer(r["ords"], "<u2"), np.frombuffer(r["impacts"], np.uint8).astype(int) * search.STEP
        exact = search.impact(search.wide(r["tfs"], len(ords)), search.damped(np.array(r["lengths"]), index.documents, index.total)[ords])
        assert (exact <= up).all() and (up - search.STEP < np.maximum(exact, 1)).all() and r["df"] == len(ords) and (np.diff(ords.astype(int)) > 0).all()


def test_search_of_nothing(spark, corpus):
    scratch = Scratch(spark, "test")
    asked = spark.createDataFrame([(1, "ban1")], "item_id bigint, text string")
    assert search.search(scratch, search.build(scratch, empty(corpus)), asked).count() == 0
    assert search.search(scratch, search.build(scratch, corpus), empty(asked)).count() == 0


# --- language model -----------------------------------------------------------------------------------


def plain_base(rows):
    counts, out = Counter(), {}
    for key, text in rows:
        if lm.learned_from(key):
            counts.update([*lm.words_of(text), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for key, text in rows:
        words = [*lm.words_of(text), b"\n"]
        out.setdefault(key, []).append((len(words), sum(w in counts for w in words), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    return counts, out


@pytest.mark.parametrize("known", [lm.KNOWN, 50])
def test_counts_and_base_scores(corpus, plain, known):
    """Whether frequent words are known to tasks or joined, the figures are those of the plain version."""
    counts, want = plain_base([r[:2] for r in plain])
    got = lm.scored(corpus, known=known, shape=lm.Shape(inputs=40, outputs=20, endings=8, dealt=4)).collect()
    assert len(got) == len(plain)
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 10 == 0)
        assert any((r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3], rel=1e-9) for w in want[r["doc_id"]])
        assert math.isfinite(r["score"]) and r["score"] < 0
    same = {}
    for r in got:  # equal texts have equal scores
        text = next(p[1] for p in plain if p[0] == r["doc_id"])
        assert same.setdefault(text, r["score"]) == pytest.approx(r["score"], rel=1e-6)


def test_probabilities_add_up_to_one():
    """Over all words and one unknown a class, after any words."""
    counts = Counter({f"w{i:03d}": 400 - i for i in range(300)}) + Counter({"\n": 50})
    shape = lm.Shape(inputs=30, outputs=10, endings=6, dealt=3)
    ordered = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    others = Counter({w: counts[w] for w in ordered[10:]})
    ends = Counter()
    for w, n in others.items():
        ends[w[-3:]] += n
    ends = [e for e, _ in sorted(ends.items(), key=lambda x: (-x[1], x[0]))[:6]]
    totals = {}
    for w, n in others.items():
        c = ends.index(w[-3:]) if w[-3:] in ends else 6 + zlib.crc32(w[-3:].encode()) % 3
        totals[c] = (totals.get(c, (0, 0))[0] + n, totals.get(c, (0, 0))[1] + 1)
    v = lm.Vocabulary(shape, ordered, [counts[w] for w in ordered], ends, totals, sum(counts.values()), len(counts))
    model = lm.Model.start(v)
    model.rows[:] += np.random.default_rng(1).normal(0, 0.5, model.rows.shape)
    before = [b"w001", b"w250", b"new"]
    mass = 0.0
    units = np.arange(shape.n_out)
    for u in units:
        _, _, unit, x, since, _ = lm.laid_out(v, [before])
        unit[3] = u
        mass_u = math.exp(lm.log_probabilities(model, unit, x, since)[3])
        if u < shape.outputs:
            mass += mass_u
        else:
            n, types = totals.get(u - shape.outputs, (0, 0))
            mass += mass_u * (n + 0.1 * types + 0.1) / 10 ** v.size[u - shape.outputs]
    assert mass == pytest.approx(1, abs=1e-4)


def test_a_trained_model_beats_the_unigram_on_held_out_texts(spark):
    """Two invented languages whose texts never mix, and word order that a unigram cannot know."""
    import random

    rng = random.Random(3)
    words = [[f"{c}{i}{'xyz'[i % 3]}" for i in range(40)] for c in "ab"]
    rows = []
    for key in range(600):
        own, at = words[key % 2], rng.randrange(40)
        text = []
        for _ in range(80):
            at = (at + rng.choice([1, 1, 1, 2, 7])) % 40
            text.append(own[at])
        rows.append((key, " ".join(text)))
    got = lm.scored(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert got[1] / got[2] > got[0] / got[2] + 0.3


def test_scores_of_nothing_and_of_no_training_text(spark, corpus):
    assert lm.scored(empty(corpus)).count() == 0
    held = next(i for i in range(100) if not lm.learned_from(i))
    got = lm.scored(spark.createDataFrame([(held, "a few words"), (None, None)], "doc_id bigint, text string")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(4, 0, 0), (1, 0, 0)} and all(math.isfinite(r["score"]) for r in got)
