"""Answer mentions of candidates, as arrays of (key, label, source, kind, score) in order of appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import constants as C
from gristmill.functions import text as T

MENTION = "struct<key: string, label: string, source: string, kind: string, score: double>"


def mention(label: Column, source: Column | str, kind: Column | str = "", key: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    key = T.normalize(label) if key is None else key
    return F.struct(key.alias("key"), label.alias("label"), lit(source).alias("source"), lit(kind).alias("kind"), F.lit(None).cast("double").alias("score"))


def first_of_each(mentions: Column, most: int | None = None) -> Column:
    """The first mention of every non-empty key, at most ``most``; the fold holds no more than that."""
    none = F.array().cast(f"array<{MENTION}>")

    def step(kept, m):
        new = (m["key"] != "") & ~F.exists(kept, lambda k: k["key"] == m["key"])
        if most is not None:
            new &= F.size(kept) < most
        return F.when(new, F.concat(kept, F.array(m))).otherwise(kept)

    return F.aggregate(mentions, none, step)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def entity_labels(text: Column) -> Column:
    labels = F.transform(found(text, C.ENTITY), lambda x: T.strip(F.regexp_replace(x, T.SPACES, " ")))
    return F.filter(labels, lambda x: F.length(x).between(2, 80))


def gated(kind: Column, kinds: tuple[str, ...], values: Column) -> Column:
    return F.when(kind.isin(*kinds), values).otherwise(F.array().cast(f"array<{MENTION}>"))


def raw_mentions(query: Column, text: Column, most: int = 5) -> Column:
    """Numbers, months, years and names of the whole text, as the query's type asks; none for yes/no queries."""
    kind = T.query_type(query)
    words = F.array_distinct(T.words_of(T.normalize(query)))
    text = F.coalesce(text, F.lit(""))
    as_mentions = lambda labels, source: F.transform(labels, lambda x: mention(x, source))
    names = F.filter(entity_labels(text), lambda x: ~T.is_query_echo(T.words_of(T.normalize(x)), words))
    return first_of_each(
        F.concat(
            gated(kind, ("number", "mixed"), as_mentions(found(text, C.NUMBER), "number")),
            gated(kind, ("date", "mixed"), as_mentions(found(text, C.MONTH), "date")),
            gated(kind, ("date", "mixed"), as_mentions(found(text, C.YEAR), "year")),
            gated(kind, ("entity", "mixed"), as_mentions(names, "entity")),
        ),
        most,
    )


def focused_mentions(query: Column, text: Column, most: int = 5, count: int = 4, max_words: int = 8, by_query: bool = True, cues: bool = True) -> Column:
    """Yes/no words, cue phrases, numbers, dates and names of the spans that fit the query, with weak candidates left out."""
    kind = T.query_type(query)
    words = F.array_distinct(T.words_of(T.normalize(query)))

    def of_span(span: Column) -> Column:
        where, text = span["kind"], span["span"]

        def candidates(labels: Column, source: str) -> Column:
            clean = F.transform(labels, lambda x: T.clean_label(x, max_words))
            return F.transform(F.filter(clean, lambda x: ~T.is_low_value(x, words)), lambda x: mention(x, F.concat_ws(":", where, F.lit(source))))

        padded = T.normalize(text)
        flag = lambda pattern, word: F.when(F.rlike(padded, F.lit(pattern)), mention(F.lit(word), "boolean", key=F.lit(word)))
        parts = [gated(kind, ("boolean",), F.array_compact(F.array(flag(C.YES, "yes"), flag(C.NO, "no"))))]
        if cues:
            parts += [
                gated(kind, ("entity",), candidates(found(text, C.WHO_CUE, 1), "who_subject_cue")),
                gated(kind, ("entity",), candidates(found(text, C.WHERE_CUE, 1), "where_cue")),
                gated(kind, ("mixed",), candidates(found(text, C.WHAT_CUE, 1), "what_cue")),
                gated(kind, ("entity", "mixed"), candidates(found(text, C.RELATION_CUE, 1), "relation_cue")),
            ]
        parts += [
            gated(kind, ("number", "mixed"), candidates(found(text, C.NUMBER_PHRASE), "number_phrase")),
            gated(kind, ("number", "mixed"), candidates(found(text, C.NUMBER), "number")),
            gated(kind, ("date", "mixed"), candidates(found(text, C.MONTH), "date")),
            gated(kind, ("date", "mixed"), candidates(found(text, C.YEAR), "year")),
            gated(kind, ("entity", "mixed"), candidates(entity_labels(text), "entity")),
        ]
        return F.concat(*parts)

    return first_of_each(F.flatten(F.transform(T.focus_spans(query, text, count, by_query), of_span)), most)


def reference_mentions(text: Column, answers: Column) -> Column:
    """Known answers (array of kind and answer) that the text holds as whole words; the key names the kind."""
    normalized = T.normalize(text)
    held = F.filter(answers, lambda a: T.contains_phrase(normalized, T.normalize(a["answer"])))
    named = F.transform(held, lambda a: mention(a["answer"], "reference", a["kind"], F.concat_ws(":", a["kind"], T.normalize(a["answer"]))))
    return first_of_each(named)


def scoring_mentions(heuristic: Column, reference: Column, use_reference: bool, kinds: tuple[str, ...] | None = None) -> Column:
    if not use_reference:
        return heuristic
    return reference if kinds is None else F.filter(reference, lambda m: F.lower(m["kind"]).isin(*kinds))


# --- outputs of models, taken as tables --------------------------------------------------------------


def semantic_rank(candidates: DataFrame, k: int, min_score: float = -1.0) -> DataFrame:
    """The k best candidates (query_id, doc_id, position, label, score) of each document by a model's score; ties by position."""
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "position")
    return candidates.where(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reader_spans(spans: DataFrame, k: int, max_tokens: int = 12, max_words: int = 8, min_score: float = -1e9) -> DataFrame:
    """A reader's spans (query_id, query, doc_id, start, end, start_logit, end_logit, label) that are answers, best first, one of each key."""
    words = F.array_distinct(T.words_of(T.normalize(F.col("query"))))
    label = T.clean_label(F.col("label"), max_words)
    fits = (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") < max_tokens)
    rows = spans.where(fits).withColumns({"label": label, "score": F.col("start_logit") + F.col("end_logit")})
    rows = rows.where((F.col("score") >= min_score) & ~T.is_low_value(F.col("label"), words) & ~T.is_sentence_like(F.col("label")))
    rows = rows.withColumn("key", T.normalize(F.col("label")))
    by_key = Window.partitionBy("query_id", "doc_id", "key").orderBy(F.desc("score"), "start", "end")
    rows = rows.withColumn("_n", F.row_number().over(by_key)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "start", "end")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def span_search(windows: DataFrame, k: int, starts: int = 20, ends: int = 20, max_tokens: int = 12) -> DataFrame:
    """(query_id, doc_id, start, end, start_logit, end_logit, rank): the k best spans of each text by a reader's logits.

    windows are (query_id, doc_id, offset, start_logits, end_logits): a text's tokens from offset on,
    in windows that may overlap. In each window the best starts meet the best ends (ties: the
    earlier), and pairs of 1 to max_tokens tokens count. A span that several windows bring has the best of its scores.
    """

    def best(column: str, n: int) -> Column:
        placed = F.transform(F.col(column), lambda x, i: F.struct((-x).alias("minus"), i.alias("i")))
        return F.slice(F.array_sort(F.filter(placed, lambda x: x["minus"].isNotNull() & ~F.isnan(x["minus"]))), 1, n)

    tops = windows.select("query_id", "doc_id", "offset", best("start_logits", starts).alias("s"), best("end_logits", ends).alias("e"))
    pairs = tops.select("query_id", "doc_id", "offset", F.explode("s").alias("s"), "e").select("query_id", "doc_id", "offset", "s", F.explode("e").alias("e"))
    pairs = pairs.where((F.col("e.i") >= F.col("s.i")) & (F.col("e.i") - F.col("s.i") < max_tokens)).select(
        "query_id", "doc_id", (F.col("offset") + F.col("s.i")).alias("start"), (F.col("offset") + F.col("e.i")).alias("end"), (-F.col("s.minus")).alias("a"), (-F.col("e.minus")).alias("b")
    )
    one = pairs.groupBy("query_id", "doc_id", "start", "end").agg(F.max(F.struct((F.col("a") + F.col("b")).alias("score"), "a", "b")).alias("x"))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("x.score"), "start", "end")
    found = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "doc_id", "start", "end", F.col("x.a").alias("start_logit"), F.col("x.b").alias("end_logit"), "rank")


def text_windows(rows: DataFrame, tokens: str, size: int, stride: int) -> DataFrame:
    """rows with offset and the tokens of each window of a list: every ``stride`` tokens one of ``size``, the last to the end."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / F.lit(stride)).cast("int") * stride, F.lit(0)), F.lit(stride))
    return rows.where(n > 0).withColumn("offset", F.explode(starts)).withColumn(tokens, F.slice(tokens, F.col("offset") + 1, size))


def merge_mentions(reader: Column, heuristic: Column, top_heuristic: int = 2, most: int = 5) -> Column:
    """A reader's mentions, then the first heuristic ones; without any of the reader's all heuristic ones."""
    both = F.concat(reader, F.slice(heuristic, 1, top_heuristic))
    return first_of_each(F.when(F.size(reader) > 0, both).otherwise(heuristic), most)


def with_fallback(reader: DataFrame | None, error: str | None = None, required: bool = False) -> tuple[DataFrame | None, str | None]:
    """A model's spans, or none and the reason where the model could not be had; an error if it is required."""
    if reader is None and required:
        raise RuntimeError(error or "the model is required")
    return reader, None if reader is not None else (error or "no model")
