"""DuckDB SQL with the results of the registered queries, by name.

Written from the operators' definitions, in another engine's terms. Queries whose patterns need
look-behind or back-references, and the folds of the whole pipeline, have none and are tested
against plain Python instead.
"""

from __future__ import annotations

from gristmill.functions import constants as C
from gristmill.plans import tables

SQL: dict[str, str] = {}


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def first_each(x: str) -> str:
    """The distinct elements of a list column in order."""
    return f"list_filter({x}, lambda each, i: list_position({x}, each) = i)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"


STOP = listed(C.QUERY_FOCUS_STOPWORDS)
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def clean(x: str) -> str:
    bare = strip(f"coalesce({x}, '')")
    return f"lower(case when length({bare}) > 1 and right({bare}, 1) = '.' then left({bare}, length({bare}) - 1) else {bare} end)"


def bm25(corpus: str = "select doc_id, text from documents", k: int | None = 20, asked: str = "select item_id as query_id, text from benchmark") -> str:
    """CTEs that end in bm(query_id, doc_id, score, rank)."""
    cut = f" where rank <= {k}" if k else ""
    return f"""
corpus as ({corpus}),
tok as (select doc_id, unnest({tokens("text")}) as term from corpus),
tf as (select term, doc_id, count(*) as tf from tok group by all),
dl as (select doc_id, len({tokens("text")}) as dl from corpus),
st as (select count(*) as n, coalesce(sum(dl), 0) / greatest(count(*), 1) as avgdl from dl),
df as (select term, count(*) as df from tf group by all),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens("text")}) as term from ({asked})) group by all),
sc as (select query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double
         / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
       from tf join qt using (term) join df using (term) join dl using (doc_id), st group by all),
bm as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc){cut})"""


def dense(name: str, metric: str, k: int = 20) -> str:
    value = "list_dot_product(q.v, d.v)"
    if metric == "cosine":
        value += " / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-12) * greatest(sqrt(list_dot_product(d.v, d.v)), 1e-12))"
    return f"""
{name}_v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
{name} as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank
  from (select q.vec_id as query_id, d.vec_id as doc_id, round({value}, 6) as score from {name}_v q, {name}_v d
        where q.vec_id in (select item_id from benchmark))) where rank <= {k})"""


# --- text -------------------------------------------------------------------------------------------

SQL["text_normalize"] = f"select doc_id, {norm('text')} as plain, {norm("replace(replace(text, 'ß', 'ss'), 'ẞ', 'ss')")} as folded from documents"
SQL["text_tokens"] = f"select doc_id, {tokens('text')} as tokens from documents"
SQL["text_clean_answer"] = f"select conv_id, turn, {clean('text')} as answer from conversations"
SQL["text_answer_list"] = f"select conv_id, turn, list_filter(list_transform(string_split(text, '.'), lambda a: {strip('a')}), lambda a: a <> '') as answers from conversations"
SQL["text_query_type"] = f"""
with q as (select conv_id, turn, {strip("lower(coalesce(text, ''))")} as q from conversations)
select conv_id, turn,
  case when string_split(q, ' ')[1] in ({", ".join(f"'{w}'" for w in C.BOOLEAN_STARTS)}) then 'boolean'
    when starts_with(q, 'how many') or starts_with(q, 'how much') or contains(' ' || q || ' ', ' number ') or contains(' ' || q || ' ', ' percentage ')
      or contains(' ' || q || ' ', ' percent ') then 'number'
    when starts_with(q, 'when') or contains(q, 'what year') or contains(' ' || q || ' ', ' date ') then 'date'
    when starts_with(q, 'who') or starts_with(q, 'where') or starts_with(q, 'which') then 'entity' else 'mixed' end as kind
from q"""
SQL["text_content_tokens"] = f"""
select item_id as query_id, list_sort(list_distinct(list_filter({words("text")}, lambda w: length(w) > 2 and not list_contains({STOP}, w)))) as words from benchmark"""
SENTENCES = (
    r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), "
    r"lambda s: regexp_replace(regexp_replace(s, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
)
SQL["text_sentences"] = f"select doc_id, {SENTENCES} as sentences from documents"
SQL["text_context_window"] = f"""
with d as (select doc_id, text, {SENTENCES} as s, list_last({words("text")}) as w from documents),
e as (select doc_id, text, coalesce(w, '') as k, list_filter(s, lambda x: contains(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), coalesce(w, ''))) as hit from d)
select doc_id, left(case when k <> '' and len(hit) > 0 then hit[1] else {strip(r"regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')")} end, 360) as context from e"""
SQL["text_ngrams"] = f"""
with q as (select item_id as query_id, {words("text")} as w from benchmark)
select distinct query_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from q, unnest(range(1, len(w) - 1)) as t(i)"""
SQL["text_reader_tokens"] = r"""
select doc_id, nfc_normalize(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'), lambda x: lower(x)), ' ')) as tokens
from documents"""
SQL["text_abstention"] = f"""
select conv_id, turn, {" or ".join("contains(lower(t), '" + m.replace("'", "''") + "')" for m in C.ABSTENTION_MARKERS)} as abstains
from (select conv_id, turn, case when turn % 3 = 1 then text || ' I don''t know.' else text end as t from conversations)"""
PROMPT = C.PROMPT.replace("'", "''")
SQL["text_prompt"] = f"""
with {bm25(k=3)},
c as (select query_id, string_agg(text, chr(10) order by rank) as c from bm join documents using (doc_id) group by all)
select query_id, replace(replace('{PROMPT}', '[question]', b.text), '[context]', c) as prompt from c join benchmark b on b.item_id = query_id"""
SQL["text_head_and_tail"] = "select doc_id, case when length(text) <= 600 then text else left(text, 100) || ' [...] ' || right(text, 495) end as text from documents"

# --- retrieval ----------------------------------------------------------------------------------------

SQL["bm25_postings"] = f"with {bm25()} select term, doc_id, tf from tf"
SQL["bm25_statistics"] = f"with {bm25()} select n, round(avgdl, 6) as avgdl, (select count(*) from df) as terms, (select sum(df)::bigint from df) as postings from st"
SQL["bm25_top_k"] = f"with {bm25()} select * from bm"
OUTSIDE = "source in ('src18', 'src19')"
EXTRA = """
xt as (select doc_id, unnest({t}) as term from ({x})),
xf as (select doc_id, term, count(*) as tf from xt group by all),
xl as (select doc_id, len({t}) as dl from ({x})),
xs as (select query_id, doc_id, sum(qtf * ln(1 + (n - coalesce(df, 0) + 0.5::double) / (coalesce(df, 0) + 0.5::double)) * tf * 2.5::double
         / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as score
       from xf join qt using (term) left join df using (term) join xl using (doc_id), st group by all),
xa as (select q.item_id as query_id, l.doc_id, round(coalesce(score, 0), 6) as score from benchmark q cross join xl l left join xs on xs.query_id = q.item_id and xs.doc_id = l.doc_id)"""
MERGE = """
mg as (select query_id, doc_id, score, is_extra, row_number() over (partition by query_id order by score desc, is_extra, doc_id) as rank
       from (select query_id, doc_id, score, false as is_extra from bm union all select query_id, doc_id, score, true from xa))"""
SQL["bm25_with_arrivals"] = f"""
with {bm25(f"select doc_id, text from documents where not {OUTSIDE}")}, {EXTRA.format(t=tokens("text"), x=f"select doc_id, text from documents where {OUTSIDE}")}, {MERGE}
select * from mg where rank <= 20"""
SQL["dense_dot"] = f"with {dense('dn', 'dot')} select * from dn"
SQL["dense_cosine"] = f"with {dense('dn', 'cosine')} select * from dn"
SQL["dense_native"] = SQL["dense_cosine"]
SQL["run_compressed"] = f"with {bm25(k=50)} select query_id, doc_id, score, rank as ord from bm"
SQL["run_joined"] = f"""
with {bm25(k=30)}
select query_id, doc_id, score, row_number() over (partition by query_id order by rank) as rank from bm join documents using (doc_id) where lang <> 'fr'"""
FUSE = "select query_id, doc_id, {p} as p, {w}::double as w, score, rank from {t}"


def fused(channels: list[tuple[str, float]], score: str, k: int = 20, having: str = "true") -> str:
    parts = " union all ".join(FUSE.format(p=i, w=w, t=t) for i, (t, w) in enumerate(channels))
    return f"""
ch as ({parts}),
fu as (select query_id, doc_id, sum(w / (60 + rank)) as rrf, count(*) as n, min({{'p': p, 'rank': rank}}) as first from ch group by all having {having}),
fr as (select *, row_number() over (partition by query_id order by score desc, first.p, first.rank, doc_id) as rank
       from (select query_id, doc_id, round(rrf, 9) as rrf_score, n as support_count, first, round({score}, 9) as score from fu))"""


BOTH = f"{bm25()}, {dense('dn', 'cosine')}"
SQL["hybrid_rrf"] = f"with {BOTH}, {fused([('dn', 1), ('bm', 1)], 'rrf')} select query_id, doc_id, score, rank, support_count from fr where rank <= 20"
ALL = f"{BOTH}, {dense('dd', 'dot')}"
THREE = [("dn", 1), ("bm", 1.5), ("dd", 1)]
SHOW = "select query_id, doc_id, rrf_score, score, rank, support_count from fr where rank <= 20"
CONSENSUS = "rrf + 0.002::double * n - case when n = 1 then 0.003::double else 0 end"
SQL["ensemble_consensus"] = f"with {ALL}, {fused(THREE, CONSENSUS)} {SHOW}"
SQL["ensemble_robust"] = f"with {ALL}, {fused(THREE, CONSENSUS + ' - 0.001::double * (3 - n)')} {SHOW}"
SQL["ensemble_min_support"] = f"with {ALL}, {fused(THREE, CONSENSUS, having='count(*) >= 2')} {SHOW}"
NORM = "case when max(score) over q = min(score) over q then 1 else (score - min(score) over q) / (max(score) over q - min(score) over q) end"
SQL["hybrid_min_max"] = f"""
with {BOTH},
nm as (select query_id, doc_id, score, rank, 0 as p, {NORM} as norm from dn window q as (partition by query_id)
       union all select query_id, doc_id, score, rank, 1, {NORM} from bm window q as (partition by query_id)),
hy as (select query_id, doc_id, coalesce(max(score) filter (p = 0), 0) as dense_raw, coalesce(max(score) filter (p = 1), 0) as bm25_raw,
         coalesce(max(norm) filter (p = 0), 0) as d, coalesce(max(norm) filter (p = 1), 0) as b, min({{'p': p, 'rank': rank}}) as first from nm group by all)
select * exclude (first, d, b) from (
  select *, round(d, 6) as dense_norm, round(b, 6) as bm25_norm, row_number() over (partition by query_id order by score desc, first.p, first.rank, doc_id) as rank
  from (select *, round(0.4::double * d + 0.6::double * b, 9) as score from hy)) where rank <= 20"""
POISON = "select doc_id, doc_id % 40 as query_id from labels where toxic = 1"
SQL["poisoned_ranking"] = f"""
with {bm25(f"select doc_id, text from documents where doc_id not in (select doc_id from ({POISON}))", 10)},
{EXTRA.format(t=tokens("text"), x=f"select doc_id, text from documents where doc_id in (select doc_id from ({POISON}))")}, {MERGE}
select query_id, count(*) as n, count(p.doc_id) as hits from mg left join (select distinct * from ({POISON})) p using (query_id, doc_id) where rank <= 10 group by all"""

# --- clusters -----------------------------------------------------------------------------------------

JACCARD = "case when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::double end"
SQL["pairwise_jaccard"] = f"""
with {bm25(k=5)}, w as (select query_id, doc_id, list_distinct({tokens("text")}) as w from bm join documents using (doc_id))
select query_id, a.doc_id as a, b.doc_id as b, round({JACCARD.format(a="a.w", b="b.w")}, 6) as similarity from w a join w b using (query_id) where a.doc_id < b.doc_id"""
CLUSTERED = f"""
{bm25()},
lw as (select query_id, doc_id, score, rank, list_distinct({tokens("text")}) as w from bm join documents using (doc_id)),
lc as (select query_id, list({{'rank': rank, 'doc_id': doc_id, 'w': w}} order by rank) as l from lw group by all),
walk as (
  select query_id, l, 1::bigint as i, [l[1].w] as leaders, 0::bigint as cluster_id from lc
  union all
  select query_id, l, i + 1, case when hit is null then list_append(leaders, l[i + 1].w) else leaders end, coalesce(hit - 1, len(leaders))
  from (select query_id, l, i, leaders,
          list_position(list_transform(leaders, lambda x: {JACCARD.format(a="x", b="l[i + 1].w")} >= 0.72::double), true) as hit from walk where i < len(l))),
cl as (select w.query_id, l[i].doc_id as doc_id, score, rank, cluster_id from walk w join bm on bm.query_id = w.query_id and bm.doc_id = l[i].doc_id)"""
SQL["leader_clusters"] = f"with recursive {CLUSTERED} select query_id, doc_id, score, rank, cluster_id from cl"
SQL["cluster_statistics"] = f"""
with recursive {CLUSTERED}
select query_id, cluster_id, count(*) as size, list_sort(list(doc_id)) as doc_ids, count(*) filter (toxic = 1) as adv_doc_count from cl left join labels using (doc_id) group by all"""
SQL["cluster_cap"] = f"""
with recursive {CLUSTERED},
kept as (select *, row_number() over (partition by query_id, cluster_id order by rank) as n from cl)
select * from (select query_id, doc_id, score, cluster_id, row_number() over (partition by query_id order by rank) as rank from kept where n = 1) where rank <= 5"""

# --- support ------------------------------------------------------------------------------------------

STAGED = f"""
{bm25(k=10)},
s0 as (select query_id, doc_id, score, rank, source, {words("d.text")} as w, {words("b.text")} as q from bm join documents d using (doc_id) join benchmark b on b.item_id = query_id),
s1 as (select * exclude (w, q), list_filter(w, lambda x: length(x) >= 5 and list_contains(q, x)) as m from s0),
st1 as (select query_id, doc_id, score, rank, source, (substr(source, 4)::int // 2)::bigint as cluster_id, {first_each("m")} as keys,
         case when doc_id % 3 = 0 then ['bm25', 'dense'] else ['bm25'] end as channels,
         case when doc_id % 5 = 0 then 0.008::double else 0 end as echo_penalty, doc_id % 7 = 0 as low,
         case when {OUTSIDE} then 'runtime external' when source <> 'src17' then 'indexed corpus' else '' end as provenance from s1),
ex as (select *, unnest(keys) as answer_key, generate_subscripts(keys, 1) as pos from st1),
pr as (select *, keys[1] as answer_key, 0 as pos from st1 where len(keys) > 0)"""
STATS = """query_id, answer_key, answer_key as label, count(distinct doc_id) as doc_count, count(distinct cluster_id) as cluster_count,
  len(list_distinct(flatten(list(channels))))::bigint as channel_count"""
ROBUST = f"""{STATS}, count(distinct cluster_id) filter (echo_penalty = 0 and not low) as non_echo_clusters, count(distinct cluster_id) filter (not low) as grounded_clusters,
  count(distinct doc_id) filter (echo_penalty > 0 or low) as echo_docs, count(distinct doc_id) filter (low) as low_grounding_docs"""
SQL["support_by_answer"] = f"with {STAGED} select {STATS}, count(*) as mention_count from ex group by query_id, answer_key"
SQL["support_robust"] = f"with {STAGED} select {ROBUST} from ex group by query_id, answer_key"
SQL["support_primary"] = f"""
with {STAGED} select {ROBUST}, string_agg(rank::varchar, ',' order by rank) as ranks, min(rank) as best_rank, round(max(score), 6) as best_score from pr group by query_id, answer_key"""
SQL["support_coverage"] = f"""
with {STAGED},
d as (select query_id, count(*) as doc_count, count(*) filter (len(keys) > 0) as mentioned_doc_count, sum(len(keys))::bigint as mention_count from st1 group by all),
a as (select query_id, count(*) as unique_answer_count, max(doc_count) as max_doc_count, max(cluster_count) as max_cluster_count
      from (select {STATS} from ex group by query_id, answer_key) group by all)
select query_id, doc_count, mentioned_doc_count, mention_count, coalesce(unique_answer_count, 0) as unique_answer_count, coalesce(max_doc_count, 0) as max_doc_count,
  coalesce(max_cluster_count, 0) as max_cluster_count, round(mentioned_doc_count / doc_count, 6) as doc_coverage,
  case when mentioned_doc_count / doc_count < 0.25::double then 'low_answer_doc_coverage' when coalesce(unique_answer_count, 0) < 1 then 'too_few_unique_answers'
    else 'answer_support_sufficient' end as reason, reason <> 'answer_support_sufficient' as evidence_mode
from d left join a using (query_id)"""
SQL["support_head"] = f"""
with {STAGED} select query_id, answer_key, count(distinct doc_id) as doc_count, count(distinct cluster_id) as cluster_count, count(*) filter (rank <= 3) as head_count,
  count(*) filter (rank > 3) as supplement_count, min(rank) as best_rank from pr group by all"""
MARGIN = f"""
{STAGED}, ps as (select {ROBUST}, min(rank) as best_rank from pr group by query_id, answer_key),
m0 as (select *, case when non_echo_clusters > 0 then non_echo_clusters else cluster_count end as independent, echo_docs / doc_count as echo_ratio, cluster_count <= 1 as isolated from ps),
m1 as (select *, round(independent + 0.25::double * greatest(channel_count - 1, 0) - 0.75::double * echo_ratio - 0.5::double * isolated::int
         - 0.25::double * (max(independent) over (partition by query_id) - independent), 9) as ss from m0),
ms as (select *, row_number() over (partition by query_id order by ss desc, independent desc, cluster_count desc, channel_count desc, best_rank, answer_key) as place from m1)"""
SQL["margin_answer_scores"] = f"""
with {MARGIN} select query_id, answer_key, independent, isolated, round(echo_ratio, 6) as echo_ratio, round(ss, 6) as support_score, place from ms"""
RISKY = " or ".join(f"contains(lower(b.text), '{k}')" for k in C.HIGH_RISK_KEYWORDS)
SQL["margin_contexts"] = f"""
with {MARGIN},
c as (select t.query_id, t.answer_key as top_answer, r.answer_key as runner_up, round(t.ss - r.ss, 9) as margin, t.isolated as top_isolated,
        t.independent <= 1 and t.channel_count <= 1 as weak, t.echo_ratio >= 0.5::double or t.echo_docs >= t.doc_count as echo,
        (select count(*) from ms x where x.query_id = t.query_id and x.independent >= 2) as strong, r.independent > t.independent as behind, r.independent >= 2 as runner,
        {RISKY} as high_risk
      from ms t join ms r on r.query_id = t.query_id and r.place = 2 join benchmark b on b.item_id = t.query_id where t.place = 1),
d as (select *, round(least(0.75::double + case when weak or top_isolated then 0.25::double else 0 end + case when echo then 0.15::double else 0 end
        + case when strong >= 2 then 0.15::double else 0 end + case when strong = 0 then 0.2::double else 0 end + case when high_risk then 0.35::double else 0 end, 1.5::double), 9) as threshold from c)
select query_id, top_answer, runner_up, margin, threshold, margin < threshold as low_margin,
  case when strong >= 2 then 'multi_supported_conflict' when behind then 'top_not_best_support' when weak and runner then 'weak_top_with_supported_alternative'
    when strong = 0 then 'no_strong_answer' when echo then 'echo_heavy_top_answer' when top_isolated then 'isolated_top_answer' else 'weak_conflict' end as conflict_type,
  weak or top_isolated or echo as top_weak, top_isolated, echo as top_echo_heavy, strong >= 2 as multi_supported, strong = 0 as no_strong_answer, high_risk from d"""

# --- scores -------------------------------------------------------------------------------------------

COMMON = listed(C.COMMON_ENTITY_WORDS)
SQL["echo_of_query"] = f"""
with {bm25(k=10)},
e0 as (select query_id, doc_id, {norm("b.text")} as q, {norm("d.text")} as d, {words("b.text")} as qw, list_slice({words("d.text")}, 1, 40) as hd
       from bm join documents d using (doc_id) join benchmark b on b.item_id = query_id),
e1 as (select *, case when len(list_filter(qw, lambda w: not list_contains({COMMON}, w))) > 0 then list_filter(qw, lambda w: not list_contains({COMMON}, w)) else qw end as tw,
         list_distinct(list_filter(hd, lambda w: length(w) > 2 and not list_contains({STOP}, w))) as ct from e0),
e2 as (select *, list_distinct(tw) as ts, list_distinct(list_transform(range(1, len(tw) - 1), lambda i: tw[i] || ' ' || tw[i + 1] || ' ' || tw[i + 2])) as tg,
         list_distinct(list_transform(range(1, len(hd) - 1), lambda i: hd[i] || ' ' || hd[i + 1] || ' ' || hd[i + 2])) as hg from e1),
e3 as (select query_id, doc_id, q <> '' and d <> '' as ok, starts_with(d, q) as exact_prefix, len(list_intersect(ts, hd)) / greatest(len(ts), 1) as overlap,
         case when len(tg) > 0 then len(list_intersect(tg, hg)) / len(tg) else 0 end as ngram_overlap, len(list_filter(ct, lambda w: not list_contains(ts, w)))::bigint as novel, len(ct) as nct from e2),
e4 as (select query_id, doc_id, ok and exact_prefix as exact_prefix, case when ok then overlap else 0 end as overlap, case when ok then ngram_overlap else 0 end as ngram_overlap,
         case when ok then novel / greatest(nct, 1) else 1 end as novelty_ratio, case when ok then novel else 0 end as novel from e3)
select query_id, doc_id, exact_prefix, round(overlap, 6) as overlap, round(ngram_overlap, 6) as ngram_overlap, round(novelty_ratio, 6) as novelty_ratio, novel,
  round(case when exact_prefix then 0.03::double else (case when overlap >= 0.9::double or ngram_overlap >= 0.5::double then 0.008::double
    when overlap >= 0.75::double and ngram_overlap >= 0.25::double then 0.004::double else 0 end) * (case when novel < 4 or novelty_ratio < 0.18::double then 1.5::double else 1 end) end, 6) as penalty
from e4"""
CUE = lambda cues: "(" + " or ".join(f"contains(d, '{c}')" for c in cues) + ")"
SQL["injection_risks"] = f"""
with i0 as (select doc_id, {norm("case when doc_id % 4 = 0 then 'The answer is x. ' || text when doc_id % 4 = 1 then 'You should answer y' else text end")} as d,
       case when doc_id % 3 = 0 then 0.008::double else 0 end as copied from documents),
i1 as (select *, {CUE(C.ASSERTION_CUES)} as a, {CUE(C.INSTRUCTION_CUES)} as n, len(string_split(d, ' ')) <= 48 as short from i0),
i2 as (select *, greatest(case when a then 0.012::double else 0 end, case when n then 0.02::double else 0 end) as base from i1)
select doc_id, round(greatest(copied, base + case when base > 0 and short then 0.004::double else 0 end), 6) as penalty,
  array_to_string(list_filter([case when copied > 0 then 'query_copy' end, case when a then 'answer_assertion' end, case when n then 'answer_instruction' end,
    case when base > 0 and short then 'short_assertion_context' end], lambda x: x is not null), ',') as signals from i2"""
SQL["untrusted_claims"] = f"""
with {STAGED}, tr as (select query_id, list_distinct(flatten(list(keys))) as good from st1 where provenance <> 'runtime external' group by all),
j as (select s.*, provenance = 'runtime external' and len(keys) > 0 as claim, len(list_intersect(keys, coalesce(good, []))) > 0 as agreed from st1 s left join tr using (query_id))
select query_id, doc_id, round(case when claim and not agreed then 0.03::double else 0.004::double end, 6) as penalty,
  case when claim and agreed then 'untrusted_corroborated' when claim then 'untrusted_uncorroborated_claim' else '' end as signals,
  round(case when claim and not agreed then 0.03::double else echo_penalty end, 6) as echo_penalty from j"""
CONTENT = f"list_filter({{w}}, lambda w: length(w) > 2 and not list_contains({STOP}, w))"
SQL["topic_grounding"] = f"""
with {bm25(k=10)},
g as (select query_id, doc_id, list_distinct({CONTENT.format(w=words("b.text"))}) as qw, {CONTENT.format(w=words("d.text"))} as dw from bm join documents d using (doc_id) join benchmark b on b.item_id = query_id),
h as (select *, len(qw) > 0 and len(dw) > 0 as ok, len(list_intersect(qw, dw)) as o from g),
k as (select *, ok and ((o < 2 and o / len(qw) < 0.25::double) or (len(dw) <= 18 and o < 2)) as low from h)
select query_id, doc_id, case when ok then o else 0 end as overlap, round(case when ok then o / len(qw) else 0 end, 6) as coverage, len(dw) as content_tokens, low,
  round(case when low then 0.012::double + case when len(dw) <= 18 then 0.04::double else 0 end else 0 end, 6) as penalty from k"""
SQL["score_evidence"] = f"""
with {STAGED}, z as (select *, count(*) over (partition by query_id, cluster_id) as size from st1)
select query_id, doc_id, round(1 / (60 + rank)::double + 0.003::double * (len(channels) - 1) + 0.004::double * least(doc_id % 4, 3) + 0.006::double * (doc_id % 4) / 4
  - case when low then 0.012::double + case when doc_id % 40 <= 18 then 0.04::double else 0 end else 0 end
  + case when size <= 1 then 0.003::double else -0.004::double * (size - 1) end - echo_penalty - case when echo_penalty > 0 then 0.006::double else 0 end, 6) as score from z"""
SUPPORTED = """
sw as (select *, count(*) over (partition by query_id) as answers, max(cluster_count) over (partition by query_id) as most from (select {stats} from ex {where} group by query_id, answer_key)),
sv as (select e.query_id, e.doc_id, sum(0.006::double * least(cluster_count, 3) - 0.004::double * greatest(doc_count - cluster_count, 0)
         - case when answers >= 2 then 0.004::double * (most - cluster_count) else 0 end) as v from ex e join sw using (query_id, answer_key) group by all),
ss as (select s.*, round(1 / (60 + rank)::double + coalesce(v, 0) - echo_penalty - case when low then 0.012::double else 0 end, 9) as hs from st1 s left join sv using (query_id, doc_id))"""
SQL["score_support"] = f"with {STAGED}, {SUPPORTED.format(stats=STATS, where='where not low')} select query_id, doc_id, round(hs, 6) as score from ss"
SQL["score_robust"] = f"""
with {STAGED},
rw as (select *, count(*) over (partition by query_id) as answers, max(non_echo_clusters) over (partition by query_id) as most from (select {ROBUST} from ex group by query_id, answer_key)),
rv as (select e.query_id, e.doc_id, sum(case when non_echo_clusters > 0 and not low then 0.006::double * least(non_echo_clusters, 3) + 0.003::double * greatest(channel_count - 1, 0) else -0.006::double end
         - case when cluster_count <= 1 then 0.006::double else 0 end - 0.004::double * greatest(doc_count - cluster_count, 0) - 0.006::double * least(echo_docs, 2)
         - 0.012::double * least(low_grounding_docs, 2) - case when answers >= 2 then 0.004::double * greatest(most - non_echo_clusters, 0) else 0 end) as v
       from ex e join rw using (query_id, answer_key) group by all)
select query_id, doc_id, round(1 / (60 + rank)::double + coalesce(v, 0) - echo_penalty - case when low then 0.012::double else 0 end, 6) as score from st1 left join rv using (query_id, doc_id)"""

# --- selection ----------------------------------------------------------------------------------------

PLACED = f"{STAGED}, {SUPPORTED.format(stats=STATS, where='')}, pl as (select *, row_number() over (partition by query_id order by hs desc, rank) as place from ss)"
SQL["guard_first_rank"] = f"""
with {PLACED},
cc as (select query_id, answer_key, cluster_count from sw),
g as (select p.query_id, doc_id, rank, place, hs, coalesce(cluster_count, 0) as cc, min(rank) over q as head, max(case when rank = 1 then hs end) over q as head_score
      from pl p left join cc on cc.query_id = p.query_id and cc.answer_key = p.keys[1] window q as (partition by p.query_id)),
b as (select *, place = 1 and rank <> head and (hs - head_score < 0.002::double or rank > 20 or cc < 1) as guard_blocked from g),
o as (select *, max(guard_blocked) over (partition by query_id) as any_blocked from b),
r as (select *, row_number() over (partition by query_id order by case when any_blocked and rank = head then 0 else place end) as spot from o)
select query_id, doc_id, guard_blocked, spot as place, round(hs, 6) as score from r where spot <= 5"""
SQL["gate_provenance"] = f"""
with {STAGED}, k as (select *, case provenance when 'indexed corpus' then 'trusted' when 'runtime external' then 'untrusted' else 'unknown' end as c from st1)
select query_id, count(*) as input_count, count(*) filter (c = 'trusted') as eligible_count, count(*) filter (c = 'trusted') as trusted_count,
  count(*) filter (c = 'untrusted') as untrusted_quarantined, count(*) filter (c = 'unknown') as unknown_quarantined,
  coalesce(string_agg(doc_id::varchar, ',' order by rank) filter (c <> 'trusted'), '') as quarantined from k group by all"""
SQL["gate_authority"] = f"with {STAGED} select query_id, doc_id from st1 where query_id % 2 <> 0 or provenance = 'indexed corpus'"

# --- evaluation ---------------------------------------------------------------------------------------

HITS = f"{bm25(k=10)}, hi as (select bm.*, p.doc_id is not null as hit from bm left join (select distinct * from ({POISON})) p using (query_id, doc_id))"
SQL["eval_poison"] = f"""
with {HITS}, n as (select item_id, count(*) filter (hit) as h from benchmark left join hi on query_id = item_id group by all)
select count(*) as num_queries, round(avg(h / 10), 6) as precision, round(avg(h / 5), 6) as recall,
  round(avg(case when h > 0 then 2 * (h / 10) * (h / 5) / (h / 10 + h / 5) else 0 end), 6) as f1 from n"""
SQL["eval_contamination"] = f"""
with {HITS} select k, round(avg(share), 6) as contamination from (select k, query_id, avg(hit::int) as share from hi, unnest([1::bigint, 3, 5, 10]) as t(k) where rank <= k group by all) group by all"""
RESPONSES = """
r0 as (select *, row_number() over (order by conv_id, turn, text) as ord from conversations),
rs as (select ord, role, case when ord % 5 <> 0 then text end as response, case when ord % 3 = 0 then string_split(trim(text), ' ')[1] else 'zzzz' end as wrong from r0)"""
SQL["eval_attack_success"] = f"""
with {RESPONSES}, h as (select (ord - 1) // 10 as i, response is not null and contains({clean("response")}, {clean("wrong")}) as hit from rs)
select count(*) as iterations, round(avg(asr), 6) as asr from (select i, count(*) filter (hit) / 10 as asr from h group by all)"""
SQL["eval_attack_success_offline"] = f"""
with {RESPONSES}, k as (select response, wrong, row_number() over (order by ord) as o from rs where response is not null),
h as (select (o - 1) // 10 as i, contains({clean("response")}, {clean("wrong")}) as hit from k)
select count(*) as iterations, round(avg(asr), 6) as asr from (select i, avg(hit::int) as asr from h group by all)"""
SQL["eval_top_k_accuracy"] = f"""
with {HITS}, f as (select query_id, min(rank) filter (hit) as first from hi group by all)
select k, round(avg(coalesce(first <= k, false)::int), 6) as accuracy from f, unnest(range(1, 11)) as t(k) group by all"""
SQL["eval_inversions"] = f"with {bm25()} select a.query_id, count(*) filter (a.rank < b.rank and a.doc_id > b.doc_id) as inversions from bm a join bm b using (query_id) group by all"
SQL["eval_rankings"] = f"""
with {bm25(k=30)}, q as (select query_id, doc_id, quality as rel from bm join labels using (doc_id) where rank % 3 <> 0),
j as (select query_id, count(*) filter (rel > 0) as relevant, list_reverse_sort(list(rel)) as ideal from q group by all),
r as (select bm.query_id, bm.rank, q.rel, coalesce(q.rel > 0, false)::int as good from bm left join q using (query_id, doc_id) where rank <= 20),
s as (select *, sum(good) over (partition by query_id order by rank) as seen from r),
p as (select query_id, k, sum(coalesce(rel, 0) / log2(rank + 1)) as dcg, sum(good) as hits, sum(good * seen / rank) as ap, min(rank) filter (good = 1) as first, count(*) filter (rel is null) as holes
      from s, unnest([1::bigint, 5, 10]) as t(k) where rank <= k group by all),
m as (select j.*, t.k, coalesce(dcg, 0) as dcg, coalesce(hits, 0) as hits, coalesce(ap, 0) as ap, first, coalesce(holes, 0) as holes,
        list_sum(list_transform(list_slice(ideal, 1, t.k), lambda g, i: g / log2(i + 1))) as best
      from j cross join unnest([1::bigint, 5, 10]) as t(k) left join p on p.query_id = j.query_id and p.k = t.k where relevant > 0)
select k, round(100 * avg(dcg / best), 4) as ndcg, round(100 * avg(ap / relevant), 4) as map, round(100 * avg(hits / relevant), 4) as recall, round(100 * avg(hits / k), 4) as precision,
  round(100 * avg(coalesce(1 / first, 0)), 4) as mrr, round(100 * avg(hits / least(relevant, k)), 4) as recall_cap, round(100 * avg(holes / k), 4) as hole from m group by all"""
SQL["eval_weighted_means"] = "select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as mean from lineitem group by all"

# --- sources and streams --------------------------------------------------------------------------------

SQL["source_titled"] = """
with t as (select doc_id, case when doc_id % 3 = 0 then source else '' end as a, case when doc_id % 5 <> 0 then text else '' end as b from documents)
select doc_id, case when a = '' then b when b = '' then a else a || chr(10) || b end as text from t"""
SQL["source_subset"] = f"""
with {bm25(k=3)}, o as (select doc_id, row_number() over (order by doc_id) as ord from documents)
select * from o where ord <= 100 or doc_id in (select doc_id from bm)"""
SQL["source_poison"] = """
select 'adv::' || item_id || '::' || (i - 1) as doc_id, text || '.' || w[i] as text, 'runtime_external' as provenance, item_id::varchar as target_id, i - 1 as adv_idx
from (select item_id, text, string_split(text, ' ') as w from benchmark), unnest(range(1, 6)) as t(i) where i <= len(w)"""
SQL["stream_late_documents"] = f"""
with {bm25(f"select doc_id, text from documents where not {OUTSIDE}")}, {EXTRA.format(t=tokens("text"), x=f"select doc_id, text from documents where {OUTSIDE}")} select query_id, doc_id, score from xa"""
SQL["stream_event_counts"] = """
select epoch(time_bucket(interval 1 hour, ts))::bigint as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"""

# --- text rules ---------------------------------------------------------------------------------------

EDGE = r"""'^[ \t\n\r,;:()\[\]{}"'']+|[ \t\n\r,;:()\[\]{}"'']+$'"""
SENTENCES = r"""
sn as (select doc_id, unnest(l) as s, generate_subscripts(l, 1) - 1 as position
       from (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+'),
               lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as l from documents))"""


def label(x: str) -> str:
    """clean_label of a text column, as a scalar subquery-free expression over its parts."""
    spaced = rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '([a-z0-9])\.([A-Z])', '\1. \2', 'g'), '\s+', ' ', 'g'), {EDGE}, '', 'g')"
    parts = f"list_filter(string_split({spaced}, ' '), lambda w: w <> '')"
    stops = f"list_position(list_transform({parts}, lambda w: list_contains({listed(C.CUE_STOP_TOKENS)}, {norm('w')})), true)"
    kept = f"list_slice({parts}, 1, least(coalesce({stops} - 1, len({parts})), 8))"
    return f"array_to_string(list_filter(list_transform({kept}, lambda w: regexp_replace(w, {EDGE}, '', 'g')), lambda w: w <> ''), ' ')"


def low_value(w: str, known: str) -> str:
    """is_low_value of a list of normalized words against a list of the query's."""
    return f"""case when len({w}) = 0 then true when len({w}) = 1 and list_contains({listed(sorted(C.LOW_VALUE_SINGLE_ENTITIES))}, {w}[1]) then true when {w}[-1] = 's' then true when len({w}) > 10 then true
  when list_contains({listed(sorted(C.LOW_VALUE_CANDIDATE_PREFIXES))}, {w}[1]) then true when len({w}) >= 3 and len(list_intersect({w}, {known})) / len(list_distinct({w})) >= 0.5::double then true
  when {echoes(w, known)} then true when len({w}) = 1 and list_contains({STOP}, {w}[1]) then true else false end"""


def echoes(w: str, known: str) -> str:
    return f"(len(list_filter({w}, lambda x: not list_contains({known}, x))) = 0 or len(list_filter({w}, lambda x: not list_contains({COMMON}, x))) = 0)"


SQL["text_clean_label"] = f"with {SENTENCES} select doc_id, position, {label('s')} as label from sn"
KNOWN = listed(["the", "thing", "and", "of", "la", "de", "answer"])
SQL["text_candidate_rules"] = f"""
with {SENTENCES}, lb as (select doc_id, position, s, {label('s')} as l from sn), lw as (select doc_id, position, {words("l")} as w, {words("s")} as sw from lb)
select doc_id, position, {low_value("w", KNOWN)} as low_value, len(sw) > 5 and len(list_intersect(sw, {listed(sorted(C.SENTENCE_VERBS))})) > 0 as sentence_like, {echoes("sw", KNOWN)} as echo from lw"""
ARTICLE = r"'(^|[^\p{L}\p{M}\p{N}_])(a|an|the)($|[^\p{L}\p{M}\p{N}_])', '\1 \3', 'g'"
BARE = r"""regexp_replace(lower(coalesce(text, '')), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g')"""
SQL["text_normalize_qa"] = rf"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace({BARE}, {ARTICLE}), {ARTICLE}), '\s+', ' ', 'g')) as answer from documents"

# --- mentions -----------------------------------------------------------------------------------------

SQL["mentions_semantic"] = f"""
with {STAGED}, c as (select query_id, doc_id, pos - 1 as position, answer_key as label, (doc_id * 7 + (pos - 1) * 3) % 10 / 10 as score from ex)
select * from (select *, row_number() over (partition by query_id, doc_id order by score desc, position) as rank from c where score >= 0.2::double) where rank <= 2"""
TEXTS = f"{{k}}, wt as (select query_id, doc_id, b.text as query, d.text as text from bm join documents d using (doc_id) join benchmark b on b.item_id = query_id)"
SQL["mentions_reader"] = rf"""
with {TEXTS.format(k=bm25(k=3))},
p as (select query_id, query, doc_id, unnest(l) as raw, generate_subscripts(l, 1) - 1 as start from (select *, list_filter(string_split_regex(text, '\s+'), lambda w: length(w) > 3) as l from wt)),
q as (select query_id, query, doc_id, start, start + start % 3 - 1 as "end", ((doc_id + start * 5) % 11) / 2.0::double + (start * 3 % 7) / 4.0::double as score, {label("raw")} as label from p where start < 40),
r as (select *, {norm("label")} as key, {words("label")} as w, list_distinct({words("query")}) as known from q where "end" >= start and "end" - start < 12 and score >= 1),
s as (select * from r where not ({low_value("w", "known")}) and not (len(w) > 5 and len(list_intersect(w, {listed(sorted(C.SENTENCE_VERBS))})) > 0)),
t as (select *, row_number() over (partition by query_id, doc_id, key order by score desc, start, "end") as n from s)
select * from (select query_id, doc_id, start, "end", label, key, round(score, 6) as score, row_number() over (partition by query_id, doc_id order by score desc, start, "end") as rank from t where n = 1) where rank <= 4"""
HELD = "({p} <> '' and contains(' ' || {t} || ' ', ' ' || {p} || ' '))"
REFERENCE = f"""
ra as (select query_id, doc_id, {norm("text")} as t, array_to_string(list_slice({words("query")}, 1, 2), ' ') as good, coalesce({words("query")}[-1], '') as bad from wt),
rm as (select query_id, doc_id, list_filter([case when {HELD.format(p="good", t="t")} then {{'kind': 'correct', 'label': good}} end,
         case when {HELD.format(p="bad", t="t")} then {{'kind': 'incorrect', 'label': bad}} end], lambda x: x is not null) as m from ra)"""
SQL["mentions_reference"] = f"""
with {TEXTS.format(k=bm25(k=5))}, {REFERENCE} select query_id, doc_id, array_to_string(list_transform(m, lambda x: x.kind || ':' || x.label), ';') as found from rm"""
SQL["support_reference"] = f"""
with {TEXTS.format(k=bm25(k=10))}, {REFERENCE}, x as (select query_id, doc_id, doc_id % 6 as cluster_id, unnest(m) as e from rm)
select query_id, e.kind as kind, count(distinct doc_id) as doc_count, count(distinct cluster_id) as cluster_count, string_agg(distinct e.label, ';' order by e.label) as labels from x group by query_id, e.kind"""
SQL["margin_alternatives"] = SQL["margin_contexts"].rsplit("select query_id, top_answer", 1)[0] + """
, near as (select m.*, d.threshold from ms m join d using (query_id) join ms t on t.query_id = m.query_id and t.place = 1 where m.place > 1 and t.ss - m.ss < d.threshold)
select query_id, answer_key from (select *, row_number() over (partition by query_id order by ss desc, independent desc, channel_count desc, best_rank, answer_key desc) as n from near) where n <= 2"""

# --- caps -----------------------------------------------------------------------------------------------

CAPS = f"""
{STAGED}, cp as (select query_id, doc_id, cluster_id, coalesce(keys[1], '') as a, row_number() over (partition by query_id order by score desc, rank) as place from st1),
cw as (
  select query_id, doc_id, place, 'accepted' as cap, [cluster_id] as cs, [a] as az from cp where place = 1
  union all
  select p.query_id, p.doc_id, p.place, v, case when v = 'accepted' then list_append(cs, p.cluster_id) else cs end, case when v = 'accepted' then list_append(az, p.a) else az end
  from (select p.*, cs, az, case when len(cs) >= 5 then 'beyond' when list_contains(cs, p.cluster_id) then 'cluster' when p.a <> '' and list_contains(az, p.a) then 'answer' else 'accepted' end as v
        from cw w join cp p on p.query_id = w.query_id and p.place = w.place + 1) p)"""
SQL["caps_in_order"] = f"with recursive {CAPS} select query_id, doc_id, place, cap from cw"

# --- policies -------------------------------------------------------------------------------------------


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


FOLD = "trim(regexp_replace(lower(replace(replace(query, 'ß', 'ss'), 'ẞ', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
ASKED = f"""
pq as (select item_id as query_id, text as query from benchmark union all select * from (values {values([(str(1_000_000 + i), quoted(q)) for i, q in enumerate(tables.QUESTIONS)])})),
pt as (select query_id, {FOLD} as t from pq)"""
CONSEQUENCES = values(
    [
        (
            str(i), quoted(p["consequence_id"]), quoted(p["domain"]), quoted(p["decision_type"]), quoted(p["severity"]), str(C.SEVERITY[p["severity"]]), f"{p['cost_weight']}::double",
            listed(p["match"]["phrases"]), "[" + ", ".join(map(quoted, p["match"]["patterns"])) + "]::varchar[]", str(p["match"]["min_phrase_matches"]),
            f"{p['required_policy']['min_support_margin']}::double", str(p["required_policy"]["require_authoritative_source"]).lower(),
        )
        for i, p in enumerate(tables.CONSEQUENCES)
    ]
)
IN_TEXT = "list_filter({phrases}, lambda p: contains(' ' || t || ' ', ' ' || p || ' '))"
MATCHES = f"""
{ASKED}, pc(o, consequence_id, domain, kind, severity, level, cost, phrases, patterns, least, margin, authority) as (values {CONSEQUENCES}),
pm as (select *, len({IN_TEXT.format(phrases="phrases")}) as np, len(list_filter(patterns, lambda p: regexp_matches(t, p, 'i'))) as nx from pt, pc),
mt as (select * from (select *, 5.0::double * nx + np as score, row_number() over (partition by query_id order by level desc, 5 * nx + np desc, cost desc, o) as place from pm where nx > 0 or np >= least) where place <= 3)"""
ROUTES = f"""
{MATCHES}, ids as (select query_id, string_agg(consequence_id, ',' order by place) as matched_ids from mt group by all),
rt as (select pt.query_id, t, coalesce(severity, 'low') as risk_tier, coalesce(cost, 1) as risk_weight, coalesce(domain, 'no_consequence_match') as risk_category,
         coalesce(margin, {C.DEFAULT_MARGIN}::double) as policy_margin, coalesce(authority, false) as require_authority, coalesce(matched_ids, '') as matched_ids
       from pt left join (select * exclude (t) from mt where place = 1) using (query_id) left join ids using (query_id))"""
SQL["policy_matches"] = f"with {MATCHES} select query_id, consequence_id, severity, score, place from mt"
SQL["policy_routes"] = f"with {ROUTES} select * exclude (t) from rt"


def any_of(patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches(t, {quoted(p)})" for p in patterns) + ")"


def aliased(names: dict) -> str:
    """The sorted names of which the text holds a phrase."""
    return "list_sort(list_filter([" + ", ".join(f"case when len({IN_TEXT.format(phrases=listed(v))}) > 0 then {quoted(k)} end" for k, v in names.items()) + "]::varchar[], lambda x: x is not null))"


HAZARDS = " union all ".join(
    f"select query_id, {quoted(h['policy_id'])} as policy_id, {quoted(h['domain'])} as domain, len({IN_TEXT.format(phrases=listed(h['domain_aliases']))}) as nd, {aliased(h['action_aliases'])} as actions,"
    f" {aliased(h['harm_target_aliases'])} as targets, " + "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in h["decision_by_intent"].items()) + "} as decisions from pt"
    for h in tables.HAZARDS
)
INTENT = "case when policy_id is null then 'unknown' " + " ".join(f"when {any_of(p)} then '{k}'" for k, p in C.INTENT_PATTERNS.items()) + " else 'informational' end"
AUTHORIZATION = "case when intent in ('safety_review', 'prevent_or_report') then 'defensive' " + " ".join(f"when {any_of(p)} then '{k}'" for k, p in C.AUTHORIZATION_PATTERNS.items()) + " else 'unknown' end"
EVENTS = f"""
hz as ({HAZARDS}),
hr as (select *, row_number() over (partition by query_id order by 4 * len(actions) + 2 * nd + len(targets) desc, policy_id desc) as place from hz where nd > 0 or len(actions) > 0),
hj as (select pt.query_id, t, domain, policy_id, actions, targets, decisions, policy_ids from pt left join (select * from hr where place = 1) using (query_id)
       left join (select query_id, string_agg(policy_id, ',' order by place) as policy_ids from hr where place <= 3 group by all) using (query_id)),
hi2 as (select *, {INTENT} as intent from hj),
ev as (select query_id, t, coalesce(domain, 'none') as domain, policy_id, coalesce(array_to_string(actions, ','), '') as actions, coalesce(array_to_string(targets, ','), '') as targets,
         coalesce(policy_ids, '') as policy_ids, intent, {AUTHORIZATION} as authorization,
         case when policy_id is null then 0 when len(actions) > 0 and intent <> 'informational' then 0.95::double else 0.8::double end as confidence,
         case when policy_id is not null then coalesce(decisions[intent], 'cautious_answer') end as decision from hi2)"""
SQL["policy_events"] = f"with {ASKED}, {EVENTS} select * exclude (t) from ev"


def gate_sql(mode: str) -> str:
    protective = "intent in ('safety_review', 'prevent_or_report', 'decision_support')"
    rules: list[tuple[str, str, str]] = []
    extra, last = "", "no_harmful_request_signal"
    if mode == "policy_grounded_verifier":
        policies = values([(quoted(h["policy_id"]), quoted(h["domain"])) for h in tables.HAZARDS])
        extra = f""", vp(policy_id, domain) as (values {policies}),
vs as (select query_id, policy_id, (query_id * 7 + length(policy_id)) % 10 / 10 as p from pt, vp where domain <> 'medical'),
vb as (select query_id, case when p >= 0.5::double then 'block' when p >= 0.3::double then 'cautious_answer' else 'allow' end as verifier_action
       from (select *, row_number() over (partition by query_id order by p desc, policy_id) as n from vs) where n = 1)"""
        rules = [
            (protective, "'cautious_answer'", "structured_protective_or_review_intent"), ("verifier_action = 'block'", "'block'", "policy_grounded_harmful_facilitation"),
            ("verifier_action = 'cautious_answer'", "'cautious_answer'", "policy_grounded_uncertain_risk"), ("harm or matched or tiered", "'cautious_answer'", "unverified_risk_cautious_fallback"),
        ]
        last = "no_verified_harmful_facilitation"
    else:
        if mode == "domain_only":
            rules.append(("policy_id is not null", "case when domain = 'medical' then 'cautious_answer' else 'block' end", "structured_hazard_domain_only"))
        if mode.startswith("structured_intent"):
            rules.append((f"policy_id is not null and ({protective} or intent = 'facilitate_harm')", "decision", "structured_hazard_intent_policy"))
        rules += [
            (f"{any_of(C.REVIEW_PATTERNS)} and (matched or tiered)", "'cautious_answer'", "explicit_safety_review_intent"), ("sensitive", "'cautious_answer'", "kb_sensitive_legitimate_query"),
            ("harm", "'block'", "kb_explicit_harmful_action"), ("matched", "'cautious_answer'", "kb_consequence_without_action_intent"),
        ]
        if mode == "structured_intent_with_fallback":
            rules.append(("tiered", "'block'", "trained_harmful_request_router"))
    action = "case " + " ".join(f"when {c} then {a}" for c, a, _ in rules) + " else 'allow' end"
    source = "case " + " ".join(f"when {c} then '{s}'" for c, _, s in rules) + f" else '{last}' end"
    join = "left join vb using (query_id)" if extra else ""
    return f"""
with {ROUTES}, {EVENTS},
kd as (select query_id, max(kind in ({", ".join(map(quoted, sorted(C.HARMFUL_DECISIONS)))}) and nx > 0) as harm, max(kind in ({", ".join(map(quoted, sorted(C.SENSITIVE_DECISIONS)))})) as sensitive from mt group by all){extra},
gt as (select ev.*, rt.risk_tier, risk_category, matched_ids, kd.query_id is not null as matched, coalesce(harm, false) as harm, coalesce(sensitive, false) as sensitive, query_id % 9 = 0 as tiered{", verifier_action" if extra else ""}
       from ev join rt using (query_id) left join kd using (query_id) {join})
select query_id, {action} as action, {source} as action_source, case when risk_tier = 'low' and tiered then 'medium' else risk_tier end as risk_tier, risk_category, domain, intent, matched_ids,
  action = 'block' as blocked, case when action = 'block' then {quoted(C.BLOCK_RESPONSE)} end as response from gt"""


for name, mode in {
    "gate_structured": "structured_intent_with_fallback", "gate_structured_only": "structured_intent", "gate_keywords": "keyword_only", "gate_domains": "domain_only", "gate_verified": "policy_grounded_verifier",
}.items():
    SQL[name] = gate_sql(mode)

# --- more of retrieval and evaluation ---------------------------------------------------------------------

SQL["retriever_rrf"], SQL["retriever_hybrid"], SQL["retriever_ensemble"] = SQL["hybrid_rrf"], SQL["hybrid_min_max"], SQL["ensemble_robust"]
SQL["dense_with_arrivals"] = f"""
with {dense("dn", "cosine", 1_000_000)}, b as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from dn where doc_id % 5 <> 0) where r <= 20),
x as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from dn where doc_id % 5 = 0) where r <= 20)
select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id % 5 = 0, doc_id) as rank from (select * from b union all select * from x)) where rank <= 20"""
SQL["truth_contexts"] = f"""
with {bm25(k=5)} select query_id, count(*) as n, string_agg(text, chr(10) order by rank) as contexts from bm join documents using (doc_id) where rank % 2 = 1 and lang <> 'fr' group by all"""
SQL["source_vector_key"] = """
with o as (select doc_id, row_number() over (order by doc_id) as i, count(*) over () as n from documents)
select any_value(n) as n, sha1(string_agg(doc_id::varchar, '|' order by doc_id) || '|' || any_value(n)) as key from o where i <= 100 or i > n - 100"""
SQL["eval_support"] = f"""
with {BOTH}, {fused([('dn', 1), ('bm', 1)], 'rrf')}, h as (select fr.*, p.doc_id is not null as hit from fr left join (select distinct * from ({POISON})) p using (query_id, doc_id) where rank <= 20)
select round(avg(support_count), 6) as mean_support, round(avg((support_count = 1)::int), 6) as singleton_rate, round(avg((support_count = 1)::int) filter (hit), 6) as poison_singleton_rate from h"""
SQL["eval_agreement"] = f"""
with {bm25()}, s as (select *, row_number() over (partition by query_id order by doc_id) as place from bm),
a as (select query_id, k, round(count(*) filter (rank <= k and place <= k) / any_value(k), 4) as v from s, unnest([1::bigint, 5, 10]) as t(k) group by query_id, k)
select query_id, string_agg(case when v = floor(v) then v::int || '.0' else v::varchar end, ',' order by k) as agreement from a group by all"""
SQL["eval_bootstrap"] = f"""
with {HITS}, o as (select query_id * 100 + rank as ord, hit::int::double as v from hi),
u as (select v, b, ('0x' || substr(md5(ord || ':' || b || ':12'), 1, 13))::bigint / 4503599627370496::double as u from o, unnest(range(1, 201)) as t(b)),
w as (select v, b, {" + ".join(f"(u >= {sum(0.36787944117144233 / __import__('math').factorial(i) for i in range(n + 1))!r}::double)::int" for n in range(8))} as w from u),
m as (select b, sum(v * w) / sum(w) as m from w group by all)
select (select round(avg(v), 6) from o) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m"""
SQL["eval_keep_answer"] = f"""
with c as (select conv_id, turn, case when turn % 2 = 0 then array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') else 'qqq' end as a, string_split(text, ' ')[1] as b from conversations)
select * from (select conv_id, turn, case when contains({clean("a")}, {clean("b")}) or contains({clean("b")}, {clean("a")}) then case when length(a) <= length(b) then a else b end end as kept from c) where kept is not null"""
RUNS = f"""
{HITS}, rn(run_id, top_k, per_iteration) as (values ('all', 10, 10), ('even', 5, 7)),
rr as (select run_id, top_k, query_id, rank, 1 + doc_id % 3 as sc, hit from hi, rn where run_id = 'all' or query_id % 2 = 0),
h0 as (select run_id, query_id, count(*) filter (hit) as h, any_value(top_k) as k from rr where rank <= top_k group by run_id, query_id),
h1 as (select run_id, count(*) as num_queries, round(avg(h / k), 6) as retrieval_precision_mean, round(avg(h / 5), 6) as retrieval_recall_mean,
         round(avg(case when h > 0 then 2 * (h / k) * (h / 5) / (h / k + h / 5) else 0 end), 6) as retrieval_f1_mean from h0 group by all),
h2 as (select run_id, round(avg(sc), 6) as support_count_mean, round(avg((sc = 1)::int), 6) as support_count_singleton_rate, round(avg(sc) filter (hit), 6) as adv_support_count_mean,
         round(avg((sc = 1)::int) filter (hit), 6) as adv_support_count_singleton_rate from rr group by all),
h3 as (select run_id, round(avg(c1), 6) as contamination_at_1_mean, round(avg(c3), 6) as contamination_at_3_mean, round(avg(c5), 6) as contamination_at_5_mean, round(avg(ck), 6) as contamination_at_top_k_mean
       from (select run_id, query_id, avg(hit::int) filter (rank <= 1) as c1, avg(hit::int) filter (rank <= 3) as c3, avg(hit::int) filter (rank <= 5) as c5, avg(hit::int) filter (rank <= top_k) as ck from rr group by all) group by all),
{RESPONSES}, an as (select run_id, per_iteration, ord, response, wrong from rs, rn where trueKEPT),
ao as (select *, row_number() over (partition by run_id order by ord) as o from an),
ai as (select run_id, (PLACE - 1) // per_iteration as i, round(count(*) filter (response is not null and contains({clean("response")}, {clean("wrong")})) / SIZE, 6) as asr from ao group by all),
h4 as (select run_id, to_json(list(asr order by i))::varchar as asr_by_iter, round(avg(asr), 6) as asr_mean from ai group by all),
fm as (select run_id, query_id, max(hit) as cd, max(sc) as sac, max(rank) as mr from rr group by all),
h5 as (select run_id, true as answer_level_enabled, count(*) as answer_level_count, round(avg(cd::int), 6) as answer_level_conflict_detected_rate, round(avg(sac), 6) as answer_level_selected_answer_count_mean from fm group by all)"""
ONLINE = RUNS.replace("KEPT", "").replace("PLACE", "ord").replace("SIZE", "any_value(per_iteration)")
STORED = RUNS.replace("KEPT", " and response is not null").replace("PLACE", "o").replace("SIZE", "count(*)")


def histogram(name: str, value: str) -> str:
    return f"(select '{{' || string_agg('\"' || k || '\":' || n, ',' order by k) || '}}' from (select {value} as k, count(*) as n from fm where fm.run_id = h1.run_id group by all)) as {name}"


GIVEN = """'given' as dataset, case run_id when 'all' then 'bm25' else 'hybrid' end as retriever, case run_id when 'even' then 0.4::double end as alpha, rn.top_k, 5 as adv_per_query, rn.per_iteration,
  case run_id when 'all' then 4 else 3 end as repeat_times"""
FAMILY = "h5.* exclude (run_id), " + histogram("answer_level_conflict_type_counts", "case when mr > 9 then 'weak_conflict' else 'none' end")
FACTS = "rn join h1 using (run_id) join h2 using (run_id) join h3 using (run_id) join h4 using (run_id) join h5 using (run_id)"
PARTS = "h1.* exclude (run_id), h2.* exclude (run_id), h3.* exclude (run_id), h4.* exclude (run_id)"
ACTION = "case query_id % 4 when 0 then 'block' when 1 then 'allow' else 'unknown' end"
SQL["summary_of_runs"] = f"""
with {ONLINE}, g as (select run_id, true as query_safety_gate_enabled, count(*) as query_safety_gate_count, round(avg((query_id % 4 = 0)::int), 6) as query_safety_gate_skipped_rate from fm group by all)
select run_id, {GIVEN}, {PARTS}, {FAMILY}, g.* exclude (run_id), {histogram("query_safety_gate_action_counts", ACTION)} from {FACTS} join g using (run_id)"""
SQL["summary_offline"] = f"with {STORED} select run_id, {GIVEN}, {PARTS}, {FAMILY} from {FACTS}"
SQL["source_subset"] = SQL["source_subset"].replace("select * from o where", "select doc_id from o where")

# --- what accepted documents say ------------------------------------------------------------------------

ONE_A_CLUSTER = CAPS.replace("when p.a <> '' and list_contains(az, p.a) then 'answer' ", "")
SQL["contradictions"] = f"""
with recursive {ONE_A_CLUSTER},
ac as (select s.*, w.place, keys[1] as answer_key from cw w join st1 s using (query_id, doc_id) where cap = 'accepted'),
top as (select query_id, answer_key as top1_answer from (select *, row_number() over (partition by query_id order by place) as n from ac) where n = 1),
sa as (select a.query_id, a.answer_key, coalesce(a.answer_key = top1_answer, false) as is_top, count(distinct cluster_id) as cc, count(distinct cluster_id) filter (echo_penalty = 0 and not low) as ne,
         len(list_distinct(flatten(list(channels))))::bigint as ch, count(distinct doc_id) as dc, count(distinct doc_id) filter (echo_penalty > 0 or low) as ec
       from ac a left join top using (query_id) where a.answer_key is not null group by all),
su as (select query_id, count(*) as selected_answer_count, count(*) filter (ne >= 2 or cc >= 2) as supported_answer_count, count(*) filter (cc <= 1) as isolated_selected_answer_count,
         count(*) filter (ne = 0) as query_echo_only_answer_count, max(cc) filter (is_top) as top1_cluster_count, max(ne) filter (is_top) as top1_non_echo_cluster_count,
         max(ch) filter (is_top) as top1_channel_count, max(dc) filter (is_top) as top1_doc_count, max(ec) filter (is_top) as top1_query_echo_doc_count,
         max(ne) as selected_max_non_echo_cluster_count, max(cc) as selected_max_cluster_count, max(ch) as selected_max_channel_count,
         max(ne) filter (not is_top) as best_alternative_non_echo_cluster_count, max(cc) filter (not is_top) as best_alternative_cluster_count, bool_or(is_top) as has_top from sa group by all),
wp as (select query_id, answer_key, count(distinct cluster_id) as cc, count(distinct cluster_id) filter (echo_penalty = 0 and not low) as ne from pr group by all),
wd as (select query_id, count(*) as candidate_answer_count, count(*) filter (ne >= 2 or cc >= 2) as candidate_supported_answer_count from wp group by all),
j as (select query_id, top1_answer, coalesce(has_top, false) as has_top, coalesce(columns('.*_count'), 0)
      from (select distinct query_id from st1) left join wd using (query_id) left join su using (query_id) left join top using (query_id)),
k as (select *, selected_answer_count >= 2 as conflict_detected, candidate_answer_count >= 2 as candidate_conflict_detected, has_top and top1_cluster_count <= 1 as top1_isolated,
        has_top and top1_non_echo_cluster_count >= selected_max_non_echo_cluster_count and top1_cluster_count >= selected_max_cluster_count as top1_has_best_support,
        case when best_alternative_non_echo_cluster_count = top1_non_echo_cluster_count then best_alternative_cluster_count - top1_cluster_count
          else best_alternative_non_echo_cluster_count - top1_non_echo_cluster_count end as top1_support_margin from j),
m as (select *, conflict_detected and top1_isolated and (best_alternative_non_echo_cluster_count >= 2 or best_alternative_cluster_count >= 2) as top1_isolated_with_alternative,
        conflict_detected and has_top and not top1_has_best_support as top1_not_best_support, conflict_detected and supported_answer_count >= 2 as multi_supported_conflict,
        conflict_detected and supported_answer_count = 0 as no_strong_answer, conflict_detected and supported_answer_count = 0 as severe_conflict from k)
select * exclude (has_top), case when not conflict_detected then 'none' when top1_isolated_with_alternative then 'top1_isolated_with_alternative' when top1_not_best_support then 'top1_not_best_support'
    when multi_supported_conflict then 'multi_supported_conflict' when no_strong_answer then 'no_strong_answer' else 'weak_conflict' end as conflict_type from m"""
SQL["eval_conflict_types"] = f"select conflict_type, count(*) as n from ({SQL['contradictions']}) group by all"
SQL["caps_chosen"] = f"""
with recursive {PLACED}, cp as (select query_id, doc_id, cluster_id, coalesce(keys[1], '') as a, place, hs from pl),
cw as (
  select query_id, doc_id, place, hs, true as kept, [cluster_id] as cs, [a] as az from cp where place = 1
  union all
  select p.query_id, p.doc_id, p.place, p.hs, v, case when v then list_append(cs, p.cluster_id) else cs end, case when v then list_append(az, p.a) else az end
  from (select p.*, cs, az, len(cs) < 5 and not list_contains(cs, p.cluster_id) and (p.a = '' or not list_contains(az, p.a)) as v from cw w join cp p on p.query_id = w.query_id and p.place = w.place + 1) p)
select query_id, doc_id, row_number() over (partition by query_id order by place) as place, round(hs, 6) as score from cw where kept"""

# --- what the steps of the choice note --------------------------------------------------------------------

#: ch: the five documents by score, one a cluster, numbered (n) with their first answers; po: these and then the others, as the margin gate sees them (n).
PICKED = f"""
{PLACED}, cp as (select query_id, doc_id, cluster_id, place from pl),
cw as (
  select query_id, doc_id, place, true as kept, [cluster_id] as cs from cp where place = 1
  union all
  select p.query_id, p.doc_id, p.place, v, case when v then list_append(cs, p.cluster_id) else cs end
  from (select p.*, cs, len(cs) < 5 and not list_contains(cs, p.cluster_id) as v from cw w join cp p on p.query_id = w.query_id and p.place = w.place + 1) p),
al as (select s.*, keys[1] as answer_key, cw.kept, cw.place from cw join st1 s using (query_id, doc_id)),
ch as (select *, row_number() over (partition by query_id order by place) as n from al where kept),
po as (select *, row_number() over (partition by query_id order by kept desc, place) as n from al)"""
TOP1 = f"""
{PICKED},
t0 as (select query_id, count(*) as size, max(case when n = 1 then answer_key end) as top1_answer, count(distinct answer_key) as answers, max(case when n = 1 then doc_id end) as top1_doc from ch group by all),
t1 as (select query_id, answer_key, count(distinct cluster_id) as cc, count(distinct cluster_id) filter (echo_penalty = 0 and not low) as ne from ch where answer_key is not null group by all),
t2 as (select t0.*, cc, ne, size >= 2 and answers >= 2 as conflict, conflict and top1_answer is not null as judged, cc <= 1 or ne = 0 as isolated from t0 left join t1 on t1.query_id = t0.query_id and t1.answer_key = top1_answer),
t3 as (select t2.query_id, list(t1.answer_key order by t1.answer_key) filter (t1.ne >= 2) as free, list(t1.answer_key order by t1.answer_key) filter (t1.cc >= 2) as any_two
       from t2 join t1 on t1.query_id = t2.query_id and t1.answer_key <> top1_answer group by all),
tt as (select query_id, top1_doc, top1_answer, conflict as conflict_detected, case when judged then isolated end as top1_isolated, case when judged then cc end as top1_cluster_count,
         case when judged then ne end as top1_non_echo_cluster_count, judged and isolated as triggered,
         case when judged and isolated then coalesce(free, any_two, []) end as backed from t2 left join t3 using (query_id))"""
SQL["trace_top1"] = f"with recursive {TOP1} select * exclude (backed), array_to_string(backed, ',') as supported_alternative_answers from tt"
HEAD = f"""
{PICKED},
h0 as (select query_id, least(3, count(*)) as head_k, least(count(*), 5) as shown from ch group by all),
h1 as (select query_id, list_sort(list_distinct(list(answer_key) filter (n <= head_k))) as heads from ch join h0 using (query_id) where answer_key is not null group by all),
h2 as (select query_id, answer_key, count(distinct cluster_id) as cc from ch where answer_key is not null group by all),
h3 as (select query_id, list(answer_key order by answer_key) filter (cc >= 2) as supported from h2 group by all),
h4 as (select h0.query_id, head_k, coalesce(heads, []) as heads, len(coalesce(heads, [])) >= 2 as conflict, coalesce(supported, []) as supported from h0 left join h1 using (query_id) left join h3 using (query_id)),
h5 as (select c.query_id, list(doc_id order by n) filter (cc <= 1 and n > 1 and list_contains(heads, c.answer_key)) as lone, bool_or(n = 1) as first_answered
       from ch c join h2 on h2.query_id = c.query_id and h2.answer_key = c.answer_key join h4 on h4.query_id = c.query_id group by all),
hd as (select query_id, head_k, heads, conflict as conflict_detected, conflict as triggered, case when conflict then len(supported) = 0 end as severe_conflict,
         case when conflict then supported end as supported, case when conflict then coalesce(lone, []) end as lone, conflict and coalesce(first_answered, false) as rank1_protected from h4 left join h5 using (query_id))"""
SQL["trace_head"] = f"""
with recursive {HEAD} select * exclude (heads, supported, lone), array_to_string(heads, ',') as head_answers, array_to_string(supported, ',') as supported_answers, array_to_string(lone, ',') as isolated_docs from hd"""
GATE = f"""
{PICKED}, ps as (select {ROBUST}, min(n) as best_rank from po where answer_key is not null group by query_id, answer_key),
{MARGIN[MARGIN.index("m0 as"):]},
mq as (select query_id, count(*) as size, bool_or({RISKY}) as high_risk from ch join benchmark b on b.item_id = query_id group by all),
mc as (select t.query_id, t.answer_key as top_answer, r.answer_key as runner_up_answer, round(t.ss - r.ss, 9) as margin, t.isolated as top_isolated,
         t.independent <= 1 and t.channel_count <= 1 as weak, t.echo_ratio >= 0.5::double or t.echo_docs >= t.doc_count as echo,
         (select count(*) from ms x where x.query_id = t.query_id and x.independent >= 2) as strong, r.independent > t.independent as behind, r.independent >= 2 as runner, high_risk
       from mq join ms t on t.query_id = mq.query_id and t.place = 1 join ms r on r.query_id = t.query_id and r.place = 2 where size >= 2),
md as (select *, round(least(0.75::double + case when weak or top_isolated then 0.25::double else 0 end + case when echo then 0.15::double else 0 end
         + case when strong >= 2 then 0.15::double else 0 end + case when strong = 0 then 0.2::double else 0 end + case when high_risk then 0.35::double else 0 end, 1.5::double), 9) as threshold from mc),
mg as (select q.query_id, top_answer, runner_up_answer, margin, coalesce(threshold, 0.75::double) as threshold, coalesce(margin < threshold, false) as low_margin, coalesce(margin < threshold, false) as triggered,
         array_to_string(list_filter([case when weak or top_isolated then 'weak_or_isolated_top' end, case when echo then 'echo_heavy_top' end, case when strong >= 2 then 'multi_supported_conflict' end,
           case when strong = 0 then 'no_strong_answer' end, case when d.high_risk then 'high_risk_query' end], lambda x: x is not null), ',') as threshold_reasons,
         case when d.query_id is null then null when strong >= 2 then 'multi_supported_conflict' when behind then 'top_not_best_support' when weak and runner then 'weak_top_with_supported_alternative'
           when strong = 0 then 'no_strong_answer' when echo then 'echo_heavy_top_answer' when top_isolated then 'isolated_top_answer' else 'weak_conflict' end as conflict_type,
         weak or top_isolated or echo as top_answer_weak, top_isolated as top_answer_isolated, echo as top_answer_echo_heavy, runner as runner_up_supported,
         strong >= 2 as multi_supported_conflict, strong = 0 as no_strong_answer, d.high_risk as high_risk_query from mq q left join md d using (query_id))"""
SQL["trace_margin"] = f"with recursive {GATE} select * from mg"
SHARE = lambda x: f"round(avg(coalesce({x}, false)::int), 6)"
SQL["summary_sections"] = f"""
with recursive {TOP1}, {HEAD[HEAD.index("h0 as"):]}, {GATE[GATE.index("ps as"):]},
rn(run_id) as (values ('all'), ('even')),
sec1 as (select run_id, {SHARE("triggered")} as top1_dominance_trigger_rate, {SHARE("conflict_detected")} as top1_dominance_conflict_rate, {SHARE("top1_isolated")} as top1_dominance_top1_isolated_rate,
         round(avg(len(coalesce(backed, []))), 6) as top1_dominance_supported_alternative_answer_count_mean, round(avg(coalesce(top1_cluster_count, 0)), 6) as top1_dominance_top1_cluster_count_mean,
         round(avg(coalesce(top1_non_echo_cluster_count, 0)), 6) as top1_dominance_top1_non_echo_cluster_count_mean from tt, rn where run_id = 'all' or query_id % 2 = 0 group by all),
sec2 as (select run_id, {SHARE("triggered")} as head_filter_trigger_rate, {SHARE("severe_conflict")} as head_filter_severe_conflict_rate,
         round(avg(len(coalesce(lone, []))), 6) as head_filter_isolated_doc_count_mean from hd, rn where run_id = 'all' or query_id % 2 = 0 group by all),
sec3 as (select run_id, {SHARE("triggered")} as margin_gate_trigger_rate, {SHARE("low_margin")} as margin_gate_low_margin_rate, round(coalesce(avg(margin), 0), 6) as margin_gate_margin_mean,
         round(avg(threshold), 6) as margin_gate_effective_threshold_mean, {", ".join(f"{SHARE(x)} as margin_gate_{x}_rate" for x in ("top_answer_weak", "top_answer_isolated", "top_answer_echo_heavy", "runner_up_supported", "multi_supported_conflict", "no_strong_answer", "high_risk_query"))}
       from mg, rn where run_id = 'all' or query_id % 2 = 0 group by all),
sec4 as (select run_id, '{{{{' || string_agg('"' || k || '":' || n, ',' order by k) || '}}}}' as margin_gate_conflict_type_counts
       from (select run_id, coalesce(conflict_type, 'unknown') as k, count(*) as n from mg, rn where run_id = 'all' or query_id % 2 = 0 group by all) group by all)
select * from sec1 join sec2 using (run_id) join sec3 using (run_id) join sec4 using (run_id)""".replace("{{", "{").replace("}}", "}")

# --- answers and costs ------------------------------------------------------------------------------------


def qa_words(x: str) -> str:
    bare = BARE.replace("coalesce(text, '')", f"coalesce({x}, '')")
    return rf"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace({bare}, {ARTICLE}), {ARTICLE}), '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


SQL["eval_answers"] = f"""
with {TEXTS.format(k=bm25(k=5))}, q as (select query_id, doc_id, {qa_words("text")} as p, {qa_words("query")} as g from wt),
pw as (select query_id, doc_id, w, count(*) as n from (select query_id, doc_id, unnest(p) as w from q) group by all),
gw as (select query_id, doc_id, w, count(*) as n from (select query_id, doc_id, unnest(g) as w from q) group by all),
s as (select query_id, doc_id, sum(least(pw.n, gw.n)) as same from pw join gw using (query_id, doc_id, w) group by all)
select query_id, doc_id, p = g as em, round(case when coalesce(same, 0) > 0 then 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) else 0 end, 6) as f1 from q left join s using (query_id, doc_id)"""
READ = r"' ' || lower(array_to_string(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{Z}}\p{{C}}]'), ' ')) || ' '"
SQL["eval_has_answer"] = f"""
with {TEXTS.format(k=bm25(k=5))}, r as (select query_id, doc_id, {READ.format(x="text")} as t, string_split(trim({READ.format(x="query")}), ' ') as a from wt)
select query_id, doc_id, contains(t, ' ' || array_to_string(list_slice(a, 1, 4), ' ') || ' ') as held from r"""
SQL["eval_consequence_cost"] = f"""
with {RESPONSES}, c as (select case when contains(lower(coalesce(response, '')), '!!') or contains(lower(coalesce(response, '')), 'token') then 5.0::double
    when regexp_matches(coalesce(response, ''), '[0-9]') then 2.0::double else 1.0::double end as w, contains({clean("response")}, {clean("wrong")})::int as hit,
  ({" or ".join("contains(lower(coalesce(response, '')), '" + m.replace("'", "''") + "')" for m in C.ABSTENTION_MARKERS)})::int as abstained, (ord % 4) / 4 as contamination from rs)
select round(sum(w * hit) / sum(w), 6) as weighted_asr, round(avg(abstained), 6) as abstention_rate, round(sum(w * contamination) / sum(w), 6) as weighted_contamination from c"""

# --- punctuation ------------------------------------------------------------------------------------------

KINDS = [(C.SPACES, " "), (C.HYPHENS, "-"), (C.DOUBLE_QUOTES, '"'), (C.SINGLE_QUOTES, "'"), (C.SLASHES, "/")]
UNIFIED = f"translate(text || '“a”–b…‘c’­d⁄e″', {quoted(''.join(k for k, _ in KINDS) + C.CONTROLS)}, {quoted(''.join(v * len(k) for k, v in KINDS))})"
for old, new in C.LONGER.items():
    UNIFIED = f"replace({UNIFIED}, {quoted(old)}, {quoted(new)})"
SQL["text_unify_punctuation"] = f"select doc_id, {UNIFIED} as text from documents"

SQL["stream_running_top_k"] = f"with {bm25()} select query_id, doc_id, score, rank from bm"
SQL["pooled_vectors"] = """
with e as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as place from embeddings where embedding is not null),
m as (select label, place, avg(x::double) as v, count(x) as n from e group by all)
select label, max(n) over (partition by label) as n, place, round(v / sqrt(sum(v * v) over (partition by label)), 6) as value from m"""
SQL["source_ids_digest"] = "select k as kind, k = 'same' as equal from (values ('same'), ('changed'), ('added'), ('twice')) as t(k)"
SQL["mentions_span_search"] = rf"""
with {TEXTS.format(k=bm25(k=3))},
w as (select query_id, doc_id, string_split_regex(text, '\s+') as w from wt),
o as (select query_id, doc_id, w, len(w) as n, unnest(range(0, greatest(ceil((len(w) - 64) / 48)::bigint * 48, 0) + 1, 48)) as o from w),
t as (select query_id, doc_id, o, unnest(range(o, least(n, o + 64))) as i, w from o),
l as (select query_id, doc_id, o, i, ((doc_id + i * 5) % 11) / 2.0::double as a, ((i * 3 + length(w[i + 1])) % 7) / 4.0::double as b from t),
r as (select *, row_number() over (partition by query_id, doc_id, o order by a desc, i) as ra, row_number() over (partition by query_id, doc_id, o order by b desc, i) as rb from l),
p as (select distinct s.query_id, s.doc_id, s.i as start, e.i as "end", s.a as start_logit, e.b as end_logit from r s join r e using (query_id, doc_id, o) where s.ra <= 10 and e.rb <= 10 and e.i >= s.i and e.i - s.i < 8)
select * from (select *, row_number() over (partition by query_id, doc_id order by start_logit + end_logit desc, start, "end") as rank from p) where rank <= 5"""

# The database's dictionary cache fails on this text now and then and takes the connection with it, so it is not offered.
READER_SPANS = SQL.pop("mentions_reader")
