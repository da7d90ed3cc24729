"""The choice of documents after scoring, one call a query: rank guard, caps, lone answers, margins, head and greedy filling.

What these steps decide depends on what the step before left, so each query's candidates (at most
the retrieval depth) go through all of them in one grouped call, from one table and without joins.
A step takes a list of candidates in order and gives back a list; a candidate is a Row, whose score
steps may change. A step may be given a dictionary, in which it notes what it has seen and done.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import constants as C
from gristmill.functions import text as T
from gristmill.operators.score import MarginConfig

DIGITS = 9


@dataclass
class Row:
    doc: object
    rank: int
    score: float
    cluster: int
    keys: list[str]
    channels: list[str]
    echo: float
    low: bool
    flags: set = field(default_factory=set)
    gain: float | None = None

    @property
    def answer(self) -> str | None:
        return self.keys[0] if self.keys else None

    def add(self, change: float) -> None:
        self.score = round(self.score + change, DIGITS)


@dataclass(frozen=True)
class GuardConfig:
    top_n: int = 1
    min_margin: float = 0.002
    most_rank: int = 20
    min_clusters: int = 1


@dataclass(frozen=True)
class Top1Config:
    window: int = 5
    min_conflict: int = 2
    isolated_clusters: int = 1
    alternative_clusters: int = 2
    penalty: float = 0.025
    bonus: float = 0.006
    echo_extra: float = 0.008
    supplement_rank: int = 5


@dataclass(frozen=True)
class MarginGateConfig:
    window: int = 10
    penalty: float = 0.02
    bonus: float = 0.012
    supplement: float = 0.012
    echo_extra: float = 0.006
    low_extra: float = 0.006
    first_supplement: int = 4
    last_supplement: int = 10
    only_if_weak: bool = True
    keep_if_no_alternative: bool = True
    keep_if_clean: bool = False
    abstain: bool = False
    context: MarginConfig = MarginConfig()


@dataclass(frozen=True)
class HeadConfig:
    conservative: bool = True
    head: int = 3
    supplement: int = 2
    min_conflict: int = 2
    supported_clusters: int = 2
    isolated_penalty: float = 0.02
    supported_bonus: float = 0.01
    supplement_bonus: float = 0.012
    protect_first: bool = True
    new_answers: bool = False
    supplement_rank: int = 3
    abstain: bool = False


@dataclass(frozen=True)
class GreedyConfig:
    pool: int = 10
    per_cluster: int = 1
    per_answer: int = 0
    echo_docs: int = 1
    cluster_penalty: float = 0.025
    answer_penalty: float = 0.008
    echo_penalty: float = 0.02
    low_margin_penalty: float = 0.012
    isolated_penalty: float = 0.025
    support_bonus: float = 0.006
    channel_bonus: float = 0.002
    new_cluster_bonus: float = 0.004
    min_gain: float = -1e9
    min_conflict: int = 2


@dataclass(frozen=True)
class ChooseConfig:
    per_cluster: int = 1
    per_answer: int = 0
    guard: GuardConfig | None = None
    top1: Top1Config | None = None
    margin: MarginGateConfig | None = None
    head: HeadConfig | None = None
    greedy: GreedyConfig | None = None


# --- what stands behind the answers --------------------------------------------------------------


class Standing:
    """One answer's documents by their first mention."""

    def __init__(self, answer: str):
        self.answer, self.rows, self.places = answer, [], []

    def take(self, row: Row, place: int) -> None:
        self.rows.append(row)
        self.places.append(place)

    def clusters(self, free: bool = False) -> int:
        return len({r.cluster for r in self.rows if not free or not (r.echo > 0 or r.low)})

    @property
    def channels(self) -> int:
        return len({c for r in self.rows for c in r.channels})

    @property
    def echoes(self) -> int:
        return sum(r.echo > 0 or r.low for r in self.rows)

    @property
    def independent(self) -> int:
        return self.clusters(free=True) or self.clusters()

    @property
    def isolated(self) -> bool:
        return self.clusters() <= 1


def standings(rows: list[Row]) -> dict[str, Standing]:
    out: dict[str, Standing] = {}
    for place, row in enumerate(rows, 1):
        if row.answer:
            out.setdefault(row.answer, Standing(row.answer)).take(row, place)
    return out


def ranked_answers(rows: list[Row], cluster=1.0, channel=0.25, echo=0.75, isolated=0.5, conflict=0.25) -> list[tuple[float, Standing]]:
    """(support score, standing) of the answers, best first."""
    found = list(standings(rows).values())
    most = max((s.independent for s in found), default=0)

    def score(s: Standing) -> float:
        own = cluster * s.independent + channel * max(0, s.channels - 1)
        return round(own - echo * s.echoes / len(s.rows) - isolated * s.isolated - conflict * (most - s.independent), DIGITS)

    scored = [(score(s), s) for s in found]
    return sorted(scored, key=lambda x: (-x[0], -x[1].independent, -x[1].clusters(), -x[1].channels, x[1].places[0], x[1].answer))


# --- steps ---------------------------------------------------------------------------------------


def ids(rows) -> list:
    return [r.doc for r in rows]


def guarded(order: list[Row], c: GuardConfig, note: dict | None = None) -> list[Row]:
    """Originally first documents come back in front of those that took their place without good reason.

    A good reason is a lead of min_margin, an original rank up to most_rank and a first answer that
    any mention backs in min_clusters clusters. Each one turned down moves the original to the very front.
    """
    backing: dict[str, set] = {}
    for row in order:
        for key in row.keys:
            backing.setdefault(key, set()).add(row.cluster)
    head, blocked = sorted(order, key=lambda r: r.rank)[: c.top_n], []
    for place, original in enumerate(head):
        now = order[place]
        if now is original:
            continue
        lead = round(now.score - original.score, DIGITS)
        if lead < c.min_margin or now.rank > c.most_rank or len(backing.get(now.answer, ())) < c.min_clusters:
            now.flags.add("guard_blocked")
            blocked.append(now)
            order = [original] + [r for r in order if r is not original]
    if note is not None:
        note.update(blocked=ids(blocked), original_head=ids(head), final_head=ids(order[: c.top_n]))
    return order


def capped(order: list[Row], k: int, per_cluster: int, per_answer: int, note: dict | None = None) -> list[Row]:
    """The first k that neither cap turns down; what one cap turns down does not count for the other."""
    clusters: dict[int, int] = {}
    answers: dict[str, int] = {}
    out: list[Row] = []
    refused: dict[str, list] = {"by_cluster": [], "by_answer": []}
    for row in order:
        if len(out) == k:
            break
        if per_cluster and clusters.get(row.cluster, 0) >= per_cluster:
            refused["by_cluster"].append(row.doc)
            continue
        if per_answer and row.answer and answers.get(row.answer, 0) >= per_answer:
            refused["by_answer"].append(row.doc)
            continue
        out.append(row)
        clusters[row.cluster] = clusters.get(row.cluster, 0) + 1
        if row.answer:
            answers[row.answer] = answers.get(row.answer, 0) + 1
    if note is not None:
        note.update(refused)
    return out


def held_back(order: list[Row], head: list[Row], floor: int) -> list[Row]:
    """Rows outside the head that would come before place ``floor`` wait until it."""
    if floor <= 0:
        return order
    early = [r for r in order[: floor - 1] if not any(r is h for h in head)]
    rest = [r for r in order if not any(r is e for e in early)]
    return rest[: floor - 1] + early + rest[floor - 1 :]


def by_change(rows: list[Row], change: list[float]) -> list[Row]:
    """Rows by score and change, earlier first at ties; scores themselves stay."""
    return [rows[i] for i in sorted(range(len(rows)), key=lambda i: (-round(rows[i].score + change[i], DIGITS), i))]


def without_lone_top(chosen: list[Row], k: int, c: Top1Config, note: dict | None = None) -> list[Row]:
    """A first answer that stands alone among others loses score and place; others' bonus only orders them."""
    note = {} if note is None else note
    note.update(triggered=False, order_changed=False, top1_doc=chosen[0].doc if chosen else None, top1_answer=chosen[0].answer if chosen else None, conflict_detected=False)
    rows = chosen[: min(len(chosen), k, max(2, c.window))]
    found = standings(rows)
    if len(rows) < 2:
        return chosen[:k]
    note.update(conflict_detected=len(found) >= c.min_conflict)
    if len(found) < c.min_conflict or not rows[0].answer:
        return chosen[:k]
    top = found[rows[0].answer]
    isolated = top.clusters() <= c.isolated_clusters or top.clusters(free=True) == 0
    note.update(top1_cluster_count=top.clusters(), top1_non_echo_cluster_count=top.clusters(free=True), top1_isolated=isolated)
    if not isolated:
        return chosen[:k]
    others = [s for s in found.values() if s is not top]
    backed = {s.answer for s in others if s.clusters(free=True) >= c.alternative_clusters}
    backed = backed or {s.answer for s in others if s.clusters() >= c.alternative_clusters}
    rows[0].add(-c.penalty - (c.echo_extra if rows[0].echo > 0 else 0.0))
    for row in chosen:
        row.flags.add("top1_triggered")
    order = held_back(by_change(rows, [c.bonus if r.answer in backed else 0.0 for r in rows]), rows[:3], c.supplement_rank)
    note.update(
        triggered=True, order_changed=ids(order) != ids(rows), supported_alternative_answers=sorted(backed), penalized=[rows[0].doc],
        promoted=[r.doc for r in order[:3] if not any(r is x for x in rows[:3])], reranked=ids(order),
    )
    return (order + chosen[len(rows) :])[:k]


def pooled(chosen: list[Row], order: list[Row], most: int) -> list[Row]:
    """The chosen, then the others in order, at most ``most``."""
    return (chosen + [r for r in order if not any(r is x for x in chosen)])[:most]


def margin_context(answers: list[tuple[float, Standing]], m: MarginConfig, risky: bool, floor: float, tier: str | None = None) -> dict:
    """What the first answer's lead shows, and the threshold that it must reach and why; see score.margin_context."""
    (best, top), (second, runner) = answers[0], answers[1]
    strong = sum(s.independent >= m.strong_clusters for _, s in answers)
    weak = top.independent <= m.weak_clusters and top.channels <= m.weak_channels
    echo = top.echoes / len(top.rows) >= m.echo_ratio or top.echoes >= len(top.rows)
    supported = runner.independent >= m.strong_clusters
    kinds = (
        ("multi_supported_conflict", strong >= 2), ("top_not_best_support", runner.independent > top.independent), ("weak_top_with_supported_alternative", weak and supported),
        ("no_strong_answer", strong == 0), ("echo_heavy_top_answer", echo), ("isolated_top_answer", top.isolated), ("weak_conflict", True),
    )
    steps = (
        ("weak_or_isolated_top", weak or top.isolated, m.weak_delta), ("echo_heavy_top", echo, m.echo_delta), ("multi_supported_conflict", strong >= 2, m.multi_delta),
        ("no_strong_answer", strong == 0, m.no_strong_delta), ("high_risk_query", risky, m.high_risk_delta),
    )
    taken = [(name, delta) for name, holds, delta in steps if m.dynamic and holds]
    threshold, reasons = m.threshold + sum(delta for _, delta in taken), [name for name, _ in taken]
    if floor > threshold:
        threshold = floor
        reasons.append(f"consequence_policy_{tier or ''}")
    threshold, margin = round(min(threshold, m.max_threshold), DIGITS), round(best - second, DIGITS)
    return {
        "margin": margin, "low_margin": margin < threshold, "threshold": threshold, "threshold_reasons": reasons, "top_answer": top.answer, "runner_up_answer": runner.answer,
        "conflict_type": next(name for name, holds in kinds if holds), "top_answer_weak": weak or top.isolated or echo, "top_answer_isolated": top.isolated,
        "top_answer_echo_heavy": echo, "runner_up_supported": supported, "multi_supported_conflict": strong >= 2, "no_strong_answer": strong == 0, "high_risk_query": risky,
    }


def close_answers(answers: list[tuple[float, Standing]], threshold: float, most: int) -> set[str]:
    """The answers behind the first by less than the threshold, at most ``most``, best first; at ties the greater key."""
    near = [(x, s) for x, s in answers[1:] if answers[0][0] - x < threshold]
    near.sort(key=lambda x: x[1].answer, reverse=True)
    near.sort(key=lambda x: (-x[0], -x[1].independent, -x[1].channels, x[1].places[0]))
    return {s.answer for _, s in near[:most]}


def with_margin(chosen: list[Row], order: list[Row], k: int, config: ChooseConfig, risky: bool, floor: float, tier: str | None = None, note: dict | None = None) -> list[Row]:
    """Chosen anew where the first answer leads by too little: it loses, close answers win, and the caps apply again."""
    c, note = config.margin, {} if note is None else note
    note.update(triggered=False, order_changed=False, low_margin=False, threshold=c.context.threshold, fallback_answered=False, uncertain_recommended=False)
    if len(chosen) < 2:
        return chosen[:k]
    pool = pooled(chosen, order, max(k, c.window))
    answers = ranked_answers(pool)
    note.update(answer_scores=[
        {"answer_key": s.answer, "support_score": x, "independent": s.independent, "cluster_count": s.clusters(), "channel_count": s.channels, "doc_count": len(s.rows), "echo_docs": s.echoes, "isolated": s.isolated, "best_rank": s.places[0]}
        for x, s in answers[:12]
    ])
    if len(answers) < c.context.min_conflict:
        return chosen[:k]
    context = margin_context(answers, c.context, risky, floor, tier)
    note.update(context)
    if not context["low_margin"]:
        return chosen[:k]
    if c.keep_if_clean and not (context["top_answer_echo_heavy"] or context["top_answer_isolated"] or context["no_strong_answer"]):
        note.update(fallback_answered=True)
        return chosen[:k]
    top, close = answers[0][1].answer, close_answers(answers, context["threshold"], c.context.alternatives)
    punish = context["top_answer_weak"] or context["multi_supported_conflict"] or context["no_strong_answer"] or not c.only_if_weak
    punish = punish and (bool(close) or not c.keep_if_no_alternative)
    moved: dict[str, list] = {"penalized": [], "boosted": [], "supplement_promoted": []}
    for row in pool:
        if row.answer == top and punish:
            row.add(-c.penalty - (c.echo_extra if row.echo > 0 else 0.0) - (c.low_extra if row.low else 0.0))
            moved["penalized"].append(row.doc)
        elif row.answer in close:
            late = not any(row is x for x in chosen) and c.first_supplement <= row.rank <= c.last_supplement
            row.add(c.bonus + (c.supplement if late else 0.0))
            moved["boosted"].append(row.doc)
            moved["supplement_promoted"] += [row.doc] * late
    for row in order:
        row.flags.add("margin_triggered")
    refused: dict = {}
    out = capped(by_change(pool, [0.0] * len(pool)), k, config.per_cluster, config.per_answer, refused)
    note.update(
        moved, triggered=True, order_changed=ids(chosen[:k]) != ids(out), alternative_answers=sorted(close), filtered_by_cluster=refused["by_cluster"][:20],
        filtered_by_answer=refused["by_answer"][:20], reranked=ids(out), uncertain_recommended=risky and context["no_strong_answer"] and c.abstain,
    )
    return out


def with_head(chosen: list[Row], k: int, c: HeadConfig, risky: bool = False, note: dict | None = None) -> list[Row]:
    """Lone answers of a disputed head move behind; scores themselves stay."""
    note = {} if note is None else note
    head = min(c.head, len(chosen), k)
    rows = chosen[: min(len(chosen), head + c.supplement, k)]
    heads = {r.answer for r in rows[:head] if r.answer}
    note.update(
        triggered=False, order_changed=False, head_k=head, head_answers=sorted(heads), conflict_detected=len(heads) >= c.min_conflict, rank1_protected=False, uncertain_recommended=False, high_risk_query=risky
    )
    if len(heads) < c.min_conflict:
        return chosen[:k]
    found, change = standings(rows), []
    supported = {s.answer for s in found.values() if s.clusters() >= c.supported_clusters}
    isolated, promoted = [], []
    for place, row in enumerate(rows):
        n, own = found[row.answer].clusters() if row.answer else 0, 0.0
        protected = place == 0 and c.conservative and c.protect_first
        if row.answer and n <= 1 and row.answer in heads and not protected:
            own -= c.isolated_penalty
            isolated.append(row.doc)
        elif row.answer and protected:
            note.update(rank1_protected=True)
        if row.answer in supported and not c.conservative:
            own += c.supported_bonus * min(n, c.supported_clusters)
            if place >= head and (c.new_answers or row.answer in heads):
                own += c.supplement_bonus
                promoted.append(row.doc)
        change.append(own)
    order = by_change(rows, change)
    if c.conservative:
        order = held_back([rows[0]] + [r for r in order if r is not rows[0]], rows[:head], c.supplement_rank)
    for row in chosen:
        row.flags.add("head_triggered")
    stats = [
        {"answer_key": s.answer, "doc_count": len(s.rows), "cluster_count": s.clusters(), "head_count": sum(p <= head for p in s.places), "supplement_count": sum(p > head for p in s.places), "ranks": s.places}
        for s in sorted(found.values(), key=lambda s: (-s.clusters(), -len(s.rows), s.places[0]))
    ]
    note.update(
        triggered=True, order_changed=ids(rows) != ids(order), supported_answers=sorted(supported), severe_conflict=not supported, answer_stats=stats,
        isolated_docs=isolated, supplement_promoted=promoted, reranked=ids(order), uncertain_recommended=not supported and risky and c.abstain,
    )
    return (order + chosen[len(rows) :])[:k]


def greedily(chosen: list[Row], order: list[Row], k: int, c: GreedyConfig, note: dict | None = None) -> list[Row]:
    """k documents by greatest marginal gain in turn; what then fits no cap fills up in pool order."""
    note = {} if note is None else note
    note.update(triggered=False, order_changed=False, pool_count=0, original=ids(chosen[:k]), selected=ids(chosen[:k]))
    if len(chosen) < 2:
        return chosen[:k]
    pool = pooled(chosen, order, max(k, c.pool))
    backing = {s.answer: s for _, s in ranked_answers(pool)}
    out: list[Row] = []

    def gain(row: Row) -> tuple[float, list[str]] | None:
        same = sum(r.cluster == row.cluster for r in out)
        again = sum(r.answer == row.answer for r in out) if row.answer else 0
        if (c.per_cluster and same >= c.per_cluster) or (c.per_answer and again >= c.per_answer):
            return None
        value, why = row.score - c.cluster_penalty * same - c.answer_penalty * again, []
        why += ["duplicate_cluster_penalty"] * (same > 0) + ["answer_concentration_penalty"] * (again > 0)
        if row.answer:
            s = backing[row.answer]
            value += c.support_bonus * s.independent + c.channel_bonus * max(0, s.channels - 1) - c.low_margin_penalty * s.isolated
            if row.echo <= 0 and not any(r.answer == row.answer and r.cluster == row.cluster for r in out):
                value += c.new_cluster_bonus
                why.append("new_answer_cluster_bonus")
        echoes = sum(r.echo > 0 for r in out)
        if row.echo > 0 and echoes >= c.echo_docs:
            value -= c.echo_penalty * (echoes - c.echo_docs + 1)
            why.append("query_overlap_concentration_penalty")
        if row.answer and not out and backing[row.answer].isolated and len(backing) >= c.min_conflict:
            value -= c.isolated_penalty
            why.append("isolated_rank1_penalty")
        return (round(value, DIGITS), why) if value >= c.min_gain else None

    left, steps, skipped = list(pool), [], set()
    while left and len(out) < k:
        gains = [gain(row) for row in left]
        skipped.update(row.doc for row, g in zip(left, gains) if g is None)
        found = [(g[0], -i) for i, g in enumerate(gains) if g is not None]
        if not found:
            break
        best, at = max(found)
        row = left.pop(-at)
        row.gain = best
        out.append(row)
        steps.append({"doc": row.doc, "gain": best, "answer": row.answer, "cluster_id": row.cluster, "query_overlap": row.echo > 0, "reasons": gains[-at][1]})
    filled = left[: k - len(out)]
    for row in filled:
        row.flags.add("filled")
        out.append(row)
    clusters = [r.cluster for r in out]
    note.update(
        triggered=True, order_changed=ids(chosen[:k]) != ids(out), pool_count=len(pool), selected=ids(out), skipped=sorted(skipped)[:20], filled=ids(filled),
        query_overlap_selected_count=sum(r.echo > 0 for r in out), duplicate_cluster_selected_count=len(clusters) - len(set(clusters)), selection_steps=steps,
    )
    return out


FLAGS = ("guard_blocked", "top1_triggered", "margin_triggered", "head_triggered", "filled")


#: What each step notes, where ID is the documents' type; a step that is not set up notes nothing.
TRACE = {
    "guard": "blocked array<ID>, original_head array<ID>, final_head array<ID>",
    "caps": "by_cluster array<ID>, by_answer array<ID>",
    "top1": "triggered boolean, order_changed boolean, top1_doc ID, top1_answer string, conflict_detected boolean, top1_isolated boolean, top1_cluster_count int,"
    " top1_non_echo_cluster_count int, supported_alternative_answers array<string>, penalized array<ID>, promoted array<ID>, reranked array<ID>",
    "margin": "triggered boolean, order_changed boolean, low_margin boolean, threshold double, threshold_reasons array<string>, margin double, top_answer string,"
    " runner_up_answer string, conflict_type string, top_answer_weak boolean, top_answer_isolated boolean, top_answer_echo_heavy boolean, runner_up_supported boolean,"
    " multi_supported_conflict boolean, no_strong_answer boolean, high_risk_query boolean, uncertain_recommended boolean, fallback_answered boolean,"
    " alternative_answers array<string>, penalized array<ID>, boosted array<ID>, supplement_promoted array<ID>, filtered_by_cluster array<ID>,"
    " filtered_by_answer array<ID>, reranked array<ID>, answer_scores array<struct<answer_key: string, support_score: double, independent: int, cluster_count: int,"
    " channel_count: int, doc_count: int, echo_docs: int, isolated: boolean, best_rank: int>>",
    "head": "triggered boolean, order_changed boolean, head_k int, conflict_detected boolean, severe_conflict boolean, rank1_protected boolean, uncertain_recommended boolean,"
    " high_risk_query boolean, head_answers array<string>, supported_answers array<string>, isolated_docs array<ID>, supplement_promoted array<ID>, reranked array<ID>,"
    " answer_stats array<struct<answer_key: string, doc_count: int, cluster_count: int, head_count: int, supplement_count: int, ranks: array<int>>>",
    "greedy": "triggered boolean, order_changed boolean, pool_count int, original array<ID>, selected array<ID>, skipped array<ID>, filled array<ID>,"
    " query_overlap_selected_count int, duplicate_cluster_selected_count int, selection_steps array<struct<doc: ID, gain: double, answer: string, cluster_id: int,"
    " query_overlap: boolean, reasons: array<string>>>",
}


def chosen_of(rows: list[Row], k: int, c: ChooseConfig, risky: bool = False, floor: float = 0.0, keyword: bool | None = None, tier: str | None = None) -> tuple[list[Row], dict[str, dict]]:
    """All steps of one query in their order, and what each has noted."""
    notes: dict[str, dict] = {"caps": {}} | {name: {} for name in ("guard", "top1", "margin", "head", "greedy") if getattr(c, name)}
    order = sorted(rows, key=lambda r: (-r.score, r.rank))
    if c.guard:
        order = guarded(order, c.guard, notes["guard"])
    out = capped(order, k, c.per_cluster, c.per_answer, notes["caps"])
    if c.top1:
        out = without_lone_top(out, k, c.top1, notes["top1"])
    if c.margin:
        out = with_margin(out, order, k, c, risky, floor, tier, notes["margin"])
    if c.head:
        out = with_head(out, k, c.head, risky if keyword is None else keyword, notes["head"])
    if c.greedy:
        out = greedily(out, order, k, c.greedy, notes["greedy"])
    return out, notes


def traced(candidates: DataFrame, queries: DataFrame, k: int, c: ChooseConfig = ChooseConfig()) -> DataFrame:
    """query_id, documents (doc_id, place, score, gain and flags, of those to show) and a struct of what each step noted, by TRACE.

    candidates are scored rows with mentions; queries may bring policy_margin (the least threshold
    that a policy asks for), policy_high (in place of the query's own risky words) and policy_tier (its name).
    """
    risky = T.or_(*(F.contains(F.lower(F.coalesce("query", F.lit(""))), F.lit(x)) for x in C.HIGH_RISK_KEYWORDS))
    routed = F.coalesce(F.col("policy_high"), risky) if "policy_high" in queries.columns else risky
    floor = F.coalesce(F.col("policy_margin").cast("double"), F.lit(0.0)) if "policy_margin" in queries.columns else F.lit(0.0)
    tier = F.col("policy_tier") if "policy_tier" in queries.columns else F.lit(None)
    asked = queries.select("query_id", routed.alias("risky"), risky.alias("keyword"), floor.alias("floor"), tier.cast("string").alias("tier"))
    rows = candidates.select(
        "query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.col("cluster_id").cast("int").alias("cluster_id"),
        F.transform("mentions", lambda m: m["key"]).alias("keys"), "channels", F.col("echo_penalty").cast("double").alias("echo"), F.coalesce("low_grounding", F.lit(False)).alias("low"),
    ).join(asked, "query_id")
    q_kind, d_kind = (candidates.schema[x].dataType.simpleString() for x in ("query_id", "doc_id"))
    fields = {name: [f.split(" ")[0] for f in parts_of(kinds)] for name, kinds in TRACE.items()}

    def one(pdf):
        import pandas as pd

        found = [Row(d, r, s, cl, list(ks), list(ch), e, lo) for d, r, s, cl, ks, ch, e, lo in pdf[["doc_id", "rank", "score", "cluster_id", "keys", "channels", "echo", "low"]].itertuples(index=False)]
        first = pdf.iloc[0]
        out, notes = chosen_of(found, k, c, bool(first["risky"]), float(first["floor"]), bool(first["keyword"]), first["tier"])
        shown = [{"doc_id": r.doc, "place": i, "score": r.score, "gain": r.gain} | {f: f in r.flags for f in FLAGS} for i, r in enumerate(out, 1)]
        told = {name: [{f: notes[name].get(f) for f in fields[name]}] if name in notes else [None] for name in TRACE}
        return pd.DataFrame({"query_id": [first["query_id"]], "documents": [shown]} | told)

    flags = ", ".join(f"{f}: boolean" for f in FLAGS)
    kinds = ", ".join(f"{name} struct<{', '.join(f.replace(' ', ': ', 1) for f in parts_of(x.replace('ID', d_kind)))}>" for name, x in TRACE.items())
    return rows.groupBy("query_id").applyInPandas(one, f"query_id {q_kind}, documents array<struct<doc_id: {d_kind}, place: int, score: double, gain: double, {flags}>>, {kinds}")


def parts_of(fields: str) -> list[str]:
    """Field definitions, cut at the commas that stand inside no brackets."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(fields[start:i].strip())
            start = i + 1
    return [*out, fields[start:].strip()]


def shown(trace: DataFrame) -> DataFrame:
    """(query_id, doc_id, place, score, gain, flags...) of the documents to show, place 1 to k, from what ``traced`` gives."""
    return trace.select("query_id", F.explode("documents").alias("d")).select("query_id", "d.*")


def choose(candidates: DataFrame, queries: DataFrame, k: int, c: ChooseConfig = ChooseConfig()) -> DataFrame:
    """The documents of ``traced`` alone."""
    return shown(traced(candidates, queries, k, c))
