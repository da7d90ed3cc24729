"""Personal data: weak labelers' votes weighed by expectation-maximisation, in DataFrame functions throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import Scratch, broadcast_if_few
from gristmill.llm.spans import report

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "iban", "person", "address")

#: The patterns of the base kinds. A match that starts inside a run of its first class would also
#: start at the run's begin, or where the last match ended (\G); saying so keeps long runs linear.
#: Runs of digits with single spaces or hyphens are whole by their begin and end, so only those of 12 to 19 digits are matched at all.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Gazetteers, in the corpus's four languages, for calls that bring no table (list, word) of their own. common
#: given names, cities, mail providers, banks.
NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Thomas Sarah Charles Karen Daniel Nancy"
    " Hans Peter Klaus Jürgen Wolfgang Ursula Monika Petra Sabine Renate Stefan Andreas Anna Lukas Felix"
    " Jean Pierre Michel André Philippe Marie Nathalie Isabelle Sylvie Catherine Nicolas Camille Julien Luc"
    " José Antonio Manuel Francisco Juan Carmen Josefa Isabel Dolores Pilar Luis Carlos Miguel Elena Lucía"
).split()
CITIES = (
    "London Paris Berlin Madrid Boston Chicago Houston Phoenix Dallas Seattle Denver Toronto Dublin Manchester Liverpool Hamburg München Köln Frankfurt"
    " Stuttgart Dresden Leipzig Wien Zürich Bern Lyon Marseille Toulouse Nice Nantes Bordeaux Lille Genève Bruxelles Barcelona Valencia Sevilla Zaragoza Málaga Bilbao Lima Bogotá"
).split()
PROVIDERS = "gmail googlemail yahoo hotmail outlook icloud protonmail gmx web mail posteo orange laposte wanadoo telefonica terra example com org net edu gov io info de fr es it uk eu ch at nl".split()
BANKS = "bank banque banco sparkasse visa mastercard amex maestro paypal volksbank santander barclays".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split()
#: Words that stand in front of a name and are none.
GREETINGS = "Dear Hello Hi Liebe Lieber Hallo Cher Chère Bonjour Querida Querido Hola Signed From By Name The Von Par".split()
LISTS = {"name": [*NAMES, *TITLES], "city": CITIES, "provider": PROVIDERS, "bank": BANKS}
#: Which list speaks for a kind, and whether by words of the span or also by those around it.
ASKED = {"email": ("provider", False), "card": ("bank", True), "iban": ("bank", True), "person": ("name", False), "address": ("city", True)}
WORD = r"\p{Lu}[\p{L}'-]{1,30}"


def one_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


#: Looser forms, which are candidates only: spelled-out addresses, IPv6, national numbers, long digit runs, account numbers, names, streets.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{2,63}+(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
    "account": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?<![\p{{L}}'-])(?:{one_of(TITLES)}\.? (?:{WORD} ){{0,2}}{WORD}|(?!{one_of(GREETINGS)} ){WORD} {WORD})(?!\p{{L}})",
    "address": rf"(?<![0-9])[0-9]{{1,5}}[A-Za-z]? {WORD} (?:Street|Avenue|Road|Lane|Drive|Boulevard)(?!\p{{L}})|{WORD}(?:straße|strasse|weg|platz|gasse|allee) [0-9]{{1,4}}(?![0-9])"
    rf"|(?<![0-9])[0-9]{{1,4}},? (?:rue|avenue|boulevard|place) (?:de la |de |du |des )?{WORD}|(?:Calle|Avenida|Plaza) (?:de la |de |del )?{WORD},? [0-9]{{1,4}}(?![0-9])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {("base", "email"): "@", ("base", "ip"): ".", ("base", "phone"): "+", ("loose", "email"): "at", ("loose", "ip"): ":"}

#: Labelers. Each votes on all candidates of a kind alike, whichever pattern brought them.
#: Structure: what a true one satisfies by its own make (tried on the found text; cards by their check digit).
STRUCTURE = {
    "email": r"(?i)^[a-z0-9][a-z0-9._%+-]*(?:@| ?[\[(] ?at ?[\])] ?| at )[a-z0-9][a-z0-9-]*.*[a-z]{2,}$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|$)){4}|:",
    "phone": r"^(?:[^0-9]*[0-9]){9,15}[^0-9]*$",
    "account": r"^(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
    "iban": r"^(?:DE|FR|ES|IT|NL|GB|CH|AT|BE|IE|PT|LU)[0-9]{2}",
    "person": rf"{WORD} {WORD}",
    "address": r"[0-9]",
}
#: Ranges that a span's own digits are in, beside the lists.
LISTED = {
    "ip": r"^(?!(?:0|10|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|192\.168\.|169\.254\.)",
    "card": r"^[3-6]",
    "phone": r"^(?:\+(?:1|33|34|39|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|\(?[02-9])",
}
#: Kinds whose looser form many harmless numbers and words have: a list or the context must name them.
NAMED = ("email", "phone", "account", "person", "address")
#: Context: words before a span that name its kind, and others that name something else.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|kontakt|courriel|correo|schreib)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|address|host|login|adresse|direcci)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|call|tel\b|tel[.:]|mobile|fax|telefon|anruf|appel|llam)[^\n]{0,24}$",
    "account": r"(?i)(?:card|visa|master|credit|account|karte|konto|carte|compte|tarjeta|cuenta|bank|banque|banco|sparkasse)[^\n]{0,24}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta)[^\n]{0,24}$",
    "person": r"(?iu)(?<!\p{L})(?:name|dear|signed|by|from|von|liebe[rn]?|cher|chère|par|querid[oa])(?!\p{L})[^\n]{0,12}$",
    "address": r"(?i)(?:address|live|adresse|wohn|habite|direcci|vive)[^\n]{0,24}$",
}
ELSE = r"(?i)(?:version|isbn|issn|doi|page|seite|página|order|serial|sku|hash|uuid|chapter|kapitel)[^\n]{0,12}$"
LABELERS = ("structure", "gazetteer", "context", "edges")


#: What is known of a match: which pattern, its place among the pattern's matches, code points since the match before, its own, and 40 to either side.
PIECE = "struct<base: int, rank: int, pos: int, gap: int, size: int, before: string, found: string, after: string>"
AROUND = 40


def pieces(base: int, kind: str, text: str, found: str, gaps: str) -> Column:
    """array<PIECE> from the columns of a pattern's matches and of what lies between; each piece is touched a few times, so time grows with the text."""
    none = F.array(F.lit(""))
    hits, between = F.col(found), F.col(gaps)
    parts = F.arrays_zip(
        hits.alias("hit"), between.alias("gap"), F.concat(none, hits).alias("last_hit"), F.concat(none, between).alias("last_gap"),
        F.slice(between, 2, F.size(between)).alias("next_gap"), F.concat(F.slice(hits, 2, F.size(hits)), none).alias("next_hit"),
    )
    n = F.lit(AROUND)

    def piece(x, i):
        before = F.concat(F.right(x["last_gap"], n), F.right(x["last_hit"], n), F.right(x["gap"], n))
        after = F.concat(F.left(x["next_gap"], n), F.left(x["next_hit"], n))
        return F.struct(
            F.lit(base).alias("base"), F.lit(KINDS.index(kind)).alias("rank"), i.alias("pos"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"),
            F.right(before, n).alias("before"), x["hit"].alias("found"), F.left(after, n).alias("after"),
        )

    # The zipped arrays are longer than the matches: after the last comes what follows it.
    return F.when(F.size(hits) > 0, F.transform(F.slice(parts, 1, F.size(hits)), piece)).otherwise(F.array().cast(f"array<{PIECE}>"))


def digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def passes(kind: str, found: Column) -> Column:
    """The checks that drop a base match."""
    if kind == "ip":
        return ~found.rlike(r"(?:^|\.)0*+(?:[1-9][0-9]{3}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])")
    if kind == "card":
        number = digits(found)
        # The characters in reverse; every second counts double, less nine above nine.
        doubled = F.transform(
            F.split(F.reverse(number), ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
        )
        total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
        return F.when(F.length(number).between(12, 19), total % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def checks_as_iban(found: Column) -> Column:
    """Country, check digits and the rest leave 1 by 97, the first four characters read last and letters as two digits."""
    bare = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    left = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return left == 1


def of_kind(each) -> Column:
    """each(kind) for the kind that a row's rank names."""
    out = F.when(F.col("rank") == 0, each(KINDS[0]))
    for i, kind in enumerate(KINDS[1:], 1):
        out = out.when(F.col("rank") == i, each(kind))
    return out


def structure(kind: str) -> Column:
    found = F.col("found")
    if kind == "card":
        return passes("card", found)
    return checks_as_iban(found) if kind == "iban" else found.rlike(STRUCTURE[kind])


def votes() -> list[Column]:
    """Each labeler's vote on a span: 1, 0 or -1 (no opinion). Every labeler votes on all spans of a kind alike."""
    found, before, around = F.col("found"), F.col("before"), F.concat(F.right("before", F.lit(1)), F.left("after", F.lit(1)))
    ranges = of_kind(lambda k: found.rlike(LISTED[k]) if k in LISTED else F.lit(False))
    opinion = F.col("rank").isin([i for i, k in enumerate(KINDS) if k in LISTED or k in ASKED])
    context = of_kind(lambda k: F.when(before.rlike(CONTEXT[k]), 1).when(before.rlike(ELSE), 0).otherwise(-1))
    all_votes = (
        F.when(of_kind(structure), 1).otherwise(0), F.when(F.col("named") | ranges, 1).when(opinion, 0).otherwise(-1), context, F.when(around.rlike(r"[A-Za-z0-9_@]"), 0).otherwise(1)
    )
    return [x.cast("int").alias(name) for x, name in zip(all_votes, LABELERS)]


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id and all pieces of a text; a text that a pattern does not match is searched by it once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    both = [(base, kind, p, NEEDS.get((group, kind), "")) for base, group, patterns in ((1, "base", BASE), (0, "loose", LOOSE)) for kind, p in patterns.items()]
    tried = lambda p, needs: (F.contains("text", F.lit(needs)) if needs else F.lit(True)) & F.col("text").rlike(p)
    rows = rows.select("*", *(F.when(tried(p, needs), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"hits_{base}_{kind}") for base, kind, p, needs in both))
    rows = rows.select("*", *(F.when(F.col(f"hits_{base}_{kind}").isNotNull(), F.split("text", p, -1)).alias(f"gaps_{base}_{kind}") for base, kind, p, _ in both))
    found = F.concat(*(pieces(base, kind, "text", f"hits_{base}_{kind}", f"gaps_{base}_{kind}") for base, kind, _, _ in both))
    return rows.select("row", "id", found.alias("pieces"))


def judged(found: DataFrame, lists: DataFrame) -> DataFrame:
    """row, base, rank, start, end, votes and shape of every base span and of each candidate that overlaps none.

    Only pieces are shuffled, once, by row; places are running sums of what lies before, and lists are asked by word.
    """
    placed = found.select("row", F.explode("pieces").alias("p")).select("row", "p.*").repartition("row")
    order = Window.partitionBy("row", "base", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(order)
    placed = placed.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    placed = placed.where((F.col("base") == 0) | of_kind(lambda k: passes(k, F.col("found")) if k in BASE_KINDS else F.lit(True)))
    # Candidates that a base span overlaps go: the furthest end of those that start before it or with it, and the next start after it.
    forth = Window.partitionBy("row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, -1)
    of_base = lambda c: F.when(F.col("base") == 1, F.col(c))
    placed = placed.withColumn("reach", F.max(of_base("end")).over(forth)).withColumn("next", F.min(of_base("start")).over(back))
    overlaps = (F.col("base") == 0) & (F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    placed = placed.where(~overlaps).drop("reach", "next", "gap", "size", "pos")
    asked = of_kind(lambda k: F.lit(ASKED[k][0] if k in ASKED else None).cast("string"))
    wide = F.col("rank").isin([KINDS.index(k) for k, (_, around) in ASKED.items() if around])
    said = F.when(wide, F.concat_ws(" ", "before", "found", "after")).otherwise(F.col("found"))
    said = F.when(F.col("rank") == KINDS.index("email"), F.regexp_extract(said, r"(?i)(?:@|\bat\b)(.*)$", 1)).otherwise(said)  # of the domain
    words = F.when(asked.isNotNull(), F.array_distinct(F.regexp_extract_all(F.lower(said), F.lit(r"\p{L}+"), F.lit(0))))
    keys = ["row", "base", "rank", "start", "end", "before", "found", "after"]
    named = placed.withColumn("list", asked).withColumn("word", F.explode_outer(words)).join(broadcast_if_few(lists), ["list", "word"], "left")
    named = named.groupBy(*keys).agg(F.max(F.col("listed").isNotNull()).alias("named"))
    return named.select("row", "base", "rank", "start", "end", *votes(), shape(F.col("found")).alias("shape"))


def estimate(counts: dict[tuple, int], steps: int = 200, near: float = 1e-9) -> tuple[dict[str, float], dict[tuple, float]]:
    """Per kind the share of true spans, and per (kind, labeler, vote) the log odds it lends, by EM.

    counts has the number of candidates for each (kind, votes). Votes are 1, 0 or -1 (no opinion)
    and independent given the truth. The first guess trusts each vote a little; the odds start at
    those of a majority. At most eight kinds times 3^4 votes, so the table is small at any scale.
    """
    trust = {(k, j, z): {1: 0.7 if z else 0.3, 0: 0.3 if z else 0.7, -1: 1.0} for k in KINDS for j in range(len(LABELERS)) for z in (0, 1)}
    for key in trust:
        total = sum(trust[key].values())
        trust[key] = {v: x / total for v, x in trust[key].items()}
    prior = dict.fromkeys(KINDS, 0.5)  # of each kind

    def odds(kind: str, votes: tuple) -> float:
        score = math.log(prior[kind] / (1 - prior[kind]))
        return score + sum(math.log(trust[kind, j, 1][v] / trust[kind, j, 0][v]) for j, v in enumerate(votes))

    before = None
    for _ in range(steps):
        weights = {key: 1 / (1 + math.exp(-max(-50.0, min(50.0, odds(*key))))) for key in counts}
        for kind in KINDS:
            mine = {votes: n for (k, votes), n in counts.items() if k == kind}
            true = sum(n * weights[kind, v] for v, n in mine.items())
            total = sum(mine.values())
            prior[kind] = (true + 1) / (total + 2)
            for j in range(len(LABELERS)):
                for z in (0, 1):
                    got = {v: 1.0 for v in (1, 0, -1)}  # one of each, so that none is impossible
                    for votes, n in mine.items():
                        got[votes[j]] += n * (weights[kind, votes] if z else 1 - weights[kind, votes])
                    trust[kind, j, z] = {v: x / sum(got.values()) for v, x in got.items()}
        if before is not None and max((abs(weights[k] - before[k]) for k in weights), default=0) < near:
            break
        before = weights
    return prior, {key: 1 / (1 + math.exp(-max(-50.0, min(50.0, odds(*key))))) for key in counts}


def shape(found: Column) -> Column:
    """What the span classifier sees besides the votes: length and share of digits, in a few steps."""
    n = F.length(found)
    return F.concat_ws("|", F.least(n / 6, F.lit(6)).cast("int"), (F.length(digits(found)) * 4 / n).cast("int"))


def listed(spark: SparkSession, gazetteer: DataFrame | None = None) -> DataFrame:
    """(list, word, listed): the words of a table (list, word), in lower case, or the fixed ones."""
    if gazetteer is None:
        gazetteer = spark.createDataFrame([(name, w) for name, words in LISTS.items() for w in words], "list string, word string")
    return gazetteer.select("list", F.lower("word").alias("word")).where("word is not null").distinct().withColumn("listed", F.lit(True))


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "spans", threshold: float = 0.9, gazetteer: DataFrame | None = None
) -> DataFrame:
    """One row per document: its id and the sorted spans of personal data in its whole text.

    Base spans are reported as they are. Candidates of looser form and further kinds are weighed:
    labelers of structure, gazetteer, context and edges vote on all spans alike, EM over the votes'
    counts estimates how reliable each is per kind, and the posteriors train a classifier over
    kind, votes and shape (naive Bayes with soft labels, from grouped sums); candidates at
    ``threshold`` or more are added, those of NAMED only where a list or the context votes for them.
    Of added spans that overlap, the first and then the longest stays. What reaches the driver is
    grouped by kind, votes and shape: at most 8 * 3^4 * 35 rows at any scale. Texts are read once
    and not shuffled; time grows in proportion to a text and to its matches. ``gazetteer`` is a
    table (list, word) of any size, where list is name, city, provider or bank.

    Null and empty texts have no spans; texts of any length are taken whole; null ids and repeated
    rows stay as they are; empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.save(extract(docs, id_col, text_col), "pieces")
    spans = scratch.save(judged(found, scratch.save(listed(docs.sparkSession, gazetteer), "lists")), "votes")
    voted = F.concat_ws(",", *LABELERS)
    kind = F.get(F.array(*map(F.lit, KINDS)), F.col("rank"))
    table = spans.groupBy(kind.alias("kind"), voted.alias("votes"), "shape").agg(F.count("*").alias("n")).collect()
    counts: dict[tuple, int] = {}
    for x in table:
        key = x["kind"], tuple(map(int, x["votes"].split(",")))
        counts[key] = counts.get(key, 0) + x["n"]
    _, posterior = estimate(counts)
    scores = classifier([(x["kind"], x["votes"], x["shape"], x["n"], posterior[x["kind"], tuple(map(int, x["votes"].split(",")))]) for x in table])
    sure = sorted(k for k, p in scores.items() if p >= threshold)
    # A national number's digits alone say nothing, and two words after "by" are a person's only where a list has one of them.
    spoken = (F.col("context") == 1) & (kind != "person") | (F.col("gazetteer") == 1) & (kind != "phone")
    unnamed = kind.isin(*NAMED) & ~spoken
    likely = F.concat_ws("/", kind, voted, "shape").isin(sure) & ~unnamed if sure else F.lit(False)
    spans = spans.where((F.col("base") == 1) | likely)
    # Of added spans in order of start and then length, one stays if none before it reaches into it.
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("base") == 0, F.col("end"))).over(order)
    spans = spans.withColumn("reach", reach).where((F.col("base") == 1) | F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)))
    span = F.struct("start", "rank", kind.alias("kind"), "end", "base")
    listed_spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint, base: int>>")
    return found.select("row", "id").join(listed_spans, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias(out_col))


def classifier(rows: list[tuple[str, str, str, int, float]]) -> dict[str, float]:
    """Probability by kind/votes/shape: the votes' posterior times what the shape tells of each kind."""
    true: dict[tuple, float] = {}
    false: dict[tuple, float] = {}
    for kind, _, form, n, p in rows:
        for key in ((kind, form), (kind, None)):
            true[key] = true.get(key, 0.0) + n * p
            false[key] = false.get(key, 0.0) + n * (1 - p)
    forms = {k: len({f for k2, _, f, _, _ in rows if k2 == k}) for k, *_ in rows}
    out = {}
    for kind, votes, form, _, p in rows:
        here = (true[kind, form] + 1) / (true[kind, None] + forms[kind])
        there = (false[kind, form] + 1) / (false[kind, None] + forms[kind])
        p = min(max(p, 1e-9), 1 - 1e-9)
        out[f"{kind}/{votes}/{form}"] = 1 / (1 + (1 - p) / p * there / here)
    return out


def is_base(span: Column) -> Column:
    return span["base"] == 1


def documents_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: personal data in all documents; n_spans counts base and added ones."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), out_col="found")
    return found.select("doc_id", *report("found", BASE_KINDS, is_base), F.size("found").cast("long").alias("n_spans"))
