"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans: email, ip, card and phone, which are always kept when they pass their checks, and access
keys, written-out secrets and social security numbers, which the method has to accept. Five labelers vote on
each proposal (yes, no or nothing): a strict pattern, word lists (gazetteers), the words before it, its edges,
and the variety of its characters. Expectation-maximisation over the counts of vote patterns, at most
3**5 per kind, estimates each labeler's reliability and each pattern's probability. With these as soft labels,
counts of categorical span features train a naive Bayes classifier, which decides on the proposals.

Positions come from the pieces between matches: a match starts after all pieces and matches before it. The
patterns use possessive repeats and look-behinds that change no match but keep long runs linear.

Null text counts as empty and has no spans; each row is judged for itself, so null ids and repeated rows are
kept; an empty table gives no rows; other columns are ignored by `find` and kept by `redact`.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, whole

BASE = ("email", "ip", "card", "phone")

#: The span patterns by kind, in the order in which spans are listed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:password|passwd|secret|api_key|token)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]++\"?",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap test that a text can hold the kind at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "key": "AKIA", "ssn": "-"}
#: What each kind looks like when it is meant seriously.
STRICT = {
    "email": r"^[A-Za-z0-9][^@]*+@[^@]*\.[A-Za-z]{2,24}$",
    "ip": r"^(?!0|127\.|255\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$",
    "phone": r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
    "key": r"^AKIA(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]{16}$",
    "secret": r"(?:=|:)\s?\"?(?=[^\"]*[0-9])(?=[^\"]*[A-Za-z])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
#: Listed endings, prefixes and names.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|[1-9][0-9]?\.|1[0-9]{2}\.|2[0-2][0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+(?:1|33|34|39|41|43|44|49|52|54|55|61|7|81|86|91)",
    "key": r"^AKIA",
    "secret": r"(?:=|:)\s?\"?[A-Za-z0-9+/_-]{6,}\"?$",
    "ssn": r"^[0-8]",
}
CUES = r"(?i)(?:mail|contact|write|phone|tel|call|mobile|fax|card|visa|credit|server|host|address|login|user|password|token|secret|key|ssn)\W{0,4}$"
AGAINST = r"(?i)(?:version|section|chapter|isbn|issn|release|figure|page|example|order|item)\W{0,4}$"
LABELERS = ("strict", "listed", "context", "edges", "variety")
CONTEXT = 40


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), kind).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """All columns, whose names must not start with an underscore but for _doc, and `_found`: per match its kind, number, the length of the text since the match before,
    itself, and what stands around it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = {}
    for kind, pattern in PATTERNS.items():
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        hits[f"_{kind}"] = F.when(F.contains(text, F.lit(NEEDS[kind])), every) if kind in NEEDS else every
    # A one-element array binds the pieces, so that they are cut once per text.
    found = [F.when(F.size(f"_{kind}") > 0, F.flatten(F.transform(F.array(F.split(text, pattern, -1)), _matches(kind))))
             for kind, pattern in PATTERNS.items()]
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,hit:string,before:string,after:string>>")
    with_hits = docs.select("*", *[c.alias(n) for n, c in hits.items()])
    return with_hits.select(*[F.col(f"`{c}`") for c in docs.columns],
                            F.concat(*[F.coalesce(f, none) for f in found]).alias("_found"))


def _matches(kind: str):
    """From the pieces of a text to the matches between them."""
    def of(gaps):
        return F.transform(f"_{kind}", lambda hit, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(F.get(gaps, i)).alias("gap"), hit.alias("hit"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")))

    return of


def _passes(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    parts = F.split(hit, r"\.")
    ip = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        parts, lambda p: F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(0)) <= 255)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    luhn = F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0
    return (F.when(kind == "ip", ip).when(kind == "card", n.between(12, 19) & F.when(n.between(12, 19), luhn))
             .when(kind == "phone", n.between(9, 15)).otherwise(True))


def _by_kind(kind: Column, patterns: dict[str, str], hit: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for name, pattern in patterns.items():
        out = F.when(kind == name, hit.rlike(pattern)).otherwise(out)
    return out


def proposals(found: DataFrame) -> DataFrame:
    """Passing matches of rows (_row, _found): kind, place in code points, votes and features."""
    one = found.select("_row", F.explode("_found").alias("m")).select("_row", "m.*")
    upto = Window.partitionBy("_row", "kind").orderBy("nth")     # the matches of one text
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    placed = one.select("*", end.cast("long").alias("end")).withColumn("start", F.col("end") - F.length("hit")).filter(_passes(F.col("kind"), F.col("hit")))
    kind, hit = F.col("kind"), F.col("hit")
    distinct = F.size(F.array_distinct(F.split(hit, "")))
    glued = F.col("before").rlike(r"[A-Za-z0-9]$") | F.col("after").rlike(r"^[A-Za-z0-9]")

    def vote(yes, no):
        return F.when(yes, 1).when(no, 0).otherwise(-1)

    votes = {"strict": vote(_by_kind(kind, STRICT, hit), ~_by_kind(kind, STRICT, hit)),
             "listed": vote(_by_kind(kind, GAZETTEER, hit), F.lit(False)),
             "context": vote(F.col("before").rlike(CUES), F.col("before").rlike(AGAINST)),
             "edges": vote(~glued, glued), "variety": vote(distinct >= 5, distinct < 4)}
    features = F.array(F.concat(F.lit("kind "), kind), F.concat_ws(" ", F.lit("length"), kind, F.least(F.length(hit) / 4, F.lit(12)).cast("int")),
                       F.concat_ws(" ", F.lit("variety"), F.least(distinct, F.lit(12))), F.concat_ws(" ", F.lit("glued"), glued.cast("string")),
                       F.concat_ws(" ", F.lit("digits"), (F.lit(8) * F.length(F.regexp_replace(hit, "[^0-9]", "")) / F.length(hit)).cast("int")),
                       F.concat_ws(" ", F.lit("cue"), F.col("before").rlike(CUES).cast("string"), F.col("before").rlike(AGAINST).cast("string")))
    return placed.select("_row", "kind", "start", "end", *[v.alias(n) for n, v in votes.items()], features.alias("features"))


@dataclass
class Model:
    reliability: dict[str, tuple[float, float]]      # of each labeler: yes on personal data, no on other
    weights: dict[str, float]                        # of each feature, and of "" for the prior odds


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50):
    """Votes (kind, votes, count): reliabilities, and the probability of each (kind, votes)."""
    m = len(LABELERS)
    yes, no = [0.8] * m, [0.8] * m
    prior = {k: 0.5 for k, _, _ in patterns}
    p: dict[tuple[str, tuple[int, ...]], float] = {}
    for _ in range(rounds):
        for kind, votes, _n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, v in enumerate(votes):
                if v == 1:
                    odds += math.log(yes[j] / (1 - no[j]))
                elif v == 0:
                    odds += math.log((1 - yes[j]) / no[j])
            p[kind, votes] = 1 / (1 + math.exp(-odds))
        for j in range(m):
            cast = [(p[k, v], v[j], n) for k, v, n in patterns if v[j] >= 0]
            a, b = sum(q * n for q, _, n in cast), sum((1 - q) * n for q, _, n in cast)
            yes[j] = min(0.99, max(0.51, (sum(q * n for q, v, n in cast if v == 1) + 4) / (a + 5)))
            no[j] = min(0.99, max(0.51, (sum((1 - q) * n for q, v, n in cast if v == 0) + 4) / (b + 5)))
        for kind in prior:
            mine = [(p[k, v], n) for k, v, n in patterns if k == kind]
            prior[kind] = min(0.99, max(0.01, (sum(q * n for q, n in mine) + 1) / (sum(n for _, n in mine) + 2)))
    return dict(zip(LABELERS, zip(yes, no))), p


def fit(spans: DataFrame) -> Model:
    """Reliabilities from vote counts, then feature weights from soft counts; both are small on the driver."""
    rows = spans.groupBy("kind", *LABELERS).count().collect()
    patterns = sorted((r.kind, tuple(r[n] for n in LABELERS), r["count"]) for r in rows)
    reliability, p = expectation_maximisation(patterns)
    if not p:
        return Model(reliability, {"": 0.0})
    key = F.concat_ws(" ", "kind", *LABELERS)
    table = F.create_map(*[F.lit(x) for (kind, votes), q in p.items() for x in (" ".join([kind, *map(str, votes)]), q)])
    soft = spans.select(F.col("features"), F.element_at(table, key).alias("p"))
    counted = soft.select(F.explode(F.concat("features", F.array(F.lit("")))).alias("feature"), "p").groupBy("feature").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = next(r for r in counted if r.feature == "")
    family = Counter(r.feature.split(" ")[0] for r in counted)     # values that a feature takes
    weights = {r.feature: math.log((r.yes + 1) / (total.yes + n)) - math.log((r.no + 1) / (total.no + n))
               for r in counted if r.feature for n in [family[r.feature.split(" ")[0]]]}
    return Model(reliability, weights | {"": math.log((total.yes + 1) / (total.no + 1))})


def decide(spans: DataFrame, model: Model) -> DataFrame:
    """Kept spans: the base kinds, and what the classifier holds likelier personal than not."""
    table = F.create_map(*[F.lit(x) for pair in sorted(model.weights.items()) for x in pair])
    odds = F.aggregate("features", F.lit(model.weights[""]), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
    return spans.withColumn("base", F.col("kind").isin(*BASE)).filter(F.col("base") | (odds >= 0)).select("_row", "kind", "start", "end", "base")


def _listed(kept: DataFrame) -> DataFrame:
    each = F.struct("start", _order(F.col("kind")).alias("order"), "end", "kind", "base")
    return kept.groupBy("_row").agg(F.sort_array(F.collect_list(each)).alias("spans"))    # of one text


def find(docs: DataFrame) -> DataFrame:
    """`doc_id, spans` of every row, spans being an array of (start, order, end, kind, base) by start and kind."""
    found = materialize(scan(docs.select("doc_id", "text")).select("doc_id", "_found").withColumn("_row", F.monotonically_increasing_id()), "pii-matches")
    some = found.filter(F.size("_found") > 0)
    spans = proposals(some)
    kept = _listed(decide(spans, fit(spans)))
    empty = F.array().cast(kept.schema["spans"].dataType)
    joined = some.select("_row", "doc_id").join(kept, "_row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))
    return found.filter(F.size("_found") == 0).select("doc_id", empty.alias("spans")).union(joined)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def _without(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of overlapping spans the first stands for all."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>").alias("out"))

    def step(a, s):
        longer = F.greatest(a["end"], s["end"])
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        last = F.get(a["out"], F.size(a["out"]) - 1)
        grown = F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1),
                         F.array(F.struct(last["start"].alias("start"), longer.alias("end"), last["kind"].alias("kind"))))
        apart = (F.size(a["out"]) == 0) | (s["start"] >= a["end"])
        return F.struct(longer.alias("end"), F.when(apart, F.concat(a["out"], F.array(new))).otherwise(grown).alias("out"))

    merged = F.aggregate(spans, start, step, lambda a: a["out"])

    def write(m):
        def part(s, i):
            since = F.coalesce(F.get(m, i - 1)["end"], F.lit(0).cast("long"))
            return F.concat(F.substr(text, since + 1, s["start"] - since), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        tail = F.substr(text, F.get(m, F.size(m) - 1)["end"] + 1, F.length(text).cast("long"))
        return F.concat(F.array_join(F.transform(m, part), ""), tail)

    return F.get(F.transform(F.array(merged), write), F.lit(0))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`; spans in `text` are replaced by their kind in brackets. Only rows with a
    match are shuffled. A column n_chars gets the new length."""
    scanned = scan(docs.select(whole(docs), "text"))
    some = materialize(scanned.filter(F.size("_found") > 0).withColumn("_row", F.monotonically_increasing_id()), "pii-rows")
    spans = proposals(some)
    kept = _listed(decide(spans, fit(spans)))
    texts = some.drop("_found").join(kept, "_row", "left").drop("_row")
    done = texts.withColumn("text", F.when(F.size("spans") > 0, _without(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    changed = done.select(*[new.get(c, F.col(f"_doc.`{c}`")) for c in docs.columns])
    return scanned.filter(F.size("_found") == 0).select("_doc.*").union(changed)
