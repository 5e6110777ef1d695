"""Personal data by weak supervision (operator 1), built of DataFrame functions only.

Candidate spans of four kinds (email, ip, card, phone) come from strict base patterns and from wider
ones (addresses written "name [at] host [dot] tld", IPv6, national phone numbers). Labelers vote on each
candidate: for, against, or not at all.

* ``regex``: the strict pattern and its arithmetic check hold; against if only the check fails
* ``gazetteer``: known top-level domains, issuer prefixes, calling codes; address blocks nobody owns
* ``context``: cue words just before the span; words that announce versions, orders, ISBNs vote against
* ``edges``: the span stands by itself, or is glued to letters and digits

Votes are counted by pattern over the whole corpus (a table of bounded size: kinds x 3^labelers x length
classes). Expectation-maximisation over the counts estimates how each labeler votes on true and on false
spans, which gives every pattern a posterior. A logistic regression, weighted by count and fitted to the
posteriors, is the final span classifier; its coefficients become a column expression. Texts are matched
once; candidates are written to the shared workspace and everything else works on them.

Base spans that pass their checks always stay. The classifier adds wider candidates that it accepts and
that overlap no base span; of wider candidates that overlap one another the first by start, then end, stays.

Defined cases: null text counts as empty; a document without spans has zero counts, the SHA-256 of the
empty string and an empty ``spans``; repeated rows are judged one by one; an empty table gives an empty
result; without candidates the classifier rejects everything. Texts are searched whole; a text may be of any length and hold any
number of spans, since places, contexts and overlaps take time in proportion to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize, table, text_or_empty
from tessera.llm.spans import add_spans, chunks, clear_of, first_of_overlapping, part, written

KINDS = ("email", "ip", "card", "phone")

#: Same matches as the plain forms in the contract; possessive, so linear and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}

# Fixed values of the gazetteer and context labelers.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "int", "mil", "info", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "us", "ca", "ch", "at")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|34|37|6011|65|35|36|38|30)"
CALLING = r"^\+?(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
UNOWNED = r"^(?:0|127|22[4-9]|2[3-5][0-9])\."
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|from|to)\W{0,4}$",
    "ip": r"(?i)(?:\bip|host|server|address|addr|from|login)\W{0,4}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|pay|charge|account)\W{0,4}(?:number|no|#)?\W{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|dial)\W{0,4}$",
}
ANTI_CUES = r"(?i)(?:version|build|release|isbn|issn|doi|order|invoice|sku|ref|serial|section)\W{0,4}$"

LABELERS = ("regex", "gazetteer", "context", "edges")
CONTEXT_CHARS = 32


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits; for strings of 1 to 19 digits."""
    def weigh(d: Column, i: Column) -> Column:
        x = d.cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    each = F.transform(F.split(F.reverse(digits), ""), weigh)
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The arithmetic check of a base match."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(13, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, base: bool, span: Column, cut: str) -> Column:
    value = span["value"]
    before = part(cut, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)), F.least(span["start"], F.lit(CONTEXT_CHARS)))
    around = F.concat(F.right(before, F.lit(1)), F.lit("\n"), part(cut, span["end"], F.lit(1)))
    if kind == "email":
        known = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(*TOP_LEVEL)
    elif kind == "card":
        known = F.rlike(_digits(value), F.lit(ISSUERS))
    elif kind == "phone":
        known = F.rlike(value, F.lit(CALLING if base else r"^\(?[2-9]"))
    else:
        known = ~F.rlike(value, F.lit(UNOWNED))
    ok = valid(kind, value) if base else F.lit(None).cast("boolean")
    glued = F.rlike(around, F.lit(r"^[\p{L}0-9_]\n|\n[\p{L}0-9_]$"))
    return F.struct(
        _vote(ok, ~ok).alias("regex"),
        _vote(known, ~known).alias("gazetteer"),
        _vote(F.rlike(before, F.lit(CUES[kind])), F.rlike(before, F.lit(ANTI_CUES))).alias("context"),
        _vote(~glued, glued).alias("edges"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: all candidate spans of each document with their votes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    has = lambda *s: F.greatest(*[F.contains("text", F.lit(x)) for x in s], F.lit(False))
    patterns = {f"base_{k}": (p, {"email": has("@"), "phone": has("+")}.get(k, F.lit(True))) for k, p in BASE.items()}
    patterns |= {f"wide_{k}": (p, {"email": has("at]", "at)"), "ip": has(":")}.get(k, F.lit(True))) for k, p in WIDE.items()}
    spans = add_spans(rows, "text", patterns)
    spans = spans.withColumn("cut", F.when(F.size(F.concat(*patterns)) > 0, chunks(F.col("text"))))

    def tagged(kind: str, base: bool) -> Column:
        return F.transform(
            f"{'base' if base else 'wide'}_{kind}",
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(KINDS.index(kind)).alias("place"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["value"].alias("value"),
                F.lit(base).alias("base"),
                (valid(kind, s["value"]) if base else F.lit(False)).alias("ok"),
                F.least(F.length(s["value"]) / 8, F.lit(3)).cast("int").alias("size"),
                _votes(kind, base, s, "cut").alias("votes"),
            ),
        )

    return spans.select("doc_id", F.concat(*[tagged(k, True) for k in KINDS], *[tagged(k, False) for k in WIDE]).alias("found"))


def vote_patterns(found: DataFrame) -> list:
    """How often each pattern of votes occurs in the corpus; bounded, whatever the corpus."""
    return (
        found.select(F.explode("found").alias("c"))
        .groupBy(F.col("c.kind").alias("kind"), F.col("c.size").alias("size"), *[F.col(f"c.votes.{v}").alias(v) for v in LABELERS])
        .agg(F.count("*").alias("n"))
        .orderBy("kind", "size", *LABELERS)
        .collect()
    )


def estimate(patterns: list, rounds: int = 50, trust: float = 4.0) -> tuple[dict, list[float]]:
    """Expectation-maximisation, kind by kind: how each labeler votes on true and false spans, and each pattern's posterior.

    Every cell starts from one pseudo-count, and from ``trust`` more where a labeler is right: labelers are better
    than chance until the corpus says otherwise.
    """
    votes = (-1, 0, 1)
    post = [1 / (1 + math.exp(-2.0 * sum(p[v] for v in LABELERS))) for p in patterns]
    rates: dict = {}
    for kind in KINDS:
        own = [i for i, p in enumerate(patterns) if p["kind"] == kind]
        for _ in range(rounds):
            for name in LABELERS:
                for truth in (0, 1):
                    cells = {v: 1.0 + trust * (v == 2 * truth - 1) for v in votes}
                    for i in own:
                        cells[patterns[i][name]] += patterns[i]["n"] * (post[i] if truth else 1 - post[i])
                    total = sum(cells.values())
                    rates[kind, name, truth] = {v: c / total for v, c in cells.items()}
            prior = (1 + sum(patterns[i]["n"] * post[i] for i in own)) / (2 + sum(patterns[i]["n"] for i in own))
            for i in own:
                post[i] = _posterior(patterns[i], prior, rates)
    return rates, post


def _posterior(pattern, prior: float, rates: dict) -> float:
    kind = pattern["kind"]
    odds = math.log(prior / (1 - prior)) + sum(math.log(rates[kind, v, 1][pattern[v]] / rates[kind, v, 0][pattern[v]]) for v in LABELERS)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _features(row) -> list[str]:
    """Kind, length class, votes, and votes by kind."""
    kind = row["kind"]
    return ["one", f"kind:{kind}", f"size:{row['size']}", *[f"{v}:{row[v]}" for v in LABELERS], *[f"{kind}/{v}:{row[v]}" for v in LABELERS]]


def train(patterns: list, post: list[float], ridge: float = 1.0, rounds: int = 300) -> dict[str, float]:
    """Coefficients of the span classifier, by gradient steps on the bounded table of patterns."""
    if not patterns:
        return {}
    rows = [(_features(p), float(p["n"]), y) for p, y in zip(patterns, post, strict=True)]
    total = sum(n for _, n, _ in rows)
    weights = {name: 0.0 for names, _, _ in rows for name in names}
    step = 4.0 / len(rows[0][0])
    for _ in range(rounds):
        slope = {name: ridge / total * w for name, w in weights.items()}
        for names, n, y in rows:
            z = sum(weights[name] for name in names)
            gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / total
            for name in names:
                slope[name] += gap
        weights = {name: w - step * slope[name] for name, w in weights.items()}
    return weights


def _score(span: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(0.0)

    def of(column: Column, prefix: str) -> Column:
        out = F.lit(0.0)
        for name, w in weights.items():
            if name.startswith(f"{prefix}:"):
                out = F.when(column.cast("string") == name.partition(":")[2], F.lit(w)).otherwise(out)
        return out

    z = F.lit(weights["one"]) + of(span["kind"], "kind") + of(span["size"], "size")
    for v in LABELERS:
        z = z + of(span["votes"][v], v)
        for kind in KINDS:
            z = z + F.when(span["kind"] == kind, of(span["votes"][v], f"{kind}/{v}")).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, base, added``: arrays of spans (kind, start, end, value, ...) in order of kind, then start."""
    found = materialize(candidates(docs, id_col, text_col), "pii")
    patterns = vote_patterns(found)
    _, post = estimate(patterns)
    weights = train(patterns, post)
    split = found.select(
        "doc_id", F.filter("found", lambda s: s["base"] & s["ok"]).alias("base"), F.filter("found", lambda s: ~s["base"] & (_score(s, weights) > threshold)).alias("added")
    )
    return first_of_overlapping(clear_of(split, "added", "base"), "added")


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_pii(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(
        F.array_sort(F.transform(c, lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: written(s["kind"], s)), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


QUERIES = {"op1_weak_supervision_pii": op1_weak_supervision_pii}
#: The estimates of expectation-maximisation have no form in SQL; tests hold the base against brute force.
ORACLES: dict[str, str] = {}
