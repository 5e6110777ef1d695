"""Secrets and who owns them (operator 2).

Candidates are found by three base patterns (assignments to credential names, access key ids, long hex
runs) and one wider pattern (opaque runs of 32 or more characters of mixed classes). What is found is
hashed, and hashes are counted over the corpus: in how many distinct repositories, of how many distinct
owners. Both decide: a value is a widely copied example if ``example_owners`` owners publish it, or if several owners
publish it in ``example_repos`` repositories or more. A value of one owner looks live, in however many repositories.

The count groups by (hash, owner, repository), then (hash, owner), then hash, each with partial sums
before its shuffle, so a value that a third of all rows repeat costs no task more than its share. The counts
are written and joined back to the spans; a join on the hash is left to adaptive execution to split where
one value is hot. Only spans move, never texts.

Base spans always stay. Opaque candidates are added unless they overlap a base span or are examples.

Defined cases: null text counts as empty; null owners and repositories count as one owner or repository;
repeated rows are kept apart; an empty table gives an empty result. Texts are searched whole, and may be of any length and
hold any number of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import materialize, table, text_or_empty
from tessera.llm.spans import add_spans, clear_of, running, written

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)"
#: Same spans as the plain forms: a run that is too short holds no run that is long enough.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "opaque": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}+",
}
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 8


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """``row, doc_id, owner, repo, base, opaque`` with spans (kind, place, start, end, hash)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        text_or_empty(text_col).alias("text"),
    )
    gates = {"access": F.contains("text", F.lit("AKIA"))}
    found = add_spans(rows, "text", {k: (p, gates.get(k, F.lit(True))) for k, p in PATTERNS.items()})

    def tagged(kind: str, value=lambda s: s["value"]) -> Column:
        return F.transform(kind, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), s["end"].alias("end"),
            F.sha2(value(s), 256).alias("hash")))

    secret = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    mixed = lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Z]")) & F.rlike(s["value"], F.lit("[a-z]"))
    tagged_spans = (
        found.withColumn("assign", F.filter("assign", lambda s: F.length(secret(s)) >= 6))
        .withColumn("opaque", F.filter("opaque", mixed))
        .select("row", "doc_id", "owner", "repo",
                F.concat(tagged("assign", secret), tagged("access"), tagged("hex")).alias("base"), tagged("opaque").alias("opaque"))
    )
    return clear_of(tagged_spans, "opaque", "base")


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners`` over the whole corpus."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c)
    return (
        found.select(key("owner"), key("repo"), F.explode(F.array_distinct(F.transform(F.concat("base", "opaque"), lambda s: s["hash"]))).alias("hash"))
        .groupBy("hash", "owner", "repo").agg(F.count("*").alias("rows"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """``doc_id, base, added, n_repos, n_owners``: spans by start, each with ``example``, and the most repositories and owners
    that any value of the document has (0 without one)."""
    found = materialize(candidates(docs, id_col, text_col, owner_col, repo_col), "secrets")
    wide = (F.col("n_owners") >= example_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= example_repos))
    counts = materialize(ownership(found).select("hash", "n_repos", "n_owners", wide.alias("example")), "owners")
    marked = (
        found.select("row", F.explode(F.array_distinct(F.transform(F.concat("base", "opaque"), lambda s: s["hash"]))).alias("hash"))
        .join(counts, "hash")
        .groupBy("row").agg(F.max("n_repos").alias("n_repos"), F.max("n_owners").alias("n_owners"), F.collect_set(F.when(F.col("example"), F.col("hash"))).alias("examples"))
    )
    rows = found.join(marked, "row", "left").withColumns({
        "examples": F.coalesce("examples", F.expr("cast(array() as array<string>)")),
        "n_repos": F.coalesce("n_repos", F.lit(0)).cast("long"), "n_owners": F.coalesce("n_owners", F.lit(0)).cast("long")})
    rows = _flagged(_flagged(rows, "base"), "opaque")
    return rows.select("doc_id", "base", F.filter("opaque", lambda s: ~s["example"]).alias("added"), "n_repos", "n_owners")


def _flagged(df: DataFrame, spans: str) -> DataFrame:
    """Add ``example`` to the spans: whether their hash is among ``examples``. Both are sorted, so any number of them is matched in one pass."""
    kept = df.columns
    own = F.transform(spans, lambda s, i: F.struct(s["hash"].alias("hash"), F.lit(1).alias("own"), i.alias("at")))
    known = F.transform("examples", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("own"), F.lit(-1).alias("at")))
    df = df.withColumn("__marks", F.array_sort(F.concat(known, own)))
    df = df.withColumn("__known", F.transform("__marks", lambda m: F.when(m["own"] == 0, m["hash"]).otherwise("")))
    df = df.withColumn("__known", running(F.col("__known"), F.greatest, F.lit(""), "string"))
    flags = F.zip_with("__marks", "__known", lambda m, h: F.struct(m["at"].alias("at"), (m["hash"] == h).alias("example")))
    df = df.withColumn("__flags", F.array_sort(F.filter(flags, lambda f: f["at"] >= 0)))
    spans_with = F.zip_with(spans, "__flags", lambda s, f: F.struct(*[s[k].alias(k) for k in ("kind", "start", "place", "end", "hash")], f["example"].alias("example")))
    return df.withColumn(spans, spans_with).select(*kept)


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan_secrets(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.transform(
        c, lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: written(s["kind"], s)), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size(F.filter(F.concat("base", "added"), lambda s: s["example"])).cast("long").alias("n_example"),
        F.size(F.filter(F.concat("base", "added"), lambda s: ~s["example"])).cast("long").alias("n_live"),
        "n_repos",
        "n_owners",
    )


QUERIES = {"op2_secret_ownership": op2_secret_ownership}

_SPANS_SQL = r"""
    {k}_l AS (SELECT doc_id, source, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS b FROM d),
    {k}_s AS (SELECT doc_id, source, '{k}' AS kind, {i} AS place, m[i] AS value,
                     CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS "end"
              FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {k}_l)),"""
#: RE2 has no lookbehind, but the first match of a long enough run starts where the run starts.
_SQL_PATTERNS = {
    "assign": r"""(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "opaque": r"[A-Za-z0-9+/_-]{32,}={0,2}",
}
ORACLES = {
    "op2_secret_ownership": "WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),"
    + "".join(_SPANS_SQL.format(k=k, p=p, i=i) for i, (k, p) in enumerate(_SQL_PATTERNS.items()))
    + r"""
    raw AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s UNION ALL SELECT * FROM opaque_s),
    c AS (SELECT *, "end" - length(value) AS start,
                 CASE kind WHEN 'assign' THEN regexp_extract(value, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE value END AS secret
          FROM raw WHERE CASE kind WHEN 'access' THEN length(value) >= 20 WHEN 'hex' THEN length(value) >= 24
                              WHEN 'opaque' THEN length(rtrim(value, '=')) >= 32 AND regexp_matches(value, '[0-9]')
                                   AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') ELSE true END),
    k AS (SELECT * FROM c WHERE kind <> 'assign' OR length(secret) >= 6),
    f AS (SELECT * FROM k a WHERE kind <> 'opaque' OR NOT EXISTS (SELECT 1 FROM k o WHERE o.doc_id = a.doc_id
              AND o.kind <> 'opaque' AND o.start < a."end" AND a.start < o."end")),
    e AS (SELECT secret, count(DISTINCT coalesce('=' || source, '')) AS n_owners, sum(r) AS n_repos FROM
          (SELECT secret, source, count(DISTINCT coalesce('=' || doc_id, '')) AS r FROM f GROUP BY secret, source) GROUP BY secret),
    g AS (SELECT f.*, n_owners, n_repos, n_owners >= 3 OR n_owners > 1 AND n_repos >= 8 AS example, concat_ws(':', kind, start, "end") AS w
          FROM f JOIN e ON f.secret = e.secret),
    a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex,
                 string_agg(w, ',' ORDER BY start, place) FILTER (kind <> 'opaque') AS base,
                 string_agg(w, ',' ORDER BY start, place) FILTER (kind <> 'opaque' OR NOT example) AS spans,
                 count(*) FILTER (example AND kind <> 'opaque') AS n_example, count(*) FILTER (NOT example) AS n_live,
                 CAST(max(n_repos) AS BIGINT) AS n_repos, max(n_owners) AS n_owners FROM g GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
           coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live, coalesce(n_repos, 0) AS n_repos, coalesce(n_owners, 0) AS n_owners
    FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""
}
