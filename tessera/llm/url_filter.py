"""URL filter (operator 7): rules first, then logistic regression on hashed character n-grams.

A URL's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; its path is what follows, up to ``?``, ``#`` or the end. A rule (host, path prefix) fits its
host and all subdomains; the longest rule that fits decides. All other URLs are judged by a classifier:
character n-grams of host and path, marked by where they stand, are hashed (Spark ML's ``HashingTF``) and
weighed by ``LogisticRegression``. It is trained on a small table of labelled URLs, a parameter.

Every row is judged by itself, so nothing is shuffled and no host can be hot. Rules are turned into one
expression; they are few, by construction of a hand-kept list.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, and the verdict
the classifier gives to no n-grams at all (allow, by the labelled table's prior); repeated rows get the
same verdict; URLs are judged whole, whatever their length; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import table

#: (verdict, rule): the host ends at the first slash.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Words of hosts to block and to allow, by topic; written down before any page was judged by them, and not changed since.
BLOCKED_WORDS = (
    # gambling
    "poker", "roulette", "jackpot", "blackjack", "slots", "wager", "bingo", "lotto", "bookmaker", "betting", "gambling", "casinos",
    # adult content
    "porn", "nude", "naked", "sexy", "escort", "fetish", "webcam", "hookup", "erotic", "milf",
    # medicine without a doctor
    "viagra", "cialis", "tramadol", "xanax", "steroids", "weightloss", "painkiller", "pillshop",
    # fraud, theft and unasked advertising
    "phishing", "malware", "spyware", "warez", "keygen", "torrent", "replica", "payday", "quickloan", "getrich", "popup", "clickbait", "adserver", "tracker", "spammer", "bulkmail",
)
ALLOWED_WORDS = (
    # learning
    "algebra", "archive", "astronomy", "biology", "botany", "chemistry", "college", "dictionary", "geology", "geometry", "grammar", "history", "journal", "lecture", "library", "museum", "physics", "school",
    # work and trade
    "bakery", "builder", "butcher", "carpenter", "dentist", "engineer", "florist", "grocer", "hospital", "insurance", "joinery", "lawyer", "mechanic", "notary", "optician", "plumber", "printer", "surveyor",
    # nature and places
    "alpine", "beaver", "canyon", "desert", "estuary", "falcon", "forest", "glacier", "harbour", "island", "juniper", "lagoon", "meadow", "orchard", "penguin", "river", "sparrow", "valley",
    # arts and free time
    "ballet", "camera", "choir", "cinema", "cycling", "drawing", "fencing", "gallery", "guitar", "hiking", "knitting", "marathon", "novel", "opera", "pottery", "rowing", "sailing", "theatre",
    # public life
    "airport", "bridge", "census", "charity", "citizen", "council", "election", "embassy", "ferry", "heritage", "market", "mayor", "parish", "postal", "railway", "station", "transit", "weather",
)


def labelled_urls() -> list[tuple[str, float]]:
    """The small table of labelled URLs; 1 is block. Every word stands alone and with the next ones of its list, under neutral hosts and paths that both labels share."""
    rows = []
    places = (("", "io", "/index"), ("my.", "info", "/item/41"), ("web.", "biz", "/about/us"), ("go.", "co", "/p?id=7"))
    for label, names in ((1.0, BLOCKED_WORDS), (0.0, ALLOWED_WORDS)):
        for i, name in enumerate(names):
            near = names[(i + 1) % len(names)], names[(i + 5) % len(names)]
            for j, own in enumerate((name, f"{name}-{near[0]}", f"{near[1]}{name}", name)):
                prefix, top, path = places[(i + j) % len(places)]
                rows.append((f"https://{prefix}{own}.{top}{path}", label))
    return rows


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for does, written in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, rest = written.partition("/")
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(written)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of the host between marks, and of the path, as an array of strings, in time that grows with their length."""
    def of(text: Column, mark: str, n: int) -> Column:
        # A lookahead takes up nothing, so that matches overlap.
        some = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(some, lambda g: F.concat(F.lit(mark), g))

    bounded = F.when(F.length(host) > 0, F.concat(F.lit("^"), host, F.lit("$"))).otherwise(F.lit(""))
    return F.concat(*[of(bounded, "h:", n) for n in sizes], *[of(path, "p:", n) for n in sizes])


def _featured(df: DataFrame, buckets: int) -> DataFrame:
    gathered = df.withColumn("grams", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="features").transform(gathered)


def train(spark: SparkSession, labelled: list[tuple[str, float]], buckets: int) -> LogisticRegressionModel:
    rows = spark.createDataFrame(labelled, "url string, label double").coalesce(1)
    # Both labels count alike, however many URLs each has.
    blocked = sum(y for _, y in labelled)
    weight = F.when(F.col("label") > 0, 0.5 / max(blocked, 1)).otherwise(0.5 / max(len(labelled) - blocked, 1)) * len(labelled)
    split = rows.select("label", weight.alias("weight"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # A little ridge keeps n-grams of paths, which say nothing here, near zero.
    return LogisticRegression(regParam=0.01, maxIter=40, weightCol="weight").fit(_featured(split, buckets))


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    labelled: list[tuple[str, float]] | None = None,
    buckets: int = 1 << 15,
    threshold: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` for every page."""
    model = train(pages.sparkSession, labelled or labelled_urls(), buckets)
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    scored = model.transform(_featured(split, buckets)).withColumn("p_block", vector_to_array("probability")[1])
    # No n-grams, no evidence: let through.
    learned = F.when((F.size("grams") > 0) & (F.col("p_block") > threshold), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "p_block")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))


QUERIES = {"op7_url_filter": op7_url_filter}
#: A fitted model has no form in SQL; tests hold hosts, paths and rules against brute force, and the model against held-out URLs.
ORACLES: dict[str, str] = {}
