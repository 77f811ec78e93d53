"""URL filter, in DataFrame functions only: prefix rules first, then logistic regression on hashed character n-grams.

A rule names a host, which stands for its subdomains too, and the start of a path; of the rules that fit a URL the
longest decides. Where none fits, a logistic regression on the hashed character n-grams of host and path decides. It is
trained from a small labelled URL table, whose size is checked; its coefficients (FEATURES numbers) are part of the plan.

Rules given as tuples become one expression; a rule table is joined on the URL's host suffixes, however small. Both
choose alike: of rules of one length the first by rule, then by host, and block before allow.

Defined cases: a rule without host, path or verdict fits nothing; a null URL and one without :// have an empty host and path, which no rule fits; repeated rows are judged
alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirebook.llm.common import read

#: (host, path, verdict): the rules of the query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MOST_LABELLED, SALTS, VARIANTS = 100_000, 16, 3
FEATURES, GRAMS = 1 << 13, (3, 4, 5)
#: What the built-in labelled URLs are made of: words of hosts and paths to block, by kind (advertising and tracking, spam,
#: fraud and malware, gambling, medicines, adult, copies), and of others.
BLOCKED = (
    "ads adserver adclick banner popunder popup tracker track tracking pixel affiliate doubleclick sponsor leadgen spam spammer farm linkfarm seo backlink bulkmail phish phishing malware trojan spyware exploit "
    "hack verify-account free-prize winner lottery casino poker betting bets slots jackpot roulette viagra pills pharma cialis adult porn escort xxx webcam replica warez torrent crack keygen serial loan payday"
).split()
ALLOWED = (
    "news library school museum science recipes weather history garden music travel health docs blog wiki forum sports books maps jobs university college research journal magazine press radio theatre cinema art "
    "gallery nature animals birds cooking kitchen bakery farmer market shop store bank post mail calendar photo video map city village council parish church hospital clinic doctor law court police fire train bus"
).split()
#: What stands beside such a word in a host: before or after it, with or without a hyphen.
BESIDE = "best free win online my top shop world city club net daily".split()
#: Harmless names without a meaning are made of two syllables, or three.
SYLLABLES = "ter ion men la re th ing con der pa no st an en er ed ou le ti se ar ble nt ho ma do".split()
SHAPES = (
    "https://www.{w}.example.com/", "http://{w}-{b}.example.net/a/{n}", "https://m.{b}{w}.example.org/{w}/page", "http://blog.example.com/{w}-{n}.html", "https://{w}{b}.example.org/index?x={n}",
    "http://the{w}.example.net/en/{n}", "https://www.{b}-{w}.example.com/fr/{n}#top", "http://{b}.example.org/{b}/{w}", "https://{w}.{b}.example.net/{n}/", "http://m.{w}{n}.example.com/{b}/{n}?page={n}",
    "https://{w}.org/{b}/{n}", "http://www.{b}{w}.co.uk/{w}/{n}.php", "https://cdn.{b}.io/{w}/{n}.js", "http://{w}-{w}.info/de/{n}/", "https://{b}.de/{n}/{w}_{b}", "http://x{n}.{w}.net/es/{n}?utm_source=feed",
)


def labelled_urls() -> list[tuple[str, int, str, str]]:
    """(url, label, word, shape): label 1 for URLs to block. Each word stands in every shape, beside VARIANTS words;
    the syllables' names, too, beside one."""
    words = [(w, 1, VARIANTS) for w in BLOCKED] + [(w, 0, VARIANTS) for w in ALLOWED] + [(a + b, 0, 1) for a in SYLLABLES for b in SYLLABLES]
    words += [(a + b + c, 0, 1) for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES) for c in [SYLLABLES[(5 * i + 7 * j) % len(SYLLABLES)]]]
    out = []
    for i, (w, label, variants) in enumerate(words):
        for j, shape in enumerate(SHAPES):
            for k in range(variants):
                beside = BESIDE[(5 * i + 3 * j + 4 * k) % len(BESIDE)]
                out.append((shape.format(w=w, b=beside, n=(37 * i + 101 * j + 997 * k) % 9973), label, w, shape))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), upper, upper.lower()), F.regexp_extract(url, pattern, 2)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, with their ends marked."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))

    return F.concat(*map(of, GRAMS))


def train(labelled: DataFrame) -> PipelineModel:
    """From (url, label) with label 1 for URLs to block. Both labels weigh alike, however many rows have them."""
    rows = labelled.limit(MOST_LABELLED + 1)
    counts = {r["label"]: r["count"] for r in rows.groupBy(F.col("label").cast("double").alias("label")).count().collect()}
    if sum(counts.values()) > MOST_LABELLED:
        raise ValueError(f"the labelled table may have {MOST_LABELLED} rows")
    host, path = host_and_path(F.col("url"))
    hashing = HashingTF(binary=True, numFeatures=FEATURES, inputCol="grams", outputCol="features")
    fit = LogisticRegression(maxIter=40, regParam=0.001, standardization=False, labelCol="label", featuresCol="features", weightCol="weight")
    weight = F.when(F.col("label") == 1, 1.0 / counts.get(1.0, 1)).otherwise(1.0 / counts.get(0.0, 1)) * (sum(counts.values()) / 2)
    return Pipeline(stages=[hashing, fit]).fit(rows.select(F.col("label").cast("double").alias("label"), grams(host, path).alias("grams"), weight.alias("weight")))


def _order(host: str, path: str, verdict: str) -> tuple:
    return -len(host + path), host + path, host, verdict == "allow"


def _longest(rules: Iterable[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null. Longer rules are tried first."""
    ordered = sorted((r for r in rules if None not in r), key=lambda r: _order(*r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    found = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    return F.coalesce(*(F.when(f, s) for f, s in zip(fits, found)), F.lit(None).cast("struct<rule:string,verdict:string>"))


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, ...) with `found`: rules (host, path, verdict) joined on every suffix of the distinct hosts
    and paths, which are joined back with salts, as one URL may have very many rows."""
    keys = rows.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    sent = keys.select("*", F.explode(suffix).alias("suffix"))
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict").dropna()
    hit = sent.join(rules, "suffix").where(F.col("path").startswith(F.col("start")))
    rule = F.concat("suffix", "start")
    best = hit.groupBy("host", "path").agg(F.min_by(F.struct(rule.alias("rule"), "verdict"), F.struct(-F.length(rule), rule, "suffix", F.col("verdict") == "allow")).alias("found"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(best, ["host", "path", "salt"], "left").drop("salt")


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], model: PipelineModel) -> DataFrame:
    """(row, host, path, rule, verdict) for each row of pages (url, ...), the row as a struct."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        rows = _joined(rows, rules)
    else:
        rows = rows.withColumn("found", _longest(rules, F.col("host"), F.col("path")))
    scored = model.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path"))))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    return scored.select("row", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_urlfilter: see the README for its columns."""
    model = train(spark.createDataFrame(labelled_urls(), "url string, label int, word string, shape string"))
    found = judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES, model)
    return found.select("row.page_id", "host", "path", "rule", "verdict")
