"""URL filter: rules on host and path, and logistic regression on hashed character n-grams for the rest.

A rule fits its host and all subdomains when the url's path starts with the rule's path; the longest
rule wins. A url that no rule fits is judged by a logistic regression over hashed character n-grams of
its host and its path, fitted on a small labelled url table (one partition, so the fit is repeatable).
All of it is DataFrame work inside the JVM; nothing is shuffled.

Defined results: a url that is null or holds no "://" has an empty host and path, fits no rule, and is
judged on no n-grams. Repeated rows are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lower_az

GRAMS = (3, 4)
BUCKETS = 1 << 14
# (rule, verdict); a rule is a host and the start of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# The labelled table is every word in every form, a label for each word list.
ALLOWED_WORDS = "news wiki docs blog school museum library science garden travel recipe history music weather archive".split()
BLOCKED_WORDS = "casino poker betting jackpot porn xxx escort viagra pills payday warez crack torrent clickbait lottery".split()
FORMS = ("https://www.{}.example/", "http://{}-online.example/{}/1", "https://site.example/{}/page", "http://my{}.example/index.html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): label 1 is to be blocked."""
    rows = [(form.format(word, word), label) for label, words in ((0, ALLOWED_WORDS), (1, BLOCKED_WORDS)) for word in words for form in FORMS]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{url}', {label})" for url, label in rows) + " AS t(url, label)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.char_length(host) + 1), r"^[^?#]*", 0)
    return lower_az(host), path


def rule_of(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(text: Column, mark: str) -> Column:
    """Character n-grams of the text between two marks; none of an empty text."""
    whole = F.concat(F.lit("<"), text, F.lit(">"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(whole) - n + 1, F.lit(1)))
        return F.transform(starts, lambda k: F.concat(F.lit(mark), F.substr(whole, k, F.lit(n))))

    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.concat(*map(of_size, GRAMS)))


def with_grams(pages: DataFrame, url_col: str) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    split = pages.withColumn("_host", host).withColumn("_path", path)
    return split.withColumn("_grams", F.concat(grams(F.col("_host"), "h"), grams(F.col("_path"), "p")))


def fit(labelled: DataFrame) -> PipelineModel:
    """labelled: (url, label); small, so one partition holds it."""
    tf = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True)
    lr = LogisticRegression(featuresCol="_features", labelCol="label", maxIter=50, regParam=0.01, standardization=False)
    return Pipeline(stages=[tf, lr]).fit(with_grams(labelled.coalesce(1), "url"))


def judged(pages: DataFrame, model: PipelineModel, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict, score (that of blocking)."""
    found = model.transform(with_grams(pages.select(id_col, url_col), url_col))
    rule, says = rule_of(F.col("_host"), F.col("_path"), rules)
    score = vector_to_array("probability")[1]
    own = F.when(score >= 0.5, "block").otherwise("allow")
    return found.select(id_col, F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(says, own).alias("verdict"), score.alias("score"))
