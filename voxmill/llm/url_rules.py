"""URL filters: listed rules first, then association rules mined from labelled URLs.

A listed rule names a host and the start of a path; it fits the host and its subdomains, and of all
rules that fit, the longest decides; of equally long ones, the one that is listed last. Other URLs are
judged by rules that FP-growth mines from the tokens of labelled URLs: combinations of tokens that
imply a bad page. They are pruned by support, by lift, and by the lower bound of an interval of their
confidence, so that a rule which few rows show must be surer than one which many do. Rules that say
less than a shorter one are left out.

A mined rule is indexed under its rarest token. A URL's tokens meet the index in an equality join,
and a rule matches if the URL has its other tokens too. So a token that most URLs have costs nothing
unless a rule has no rarer one.

A null URL, and one without ``://``, has an empty host and path and no token: it is allowed. Repeated
rows get the same verdict; URLs of any length are read whole; other columns are not read. Without
labels, or if no rule is frequent and sure enough, everything that no listed rule names is allowed.
An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label:bad"
RULES = "token string, others array<string>, confidence double, lift double, rows long"
#: An index of at most so many rules is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The listed rules.
LISTED = (
    ListedRule("allow", "com", "/"),
    ListedRule("block", "example.com", "/en/"),
    ListedRule("allow", "www.example.com", "/en/"),
    ListedRule("block", "net", "/es/"),
    ListedRule("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host and their parts, path segments, extension, query, fragment.

    Numbers in a path name single pages and are left out.
    """
    host, path = url_host(url), url_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(host, r"[.\-]"), lambda x: x != "")
    segments = F.filter(F.split(path, "[/.]"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    fragment = F.regexp_extract(url, "#(.*)$", 1)
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(url, "^([a-zA-Z]+)://", 1)))
    tokens = F.concat(
        scheme,
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(segments, lambda x: F.concat(F.lit("p:"), x)),
        F.transform(query, lambda x: F.concat(F.lit("q:"), x)),
        F.when(fragment != "", F.array(F.concat(F.lit("f:"), fragment))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.contains("://"), F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def listed_rule(host: Column, path: Column, rules: tuple[ListedRule, ...], field: str) -> Column:
    """``name`` or ``verdict`` of the longest listed rule that fits; null if none does."""
    result = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        of_host = (host == rule.host) | host.endswith("." + rule.host)
        result = F.when(of_host & path.startswith(rule.path), F.lit(getattr(rule, field))).otherwise(result)
    return result


def least_confidence(share: Column, rows: Column, z: float) -> Column:
    """Lower bound of the score interval of a share among ``rows``."""
    centre = share + z * z / (2 * rows)
    spread = z * F.sqrt((share * (1 - share) + z * z / (4 * rows)) / rows)
    return (centre - spread) / (1 + z * z / rows)


def mine_rules(urls: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5, min_lift: float = 1.5, z: float = 1.96) -> DataFrame:
    """token, others, confidence, lift and rows of each mined rule that implies a bad page; ``token`` is its rarest.

    ``urls`` has url and bad (boolean). FP-growth runs distributed over all labelled rows. A rule is
    sure if the lower bound of its confidence (``z`` standard errors) is ``min_confidence`` or more.
    Fewer rows than ``z * z * c / (1 - c)`` for that confidence c cannot show any rule to be sure,
    whatever they say; the support floor is not set below that, and no rule is lost by it.
    """
    items = urls.where("bad is not null and url is not null").select(
        F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    items = materialize(items)
    n = items.count()
    if n == 0:
        return items.sparkSession.createDataFrame([], RULES)
    needed = z * z * min_confidence / (1 - min_confidence)
    support = min(1.0, max(min_support, needed / n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    implied = model.associationRules.where((F.size("consequent") == 1) & F.array_contains("consequent", BAD) & (F.col("lift") >= min_lift))
    rows = F.round(F.col("support") * n / F.col("confidence")).cast("long")
    sure = implied.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", rows.alias("rows"))
    sure = materialize(sure.where(least_confidence(F.col("confidence"), F.col("rows"), z) >= min_confidence).where(F.size("antecedent") > 0))
    # A rule that has all tokens of a shorter one blocks nothing that the shorter does not; found by the shorter's first token.
    longer = sure.select("antecedent", F.explode("antecedent").alias("first"))
    shorter = sure.select(F.col("antecedent")[0].alias("first"), F.col("antecedent").alias("less"))
    implied_by = (F.size("less") < F.size("antecedent")) & (F.size(F.array_intersect("less", "antecedent")) == F.size("less"))
    redundant = longer.join(shorter, "first").where(implied_by).select("antecedent").distinct()
    kept = sure.join(redundant, "antecedent", "left_anti")
    # Frequencies of single tokens are frequent item sets of one.
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    ranked = kept.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    rarest = ranked.groupBy("antecedent", "confidence", "lift", "rows").agg(F.min(F.struct("freq", "token"))["token"].alias("token"))
    return materialize(rarest.select("token", F.array_remove("antecedent", F.col("token")).alias("others"), "confidence", "lift", "rows"))


def judge_urls(pages: DataFrame, mined: DataFrame, rules: tuple[ListedRule, ...] = LISTED) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    Rows that a mined rule may block are numbered, and their tokens meet the index; a row's matches are
    summed up where the row lies, before its number is shuffled, so a URL that many rows share is no hot key.
    """
    url = F.col("url")
    parsed = pages.select("page_id", "url", url_host(url).alias("host"), url_path(url).alias("path"))
    named = parsed.withColumn("rule", listed_rule(F.col("host"), F.col("path"), rules, "name"))
    named = named.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules, "verdict"))
    index = mined.select("token", "others")
    if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    listed = named.where("rule is not null").select("page_id", "host", "path", "rule", F.col("listed").alias("verdict"))
    open_ = named.where("rule is null").select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", url_tokens(url).alias("tokens"))
    met = open_.select("*", F.explode_outer("tokens").alias("token")).join(index, "token", "left")
    fits = F.col("others").isNotNull() & (F.size(F.array_except("others", "tokens")) == 0)
    judged = met.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("bad"))
    found = judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
    return listed.unionByName(found)


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and bad: a page is labelled through the number in its path, which is the doc_id of its text.

    Bad is what ``labels`` marks as low quality or as toxic.
    """
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    number = F.regexp_extract("url", r"://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[./?#]|$)", 1)
    numbered = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    return numbered.join(known, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
