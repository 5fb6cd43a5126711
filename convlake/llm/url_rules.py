"""URL verdicts by association rules (native).

URLs become sets of tokens (host, its labels and words, path parts, query keys).
Rules "tokens -> bad" need a number of bad URLs, a confidence and a lift. Tokens
that pass alone are rules, by the same number at every table size; Spark's
FP-growth mines the combinations of the others, by support, from the bad URLs,
and their confidence comes from all labelled URLs. A rule that holds a passing token could not change a verdict,
so such tokens need not be mined. Rules are matched by an inverted index: each
waits for its tokens under one of them, and a URL that holds all of a rule's
tokens is blocked. Given host and path rules come first; the longest that fits
decides.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlake.llm.frames import stored

#: Bad URLs that a rule needs; a combination of tokens also this share of all labelled URLs,
#: so that their number does not grow with the table.
MIN_COUNT = 20
MIN_SUPPORT = 0.004
MIN_CONFIDENCE = 0.6
MIN_LIFT = 2.0
#: (host/path, verdict), fixed by the contract.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From there up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Different tokens of a URL; digits in path parts are all the same."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    parts = F.regexp_replace(path, "[0-9]+", "0")
    tokens = F.concat(
        F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("scheme:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("part:"), x)),
        F.transform(F.filter(F.split(host, r"[.\-]"), lambda x: host.contains("-")), lambda x: F.concat(F.lit("word:"), x)),
        F.transform(F.split(parts, "/"), lambda x: F.concat(F.lit("path:"), x)),
        F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1))))
    return F.array_distinct(F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda x: ~x.endswith(":")))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest given rule that fits, and its verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last to fit wins
        at = text.index("/")
        own, start = text[:at], text[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT,
         min_count: int = MIN_COUNT, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(rule_id, tokens, token, confidence, support) of the rules that stay: token is
    the rarest of the tokens, support their share of bad URLs among the labelled. ``labelled`` has tokens (different
    strings) and bad (boolean). A rule stays only if no rule on a part of its
    tokens is as confident. Without bad rows there is none."""
    rows = stored(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("key")), "baskets")
    n, n_bad = rows.agg(F.count("*"), F.count(F.when(F.col("bad"), 1))).first()
    if n_bad < min_count:
        return labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, token string, confidence double, support double")

    floor = max(min_count, min_support * n)  # of combinations

    def kept(counts: DataFrame) -> DataFrame:
        """Rules among counts (tokens, of, bad)."""
        return (counts.withColumn("confidence", F.col("bad") / F.col("of")).withColumn("support", F.col("bad") / n)
                .filter((F.col("bad") >= min_count) & (F.col("confidence") >= min_confidence) & (F.col("confidence") * n >= min_lift * n_bad))
                .select(F.xxhash64("tokens").alias("rule_id"), "tokens", "token", "confidence", "support"))

    bad = F.count(F.when(F.col("bad"), 1)).alias("bad")
    singles = stored(rows.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("of"), bad), "singles")
    alone = kept(singles.select(F.array("token").alias("tokens"), "token", "of", "bad"))
    # tokens for combinations: often enough with bad, and no rule by themselves
    usable = singles.filter(F.col("bad") >= floor).join(alone.select("token"), "token", "left_anti").select("token")
    left = stored(rows.select("key", "bad", F.explode("tokens").alias("token")).join(usable, "token")
                  .groupBy("key", "bad").agg(F.array_sort(F.collect_list("token")).alias("tokens")), "combinations")
    model = FPGrowth(itemsCol="tokens", minSupport=min(1.0, (floor - 0.5) / n_bad)).fit(left.filter("bad"))
    sets = stored(model.freqItemsets.filter((F.size("items") > 1) & (F.col("freq") >= floor))
                  .select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad")).withColumn("rule_id", F.xxhash64("tokens")), "itemsets")
    rarest = (sets.select("rule_id", F.explode("tokens").alias("token")).join(singles, "token")
              .groupBy("rule_id").agg(F.min_by("token", F.struct("of", "token")).alias("token")))
    sets = stored(sets.join(rarest, "rule_id"), "itemsets")
    # only the good URLs remain to be counted
    good = matched(left.filter("not bad"), sets).groupBy("rule_id").agg(F.count("*").alias("good"))
    many = kept(sets.join(good, "rule_id", "left").select("tokens", "token", "bad", (F.col("bad") + F.coalesce("good", F.lit(0))).alias("of")))
    rules = stored(alone.unionByName(many), "rules")
    # prune by containment through the inverted index: parts of a rule share its tokens
    flat = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    inside = (flat.alias("a").join(flat.alias("b"), F.expr("a.token = b.token and size(a.tokens) < size(b.tokens) and a.confidence >= b.confidence"))
              .groupBy("a.tokens", "b.tokens").agg(F.count("*").alias("n")).toDF("part", "whole", "n")
              .filter(F.col("n") == F.size("part")).select(F.col("whole").alias("tokens")).distinct())
    return stored(rules.join(inside, "tokens", "left_anti").select("rule_id", "tokens", "token", "confidence", "support"), "rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id) of ``urls`` (key, tokens) that hold all tokens of a rule.
    Rules are posted under their rarest token, so a URL meets each once and common
    tokens post little."""
    posted = rules.select("rule_id", F.col("tokens").alias("needed"), "token")
    return (urls.select("key", "tokens", F.explode("tokens").alias("token")).join(posted, "token")
            .filter(F.size(F.array_except("needed", "tokens")) == 0).select("key", "rule_id"))


def verdicts(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
             label_key: Column | None = None, **bounds: float) -> DataFrame:
    """(id, host, path, rule, verdict, n_mined) of every row.

    ``labels`` has (label_id, bad). ``label_key`` gives a page's label id; by
    default the last number in its path. A null URL or one without ``://`` has
    empty host and path, and no tokens, so it is allowed. A label id marked both
    ways counts as bad. Repeated pages get the same verdict.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    key = label_key if label_key is not None else F.nullif(F.regexp_extract(path, r"(?s)^.*?([0-9]{1,18})[^0-9]*$", 1), F.lit("")).cast("long")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), key.alias("label_id"))
    marks = labels.groupBy("label_id").agg(F.max("bad").alias("bad")).filter("bad is not null")
    urls = base.filter("host <> ''").select(F.col("url").alias("key"), "label_id", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(urls.join(marks, "label_id"), **bounds)
    hits = matched(urls.select("key", "tokens").distinct(), mined).groupBy("key").agg(F.count("*").alias("n_mined"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (base.join(hits, F.col("url") == F.col("key"), "left")
            .select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("n_mined") > 0, "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("n_mined", F.lit(0)).alias("n_mined")))
