"""URL filters by association rules (operator 2).

A url becomes a set of tokens (host labels, registered domain, path segments, query keys,
fragment); of tokens that always occur together on the labelled pages one stands for all.
Spark's FP-growth mines the token sets of the bad pages; through an inverted index from
each set's rarest token it is counted on how many labelled pages a set occurs. A set is a
rule if it has enough bad pages, if enough of its pages are bad, also at the lower bound of
that share against the share of all pages, and if no smaller set in it is as sure. Rules are
matched through the same index. A list of host/path rules comes before the mined ones.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut

#: Bad pages that a rule needs, at any size of the input, and the share of its pages that is bad.
MIN_BAD, MIN_CONFIDENCE = 5, 0.5
#: Standard deviations by which that share lies above the one of all pages (Wilson's bound).
DEVIATIONS = 1.645
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (host, path, verdict): a rule fits its host and all subdomains, under its path; the longest wins.
LISTED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts(url):
    """(host, path) columns; both empty where the url is null or has no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, UPPER.lower()), F.regexp_extract(url, pattern, 2)


def listed(host, path, rules=None):
    """(rule, verdict) columns of the longest rule that fits, else null."""
    rules = sorted(LISTED if rules is None else rules, key=lambda r: -len(r[0] + r[1]))
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(rules):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url):
    """Distinct tokens of a url; those of its name and place in it, digits folded to 0."""
    host, path = parts(url)
    labels = F.split(host, r"\.")
    host_tokens = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    domain = F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")))
    path_tokens = F.transform(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    query_tokens = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_replace(F.regexp_replace(x, r"(?s)=.*", ""), "[0-9]+", "0")))
    fragment = F.array(F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("f:#")))
    return F.array_distinct(F.filter(F.concat(host_tokens, domain, path_tokens, query_tokens, fragment), lambda x: x.isNotNull() & (F.length(x) > 2)))


def distinct_tokens(labelled: DataFrame) -> DataFrame:
    """labelled: id, tokens. The tokens without those that another one always goes with: the first by name stays."""
    spread = labelled.select("id", F.explode("tokens").alias("token"))
    sets = spread.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    return sets.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")


def mine(labelled: DataFrame, min_bad: int = MIN_BAD, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled: id (distinct), tokens array, bad boolean. Rules: antecedent (sorted), n_bad, n, confidence.

    Rows without a label don't count.
    """
    spark = labelled.sparkSession
    labelled = labelled.filter("bad is not null")
    total, bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if bad < min_bad:
        return spark.createDataFrame([], "antecedent array<string>, n_bad long, n long, confidence double")
    own = broadcast_if_small(cut(distinct_tokens(labelled)), 200_000)
    baskets = labelled.select("id", "bad", F.explode("tokens").alias("token")).join(own, "token").groupBy("id", "bad").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    baskets = cut(baskets)
    model = FPGrowth(itemsCol="tokens", minSupport=(min_bad - 0.5) / bad, minConfidence=0.0).fit(baskets.filter("bad"))
    sets = cut(model.freqItemsets.select(F.sort_array("items").alias("antecedent"), F.col("freq").alias("n_bad")))
    counted = holding(baskets.select("id", "tokens"), sets.select("antecedent")).groupBy("antecedent").agg(F.count("*").alias("n"))
    share, z2 = F.col("n_bad") / F.col("n"), DEVIATIONS**2
    bound = (share + z2 / (2 * F.col("n")) - DEVIATIONS * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n"))
    rules = sets.join(counted, "antecedent").withColumn("confidence", share).filter((share >= min_confidence) & (bound > bad / total))
    rules = cut(rules.select("antecedent", "n_bad", "n", "confidence"))
    # a rule goes when one of fewer of its tokens is as sure: each meets its subsets
    some = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("antecedent")) - 2).cast("int"))
    subset = lambda mask: F.filter("antecedent", lambda t, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    longer = rules.filter(F.size("antecedent") > 1).select(F.col("antecedent").alias("of"), F.col("confidence").alias("c"), F.explode(F.transform(some, subset)).alias("antecedent"))
    worse = longer.join(rules, "antecedent").filter(F.col("confidence") >= F.col("c")).select(F.col("of").alias("antecedent")).distinct()
    return rules.join(worse, "antecedent", "left_anti")


def holding(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows: id, tokens; rules: antecedent. (id, antecedent) of each row and rule whose tokens it has, by an index from each rule's rarest token."""
    spread = rows.select("id", "tokens", F.explode("tokens").alias("token"))
    used = broadcast_if_small(cut(rules.select(F.explode("antecedent").alias("token")).distinct()), 200_000)
    common = spread.select("token").join(used, "token").groupBy("token").count()
    index = rules.select("antecedent", F.explode("antecedent").alias("token")).join(common, "token", "left")
    index = index.groupBy("antecedent").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("rarest")).select("antecedent", F.col("rarest.token").alias("token"))
    return spread.join(broadcast_if_small(cut(index)), "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("id", "antecedent")


def filter_urls(pages: DataFrame, labels: DataFrame, url_col: str = "url", page_id_col: str = "page_id", label_id_col: str = "doc_id", rules=None, min_bad: int = MIN_BAD, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pages with host, path, rule (the listed rule that fits, else null) and verdict, allow or block.

    labels name pages by id; a page is bad if it is labelled of no quality or toxic (null
    counts as not). Pages without a fitting listed rule are blocked if a mined rule fits. A
    null url, or one without ://, has empty host and path and no tokens but those of its query,
    and fits no listed rule. Repeated rows of pages or labels count, each as a labelled page,
    and are judged alike. Without min_bad bad pages nothing is mined. Columns of the names
    made here are replaced.
    """
    url = F.col(url_col)
    pages = pages.drop("host", "path", "rule", "verdict", "_hit", "_verdict")
    d = pages.select(F.col(page_id_col).alias("_id"), url.alias("url")).filter("url is not null").withColumn("tokens", tokens(F.col("url")))
    bad = labels.select(F.col(label_id_col).alias("_id"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    labelled = d.join(bad, "_id").select(F.monotonically_increasing_id().alias("id"), "tokens", "bad")
    found = mine(cut(labelled), min_bad, min_confidence).select("antecedent")
    once = d.select(F.col("url").alias("id"), "tokens").distinct()
    hit = holding(once, found).select(F.col("id").alias(url_col), F.lit(True).alias("_hit")).distinct()
    host, path = parts(url)
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_verdict": verdict}).join(hit, url_col, "left")
    return out.select(*pages.columns, "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_hit"), "block").otherwise("allow")).alias("verdict"))
