"""URL filters: listed rules first, association rules mined from labels for the rest.

Listed rules name a host and the begin of a path; a rule fits its host and all subdomains, and the longest wins.

URLs without a listed rule are judged by association rules. Spark's FP-growth mines the token combinations of labelled
URLs; a combination becomes a rule when the label `block` follows it with enough confidence and support, and when no part
of it is a rule already. Rules stand in an inverted index under their rarest token: a URL meets a rule only through that
token and fits it if it has all the rule's tokens. Without a fitting rule a URL is allowed.

Tokens are the dot-separated labels of the host, their hyphen-separated words, the directories of the path without digits, the
suffix of its last part and the names of query parameters.

Learning reads distinct labelled URLs, at most `LEARN_URLS` by a hash, and all tokens of each; judging reads all of every
URL. Since only rules without a rule as a part are used, FP-growth gets no token that cannot be in one together with others:
tokens too rare beside the label, tokens that are rules alone, tokens of all URLs, and all but one of the tokens that stand in
the same URLs, which take its place in the rules found. No rule is lost by this, and rules have no greatest length: the work
still grows fast with the number of other tokens that many URLs share.

Cases: a null url, or one without `://`, has empty host and path, no tokens and the verdict allow. Null labels teach
nothing. Repeated rows are judged one by one; repeated page_ids get one row per input row. Without labels there are no
rules. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneloom.llm.text import written

#: Fixed values of the contract: host, begin of the path, verdict.
LISTED = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LEARN_URLS = 200_000
LEAST_SUPPORT = 0.001
LEAST_ROWS = 8
LEAST_CONFIDENCE = 0.7
BLOCK = "label:block"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = LISTED) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, host first."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    folders = F.filter(F.split(F.regexp_extract(path, r"(?s)^(.*)/", 1), "/"), lambda x: (F.length(x) > 0) & ~x.rlike("[0-9]"))
    suffix = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    kinds = (("host:", labels), ("word:", words), ("path:", folders), ("type:", F.array(suffix)), ("query:", names))
    return F.array_distinct(F.concat(*(_named(kind, values) for kind, values in kinds)))


def _named(kind: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: F.length(x) > 0), lambda x: F.concat(F.lit(kind), x))


_RULES = "tokens array<string>, confidence double, support double"


def mine(labelled: DataFrame, support: float = LEAST_SUPPORT, rows: int = LEAST_ROWS, confidence: float = LEAST_CONFIDENCE, most: int = LEARN_URLS, shortest: bool = False) -> DataFrame:
    """(tokens, confidence, support) of the rules for `labelled` (url, bad): see the module.

    With `shortest`, rules that have a rule as a part may be missing, and no others.
    """
    known = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("bad"))
    known = known.orderBy(F.xxhash64("url"), "url").limit(most)
    baskets = written(known.select("url", "bad", tokens_of(F.col("url")).alias("items")).where(F.size("items") > 0), "url-baskets")
    n = baskets.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], _RULES)
    share = min(1.0, max(support, rows / n))
    if not shortest:
        return written(_grown(baskets, share, confidence), "url-rules")
    each = baskets.select("url", "bad", F.explode("items").alias("token"))
    counted = each.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("both"), F.bit_xor(F.xxhash64("url")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "url")).alias("h2"))
    counted = written(counted.where(F.col("both") >= math.ceil(share * n)), "url-tokens")
    sure = F.col("both") / F.col("n")
    alone = counted.where(sure >= confidence).select(F.array("token").alias("tokens"), sure.alias("confidence"), (F.col("both") / n).alias("support"))
    # tokens of the same URLs: the first by name stands for all
    same = written(counted.where((sure < confidence) & (F.col("n") < n)).groupBy("n", "h1", "h2").agg(
        F.min("token").alias("_chosen"), F.array_sort(F.collect_list("token")).alias("_members")).select("_chosen", "_members"), "url-classes")
    chosen = each.join(F.broadcast(same.select("_chosen")), F.col("token") == F.col("_chosen"), "left").groupBy("url").agg(F.max("bad").alias("bad"), F.collect_list("_chosen").alias("items"))
    found = _grown(written(chosen.select("bad", "items"), "url-chosen"), share, confidence)
    members = found.select("tokens", "confidence", "support", F.explode("tokens").alias("_token")).join(F.broadcast(same), F.col("_token") == F.col("_chosen")).groupBy("tokens").agg(
        F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.collect_list("_members").alias("_members"))
    each_of = F.aggregate(
        "_members", F.array(F.array().cast("array<string>")), lambda made, some: F.flatten(F.transform(made, lambda m: F.transform(some, lambda x: F.concat(m, F.array(x))))))
    return written(alone.unionByName(members.select(F.explode(each_of).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))), "url-rules")


def _grown(baskets: DataFrame, share: float, confidence: float) -> DataFrame:
    """The rules of `baskets` (bad, items) for the label by FP-growth."""
    labelled = baskets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(labelled)
    return model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")


def shortest_rules(rules: DataFrame) -> DataFrame:
    """Rules of which no part is a rule: a part that blocks makes the longer combination superfluous."""
    one = rules.select("tokens", F.explode("tokens").alias("_t"))
    parts = rules.select(F.col("tokens").alias("_part"), F.element_at("tokens", 1).alias("_t"))
    longer = one.join(parts, "_t").where((F.size("_part") < F.size("tokens")) & (F.size(F.array_except("_part", "tokens")) == 0)).select("tokens").distinct()
    return rules.join(longer, "tokens", "left_anti")


def judge(pages: DataFrame, labelled: DataFrame, listed_rules: tuple[tuple[str, str, str], ...] = LISTED) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, evidence (the tokens of the surest mined rule that fits, or null)."""
    url = F.col("url").cast("string")
    host, path = F.col("host"), F.col("path")
    name, says = listed(host, path, listed_rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("*", name.alias("rule"), says.alias("says"))
    rules = shortest_rules(mine(labelled, shortest=True))
    # the inverted index: each rule under its token that is rarest among the rules' URLs
    open_urls = rows.where("rule is null and url is not null").select("url").distinct().select("url", tokens_of(F.col("url")).alias("has"))
    often = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("rules_with"))
    rarest = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(often, "token").groupBy("tokens", "confidence").agg(
        F.min(F.struct("rules_with", "token"))["token"].alias("token"))
    index = written(rarest.groupBy("token").agg(F.collect_list(F.struct("confidence", "tokens")).alias("under")), "url-index")
    hits = open_urls.select("url", "has", F.explode("has").alias("token")).join(index, "token").select(
        "url", F.filter("under", lambda r: F.size(F.array_except(r["tokens"], F.col("has"))) == 0).alias("fits")).where(F.size("fits") > 0)
    surest = hits.groupBy("url").agg(F.max(F.array_max("fits")).alias("best")).select("url", F.col("best.tokens").alias("evidence"))
    judged = rows.join(surest, "url", "left")
    verdict = F.coalesce("says", F.when(F.col("evidence").isNotNull() & F.col("rule").isNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("evidence")).alias("evidence"))
