"""URL filters by association rules.

FP-growth mines combinations of URL tokens together with the label of the page. Rules "tokens -> bad" of enough support
and confidence are indexed by their rarest token; a page looks up its tokens there, and a rule fires if the page has
all of its tokens. Given rules by host and path go first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import ASCII_UPPER, discard, materialize, table

# Verdict, host and path of the given rules.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Least bad pages that have a rule's tokens, and least share of bad pages among those with its tokens. A bad site is
#: found by its own pages, however many other sites there are.
MIN_ROWS, MIN_CONFIDENCE = 20, 0.6
#: Least share of the labelled pages that these bad pages are; it bounds the tokens that are broadcast.
MIN_SUPPORT = 1e-4
#: What stands for a bad page beside its classes, and what stands before every class, so that none can be taken for it.
BAD, CLASS = "bad", "="
#: Tasks that the rows of one token set are dealt over.
SALTS = 32


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty if url is null or has no "://"."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest given rule that fits and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, sorted: scheme, top label, site, first label, labels between first and site, words
    of labels with hyphens, path segments (those with digits are one token), suffix of the path, query keys, and
    whether there is a fragment."""
    u = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    inner = F.transform(F.filter(labels, lambda x, i: (i > 0) & (i < n - 2)), lambda x: F.concat(F.lit("label="), x))
    hyphened = F.filter(labels, lambda x, i: (i < n - 1) & x.contains("-"))
    words = F.transform(F.filter(F.flatten(F.transform(hyphened, lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.when(x.rlike("[0-9]"), F.lit("seg=#")).otherwise(F.concat(F.lit("seg="), x)))
    keys = F.transform(F.filter(F.split(F.regexp_extract(u, r"[?]([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.regexp_extract(x, r"^([^=]*)", 1)))
    one = F.array(
        F.concat(F.lit("scheme="), F.regexp_extract(u, r"^([a-z]+)://", 1)),
        F.when(n > 0, F.concat(F.lit("top="), F.element_at(labels, -1))),
        F.when(n > 1, F.concat(F.lit("site="), F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1))),
        F.when(n > 2, F.concat(F.lit("first="), F.element_at(labels, 1))),
        F.when(path.rlike(r"\.[a-z]+$"), F.concat(F.lit("suffix="), F.regexp_extract(path, r"\.([a-z]+)$", 1))),
        F.when(F.instr(u, "#") > 0, F.lit("fragment")),
    )
    return F.array_sort(F.array_distinct(F.filter(F.concat(one, inner, words, segments, keys), lambda x: x.isNotNull())))


@dataclass(frozen=True)
class Rules:
    """rules: antecedent (classes of tokens), confidence and key (the rarest of them); classes: token and class. Tokens
    that stand in the same labelled rows are one class, named after the first of them; only those of enough support are
    there."""

    rules: DataFrame
    classes: DataFrame


def mine(labelled: DataFrame, items: str, bad: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = 1) -> Rules:
    """Rules "tokens -> bad": token combinations whose rows are bad at least so often, and that at least min_rows bad rows
    have, which are at least min_support of all rows.

    labelled has an array of distinct tokens and a boolean; rows where either is null are left out. Tokens that always come
    together are mined as one, so thirty keys of one kind of url are one item, not 2**30 sets; a row has a class if it has
    one of its tokens, as the rules of every token of a class would say. key is the rule's rarest class among labelled
    rows (ties: the first in order). No labelled rows give no rules. Only tokens that stand in enough bad rows can be in a
    rule, and only these are mined; they are as many as those of a row divided by min_support at most, whatever the
    number of rows, and are broadcast.
    """
    rows = materialize(labelled.where(F.col(items).isNotNull() & F.col(bad).isNotNull()).select(F.col(items).alias("items"), F.col(bad).alias("bad"), F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    least = max(min_rows, math.ceil(min_support * total))
    each = rows.select("row", "bad", F.explode("items").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    seen = seen.where(F.col("n_bad") >= least).drop("n_bad")
    first = seen.groupBy("n", "x", "y").agg(F.min("token").alias("class"))
    classes = materialize(seen.join(first, ["n", "x", "y"]).select("token", "class", "n"))
    sets = each.join(F.broadcast(classes), "token").groupBy("row").agg(F.collect_set("class").alias("own"))
    whole = rows.join(sets, "row", "left").select(F.concat(F.transform(F.coalesce("own", F.array().cast("array<string>")), lambda x: F.concat(F.lit(CLASS), x)), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    baskets = materialize(whole)
    if not total:
        found = labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double")
    else:
        # Half a row less than least, as the share times the number of rows is rounded up again.
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_confidence).fit(baskets)
        found = model.associationRules.where(F.col("consequent")[0] == BAD).select(F.array_sort(F.transform("antecedent", lambda x: F.substring(x, F.lit(len(CLASS) + 1), F.length(x)))).alias("antecedent"), "confidence")
    single = classes.where("token = class").select(F.col("class").alias("one"), "n")
    by = found.select("antecedent", "confidence", F.explode("antecedent").alias("one")).join(F.broadcast(single), "one")
    rules = materialize(by.groupBy("antecedent", "confidence").agg(F.min_by("one", F.struct("n", "one")).alias("key")))
    for done in (rows, baskets):
        discard(done)
    return Rules(rules, classes.select("token", "class"))


def fired(pages: DataFrame, items: str, rules: Rules) -> DataFrame:
    """The distinct token sets of pages for which a rule fires, with the highest confidence."""
    sets = pages.select(items).distinct()
    known = sets.select(items, F.explode(items).alias("token")).join(F.broadcast(rules.classes), "token").groupBy(items).agg(F.collect_set("class").alias("own"))
    met = known.select(items, "own", F.explode("own").alias("key")).join(rules.rules, "key").where(F.size(F.array_except("antecedent", "own")) == 0)
    return met.groupBy(items).agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, url: str, rules: Rules, keys: list[str]) -> DataFrame:
    """keys, host, path, rule, verdict and confidence for every row of pages.

    The longest given rule decides; else a row is blocked if a mined rule fires, and allowed if none does. A url that
    is null or has no "://" has empty host and path, and no given rule. Equal rows each keep their row.
    """
    host, path = host_path(F.col(url))
    cut = pages.select(*keys, F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    cut = cut.withColumn("_tokens", tokens(F.col("_url"), F.col("host"), F.col("path")))
    rule, verdict = given_rule(F.col("host"), F.col("path"))
    # Rows of one token set, such as those without a url, are dealt over SALTS tasks.
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*keys, "_url"), F.lit(SALTS)))
    answers = fired(cut, "_tokens", rules).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = salted.join(answers, ["_tokens", "_salt"], "left")
    own = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(*keys, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "confidence")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages. A page's label is that of the document with its number: bad if its quality is 0."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    host, path = host_path(F.col("url"))
    bad = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    labelled = pages.join(bad, pages.page_id == bad.doc_id).select(tokens(F.col("url"), host, path).alias("items"), "bad")
    return judge(pages, "url", mine(labelled, "items", "bad", min_rows=MIN_ROWS), ["page_id"])


OP3_SQL = rf"""
WITH a AS (
  SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages
), b AS (
  SELECT page_id, u, translate(regexp_extract(after, '^([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}') AS host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), l AS (
  SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels FROM b
), t AS (
  SELECT page_id, host, path, list_sort(list_distinct(list_filter(list_concat([
      'scheme=' || regexp_extract(u, '^([a-z]+)://', 1),
      CASE WHEN len(labels) > 0 THEN 'top=' || labels[-1] END,
      CASE WHEN len(labels) > 1 THEN 'site=' || labels[-2] || '.' || labels[-1] END,
      CASE WHEN len(labels) > 2 THEN 'first=' || labels[1] END,
      CASE WHEN regexp_matches(path, '\.[a-z]+$') THEN 'suffix=' || regexp_extract(path, '\.([a-z]+)$', 1) END,
      CASE WHEN instr(u, '#') > 0 THEN 'fragment' END],
    CASE WHEN len(labels) > 3 THEN list_transform(labels[2 : len(labels) - 2], lambda x: 'label=' || x) ELSE [] END,
    CASE WHEN len(labels) > 1 THEN list_transform(list_filter(flatten(list_transform(list_filter(labels[1 : len(labels) - 1], lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'word=' || x) ELSE [] END,
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN 'seg=#' ELSE 'seg=' || x END),
    list_transform(list_filter(string_split(regexp_extract(u, '[?]([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'key=' || regexp_extract(x, '^([^=]*)', 1))
  ), lambda x: x IS NOT NULL))) AS items FROM l
), y AS (
  SELECT items, bad FROM t JOIN (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q ON q.doc_id = t.page_id
), s AS (
  SELECT bad, mask, list_filter(items, lambda x, i: (mask >> (i - 1)::INT) & 1 = 1) AS part FROM (SELECT items, bad, unnest(range(1, 1 << len(items)::INT)) AS mask FROM y)
), r AS (
  SELECT part, count(*) FILTER (bad) / count(*) AS confidence FROM s GROUP BY part
  HAVING count(*) FILTER (bad) >= greatest({MIN_ROWS}, ceil({MIN_SUPPORT} * (SELECT count(*) FROM y))) AND count(*) FILTER (bad) / count(*) >= {MIN_CONFIDENCE}
), f AS (
  SELECT t.items, max(confidence) AS confidence FROM (SELECT DISTINCT items FROM t) t JOIN r ON list_has_all(t.items, r.part) GROUP BY t.items
), v AS (
  SELECT page_id, host, path, confidence,
    CASE {" ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))} END AS rule
  FROM t LEFT JOIN f USING (items)
)
SELECT page_id, host, path, rule, confidence,
  CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{w}'" for w, h, p in RULES)} WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""
