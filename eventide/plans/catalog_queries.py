"""Projections, filters, joins, aggregates, sets and samples over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.functions import columns as fn
from eventide.operators import curate, vectors
from eventide.plans.tables import TIMED_SQL, annotations, collector, table

QUERIES, SQL, query = collector()
T = TIMED_SQL

# Projections


@query("prj01_rename", "SELECT c_custkey AS customer, c_name AS name, c_mktsegment AS segment FROM customer")
def rename(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@query("prj02_duration", f"WITH {T} SELECT event_id, end_us - begin_us AS duration_us FROM ann")
def duration(spark, d):
    return annotations(spark, d).select("event_id", (F.col("end_us") - F.col("begin_us")).alias("duration_us"))


@query("prj03_composite_key", "SELECT doc_id, concat(coalesce(source, ''), coalesce(lang, '')) AS key FROM documents")
def composite_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("key"))


@query("prj04_end", f"WITH {T} SELECT event_id, begin_us + (end_us - begin_us) AS end_us, begin_us + 1000000 AS offset_us FROM ann")
def end(spark, d):
    return annotations(spark, d).select("event_id", (F.col("begin_us") + (F.col("end_us") - F.col("begin_us"))).alias("end_us"), (F.col("begin_us") + 1_000_000).alias("offset_us"))


@query("prj05_midpoint", "SELECT event_id, greatest(0, value - 0.5) AS begin_s, least(300, value + 0.5) AS end_s FROM events")
def midpoint(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0.0), F.col("value") - 0.5).alias("begin_s"), F.least(F.lit(300.0), F.col("value") + 0.5).alias("end_s"))


@query("prj06_units", f"WITH {T} SELECT event_id, begin_us / 1000000.0::DOUBLE AS begin_s FROM ann")
def units(spark, d):
    return annotations(spark, d).select("event_id", (F.col("begin_us") / 1_000_000.0).alias("begin_s"))


@query("prj07_constant", "SELECT p_partkey, 'POS' AS q, 1 AS channel FROM part")
def constant(spark, d):
    rows = table(spark, d, "part").withColumn("q", F.lit("POS"))
    rows = rows if "channel" in rows.columns else rows.withColumn("channel", F.lit(1))
    return rows.select("p_partkey", "q", "channel")


@query("prj08_drop", "SELECT * EXCLUDE (p_type, p_size) FROM part")
def drop(spark, d):
    return table(spark, d, "part").drop("p_type", "p_size")


@query("prj09_value_map", "SELECT event_id, CASE event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' WHEN 'signup' THEN 'c' WHEN 'purchase' THEN 'd' WHEN 'error' THEN 'Unknown' END AS class FROM events")
def value_map(spark, d):
    names = {"view": "a", "click": "b", "signup": "c", "purchase": "d", "error": "Unknown"}
    return table(spark, d, "events").select("event_id", curate.mapped(F.col("event_type"), names).alias("class"))


@query("prj10_relabel", "SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'UNK' ELSE 'POS' END AS q FROM events")
def relabel(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("error", "signup"), "UNK").otherwise("POS").alias("q"))


@query("prj11_membership", "SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'inside' ELSE 'outside' END AS class FROM supplier")
def membership(spark, d):
    inside = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("there"))
    return table(spark, d, "supplier").join(inside, "s_nationkey", "left").select("s_suppkey", F.when(F.col("there"), "inside").otherwise("outside").alias("class"))


@query("prj12_unpivot_first", "SELECT doc_id, CASE WHEN quality = 0 THEN 'quality' ELSE 'toxic' END AS class, CASE WHEN quality = 0 THEN quality ELSE toxic END AS q FROM labels WHERE quality = 0 OR toxic = 0")
def unpivot_first(spark, d):
    return curate.unpivot_first(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"], [0])


@query("prj13_fanout", "WITH l AS (UNPIVOT labels ON quality, toxic INTO NAME class VALUE q) SELECT class, doc_id, q FROM l WHERE class IN (SELECT class FROM l GROUP BY class HAVING count(*) FILTER (q = 1) > 6)")
def fanout(spark, d):
    return curate.fan_out(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"], 1, 6)


@query("prj14_stretch", f"WITH {T} SELECT event_id, begin_us * 2 AS begin_us, end_us * 2 AS end_us, value / 2 AS high_hz FROM ann")
def stretch(spark, d):
    return annotations(spark, d).select("event_id", (F.col("begin_us") * 2).alias("begin_us"), (F.col("end_us") * 2).alias("end_us"), (F.col("value") / 2).alias("high_hz"))


@query("prj16_clip", f"WITH {T} SELECT event_id, least(end_us, 2000000000000) AS end_us FROM ann")
def clip(spark, d):
    return annotations(spark, d).select("event_id", F.least("end_us", F.lit(2_000_000_000_000)).alias("end_us"))


@query("prj17_clamp", "SELECT event_id, greatest(10.0, least(100.0, value))::DOUBLE AS value FROM events")
def clamp(spark, d):
    return table(spark, d, "events").select("event_id", fn.clamp(F.col("value"), 10.0, 100.0).alias("value"))


@query("prj18_19_flags", "SELECT doc_id, coalesce(lang, '') AS lang, coalesce(lang, '') IN ('', 'de', 'es') AS is_nonbio, coalesce(lang, '') NOT IN ('', 'de', 'es') AS is_bio FROM documents")
def flags(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return rows.withColumn("is_nonbio", F.col("lang").isin("", "de", "es")).withColumn("is_bio", ~F.col("is_nonbio"))


# Filters


@query("flt01_equal", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
def equal(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey")


@query("flt02_in", "SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND event_type NOT IN ('error')")
def in_list(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click") & ~F.col("event_type").isin("error")).select("event_id")


@query("flt03_range", "SELECT event_id, value FROM events WHERE value >= 10 AND value < 100 AND user_id > 5")
def in_range(spark, d):
    return table(spark, d, "events").where("value >= 10 and value < 100 and user_id > 5").select("event_id", "value")


@query("flt04_excerpt", f"WITH {T} SELECT event_id FROM ann WHERE begin_us >= 400000000000 AND begin_us < 800000000000 OR end_us >= 400000000000 AND end_us < 800000000000")
def excerpt(spark, d):
    """Events that begin or end in an excerpt; one that spans all of it is missed, as it is where this comes from."""
    inside = lambda c: (F.col(c) >= 400_000_000_000) & (F.col(c) < 800_000_000_000)
    return annotations(spark, d).where(inside("begin_us") | inside("end_us")).select("event_id")


@query("flt05_contains", "SELECT page_id FROM pages WHERE contains(url, 'example.org')")
def contains(spark, d):
    return table(spark, d, "pages").where(F.col("url").contains("example.org")).select("page_id")


@query("flt06_token_prefix", "SELECT o_orderkey FROM orders WHERE split_part(o_orderpriority, '-', 1) = '2'")
def token_prefix(spark, d):
    return table(spark, d, "orders").where(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)) == "2").select("o_orderkey")


@query("flt07_booleans", "SELECT doc_id FROM labels WHERE quality = 1 AND NOT toxic = 1")
def booleans(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    return rows.where(F.col("good") & ~F.col("bad")).select("doc_id")


@query("flt08_allow_list", "SELECT doc_id FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 2)")
def allow_list(spark, d):
    allowed = table(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return table(spark, d, "documents").join(allowed, "source", "left_semi").select("doc_id")


@query("flt09_exclude", "SELECT page_id FROM pages WHERE NOT contains(url, '/de/') AND NOT contains(url, 'utm_')")
def exclude(spark, d):
    return table(spark, d, "pages").where(~F.col("url").contains("/de/") & ~F.col("url").contains("utm_")).select("page_id")


@query("flt10_exists", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def exists(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("flt11_least_duration", f"WITH {T} SELECT event_id FROM ann WHERE end_us - begin_us >= 60000000000")
def least_duration(spark, d):
    return annotations(spark, d).where("end_us - begin_us >= 60000000000").select("event_id")


@query("flt12_most_duration", f"WITH {T} SELECT event_id FROM ann WHERE end_us - begin_us < 60000000000")
def most_duration(spark, d):
    return annotations(spark, d).where("end_us - begin_us < 60000000000").select("event_id")


@query("flt13_confidence", "SELECT event_id FROM events WHERE value > 100.5")
def confidence(spark, d):
    return table(spark, d, "events").where("value > 100.5").select("event_id")


@query("flt14_agreement", "SELECT d.doc_id, d.lang = 'en' AS is_bio FROM documents d JOIN labels l USING (doc_id) WHERE (d.lang = 'en') = (l.quality = 1)")
def agreement(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("lang") == "en").alias("is_bio"), (F.col("quality") == 1).alias("other"))
    return rows.where((F.col("is_bio") & F.col("other")) | (~F.col("is_bio") & ~F.col("other"))).select("doc_id", "is_bio")


@query("flt15_tolerant", "SELECT page_id, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages WHERE try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) IS NOT NULL")
def tolerant(spark, d):
    """Rows whose url holds a number; the others are skipped, not failed on."""
    found = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint").alias("number"))
    return found.where("number is not null")


# Joins


@query("jn01_inner", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def inner(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("jn02_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("jn03_default", "SELECT d.doc_id, coalesce(l.e, true) AS exclude FROM documents d LEFT JOIN (SELECT doc_id, arg_max(quality = 0, toxic) AS e FROM labels GROUP BY doc_id) l USING (doc_id)")
def default(spark, d):
    flags_ = table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("exclude"), F.col("toxic").alias("row"))
    return curate.lookup(table(spark, d, "documents").select("doc_id"), flags_, ["doc_id"], "exclude", F.lit(True), "row")


@query("jn04_strict", "SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def strict(spark, d):
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return curate.strict_lookup(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), names, ["n_regionkey"], "r_name").select("n_nationkey", "r_name")


@query("jn05_semi", "SELECT doc_id FROM documents WHERE (source, lang) IN (SELECT (source, lang) FROM documents GROUP BY source, lang HAVING count(*) >= 8)")
def semi(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.join(curate.frequent(docs, ["source", "lang"], 8), ["source", "lang"], "left_semi").select("doc_id")


@query("jn06_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("jn16_path_key", "SELECT page_id, n_name FROM pages JOIN nation ON n_nationkey = length(regexp_extract(url, '//([^/]*)', 1))")
def path_key(spark, d):
    key = F.length(F.regexp_extract("url", "//([^/]*)", 1))
    n = table(spark, d, "nation")
    return table(spark, d, "pages").withColumn("k", key).join(n, F.col("k") == n.n_nationkey).select("page_id", "n_name")


@query("jn18_nearest", "WITH c AS (SELECT label AS centre, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id, centre, sum(e.x * c.x) / (sqrt(sum(e.x * e.x)) * sqrt(sum(c.x * c.x))) AS score FROM e JOIN c USING (i) GROUP BY vec_id, centre) SELECT vec_id, arg_max(centre, (score, -centre)) AS centre, round(max(score), 5) AS score FROM s GROUP BY vec_id")
def nearest(spark, d):
    rows = table(spark, d, "embeddings")
    centres = vectors.mean_vectors(rows, ["label"], "embedding").select(F.col("label").alias("centre"), F.col("embedding").alias("other"))
    return vectors.nearest(rows, "vec_id", "embedding", centres, "centre", "other").withColumn("score", F.round("score", 5))


@query("ml07_assign", "WITH c AS (SELECT label AS centre, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id, centre, -sum((e.x - c.x) * (e.x - c.x)) AS score FROM e JOIN c USING (i) GROUP BY vec_id, centre) SELECT vec_id, arg_max(centre, (score, -centre)) AS centre, round(max(score), 5) AS score FROM s GROUP BY vec_id")
def assign(spark, d):
    rows = table(spark, d, "embeddings")
    centres = vectors.mean_vectors(rows, ["label"], "embedding").select(F.col("label").alias("centre"), F.col("embedding").alias("other"))
    return vectors.nearest(rows, "vec_id", "embedding", centres, "centre", "other", "l2").withColumn("score", F.round("score", 5))


@query("jn19_matrix", "SELECT d.doc_id, round(coalesce(list_sum(e.embedding::DOUBLE[]), 0), 5) AS total, coalesce(len(e.embedding), 64) AS size FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def matrix(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    full = vectors.filled_matrix(table(spark, d, "documents").select("doc_id"), rows, "doc_id", "embedding", 64)
    return full.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size("embedding").alias("size"))


@query("jn20_compare_counts", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new FROM (SELECT doc_id, count(*) AS n_old FROM labels GROUP BY doc_id) a FULL JOIN (SELECT conv_id AS doc_id, count(*) AS n_new FROM conversations GROUP BY conv_id) b ON a.doc_id = b.doc_id WHERE coalesce(n_old, 0) <> coalesce(n_new, 0)")
def compare_counts(spark, d):
    old = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n_old"))
    new = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n_new"))
    return old.join(new, "doc_id", "full_outer").na.fill(0, ["n_old", "n_new"]).where("n_old <> n_new")


# Aggregates


@query("ag01_having", "SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang HAVING count(*) BETWEEN 4 AND 256")
def having(spark, d):
    return curate.frequent(table(spark, d, "documents"), ["source", "lang"], 4, 256)


@query("ag02_two_thresholds", "SELECT source, lang, count(*) AS n, count(*) FILTER (n_chars > 3000) AS n_if FROM documents GROUP BY source, lang HAVING count(*) >= 12 OR count(*) FILTER (n_chars > 3000) >= 3")
def two_thresholds(spark, d):
    return curate.frequent_or(table(spark, d, "documents"), ["source", "lang"], 12, F.col("n_chars") > 3000, 3)


@query("ag03_count_filtered", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type HAVING count(*) > 15")
def count_filtered(spark, d):
    return curate.frequent(table(spark, d, "events").where("value > 50"), ["event_type"], 16)


@query("ag04_partition", f"WITH {T} SELECT file_id, count(*) AS n, min(begin_us) AS first_us FROM ann GROUP BY file_id")
def partition(spark, d):
    return annotations(spark, d).groupBy("file_id").agg(F.count("*").alias("n"), F.min("begin_us").alias("first_us"))


@query("ag08_stats", "SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS middle, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY l_returnflag")
def stats(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.avg(q), 6).alias("mean"), F.median(q).alias("middle"), F.round(F.stddev_samp(q), 6).alias("std"))


@query("ag09_confusion", "WITH l AS (SELECT quality AS y, toxic AS p FROM labels WHERE quality IS NOT NULL) SELECT round(coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (p = 1), 0), 0), 9) AS precision, round(coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1), 0), 0), 9) AS recall FROM l")
def confusion(spark, d):
    y, p = F.col("quality") == 1, F.col("toxic") == 1
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.count_if(a).cast("double"), F.count_if(b)), F.lit(0.0)), 9)
    return table(spark, d, "labels").where("quality is not null").agg(share(y & p, p).alias("precision"), share(y & p, y).alias("recall"))


@query("ag10_argmax", "SELECT user_id, arg_max(event_type, (value, -event_id)) AS event_type, max(value) AS value FROM events WHERE value > 0 GROUP BY user_id")
def argmax(spark, d):
    return curate.best_detection(table(spark, d, "events"), ["user_id"], "event_type", "value", "event_id")


@query("ag11_mean_vec", "SELECT label, i - 1 AS i, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def mean_vec(spark, d):
    means = vectors.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@query("ag12_accuracy", "SELECT round(avg((quality = toxic)::INT), 9) AS accuracy, round(avg((quality = 0 AND toxic = 1)::INT), 9) AS fp, round(avg((quality = 1 AND toxic = 0)::INT), 9) AS fn FROM labels")
def accuracy(spark, d):
    share = lambda c: F.round(F.avg(c.cast("double")), 9)
    y, p = F.col("quality"), F.col("toxic")
    return table(spark, d, "labels").agg(share(y == p).alias("accuracy"), share((y == 0) & (p == 1)).alias("fp"), share((y == 1) & (p == 0)).alias("fn"))


@query("ag13_snr", "SELECT user_id, round(10 * log10(v / w), 6) AS snr_db FROM (SELECT user_id, var_pop(value) FILTER (event_type = 'click') AS v, var_pop(value) AS w FROM events GROUP BY user_id) WHERE v > 0 AND w > 0")
def snr(spark, d):
    v = F.var_pop(F.when(F.col("event_type") == "click", F.col("value")))
    found = table(spark, d, "events").groupBy("user_id").agg(v.alias("v"), F.var_pop("value").alias("w")).where("v > 0 and w > 0")
    return found.select("user_id", F.round(10 * F.log10(F.col("v") / F.col("w")), 6).alias("snr_db"))


@query("ag14_quantile", "SELECT user_id, round(quantile_cont(value, 0.2), 6) AS floor, round(avg(value) FILTER (value BETWEEN 10 AND 100), 6) AS band FROM events GROUP BY user_id")
def quantile(spark, d):
    band = F.avg(F.when(F.col("value").between(10, 100), F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.percentile("value", 0.2), 6).alias("floor"), F.round(band, 6).alias("band"))


@query("ag15_summary", f"WITH {T} SELECT file_id % 8 AS set_id, count(DISTINCT file_id) AS n_files, round(sum(end_us - begin_us) / 3600000000.0, 4) AS hours, count(*) FILTER (q = 'POS') AS n_events FROM ann GROUP BY ALL")
def summary(spark, d):
    hours = F.round(F.sum(F.col("end_us") - F.col("begin_us")) / 3_600_000_000.0, 4)
    return annotations(spark, d).groupBy((F.col("file_id") % 8).alias("set_id")).agg(F.countDistinct("file_id").alias("n_files"), hours.alias("hours"), F.count_if(F.col("q") == "POS").alias("n_events"))


@query("ag16_pivot", f"WITH {T}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY begin_us, event_id) <= 5 AS first_five FROM ann) SELECT file_id, round(avg(value) FILTER (first_five), 6) AS support, round(avg(value) FILTER (NOT first_five), 6) AS query FROM n GROUP BY file_id")
def pivot(spark, d):
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("begin_us", "event_id"))
    rows = annotations(spark, d).withColumn("part", F.when(nth <= 5, "support").otherwise("query"))
    return rows.groupBy("file_id").pivot("part", ["support", "query"]).agg(F.round(F.avg("value"), 6))


@query("ag17_fraction", "SELECT lang, round(avg((n_chars > 2000)::INT), 9) AS share FROM documents GROUP BY lang")
def fraction(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.avg((F.col("n_chars") > 2000).cast("double")), 9).alias("share"))


@query("ag18_rate", f"WITH {T} SELECT file_id, round(count(*) / (max(end_us) / 1000000.0), 9) AS per_second, median(end_us - begin_us)::DOUBLE AS middle_us FROM ann GROUP BY file_id")
def rate(spark, d):
    return annotations(spark, d).groupBy("file_id").agg(F.round(F.count("*") / (F.max("end_us") / 1_000_000.0), 9).alias("per_second"), F.median(F.col("end_us") - F.col("begin_us")).alias("middle_us"))


@query("ag19_distinct", "SELECT DISTINCT source, lang FROM documents")
def distinct(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("ag20_first_value", "SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def first_value(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"))


@query("ag22_checksum", "SELECT event_id % 3 AS split, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL")
def checksum(spark, d):
    return table(spark, d, "events").groupBy((F.col("event_id") % 3).alias("split")).agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


# Order, sets and samples


@query("srt01_ranked", f"WITH {T} SELECT file_id, event_id, row_number() OVER (PARTITION BY file_id ORDER BY begin_us, event_id) AS place FROM ann")
def ranked(spark, d):
    return annotations(spark, d).select("file_id", "event_id", F.row_number().over(Window.partitionBy("file_id").orderBy("begin_us", "event_id")).alias("place"))


@query("srt02_text_order", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY round(value * 100)::BIGINT::VARCHAR, event_id) AS as_text, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS as_number FROM events")
def text_order(spark, d):
    text = F.round(F.col("value") * 100).cast("long").cast("string")
    nth = lambda c: F.row_number().over(Window.partitionBy("user_id").orderBy(c, "event_id"))
    return table(spark, d, "events").select("event_id", nth(text).alias("as_text"), nth("value").alias("as_number"))


@query("srt03_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("srt05_cap", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (turn * 2654435761 + 3) % 4294967296, turn) n FROM conversations) WHERE n <= 2")
def cap(spark, d):
    return curate.sample_per_group(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn", 2, 3)


@query("srt06_top_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) n FROM documents) WHERE n <= 6")
def top_per_group(spark, d):
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, d, "documents").withColumn("n", nth).where("n <= 6").select("source", "doc_id")


@query("srt07_index_max", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS at FROM embeddings")
def index_max(spark, d):
    return table(spark, d, "embeddings").select("vec_id", fn.index_of_max(F.col("embedding")).alias("at"))


@query("set01_union", "SELECT c_nationkey AS nation, c_acctbal AS balance, NULL::VARCHAR AS kind FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier")
def union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set02_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set03_except", "SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def except_(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key")).subtract(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("set04_intersect", "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def intersect(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key")).intersect(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"))


@query("set05_is_distinct", "SELECT count(*) = count(DISTINCT doc_id) AS unique_docs, count(*) = count(DISTINCT source) AS unique_sources FROM documents")
def is_distinct(spark, d):
    return table(spark, d, "documents").agg((F.count("*") == F.countDistinct("doc_id")).alias("unique_docs"), (F.count("*") == F.countDistinct("source")).alias("unique_sources"))


@query("rnd01_sample", "SELECT doc_id FROM documents ORDER BY (doc_id * 2654435761 + 1) % 4294967296, doc_id LIMIT 50")
def sample(spark, d):
    return curate.sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 1)


@query("rnd02_with_replacement", "SELECT user_id, k, arg_min(event_id, (((event_id * 2654435761 + k) % 4294967296), event_id)) AS event_id FROM events, (SELECT unnest(range(3)) AS k) GROUP BY user_id, k")
def with_replacement(spark, d):
    """Three draws from every user's events, each from all of them."""
    drawn = table(spark, d, "events").select("user_id", "event_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return drawn.groupBy("user_id", F.col("k").cast("long").alias("k")).agg(F.min_by("event_id", F.struct(F.expr("(event_id * 2654435761 + k) % 4294967296"), "event_id")).alias("event_id"))


@query("rnd03_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 2654435761 + 5) % 4294967296, doc_id) n FROM documents) WHERE n <= 10")
def per_group(spark, d):
    return curate.sample_per_group(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 10, 5)


@query("rnd04_shuffle", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 2654435761 + 9) % 4294967296, event_id) AS place FROM events")
def shuffle(spark, d):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(curate.shared_hash("event_id", 9), "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", nth.alias("place"))


@query("rnd05_weighted", "SELECT event_id, CASE WHEN u < 0.2 THEN 'a' WHEN u < 0.4 THEN 'b' ELSE 'c' END AS source FROM (SELECT event_id, ((event_id * 2654435761 + 11) % 4294967296) / 4294967296.0::DOUBLE AS u FROM events)")
def weighted(spark, d):
    u = curate.shared_hash("event_id", 11) / 4294967296.0
    return table(spark, d, "events").select("event_id", curate.weighted_choice(u, [("a", 0.2), ("b", 0.2), ("c", 0.6)]).alias("source"))


@query("rnd06_two_level", "SELECT arg_min(source, (h, doc_id)) AS coarse, arg_min(lang, (h, doc_id)) AS fine, source_of FROM (SELECT doc_id, source, lang, doc_id % 7 AS source_of, (doc_id * 2654435761 + 13) % 4294967296 AS h FROM documents) GROUP BY source_of")
def two_level(spark, d):
    """For each of seven draws a row, and with it its cluster: frequent clusters are drawn more often."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 7).alias("source_of"), curate.shared_hash("doc_id", 13).alias("h"))
    order = F.struct("h", "doc_id")
    return rows.groupBy("source_of").agg(F.min_by("source", order).alias("coarse"), F.min_by("lang", order).alias("fine"))


@query("rnd07_draws", "SELECT event_id, floor(-ln(1 - u) / 0.5)::BIGINT AS waits, (u < 0.3)::BIGINT AS hit, round(-5 + 10 * u, 9) AS level FROM (SELECT event_id, ((event_id * 2654435761 + 17) % 4294967296) / 4294967296.0::DOUBLE AS u FROM events)")
def draws(spark, d):
    """Exponential, binomial and uniform draws from one hashed uniform, by inverse distribution functions."""
    rows = table(spark, d, "events").select("event_id", (curate.shared_hash("event_id", 17) / 4294967296.0).alias("u"))
    return rows.select("event_id", F.floor(-F.log(1 - F.col("u")) / 0.5).alias("waits"), (F.col("u") < 0.3).cast("long").alias("hit"), F.round(-5 + 10 * F.col("u"), 9).alias("level"))


@query("rnd09_eligible_choice", f"WITH {T}, e AS (SELECT file_id, class, count(*) AS n FROM ann WHERE q = 'POS' GROUP BY ALL HAVING count(*) > 5) SELECT file_id, arg_min(class, (n, class)) AS class, min(n) AS n FROM e GROUP BY file_id")
def eligible_choice(spark, d):
    """One class of each file among those with more than five events."""
    eligible = curate.frequent(annotations(spark, d).where("q = 'POS'"), ["file_id", "class"], 6)
    return eligible.groupBy("file_id").agg(F.min_by("class", F.struct("n", "class")).alias("class"), F.min("n").alias("n"))


@query("wn13_quota", "WITH f AS (SELECT source, doc_id, lang, (doc_id * 2654435761 + 21) % 4294967296 AS h FROM documents), g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) n FROM f) WHERE n <= 12) SELECT source, doc_id FROM g WHERE lang <> 'en' UNION ALL (SELECT source, doc_id FROM g WHERE lang = 'en' ORDER BY h, doc_id LIMIT 40)")
def quota(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", "lang")
    return curate.quotas(rows, "source", "doc_id", 12, F.col("lang") == "en", 40, 21).select("source", "doc_id")


@query("wn14_split", "SELECT source, doc_id, CASE WHEN n <= 20 THEN 'Train' WHEN n <= 22 THEN 'Val' ELSE 'Test' END AS part FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 2654435761 + 23) % 4294967296, doc_id) n FROM documents) WHERE n <= 24")
def split(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id")
    return curate.split_in_groups(rows, ["source"], "doc_id", [("Train", 20), ("Val", 2), ("Test", 2)], 23)


@query("wn17_pages", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS page FROM events")
def pages(spark, d):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").select("user_id", "event_id", F.floor(nth / 10).alias("page"))


# Functions


@query("fn01_paths", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(url, '/?[^/]*$', '') AS dir, split_part(url, '/', 3) AS host, replace(url, 'https', 'http') AS plain FROM pages")
def paths(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", fn.base_name(u).alias("base"), fn.dir_name(u).alias("dir"), F.split_part(u, F.lit("/"), F.lit(3)).alias("host"), F.replace(u, F.lit("https"), F.lit("http")).alias("plain"))


@query("fn02_text", "SELECT user_id, string_agg(printf('%.2f-%.2f', value, value + 1), ', ' ORDER BY event_id) AS spans FROM events GROUP BY user_id")
def text(spark, d):
    spans = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: F.struct(x["value"].alias("b"), (x["value"] + 1).alias("e")))
    return table(spark, d, "events").groupBy("user_id").agg(fn.interval_text(spans).alias("spans"))


@query("fn03_math", "SELECT event_id, round(log10(value), 9) AS a, round(sqrt(value), 9) AS b, trunc(-value)::BIGINT AS c, ceil(value)::BIGINT AS d, floor(value)::BIGINT AS e, round(pow(value, 1.5), 6) AS f FROM events")
def math_(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(fn.log10(v), 9).alias("a"), F.round(F.sqrt(v), 9).alias("b"), fn.truncated(-v).alias("c"), F.ceil(v).alias("d"), F.floor(v).alias("e"), F.round(F.pow(v, F.lit(1.5)), 6).alias("f"))


@query("fn04_kernels", "SELECT event_id, round(exp(-0.5 * pow((value - 50) / 20, 2)), 9) AS near, round(1 / (1 + exp(-value / 100)), 9) AS p FROM events")
def kernels(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(fn.gaussian(v, 50.0, 20.0), 9).alias("near"), F.round(fn.logistic(v / 100), 9).alias("p"))


@query("fn05_arrays", "SELECT vec_id, len(embedding[3:10]) AS n, round(list_min(embedding)::DOUBLE, 6) AS low, round(embedding[-1]::DOUBLE, 6) AS last, len(list_filter(embedding, lambda x: x > 0)) AS n_pos FROM embeddings")
def arrays(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(F.slice(e, 3, 8)).alias("n"), F.round(F.array_min(e).cast("double"), 6).alias("low"), F.round(F.element_at(F.reverse(e), 1).cast("double"), 6).alias("last"), F.size(F.filter(e, lambda x: x > 0)).alias("n_pos"))


@query("fn06_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similar FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(fn.cosine(F.col("embedding"), F.col("other")), 5).alias("similar"))


@query("fn07_json", "SELECT event_id, coalesce((props->>'k')::BIGINT, -1) AS k FROM events")
def json_(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.element_at(F.from_json("props", "map<string, bigint>"), "k"), F.lit(-1).cast("long")).alias("k"))


@query("fn08_nulls", "SELECT event_id, CASE WHEN isnan(x) THEN 0 ELSE greatest(-50, least(50, x)) END::DOUBLE AS x FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END AS x FROM events)")
def nulls(spark, d):
    x = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 1, F.lit(float("inf"))).when(F.col("event_id") % 4 == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", fn.finite(x, 50.0).alias("x"))


@query("fn09_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


# Signals as arrays


@query("sig03_rms", "WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS x, list_avg(embedding::DOUBLE[]) AS m FROM embeddings), c AS (SELECT vec_id, list_transform(x, lambda v: v - m) AS x FROM s), r AS (SELECT vec_id, x, sqrt(list_avg(list_transform(x, lambda v: v * v))) AS std FROM c) SELECT vec_id, round(list_sum(list_transform(x, lambda v: abs(v / greatest(std / 0.005, 1e-6)))), 6) AS total FROM r")
def to_rms(spark, d):
    scaled = fn.to_rms(F.col("embedding"), 0.005)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("total"))


@query("sig04_wrap", "SELECT vec_id, 100 AS n, round(list_sum(embedding::DOUBLE[]) + list_sum((embedding::DOUBLE[])[1:36]), 5) AS total FROM embeddings")
def wrap(spark, d):
    x = fn.wrapped(F.col("embedding"), 50)
    return table(spark, d, "embeddings").select("vec_id", F.size(x).alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("sig05_zero_pad", "SELECT vec_id, 100 AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def zero_pad(spark, d):
    x = fn.zero_padded(F.col("embedding"), 50)
    return table(spark, d, "embeddings").select("vec_id", F.size(x).alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("sig06_boxcar", "SELECT user_id, event_id, round(avg(value * value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 8) AS power FROM events")
def boxcar(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.avg(F.col("value") * F.col("value")).over(w), 8).alias("power"))


@query("sig08_ramp", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x * least(1.0, (i - 1) / 8, (64 - i) / 8))), 5) AS total FROM embeddings")
def ramp(spark, d):
    x = fn.ramped(F.col("embedding"), 8)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("sig09_mix", "SELECT a.vec_id, round(list_sum(a.embedding::DOUBLE[]) * sqrt(list_sum(list_transform(b.embedding::DOUBLE[], lambda x: x * x))) / sqrt(list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x))) * pow(10, 0.1 * -3) + list_sum(b.embedding::DOUBLE[]), 5) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mix(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x = fn.mixed_at_snr(F.col("embedding"), F.col("other"), -3.0)
    return a.join(b, "vec_id").select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("sig24_trim", "SELECT vec_id, round(list_sum((embedding::DOUBLE[])[1:20]), 5) AS total, round(list_sum((embedding::DOUBLE[])[23:42]), 5) AS middle FROM embeddings")
def trim(spark, d):
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")), 5)
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", total(fn.sized(e, 20)).alias("total"), total(fn.central(e, 20)).alias("middle"))


@query("src08_json", "SELECT event_id, 'f' || (event_id % 5) AS file, event_type AS label, value * 1000 AS start_ms FROM events")
def nested_json(spark, d):
    """Events written as {file: [{start, label}]} and read from it."""
    item = F.struct("event_id", (F.col("value") * 1000).alias("start"), F.col("event_type").alias("label"))
    rows = table(spark, d, "events").withColumn("file", F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")))
    text = rows.select("user_id", F.to_json(F.create_map("file", F.array(item))).alias("json"))
    read = text.select(F.explode(F.from_json("json", "map<string, array<struct<event_id: bigint, start: double, label: string>>>")).alias("file", "items")).select("file", F.explode("items").alias("x"))
    return read.select("x.event_id", "file", "x.label", F.col("x.start").alias("start_ms"))
