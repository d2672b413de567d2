"""Queries over probabilities, prefixes, motifs; with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import prob, vectors
from strandline.operators import bayes, motif, prefix
from strandline.plans.sequence_queries import _READS, reads
from strandline.session import table


def phred(spark, d):
    """Error probability of each read from its quality string, in three scales."""
    q = reads(spark, d).filter("qual is not null and length(qual) > 0").select("read_id", F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33).alias("q"))
    mean = F.aggregate(F.filter("q", lambda x: x >= 0), F.lit(0.0), lambda a, x: a + prob.phred_to_prob(x)) / F.size("q")
    q = q.select("read_id", mean.alias("p"))
    return q.select("read_id", F.round("p", 6).alias("p"), F.round(prob.ln("p"), 6).alias("ln_p"), F.round(prob.prob_to_phred("p"), 6).alias("phred"))


def ln_arithmetic(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", prob.ln("l_discount").alias("a"), prob.ln("l_tax").alias("b"))
    finite = lambda c: F.when(c == prob.NEG_INF, F.lit(None)).otherwise(F.round(c, 6))
    return l.select("l_orderkey", "l_linenumber", finite(prob.ln_add_exp("a", "b")).alias("ln_sum"), finite(prob.ln_sub_exp(F.greatest("a", "b"), F.least("a", "b"))).alias("ln_diff"), finite(prob.ln_one_minus_exp("a")).alias("ln_rest"))


def log_sum_exp(spark, d):
    """Sums of discounts in log space, also where each is 900 orders of e smaller than a double can hold."""
    l = table(spark, d, "lineitem").select("l_suppkey", prob.ln("l_discount").alias("x"))
    logs = F.when(F.col("x") > prob.NEG_INF, F.col("x"))
    s = prob.ln_sum_exp(l, ["l_suppkey"], "x", "ln_total", {"ln_product": (prob.ln_product(logs), F.sum), "n": (F.count("*"), F.sum)})
    far = prob.ln_sum_exp(l.withColumn("x", F.col("x") - 900), ["l_suppkey"], "x", "far")
    return s.join(far, "l_suppkey").select("l_suppkey", F.round("ln_total", 6).alias("ln_total"), F.round("far", 6).alias("ln_far"), F.round("ln_product", 4).alias("ln_product"), "n")


def log_cumsum(spark, d):
    l = table(spark, d, "lineitem").filter("l_tax > 0").select("l_orderkey", "l_linenumber", "l_tax", (prob.ln("l_tax") - 900).alias("x"))
    return prob.ln_cumsum_exp(l, ["l_orderkey"], ["l_linenumber", "l_tax"], "x").select("l_orderkey", "l_linenumber", F.round("ln_cum", 6).alias("ln_cum"))


def expected_fdr(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") + F.col("l_tax")).alias("pep"))
    return prob.expected_fdr(l, ["l_orderkey", "l_linenumber"], "pep").select("l_orderkey", "l_linenumber", F.round(F.col("fdr") + 1e-9, 6).alias("fdr"))


def _pmf(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    total = o.groupBy("l_returnflag").agg(F.sum("n").alias("t"))
    return o.join(total, "l_returnflag").select("l_returnflag", "l_quantity", (F.col("n") / F.col("t")).alias("p"))


def _cdf(spark, d):
    return prob.cdf(_pmf(spark, d), ["l_returnflag"], "l_quantity", "p")


def cdf(spark, d):
    return _cdf(spark, d).select("l_returnflag", "l_quantity", F.round("pmf", 6).alias("pmf"), F.round("cdf", 6).alias("cdf"))


def cdf_moments(spark, d):
    c = _cdf(spark, d)
    m = prob.cdf_moments(c, ["l_returnflag"], "l_quantity").join(prob.credible_interval(c, ["l_returnflag"], "l_quantity", 0.9), "l_returnflag")
    return m.select("l_returnflag", F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"), F.round("std_dev", 5).alias("std_dev"), "map_value", "lower", "upper")


def cdf_sample(spark, d):
    c = prob.cdf_sample(prob.cdf_reduce(_cdf(spark, d), ["l_returnflag"], "l_quantity"), ["l_returnflag"], "l_quantity", 8)
    return c.select("l_returnflag", "l_quantity", F.round("cdf", 6).alias("cdf"))


def cdf_get(spark, d):
    one = prob.cdf(table(spark, d, "part").groupBy("p_size").agg((F.count("*") / F.lit(1.0)).alias("n")).select("p_size", (F.col("n") / table(spark, d, "part").count()).alias("p")), [], "p_size", "p")
    probes = table(spark, d, "part").select((F.col("p_retailprice") / 30).alias("size_at")).distinct()
    return prob.cdf_get(one, probes, "p_size", "size_at").select(F.round("size_at", 6).alias("size_at"), F.round("p", 6).alias("p"))


def bayes_model(spark, d):
    """Which order priority do the lines of a part speak for, given how lines with their flag and status split by priority?"""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_returnflag", "o_orderpriority")
    prior = lines.groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("o_orderpriority", F.log("n").alias("ln_prior"))
    flag = lines.groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("nf")).join(lines.groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority").select("o_orderpriority", "l_returnflag", F.log(F.col("nf") / F.col("n")).alias("l"))
    seen = lines.groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("k"))
    like = seen.join(F.broadcast(flag), "l_returnflag").groupBy("l_partkey", "o_orderpriority").agg(F.sum(F.col("k") * F.col("l")).alias("ln_likelihood"))
    post = bayes.posterior(prior, like, "o_orderpriority", "l_partkey")
    ranked = bayes.ranked_posteriors(post.withColumn("raw", F.col("ln_posterior")).withColumn("ln_posterior", F.round("ln_posterior", 9)), "o_orderpriority", "l_partkey")
    return ranked.select("l_partkey", "o_orderpriority", F.round("raw", 5).alias("ln_posterior"), F.col("rank").cast("bigint").alias("rank"))


def bayes_factor(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 10).alias("b"))
    k = prob.bayes_factor("a", "b")
    return l.select("l_orderkey", "l_linenumber", F.round(k, 4).alias("k"), prob.kass_raftery(F.round(k, 9)).alias("label"))


def combinations(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("n"), F.pmod("p_partkey", F.lit(5)).cast("double").alias("k"))
    return p.select("p_partkey", F.round(prob.combinations("n", "k"), 3).alias("c"), F.round(prob.combinations("n", "k", 0.5), 3).alias("scaled"), F.round(prob.combinations_with_repetition("n", "k"), 3).alias("rep"))


def integrate(spark, d):
    """Log integrals of a discount's density over the quantity grid, per supplier."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.avg("l_extendedprice").alias("v")).withColumn("ln_v", F.log("v"))
    return prob.integrate_grid(g, ["l_suppkey"], "l_quantity", "ln_v").select("l_suppkey", F.round("ln_integral", 6).alias("ln_integral"))


def interpolate(spark, d):
    """Squares from a table, between its points too, and beyond it by the function itself."""
    look = prob.tabulated(lambda x: x * x, 0.0, 0.1, 0.001, lambda x: x * x)
    l = table(spark, d, "lineitem").withColumn("x", F.col("l_discount") + F.col("l_quantity") / 7000)
    return l.select("l_orderkey", "l_linenumber", F.round(look(F.col("x")) + 1e-9, 7).alias("y"))


def prefix_ops(spark, d):
    o = table(spark, d, "orders")
    s = prefix.prefix_sum(o, ["o_custkey"], ["o_orderkey"], "o_totalprice", out="incl")
    s = prefix.prefix_sum(s, ["o_custkey"], ["o_orderkey"], "o_totalprice", exclusive=True, out="excl")
    s = prefix.prefix_max(s, ["o_custkey"], ["o_orderkey"], "o_totalprice", out="top")
    return s.select("o_orderkey", F.round("incl", 2).alias("incl"), F.round("excl", 2).alias("excl"), F.round("top", 2).alias("top"))


def _bits(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("bit"))
    return prefix.bit_ranks(e, "event_id", "bit")


def bit_rank(spark, d):
    return _bits(spark, d)


def bit_select(spark, d):
    r = _bits(spark, d)
    return prefix.bit_select(r, "event_id", "bit").withColumn("kind", F.lit(1)).unionByName(prefix.bit_select(r, "event_id", "bit", False).withColumn("kind", F.lit(0)))


def bit_extend(spark, d):
    """Ranks of all events, those of odd days' halves of the table being appended to the others', at every 64th bit."""
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "error").alias("bit"))
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    r = prefix.extend_ranks(prefix.bit_ranks(e.filter(F.col("event_id") <= half), "event_id", "bit"), e.filter(F.col("event_id") > half), "event_id", "bit")
    return prefix.rank_samples(r, "event_id", 64).select("event_id", "rank1", "rank0")


def scans(spark, d):
    """Running products of what is left after each line's discount, and running maxima, by order: scans with two operations."""
    import numpy as np

    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", (1 - F.col("l_discount")).alias("x"))
    s = prob.scan_rows(l, ["l_orderkey"], ["l_linenumber", "l_tax", "x"], "x", np.multiply, "product")
    s = prob.scan_rows(s, ["l_orderkey"], ["l_linenumber", "l_tax", "x"], "x", max, "top")
    return s.select("l_orderkey", "l_linenumber", F.round("product", 6).alias("product"), "top")


def small_ints(spark, d):
    """Prices of each order in cents as a vector of mostly small numbers: read, changed, lengthened and written out again."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))), lambda x: F.when(x["l_linenumber"] % 2 == 0, x["l_quantity"]).otherwise(F.round(x["l_extendedprice"] * 100)).cast("bigint")).alias("v"))
    o = o.select("l_orderkey", vectors.compress("v").alias("c"))
    changed = vectors.push(vectors.put("c", F.lit(0), F.lit(7).cast("bigint")), F.lit(10**12).cast("bigint"))
    return o.select("l_orderkey", vectors.decompress("c").alias("v"), vectors.get("c", F.lit(1)).alias("second"), vectors.decompress(changed).alias("changed"), vectors.length(changed).cast("bigint").alias("n"))


def cdf_pmf(spark, d):
    """Masses of a distribution at given values, also at some that it does not have."""
    n = table(spark, d, "part").count()
    one = prob.cdf(table(spark, d, "part").groupBy("p_size").agg((F.count("*") / n).alias("p")), [], "p_size", "p")
    probes = spark.range(1, 60).select((F.col("id") * 1.0).alias("size_at"))
    return prob.cdf_get_pmf(one, probes, "p_size", "size_at").select("size_at", F.round("p", 6).alias("p"))


def symbol_rank(spark, d):
    """For the last symbol of each read: how often it occurs in it."""
    r = reads(spark, d).select("read_id", F.posexplode(F.split("s", "")).alias("i", "c"))
    k = prefix.symbol_ranks(r, ["read_id"], "i", "c")
    return k.groupBy("read_id").agg(F.max_by("c", "i").alias("last_symbol"), F.max_by("rank", "i").alias("last_rank"), F.max("rank").alias("top_rank"))


def less_table(spark, d):
    r = reads(spark, d).select("read_id", F.explode(F.split("s", "")).alias("c"))
    return prefix.less_table(r, ["read_id"], "c")


def _motifs(spark, d):
    """Motifs: the reads of one length, whole."""
    r = reads(spark, d).filter(~F.col("s").rlike("[^ATGCMRWSYKVHDBN]") & (F.length("s") > 0))
    return motif.weight_matrix(r.select(F.length("s").cast("string").alias("m"), "s"), "m", "s")


def motif_weights(spark, d):
    return _motifs(spark, d).select("motif", F.col("pos").cast("bigint").alias("pos"), "mono", F.round("weight", 6).alias("weight"))


def motif_information(spark, d):
    w = _motifs(spark, d)
    r = motif.score_range(w)
    return motif.information(w).join(r, "motif").select("motif", F.round("bits", 6).alias("bits"), F.round("min_score", 6).alias("min_score"), F.round("max_score", 6).alias("max_score"))


def motif_consensus(spark, d):
    return motif.consensus(_motifs(spark, d).withColumn("weight", F.round("weight", 9)))


def motif_scan(spark, d):
    """The best place of one motif, a fixed set of sites, in every read, windows with other symbols than bases passed over."""
    sites = spark.createDataFrame([("site", s) for s in ("TATAAT", "TATGAT", "TACAAT", "TATACT", "GATAAT")], "m string, w string")
    return motif.best_window(reads(spark, d), "read_id", "s", motif.weight_matrix(sites, "m", "w"), skip=True).select(F.col("id").alias("read_id"), "loc", F.round("score", 6).alias("score"))


_CDF = """
pmf AS (SELECT l_returnflag, l_quantity, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS pmf FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, least(1, sum(pmf) OVER (PARTITION BY l_returnflag ORDER BY l_quantity)) AS cdf FROM pmf)"""
_CODES = ", ".join(f"('{c}', '{m}', {motif.SHARE[len(ms)]})" for c, ms in motif.DNA_CODES.items() for m in ms)
_W = f"""
r AS (SELECT CAST(length(s) AS VARCHAR) AS motif, s AS w, length(s) AS len FROM {_READS} WHERE length(s) > 0 AND NOT regexp_matches(s, '[^ATGCMRWSYKVHDBN]')),
k(code, mono, share) AS (VALUES {_CODES}), g AS (SELECT motif, pos, mono, idx FROM (SELECT motif, unnest(generate_series(0, len - 1)) AS pos FROM (SELECT DISTINCT motif, len FROM r)), (VALUES ('A', 0), ('T', 1), ('G', 2), ('C', 3)) m(mono, idx)),
n AS (SELECT motif, i AS pos, mono, sum(share) AS c FROM (SELECT motif, i, substr(w, i + 1, 1) AS code FROM (SELECT motif, w, unnest(generate_series(0, len - 1)) AS i FROM r)) JOIN k USING (code) GROUP BY 1, 2, 3),
f AS (SELECT g.motif, g.pos, g.mono, idx, coalesce(c, 0) + 0.5 AS c FROM g LEFT JOIN n ON n.motif = g.motif AND n.pos = g.pos AND n.mono = g.mono),
pw AS (SELECT motif, pos, mono, idx, c / sum(c) OVER (PARTITION BY motif, pos) AS weight FROM f)"""
_SITES = "('TATAAT'), ('TATGAT'), ('TACAAT'), ('TATACT'), ('GATAAT')"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (phred, ln_arithmetic, log_sum_exp, log_cumsum, expected_fdr, cdf, cdf_moments, cdf_sample, cdf_get, bayes_model, bayes_factor, combinations, integrate, interpolate, prefix_ops, bit_rank, bit_select, bit_extend, scans, small_ints, cdf_pmf, symbol_rank, less_table, motif_weights, motif_information, motif_consensus, motif_scan)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {
        "phred": "SELECT read_id, round(p, 6) AS p, round(ln(p), 6) AS ln_p, round(-10 * log10(p), 6) AS phred FROM (SELECT read_id, avg(pow(10, -(ascii(c) - 33) / 10.0)) AS p FROM (SELECT read_id, unnest(string_split(qual, '')) AS c FROM fastq WHERE qual IS NOT NULL AND length(qual) > 0 AND seq IS NOT NULL) GROUP BY read_id)",
        "ln_arithmetic": "SELECT l_orderkey, l_linenumber, CASE WHEN a + b > 0 THEN round(ln(a + b), 6) END AS ln_sum, CASE WHEN abs(a - b) > 1e-12 THEN round(ln(abs(a - b)), 6) END AS ln_diff, CASE WHEN a < 1 THEN round(ln(1 - a), 6) END AS ln_rest FROM (SELECT *, l_discount AS a, l_tax AS b FROM lineitem)",
        "log_sum_exp": "SELECT l_suppkey, round(ln(sum(l_discount)), 6) AS ln_total, round(ln(sum(l_discount)) - 900, 6) AS ln_far, round(sum(CASE WHEN l_discount > 0 THEN ln(l_discount) END), 4) AS ln_product, count(*) AS n FROM lineitem GROUP BY 1",
        "log_cumsum": "SELECT l_orderkey, l_linenumber, round(ln(sum(l_tax) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_tax ROWS UNBOUNDED PRECEDING)) - 900, 6) AS ln_cum FROM lineitem WHERE l_tax > 0",
        "expected_fdr": "SELECT l_orderkey, l_linenumber, round(least(1, sum(pep) OVER w / row_number() OVER w) + 1e-9, 6) AS fdr FROM (SELECT *, l_discount + l_tax AS pep FROM lineitem) WINDOW w AS (ORDER BY pep, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)",
        "cdf": f"WITH {_CDF} SELECT l_returnflag, l_quantity, round(pmf, 6) AS pmf, round(cdf, 6) AS cdf FROM c",
        "cdf_moments": f"""WITH {_CDF}, m AS (SELECT l_returnflag, sum(l_quantity * pmf) AS mean FROM c GROUP BY 1)
            SELECT l_returnflag, round(any_value(mean), 5) AS mean, round(sum(pow(l_quantity - mean, 2) * pmf), 4) AS variance, round(sqrt(sum(pow(l_quantity - mean, 2) * pmf)), 5) AS std_dev, arg_max(l_quantity, (pmf, l_quantity)) AS map_value,
            coalesce(max(CASE WHEN cdf <= 0.05 + 1e-12 THEN l_quantity END), min(l_quantity)) AS lower, min(CASE WHEN cdf >= 0.95 - 1e-12 THEN l_quantity END) AS upper FROM c JOIN m USING (l_returnflag) GROUP BY 1""",
        "cdf_sample": f"WITH {_CDF}, i AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM c) SELECT l_returnflag, l_quantity, round(cdf, 6) AS cdf FROM i WHERE n <= 8 OR k % greatest(n // 7, 1) = 0 OR k = n - 1",
        "cdf_get": "SELECT round(size_at, 6) AS size_at, round(CAST((SELECT count(*) FROM part p WHERE p.p_size <= size_at) AS DOUBLE) / (SELECT count(*) FROM part), 6) AS p FROM (SELECT DISTINCT p_retailprice / 30 AS size_at FROM part)",
        "bayes_model": """WITH l AS (SELECT l_partkey, l_returnflag, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
            pr AS (SELECT o_orderpriority, count(*) AS n FROM l GROUP BY 1), fl AS (SELECT o_orderpriority, l_returnflag, ln(count(*) / any_value(n)) AS x FROM l JOIN pr USING (o_orderpriority) GROUP BY 1, 2),
            j AS (SELECT l_partkey, o_orderpriority, ln(any_value(n)) + sum(x) AS j FROM (SELECT l_partkey, l_returnflag FROM l) JOIN fl USING (l_returnflag) JOIN pr USING (o_orderpriority) GROUP BY 1, 2),
            t AS (SELECT *, max(j) OVER (PARTITION BY l_partkey) AS top FROM j), z AS (SELECT l_partkey, o_orderpriority, j - top - ln(sum(exp(j - top)) OVER (PARTITION BY l_partkey)) AS p FROM t)
            SELECT l_partkey, o_orderpriority, round(p, 5) AS ln_posterior, row_number() OVER (PARTITION BY l_partkey ORDER BY round(p, 9) DESC, o_orderpriority) AS rank FROM z""",
        "bayes_factor": "SELECT l_orderkey, l_linenumber, round(k, 4) AS k, CASE WHEN round(k, 9) <= 1 THEN 'None' WHEN round(k, 9) <= 3 THEN 'Barely' WHEN round(k, 9) <= 20 THEN 'Positive' WHEN round(k, 9) <= 150 THEN 'Strong' ELSE 'VeryStrong' END AS label FROM (SELECT *, exp(l_quantity / 10 - l_discount * 10) AS k FROM lineitem)",
        "combinations": """SELECT p_partkey, CASE WHEN k > n THEN 0.0 ELSE round(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)), 3) END AS c, CASE WHEN k > n THEN 0.0 ELSE round(0.5 * exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)), 3) END AS scaled,
            CASE WHEN k = 0 THEN 1.0 ELSE round(exp(lgamma(n + k) - lgamma(k + 1) - lgamma(n)), 3) END AS rep FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, CAST(p_partkey % 5 AS DOUBLE) AS k FROM part)""",
        "integrate": "SELECT l_suppkey, round(ln(sum((q - pq) * (v + pv) / 2)), 6) AS ln_integral FROM (SELECT l_suppkey, l_quantity AS q, v, lag(l_quantity) OVER w AS pq, lag(v) OVER w AS pv FROM (SELECT l_suppkey, l_quantity, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity)) WHERE pq IS NOT NULL GROUP BY 1",
        "interpolate": "SELECT l_orderkey, l_linenumber, round(CASE WHEN x > 0.1 THEN x * x ELSE (k / 1000.0) * (k / 1000.0) + (2 * k + 1) / 1e6 * (x * 1000 - k) END + 1e-9, 7) AS y FROM (SELECT *, least(floor(x / 0.001), 99) AS k FROM (SELECT *, l_discount + l_quantity / 7000 AS x FROM lineitem))",
        "prefix_ops": "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS incl, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS excl, round(max(o_totalprice) OVER w, 2) AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
        "bit_rank": "SELECT event_id, bit, CAST(sum(bit::INT) OVER (ORDER BY event_id) AS BIGINT) AS rank1, CAST(sum((NOT bit)::INT) OVER (ORDER BY event_id) AS BIGINT) AS rank0 FROM (SELECT event_id, event_type = 'error' AS bit FROM events)",
        "bit_select": "SELECT row_number() OVER (PARTITION BY bit ORDER BY event_id) AS j, event_id, CAST(bit AS INT) AS kind FROM (SELECT event_id, event_type = 'error' AS bit FROM events)",
        "bit_extend": "SELECT event_id, rank1, rank0 FROM (SELECT event_id, CAST(sum(bit::INT) OVER (ORDER BY event_id) AS BIGINT) AS rank1, CAST(sum((NOT bit)::INT) OVER (ORDER BY event_id) AS BIGINT) AS rank0 FROM (SELECT event_id, event_type = 'error' AS bit FROM events)) WHERE (rank1 + rank0) % 64 = 0",
        "scans": "SELECT l_orderkey, l_linenumber, round(product(1 - l_discount) OVER w, 6) AS product, max(1 - l_discount) OVER w AS top FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_tax, 1 - l_discount ROWS UNBOUNDED PRECEDING)",
        "small_ints": "SELECT l_orderkey, v, v[2] AS second, list_concat([7], v[2:], [1000000000000]) AS changed, len(v) + 1 AS n FROM (SELECT l_orderkey, list(CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE round(l_extendedprice * 100) END AS BIGINT) ORDER BY l_linenumber, l_quantity, l_extendedprice) AS v FROM lineitem GROUP BY 1)",
        "cdf_pmf": "SELECT CAST(x AS DOUBLE) AS size_at, round(CASE WHEN x IN (SELECT p_size FROM part) THEN (SELECT count(*) FROM part WHERE p_size = x) ELSE (SELECT count(*) FROM part WHERE p_size < x) END / (SELECT count(*) FROM part), 6) AS p FROM (SELECT unnest(generate_series(1, 59)) AS x)",
        "symbol_rank": f"SELECT read_id, right(s, 1) AS last_symbol, length(s) - length(replace(s, right(s, 1), '')) AS last_rank, greatest(length(s) - length(replace(s, 'A', '')), length(s) - length(replace(s, 'C', '')), length(s) - length(replace(s, 'G', '')), length(s) - length(replace(s, 'T', '')), length(s) - length(replace(s, 'N', ''))) AS top_rank FROM {_READS}",
        "less_table": f"SELECT read_id, c, n, CAST(coalesce(sum(n) OVER (PARTITION BY read_id ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS less FROM (SELECT read_id, c, count(*) AS n FROM (SELECT read_id, unnest(string_split(s, '')) AS c FROM {_READS}) GROUP BY 1, 2)",
        "motif_weights": f"WITH {_W} SELECT motif, pos, mono, round(weight, 6) AS weight FROM pw",
        "motif_information": f"WITH {_W} SELECT motif, round(2 * count(DISTINCT pos) + sum(weight * log2(weight)), 6) AS bits, round(any_value(lo), 6) AS min_score, round(any_value(hi), 6) AS max_score FROM pw JOIN (SELECT motif, sum(a) AS lo, sum(b) AS hi FROM (SELECT motif, pos, min(weight) AS a, max(weight) AS b FROM pw GROUP BY 1, 2) GROUP BY 1) USING (motif) GROUP BY 1",
        "motif_consensus": f"""WITH {_W}, o AS (SELECT motif, pos, list(round(weight, 9) ORDER BY round(weight, 9) DESC, idx DESC) AS w, list(mono ORDER BY round(weight, 9) DESC, idx DESC) AS m FROM pw GROUP BY 1, 2),
            s AS (SELECT motif, pos, CASE WHEN w[1] > 0.5 AND w[1] > 2 * w[2] THEN m[1] WHEN w[1] + w[2] > 0.75 THEN CASE list_aggregate(list_sort(m[1:2]), 'string_agg', '') WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' ELSE 'K' END
              WHEN w[4] < 1e-5 THEN CASE list_aggregate(list_sort(m[1:3]), 'string_agg', '') WHEN 'ACG' THEN 'V' WHEN 'ACT' THEN 'H' WHEN 'AGT' THEN 'D' ELSE 'B' END ELSE 'N' END AS y FROM o)
            SELECT motif, string_agg(y, '' ORDER BY pos) AS consensus FROM s GROUP BY 1""",
        "motif_scan": f"""WITH v(w) AS (VALUES {_SITES}), x AS (SELECT i, substr(w, i, 1) AS mono FROM (SELECT w, unnest(generate_series(1, 6)) AS i FROM v)),
            p AS (SELECT i, m.mono, (coalesce(n, 0) + 0.5) / 7 AS wt FROM (SELECT unnest(generate_series(1, 6)) AS i), (VALUES ('A'), ('T'), ('G'), ('C')) m(mono) LEFT JOIN (SELECT i AS j, mono AS mm, count(*) AS n FROM x GROUP BY 1, 2) ON j = i AND mm = m.mono),
            rg AS (SELECT sum(a) AS lo, sum(b) AS hi FROM (SELECT i, min(wt) AS a, max(wt) AS b FROM p GROUP BY 1)),
            q AS (SELECT read_id, loc, sum(wt) AS t FROM (SELECT read_id, loc, i, substr(s, loc + i, 1) AS mono FROM (SELECT * FROM (SELECT read_id, s, unnest(generate_series(0, length(s) - 6)) AS loc FROM {_READS} WHERE length(s) >= 6) WHERE regexp_full_match(substr(s, loc + 1, 6), '[ATGC]+')), (SELECT unnest(generate_series(1, 6)) AS i)) JOIN p USING (i, mono) GROUP BY 1, 2)
            SELECT read_id, arg_min(loc, (-round(t, 12), loc)) AS loc, round((max(t) - any_value(lo)) / (any_value(hi) - any_value(lo)), 6) AS score FROM q, rg GROUP BY 1""",
    }
