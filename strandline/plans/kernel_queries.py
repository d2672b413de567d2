"""Queries on the pair and text kernels; oracle SQL where it can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.kernels import approx, hmm, pairhmm, pairwise
from strandline.operators import pairs
from strandline.plans.sequence_queries import _FASTA, _READS, _pairs, fasta, reads
from strandline.session import table

SCORING = pairwise.Scoring.from_scores(-5, -1, 1, -1)
PATTERN = "GATTACAG"
SITE = "ACGTTGCAAGGCTTACGATCGGAT"
SEARCH = ["ACGTAC", "GATTACAGATTACA", "TTTTTTTTTT"]
#: A two-state model of AT-rich and GC-rich stretches over the ranks of A, C, G, T.
COMPOSITION = hmm.Discrete([[0.95, 0.05], [0.1, 0.9]], [[0.3, 0.2, 0.2, 0.3], [0.15, 0.35, 0.35, 0.15]], [0.5, 0.5])


def _align(mode: str, band: tuple[int, int] | None = None):
    def query(spark, d):
        a = pairs.align_pairs(_pairs(spark, d), "a_id", "a", "b", SCORING, mode, band)
        same = F.aggregate("ops", F.lit(0), lambda s, o: s + F.when(o["op"] == "M", o["n"]).otherwise(0))
        return a.select("id", "score", "xstart", "xend", "ystart", "yend", same.cast("bigint").alias("n_same"), F.size("ops").cast("bigint").alias("n_runs"))

    return query


def align_custom(spark, d):
    from dataclasses import replace

    s = replace(SCORING, xclip_prefix=-10, xclip_suffix=-10, yclip_prefix=0, yclip_suffix=0)
    a = pairs.align_pairs(_pairs(spark, d), "a_id", "a", "b", s, "custom")
    return a.select("id", "score", F.to_json("ops").alias("ops"))


def align_matrix(spark, d):
    """Local scores by a substitution matrix that is read from its text form."""
    text = "  A C G T *\nA 5 -4 -1 -4 -5\nC -4 5 -4 -1 -5\nG -1 -4 5 -4 -5\nT -4 -1 -4 5 -5\n* -5 -5 -5 -5 1\n"
    s = pairwise.Scoring(-10, -1, pairwise.read_matrix(text))
    return pairs.align_pairs(_pairs(spark, d), "a_id", "a", "b", s, "local").select("id", "score", "xstart", "xend", "ystart", "yend")


def align_site(spark, d):
    """Scores of one site against every read, in three modes."""
    r = reads(spark, d).select("read_id", F.lit(SITE).alias("x"), "s")
    out = None
    for mode in ("global", "semiglobal", "local"):
        a = pairs.align_pairs(r, "read_id", "x", "s", SCORING, mode).select("id", F.col("score").alias(mode))
        out = a if out is None else out.join(a, "id")
    return out


def pair_hmm_site(spark, d):
    """The probability that a site comes from each read, over all its places and alignments."""
    p = pairs.pair_related(reads(spark, d).select("read_id", "s", F.lit(SITE).alias("y")), "read_id", "s", "y", pairhmm.PairModel())
    return p.select("id", F.when(F.col("ln_p") > float("-inf"), F.round("ln_p", 4)).alias("ln_p"))


def seed_chains(spark, d):
    return pairs.chains(_pairs(spark, d), "a_id", "a", "b", 8, 1, -1, -1, mismatches=1)


def myers_ends(spark, d):
    return pairs.approximate_ends(reads(spark, d), "read_id", "s", approx.Pattern(PATTERN), 1)


def myers_matches(spark, d):
    return pairs.approximate_matches(reads(spark, d), "read_id", "s", approx.Pattern("GATTNCAGNNTA", {"N": "ACGT"}, "N"), 2)


def myers_best(spark, d):
    return pairs.best_approximate(reads(spark, d), "read_id", "s", approx.Pattern("GATTAC"))


def myers_long(spark, d):
    """A pattern of more than a machine word."""
    return pairs.approximate_ends(fasta(spark, d), "rec_id", "s", approx.Pattern("ACGT" * 25), 55)


def ukkonen_ends(spark, d):
    return pairs.ukkonen_ends(reads(spark, d), "read_id", "s", PATTERN, 1)


def suffix_array(spark, d):
    return pairs.suffix_arrays(reads(spark, d), "read_id", "s").select("id", "rnk", "pos", "bwt")


def lcp_sus(spark, d):
    s = pairs.suffix_arrays(reads(spark, d), "read_id", "s")
    return s.groupBy("id").agg(F.max("lcp").alias("longest_repeat"), F.min("sus").alias("shortest_unique"), F.count("sus").alias("n_unique"))


def fm_search(spark, d):
    return pairs.fm_search(fasta(spark, d), "rec_id", "s", SEARCH)


def fm_map(spark, d):
    """Reads searched in all records."""
    return pairs.fm_map_reads(reads(spark, d), "read_id", "s", fasta(spark, d), "rec_id", "s").withColumnRenamed("text", "rec_id")


def smems(spark, d):
    return pairs.smems(reads(spark, d), "read_id", "s", fasta(spark, d), "rec_id", "s", 10)


def poa_consensus(spark, d):
    """Reads that follow one another, as families of a bounded size."""
    r = reads(spark, d).select((F.col("read_id") / 3).cast("bigint").alias("family"), "read_id", "s")
    return pairs.poa_consensus(r, "family", "read_id", "s")


def _observed(spark, d):
    """Reads as ranks of A, C, G, T; other symbols are -1, not known."""
    return reads(spark, d).filter(F.length("s") > 0).select("read_id", F.transform(F.split("s", ""), lambda x: F.instr(F.lit("ACGT"), x) - 1).alias("obs"))


def hmm_decode(spark, d):
    out = pairs.hmm_decode(_observed(spark, d), "read_id", "obs", COMPOSITION)
    return out.select("id", F.aggregate("path", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_rich"), F.round("ln_viterbi", 6).alias("ln_viterbi"), F.round("ln_forward", 6).alias("ln_forward"), F.round("ln_backward", 6).alias("ln_backward"))


def hmm_train(spark, d):
    """One model for every fifty reads, trained until it settles or for the operator's 500 steps."""
    r = _observed(spark, d).withColumn("m", (F.col("read_id") / 50).cast("bigint"))
    out = pairs.hmm_train(r, "m", "read_id", "obs", COMPOSITION)
    return out.select("model", F.round(F.col("transition")[0], 3).alias("stay"), "n_steps", "settled")


def pair_hmm(spark, d):
    p = pairs.pair_related(_pairs(spark, d), "a_id", "a", "b", pairhmm.PairModel())
    return p.select("id", F.round("ln_p", 4).alias("ln_p"))


def homopolymer_hmm(spark, d):
    p = pairs.pair_related(_pairs(spark, d), "a_id", "a", "b", pairhmm.PairModel(hop_x=1e-5, hop_y=1e-5, hop_x_extend=0.1, hop_y_extend=0.1), True)
    return p.select("id", F.round("ln_p", 4).alias("ln_p"))


def adaptive_integral(spark, d):
    """The mass within 0..1 of a normal density around each line's discount, whose width its tax sets."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("mean"), (F.col("l_tax") + 0.05).alias("sd"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    one = l.groupBy("mean", "sd").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")).withColumn("id", F.concat_ws("/", F.round("mean", 2), F.round("sd", 2)))
    out = pairs.integrate_adaptive(one, "id", "lo", "hi", ["mean", "sd"], lambda x, mean, sd: -0.5 * ((x - mean) / sd) ** 2 - math.log(sd * math.sqrt(2 * math.pi)), 1e-3)
    return out.join(one.select("id", "n"), "id").select("id", "n", F.round(F.exp("ln_integral"), 3).alias("mass"))


_ALIGN = {"align_global": ("global", None), "align_semiglobal": ("semiglobal", None), "align_local": ("local", None), "align_banded": ("semiglobal", (8, 6))}
_ENDS = f"""SELECT id, end_pos, dist FROM (SELECT read_id AS id, e - 1 AS end_pos, min(levenshtein('{PATTERN}', substr(s, e - n + 1, n))) AS dist FROM (SELECT read_id, s, unnest(generate_series(1, length(s))) AS e FROM {_READS}), (SELECT unnest(generate_series(7, 9)) AS n) WHERE e >= n GROUP BY 1, 2) WHERE dist <= 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (align_custom, align_matrix, align_site, pair_hmm_site, seed_chains, myers_ends, myers_matches, myers_best, myers_long, ukkonen_ends, suffix_array, lcp_sus, fm_search, fm_map, smems, poa_consensus, hmm_decode, hmm_train, pair_hmm, homopolymer_hmm, adaptive_integral)
    return {n: _align(*a) for n, a in _ALIGN.items()} | {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    pats = ", ".join(f"('{p}')" for p in SEARCH)
    p = pairhmm.PairModel()
    emit = [f"CASE substr(s, {{}}, 1) WHEN 'A' THEN ln({a}) WHEN 'C' THEN ln({c}) WHEN 'G' THEN ln({g}) WHEN 'T' THEN ln({t}) ELSE 0 END" for a, c, g, t in COMPOSITION.emission.tolist()]
    (t00, t01), (t10, t11) = ([f"ln({x})" for x in row] for row in COMPOSITION.transition.tolist())
    lse = lambda a, b: f"greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b}))))"
    return {
        "fm_map": f"""WITH RECURSIVE r AS (SELECT read_id AS id, s FROM {_READS}), fp AS (SELECT rec_id, p, substr(s, p + 1, 1) AS c, substr(s, p + 1, 4) AS g FROM (SELECT rec_id, s, unnest(range(0, length(s))) AS p FROM {_FASTA})),
            h AS (SELECT id, rec_id, p, 4 AS n FROM r JOIN fp ON g = right(s, 4) WHERE length(s) >= 4), st AS (SELECT * FROM h UNION ALL SELECT id, rec_id, p, 1 FROM r JOIN fp ON c = right(s, 1) WHERE s <> '' AND id NOT IN (SELECT id FROM h)
            UNION ALL SELECT st.id, st.rec_id, st.p - 1, n + 1 FROM st JOIN r ON r.id = st.id JOIN fp ON fp.rec_id = st.rec_id AND fp.p = st.p - 1 AND fp.c = substr(r.s, length(r.s) - n, 1) WHERE n < length(r.s)),
            b AS (SELECT id, max(n) AS n FROM st GROUP BY id)
            SELECT r.id, CASE WHEN b.n IS NULL THEN 'Absent' WHEN b.n = length(s) THEN 'Complete' ELSE 'Partial' END AS kind, coalesce(b.n, 0) AS length, rec_id, p AS pos FROM r LEFT JOIN b ON b.id = r.id LEFT JOIN st ON st.id = b.id AND st.n = b.n""",
        "smems": f"""WITH x AS (SELECT id, p AS x, substr(s, p + 1, 10) AS g FROM (SELECT read_id AS id, s, unnest(range(0, length(s) - 9)) AS p FROM {_READS} WHERE length(s) >= 10)),
            t AS (SELECT rec_id * 2 AS t, s FROM {_FASTA} UNION ALL SELECT rec_id * 2 + 1, reverse(translate(s, 'ACGT', 'TGCA')) FROM {_FASTA}),
            y AS (SELECT t, p AS y, substr(s, p + 1, 10) AS g FROM (SELECT t, s, unnest(range(0, length(s) - 9)) AS p FROM t WHERE length(s) >= 10)),
            h AS (SELECT id, t, x, y FROM x JOIN y USING (g) WHERE regexp_full_match(g, '[ACGTN]+')), i AS (SELECT *, x - row_number() OVER (PARTITION BY id, t, y - x ORDER BY x) AS k FROM h),
            m AS (SELECT id, a, b, count(*) AS n FROM (SELECT id, min(x) AS a, max(x) + 10 AS b FROM i GROUP BY id, t, y - x, k) GROUP BY 1, 2, 3),
            r AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m)
            SELECT id, a AS start_pos, b - a AS length, n AS n_hits FROM r WHERE reach IS NULL OR reach < b""",
        "align_site": f"""WITH RECURSIVE r AS (SELECT read_id AS id, s FROM {_READS}),
            st AS (SELECT id, s, 0 AS i, j, CASE WHEN j = 0 THEN 0 ELSE -4 - j END AS hg, -1000000 AS vg, 0 AS hs, -1000000 AS vs, 0 AS hl, -1000000 AS vl, 0 AS top FROM (SELECT id, s, unnest(range(0, length(s) + 1)) AS j FROM r)
            UNION ALL SELECT id, s, i, j, greatest(bg, -4 - j + max(bg + j) OVER w) AS hg, vg, greatest(bs, -4 - j + max(bs + j) OVER w) AS hs, vs, greatest(bl, -4 - j + max(bl + j) OVER w) AS hl, vl, greatest(top, bl, -4 - j + max(bl + j) OVER w) AS top
            FROM (SELECT id, s, i, j, vg, vs, vl, top, greatest(vg, dg + m) AS bg, greatest(vs, ds + m) AS bs, greatest(vl, dl + m, 0) AS bl FROM (SELECT id, s, i + 1 AS i, j, top, greatest(vg - 1, hg - 5) AS vg, greatest(vs - 1, hs - 5) AS vs, greatest(vl - 1, hl - 5) AS vl,
              coalesce(lag(hg) OVER v, -1000000) AS dg, coalesce(lag(hs) OVER v, -1000000) AS ds, coalesce(lag(hl) OVER v, -1000000) AS dl, CASE WHEN substr('{SITE}', i + 1, 1) = substr(s, j, 1) THEN 1 ELSE -1 END AS m FROM st WHERE i < {len(SITE)} WINDOW v AS (PARTITION BY id ORDER BY j)))
            WINDOW w AS (PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
            SELECT id, CAST(max(CASE WHEN j = length(s) THEN hg END) AS BIGINT) AS global, CAST(max(hs) AS BIGINT) AS semiglobal, CAST(max(top) AS BIGINT) AS local FROM st WHERE i = {len(SITE)} GROUP BY id""",
        "pair_hmm_site": f"""WITH RECURSIVE st AS (SELECT read_id AS id, s, 0 AS j, i, CASE WHEN i = 0 THEN 2.0::DOUBLE ELSE 1.0 END AS m, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM (SELECT read_id, s, unnest(range(0, length(s) + 1)) AS i FROM {_READS})
            UNION ALL SELECT id, s, j, i, m, CASE WHEN i = 0 THEN 0 ELSE (1 - {p.substitution}) * {p.gap_y} * lag(m) OVER (PARTITION BY id ORDER BY i) END AS x, y FROM (SELECT id, s, j + 1 AS j, i, CASE WHEN i = 0 THEN 0 ELSE (CASE WHEN substr(s, i, 1) = substr('{SITE}', j + 1, 1) THEN 1 - {p.substitution} ELSE {p.substitution} / 3 END)
              * lag((1 - {p.gap_x} - {p.gap_y}) * m + x + y) OVER (PARTITION BY id ORDER BY i) END AS m, CASE WHEN i = 0 THEN 0 ELSE (1 - {p.substitution}) * {p.gap_x} * m END AS y FROM st WHERE j < {len(SITE)}))
            SELECT id, round(least(ln(sum(m + x + y) FILTER (i > 0)), 0), 4) AS ln_p FROM st WHERE j = {len(SITE)} GROUP BY id""",
        "myers_ends": _ENDS,
        "ukkonen_ends": _ENDS,
        "myers_best": f"""SELECT id, arg_min(end_pos, (dist, end_pos)) AS end_pos, min(dist) AS dist FROM (SELECT read_id AS id, e - 1 AS end_pos, min(levenshtein('GATTAC', substr(s, e - n + 1, n))) AS dist
            FROM (SELECT read_id, s, unnest(generate_series(1, length(s))) AS e FROM {_READS}), (SELECT unnest(generate_series(1, 12)) AS n) WHERE e >= n GROUP BY 1, 2) GROUP BY 1""",
        "lcp_sus": f"""WITH sfx AS (SELECT id, pos, substr(t, pos + 1) AS f, length(t) AS len FROM (SELECT read_id AS id, s || '$' AS t, unnest(generate_series(0, length(s))) AS pos FROM {_READS})),
            ord AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f) AS r, lag(f) OVER (PARTITION BY id ORDER BY f) AS g FROM sfx),
            lcp AS (SELECT id, r, max(CASE WHEN left(f, k) = left(g, k) THEN k ELSE 0 END) AS l FROM (SELECT *, unnest(generate_series(0, least(length(f), length(g)))) AS k FROM ord WHERE g IS NOT NULL) GROUP BY 1, 2),
            both_ AS (SELECT o.id, o.pos, o.len, coalesce(a.l, -1) AS l, greatest(1 + greatest(coalesce(a.l, -1), coalesce(b.l, -1)), 1) AS need FROM ord o LEFT JOIN lcp a ON a.id = o.id AND a.r = o.r LEFT JOIN lcp b ON b.id = o.id AND b.r = o.r + 1)
            SELECT id, max(l) AS longest_repeat, min(CASE WHEN pos + need <= len THEN need END) AS shortest_unique, count(CASE WHEN pos + need <= len THEN 1 END) AS n_unique FROM both_ GROUP BY id""",
        "hmm_decode": f"""WITH RECURSIVE h AS (SELECT read_id AS id, s, 1 AS t, ln(0.5) + {emit[0].format(1)} AS f0, ln(0.5) + {emit[1].format(1)} AS f1, ln(0.5) + {emit[0].format(1)} AS v0, ln(0.5) + {emit[1].format(1)} AS v1, 0 AS c0, 1 AS c1 FROM {_READS} WHERE length(s) > 0
            UNION ALL SELECT id, s, t + 1, {lse(f"f0 + {t00}", f"f1 + {t10}")} + {emit[0].format("t + 1")}, {lse(f"f0 + {t01}", f"f1 + {t11}")} + {emit[1].format("t + 1")}, greatest(v0 + {t00}, v1 + {t10}) + {emit[0].format("t + 1")}, greatest(v0 + {t01}, v1 + {t11}) + {emit[1].format("t + 1")},
            CASE WHEN v0 + {t00} >= v1 + {t10} THEN c0 ELSE c1 END, 1 + CASE WHEN v0 + {t01} >= v1 + {t11} THEN c0 ELSE c1 END FROM h WHERE t < length(s))
            SELECT id, CAST(CASE WHEN v0 >= v1 THEN c0 ELSE c1 END AS BIGINT) AS n_rich, round(greatest(v0, v1), 6) AS ln_viterbi, round({lse("f0", "f1")}, 6) AS ln_forward, round({lse("f0", "f1")}, 6) AS ln_backward FROM h WHERE t = length(s)""",
        "suffix_array": f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY substr(t, pos + 1)) - 1 AS rnk, pos, CASE WHEN pos = 0 THEN right(t, 1) ELSE substr(t, pos, 1) END AS bwt FROM (SELECT read_id AS id, s || '$' AS t, unnest(generate_series(0, length(s))) AS pos FROM {_READS})",
        "fm_search": f"""WITH k AS (SELECT rec_id, s, pattern, coalesce(max(n), 0) AS n FROM (SELECT rec_id, s, pattern, unnest(generate_series(1, length(pattern))) AS n FROM {_FASTA}, (VALUES {pats}) v(pattern)) WHERE contains(s, right(pattern, n)) GROUP BY 1, 2, 3),
            b AS (SELECT f.rec_id, f.s, v.pattern, coalesce(n, 0) AS n FROM {_FASTA} f CROSS JOIN (VALUES {pats}) v(pattern) LEFT JOIN k ON k.rec_id = f.rec_id AND k.pattern = v.pattern)
            SELECT rec_id AS id, pattern, CASE WHEN n = length(pattern) THEN 'Complete' ELSE 'Partial' END AS kind, n AS length, i AS pos FROM (SELECT *, unnest(generate_series(0, length(s) - n)) AS i FROM b WHERE n > 0) WHERE substr(s, i + 1, n) = right(pattern, n)
            UNION ALL SELECT rec_id, pattern, 'Absent', 0, NULL FROM b WHERE n = 0""",
    }
