"""Queries and oracle SQL of the general data-cleaning operators (problems 3 to 6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import packed, periods, rejects, skew
from strandline.session import table


def _first_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "bedpe").filter("chrom1 is not null and chrom1 <> '.' and start1 >= 0 and end1 > start1")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periods_and_gaps(_first_ends(spark, sf_dir), ["track_id", "chrom1"], "start1", "end1")


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track and chromosome: how many periods, what they cover and what the gaps between them amount to."""
    m = periods.merge_intervals(_first_ends(spark, sf_dir), ["track_id", "chrom1"], "start1", "end1")
    return m.groupBy(F.col("k0").alias("track_id"), F.col("k1").alias("chrom1")).agg(F.count("*").alias("n_periods"), F.sum(F.col("span_end") - F.col("span_start")).alias("covered"), F.coalesce(F.sum(F.col("span_start") - F.col("prev_end")), F.lit(0)).cast("bigint").alias("uncovered"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.split_packed(table(spark, sf_dir, "gff"), "feature_id", "attributes").withColumnRenamed("id", "feature_id")


def p4_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tag: values, features and distinct values."""
    v = p4_found(spark, sf_dir)
    per = v.groupBy("tag", "val").agg(F.count("*").alias("n"))
    return per.groupBy("tag").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the counts of their shards."""
    out = None
    for name, key, row in (("gff", "seqname", "feature_id"), ("bed", "chrom", "interval_id")):
        one = skew.hot_keys(table(spark, sf_dir, name), key, F.col(row)).select(F.lit(name).alias("table_name"), F.col("key").alias("key_val"))
        out = one if out is None else out.unionByName(one)
    return out


def p5_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sequence name of gff and bed: rows and covered length (1-based closed spans of gff taken as half-open from start)."""
    out = None
    for name, key, row in (("gff", "seqname", "feature_id"), ("bed", "chrom", "interval_id")):
        t = table(spark, sf_dir, name)
        cover = skew.covered_length(t, key, "start_pos", "end_pos", F.col(row)).withColumnRenamed("key", "key_val")
        counts = skew.per_key(t, key, F.col(row), {"n_rows": (F.count("*"), F.sum)}).withColumnRenamed(key, "key_val")
        one = counts.join(cover, "key_val", "left").select(F.lit(name).alias("table_name"), "key_val", "n_rows", F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"))
        out = one if out is None else out.unionByName(one)
    return out


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest features of each sequence name."""
    gff = table(spark, sf_dir, "gff").select("feature_id", "seqname", (F.col("end_pos") - F.col("start_pos")).alias("span"))
    return skew.top_per_key(gff, "seqname", [F.desc_nulls_last("span"), F.asc("feature_id")], 3, F.col("feature_id")).select("seqname", "feature_id", "span", F.col("__rank").alias("rank"))


def p5_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature type and name: features, and the rows of bed that begin in the same 4,096 symbols of the name, by a fragment-replicate join."""
    gff = table(spark, sf_dir, "gff").select("feature_id", "seqname", "feature_type", F.expr("start_pos div 4096").alias("block"))
    bed = table(spark, sf_dir, "bed").groupBy("chrom", F.expr("start_pos div 4096").alias("at")).agg(F.count("*").alias("n_bed"))
    j = skew.fragment_replicate_join(gff, bed, "seqname", "chrom", F.col("feature_id"), [("block", "at")])
    return j.groupBy("seqname", "feature_type").agg(F.count("*").alias("n_features"), F.sum("n_bed").alias("n_bed"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.parse_records(table(spark, sf_dir, "raw_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(_parsed(spark, sf_dir))


def _loaded(fmt: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rejects.loaded(_parsed(spark, sf_dir), fmt)

    query.__name__ = f"p6_loaded_{fmt}"
    return query


_P3 = """
v AS (SELECT DISTINCT track_id, chrom1, start1 AS s, end1 AS e FROM bedpe WHERE chrom1 IS NOT NULL AND chrom1 <> '.' AND start1 >= 0 AND end1 > start1),
m AS (SELECT *, max(e) OVER (PARTITION BY track_id, chrom1 ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, chrom1 ORDER BY s, e) AS k FROM m),
p AS (SELECT track_id, chrom1, min(s) AS a, max(e) AS b FROM g GROUP BY track_id, chrom1, k),
n AS (SELECT *, lead(a) OVER (PARTITION BY track_id, chrom1 ORDER BY a) AS c FROM p)"""

_P4 = r"""
f AS (SELECT feature_id, trim(attributes) AS a FROM gff WHERE attributes IS NOT NULL AND trim(attributes) NOT IN ('', '.')),
t AS (SELECT feature_id, unnest(regexp_extract_all(a, '[ \t]*[^;= \t]+(?:[ \t]*=?[ \t]*)(?:"(?:[^"]|"")*"[ \t]*|''[^'']*''[ \t]*|[^;,|"''][^;,|]*|[,|][ \t]*)*')) AS one,
             generate_subscripts(regexp_extract_all(a, '[ \t]*[^;= \t]+(?:[ \t]*=?[ \t]*)(?:"(?:[^"]|"")*"[ \t]*|''[^'']*''[ \t]*|[^;,|"''][^;,|]*|[,|][ \t]*)*'), 1) AS i FROM f),
u AS (SELECT feature_id, i, regexp_extract(one, '[ \t]*([^;= \t]+)', 1) AS tag, regexp_replace(one, '^[ \t]*[^;= \t]+[ \t]*=?[ \t]*', '') AS vals FROM t),
w AS (SELECT feature_id, i, tag, unnest(regexp_extract_all(',' || vals, '[,|][ \t]*("(?:[^"]|"")*"|''[^'']*''|[^,|]*)', 1)) AS v,
             generate_subscripts(regexp_extract_all(',' || vals, '[,|][ \t]*("(?:[^"]|"")*"|''[^'']*''|[^,|]*)', 1), 1) AS j FROM u),
x AS (SELECT feature_id, i, j, tag, CASE WHEN length(trim(v)) > 1 AND trim(v) LIKE '"%"' THEN replace(substr(trim(v), 2, length(trim(v)) - 2), '""', '"')
             WHEN length(trim(v)) > 1 AND trim(v) LIKE '''%''' THEN substr(trim(v), 2, length(trim(v)) - 2) ELSE trim(v) END AS v FROM w),
p4 AS (SELECT feature_id, CAST(row_number() OVER (PARTITION BY feature_id ORDER BY i, j) - 1 AS INT) AS val_pos, tag, url_decode(regexp_replace(v, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)', '%25\1', 'g')) AS val FROM x WHERE v <> '')"""


_P6 = r"""
src AS (SELECT raw_id, file_name, line_no, lower(fmt) AS fmt, raw, CASE WHEN right(raw, 1) = chr(13) THEN left(raw, length(raw) - 1) ELSE raw END AS l FROM raw_records WHERE raw IS NOT NULL),
ln AS (SELECT *, regexp_extract_all(chr(9) || l, '(?s)\t("(?:[^"]|"")*"|[^\t]*)', 1) AS f FROM src WHERE fmt <> 'fastq' AND l <> '' AND NOT starts_with(raw, '#')),
wd AS (SELECT fmt, file_name, arg_min(len(f), line_no) AS width FROM ln WHERE fmt IN ('bed', 'bedpe') GROUP BY 1, 2),
ck AS (SELECT ln.*, regexp_full_match(l, '(?s)("[^"]*(""[^"]*)*"|[^"\t][^\t]*|)(\t("[^"]*(""[^"]*)*"|[^"\t][^\t]*|))*') AND NOT (ln.fmt = 'gtf' AND (length(coalesce(f[9], '')) - length(replace(coalesce(f[9], ''), '"', ''))) % 2 = 1) AS quoted,
       CASE WHEN ln.fmt IN ('bed', 'bedpe') THEN width ELSE 9 END AS width, list_transform(f, lambda x: CASE WHEN length(x) > 1 AND x LIKE '"%"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c
       FROM ln LEFT JOIN wd ON wd.fmt = ln.fmt AND wd.file_name IS NOT DISTINCT FROM ln.file_name),
nm AS (SELECT *, list_transform(c, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN TRY_CAST(x AS BIGINT) END) AS v FROM ck),
lr AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> width THEN 'layout' WHEN NOT coalesce(CASE fmt WHEN 'bed' THEN v[2] <= v[3] WHEN 'bedpe' THEN v[2] <= v[3] AND v[5] <= v[6] ELSE v[4] <= v[5] END, FALSE) THEN 'coords'
       WHEN fmt IN ('gff3', 'gtf') AND c[8] NOT IN ('.', '0', '1', '2') THEN 'phase' END AS reason FROM nm),
fq AS (SELECT raw_id, list_transform(string_split(raw, chr(10)), lambda x: CASE WHEN right(x, 1) = chr(13) THEN left(x, length(x) - 1) ELSE x END) AS p FROM src WHERE fmt = 'fastq'),
fr AS (SELECT *, CASE WHEN len(p) <> 4 OR NOT starts_with(p[1], '@') OR NOT starts_with(p[3], '+') THEN 'layout' WHEN NOT regexp_full_match(p[2], '[ACGTRYSWKMBDHVNacgtryswkmbdhvn]+') THEN 'seq'
       WHEN length(p[4]) <> length(p[2]) OR NOT regexp_full_match(p[4], '[!-~]*') THEN 'qual' END AS reason FROM fq)"""


def _covered(name: str, key: str) -> str:
    return f"""SELECT '{name}' AS table_name, key_val, n_rows, CAST(coalesce(c, 0) AS BIGINT) AS covered FROM (SELECT {key} AS key_val, count(*) AS n_rows FROM {name} WHERE {key} IS NOT NULL GROUP BY 1)
    LEFT JOIN (SELECT k, sum(b - a) AS c FROM (SELECT k, min(s) AS a, max(e) AS b FROM (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g
      FROM (SELECT {key} AS k, start_pos AS s, end_pos AS e, max(end_pos) OVER (PARTITION BY {key} ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {name} WHERE {key} IS NOT NULL AND end_pos > start_pos))
      GROUP BY k, g) GROUP BY k) ON k = key_val"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f.__name__: f for f in (p3_found, p3_coverage, p4_found, p4_tags, p5_found, p5_stats, p5_top, p5_depth, p6_found)}
    return found | {f"p6_loaded_{fmt}": _loaded(fmt) for fmt in ("bed", "bedpe", "gff3", "gtf", "fastq")}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_P3} SELECT track_id, chrom1, 'period' AS kind, a AS span_start, b AS span_end FROM n UNION ALL SELECT track_id, chrom1, 'gap', b, c FROM n WHERE c IS NOT NULL",
        "p3_coverage": f"WITH {_P3} SELECT track_id, chrom1, count(*) AS n_periods, CAST(sum(b - a) AS BIGINT) AS covered, CAST(coalesce(sum(c - b), 0) AS BIGINT) AS uncovered FROM n GROUP BY 1, 2",
        "p4_found": f"WITH {_P4} SELECT feature_id, val_pos, tag, val FROM p4",
        "p4_tags": f"WITH {_P4} SELECT tag, count(*) AS n_values, count(DISTINCT val) AS n_distinct FROM p4 GROUP BY tag",
        "p6_found": f"WITH {_P6} SELECT raw_id, reason FROM lr WHERE reason IS NOT NULL UNION ALL SELECT raw_id, reason FROM fr WHERE reason IS NOT NULL",
        "p6_loaded_bed": f"WITH {_P6} SELECT raw_id, c[1] AS chrom, v[2] AS start_pos, v[3] AS end_pos, CASE WHEN len(c) > 3 THEN c[4:] END AS aux FROM lr WHERE reason IS NULL AND fmt = 'bed'",
        "p6_loaded_bedpe": f"WITH {_P6} SELECT raw_id, c[1] AS chrom1, v[2] AS start1, v[3] AS end1, c[4] AS chrom2, v[5] AS start2, v[6] AS end2, CASE WHEN len(c) > 6 THEN c[7:] END AS aux FROM lr WHERE reason IS NULL AND fmt = 'bedpe'",
        **{f"p6_loaded_{k}": f"WITH {_P6} SELECT raw_id, c[1] AS seqname, c[2] AS source, c[3] AS feature_type, v[4] AS start_pos, v[5] AS end_pos, c[6] AS score, c[7] AS strand, TRY_CAST(c[8] AS TINYINT) AS phase, c[9] AS attributes FROM lr WHERE reason IS NULL AND fmt = '{k}'" for k in ("gff3", "gtf")},
        "p6_loaded_fastq": f"WITH {_P6} SELECT raw_id, split_part(substr(p[1], 2), ' ', 1) AS id, CASE WHEN contains(p[1], ' ') THEN substr(p[1], instr(p[1], ' ') + 1) END AS descr, p[2] AS seq, p[4] AS qual FROM fr WHERE reason IS NULL",
        "p5_found": "SELECT 'gff' AS table_name, seqname AS key_val FROM gff WHERE seqname IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.04 * (SELECT count(*) FROM gff) UNION ALL SELECT 'bed', chrom FROM bed WHERE chrom IS NOT NULL GROUP BY 2 HAVING count(*) >= 0.04 * (SELECT count(*) FROM bed)",
        "p5_stats": _covered("gff", "seqname") + " UNION ALL " + _covered("bed", "chrom"),
        "p5_top": "SELECT seqname, feature_id, span, CAST(rank AS INT) AS rank FROM (SELECT seqname, feature_id, end_pos - start_pos AS span, row_number() OVER (PARTITION BY seqname ORDER BY end_pos - start_pos DESC NULLS LAST, feature_id) AS rank FROM gff WHERE seqname IS NOT NULL) WHERE rank <= 3",
        "p5_depth": "SELECT seqname, feature_type, count(*) AS n_features, CAST(sum(n_bed) AS BIGINT) AS n_bed FROM gff JOIN (SELECT chrom, start_pos // 4096 AS block, count(*) AS n_bed FROM bed GROUP BY 1, 2) ON seqname = chrom AND start_pos // 4096 = block GROUP BY 1, 2",
    }
