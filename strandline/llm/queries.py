"""Queries and oracle SQL of the training-data operators (problems 1, 2, 7, 8, 9 and 10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import containers, languages, leakage, neardup, repeats, splitting
from strandline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.boundary_runs(table(spark, sf_dir, "fasta"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record in pieces, along with the size its index claims."""
    fasta = table(spark, sf_dir, "fasta")
    claims = splitting.claimed_lengths(table(spark, sf_dir, "fai"))
    named = fasta.select("rec_id", F.col("id").alias("name")).join(claims, "name", "left").select("rec_id", "claimed_len", F.coalesce("n_claims", F.lit(0)).alias("n_claims"))
    size = splitting.split_oversized(fasta)
    return size.join(named, "rec_id")


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record put together again from its pieces, and whether these keep the limit and overlap as they should."""
    overlap = splitting.OVERLAP
    p = splitting.split_oversized(table(spark, sf_dir, "fasta")).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "piece"))).alias("p"))
    rest = F.transform("p", lambda x, i: F.when(i == 0, x["piece"]).otherwise(F.substring(x["piece"], F.lit(overlap + 1), F.length(x["piece"]))))
    chained = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | (F.element_at("p", i)["start_pos"] == F.element_at("p", F.greatest(i - 1, F.lit(1)))["end_pos"] - overlap))
    whole = F.array_join(rest, "")
    return p.select("rec_id", F.md5(whole).alias("digest"), F.length(whole).cast("bigint").alias("n_symbols"), F.forall("p", lambda x: F.length(x["piece"]) <= splitting.LIMIT).alias("within"), chained.alias("chained"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "fastq")).select(F.col("id_a").alias("read_id_a"), F.col("id_b").alias("read_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "fastq")).select(F.col("id").alias("read_id"), "rep", "group_id", "n_links")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.shared_spans(table(spark, sf_dir, "fasta"))


def p7_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.shared_fraction(table(spark, sf_dir, "fasta"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.fill_containers(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.container_fill(p8_containers(spark, sf_dir))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: is all of it placed, in one piece unless it exceeds a container, and are its containers within their capacity?"""
    a = containers.fill_containers(table(spark, sf_dir, "documents"))
    full = a.filter("container_id >= 0").groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    d = a.join(full, "container_id", "left").groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max(F.col("tok_start") + F.col("n_tokens")).alias("reach"), F.max(F.coalesce("held", F.lit(0))).alias("held"))
    cap = containers.CAPACITY
    return d.select("doc_id", (F.col("n") == F.col("reach")).alias("complete"), (F.col("pieces") == F.greatest(F.ceil(F.col("n") / cap), F.lit(1))).alias("whole"), (F.col("held") <= cap).alias("within"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that hold a part of it."""
    items = table(spark, sf_dir, "benchmark").select("item_id")
    return items.join(p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_docs"))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.label_segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled(p10_segments(spark, sf_dir)).select("doc_id", "par_no", "lang")


_CLEAN = "upper(regexp_replace(seq, '\\s', '', 'g'))"

_P1_RUNS = f"""
toks AS (SELECT rec_id, unnest(regexp_extract_all(s, 'N{{10,}}|N{{1,9}}|[^N]+')) AS tok, generate_subscripts(regexp_extract_all(s, 'N{{10,}}|N{{1,9}}|[^N]+'), 1) AS i
         FROM (SELECT rec_id, {_CLEAN} AS s FROM fasta) WHERE length(s) > 5000),
placed AS (SELECT rec_id, tok, sum(length(tok)) OVER (PARTITION BY rec_id ORDER BY i) - length(tok) AS pos FROM toks),
runs AS (SELECT rec_id, CAST(pos AS BIGINT) AS gap_start FROM placed WHERE tok LIKE 'NNNNNNNNNN%')"""

_P2_PAIRS = f"""
grams AS (SELECT DISTINCT read_id, substr(s, i, 12) AS g
          FROM (SELECT read_id, s, unnest(generate_series(1, length(s) - 11)) AS i FROM (SELECT read_id, {_CLEAN} AS s FROM fastq WHERE seq IS NOT NULL) WHERE length(s) >= 12)),
sizes AS (SELECT read_id, count(*) AS n FROM grams GROUP BY read_id),
both_ AS (SELECT x.read_id AS a, y.read_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.read_id < y.read_id GROUP BY 1, 2)"""

_P7_SPANS = f"""
recs AS (SELECT rec_id, {_CLEAN} AS s FROM fasta WHERE seq IS NOT NULL),
wins AS (SELECT rec_id, i - 1 AS pos, substr(s, i, 48) AS w FROM (SELECT rec_id, s, unnest(generate_series(1, length(s) - 47)) AS i FROM recs WHERE length(s) >= 48)),
good AS (SELECT * FROM wins WHERE regexp_full_match(w, '[ACGT]+')),
common AS (SELECT w FROM good GROUP BY w HAVING count(DISTINCT rec_id) > 1),
hit AS (SELECT rec_id, pos FROM good SEMI JOIN common USING (w)),
flag AS (SELECT rec_id, pos, CASE WHEN pos > coalesce(lag(pos) OVER (PARTITION BY rec_id ORDER BY pos), -1000) + 48 THEN 1 ELSE 0 END AS f FROM hit),
isl AS (SELECT rec_id, pos, sum(f) OVER (PARTITION BY rec_id ORDER BY pos) AS g FROM flag),
spans AS (SELECT rec_id, CAST(min(pos) AS BIGINT) AS span_start, CAST(max(pos) + 48 AS BIGINT) AS span_end FROM isl GROUP BY rec_id, g)"""

_P9_PAIRS = """
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+') AS w FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, list_aggregate(w[i : i + 11], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, list_aggregate(w[i : i + 11], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM iw WHERE len(w) >= 12)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_groups, p7_found, p7_share, p8_containers, p8_documents, p8_fill, p9_found, p9_items, p10_found, p10_segments)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_P1_RUNS} SELECT rec_id, gap_start FROM runs UNION ALL SELECT DISTINCT rec_id, CAST(-1 AS BIGINT) FROM toks WHERE rec_id NOT IN (SELECT rec_id FROM runs)",
        "p2_found": f"WITH {_P2_PAIRS} SELECT a AS read_id_a, b AS read_id_b FROM both_ JOIN sizes p ON p.read_id = a JOIN sizes q ON q.read_id = b WHERE k >= 0.5 * (p.n + q.n - k)",
        "p1_pieces": f"""WITH RECURSIVE {_P1_RUNS}, gp AS (SELECT rec_id, CAST(pos AS BIGINT) AS s, CAST(pos + length(tok) AS BIGINT) AS e FROM placed WHERE tok LIKE 'NNNNNNNNNN%'),
            sq AS (SELECT rec_id, id, coalesce({_CLEAN}, '') AS s FROM fasta), nd AS (SELECT rec_id, 0::BIGINT AS a, length(s) AS b, 'start' AS kind FROM sq WHERE length(s) > 5000
            UNION ALL SELECT rec_id, CASE WHEN side = 0 THEN a ELSE c END, CASE WHEN side = 0 THEN c ELSE b END, CASE WHEN side = 0 THEN kind WHEN gap THEN 'gap' ELSE 'midpoint' END
            FROM (SELECT rec_id, a, b, kind, coalesce(arg_min(spot, {{'x': s - e, 'y': abs(spot - mid), 'z': spot}}), mid) AS c, count(spot) > 0 AS gap FROM (SELECT m.*, g.s, g.e, CASE WHEN g.s IS NOT NULL THEN least(greatest((g.s + g.e) // 2, a + 1), b - 1) END AS spot
              FROM (SELECT *, (a + b) // 2 AS mid, greatest(1, (b - a) // 4) AS near FROM nd WHERE b - a > 4900) m LEFT JOIN gp g ON g.rec_id = m.rec_id AND g.e >= mid - near AND g.s <= mid + near AND abs(least(greatest((g.s + g.e) // 2, a + 1), b - 1) - mid) <= near)
              GROUP BY rec_id, a, b, kind, mid), (VALUES (0), (1)) v(side)),
            lf AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY a) - 1 AS k, a, b, kind FROM nd WHERE b - a <= 4900),
            pc AS (SELECT rec_id, CAST(k AS INT) AS piece_no, CASE WHEN k = 0 THEN 0 ELSE a - 100 END AS start_pos, b AS end_pos, kind AS cut FROM lf UNION ALL SELECT rec_id, 0, 0, length(s), 'whole' FROM sq WHERE length(s) <= 5000)
            SELECT pc.rec_id, piece_no, start_pos, end_pos, cut, substr(s, start_pos + 1, end_pos - start_pos) AS piece, claimed_len, coalesce(n_claims, 0) AS n_claims FROM pc JOIN sq ON sq.rec_id = pc.rec_id LEFT JOIN (SELECT name, max(len) AS claimed_len, count(*) AS n_claims FROM fai WHERE name IS NOT NULL GROUP BY 1) f ON f.name = sq.id""",
        "p1_rebuilt": f"SELECT rec_id, md5(coalesce({_CLEAN}, '')) AS digest, CAST(length(coalesce({_CLEAN}, '')) AS BIGINT) AS n_symbols, TRUE AS within, TRUE AS chained FROM fasta",
        "p2_groups": f"""WITH RECURSIVE {_P2_PAIRS}, rd AS (SELECT read_id, s, min(read_id) OVER (PARTITION BY s) AS rep FROM (SELECT read_id, {_CLEAN} AS s FROM fastq WHERE seq IS NOT NULL) WHERE length(s) >= 12),
            ln AS (SELECT a, b FROM both_ JOIN sizes p ON p.read_id = a JOIN sizes q ON q.read_id = b WHERE k >= 0.5 * (p.n + q.n - k) AND a IN (SELECT rep FROM rd) AND b IN (SELECT rep FROM rd)),
            e AS (SELECT a AS s, b AS t FROM ln UNION ALL SELECT b, a FROM ln), reach AS (SELECT DISTINCT rep AS n, rep AS m FROM rd UNION SELECT reach.n, e.t FROM reach JOIN e ON e.s = reach.m),
            g AS (SELECT n, min(m) AS group_id FROM reach GROUP BY n), dg AS (SELECT s AS n, count(*) AS n_links FROM e GROUP BY s)
            SELECT read_id, rep, group_id, coalesce(n_links, 0) AS n_links FROM rd JOIN g ON g.n = rep LEFT JOIN dg ON dg.n = rep""",
        "p8_documents": "SELECT doc_id, TRUE AS complete, TRUE AS whole, TRUE AS within FROM documents",
        "p7_found": f"WITH {_P7_SPANS} SELECT rec_id, span_start, span_end FROM spans",
        "p7_share": f"""WITH {_P7_SPANS} SELECT f.rec_id, CAST(coalesce(length({_CLEAN.replace('seq', 'f.seq')}), 0) AS BIGINT) AS n_symbols, CAST(coalesce(n, 0) AS BIGINT) AS n_shared,
            CASE WHEN coalesce(length({_CLEAN.replace('seq', 'f.seq')}), 0) > 0 THEN round(coalesce(n, 0) / length({_CLEAN.replace('seq', 'f.seq')}), 6) ELSE 0.0 END AS share
            FROM fasta f LEFT JOIN (SELECT rec_id, sum(span_end - span_start) AS n FROM spans GROUP BY rec_id) s ON s.rec_id = f.rec_id""",
        "p9_found": f"WITH {_P9_PAIRS} SELECT doc_id, item_id FROM leaks",
        "p9_items": f"WITH {_P9_PAIRS} SELECT b.item_id, CAST(count(l.doc_id) AS BIGINT) AS n_docs FROM benchmark b LEFT JOIN leaks l ON l.item_id = b.item_id GROUP BY b.item_id",
    }
