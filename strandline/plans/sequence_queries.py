"""Queries over sequences: checks, composition, search, q-grams, reading frames, records, intervals; with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import alphabets as al
from strandline.functions import checks, records, search, seqstats
from strandline.operators import intervals, packed, periods, qgrams
from strandline.operators.pairs import spread
from strandline.plans.core_queries import _P4
from strandline.session import table

_S = "upper(regexp_replace(seq, '\\s', '', 'g'))"
_FASTA = f"(SELECT rec_id, id, descr, {_S} AS s FROM fasta WHERE seq IS NOT NULL)"
_READS = f"(SELECT read_id, id, descr, {_S} AS s, qual FROM fastq WHERE seq IS NOT NULL)"
PATTERN = "GATTACA"
ALPHABET = al.Alphabet("ACGNTRYSWKMBDHV")


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fasta").filter("seq is not null").select("rec_id", "id", "descr", F.upper(F.regexp_replace("seq", r"\s+", "")).alias("s"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fastq").filter("seq is not null").select("read_id", "id", "descr", F.upper(F.regexp_replace("seq", r"\s+", "")).alias("s"), "qual")


def gc_content(spark, d):
    return fasta(spark, d).filter(al.is_word("s", al.DNA_IUPAC)).select("rec_id", F.round(seqstats.gc_content("s"), 6).alias("gc"), F.round(seqstats.gc3_content("s"), 6).alias("gc3"))


def is_word(spark, d):
    f = fasta(spark, d)
    return f.select("rec_id", al.is_word("s", al.DNA).alias("dna"), al.is_word("s", al.DNA_N).alias("dna_n"), al.is_word("s", al.DNA_IUPAC).alias("iupac"), al.is_word("s", al.PROTEIN).alias("protein"), al.is_word(F.replace("s", F.lit("T"), F.lit("U")), al.RNA_IUPAC).alias("rna"), al.is_word("s", al.PROTEIN_IUPAC).alias("protein_iupac"), al.is_word(F.lower("s"), al.ENGLISH_LOWER).alias("letters"))


def symbols(spark, d):
    """The alphabet each record uses, and what it has beyond the bases."""
    f = fasta(spark, d).select("rec_id", al.symbols_of("s").alias("symbols"))
    return f.withColumn("beyond", F.translate("symbols", "ACGT", "")).withColumn("n_symbols", F.length("symbols").cast("bigint"))


def revcomp(spark, d):
    return reads(spark, d).select("read_id", al.dna_complement("s").alias("comp"), al.dna_revcomp("s").alias("revcomp"), al.rna_revcomp(F.replace("s", F.lit("T"), F.lit("U"))).alias("rna_revcomp"))


def rank_transform(spark, d):
    return reads(spark, d).select("read_id", F.transform(al.ranks("s", ALPHABET), lambda r: r.cast("bigint")).alias("ranks"))


def qgram_codes(spark, d):
    r = spread(reads(spark, d)).select("read_id", F.explode(al.qgrams("s", 8, ALPHABET)).alias("code"))
    return r.groupBy("read_id").agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.sum("code").alias("total"))


def fasta_check(spark, d):
    return table(spark, d, "fasta").select("rec_id", checks.fasta_check("id", "seq").alias("reason"))


def fastq_check(spark, d):
    return table(spark, d, "fastq").select("read_id", checks.fastq_check("id", "seq", "qual").alias("reason"), checks.is_empty_record("id", "seq").alias("is_empty"))


def find_exact(spark, d):
    """All places of a pattern; one query for all exact matchers, as their results are the same."""
    return fasta(spark, d).select("rec_id", F.explode(search.find_all("s", PATTERN)).alias("pos"))


def find_counts(spark, d):
    """Overlapping occurrences of a low-complexity pattern."""
    return fasta(spark, d).select("rec_id", search.count_all("s", "AAA").cast("bigint").alias("n"), F.size(search.find_all("s", "ATAT")).cast("bigint").alias("n_atat"))


def _pairs(spark, d):
    r = reads(spark, d).select("read_id", "s")
    a = r.select(F.col("read_id").alias("a_id"), F.col("s").alias("a"))
    b = r.select((F.col("read_id") - 1).alias("a_id"), F.col("s").alias("b"))
    return a.join(b, "a_id")


def hamming(spark, d):
    """Each read, whole, against its reverse complement: both are of one length."""
    return spread(reads(spark, d)).select("read_id", search.hamming("s", al.dna_revcomp("s")).alias("d"))


def levenshtein(spark, d):
    return spread(_pairs(spark, d)).select("a_id", search.levenshtein("a", "b").cast("bigint").alias("d"))


def bounded_levenshtein(spark, d):
    return spread(_pairs(spark, d)).select("a_id", search.bounded_levenshtein("a", "b", 100).cast("bigint").alias("d"))


def orf(spark, d):
    return seqstats.find_orfs(spread(fasta(spark, d)), "rec_id", "s", min_len=60).select(F.col("id").alias("rec_id"), F.col("start").cast("bigint").alias("orf_start"), F.col("end").cast("bigint").alias("orf_end"), F.col("offset").cast("bigint").alias("frame"))


def fasta_text(spark, d):
    return fasta(spark, d).select("rec_id", records.fasta_text("id", "descr", "s").alias("plain"), F.md5(records.fasta_text("id", "descr", "s", 60)).alias("wrapped_md5"))


def fastq_text(spark, d):
    return reads(spark, d).filter("qual is not null").select("read_id", records.fastq_text("id", "descr", "s", "qual").alias("txt"))


def fastx_convert(spark, d):
    """Reads as FASTA, FASTA as reads of constant quality, in one schema."""
    a = reads(spark, d).select(F.lit("fasta").alias("kind"), "id", "descr", "s", F.lit(None).cast("string").alias("qual"))
    b = fasta(spark, d).select(F.lit("fastq").alias("kind"), "id", "descr", "s", records.fill_qual("s", "I").alias("qual"))
    return a.unionByName(b)


def bed_fields(spark, d):
    b = table(spark, d, "bed")
    return b.select("interval_id", records.bed_name("aux").alias("name"), records.bed_score("aux").alias("score"), records.bed_strand("aux").alias("strand"), records.bed_text("chrom", "start_pos", "end_pos", aux="aux").alias("line"))


def bed_set(spark, d):
    b = table(spark, d, "bed")
    return b.select("interval_id", F.array_join(records.set_aux("aux", 5, 3, F.lit("-")), "|").alias("strand_set"), F.array_join(records.push_aux("aux", F.lit("x")), "|").alias("pushed"))


def bedpe_fields(spark, d):
    b = table(spark, d, "bedpe")
    return b.select("pair_id", records.bedpe_name("aux").alias("name"), records.bedpe_score("aux").alias("score"), records.bedpe_strand1("aux").alias("strand1"), records.bedpe_strand2("aux").alias("strand2"))


def gff_fields(spark, d):
    g = table(spark, d, "gff")
    return g.select("feature_id", records.gff_score("score").alias("score_num"), records.gff_strand("strand").alias("strand_sign"), records.phase_text("phase").alias("phase_txt"), records.gff3_encode("attributes").alias("encoded"))


def located_bed(spark, d):
    """Each feature as a BED line, so its first symbol, and both its ends as one BEDPE line."""
    g = table(spark, d, "gff").filter("seqname is not null and end_pos > start_pos")
    strand, name = F.coalesce(records.gff_strand("strand"), F.lit(".")), F.col("feature_id").cast("string")
    whole, first = records.contig_to_bed("seqname", "start_pos", F.col("end_pos") - F.col("start_pos"), strand, name), records.point_to_bed("seqname", "start_pos", strand, name)
    ends = records.points_to_bedpe("seqname", "start_pos", strand, "seqname", F.col("end_pos") - 1, strand, name)
    line = lambda b: records.bed_text(b["chrom"], b["start"], b["end"], aux=b["aux"])
    return g.select("feature_id", line(whole).alias("whole"), line(first).alias("first"), records.bed_text(*[ends[c] for c in ("chrom1", "start1", "end1", "chrom2", "start2", "end2")], aux=ends["aux"]).alias("ends"))


def spliced_transcripts(spark, d):
    """The features of a transcript on a strand, merged, as exons of one 12-column record; a feature of no transcript is a record of its own."""
    g = table(spark, d, "gff").filter("seqname is not null and end_pos > start_pos")
    tags = packed.split_packed(g, "feature_id", "attributes").filter(F.col("tag").isin("Parent", "transcript_id"))
    tags = tags.select(F.col("id").alias("feature_id"), F.col("val").alias("transcript")).distinct()
    key = F.coalesce("transcript", F.concat(F.lit("feature "), F.col("feature_id").cast("string")))
    rows = g.join(tags, "feature_id", "left").select("seqname", F.coalesce(records.gff_strand("strand"), F.lit(".")).alias("strand"), key.alias("name"), "start_pos", "end_pos")
    exons = periods.merge_intervals(rows, ["seqname", "strand", "name"], "start_pos", "end_pos").groupBy("k0", "k1", "k2").agg(F.sort_array(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end")))).alias("exons"))
    rec = records.spliced_to_bed12("k0", F.col("exons"), F.col("k1"), F.col("k2"))
    return exons.select(F.col("k0").alias("seqname"), F.col("k1").alias("strand"), F.col("k2").alias("name"), records.bed_text(rec["chrom"], rec["start"], rec["end"], aux=rec["aux"]).alias("line"))


def base_at(spark, d):
    """The first, the middle and the hundredth symbol of each read, and their qualities."""
    r, mid = reads(spark, d), F.floor(F.length("s") / 2)
    return r.select("read_id", records.symbol_at("s", F.lit(0)).alias("first"), records.symbol_at("s", mid).alias("middle"), records.symbol_at("s", F.lit(99)).alias("far"), records.quality_at("qual", mid).cast("bigint").alias("q_middle"), records.quality_at("qual", F.lit(99)).cast("bigint").alias("q_far"))


def pack_bits(spark, d):
    """Ranks of each read packed by eights, 4 bits each, and unpacked again."""
    p = spread(reads(spark, d)).select("read_id", "s", al.pack_bits(al.ranks("s", ALPHABET), 4).alias("packed"))
    back = al.from_ranks(al.unpack_bits("packed", 4, F.length("s")), ALPHABET)
    return p.select("read_id", F.size("packed").cast("bigint").alias("n_blocks"), F.try_element_at("packed", F.lit(2)).alias("second"), F.md5(back).alias("digest"))


def rev_qgrams(spark, d):
    """Codes of 8-grams from right to left: the first and last of each read."""
    r = spread(reads(spark, d)).filter(F.length("s") >= 8).select("read_id", al.rev_qgrams("s", 8, ALPHABET).alias("c"))
    return r.select("read_id", F.element_at("c", 1).alias("last_code"), F.element_at("c", -1).alias("first_code"), F.size("c").cast("bigint").alias("n"))


def alphabet_sets(spark, d):
    """Symbols of each record: those of the bases, those beyond, and all of either."""
    have, bases = al.chars(al.symbols_of("s")), al.chars(F.lit("ACGT"))
    text = lambda a: F.array_join(F.array_sort(a), "")
    return fasta(spark, d).select("rec_id", text(F.array_intersect(have, bases)).alias("common"), text(F.array_except(have, bases)).alias("beyond"), text(F.array_union(have, bases)).alias("either"), F.size(have).cast("bigint").alias("n_symbols"))


def trim_newline(spark, d):
    """Written form of each record without its last line feed."""
    return table(spark, d, "fasta").select("rec_id", F.md5(records.trim_newline(F.concat("seq", F.lit("\n")))).alias("one"), F.length(records.trim_newline("seq")).cast("bigint").alias("n"))


def validity(spark, d):
    """Intervals whose end is not below their start."""
    return table(spark, d, "bedpe").select("pair_id", checks.valid_interval("start1", "end1").alias("first_ok"), checks.valid_interval("start2", "end2").alias("second_ok"))


def fai_fetch(spark, d):
    """Regions by name: the middle third of each record that its index describes correctly, with the byte it begins at."""
    i = table(spark, d, "fai").filter("len is not null and name is not null").distinct()
    f = fasta(spark, d).join(i, F.col("id") == F.col("name")).filter(F.col("len") == F.length("s"))
    a, b = F.floor(F.col("len") / 3), F.floor(F.col("len") * 2 / 3)
    return f.select("rec_id", "byte_offset", records.fai_offset("byte_offset", "line_bases", "line_bytes", a).alias("at_byte"), records.fetch("s", a, b).alias("part"))


def fai_names(spark, d):
    """The index's sequences with the number of claims and of records."""
    i = table(spark, d, "fai").filter("name is not null").groupBy("name").agg(F.count("*").alias("n_claims"), F.max("len").alias("max_len"))
    return i.join(table(spark, d, "fasta").select(F.col("id").alias("name"), F.length(F.regexp_replace("seq", r"\s", "")).cast("bigint").alias("n")), "name", "left")


def _features(spark, d):
    return table(spark, d, "gff").select("feature_id", "seqname", F.col("start_pos").alias("fs"), F.col("end_pos").alias("fe"))


def interval_keyed(spark, d):
    """Features and intervals of one name that overlap."""
    b = table(spark, d, "bed").select("interval_id", "chrom", "start_pos", "end_pos")
    return intervals.interval_join(_features(spark, d), b, ("fs", "fe"), ("start_pos", "end_pos"), [("seqname", "chrom")], 8192).select("feature_id", "interval_id")


def interval_plain(spark, d):
    """First ends of pairs of one track that overlap its second ends, whatever the chromosome."""
    p = table(spark, d, "bedpe").filter("start1 >= 0 and end1 > start1 and start2 >= 0 and end2 > start2")
    a = p.select(F.col("pair_id").alias("a_id"), "start1", "end1")
    b = p.select(F.col("pair_id").alias("b_id"), "start2", "end2")
    return intervals.interval_join(a, b, ("start1", "end1"), ("start2", "end2"), [], 2048).groupBy("a_id").agg(F.count("*").alias("n"), F.min("b_id").alias("first_b"))


def interval_semi(spark, d):
    """Features that any interval of their name overlaps."""
    b = table(spark, d, "bed").select("chrom", "start_pos", "end_pos")
    return intervals.interval_join(_features(spark, d), b, ("fs", "fe"), ("start_pos", "end_pos"), [("seqname", "chrom")], 8192, how="left_semi").select("feature_id")


def interval_anti(spark, d):
    """Features that none overlaps."""
    b = table(spark, d, "bed").select("chrom", "start_pos", "end_pos")
    return intervals.interval_join(_features(spark, d), b, ("fs", "fe"), ("start_pos", "end_pos"), [("seqname", "chrom")], 8192, how="left_anti").select("feature_id")


def interval_points(spark, d):
    """Intervals that each feature's first place, an empty interval, lies strictly inside of."""
    b = table(spark, d, "bed").select("interval_id", "chrom", "start_pos", "end_pos")
    at = _features(spark, d).select("feature_id", "seqname", "fs", F.col("fs").alias("ft"))
    return intervals.interval_join(at, b, ("fs", "ft"), ("start_pos", "end_pos"), [("seqname", "chrom")], 8192, empty_inside=True).groupBy("feature_id").agg(F.count("*").alias("n"), F.min("interval_id").alias("first_id"))


def interval_hits(spark, d):
    b = table(spark, d, "bed").select("chrom", "start_pos", "end_pos")
    return intervals.annotate_hits(_features(spark, d), b, ("fs", "fe"), ("start_pos", "end_pos"), [("seqname", "chrom")], "feature_id").select("feature_id", "n_hits")


def kmer_counts(spark, d):
    return qgrams.gram_counts(spread(reads(spark, d)).withColumnRenamed("s", "seq"), "read_id", "seq", 8).select("gram", "n", F.col("n_records"))


def _seeds(spark, d, q):
    """All pairs of places, of frequent q-grams too."""
    x = reads(spark, d).select(F.col("read_id").alias("id"), F.col("s").alias("seq"))
    y = fasta(spark, d).select(F.col("rec_id").alias("id"), F.col("s").alias("seq"))
    return qgrams.kmer_matches(x, y, q)


def kmer_join(spark, d):
    return _seeds(spark, d, 16).groupBy("x_id", "y_id").agg(F.count("*").alias("n"), F.min("x").cast("bigint").alias("x0"), F.min("y").cast("bigint").alias("y0"))


def diagonals(spark, d):
    m = qgrams.diagonal_matches(_seeds(spark, d, 16), 16, 2)
    return m.select("x_id", "y_id", *[F.col(c).cast("bigint").alias(c) for c in ("diag", "x_start", "x_stop", "y_start", "y_stop", "n")])


def exact_matches(spark, d):
    m = qgrams.exact_matches(_seeds(spark, d, 16), 16)
    return m.select("x_id", "y_id", *[F.col(c).cast("bigint").alias(c) for c in ("x_start", "x_stop", "y_start", "y_stop")])


_SEEDS = f"""
xg AS (SELECT read_id AS x_id, i AS x, substr(s, i + 1, 16) AS g FROM (SELECT read_id, s, unnest(generate_series(0, length(s) - 16)) AS i FROM {_READS} WHERE length(s) >= 16)),
yg AS (SELECT rec_id AS y_id, i AS y, substr(s, i + 1, 16) AS g FROM (SELECT rec_id, s, unnest(generate_series(0, length(s) - 16)) AS i FROM {_FASTA} WHERE length(s) >= 16)),
hits AS (SELECT x_id, y_id, x, y FROM xg JOIN yg USING (g))"""
_FIND = f"SELECT rec_id, CAST(i AS INT) AS pos FROM (SELECT rec_id, s, unnest(generate_series(0, length(s) - 7)) AS i FROM {_FASTA} WHERE length(s) >= 7) WHERE substr(s, i + 1, 7) = '{PATTERN}'"
_TR = "translate({}, 'AGCTYRWSKMDVHBN', 'TCGARYWSMKHBDVN')"
_PAIR = f"(SELECT a.read_id AS a_id, a.s AS a, b.s AS b FROM {_READS} a JOIN {_READS} b ON b.read_id = a.read_id + 1)"
_OVER = "seqname = chrom AND g.end_pos > b.start_pos AND g.start_pos < b.end_pos AND g.end_pos > g.start_pos AND b.end_pos > b.start_pos"


def _code(at: str) -> str:
    return f"CAST(list_sum(list_transform(range(0, 8), lambda k: CAST((instr('{ALPHABET.symbols}', s[{at} + k]) - 1) AS BIGINT) * CAST(pow(16, 7 - k) AS BIGINT))) AS BIGINT)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (gc_content, is_word, symbols, revcomp, rank_transform, qgram_codes, fasta_check, fastq_check, find_exact, find_counts, hamming, levenshtein, bounded_levenshtein, orf, fasta_text, fastq_text, fastx_convert, bed_fields, bed_set, bedpe_fields, gff_fields, located_bed, spliced_transcripts, base_at, pack_bits, rev_qgrams, alphabet_sets, trim_newline, validity, fai_fetch, fai_names, interval_keyed, interval_plain, interval_semi, interval_anti, interval_points, interval_hits, kmer_counts, kmer_join, diagonals, exact_matches)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    chars = "list_filter(string_split(s, ''), lambda x: x <> '')"
    return {
        "gc_content": f"SELECT rec_id, round(length(regexp_replace(s, '[^GC]', '', 'g')) / length(s), 6) AS gc, round(length(regexp_replace(t, '[^GC]', '', 'g')) / length(t), 6) AS gc3 FROM (SELECT rec_id, s, list_aggregate(list_filter({chars}, lambda x, i: (i - 1) % 3 = 0), 'string_agg', '') AS t FROM {_FASTA}) WHERE regexp_full_match(s, '[ACGTRYSWKMBDHVNZ]*')",
        "is_word": f"SELECT rec_id, regexp_full_match(s, '[ACGT]*') AS dna, regexp_full_match(s, '[ACGTN]*') AS dna_n, regexp_full_match(s, '[ACGTRYSWKMBDHVNZ]*') AS iupac, regexp_full_match(s, '[ARNDCEQGHILKMFPSTWYV]*') AS protein, regexp_full_match(replace(s, 'T', 'U'), '[ACGURYSWKMBDHVNZ]*') AS rna, regexp_full_match(s, '[ABCDEFGHIKLMNPQRSTVWXYZ]*') AS protein_iupac, regexp_full_match(lower(s), '[a-z]*') AS letters FROM {_FASTA}",
        "symbols": f"SELECT rec_id, sym AS symbols, translate(sym, 'ACGT', '') AS beyond, length(sym) AS n_symbols FROM (SELECT rec_id, coalesce(list_aggregate(list_sort(list_distinct({chars})), 'string_agg', ''), '') AS sym FROM {_FASTA})",
        "revcomp": f"SELECT read_id, {_TR.format('s')} AS comp, reverse({_TR.format('s')}) AS revcomp, reverse(translate(replace(s, 'T', 'U'), 'AGCUYRWSKMDVHBN', 'UCGARYWSMKHBDVN')) AS rna_revcomp FROM {_READS}",
        "rank_transform": f"SELECT read_id, list_transform({chars}, lambda x: instr('{ALPHABET.symbols}', x) - 1) AS ranks FROM {_READS}",
        "qgram_codes": f"""SELECT read_id, count(*) AS n, CAST(min(c) AS BIGINT) AS lo, CAST(max(c) AS BIGINT) AS hi, CAST(sum(c) AS BIGINT) AS total FROM (SELECT read_id, list_sum(list_transform(generate_series(0, 7), lambda k: CAST((instr('{ALPHABET.symbols}', s[i + k + 1]) - 1) AS BIGINT) * CAST(pow(16, 7 - k) AS BIGINT))) AS c
            FROM (SELECT read_id, s, unnest(generate_series(0, length(s) - 8)) AS i FROM {_READS} WHERE length(s) >= 8)) GROUP BY read_id""",
        "fasta_check": "SELECT rec_id, CASE WHEN coalesce(id, '') = '' THEN 'EmptyId' WHEN regexp_matches(coalesce(seq, ''), '[^\\x00-\\x7F]') THEN 'NonAsciiSequence' WHEN regexp_matches(coalesce(seq, ''), '[^A-Za-z\\-.*]') THEN 'InvalidCharacters' END AS reason FROM fasta",
        "fastq_check": "SELECT read_id, CASE WHEN coalesce(id, '') = '' THEN 'EmptyId' WHEN regexp_matches(coalesce(seq, ''), '[^\\x00-\\x7F]') THEN 'NonAsciiSequence' WHEN regexp_matches(coalesce(seq, ''), '[^A-Za-z\\-.*]') THEN 'InvalidCharacters' WHEN regexp_matches(coalesce(qual, ''), '[^\\x00-\\x7F]') THEN 'NonAsciiQuality' WHEN length(coalesce(seq, '')) <> length(coalesce(qual, '')) THEN 'UnequalLengths' END AS reason, coalesce(id, '') = '' AND coalesce(seq, '') = '' AS is_empty FROM fastq",
        "find_exact": _FIND,
        "find_counts": f"SELECT rec_id, CAST(len(list_filter(generate_series(1, length(s) - 2), lambda i: substr(s, i, 3) = 'AAA')) AS BIGINT) AS n, CAST(len(list_filter(generate_series(1, length(s) - 3), lambda i: substr(s, i, 4) = 'ATAT')) AS BIGINT) AS n_atat FROM {_FASTA}",
        "hamming": f"SELECT read_id, CAST(hamming(s, reverse({_TR.format('s')})) AS BIGINT) AS d FROM {_READS}",
        "levenshtein": f"SELECT a_id, levenshtein(a, b) AS d FROM {_PAIR}",
        "bounded_levenshtein": f"SELECT a_id, CASE WHEN levenshtein(a, b) <= 100 THEN levenshtein(a, b) END AS d FROM {_PAIR}",
        "orf": f"""WITH c AS (SELECT rec_id, i, i % 3 AS f, substr(s, i + 1, 3) AS c FROM (SELECT rec_id, s, unnest(generate_series(0, length(s) - 3)) AS i FROM {_FASTA} WHERE length(s) >= 3)),
            n AS (SELECT *, min(CASE WHEN c IN ('TGA', 'TAG', 'TAA') THEN i END) OVER (PARTITION BY rec_id, f ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM c)
            SELECT rec_id, i AS orf_start, stop + 3 AS orf_end, f AS frame FROM n WHERE c = 'ATG' AND stop IS NOT NULL AND stop + 3 - i - 2 > 60""",
        "fasta_text": f"SELECT rec_id, '>' || id || coalesce(' ' || descr, '') || chr(10) || s || chr(10) AS plain, md5('>' || id || coalesce(' ' || descr, '') || chr(10) || regexp_replace(s, '(.{{1,60}})', '\\1' || chr(10), 'g')) AS wrapped_md5 FROM {_FASTA}",
        "fastq_text": f"SELECT read_id, '@' || id || coalesce(' ' || descr, '') || chr(10) || s || chr(10) || '+' || chr(10) || qual || chr(10) AS txt FROM {_READS} WHERE qual IS NOT NULL",
        "fastx_convert": f"SELECT 'fasta' AS kind, id, descr, s, CAST(NULL AS VARCHAR) AS qual FROM {_READS} UNION ALL SELECT 'fastq', id, descr, s, repeat('I', length(s)) FROM {_FASTA}",
        "bed_fields": "SELECT interval_id, aux[1] AS name, aux[2] AS score, CASE WHEN aux[3] IN ('+', '-') THEN aux[3] END AS strand, chrom || chr(9) || start_pos || chr(9) || end_pos || coalesce(list_aggregate(list_transform(aux, lambda x: chr(9) || x), 'string_agg', ''), '') AS line FROM bed",
        "bed_set": "SELECT interval_id, coalesce(aux[1], '') || '|' || coalesce(aux[2], '') || '|-' || coalesce(list_aggregate(list_transform(aux[4:], lambda x: '|' || x), 'string_agg', ''), '') AS strand_set, coalesce(list_aggregate(list_transform(aux, lambda x: x || '|'), 'string_agg', ''), '') || 'x' AS pushed FROM bed",
        "bedpe_fields": "SELECT pair_id, aux[1] AS name, aux[2] AS score, CASE WHEN aux[3] IN ('+', '-') THEN aux[3] END AS strand1, CASE WHEN aux[4] IN ('+', '-') THEN aux[4] END AS strand2 FROM bedpe",
        "gff_fields": "SELECT feature_id, CASE WHEN regexp_full_match(score, '\\+?[0-9]+') THEN TRY_CAST(score AS BIGINT) END AS score_num, CASE WHEN strand IN ('+', '-') THEN strand END AS strand_sign, coalesce(CAST(phase AS VARCHAR), '.') AS phase_txt, replace(replace(replace(replace(replace(attributes, '%', '%25'), ';', '%3B'), '=', '%3D'), '&', '%26'), ',', '%2C') AS encoded FROM gff",
        "located_bed": "SELECT feature_id, concat_ws(chr(9), seqname, start_pos, end_pos, feature_id, '0', sd) AS whole, concat_ws(chr(9), seqname, start_pos, start_pos + 1, feature_id, '0', sd) AS first, concat_ws(chr(9), seqname, start_pos, start_pos + 1, seqname, end_pos - 1, end_pos, feature_id, '0', sd, sd) AS ends FROM (SELECT *, CASE WHEN strand IN ('+', '-') THEN strand ELSE '.' END AS sd FROM gff WHERE seqname IS NOT NULL AND end_pos > start_pos)",
        "spliced_transcripts": f"""WITH {_P4},
            par AS (SELECT DISTINCT feature_id, val FROM p4 WHERE tag IN ('Parent', 'transcript_id')),
            sp AS (SELECT DISTINCT seqname, CASE WHEN strand IN ('+', '-') THEN strand ELSE '.' END AS strand, coalesce(val, 'feature ' || g.feature_id) AS name, start_pos AS s, end_pos AS e FROM gff g LEFT JOIN par ON par.feature_id = g.feature_id WHERE seqname IS NOT NULL AND end_pos > start_pos),
            re AS (SELECT *, max(e) OVER (PARTITION BY seqname, strand, name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp),
            isl AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY seqname, strand, name ORDER BY s, e) AS k FROM re),
            ex AS (SELECT seqname, strand, name, min(s) AS a, max(e) AS b FROM isl GROUP BY seqname, strand, name, k),
            al AS (SELECT *, min(a) OVER (PARTITION BY seqname, strand, name) AS lo FROM ex)
            SELECT seqname, strand, name, concat_ws(chr(9), seqname, lo, max(b), name, '0', strand, lo, max(b), '0', count(*), string_agg((b - a) || ',', '' ORDER BY a), string_agg((a - lo) || ',', '' ORDER BY a)) AS line FROM al GROUP BY seqname, strand, name, lo""",
        "base_at": f"SELECT read_id, substr(s, 1, 1) AS first, nullif(substr(s, length(s) // 2 + 1, 1), '') AS middle, nullif(substr(s, 100, 1), '') AS far, CAST(ascii(nullif(substr(qual, length(s) // 2 + 1, 1), '')) - 33 AS BIGINT) AS q_middle, CAST(ascii(nullif(substr(qual, 100, 1), '')) - 33 AS BIGINT) AS q_far FROM {_READS}",
        "pack_bits": f"SELECT read_id, CAST(ceil(length(s) / 8) AS BIGINT) AS n_blocks, CAST(list_sum(list_transform(range(0, least(8, length(s) - 8)), lambda k: (instr('{ALPHABET.symbols}', s[9 + k]) - 1) * (1::BIGINT << (4 * k)))) AS BIGINT) AS second, md5(s) AS digest FROM {_READS}",
        "rev_qgrams": f"SELECT read_id, {_code('length(s) - 7')} AS last_code, {_code('1')} AS first_code, length(s) - 7 AS n FROM {_READS} WHERE length(s) >= 8",
        "alphabet_sets": f"SELECT rec_id, translate(sym, translate(sym, 'ACGT', ''), '') AS common, translate(sym, 'ACGT', '') AS beyond, list_aggregate(list_sort(list_distinct(list_concat(list_filter(string_split(sym, ''), lambda x: x <> ''), ['A', 'C', 'G', 'T']))), 'string_agg', '') AS either, length(sym) AS n_symbols FROM (SELECT rec_id, coalesce(list_aggregate(list_sort(list_distinct({chars})), 'string_agg', ''), '') AS sym FROM {_FASTA})",
        "trim_newline": "SELECT rec_id, md5(seq) AS one, length(CASE WHEN right(seq, 1) = chr(10) THEN left(seq, length(seq) - 1) ELSE seq END) AS n FROM fasta",
        "validity": "SELECT pair_id, end1 >= start1 AS first_ok, end2 >= start2 AS second_ok FROM bedpe",
        "fai_fetch": f"SELECT rec_id, byte_offset, CAST(byte_offset + (a // line_bases) * line_bytes + a % line_bases AS BIGINT) AS at_byte, substr(s, a + 1, len * 2 // 3 - a) AS part FROM (SELECT DISTINCT rec_id, s, i.*, len // 3 AS a FROM {_FASTA} f JOIN fai i ON f.id = i.name WHERE i.len = length(s))",
        "fai_names": "SELECT i.name, n_claims, max_len, n FROM (SELECT name, count(*) AS n_claims, max(len) AS max_len FROM fai WHERE name IS NOT NULL GROUP BY 1) i LEFT JOIN (SELECT id AS name, length(regexp_replace(seq, '\\s', '', 'g')) AS n FROM fasta) f ON f.name = i.name",
        "interval_keyed": f"SELECT feature_id, interval_id FROM gff g JOIN bed b ON {_OVER}",
        "interval_plain": "SELECT a.pair_id AS a_id, count(*) AS n, min(b.pair_id) AS first_b FROM (SELECT * FROM bedpe WHERE start1 >= 0 AND end1 > start1 AND start2 >= 0 AND end2 > start2) a JOIN (SELECT * FROM bedpe WHERE start1 >= 0 AND end1 > start1 AND start2 >= 0 AND end2 > start2) b ON a.end1 > b.start2 AND a.start1 < b.end2 GROUP BY 1",
        "interval_semi": f"SELECT feature_id FROM gff g WHERE EXISTS (SELECT 1 FROM bed b WHERE {_OVER})",
        "interval_anti": f"SELECT feature_id FROM gff g WHERE NOT EXISTS (SELECT 1 FROM bed b WHERE {_OVER})",
        "interval_points": "SELECT feature_id, count(*) AS n, min(interval_id) AS first_id FROM gff g JOIN bed b ON seqname = chrom AND b.start_pos < g.start_pos AND g.start_pos < b.end_pos GROUP BY 1",
        "interval_hits": f"SELECT g.feature_id, coalesce(n, 0) AS n_hits FROM gff g LEFT JOIN (SELECT feature_id, count(*) AS n FROM gff g JOIN bed b ON {_OVER} GROUP BY 1) h ON h.feature_id = g.feature_id",
        "kmer_counts": f"SELECT g AS gram, count(*) AS n, count(DISTINCT read_id) AS n_records FROM (SELECT read_id, substr(s, i + 1, 8) AS g FROM (SELECT read_id, s, unnest(generate_series(0, length(s) - 8)) AS i FROM {_READS} WHERE length(s) >= 8)) GROUP BY g",
        "kmer_join": f"WITH {_SEEDS} SELECT x_id, y_id, count(*) AS n, min(x) AS x0, min(y) AS y0 FROM hits GROUP BY 1, 2",
        "diagonals": f"WITH {_SEEDS} SELECT x_id, y_id, y - x AS diag, min(x) AS x_start, max(x) + 16 AS x_stop, min(y) AS y_start, max(y) + 16 AS y_stop, count(*) AS n FROM hits GROUP BY 1, 2, 3 HAVING count(*) >= 2",
        "exact_matches": f"WITH {_SEEDS}, isl AS (SELECT *, x - row_number() OVER (PARTITION BY x_id, y_id, y - x ORDER BY x) AS k FROM hits) SELECT x_id, y_id, min(x) AS x_start, max(x) + 16 AS x_stop, min(y) AS y_start, max(y) + 16 AS y_stop FROM isl GROUP BY x_id, y_id, y - x, k",
    }
