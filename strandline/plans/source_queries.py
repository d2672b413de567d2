"""Queries that write a table in a format to the shared folder and read it back; with oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans.sequence_queries import _FASTA, _READS, fasta, reads
from strandline.session import checkpoint_root, materialize, table
from strandline.sources import formats, text


def _path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source_fasta(spark, d):
    path = _path(spark, "fasta")
    text.write_fasta(fasta(spark, d).select("id", "descr", F.col("s").alias("seq")).filter("seq <> ''"), path, wrap=60)
    return text.read_fasta(spark, path)


def source_fasta_reader(spark, d):
    """The same through the data source."""
    formats.register(spark)
    path = _path(spark, "fasta")
    fasta(spark, d).select("id", "descr", F.col("s").alias("seq")).write.format("fasta").option("wrap", 70).mode("append").save(path)
    return spark.read.format("fasta").load(path)


def source_fastq(spark, d):
    formats.register(spark)
    path = _path(spark, "fastq")
    reads(spark, d).filter("length(qual) = length(s) and s <> ''").select("id", "descr", F.col("s").alias("seq"), "qual").write.format("fastq").mode("append").save(path)
    return spark.read.format("fastq").load(path)


def source_fastx(spark, d):
    formats.register(spark)
    path = _path(spark, "fastx")
    text.write_fastq(reads(spark, d).filter("length(qual) = length(s) and s <> ''").select("id", "descr", F.col("s").alias("seq"), "qual"), path)
    return spark.read.format("fastx").load(path)


def source_bed(spark, d):
    path = _path(spark, "bed")
    text.write_bed(table(spark, d, "bed"), path)
    return text.read_bed(spark, path, extra=[("name", "string")]).select("chrom", "start_pos", "end_pos", F.array_join("aux", "|").alias("aux"), "name")


def source_bedpe(spark, d):
    path = _path(spark, "bedpe")
    text.write_bedpe(table(spark, d, "bedpe"), path)
    return text.read_bedpe(spark, path).withColumn("aux", F.array_join("aux", "|"))


def source_gff(spark, d):
    """The table as GFF3 with two attributes of its own, read back with every value."""
    path = _path(spark, "gff")
    attrs = F.create_map(F.lit("ID"), F.array(F.col("feature_id").cast("string")), F.lit("Note"), F.array(F.coalesce("attributes", F.lit("none")), F.coalesce("seqname", F.lit("no name"))))
    text.write_gff(table(spark, d, "gff").withColumn("attributes", attrs), path)
    r = text.read_gff(spark, path)
    return r.select("seqname", "source", "feature_type", "start_pos", "end_pos", "score", "strand", F.col("phase").cast("int").alias("phase"), F.col("attributes")["ID"][0].cast("bigint").alias("feature_id"), F.col("attributes")["Note"][0].alias("note"), F.col("attributes")["Note"][1].alias("name"))


def source_gff_custom(spark, d):
    """Attributes with separators of their own: ``:`` after a key, ``/`` between attributes, ``+`` between values."""
    path = _path(spark, "gff-own")
    own = (":", "/", "+")
    attrs = F.create_map(F.lit("id"), F.array(F.col("feature_id").cast("string")), F.lit("span"), F.array(F.col("start_pos").cast("string"), F.col("end_pos").cast("string")))
    text.write_gff(table(spark, d, "gff").withColumn("attributes", attrs), path, own)
    r = text.read_gff(spark, path, own)
    return r.select(F.col("attributes")["id"][0].cast("bigint").alias("feature_id"), F.array_join(F.col("attributes")["span"], "-").alias("span"))


def source_fetch(spark, d):
    """The middle third of each record, read at its place in the files by an index of them, and all of the empty ones."""
    path = _path(spark, "fetch")
    text.write_fasta(fasta(spark, d).select("id", "descr", F.col("s").alias("seq")), path, wrap=50)
    index = materialize(text.build_fai(spark, path), "fai")
    third = F.floor(F.col("len") / 3)
    regions = index.select("name", F.when(F.col("len") > 0, third).alias("start"), F.when(F.col("len") > 0, F.col("len") - third).alias("stop"))
    return text.fetch_regions(index, regions).select("name", "start", "stop", "seq")


def source_fai(spark, d):
    """The index as a text file, read back."""
    path = _path(spark, "fai")
    i = table(spark, d, "fai").select("name", "len", "byte_offset", "line_bases", "line_bytes")
    i.write.csv(path, sep="\t")
    return text.read_fai(spark, path)


def source_newick(spark, d):
    """One tree per region, its nations as leaves."""
    leaf = F.concat("n_name", F.lit(":"), (F.col("n_nationkey") / 4).cast("string"))
    trees = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.concat_ws(",", F.sort_array(F.collect_list(leaf))).alias("leaves"))
    trees = trees.select("r_regionkey", F.concat(F.lit("("), "leaves", F.lit(")"), "r_name", F.lit(";")).alias("t"))
    n = text.read_newick(trees, "r_regionkey", "t")
    return n.select(F.col("id").alias("r_regionkey"), F.col("name").alias("node"), F.col("parent").isNull().alias("is_root"), F.round(F.col("weight").cast("double"), 4).alias("weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (source_fasta, source_fasta_reader, source_fastq, source_fastx, source_bed, source_bedpe, source_gff, source_gff_custom, source_fetch, source_fai, source_newick)}


def oracle_sql() -> dict[str, str]:
    fastq = f"FROM {_READS} WHERE length(qual) = length(s) AND s <> ''"
    return {
        "source_fasta": f"SELECT id, descr, s AS seq FROM {_FASTA} WHERE s <> ''",
        "source_fasta_reader": f"SELECT id, descr, s AS seq FROM {_FASTA}",
        "source_fastq": f"SELECT id, descr, s AS seq, qual {fastq}",
        "source_fastx": f"SELECT 'fastq' AS kind, id, descr, s AS seq, qual {fastq}",
        "source_bed": "SELECT coalesce(chrom, '.') AS chrom, coalesce(start_pos, -1) AS start_pos, coalesce(end_pos, -1) AS end_pos, coalesce(list_aggregate(aux, 'string_agg', '|'), '') AS aux, aux[1] AS name FROM bed",
        "source_bedpe": "SELECT nullif(chrom1, '.') AS chrom1, nullif(start1, -1) AS start1, nullif(end1, -1) AS end1, nullif(chrom2, '.') AS chrom2, nullif(start2, -1) AS start2, nullif(end2, -1) AS end2, coalesce(list_aggregate(aux, 'string_agg', '|'), '') AS aux FROM bedpe",
        "source_gff": "SELECT coalesce(seqname, '.') AS seqname, coalesce(source, '.') AS source, coalesce(feature_type, '.') AS feature_type, start_pos, end_pos, coalesce(score, '.') AS score, coalesce(strand, '.') AS strand, CAST(phase AS INT) AS phase, feature_id, coalesce(attributes, 'none') AS note, coalesce(seqname, 'no name') AS name FROM gff",
        "source_gff_custom": "SELECT feature_id, start_pos || '-' || end_pos AS span FROM gff",
        "source_fetch": f"SELECT id AS name, CASE WHEN s <> '' THEN length(s) // 3 END AS start, CASE WHEN s <> '' THEN length(s) - length(s) // 3 END AS stop, substr(s, length(s) // 3 + 1, length(s) - 2 * (length(s) // 3)) AS seq FROM {_FASTA}",
        "source_fai": "SELECT name, len, byte_offset, line_bases, line_bytes FROM fai",
        "source_newick": "SELECT r_regionkey, n_name AS node, FALSE AS is_root, round(n_nationkey / 4, 4) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, r_name, TRUE, NULL FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
    }
