import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.sources import formats, text
from strandline.streaming import matcher

FASTA = ">id desc one\nACCGTAGGCTGA\nCCGTAGGCTGAA\n>id2\nATTGTTGTTTTA\n"


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.write_bytes(content.encode())
        return str(p)

    return write


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("last", [True, False])
def test_fasta_both_readers(spark, put, end, last):
    content = FASTA if last else FASTA[:-1]
    p = put("a.fasta", content.replace("\n", end))
    formats.register(spark)
    want = [("id", "desc one", "ACCGTAGGCTGACCGTAGGCTGAA"), ("id2", None, "ATTGTTGTTTTA")]
    assert rows(text.read_fasta(spark, p)) == want
    assert rows(spark.read.format("fasta").load(p)) == want


def test_fasta_errors():
    with pytest.raises(formats.FormatError, match="Expected > at record start"):
        list(formats.parse_fasta(["ACGT\n"]))
    assert list(formats.parse_fasta([])) == []
    assert list(formats.parse_fasta([">\n"])) == [("", None, "")]


def test_fastq(spark, put):
    p = put("a.fastq", "@id desc\nACCG\nTAGG\n+\nIIII\nJJJJ\n@id2\nA\n+id2\n@\n")
    formats.register(spark)
    assert rows(spark.read.format("fastq").load(p)) == [("id", "desc", "ACCGTAGG", "IIIIJJJJ"), ("id2", None, "A", "@")]
    with pytest.raises(formats.FormatError, match="Expected @"):
        list(formats.parse_fastq([">id\n"]))
    with pytest.raises(formats.FormatError, match="Incomplete"):
        list(formats.parse_fastq(["@id\n", "ACGT\n", "+\n"]))


def test_fastx(spark, put):
    formats.register(spark)
    a, b = put("a.x", FASTA), put("b.x", "@r\nAC\n+\nII\n")
    assert [r[0] for r in rows(spark.read.format("fastx").load(a))] == ["fasta", "fasta"]
    assert rows(spark.read.format("fastx").load(b)) == [("fastq", "r", None, "AC", "II")]
    with pytest.raises(EOFError):
        list(formats.parse_fastx([]))
    with pytest.raises(formats.FormatError):
        list(formats.parse_fastx(["x"]))


def test_round_trips(spark, tmp_path):
    formats.register(spark)
    seqs = spark.createDataFrame([("a", "x y", "ACGTACGTAC"), ("b", None, "TTT"), ("c", None, "")], "id string, descr string, seq string")
    out = str(tmp_path / "f")
    seqs.write.format("fasta").option("wrap", 4).mode("append").save(out)
    assert rows(spark.read.format("fasta").load(out)) == rows(seqs)
    text.write_fasta(seqs.filter("seq <> ''"), str(tmp_path / "g"), wrap=3)
    assert rows(text.read_fasta(spark, str(tmp_path / "g"))) == rows(seqs.filter("seq <> ''"))
    reads = spark.createDataFrame([("a", "x", "ACGT", "IIII"), ("b", None, "T", "@")], formats.FASTQ_SCHEMA)
    reads.write.format("fastq").mode("append").save(str(tmp_path / "q"))
    assert rows(spark.read.format("fastq").load(str(tmp_path / "q"))) == rows(reads)
    text.write_fastq(reads, str(tmp_path / "q2"))
    assert rows(spark.read.format("fastq").load(str(tmp_path / "q2"))) == rows(reads)


def test_fai_fetch(spark, put):
    fai = text.read_fai(spark, put("a.fai", "id\t24\t10\t12\t13\nid2\t12\t41\t12\t13\n"))
    seqs = text.read_fasta(spark, put("a.fa", FASTA))
    regions = spark.createDataFrame([("id", 11, 14)], "name string, start bigint, stop bigint")
    r = text.index_fasta(seqs, fai, regions).first()
    assert (r.at_byte, r.seq) == (21, "ACC")
    for bad, why in ((("id", 1, 99), "out of bounds"), (("id", 5, 2), "Invalid query interval")):
        with pytest.raises(Exception, match=why):
            text.index_fasta(seqs, fai, spark.createDataFrame([bad], "name string, start bigint, stop bigint")).collect()


def test_regions_are_read_in_place(spark, put):
    p = put("i.fa", ">one a b\nACGTA\nCGTAC\nGT\n>two\r\nGGG\r\nCC\r\n>none\n\n>last\nTTTT")
    index = text.build_fai(spark, p)
    got = [(r.rid, r.name, r.len, r.byte_offset, r.line_bases, r.line_bytes) for r in index.orderBy("rid").collect()]
    assert got == [(0, "one", 12, 9, 5, 6), (1, "two", 5, 30, 3, 5), (2, "none", 0, 45, 0, 0), (3, "last", 4, 52, 4, 4)]
    regions = [("one", 4, 11), ("one", None, None), ("one", 5, 10), ("two", 2, 4), ("two", 0, 5), ("none", None, None), ("last", 1, 4), ("last", 4, 4)]
    df = spark.createDataFrame(regions, "name string, start bigint, stop bigint")
    want = {"one": "ACGTACGTACGT", "two": "GGGCC", "none": "", "last": "TTTT"}
    assert {(r.name, r.start, r.stop): r.seq for r in text.fetch_regions(index, df).collect()} == {(n, a, z): want[n][a or 0 : len(want[n]) if z is None else z] for n, a, z in regions}
    by_number = text.fetch_regions(index, spark.createDataFrame([(1, 1, 3)], "rid bigint, start bigint, stop bigint"), "rid").first()
    assert by_number.seq == "GG"
    for bad, why in ((("one", 0, 13), "beyond"), (("one", 3, 2), "before"), (("x", 0, 1), "no such")):
        with pytest.raises(Exception, match=why):
            text.fetch_regions(index, spark.createDataFrame([bad], df.schema)).collect()
    with pytest.raises(Exception, match="different length"):
        text.build_fai(spark, put("u.fa", ">a\nAC\nACG\n")).collect()


def test_bed(spark, put, tmp_path):
    b = text.read_bed(spark, put("a.bed", "#c\n1\t5\t5000\tname1\tup\n2\t3\t5005\r\n"), extra=[("name", "string")])
    assert rows(b) == [("1", 5, 5000, ["name1", "up"], "name1"), ("2", 3, 5005, [], None)]
    text.write_bed(b, str(tmp_path / "b"))
    assert rows(text.read_bed(spark, str(tmp_path / "b"))) == [("1", 5, 5000, ["name1", "up"]), ("2", 3, 5005, [])]
    p = text.read_bedpe(spark, put("a.bedpe", "1\t5\t50\t2\t7\t90\tn\t3\t+\t-\n"))
    assert rows(p) == [("1", 5, 50, "2", 7, 90, ["n", "3", "+", "-"])]
    text.write_bedpe(p, str(tmp_path / "p"))
    assert rows(text.read_bedpe(spark, str(tmp_path / "p"))) == rows(p)


def test_gff(spark, put, tmp_path):
    g = text.read_gff(spark, put("a.gff", "##x\nP0A\tUni\tInit\t1\t1\t.\t.\t.\tNote=Removed,Obsolete;ID=test%2Cx\n"))
    r = g.first()
    assert (r.seqname, r.start_pos, r.score, r.phase, r.attributes) == ("P0A", 1, ".", None, {"Note": ["Removed", "Obsolete"], "ID": ["test,x"]})
    text.write_gff(g, str(tmp_path / "g"))
    assert text.read_gff(spark, str(tmp_path / "g")).first() == r
    t = text.read_gff(spark, put("a.gtf", 'c1\ths\texon\t11869\t12227\t0.5\t+\t2\tgene_id "G1"; tag "a"; tag "b";\n'), "gtf2").first()
    assert t.attributes == {"gene_id": ["G1"], "tag": ["a", "b"]} and t.phase == 2
    with pytest.raises(ValueError):
        text.read_gff(spark, "x", "gff9")
    with pytest.raises(Exception, match="invalid phase"):
        text.read_gff(spark, put("b.gff", "a\tb\tc\t1\t2\t.\t.\t7\tx=1\n")).collect()


def test_newick(spark):
    df = spark.createDataFrame([(1, "(A:0.1,B:0.2,(C:0.3,D:0.4)E:0.5)F;"), (2, "(,(,));"), (3, None)], "t int, s string")
    got = {(r.id, r.node_id): (r.name, r.parent, r.weight) for r in text.read_newick(df, "t", "s").collect()}
    assert got[1, 0] == ("F", None, None)
    by = {v[0]: (v[1], round(v[2], 3)) for k, v in got.items() if k[0] == 1 and v[1] is not None}
    e = next(k[1] for k, v in got.items() if v[0] == "E")
    assert by == {"A": (0, 0.1), "B": (0, 0.2), "C": (e, 0.3), "D": (e, 0.4), "E": (0, 0.5)}
    assert got[2, 0][0] == "N/A" and got[2, 1][2] != got[2, 1][2]
    for bad in ("(A,B", "A,B;", "A);"):
        with pytest.raises(ValueError):
            text.parse_newick(bad)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.fasta").write_text(FASTA)
    q = matcher.stream_fasta(spark, str(src)).writeStream.format("memory").queryName("fa").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from fa").first()[0] == 2
    formats.register(spark)
    q = spark.readStream.format("fasta").load(str(src)).writeStream.format("memory").queryName("fb").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from fb").first()[0] == 2
    chunks = tmp_path / "chunks"
    chunks.mkdir()
    for i, c in enumerate(["GATT", "ACAGAT", "TACA"]):
        (chunks / f"{i}.json").write_text(f'{{"k": "x", "o": {i}, "c": "{c}"}}\n')
        os.utime(chunks / f"{i}.json", (1000 + i, 1000 + i))
    s = spark.readStream.schema("k string, o int, c string").option("maxFilesPerTrigger", 1).json(str(chunks))
    q = matcher.find_in_chunks(s, "k", "o", "c", "GATTACA").writeStream.format("memory").queryName("fc").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert sorted(r.pos for r in spark.sql("select pos from fc").collect()) == [0, 7]


def test_fastq_splits_meet_at_record_borders(spark, tmp_path):
    rng = random.Random(8)
    records = []
    for i in range(300):
        n = rng.randint(1, 40)
        records.append((f"r{i}", rng.choice([None, "x y", ""]), "".join(rng.choice("ACGT") for _ in range(n)), rng.choice("@+I") + "".join(rng.choice("@+I!~") for _ in range(n - 1))))
    text_ = "".join(formats.fastq_record(*r) for r in records)
    formats.register(spark)
    for name, content in (("a", text_), ("b", text_[:-1]), ("c", text_.replace("\n", "\r\n")), ("d", text_ + "\n\n")):
        p = tmp_path / f"{name}.fastq"
        p.write_bytes(content.encode())
        for split in (37, 1000, 10**6):
            df = spark.read.format("fastq").option("split", split).load(str(p))
            assert rows(df) == sorted(records, key=str), (name, split)
    both = spark.read.format("fastx").option("split", 500).load(str(tmp_path))
    assert rows(both.filter("kind = 'fastq'").drop("kind")) == sorted(records * 4, key=str)
    assert df.rdd.getNumPartitions() == 1 and spark.read.format("fastq").option("split", 1000).load(str(p)).rdd.getNumPartitions() > 10
    (tmp_path / "bad.fastq").write_text("@a\nAC\n+\nII\n@b\nAC\n")
    with pytest.raises(Exception, match="Incomplete"):
        spark.read.format("fastq").load(str(tmp_path / "bad.fastq")).collect()


def test_sinks_lose_nothing(spark, tmp_path):
    bed = spark.createDataFrame([(None, 1, 2, ["n"]), ("c", 3, None, None)], "chrom string, start_pos bigint, end_pos bigint, aux array<string>")
    text.write_bed(bed, str(tmp_path / "b"))
    assert rows(text.read_bed(spark, str(tmp_path / "b"))) == [(".", 1, 2, ["n"]), ("c", 3, -1, [])]
    pe = spark.createDataFrame([(None, None, 5, "d", 1, None, ["n"])], "chrom1 string, start1 bigint, end1 bigint, chrom2 string, start2 bigint, end2 bigint, aux array<string>")
    text.write_bedpe(pe, str(tmp_path / "p"))
    assert rows(text.read_bedpe(spark, str(tmp_path / "p"))) == rows(pe)
    gff = spark.createDataFrame([(None, None, None, 1, 2, None, None, None, None)], "seqname string, source string, feature_type string, start_pos bigint, end_pos bigint, score string, strand string, phase tinyint, attributes map<string,array<string>>")
    text.write_gff(gff, str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).first()[0] == ".\t.\t.\t1\t2\t.\t.\t.\t."
    own = gff.withColumn("attributes", F.expr("map('k', array('a b', 'c'), 'l', array('d'))"))
    text.write_gff(own, str(tmp_path / "h"), (":", "|", "+"))
    assert spark.read.text(str(tmp_path / "h")).first()[0].endswith('k:"a b"+"c"|l:"d"')
    assert text.read_gff(spark, str(tmp_path / "h"), (":", "|", "+")).first().attributes == {"k": ["a b", "c"], "l": ["d"]}
    formats.register(spark)
    for bad, write in ((spark.createDataFrame([("a", None, None)], formats.FASTA_SCHEMA), lambda d: text.write_fasta(d, str(tmp_path / "x2"))), (spark.createDataFrame([("a", None, None)], formats.FASTA_SCHEMA), lambda d: d.write.format("fasta").mode("append").save(str(tmp_path / "x3")))):
        with pytest.raises(Exception, match="needs"):
            write(bad)


def test_overwriting_waits_for_success(spark, tmp_path):
    formats.register(spark)
    out = str(tmp_path / "o")
    one = spark.createDataFrame([("a", None, "AC")], formats.FASTA_SCHEMA)
    one.write.format("fasta").mode("append").save(out)
    with pytest.raises(Exception, match="needs"):
        spark.createDataFrame([("b", None, None)], formats.FASTA_SCHEMA).write.format("fasta").mode("overwrite").save(out)
    assert rows(spark.read.format("fasta").load(out)) == rows(one)
    two = spark.createDataFrame([("b", None, "GG")], formats.FASTA_SCHEMA)
    two.write.format("fasta").mode("overwrite").save(out)
    assert rows(spark.read.format("fasta").load(out)) == rows(two)
    assert not [n for n in os.listdir(out) if n.startswith("_")]


def test_files_that_arrive_out_of_order(spark, tmp_path):
    formats.register(spark)
    src, mark = tmp_path / "in", str(tmp_path / "mark")
    src.mkdir()
    seen = []

    def take():
        q = spark.readStream.format("fasta").load(str(src)).writeStream.foreachBatch(lambda df, _: seen.extend(r.id for r in df.collect())).trigger(availableNow=True).option("checkpointLocation", mark).start()
        q.awaitTermination()

    (src / "b.fa").write_text(">b\nAC\n")
    take()
    (src / "a.fa").write_text(">a\nAC\n")
    take()
    assert seen == ["b", "a"]
