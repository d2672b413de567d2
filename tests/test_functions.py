"""Known values of the column functions and relational operators."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import alphabets as al
from strandline.functions import checks, prob, records, search, seqstats
from strandline.operators import bayes, intervals, motif, prefix, qgrams


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first().x


def test_alphabets(spark):
    assert one(spark, al.dna_revcomp("s"), s="ACGTN") == "NACGT"
    assert one(spark, al.dna_revcomp("s"), s="GaTtaCA") == "TGtaAtC"
    assert one(spark, al.dna_revcomp("s"), s="AGCTYRWSKMDVHBN") == "NVDBHKMSWYRAGCT"
    assert one(spark, al.rna_complement("s"), s="AUzX") == "UAzX"
    a = al.Alphabet(al.DNA)
    assert one(spark, al.ranks("s", a), s="aAcCgGtT") == [4, 0, 5, 1, 6, 2, 7, 3]
    assert one(spark, al.qgrams("s", 2, a), s="ACGT") == [1, 10, 19]
    assert one(spark, al.rev_qgrams("s", 2, a), s="ACGT") == [19, 10, 1]
    assert one(spark, al.from_ranks(al.ranks("s", a), a), s="GATTACA") == "GATTACA"
    assert one(spark, al.qgrams("s", 5, a), s="ACGT") == [] and one(spark, al.kmers("s", 2), s="A") == []
    assert one(spark, al.qgrams("s", 2, al.Alphabet(al.PROTEIN_IUPAC)), s="ARN") is not None
    with pytest.raises(Exception, match="outside the alphabet"):
        one(spark, al.qgrams("s", 2, a), s="AXG")
    assert one(spark, al.is_word("s", al.PROTEIN), s="PRSkl") and not one(spark, al.is_word("s", al.PROTEIN), s="Bb") and one(spark, al.is_word("s", "A"), s="")
    x, y = al.Alphabet("acgt"), al.Alphabet("cgx")
    assert x.intersection(y).symbols == "cg" and x.difference(y).symbols == "at" and x.union(y).symbols == "acgtx"
    assert x.insert("b").symbols == "abcgt" and x.max_symbol() == "t" and len(al.Alphabet()) == 0 and x == al.Alphabet("tgca")
    packed = al.pack_bits(F.array(*map(F.lit, [0, 2, 1, 3, 7, 5, 6, 4, 1, 2, 3])), 3)
    assert one(spark, al.unpack_bits(packed, 3, F.lit(11))) == [0, 2, 1, 3, 7, 5, 6, 4, 1, 2, 3]


def test_sequence_statistics(spark):
    assert one(spark, seqstats.gc_content("s"), s="GATATACA") == pytest.approx(2 / 8)
    assert one(spark, seqstats.gc3_content("s"), s="GATATACA") == pytest.approx(2 / 3)
    assert math.isnan(one(spark, seqstats.gc_content("s"), s=""))
    cases = {"GGGATGGGGTGAGGG": {(3, 12, 0)}, "ATGGGGATGGGGGGATGGAAAAATAAGTAG": {(14, 26, 2), (0, 30, 0), (6, 30, 0)}, "ATG": set(), "": set()}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {k: set() for k in cases}
    for r in seqstats.find_orfs(df, "s", "s", min_len=5).collect():
        got[r.id].add((r.start, r.end, r.offset))
    assert got == cases


@pytest.mark.parametrize("text,pattern,want", [("aaaaabbabbbbbbbabbab", "abbab", [4, 15]), ("ACGGCTAGGAAAAAGACTGAGGACTGAAAA", "GAAAA", [8, 25]), ("dhjalkjwqnnnannanaflkjdklfj", "qnnnannan", [8]), ("aaaa", "aa", [0, 1, 2]), ("", "a", []), ("a", "aa", []), ("a.b", ".", [1]), ("x" * 3000, "xx", list(range(2999)))])
def test_exact_search(spark, text, pattern, want):
    assert one(spark, search.find_all("t", pattern), t=text) == want
    assert one(spark, search.find_all("t", F.col("p")), t=text, p=pattern) == want
    assert one(spark, search.count_all("t", pattern), t=text) == len(want)


def test_empty_pattern():
    with pytest.raises(ValueError):
        search.find_all("t", "")


def test_distances(spark):
    assert one(spark, search.hamming("a", "b"), a="GTCTGCATGCG", b="TTTAGCTAGCG") == 5
    with pytest.raises(Exception, match="unequal"):
        one(spark, search.hamming("a", "b"), a="GT", b="TTT")
    assert one(spark, search.levenshtein("a", "b"), a="ACCGTGGAT", b="AAAAACCGTTGAT") == 5
    assert one(spark, search.bounded_levenshtein("a", "b", 5), a="ACCGTGGAT", b="AAAAACCGTTGAT") == 5
    assert one(spark, search.bounded_levenshtein("a", "b", 4), a="ACCGTGGAT", b="AAAAACCGTTGAT") is None


def test_checks(spark):
    def fasta(i, s):
        return one(spark, checks.fasta_check("i", "s"), i=i, s=s)

    assert fasta("", "A") == "EmptyId" and fasta("i", "Prüfung") == "NonAsciiSequence" and fasta("i", "AC 1") == "InvalidCharacters" and fasta("i", "AC-.*") is None
    assert one(spark, checks.fastq_check("i", "s", "q"), i="i", s="AC", q="I") == "UnequalLengths"
    assert one(spark, checks.fastq_check("i", "s", "q"), i="i", s="AC", q="Ié") == "NonAsciiQuality"
    assert one(spark, checks.checked_prob(F.lit(0.5))) == 0.5
    with pytest.raises(Exception, match="invalid probability"):
        one(spark, checks.checked_prob(F.lit(1.5)))
    with pytest.raises(Exception, match="invalid interval"):
        one(spark, checks.checked_interval(F.lit(5).cast("bigint"), F.lit(2).cast("bigint")))
    assert one(spark, checks.valid_ln_prob(F.lit(0.0))) and not one(spark, checks.valid_ln_prob(F.lit(float("nan"))))


def test_records(spark):
    assert one(spark, records.trim_newline("s"), s="abc\n") == "abc" and one(spark, records.trim_newline("s"), s="abc") == "abc"
    exons = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 20), (30, 45), (60, 61))])
    bed = records.spliced_to_bed12(F.lit("chrI"), exons, F.lit("-"), F.lit("n"))
    line = records.bed_text(bed["chrom"], bed["start"], bed["end"], aux=bed["aux"])
    assert one(spark, line) == "chrI\t10\t61\tn\t0\t-\t10\t61\t0\t3\t10,15,1,\t0,20,50,"
    assert one(spark, records.gff_score("s"), s="0.5") is None and one(spark, records.gff_score("s"), s="50") == 50
    assert one(spark, records.gff3_encode("s"), s="a;b=c d%\t") == "a%3Bb%3Dc d%25%09"
    assert one(spark, records.trim_quotes("s"), s="\"'x\"") == "x"
    assert one(spark, records.set_aux(F.array(F.lit("a")), 5, 3, F.lit("+"))) == ["a", "", "+"]
    assert one(spark, records.point_to_bed(F.lit("c"), F.lit(5), F.lit("+"), F.lit("n"))).end == 6
    with pytest.raises(Exception, match="invalid phase"):
        one(spark, records.parse_phase("s"), s="5")
    with pytest.raises(Exception, match="neither"):
        one(spark, records.fastx_kind("s"), s="x")


def test_probabilities(spark):
    assert one(spark, prob.ln_add_exp(F.lit(math.log(0.2)), F.lit(math.log(0.3)))) == pytest.approx(math.log(0.5))
    assert one(spark, prob.ln_add_exp(F.lit(prob.NEG_INF), F.lit(-1.0))) == -1.0
    assert one(spark, prob.ln_sub_exp(F.lit(math.log(0.5)), F.lit(math.log(0.2)))) == pytest.approx(math.log(0.3))
    assert one(spark, prob.ln_sub_exp(F.lit(-1.0), F.lit(-1.0))) == prob.NEG_INF
    with pytest.raises(Exception, match="exceeds the minuend"):
        one(spark, prob.ln_sub_exp(F.lit(-2.0), F.lit(-1.0)))
    assert one(spark, prob.ln_one_minus_exp(F.lit(-0.1))) == pytest.approx(math.log(1 - math.exp(-0.1)))
    assert one(spark, prob.prob_to_phred(F.lit(0.001))) == pytest.approx(30) and one(spark, prob.phred_to_prob(F.lit(20.0))) == pytest.approx(0.01)
    assert one(spark, prob.combinations(F.lit(5.0), F.lit(3.0))) == 10 and one(spark, prob.combinations(F.lit(5.0), F.lit(3.0), 0.5)) == 5
    assert one(spark, prob.combinations_with_repetition(F.lit(5.0), F.lit(3.0))) == 35
    assert one(spark, prob.kass_raftery(F.lit(151.0))) == "VeryStrong" and one(spark, prob.kass_raftery(F.lit(3.0))) == "Barely"
    big = spark.createDataFrame([("a", 1000.0), ("a", 1000.0), ("b", prob.NEG_INF)], "k string, x double")
    got = {r.k: r.ln_sum for r in prob.ln_sum_exp(big, ["k"], "x").collect()}
    assert got["a"] == pytest.approx(1000 + math.log(2)) and got["b"] == prob.NEG_INF
    for rule in ("trapezoid", "simpson"):
        area = prob.integrate(spark, lambda x: F.log(x), 1.0, 3.0, 101, rule).first().ln_integral
        assert area == pytest.approx(math.log(4), abs=1e-4)
    with pytest.raises(ValueError):
        prob.integrate(spark, lambda x: x, 0.0, 1.0, 100, "simpson")
    assert one(spark, prob.tabulated(lambda x: x * 2, 0.0, 1.0, 0.1)(F.lit(0.25))) == pytest.approx(0.5)


def test_fdr(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.0), (2, 0.25)], "i int, pep double")
    got = {r.i: r.fdr for r in prob.expected_fdr(df, ["i"], "pep").collect()}
    assert got == pytest.approx({0: 0.05, 1: 0.0, 2: 0.35 / 3})
    many = spark.range(1000).select(F.col("id").alias("i"), (F.pmod(F.col("id") * 37, F.lit(101)) / 101).alias("pep"))
    rows = sorted((r.pep, r.i) for r in many.collect())
    want, total = {}, 0.0
    for k, (p, i) in enumerate(rows, 1):
        total += p
        want[i] = min(1.0, total / k)
    assert {r.i: r.fdr for r in prob.expected_fdr(many, ["i"], "pep").collect()} == pytest.approx(want)


def test_cdf(spark):
    df = spark.createDataFrame([("d", float(v), 0.1) for v in (0, 0, 1, 2, 3, 4, 5, 6, 7, 8)], "d string, v double, p double")
    c = prob.cdf(df, ["d"], "v", "p")
    assert {r.v: r.cdf for r in c.collect()}[1.0] == pytest.approx(0.3)
    ci = prob.credible_interval(c, ["d"], "v", 0.95).first()
    assert (ci.lower, ci.upper) == (0, 8)
    m = prob.cdf_moments(c, ["d"], "v").first()
    assert m.total == pytest.approx(1) and m.map_value == 0 and m.mean == pytest.approx(3.6)
    probes = spark.createDataFrame([(-1.0,), (0.5,), (99.0,)], "q double")
    assert {r.q: r.p for r in prob.cdf_get(c.drop("d"), probes, "v", "q").collect()} == pytest.approx({-1.0: 0, 0.5: 0.2, 99.0: 1})
    assert prob.cdf_sample(c, ["d"], "v", 3).count() == 3


def test_bayes(spark):
    prior = spark.createDataFrame([("h1", math.log(0.5)), ("h2", math.log(0.5)), ("h3", prob.NEG_INF)], "e string, ln_prior double")
    like = spark.createDataFrame([("x", "h1", math.log(0.9)), ("x", "h2", math.log(0.1)), ("x", "h3", 0.0)], "d string, e string, ln_likelihood double")
    post = bayes.posterior(prior, like, "e", "d")
    assert {r.e: math.exp(r.ln_posterior) for r in post.collect()} == pytest.approx({"h1": 0.9, "h2": 0.1, "h3": 0})
    assert bayes.maximum_posterior(post, "e", "d").first().e == "h1"


def test_prefix(spark):
    arr = F.array(*map(F.lit, [1, 2, 3]))
    assert one(spark, prefix.scan(arr, lambda a, x: a + x)) == [1, 3, 6]
    assert one(spark, prefix.scan(arr, lambda a, x: a + x, F.lit(0))) == [0, 1, 3]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([0, 1, 1, 0, 1])], "i int, b int").withColumn("bit", F.col("b") == 1)
    r = {x.i: (x.rank1, x.rank0) for x in prefix.bit_ranks(df, "i", "bit").collect()}
    assert r == {0: (0, 1), 1: (1, 1), 2: (2, 1), 3: (2, 2), 4: (3, 2)}
    assert {x.j: x.i for x in prefix.bit_select(prefix.bit_ranks(df, "i", "bit"), "i", "bit").collect()} == {1: 1, 2: 2, 3: 4}


def test_motifs(spark):
    def matrix(*seqs, **k):
        return motif.weight_matrix(spark.createDataFrame([("m", s) for s in seqs], "m string, s string"), "m", "s", **k)

    assert all(r.weight == pytest.approx(0.25) for r in matrix("AAAA", "TTTT", "GGGG", "CCCC").collect())
    zero = {m: 0.0 for m in motif.DNA_MONOS}
    assert motif.information(matrix("AAAA", pseudos=zero)).first().bits == pytest.approx(8)
    assert motif.consensus(matrix("AAACCG", "CGTGTT", pseudos=zero)).first().consensus == "MRWSYK"
    assert motif.consensus(matrix("AAAC", "CCGG", "GTTT", pseudos=zero)).first().consensus == "VHDB"
    texts = spark.createDataFrame([(1, "GGGGATGCGGGG")], "i int, s string")
    best = motif.best_window(texts, "i", "s", matrix("ATGC")).first()
    assert best.loc == 4 and best.score == pytest.approx(1)
    for bad, why in ((("AAAAXAAA",), "invalid monomer"), (("AA", "AAA"), "inconsistent")):
        with pytest.raises(Exception, match=why):
            matrix(*bad).collect()
    with pytest.raises(Exception, match="shorter"):
        motif.best_window(spark.createDataFrame([(1, "AT")], "i int, s string"), "i", "s", matrix("ATGC")).collect()


def test_interval_joins(spark):
    import random

    rng = random.Random(3)
    a = [(i, rng.choice("xy"), s := rng.randint(-500, 5000), s + rng.choice([0, 1, 30, 4000])) for i in range(150)]
    b = [(i, rng.choice("xy"), s := rng.randint(-500, 5000), s + rng.choice([0, 1, 30, 300])) for i in range(150)]
    l = spark.createDataFrame(a, "i int, k string, s bigint, e bigint")
    r = spark.createDataFrame(b, "j int, kk string, t bigint, u bigint")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[3] > y[2] and x[2] < y[3])
    for levels in (1, 3):
        got = intervals.interval_join(l, r, ("s", "e"), ("t", "u"), [("k", "kk")], 16, levels)
        assert sorted((x.i, x.j) for x in got.collect()) == want
    semi = intervals.interval_join(l, r, ("s", "e"), ("t", "u"), [("k", "kk")], 64, how="left_semi")
    assert sorted(x.i for x in semi.collect()) == sorted({i for i, _ in want})


def test_qgram_matches(spark):
    x = spark.createDataFrame([(1, "GCTG")], "id int, seq string")
    y = spark.createDataFrame([(2, "ACGGCTGAGATGAT")], "id int, seq string")
    m = {(r.x_start, r.x_stop, r.y_start, r.y_stop, r.n) for r in qgrams.diagonal_matches(qgrams.kmer_matches(x, y, 3), 3, 1).collect()}
    assert (0, 4, 3, 7, 2) in m
    z = spark.createDataFrame([(3, "GCTAAGA")], "id int, seq string")
    e = {(r.x_start, r.x_stop, r.y_start, r.y_stop) for r in qgrams.exact_matches(qgrams.kmer_matches(z, y, 3), 3).collect()}
    assert e == {(0, 3, 4, 7), (4, 7, 7, 10)} or (4, 7, 7, 10) in e


def test_logs_of_any_size(spark):
    import numpy as np

    data = [("a", -800.0), ("a", -801.0), ("b", -5.0), ("b", -900.0), ("c", prob.NEG_INF), ("d", None), ("e", 700.0), ("e", 1100.0), (None, -3.0), ("f", float("inf")), ("f", 0.0)]
    df = spark.createDataFrame([(k, x, 1) for k, x in data], "k string, x double, __n int")
    got = {r.k: r.ln_sum for r in prob.ln_sum_exp(df, ["k"], "x").collect()}
    want = {k: np.logaddexp.reduce([x for j, x in data if j == k and x is not None], initial=-np.inf) for k in {j for j, _ in data}}
    assert got == pytest.approx(want)
    assert prob.ln_sum_exp(df.limit(0), [], "x").first().ln_sum == prob.NEG_INF
    rows = [(i % 3, i, -1000.0 + (i * 37 % 50) if i % 7 else None) for i in range(500)]
    run = prob.ln_cumsum_exp(spark.createDataFrame(rows, "k int, i int, x double"), ["k"], ["i"], "x")
    by = {r.i: r.ln_cum for r in run.collect()}
    for k in range(3):
        total = -np.inf
        for _, i, x in (r for r in rows if r[0] == k):
            total = total if x is None else np.logaddexp(total, x)
            assert by[i] is None if x is None else by[i] == pytest.approx(total)
    scanned = prob.scan_rows(spark.createDataFrame([(1, 12.0), (2, 18.0), (3, 4.0)], "i int, v double"), [], ["i"], "v", lambda a, b: math.gcd(int(a), int(b)))
    assert [r.scan for r in scanned.orderBy("i").collect()] == [12.0, 6.0, 2.0]


def test_masses_beyond_one(spark):
    ok = spark.createDataFrame([(1, 0.5), (2, 0.500001)], "v int, p double")
    assert [r.cdf for r in prob.cdf(ok, [], "v", "p").orderBy("v").collect()] == [0.5, 1.0]
    with pytest.raises(Exception, match="above 1"):
        prob.cdf(spark.createDataFrame([(1, 0.9), (2, 0.9)], "v int, p double"), [], "v", "p").collect()
    c = prob.cdf(spark.createDataFrame([(1, 0.25), (3, 0.5)], "v int, p double"), [], "v", "p")
    probes = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "at double")
    assert {r["at"]: r.p for r in prob.cdf_get_pmf(c, probes, "v", "at").collect()} == {0.0: 0.0, 1.0: 0.25, 2.0: 0.25, 3.0: 0.5}


def test_many_hits_and_overlaps(spark):
    import re
    import time

    for t, p in (("A" * 5000, "AA"), ("ab" * 3000 + "é😀" * 600, "bab"), ("x" * 511 + "yx" * 400, "xyx"), ("\n" * 2000, "\n"), ("a\\Eb\\E a\\Eb\\E", "\\Eb\\E"), ("x.y+x.y", "x.y"), ("$(^$(", "$(")):
        want = [m.start() for m in re.finditer(f"(?={re.escape(p)})", t)]
        assert one(spark, search.find_all("s", p), s=t) == want
    took = []
    for n in (20_000, 80_000, 320_000):
        began = time.time()
        assert one(spark, F.size(search.find_all("s", "AA")), s="A" * n) == n - 1
        took.append(time.time() - began)
    assert took[2] < 16 * max(took[1], 0.3)


def test_counted_overlaps(spark):
    l = spark.createDataFrame([(1, "a", 0, 10), (2, "a", 10, 10), (3, "b", 5, 6), (4, None, 0, 9), (5, "z", 0, 9), (6, "a", -5, 300)], "i int, k string, s bigint, e bigint")
    r = spark.createDataFrame([("a", 9, 20), ("a", 10, 20), ("a", -9, 0), ("a", -9, 1), ("a", 3, 3), ("b", 0, 100_000), ("b", 0, 100_000), (None, 0, 9)], "kk string, t bigint, u bigint")
    got = {x.i: x.n_hits for x in intervals.annotate_hits(l, r, ("s", "e"), ("t", "u"), [("k", "kk")], "i").collect()}
    assert got == {1: 2, 2: 0, 3: 2, 4: 0, 5: 0, 6: 4}
    for a, b in ((l.limit(0), r), (l, r.limit(0))):
        assert intervals.interval_join(a, b, ("s", "e"), ("t", "u"), [("k", "kk")]).count() == 0
    points = spark.createDataFrame([(1, 5, 5), (2, 0, 0), (3, 9, 9), (4, 4, 6), (5, 4096, 4096)], "i int, s bigint, e bigint")
    whole = spark.createDataFrame([(0, 9), (5, 5), (4095, 4097), (0, 100_000)], "t bigint, u bigint")
    inside = intervals.interval_join(points, whole, ("s", "e"), ("t", "u"), empty_inside=True)
    assert sorted((x.i, x.t, x.u) for x in inside.collect()) == [(1, 0, 9), (1, 0, 100_000), (3, 0, 100_000), (4, 0, 9), (4, 0, 100_000), (4, 5, 5), (5, 0, 100_000), (5, 4095, 4097)]
    anti = intervals.interval_join(l, r, ("s", "e"), ("t", "u"), [("k", "kk")], how="left_anti")
    assert sorted(x.i for x in anti.collect()) == [2, 4, 5]


def test_small_numbers(spark):
    from strandline.functions import vectors

    v = [0, 7, 32766, 32767, -1, 10**12]
    df = spark.createDataFrame([(v, [])], "v array<bigint>, w array<bigint>").select(vectors.compress("v").alias("c"), vectors.compress("w").alias("e"))
    r = df.select(
        vectors.decompress("c").alias("all"), vectors.length("c").alias("n"), vectors.get("c", F.lit(5)).alias("big"), vectors.get("c", F.lit(6)).alias("none"), vectors.decompress(vectors.put("c", F.lit(5), F.lit(3))).alias("low"),
        vectors.decompress(vectors.put("c", F.lit(0), F.lit(99_999))).alias("high"), vectors.decompress(vectors.push("e", F.lit(-5))).alias("one"), vectors.decompress("e").alias("empty"), F.size("c.high").alias("n_high"),
    ).first()
    assert r.all == v and r.n == 6 and r.big == 10**12 and r.none is None and r.low == [*v[:5], 3] and r.high == [99_999, *v[1:]] and r.one == [-5] and r.empty == [] and r.n_high == 3
    assert one(spark, records.symbol_at("s", F.lit(1)), s="ACG") == "C" and one(spark, records.symbol_at("s", F.lit(3)), s="ACG") is None
    assert one(spark, records.quality_at("s", F.lit(0)), s="I") == 40


def test_appended_bits(spark):
    bits = [(i, i % 3 == 0) for i in range(50)]
    df = spark.createDataFrame(bits, "i int, b boolean")
    r = prefix.extend_ranks(prefix.bit_ranks(df.filter("i < 20"), "i", "b"), df.filter("i >= 20"), "i", "b")
    assert sorted(map(tuple, r.collect())) == sorted(map(tuple, prefix.bit_ranks(df, "i", "b").collect()))
    assert sorted(x.i for x in prefix.rank_samples(r, "i", 16).collect()) == [15, 31, 47]
    assert prefix.extend_ranks(prefix.bit_ranks(df.limit(0), "i", "b"), df, "i", "b").count() == 50
