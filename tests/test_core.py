"""Problems 3 to 6: brute force and edge cases."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandline.operators import packed, periods, rejects, skew
from tests.brute_rejects import rejects as brute_rejects


# problem 3


def brute_periods(rows):
    by = defaultdict(list)
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by[k].append((s, e))
    out = set()
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def test_periods_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        k = rng.choice(["a", "a", "a", "b", None])
        s = rng.choice([rng.randint(0, 4000), rng.randint(-50, 50), rng.randint(0, 40) * 10])
        rows.append((k, s, s + rng.choice([0, -3, 1, 5, 10, 10, 10, 700])))
    rows += [("c", None, 5), ("c", 5, None), ("d", 7, 9), ("d", 7, 9), ("e", 2**61, 2**61 + 5), ("e", -(2**61), -(2**61) + 5)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "k0 string, s bigint, e bigint, bin int, kind int, top int")
    for bins in (1, 7, 1024):
        got = [tuple(r) for r in periods.periods_and_gaps(df, ["k0"], "s", "e", bins).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_periods(rows)
    assert periods.periods_and_gaps(df.limit(0), ["k0"], "s", "e").count() == 0


# problem 4

FIELDS = {
    None: [],
    "": [],
    ".": [],
    "  ": [],
    "partial": [],
    "ID=x": [("ID", "x")],
    ' ID = "a;b,c" , d | e ;; Note ': [("ID", "a;b,c"), ("ID", "d"), ("ID", "e")],
    "gene_id \"g\"; tag 'x|y',z;": [("gene_id", "g"), ("tag", "x|y"), ("tag", "z")],
    'Note="say ""hi"""': [("Note", 'say "hi"')],
    "a=,b,,c;d==e": [("a", "b"), ("a", "c"), ("d", "=e")],
    "a=%2C%zz%4;b=1+1%20%": [("a", ",%zz%4"), ("b", "1+1 %")],
    "a=5' end;b=x": [("a", "5' end"), ("b", "x")],
    'a="" , ""  ;b=\'\'': [],
    'a="open, b': [("a", '"open'), ("a", "b")],
    'a="x" y,z': [("a", '"x" y'), ("a", "z")],
    "a=%C3%A9": [("a", "é")],
    "; =v;\"a b\"=c;t\t= x y , 'p' q,'r'": [("", "v"), ('"a', 'b"=c'), ("t", "x y"), ("t", "'p' q"), ("t", "r")],
    'n="""";m="a""";k="b"";j=1': [("n", '"'), ("m", 'a"'), ("k", '"b""'), ("j", "1")],
    'w "' + "x;" * 50_000 + '"': [("w", "x;" * 50_000)],
    'u "' + 'x""' * 20_000 + '"': [("u", 'x"' * 20_000)],
    "t " + ",".join(f"v{i}" for i in range(3000)): [("t", f"v{i}") for i in range(3000)],
    ";".join(f"t{i}=v" for i in range(9000)): [(f"t{i}", "v") for i in range(9000)],
}


def test_packed_fields(spark):
    rows = [(i, f, 1, "k", 0, 0) for i, f in enumerate(FIELDS)] + [(5, "ID=x", 1, "k", 0, 0), (None, "q=1", 1, "k", 0, 0)]
    df = spark.createDataFrame(rows, "fid int, field string, id int, sk string, rules int, tok int")
    got = defaultdict(list)
    for r in packed.split_packed(df, "fid", "field").collect():
        got[r.id].append((r.val_pos, r.tag, r.val))
    for i, want in enumerate(FIELDS.values()):
        values = [(t, v) for _, t, v in sorted(got[i])]
        assert values == (sorted(want * 2) if i == 5 else want), (i, values[:5])
    assert got[None] == [(0, "q", "1")]
    assert packed.split_packed(df.limit(0), "fid", "field").count() == 0


# problem 5


def test_hot_keys_and_plan(spark):
    rows = [("hot",)] * 50 + [("warm",)] * 4 + [(None,)] * 6 + [(f"k{i}",) for i in range(40)]
    df = spark.createDataFrame([(r[0], 1, 2) for r in rows], "name string, key int, load int")
    assert sorted(r.key for r in skew.hot_keys(df, "name", F.col("key")).collect()) == ["hot", "warm"]
    assert skew.hot_keys(df.limit(0), "name", F.col("key")).count() == 0
    plan = {k: (t, n) for k, t, n in skew.pack_keys([("hot", 50), ("warm", 4), ("w2", 4)], 100, 8)[0]}
    assert plan["hot"][1] == 4 and plan["warm"][1] == 1 and plan["warm"][0] != plan["w2"][0]


def test_fragment_replicate_join_and_top(spark):
    rng = random.Random(5)
    left = [(i, rng.choice(["hot"] * 8 + ["a", "b", None])) for i in range(400)]
    right = [("hot", 1), ("hot", 2), ("a", 3), ("zz", 4), (None, 5)]
    a = spark.createDataFrame(left, "i int, k string")
    b = spark.createDataFrame(right, "kk string, v int")
    got = Counter((r.i, r.v) for r in skew.fragment_replicate_join(a, b, "k", "kk", F.col("i"), tasks=8).collect())
    assert got == Counter((i, v) for i, k in left for kk, v in right if k is not None and k == kk)
    shards = skew.fragment(a, "k", F.col("i"), 8)
    per = Counter(r["__task"] for r in shards.collect())
    assert max(per.values()) < 130
    top = skew.top_per_key(a, "k", [F.desc("i")], 3, F.col("i"), tasks=8).collect()
    for k in ("hot", "a", "b"):
        assert [r.i for r in sorted((r for r in top if r.k == k), key=lambda r: r["__rank"])] == sorted((i for i, x in left if x == k), reverse=True)[:3]


def test_one_key_of_half_the_rows_is_spread_evenly(spark):
    rows = [(i, "hot" if i % 2 else f"k{i % 500}", i * 7 % 1000, 1) for i in range(40_000)]
    df = spark.createDataFrame(rows, "i int, k string, s int, __x int")
    placed = skew.fragment(df, "k", F.col("i"), 8)
    assert "__task" in placed._jdf.queryExecution().executedPlan().toString()
    per = [r.n for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(per) == 8 and max(per) < 1.5 * 40_000 / 8
    counts = {r.k: r.n for r in skew.per_key(df, "k", F.col("i"), {"n": (F.count("*"), F.sum)}, 8).collect()}
    assert counts == Counter(r[1] for r in rows)
    spans = df.select("i", "k", "s", (F.col("s") + F.pmod("i", F.lit(5))).alias("e"))
    want = defaultdict(set)
    for r in spans.collect():
        want[r.k] |= set(range(r.s, r.e))
    got = {r.key: r.covered for r in skew.covered_length(spans, "k", "s", "e", F.col("i"), 8).collect()}
    assert got == {k: len(v) for k, v in want.items() if v}


# problem 6

LINES = [
    "chr1\t1\t2\tx", "chr1\t1\t2\tx\r", "chr1\t1\t2", '"chr1"\t1\t2\t"a""b"', '"chr1\t1\t2\tx', 'chr1\t1\t2\t"x"y', 'chr1\t1\t2\tx"y"', "chr1\t-1\t2\tx", "chr1\t3\t2\tx", "chr1\t1\t9223372036854775807\tx",
    "chr1\t1\t9223372036854775808\tx", "chr1\t1\t00000000000000000000009\tx", "chr1\t1 \t2\tx", "chr1\t\t2\tx", "#c", "", "\r", " ", "chr1\t1\t2\ta\nb", "chr1\t1\t2\ta\rb", '﻿chr1\t"1"\t2\tx', "chr1\t1\t2\té ", "chr1\t١\t2\tx", '\t1\t2\t""', "x" * 200_000 + "\t1\t2\tx", None,
]
GFF = ["c\ts\tt\t1\t2\t.\t+\t0\tID=1", "c\ts\tt\t1\t2\t.\t+\t3\tID=1", "c\ts\tt\t1\t2\t.\t+\t \tID=1", "c\ts\tt\t1\t2\t.\t+\t.\tgene_id \"a", "c\ts\tt\t1\t2\t.\t+\t.\tgene_id \"a\"; x \"b\"", "c\ts\tt\t1\t2\t.\t+\t.", "c\ts\tt\t2\t1\t.\t+\t9\tx", "c\ts\tt\t1\t2\t.\t+\t\"1\"\tx"]
FASTQ = ["@a b c\nACGT\n+\nIIII", "@a\r\nACGT\r\n+\r\nIIII\r", "@a\nACGT\n+\nIII", "@a\n\n+\n", "@a\nACXT\n+\nIIII", "@a\nACGT\n+\nII I", "@a\nACGT\n+\nIIII\n", "a\nACGT\n+\nIIII", "@a\nACGT\n-\nIIII", "", None, "@a\nacgtn\n+x\n~~~!!", "@a\nACGÉ\n+\nIIII"]


def _raw():
    rng = random.Random(6)
    rows = []
    for f in range(6):
        order = rng.sample(LINES, len(LINES))
        rows += [(f"f{f}.bed", n, "bed", t) for n, t in enumerate(order, 1)]
    rows += [("p.bedpe", n, "bedpe", t) for n, t in enumerate(["a\t1\t2\tb\t3\t4\tn", "a\t1\t2\tb\t4\t3\tn", "a\t1\t2\tb\t3\t4", "a\t-1\t2\tb\t3\t4\tn"], 1)]
    rows += [("two.bed", 1, "bed", "chr1\t5"), ("two.bed", 2, "bed", "chr1\t5\t6")]
    rows += [("g.gff", n, "gff3", t) for n, t in enumerate(GFF, 1)] + [("g.gtf", n, "gtf", t) for n, t in enumerate(GFF, 1)]
    rows += [("r.fq", n, "fastq", t) for n, t in enumerate(FASTQ, 1)]
    return [(i, *r, "clash", 1) for i, r in enumerate(rows)]


def test_rejects_match_brute_force(spark):
    rows = _raw()
    df = spark.createDataFrame(rows, "raw_id int, file_name string, line_no int, fmt string, raw string, file string, reason int")
    parsed = rejects.parse_records(df)
    got = sorted(map(tuple, rejects.rejected(parsed).collect()))
    assert got == sorted(brute_rejects(rows))
    bed = {r.raw_id: r for r in rejects.loaded(parsed, "bed").collect()}
    one = next(r for r in rows if r[4] == '"chr1"\t1\t2\t"a""b"')
    if one[0] in bed:
        assert tuple(bed[one[0]])[1:] == ("chr1", 1, 2, ['a"b'])
    embedded = [bed[r[0]].aux for r in rows if r[4] == "chr1\t1\t2\ta\nb" and r[0] in bed]
    assert all(a == ["a\nb"] for a in embedded)
    fq = {r.id: r for r in rejects.loaded(parsed, "fastq").collect()}
    assert fq["a"].seq in ("ACGT", "acgtn")
    gff = rejects.loaded(parsed, "gff3").first()
    assert (gff.seqname, gff.start_pos, gff.phase) == ("c", 1, 0)
    assert rejects.parse_records(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, 1, "xml", "a", "", 0), (2, "f", 1, None, "a", "", 0)], df.schema)
    assert sorted(map(tuple, rejects.rejected(rejects.parse_records(odd)).collect())) == [(1, "layout"), (2, "layout")]
