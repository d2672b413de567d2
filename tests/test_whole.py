"""Queries do the whole job on tables where a bound would show."""

import random

import numpy as np
import pytest

import __spark_entry__ as entry
from strandline.kernels import hmm, textindex
from strandline.operators import pairs


def query(spark, path, name, **tables):
    """Rows of a query over small tables, each a pair of rows and schema."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
    return entry.queries()[name](spark, str(path)).collect()


FASTA = "rec_id bigint, id string, descr string, seq string"
FASTQ = "read_id bigint, id string, descr string, seq string, qual string"


def bases(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def test_frequent_seeds(spark, tmp_path):
    """One molecule read more than 200 times keeps its pairs, and its matches are not broken."""
    s = bases(random.Random(1), 60)
    fasta = [(1, "f", None, "TTT" + s + "CCC")], FASTA
    fastq = [(i, f"r{i}", None, s, "I" * 60) for i in range(250)], FASTQ
    got = query(spark, tmp_path, "kmer_join", fasta=fasta, fastq=fastq)
    assert sorted(map(tuple, got)) == [(i, 1, 45, 0, 3) for i in range(250)]
    got = query(spark, tmp_path, "diagonals", fasta=fasta, fastq=fastq)
    assert sorted(map(tuple, got)) == [(i, 1, 3, 0, 60, 3, 63, 45) for i in range(250)]
    got = query(spark, tmp_path, "exact_matches", fasta=fasta, fastq=fastq)
    assert sorted(map(tuple, got)) == [(i, 1, 0, 60, 3, 63) for i in range(250)]


def search_tables():
    rng = random.Random(2)
    texts = [bases(rng, n) for n in (1, 300, 90, 400, 50)]
    texts[2] += texts[1][100:190] + "N" * 30 + texts[1][150:250]
    texts[3] = texts[3][:200] + "R" + texts[3][200:] + "A" * 40
    back = texts[3][::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    reads = ["A" * 30, "TTT", "GGNNNNNNNNNNNNNNNNNNNNNNNNNCC", "R", "ACGTR", "X", bases(rng, 80)]
    for t in (*texts, back):
        reads += [t[a : a + n] for a in range(0, len(t) - 20, 23) for n in (20, 60, 75)]
    reads += [a[:30] + b[-30:] for a, b in zip(reads[7:], reads[20:])]
    return texts, reads


def searched(spark, monkeypatch, tmp_path, name, limit):
    """Rows of a query over these tables, in blocks and pieces of a limit."""
    texts, reads = search_tables()
    if limit:
        monkeypatch.setattr(pairs, "MAX_REFERENCE", limit)
    fasta = [(i, f"f{i}", None, t) for i, t in enumerate(texts)], FASTA
    return texts, reads, query(spark, tmp_path, name, fasta=fasta, fastq=([(i, f"r{i}", None, r, None) for i, r in enumerate(reads)], FASTQ))


def places(s, t):
    return [i for i in range(len(t) - len(s) + 1) if t.startswith(s, i)]


@pytest.mark.parametrize("limit", [0, 320])
def test_fm_map_searches_all_records(spark, tmp_path, monkeypatch, limit):
    texts, reads, got = searched(spark, monkeypatch, tmp_path, "fm_map", limit)
    want = []
    for i, r in enumerate(reads):
        n = next(n for n in range(len(r), -1, -1) if any(r[len(r) - n :] in t for t in texts))
        want += [(i, "Complete" if n == len(r) else "Partial", n, k, p) for k, t in enumerate(texts) for p in places(r[len(r) - n :], t)] if n else [(i, "Absent", 0, None, None)]
    assert sorted(map(str, ((g.id, g.kind, g.length, g.rec_id, g.pos) for g in got))) == sorted(map(str, want))


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_fm_map_sends_no_read_to_every_block(spark, tmp_path, monkeypatch):
    """What is shuffled does not grow with the blocks of texts, and long matches are followed through all of them."""
    rng = random.Random(14)
    texts = [bases(rng, 100) for _ in range(300)]
    reads = [bases(rng, 60) for _ in range(2000)] + [bases(rng, 20) + "N" + texts[k][5:85] for k in range(50)] + [texts[7], "é" + texts[8][-30:], "", "Q"]
    monkeypatch.setattr(pairs, "MAX_REFERENCE", 1000)
    before = shuffled(spark)
    got = query(spark, tmp_path, "fm_map", fasta=([(i, f"f{i}", None, t) for i, t in enumerate(texts)], FASTA), fastq=([(i, f"r{i}", None, r, None) for i, r in enumerate(reads)], FASTQ))
    assert shuffled(spark) - before < 1_000_000
    got = [tuple(r) for r in got if r.id >= 2000]
    want = [(2000 + k, "Partial", 80, k, 5) for k in range(50)] + [(2050, "Complete", 100, 7, 0), (2051, "Partial", 30, 8, 70), (2052, "Absent", 0, None, None), (2053, "Absent", 0, None, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_fm_map_without_texts_or_reads(spark, tmp_path):
    none, reads = ([], FASTA), ([(1, "r", None, "ACGT", None), (2, "r", None, None, None)], FASTQ)
    assert [tuple(r) for r in query(spark, tmp_path, "fm_map", fasta=none, fastq=reads)] == [(1, "Absent", 0, None, None)]
    assert query(spark, tmp_path, "fm_map", fasta=([(1, "f", None, "ACGT")], FASTA), fastq=([], FASTQ)) == []


@pytest.mark.parametrize("limit", [0, 320])
def test_smems_search_all_records(spark, tmp_path, monkeypatch, limit):
    texts, reads, got = searched(spark, monkeypatch, tmp_path, "smems", limit)
    strands = [s for t in texts for s in (t, t[::-1].translate(str.maketrans("ACGTN", "TGCAN")))]
    want = []
    for i, r in enumerate(reads):
        last = 0
        for a in range(len(r)):
            b = a
            while b < len(r) and r[b] in "ACGTN" and any(r[a : b + 1] in s for s in strands):
                b += 1
            if b > last and b - a >= 10:
                want.append((i, a, b - a, sum(len(places(r[a:b], s)) for s in strands)))
            last = max(last, b)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 200


def test_smems_send_no_read_to_every_block(spark, tmp_path, monkeypatch):
    """What is shuffled does not grow with the blocks of texts, and long matches are counted over all of them, in parts of any size."""
    rng = random.Random(15)
    shared = bases(rng, 30) + "N" * 25 + bases(rng, 45)
    back = shared[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    texts = [bases(rng, 100) for _ in range(300)]
    for k in range(0, 300, 3):
        texts[k] = texts[k][:20] + (back if k % 2 else shared) + texts[k][:20] * 3
    reads = [bases(rng, 60) for _ in range(2000)] + [bases(rng, 20) + "R" + texts[k][5:85] for k in range(1, 300, 6)] + [shared, back[10:], "Q" + shared[:60] + "é", "", "N" * 30]
    monkeypatch.setattr(pairs, "MAX_REFERENCE", 1000)
    for module, name, value in ((pairs, "PART", 5000), (pairs, "RANGE", 2000), (textindex, "FOLLOWED", 2000)):
        monkeypatch.setattr(module, name, value, raising=False)
    before = shuffled(spark)
    got = query(spark, tmp_path, "smems", fasta=([(i, f"f{i}", None, t) for i, t in enumerate(texts)], FASTA), fastq=([(i, f"r{i}", None, r, None) for i, r in enumerate(reads)], FASTQ))
    assert shuffled(spark) - before < 1_000_000
    got = [tuple(r) for r in got]
    assert len(got) == len({r[:2] for r in got}) > 2000
    want = [(2000 + k, 21, 80, 1) for k in range(50)] + [(2050, 0, 100, 100), (2051, 0, 90, 100), (2052, 1, 60, 100), (2054, 0, 25, 200), *((2054, a, 25, 200) for a in range(1, 6))]
    assert sorted(r for r in got if r[0] >= 2000 and r[2] > 20) == sorted(want)


def test_all_exons(spark, tmp_path):
    """Features of a transcript are all exons of its record, overlapping ones merged."""
    spans = [("Parent=t1", 60, 70), ("Parent=t1,t2", 10, 20), ("transcript_id 't1' ;", 15, 25), ("Parent=t1", 40, 45), ("ID=x", 5, 9), (None, 5, 8)]
    gff = [(i, "c", "s", a, b, "+", x) for i, (x, a, b) in enumerate(spans)], "feature_id bigint, seqname string, source string, start_pos bigint, end_pos bigint, strand string, attributes string"
    got = query(spark, tmp_path, "spliced_transcripts", gff=gff)
    assert {r.name: r.line.split("\t")[9:] for r in got} == {"t1": ["3", "15,5,10,", "0,30,50,"], "t2": ["1", "10,", "0,"], "feature 4": ["1", "4,", "0,"], "feature 5": ["1", "3,", "0,"]}


def test_training_settles_on_all_reads(spark, tmp_path):
    """More steps than two, and reads with unknown symbols take part."""
    rng = random.Random(3)
    seqs = [bases(rng, 30), bases(rng, 15) + "N" + bases(rng, 15)]
    fastq = [(i, f"r{i}", None, s, None) for i, s in enumerate(seqs)] + [(60, "n", None, "ACNGTACGGT", None)], FASTQ
    got = {r.model: r for r in query(spark, tmp_path, "hmm_train", fastq=fastq)}
    assert set(got) == {0, 1} and all(r.settled or r.n_steps == 500 for r in got.values()) and max(r.n_steps for r in got.values()) > 2
    got = {r.id: r for r in query(spark, tmp_path, "hmm_decode", fastq=fastq)}
    assert set(got) == {0, 1, 60} and all(abs(r.ln_forward - r.ln_backward) < 1e-5 for r in got.values())


def test_unknown_symbols_add_nothing():
    m = hmm.Discrete([[0.9, 0.1], [0.2, 0.8]], [[0.7, 0.3], [0.2, 0.8]], [0.5, 0.5])
    assert hmm.forward(m, [0, -1, 1])[1] == pytest.approx(np.logaddexp(*(hmm.forward(m, [0, k, 1])[1] for k in (0, 1))))
    assert hmm.baum_welch_step(m, [0, -1, 1]).emission.sum(1) == pytest.approx([1, 1])


def seed_tables():
    """Reads and texts with unknown, foreign and no symbols, and their pairs of places with one 16-mer."""
    rng = random.Random(8)
    texts = [bases(rng, n) for n in (15, 16, 400, 90)] + ["", "N" * 40, bases(rng, 30) + "É€" + bases(rng, 30)]
    reads = [t[a : a + n] for t in texts for a in (0, 13) for n in (15, 17, 60)] + ["N" * 20, texts[2][:40] + texts[3][:40]]
    hits = [(i, j, a, b) for i, r in enumerate(reads) for j, t in enumerate(texts) for a in range(len(r) - 15) for b in range(len(t) - 15) if r[a : a + 16] == t[b : b + 16]]
    return {"fasta": ([(i, f"f{i}", None, t) for i, t in enumerate(texts)], FASTA), "fastq": ([(i, f"r{i}", None, r, None) for i, r in enumerate(reads)], FASTQ)}, hits


def never_broadcast(spark, path, name):
    """The q-grams of a small file are far larger than the file, so no plan may send them to all executors."""
    assert "Broadcast" not in entry.queries()[name](spark, str(path))._jdf.queryExecution().executedPlan().toString()


def test_seeds_of_all_records(spark, tmp_path):
    tables, hits = seed_tables()
    want = {}
    for i, j, a, b in hits:
        n, x, y = want.get((i, j), (0, 1 << 30, 1 << 30))
        want[i, j] = n + 1, min(x, a), min(y, b)
    assert sorted(map(tuple, query(spark, tmp_path, "kmer_join", **tables))) == sorted((*k, *v) for k, v in want.items())
    never_broadcast(spark, tmp_path, "kmer_join")


def test_diagonals_of_all_records(spark, tmp_path):
    tables, hits = seed_tables()
    want = {}
    for i, j, a, b in hits:
        want.setdefault((i, j, b - a), []).append(a)
    rows = [(i, j, d, min(x), max(x) + 16, min(x) + d, max(x) + 16 + d, len(x)) for (i, j, d), x in want.items() if len(x) > 1]
    assert sorted(map(tuple, query(spark, tmp_path, "diagonals", **tables))) == sorted(rows)
    never_broadcast(spark, tmp_path, "diagonals")


def test_exact_matches_of_all_records(spark, tmp_path):
    tables, hits = seed_tables()
    found = set(hits)
    rows = []
    for i, j, a, b in found:
        if (i, j, a - 1, b - 1) not in found:
            n = next(n for n in range(1, 1 << 30) if (i, j, a + n, b + n) not in found) + 15
            rows.append((i, j, a, a + n, b, b + n))
    assert sorted(map(tuple, query(spark, tmp_path, "exact_matches", **tables))) == sorted(rows)
    never_broadcast(spark, tmp_path, "exact_matches")
