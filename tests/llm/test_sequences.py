"""Problems 1, 2 and 7 against brute force, and their edge cases."""

import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import neardup, repeats, splitting

SCHEMA = "rec_id bigint, seq string, id string, name string, start_pos int, key string, code int, rep int, lo int"


def table(spark, rows):
    return spark.createDataFrame([(i, s, "x", None, 1, "k", 2, 3, 4) for i, s in rows], SCHEMA)


def random_seq(rng, n, alphabet="ACGT"):
    return "".join(rng.choice(alphabet) for _ in range(n))


# problem 1


def test_bisect_properties():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 3000)
        runs = sorted({rng.randint(0, max(1, n - 12)) for _ in range(rng.randint(0, 5))})
        runs = [(a, a + 10) for a, b in zip(runs, runs[1:] + [10**9]) if a + 10 < b and a + 10 <= n]
        pieces = splitting.bisect(n, runs, 200, 20)
        assert pieces[0][0] == 0 and pieces[-1][1] == n
        assert all(b - a <= 200 for a, b, _ in pieces)
        assert all(y[0] == x[1] - 20 for x, y in zip(pieces, pieces[1:]))
        assert (len(pieces) == 1) == (n <= 200)


def test_cut_in_the_longest_run_in_reach():
    pieces = splitting.bisect(300, [(120, 130), (140, 170), (290, 300)], 200, 20)
    assert pieces == [(0, 155, "start"), (135, 300, "gap")]
    assert splitting.bisect(300, [(0, 10), (290, 300)], 200, 20)[1][2] == "midpoint"
    with pytest.raises(ValueError):
        splitting.bisect(10, [], 100, 60)


def test_split_edges(spark):
    long = "ac gt\n" * 10 + "n" * 12 + "ACGT" * 20
    df = table(spark, [(1, None), (2, ""), (3, "ACGT"), (4, long), (4, long), (None, long), (5, "N" * 101)])
    out = splitting.split_oversized(df, limit=100, overlap=10).collect()
    by = Counter((r.rec_id, r.piece_no) for r in out)
    assert by[1, 0] == by[2, 0] == by[3, 0] == 1 and by[4, 0] == by[4, 1] == 2 and by[None, 1] == 1
    clean = "".join(long.split()).upper()
    for r in out:
        if r.rec_id == 4:
            assert r.piece == clean[r.start_pos : r.end_pos]
        assert r.end_pos - r.start_pos == len(r.piece) <= 100
    runs = sorted((r.rec_id or 0, r.gap_start) for r in splitting.boundary_runs(df, limit=100, overlap=10).collect())
    assert runs == [(0, 40), (4, 40), (4, 40), (5, 0)]
    assert splitting.boundary_runs(table(spark, [(7, "A" * 101)]), limit=100, overlap=10).first().gap_start == -1
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_claims(spark):
    fai = spark.createDataFrame([("a", 5), ("a", 7), ("b", None), (None, 1)], "name string, len bigint")
    assert sorted(map(tuple, splitting.claimed_lengths(fai).collect())) == [("a", 7, 2), ("b", None, 1)]


# problem 2


def brute_pairs(rows, width=12, threshold=0.5):
    sets = [(i, {s[k : k + width] for k in range(len(s) - width + 1)}) for i, s in ((i, "".join((s or "").split()).upper()) for i, s in rows) if i is not None]
    out = set()
    for x, (i, p) in enumerate(sets):
        for j, q in sets[x + 1 :]:
            if p | q and len(p & q) >= threshold * len(p | q) and i != j:
                out.add((min(i, j), max(i, j)))
    return out


def family(rng, n, size):
    rows = []
    for f in range(n):
        base = random_seq(rng, rng.choice([14, 40, 130, 260]), "ACGTN" if f % 5 == 0 else "ACGT")
        for _ in range(size):
            s = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                k = rng.randrange(len(s))
                s[k : k + rng.choice([0, 1])] = rng.choice("ACGT") * rng.choice([0, 1, 2])
            if rng.random() < 0.2:
                cut = rng.randrange(len(s))
                s = s[cut:] + s[:cut]
            rows.append("".join(s))
    return rows


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    adapter = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"
    seqs = family(rng, 30, 5) + [random_seq(rng, 100) + adapter for _ in range(40)] + [adapter] * 3 + ["ACGTACGTACGTACGT", "acgt acgt\nACGTACGT", "ACGTACGT*CGTACGT", "ACGTACGTéCGTACGT", "", "A", "A" * 50, "A" * 90, None]
    rows = list(enumerate(seqs)) + [(None, adapter)]
    got = [tuple(r) for r in neardup.near_duplicates(table(spark, rows), "rec_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(rows)


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(table(spark, []), "rec_id").count() == 0


def test_groups(spark):
    rng = random.Random(3)
    base = random_seq(rng, 200)
    chain = [base, base[20:] + random_seq(rng, 20), base[40:] + random_seq(rng, 40), base]
    rows = [(i + 10, s) for i, s in enumerate(chain)] + [(1, random_seq(rng, 150)), (2, "ACG"), (3, None)]
    got = {r.id: (r.rep, r.group_id, r.n_links) for r in neardup.near_duplicate_groups(table(spark, rows), "rec_id").collect()}
    assert set(got) == {1, 10, 11, 12, 13} and got[1] == (1, 1, 0)
    assert {got[i][1] for i in (10, 11, 12, 13)} == {10} and got[13][0] == 10


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.range(n).toDF("node")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 2)], "a bigint, b bigint")
    got = {r.node: r.group for r in neardup.components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(n - 1)) and got[n - 1] == n - 1


# problem 7


def brute_spans(rows, window):
    where = {}
    clean = [(i, "".join((s or "").split()).upper()) for i, s in rows if i is not None]
    for i, s in clean:
        for k in range(len(s) - window + 1):
            w = s[k : k + window]
            if not set(w) - set("ACGT"):
                where.setdefault(w, set()).add(i)
    cover = {}
    for i, s in clean:
        for k in range(len(s) - window + 1):
            if len(where.get(s[k : k + window], ())) > 1:
                cover.setdefault(i, set()).update(range(k, k + window))
    out = set()
    for i, places in cover.items():
        for p in places:
            if p - 1 not in places:
                e = p
                while e in places:
                    e += 1
                out.add((i, p, e))
    return out


@pytest.mark.parametrize("window", [48, 20])
def test_shared_spans_match_brute_force(spark, window):
    rng = random.Random(window)
    shared = [random_seq(rng, n) for n in (window, window + 1, 75, 200, 400)] + ["A" * 130, "AC" * 70, "AAC" * 50, "ACGTTGCA" * 20]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            piece = rng.choice(shared) if rng.random() < 0.5 else random_seq(rng, rng.randint(1, 120))
            if rng.random() < 0.3:
                k = rng.randrange(len(piece))
                piece = piece[:k] + rng.choice("ACGTNR") + piece[k + 1 :]
            if rng.random() < 0.3:
                piece = piece[rng.randrange(len(piece)) :]
            parts.append(piece)
        rows.append((i, "".join(parts) if i % 7 else "\n".join(parts).lower()))
    rows += [(100, None), (101, ""), (102, "ACGT"), (None, shared[3]), (103, rows[5][1])]
    got = {tuple(r) for r in repeats.shared_spans(table(spark, rows), window=window).collect()}
    assert got == brute_spans(rows, window)


def test_cut_chunks_change_nothing(spark):
    rng = random.Random(9)
    common = random_seq(rng, 300)
    seqs = [random_seq(rng, 500) + common + random_seq(rng, 90), random_seq(rng, 130) + common, "A" * 700, "A" * 60 + "C", random_seq(rng, 99)]
    whole = [dict(zip(k[2].tolist(), zip(k[0].tolist(), k[1].tolist()))) for k in (repeats.window_keys(repeats._encode([s])[0]) for s in seqs)]
    assert set(whole[0]) & set(whole[1]) and len(whole[2]) == 1
    rows = [*enumerate(seqs), (0, seqs[0]), (0, seqs[1][50:])]  # one id with several sequences
    for chunk in (100, 333, 65_536):
        assert sorted(map(tuple, repeats.shared_spans(table(spark, rows), chunk=chunk).collect())) == sorted(brute_spans(rows, 48)), chunk


def test_every_window_has_a_key():
    rng = random.Random(4)
    for s in ("A" * 200, "AC" * 100, random_seq(rng, 500), "ACGT" * 3 + "N" + "G" * 60):
        first, end, _ = repeats.window_keys(repeats._encode([s])[0])
        covered = np.concatenate([np.arange(a, b) for a, b in zip(first, end)]) if len(first) else []
        want = [k + 1 for k in range(len(s) - 47) if not set(s[k : k + 48]) - set("ACGT")]
        assert sorted(covered) == want


def test_share_edges(spark):
    s = "ACGTTGCAACGGTTAACCGGATATCCGCGATTACAGGCATTACGGACTTACGGAT"
    rows = [(1, s), (1, s), (2, None), (3, s + "NNN"), (4, "")]
    got = {r.rec_id: (r.n_symbols, r.n_shared, r.share) for r in repeats.shared_fraction(table(spark, rows)).collect()}
    assert got[1] == (len(s), len(s), 1.0) and got[2] == (0, 0, 0.0) and got[4] == (0, 0, 0.0)
    assert got[3][1] == len(s)
    assert repeats.shared_spans(table(spark, [(1, s), (1, s)])).count() == 0
    assert repeats.shared_spans(table(spark, [])).count() == 0
