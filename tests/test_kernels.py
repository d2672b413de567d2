"""Known values and brute force for the kernels."""

import math
import random
import time
from dataclasses import replace

import numpy as np
import pytest

from strandline.kernels import approx, hmm, integrate, pairhmm, pairwise, poa, sparse, textindex
from strandline.operators import pairs

S = pairwise.Scoring.from_scores


def test_alignment_known_values():
    x, y = "ACCGTGGAT", "AAAAACCGTTGAT"
    a = pairwise.align(x, y, S(-5, -1, 1, -1), "semiglobal")
    assert (a.xstart, a.ystart, a.ops) == (0, 4, "MMMMMSMMM")
    assert pairwise.align(x, y, S(-1, -1, 1, -5), "semiglobal").ops == "MMMMDMIMMM"
    assert pairwise.align(x, y, S(-5, -1, 1, -1), "global").ops == "DDDDMMMMMSMMM"
    assert pairwise.align("ACGAGAACA", "ACGACA", S(-5, -1, 1, -3), "global").ops == "MMMIIIMMM"
    clip = replace(S(-5, -1, 1, -1), xclip_prefix=-10, yclip_prefix=0, yclip_suffix=0)
    a = pairwise.align("GGGGGGGGGACGTACGTACGT", "AAAAACGTACGTACGTAAAA", clip)
    assert a.score == 2 and a.clipped() == [("Y", 4), ("X", 9), ("M", 12), ("Y", 4)]
    assert "|" in a.pretty("GGGGGGGGGACGTACGTACGT", "AAAAACGTACGTACGTAAAA")


def brute_score(x, y, sc):
    m, n, low = len(x), len(y), -(10**9)
    s, i_, d = ([[low] * (n + 1) for _ in range(m + 1)] for _ in range(3))
    best = low
    for i in range(m + 1):
        for j in range(n + 1):
            v = (sc.xclip_prefix if i else 0) + (sc.yclip_prefix if j else 0)
            if i:
                i_[i][j] = max(i_[i - 1][j] + sc.gap_extend, s[i - 1][j] + sc.gap_open)
            if j:
                d[i][j] = max(d[i][j - 1] + sc.gap_extend, s[i][j - 1] + sc.gap_open)
            if i and j:
                v = max(v, s[i - 1][j - 1] + int(sc.table[ord(x[i - 1]), ord(y[j - 1])]))
            s[i][j] = max(v, i_[i][j], d[i][j])
            best = max(best, s[i][j] + (0 if i == m else sc.xclip_suffix) + (0 if j == n else sc.yclip_suffix))
    return best


@pytest.mark.parametrize("mode", ["global", "semiglobal", "local", "custom"])
def test_alignment_brute_force(mode):
    rng = random.Random(mode)
    sc = replace(S(-3, -1, 2, -2), xclip_prefix=-2, xclip_suffix=-1, yclip_prefix=-3, yclip_suffix=0)
    xs = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 10))) for _ in range(80)]
    ys = ["".join(rng.choice("ACG") for _ in range(rng.randint(0, 10))) for _ in range(80)]
    wide = [(np.maximum(0, np.arange(len(x) + len(y) + 1) - len(y)), np.minimum(len(x), np.arange(len(x) + len(y) + 1))) for x, y in zip(xs, ys)]
    for bands in (None, wide):
        for a, x, y in zip(pairwise.align_batch(xs, ys, sc, mode) if bands is None else pairwise._align_bands(xs, ys, sc, mode, bands), xs, ys):
            assert a.score == brute_score(x, y, sc.with_mode(mode))
            i, j = a.xstart, a.ystart
            for o in a.ops:
                assert o not in "MS" or (x[i] == y[j]) == (o == "M")
                i, j = i + (o != "D"), j + (o != "I")
            assert (i, j) == (a.xend, a.yend)


def test_banded():
    x = "AGCACAAGTGTGCGCTATACAGGAAGTAGGAGTACACGTGTCA"
    y = "CAGTTGTACTAGCATGACCAGTTGTACTAGCATGACAGCACACGTGTGCGCTATACAGTAAGTAGTAGTACACGTGTCACAGTTGTACTAGCATGACCAGTTGTACTAGCATGAC"
    assert pairwise.align_banded([x], [y], S(-5, -1, 1, -1), 8, 6, "semiglobal")[0].score == 37
    assert pairwise.align_banded([x], [y], S(-5, -1, 1, -1), 8, 6, max_cells=10)[0].score == pairwise.MIN_SCORE
    rng = random.Random(1)
    for mode in ("global", "semiglobal", "local"):
        base = "".join(rng.choice("ACGT") for _ in range(300))
        other = base[:100] + base[104:200] + "GG" + base[200:]
        full, band = pairwise.align(base, other, S(-5, -1, 1, -1), mode), pairwise.align_banded([base], [other], S(-5, -1, 1, -1), 10, 12, mode)[0]
        assert full.score == band.score


def test_matrix():
    t = pairwise.read_matrix("# c\n   A  R  *\nA  4 -1 -4\nR -1  5 -4\n* -4 -4  1\n")
    assert t[ord("a"), ord("R")] == -1 and t[ord("Z"), ord("A")] == -4 and t[ord("Z"), ord("Q")] == 1
    with pytest.raises(ValueError):
        S(1, -1, 1, -1)


def test_sparse():
    m = sparse.find_kmer_matches("ACGTACGATAGGTA", "TTACGTACGATAGGTATT", 8)
    r = sparse.lcskpp(m, 8)
    assert [m[i] for i in r.path] == [(k, k + 2) for k in range(7)] and r.score == 14
    a, b = "ACGTACGATAGATCCGTACGTAACAGTACAGTATATCAGTTATATGCGATA", "TTACGTACGATAGATCCGTACGTAACATTTTTGTACAGTATATCAGTTATATGCGA"
    m = sparse.find_kmer_matches(a, b, 8)
    assert len(m) == (25 - 8 + 1) + (24 - 8 + 1) and sorted((x, y) for y, x in sparse.find_kmer_matches(b, a, 8)) == m
    assert sparse.sdpkpp(m, 8, 1, -1, -1).score <= sparse.lcskpp(m, 8).score
    path = sparse.union_path(m, 8, 1, -1, -1)
    assert path == sorted(path)
    assert set(m) <= set(sparse.expand_matches(a, b, 8, m, 1))
    assert sparse.lcskpp([], 8).path == []
    with pytest.raises(ValueError):
        sparse.lcskpp([(3, 1), (1, 1)], 2)


def test_chain_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        k = 2
        m = sorted({(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(8)})
        best = [0] * len(m)
        for i, (x, y) in enumerate(m):
            best[i] = k
            for j in range(i):
                a, b = m[j]
                if a + k <= x and b + k <= y:
                    best[i] = max(best[i], best[j] + k)
                if (a, b) == (x - 1, y - 1):
                    best[i] = max(best[i], best[j] + 1)
        assert sparse.lcskpp(m, k).score == max(best)


def test_partial_order():
    g = poa.Graph("AAAAAAA")
    assert g.align("AABCBAA")[0] == 1
    g.add("AABBBAA", g.align("AABBBAA")[1])
    assert g.align("AABCBAA")[0] == 5
    assert poa.consensus_of(["ACGTTA", "ACGATA", "ACGTTA"]) == "ACGTTA" and poa.consensus_of([]) == ""
    assert poa.Graph("ACGTACGT").align("GTAC", mode="semiglobal")[0] == 4 and poa.Graph("TTACGTT").align("GGACGGG", mode="local")[0] == 3
    assert g.align("AABCBAA", band=3)[0] == 5
    assert g.rows(["AAAAAAA", "AABBBAA"]) == ["AAAAAAA", "AABBBAA"]


def test_suffix_structures():
    t = "GCCTTAACATTATTACGCCTA$"
    sa = textindex.suffix_array(t)
    assert sa.tolist() == [21, 20, 5, 6, 14, 11, 8, 7, 17, 1, 15, 18, 2, 16, 0, 19, 4, 13, 10, 3, 12, 9]
    assert textindex.lcp_array(t, sa).tolist() == [-1, 0, 1, 1, 2, 1, 4, 0, 1, 3, 1, 1, 2, 0, 4, 0, 2, 2, 2, 1, 3, 3, -1]
    b = textindex.bwt(t, sa)
    assert b == "ATTATTCAGGACCC$CTTTCAA" and textindex.invert_bwt(b) == t
    u = "GCTGCTA$"
    sa = textindex.suffix_array(u)
    assert textindex.shortest_unique(sa, textindex.lcp_array(u, sa)) == [4, 3, 2, 4, 3, 2, 1, 1]
    assert textindex.suffix_array("AC$AC$").tolist() == [5, 2, 3, 0, 4, 1]
    assert textindex.suffix_array_int(np.array([3, 1, 2, 0])).tolist() == [3, 1, 2, 0]
    for bad in ("", "$A", "AB"):
        with pytest.raises(ValueError):
            textindex.suffix_array(bad)
    assert [textindex.wavelet_rank("AANGGT$ACCNTT$", c, i) for c, i in (("A", 0), ("G", 9), ("T", 13))] == [1, 2, 3]


@pytest.mark.parametrize("sample", [1, 4])
def test_fm_index(sample):
    t = "GCCTTAACATTATTACGCCTA"
    f = textindex.FMIndex(t + "$", 4, sample)
    kind, lo, hi, n = f.backward_search("TTA")
    assert (kind, n, f.positions(lo, hi)) == ("Complete", 3, [3, 12, 9])
    assert f.backward_search("GGTTA")[0::3] == ("Partial", 3) and f.backward_search("Z")[0] == "Absent"


def test_batches_of_backward_search():
    rng = random.Random(11)
    for n, rate in ((1, 4), (63, 4), (64, 4), (700, 64), (640, 64)):
        f = textindex.FMIndex("".join(rng.choice("ACGTé") for _ in range(n)) + "$", rate)
        pats = ["".join(rng.choice("ACGTéZ" if rng.random() < 0.2 else "ACGT") for _ in range(rng.choice([0, 1, 3, 9]))) for _ in range(200)]
        lo, hi, k = f.search_batch(pats)
        for p, got in zip(pats, zip(lo.tolist(), hi.tolist(), k.tolist())):
            kind, a, b, n_ = f.backward_search(p)
            assert got == ((a, b, n_) if n_ else (0, 0, 0)), p
    t = "".join(rng.choice("AB") for _ in range(300)) + "$"
    assert textindex.suffix_array(t).tolist() == sorted(range(301), key=lambda i: t[i:])


def test_smems():
    f = textindex.FMDIndex("ATTCGGGG$CCCCGAAT$")
    assert [s[3:] for s in f.all_smems("ATTGGGG")] == [(0, 3), (3, 4)]
    g = "GCCTTAACAT"
    rc = g[::-1].translate(str.maketrans("ACGT", "TGCA"))
    f = textindex.FMDIndex(f"{g}${rc}$")
    (lo, rev, n, at, k), = f.smems("AA", 0)
    assert sorted(f.positions(lo, lo + n)) == [5, 16] and sorted(f.positions(rev, rev + n)) == [3, 14] and (at, k) == (0, 2)
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(80))
    both = text + "$" + text[::-1].translate(str.maketrans("ACGT", "TGCA")) + "$"
    f = textindex.FMDIndex(both)
    for _ in range(20):
        p = "".join(rng.choice("ACGT") for _ in range(12))
        spans = [(s, e) for s in range(12) for e in range(s + 1, 13) if p[s:e] in both and (s == 0 or p[s - 1 : e] not in both) and (e == 12 or p[s : e + 1] not in both)]
        assert [(a, a + n) for _, _, _, a, n in f.all_smems(p)] == sorted(spans)
    with pytest.raises(ValueError):
        textindex.FMDIndex("AXB$")


def test_approximate():
    p, t = approx.Pattern("TCCTAGGGC"), "CGGTCCTGAGGGATTAGCAC"
    assert approx.find_all_end(p, t, 2) == [(11, 2), (12, 2)]
    assert [m[:3] for m in approx.find_all(p, t, 2)] == [(3, 12, 2), (3, 13, 2)]
    assert approx.ukkonen("TGAGCGA", "ACCGTGGATGAGCGCCATAG", 1) == [(13, 1), (14, 1)]
    assert approx.distance(approx.Pattern("TGATCNT", {"N": "ACGT"}), "GTCTGATCTTACC") == 0
    assert approx.distance(p, "") is None and approx.find_best_end(approx.Pattern("AC"), "GGACAC") == (3, 0)
    assert approx.distance(approx.Pattern("ACGT", wildcards="N"), "ANNT") == 0
    rng = random.Random(2)
    for n in (1, 5, 70, 130):
        a = "".join(rng.choice("AC") for _ in range(n))
        b = "".join(rng.choice("AC") for _ in range(200))
        k = rng.randint(0, n // 2)
        ends = approx.find_all_end(approx.Pattern(a), b, k)
        assert ends == approx.ukkonen(a, b, k)
        for s, e, d, ops in approx.find_all(approx.Pattern(a), b, k)[:20]:
            assert sum(o != "M" for o in ops) == d and e - s == sum(o != "I" for o in ops)
    with pytest.raises(ValueError):
        approx.Pattern("")


def test_hidden_markov():
    m = hmm.Discrete([[0.5, 0.5], [0.4, 0.6]], [[0.2, 0.3, 0.3, 0.2], [0.3, 0.2, 0.2, 0.3]], [0.5, 0.5])
    path, p = hmm.viterbi(m, [2, 2, 1, 0, 1, 3, 2, 0, 0])
    assert path == [0, 0, 0, 1, 1, 1, 1, 1, 1] and np.exp(p) == pytest.approx(4.25e-8, abs=1e-9)
    assert np.exp(hmm.forward(m, [2, 2, 1, 0])[1]) == pytest.approx(0.0038432, abs=1e-6) == np.exp(hmm.backward(m, [2, 2, 1, 0])[1])
    ices = [1, 2, 2, 1, 2, 1, 2, 1, 1, 2, 0, 2, 2, 0, 0, 0, 1, 0, 0, 0, 2, 0, 1, 0, 0, 0, 1, 2, 2, 1, 2, 1, 1]
    e = [[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]]
    m = hmm.Discrete([[0.8, 0.1], [0.1, 0.8]], e, [0.5, 0.5], [0.1, 0.1])
    assert np.exp(hmm.backward(m, ices)[1]) == pytest.approx(0.912e-18, rel=2e-3)
    step = hmm.baum_welch_step(hmm.Discrete([[0.8, 0.1], [0.1, 0.8]], e, [0.3, 0.7], [0.1, 0.1]), ices)
    assert step.initial == pytest.approx([0.0597, 0.9403], abs=1e-3) and step.transition.ravel() == pytest.approx([0.8797, 0.1049, 0.0921, 0.8658], abs=1e-3) and step.end == pytest.approx([0.0153, 0.0423], abs=1e-3)
    g = hmm.Gaussian([[0.5, 0.5], [0.4, 0.6]], [[0.0, 1.0], [2.0, 1.0]], [0.5, 0.5])
    obs = [-0.1, 0.2, 1.9, 2.2]
    assert hmm.viterbi(g, obs)[0] == [0, 0, 1, 1] and hmm.forward(g, obs)[1] == pytest.approx(hmm.backward(g, obs)[1])
    trained, history = hmm.train(m, [ices], steps=20)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    with pytest.raises(ValueError):
        hmm.Discrete([[1.0]], [[1.0], [1.0]], [0.5, 0.5])
    with pytest.raises(ValueError):
        hmm.viterbi(m, [])


def brute_pair(x, y, p):
    """Sum over all alignments, by recursion on states."""
    import functools

    @functools.cache
    def f(i, j, s):
        if i == 0 and j == 0:
            return 1.0 if s == "m" else 0.0
        if s == "m":
            if not i or not j:
                return 0.0
            e = 1 - p.substitution if x[i - 1] == y[j - 1] else p.substitution / 3
            return e * ((1 - p.gap_x - p.gap_y) * f(i - 1, j - 1, "m") + (1 - p.gap_y_extend) * f(i - 1, j - 1, "x") + (1 - p.gap_x_extend) * f(i - 1, j - 1, "y"))
        if not i or not j:
            return 0.0
        if s == "x":
            return (1 - p.substitution) * (p.gap_y * f(i - 1, j, "m") + p.gap_y_extend * f(i - 1, j, "x"))
        return (1 - p.substitution) * (p.gap_x * f(i, j - 1, "m") + p.gap_x_extend * f(i, j - 1, "y"))

    return sum(f(len(x), len(y), s) for s in "mxy")


def test_pair_models():
    p = pairhmm.PairModel(0.05, 0.1, 0.2, 0.3, 0.05, semiglobal=False)
    rng = random.Random(6)
    xs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    ys = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    with np.errstate(divide="ignore"):
        want = np.log([brute_pair(x, y, p) for x, y in zip(xs, ys)])
    assert pairhmm.pair_probability(xs, ys, p) == pytest.approx(want)
    g = pairhmm.PairModel(semiglobal=False)
    assert pairhmm.pair_probability(["AAA"], ["A"], g)[0] == -np.inf
    most = np.log(5.1e-6) * 6 + np.log(1 - 0.0021) * 12
    assert pairhmm.pair_probability(["ACGTACGTACGT"], ["AGAGAG"], g)[0] == pytest.approx(most, rel=1e-3)
    s = pairhmm.PairModel()
    inside = pairhmm.pair_probability(["GGACGTACGTCC"], ["ACGTACGT"], s)[0]
    assert inside == pytest.approx(np.log(1 - 0.0021) * 8, abs=1e-3) and pairhmm.pair_probability(["GGACGTACGTCC"], ["ACGTACGT"], s, 2)[0] == pytest.approx(inside, abs=1e-6)
    assert pairhmm.pair_probability(["", "A"], ["A", ""], s).tolist() == [-np.inf, -np.inf]
    hop = pairhmm.PairModel(semiglobal=False, hop_x=1e-5, hop_y=1e-5, hop_x_extend=0.1, hop_y_extend=0.1)
    same, shorter, other = pairhmm.homopolymer_probability(["ACGGGT"] * 3, ["ACGGGT", "ACGGT", "ACGCGT"], hop)
    assert same == pytest.approx(np.log(1 - 0.0021) * 6, abs=1e-3) and same > other > shorter - 20 and shorter > np.log(1e-5) - 1.5


def test_operators_on_edges(spark):
    df = spark.createDataFrame([(1, "ACGTACGT", "ACGTTACGT"), (2, None, "A"), (3, "", "A"), (None, "AC", "AC"), (1, "ACGTACGT", "ACGTTACGT")], "i int, x string, y string")
    out = pairs.align_pairs(df, "i", "x", "y", S(-5, -1, 1, -1), "global").collect()
    assert sorted((r.id or 0, r.score if r.score is not None else -99) for r in out) == [(0, 2), (1, 3), (1, 3), (2, -99), (3, -5)]
    assert pairs.align_pairs(df.limit(0), "i", "x", "y", S(-5, -1, 1, -1)).count() == 0
    assert {r.id for r in pairs.approximate_ends(df, "i", "x", approx.Pattern("ACGT"), 0).collect()} == {1}
    assert pairs.suffix_arrays(df, "i", "x").filter("id = 1").count() == 18
    assert pairs.chains(df, "i", "x", "y", 4).filter("id = 1").first().n_matches > 0
    assert pairs.poa_consensus(df, "i", "y", "y").filter("group = 1").first().consensus == "ACGTTACGT"


def test_adaptive_integral():
    for mean, sd in ((0.3, 0.001), (5.0, 1.0), (9.99, 0.01)):
        got = integrate.adaptive(lambda x: -0.5 * ((x - mean) / sd) ** 2 - np.log(sd * np.sqrt(2 * np.pi)), 0.0, 10.0, 1e-4)
        inside = 1.0 if mean < 9 else 0.841345
        assert np.exp(got) == pytest.approx(inside, rel=5e-3)
    assert integrate.adaptive(lambda x: float("-inf"), 0, 1, 0.1) == -np.inf
    assert np.exp(integrate.adaptive(lambda x: 0.0, 0, 2, 0.1)) == pytest.approx(2)
    with pytest.raises(ValueError):
        integrate.adaptive(lambda x: 0.0, 2, 1, 0.1)


def test_batches_of_approximate_search():
    rng = random.Random(9)
    for n in (1, 8, 40, 63, 70):
        p = approx.Pattern("".join(rng.choice("ACGN") for _ in range(n)), {"N": "ACGT"}, "?")
        texts = ["".join(rng.choice("ACGT?é") for _ in range(rng.choice([0, 1, 30, 33, 90, 400]))) for _ in range(90)]
        row, end, dist = approx.ends_batch(p, texts, n // 2)
        want = [(i, e, d) for i, t in enumerate(texts) for e, d in approx.find_all_end(p, t, n // 2)]
        assert list(zip(row.tolist(), end.tolist(), dist.tolist())) == want
    assert len(approx.ends_batch(p, [], 1)[0]) == 0


def test_chain_with_gap_costs():
    assert sparse.sdpkpp([(0, 0), (9, 12)], 4, 10, 0, -1).score == 72  # eight symbols and a gap of max(5, 8)
    assert sparse.sdpkpp([(0, 0), (4, 4)], 4, 1, -5, -1).score == 8 and sparse.sdpkpp([(0, 0), (5, 4)], 4, 1, -1, -1).score == 6
    m = [(0, 0), (20, 20), (21, 21), (40, 90)]
    assert sparse.union_path(m, 4, 1, -3, -1) == [0, 1, 2, 3]


def test_only_plain_models_are_trained():
    g = hmm.Gaussian([[0.5, 0.5], [0.5, 0.5]], [[0.0, 1.0], [2.0, 1.0]], [0.5, 0.5])
    with pytest.raises(TypeError, match="Gaussian"):
        hmm.train(g, [[0.1, 2.0, 1.5]])
    m = hmm.Discrete([[0.5, 0.5], [0.4, 0.6]], [[0.5, 0.5], [0.1, 0.9]], [0.5, 0.5])
    assert list(hmm.states(m)) == [0, 1] and list(hmm.transitions(m))[2] == (1, 0, 0.4)


def test_batches_of_hidden_models():
    rng = random.Random(6)
    for end in (None, [0.1, 0.2, 0.3]):
        m = hmm.Discrete([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.1, 0.8]], [[0.7, 0.2, 0.1], [0.1, 0.6, 0.3], [0.3, 0.3, 0.4]], [0.5, 0.3, 0.2], end)
        obs = [[rng.randint(-1, 2) for _ in range(rng.choice([1, 2, 7, 40, 300]))] for _ in range(25)]
        for o, (path, v, f, b) in zip(obs, hmm.decode_batch(m, obs)):
            assert path == hmm.viterbi(m, o)[0] and v == pytest.approx(hmm.viterbi(m, o)[1])
            assert f == pytest.approx(hmm.forward(m, o)[1]) and b == pytest.approx(hmm.backward(m, o)[1]) and f == pytest.approx(b)
    assert hmm.decode_batch(m, []) == []
    g = hmm.Gaussian([[0.5, 0.5], [0.5, 0.5]], [[0.0, 1.0], [2.0, 1.0]], [0.5, 0.5])
    assert hmm.decode_batch(g, [[0.1, 1.9], [2.2]])[0][0] == hmm.viterbi(g, [0.1, 1.9])[0]


def test_wide_bands_find_the_best_alignment():
    rng = random.Random(7)
    s = pairwise.Scoring.from_scores(-5, -1, 1, -1)
    xs = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 60))) for _ in range(20)]
    ys = [x[: rng.randint(1, len(x))] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9))) for x in xs]
    for mode in ("global", "semiglobal", "local"):
        whole = pairwise.align_batch(xs, ys, s, mode)
        banded = pairwise.align_banded(xs, ys, s, 5, 200, mode)
        assert [a.score for a in whole] == [b.score for b in banded]
    m = sparse.find_kmer_matches(xs[0], ys[0], 4)
    a = pairwise.align_with_matches(xs[0], ys[0], s, 4, 100, m, "semiglobal", mismatches=1, union=True)
    assert a.score == pairwise.align(xs[0], ys[0], s, "semiglobal").score
    picture = pairwise.show_band("ACGT", "ACT", pairwise.band_around([(0, 0)], 4, 3, 2, 1), pairwise.align("ACGT", "ACT", s, "global"))
    assert picture.count("\n") == 4 and picture[0] == picture[-1] == "\\" and "x" in picture
    assert pairwise.align_banded(["A" * 50], ["A" * 50], s, 5, 10, "global", max_cells=10)[0].ops == ""


def test_models_trained_together():
    """As trained one by one."""
    rng = random.Random(9)
    for end in (None, [0.1, 0.2, 0.3]):
        m = hmm.Discrete([[0.6, 0.3, 0.1], [0.2, 0.5, 0.3], [0.1, 0.1, 0.8]], [[0.7, 0.2, 0.1], [0.1, 0.6, 0.3], [0.3, 0.3, 0.4]], [0.5, 0.3, 0.2], end)
        groups = [[[rng.randint(-1, 2) for _ in range(rng.choice([2, 7, 8, 9, 40, 300]))] for _ in range(n)] for n in (0, 1, 3, 6, 6, 2)] + [[[-1, -1, -1], [0, 1, 2, 1]]]
        for group, (got, history) in zip(groups, hmm.train_batch(m, groups, 1e-2, 5)):
            want, steps = hmm.train(m, group, 1e-2, 5) if group else (m, [])
            assert history == pytest.approx(steps, nan_ok=True)
            for name in ("transition", "emission", "initial", "end"):
                assert end is None and name == "end" or np.allclose(getattr(got, name), getattr(want, name), atol=1e-9, equal_nan=True), name
    with pytest.raises(ValueError):
        hmm.train_batch(m, [[[]]])
    assert [i for i, _ in pairs._several(enumerate(groups), lambda g: [len(x) for x in g])] == list(range(len(groups)))


def brute_homopolymer(x, y, p):
    """Sum over all alignments of the 14-state model in exact fractions, cell by cell."""
    from fractions import Fraction as Q

    hx, hy, hxe, hye = ([Q(v) for v in p.per_base(k)] for k in ("hop_x", "hop_y", "hop_x_extend", "hop_y_extend"))
    gx, gy, gxe, gye, sub = (Q(v) for v in (p.gap_x, p.gap_y, p.gap_x_extend, p.gap_y_extend, p.substitution))
    into = [1 - gx - gy - sum(hx) / 4 - sum(hy) / 4] * 4 + [1 - gxe, 1 - gye] + [1 - v for v in hx] + [1 - v for v in hy]
    f = {}
    for i in range(len(x) + 1):
        f[i, 0] = [Q(1, 2) if i == 0 else Q(1, 4)] * 4 + [Q(0)] * 10
        for j in range(1, len(y) + 1):
            if i == 0:
                f[i, j] = [Q(0)] * 14
                continue
            corner, up, left = f[i - 1, j - 1], f[i, j - 1], f[i - 1, j]
            before = sum(a * b for a, b in zip(corner, into))
            cells = [(1 - sub if x[i - 1] == y[j - 1] else sub / 6) * before if b in (x[i - 1], y[j - 1]) else Q(0) for b in "ACGT"]
            cells += [(1 - sub) * (gx * sum(up[:4]) + gxe * up[4]), (1 - sub) * (gy * sum(left[:4]) + gye * left[5])]
            cells += [hx[k] * up[k] + hxe[k] * up[6 + k] for k in range(4)] + [hy[k] * left[k] + hye[k] * left[10 + k] for k in range(4)]
            f[i, j] = cells
    end = sum(sum(f[i, len(y)]) for i in range(1, len(x) + 1))
    return min(0.0, math.log(end.numerator) - math.log(end.denominator)) if end else -np.inf


def test_homopolymer_model_is_exact_and_not_slow():
    """Every kind of hop is summed as 14 states are; the model takes less time than three states in logs."""
    rng = random.Random(12)
    draw = lambda n, a="ACGT": "".join(rng.choices(a, k=n))
    one = pairhmm.PairModel(hop_x=1e-5, hop_y=1e-5, hop_x_extend=0.1, hop_y_extend=0.1)
    each = pairhmm.PairModel(0.01, 0.02, 0.1, 0.2, 0.05, hop_x=(0.01, 0.02, 0.01, 0.03), hop_y=(0.01, 0.0, 0.01, 0.03), hop_x_extend=(0.1, 0.2, 0.1, 0.3), hop_y_extend=0.2)
    for p in (one, each):
        xs, ys = ([draw(rng.randint(1, 9), "ACGTN") for _ in range(25)] for _ in range(2))
        assert pairhmm.homopolymer_probability(xs, ys, p) == pytest.approx([brute_homopolymer(x, y, p) for x, y in zip(xs, ys)], rel=1e-9)
    # the start unlike the reads' first half, then the reverse: no one scale fits a row
    x, y = draw(150), draw(150)
    xs, ys = [x + y, "A" * 280, x + y], [y + x, "C" * 280, x + y]
    got = pairhmm.homopolymer_probability(xs, ys, one)
    assert np.isfinite(got).all() and got[1] == pytest.approx(-648.28513244) and got[2] > -1
    xs, ys = ([draw(220) for _ in range(40)] for _ in range(2))
    took = []
    for f in (pairhmm.pair_probability, pairhmm.homopolymer_probability):
        began = time.process_time()
        f(xs, ys, one)
        took.append(time.process_time() - began)
    assert took[1] < took[0]
