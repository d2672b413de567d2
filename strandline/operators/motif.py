"""Position weight matrices as long relations: counts, weights, information, consensus, scanning."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How a nucleotide code counts for A, T, G, C; the order decides ties.
DNA_MONOS = "ATGC"
DNA_CODES = {"A": "A", "T": "T", "G": "G", "C": "C", "M": "AC", "R": "AG", "W": "AT", "S": "GC", "Y": "TC", "K": "TG", "V": "AGC", "H": "ATC", "D": "ATG", "B": "TGC", "N": "ATGC"}
SHARE = {1: 1.0, 2: 0.5, 3: 0.333, 4: 0.25}
PROTEIN_MONOS = "ARNDCEQGHILKMFPSTWYV"
PSEUDO = 0.5
#: Motifs that one scan holds in its tasks; more are taken in groups, each a pass over the texts.
MAX_MOTIFS = 10_000


class Kind:
    def __init__(self, name: str, monos: str, codes: dict[str, str], bits: float):
        self.name, self.monos, self.codes, self.bits = name, monos, codes, bits

    def weights(self) -> list[tuple[str, str, float]]:
        """(code, mono, what one occurrence of the code adds to the mono)."""
        return [(c, m, SHARE.get(len(ms), 1.0 / len(ms))) for c, ms in self.codes.items() for m in ms]


DNA = Kind("dna", DNA_MONOS, DNA_CODES, 2.0)
PROTEIN = Kind("protein", PROTEIN_MONOS, {m: m for m in PROTEIN_MONOS} | {"X": PROTEIN_MONOS}, math.log2(20))


def weight_matrix(seqs: DataFrame, motif_col: str, seq_col: str, kind: Kind = DNA, pseudos: dict[str, float] | None = None) -> DataFrame:
    """(motif, pos, mono, weight): normalised weights. Sequences of unequal length, codes that are not known and wrong pseudo counts are errors; a motif without sequences has no rows."""
    pseudos = pseudos if pseudos is not None else {m: PSEUDO for m in kind.monos}
    if set(pseudos) != set(kind.monos):
        raise ValueError(f"pseudo counts are needed for exactly {len(kind.monos)} monomers")
    spark = seqs.sparkSession
    s = seqs.select(F.col(motif_col).alias("motif"), F.col(seq_col).alias("seq"))
    sizes = s.groupBy("motif").agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"))
    length = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("motif sequences are of inconsistent length")).cast("int"))
    base = F.array(*[F.struct(F.lit(m).alias("mono"), F.lit(i).alias("idx"), F.lit(float(pseudos[m])).alias("pseudo")) for i, m in enumerate(kind.monos)])
    grid = sizes.select("motif", length.alias("n")).filter("n > 0").select("motif", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    grid = grid.select("motif", "pos", F.inline(base))
    codes = s.select("motif", F.posexplode(F.filter(F.split("seq", ""), lambda x: x != "")).alias("pos", "code")).groupBy("motif", "pos", "code").agg(F.count("*").alias("n"))
    known = spark.createDataFrame(kind.weights(), "code string, mono string, share double")
    checked = codes.withColumn("code", F.when(F.col("code").isin(*kind.codes), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("invalid monomer: "), F.col("code"))).cast("string")))
    counts = checked.join(F.broadcast(known), "code").groupBy("motif", "pos", "mono").agg(F.sum(F.col("n") * F.col("share")).alias("c"))
    full = grid.join(counts, ["motif", "pos", "mono"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)) + F.col("pseudo"))
    total = F.sum("c").over(Window.partitionBy("motif", "pos"))
    return full.select("motif", "pos", "mono", "idx", F.when(total > 0, F.col("c") / total).otherwise(0.0).alias("weight"))


def information(weights: DataFrame, kind: Kind = DNA) -> DataFrame:
    """(motif, bits): bits per position less the entropy, summed."""
    ent = F.when(F.col("weight") > 0, -F.col("weight") * F.log2("weight")).otherwise(0.0)
    return weights.groupBy("motif").agg((F.countDistinct("pos") * kind.bits - F.sum(ent)).alias("bits"))


def score_range(weights: DataFrame) -> DataFrame:
    """(motif, min_score, max_score, n)."""
    per = weights.groupBy("motif", "pos").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    return per.groupBy("motif").agg(F.sum("lo").alias("min_score"), F.sum("hi").alias("max_score"), F.count("*").alias("n"))


def consensus(weights: DataFrame, kind: Kind = DNA) -> DataFrame:
    """(motif, consensus): a dominant monomer, else a code of two, else of three, else N (proteins: X)."""
    top = F.reverse(F.array_sort(F.collect_list(F.struct("weight", "idx", "mono"))))
    per = weights.groupBy("motif", "pos").agg(top.alias("t"))
    w = lambda i: F.col("t")[i]["weight"]
    m = lambda i: F.col("t")[i]["mono"]
    sym = F.when((w(0) > 0.5) & (w(0) > 2 * w(1)), m(0))
    if kind.name == "dna":
        by_set = {"".join(sorted(v)): k for k, v in kind.codes.items()}
        code = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in by_set.items() for x in p]), F.array_join(F.array_sort(c), ""))
        sym = sym.when(w(0) + w(1) > 0.75, code(F.array(m(0), m(1)))).when(w(3) < 1e-5, code(F.array(m(0), m(1), m(2)))).otherwise("N")
    else:
        sym = sym.otherwise("X")
    one = per.select("motif", "pos", sym.alias("sym"))
    return one.groupBy("motif").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]), "").alias("consensus"))


def best_window(texts: DataFrame, id_col: str, seq_col: str, weights: DataFrame, kind: Kind = DNA, skip: bool = False) -> DataFrame:
    """(id, motif, loc, sum, score): the best window of each text for each motif, the leftmost of ties; ``score`` is
    scaled to 0..1 by the motif's range. A symbol that is no monomer, a text shorter than a motif and a motif whose
    range is empty are errors; with ``skip`` windows that hold such a symbol are passed over, and a text without any
    window gives no row.

    A motif is small (positions x monomers), so each is one array of scores; texts are scanned in place, with no
    explosion into windows.
    """
    rows = weights.groupBy("motif").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx", "weight"))), lambda x: x["weight"]).alias("w"), (F.max("pos") + 1).alias("n"))
    rows = rows.join(score_range(weights).select("motif", "min_score", "max_score"), "motif")
    k = len(kind.monos)
    t = texts.select(F.col(id_col).alias("id"), F.upper(F.col(seq_col)).alias("seq"))
    import numpy as np
    import pyarrow as pa

    lut = np.full(256, 255, np.uint8)
    for i, c in enumerate(kind.monos.encode()):
        lut[c] = i
    def run(batches, held):
        for b in batches:
            ids, names, loc, tot, score = [], [], [], [], []
            for i, s in enumerate(b.column(1).to_pylist()):
                if s is None:
                    continue
                code = lut[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
                wrong = np.concatenate(([0], np.cumsum(code == 255)))
                if wrong[-1] and not skip:
                    raise ValueError(f"invalid monomer: {s[int(np.argmax(code == 255))]!r}")
                for name, w, lo, hi in held:
                    n = len(w)
                    if len(code) < n:
                        if skip:
                            continue
                        raise ValueError(f"the query ({len(code)}) is shorter than the motif ({n})")
                    if abs(hi - lo) < 1e-12:
                        raise ValueError("the motif has no information")
                    sums = np.zeros(len(code) - n + 1)
                    for j in range(n):
                        sums += w[j][np.minimum(code[j : j + len(sums)], k - 1)]
                    if wrong[-1]:
                        sums[wrong[n:] > wrong[:-n]] = -np.inf
                    at = int(np.argmax(np.round(sums, 12)))
                    if sums[at] == -np.inf:
                        continue
                    ids.append(i)
                    names.append(name)
                    loc.append(at)
                    tot.append(float(sums[at]))
                    score.append(float((sums[at] - lo) / (hi - lo)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(names, pa.string()), pa.array(loc, pa.int64()), pa.array(tot, pa.float64()), pa.array(score, pa.float64())], ["id", "motif", "loc", "raw", "score"])

    kind_of = texts.schema[id_col].dataType.simpleString()
    schema = f"id {kind_of}, motif string, loc bigint, raw double, score double"
    out, group = None, []
    for r in itertools.chain(rows.toLocalIterator(), [None]):
        if r is not None:
            group.append((r.motif, np.array(r.w).reshape(r.n, k), r.min_score, r.max_score))
        if group and (r is None or len(group) == MAX_MOTIFS):
            found = t.mapInArrow(functools.partial(run, held=group), schema)
            out, group = found if out is None else out.unionByName(found), []
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)
