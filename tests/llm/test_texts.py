"""Problems 8, 9 and 10 against brute force, exact round trips and held-out text, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import containers, languages, leakage

SCHEMA = "doc_id bigint, text string, lang string, size int, salt int, rank int, item_id int, h int, n_tokens int"
DATA = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, 1, 2, 3, 4, 5, 6) for i, t, l in rows], SCHEMA)


# problem 8


def test_chunk_counts_equal_the_tokenizer():
    counter = containers.TokenCounter(containers.TOKENIZER, keep=50)
    texts = [r[0] for r in duckdb.sql(f"select text from '{DATA}/documents.parquet' limit 300").fetchall()]
    texts += ["", " ", "a  b", " a", "a ", "a\n b", "a\tb c", "don't 'll x's", "it 's", " x y", "x 　y", "é ü", "█ █", "a\x1cb c", "12 345, 6"]
    for t in texts:
        assert counter.count(t) == len(counter.encode(t)), repr(t)


def placed(plan, capacity):
    fill, where = Counter(), Counter()
    for size, a, b, base, per in plan:
        for r in range(a, b):
            fill[base + (r - a) // per] += size
            where[size, r] += 1
    assert all(v == 1 for v in where.values()) and all(v <= capacity for v in fill.values())
    return fill, Counter(s for s, _ in where)


def test_plan_places_every_item_once():
    rng = random.Random(1)
    for capacity in (10, 37, 100):
        for _ in range(40):
            counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 20))}
            plan = containers.pack_plan(counts, capacity)
            fill, got = placed(plan, capacity)
            assert got == Counter(counts)
            total = sum(s * n for s, n in counts.items())
            assert len(fill) <= max(2 * total / capacity + 1, 1)
            assert sorted(fill) == list(range(len(fill)))


def test_plan_takes_exact_complements():
    for counts in ({60: 5, 40: 5}, {50: 4, 30: 4, 20: 4}, {40: 3, 30: 3, 20: 3, 10: 3}):
        fill, _ = placed(containers.pack_plan(counts, 100), 100)
        assert set(fill.values()) == {100}
    with pytest.raises(ValueError):
        containers.pack_plan({101: 1}, 100)


def test_fill_containers(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["court", "seller", "goods", "the"]) for _ in range(rng.choice([1, 3, 10, 40, 64, 65, 200]))), None) for i in range(200)]
    rows += [(500, None, None), (501, "", None), (502, rows[0][1], None), (502, rows[0][1], None), (None, "court", None), (503, "goods " * 1000, None)]
    out = containers.fill_containers(table(spark, rows), capacity=64, per_salt=20).collect()
    counter = containers.TokenCounter(containers.TOKENIZER)
    fill, per, starts = Counter(), Counter(), defaultdict(list)
    for r in out:
        if r.container_id >= 0:
            fill[r.container_id] += r.n_tokens
        per[r.doc_id] += r.n_tokens
        starts[r.doc_id].append((r.tok_start, r.n_tokens))
    want = Counter()
    for i, t, _ in rows:
        want[i] += counter.count(t)
    assert +per == +want and max(fill.values()) <= 64
    for i, t, _ in rows:
        n = counter.count(t)
        if i == 502:
            continue
        if n <= 64:
            assert starts[i] == [(0, n)]
        else:
            assert [s for s, _ in sorted(starts[i])] == list(range(0, n, 64))
    assert len([r for r in out if r.doc_id in (500, 501) and r.container_id == -1]) == 2
    assert len(fill) * 64 < 1.1 * sum(per.values())
    assert containers.fill_containers(table(spark, [])).count() == 0


# problem 9


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute_leaks(docs, items, span=12):
    out = set()
    for i, t in docs:
        w = words(t)
        grams = {tuple(w[k : k + span]) for k in range(len(w) - span + 1)}
        for j, u in items:
            v = words(u)
            if any(tuple(v[k : k + span]) in grams for k in range(len(v) - span + 1)) and i is not None and j is not None:
                out.add((i, j))
    return out


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_leaks_match_brute_force(spark, block_words):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 13, 30])))) for j in range(25)] + [(90, None), (91, ""), (None, "w1 " * 20), (92, "w1 " * 14)]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 8, 12, 60, 300]))]
        if i % 3 == 0:
            v = words(rng.choice(items[:25])[1])
            a = rng.randrange(max(1, len(v) - 11))
            part = v[a : a + rng.choice([11, 12, 13, 20])]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in part]
        docs.append((i, rng.choice([" ", "\n", ", ", " — ", "_"]).join(w)))
    docs += [(200, None), (201, ""), (None, docs[0][1]), (202, "w1 " * 5000), (203, docs[3][1]), (203, docs[3][1])]
    d = table(spark, [(i, t, None) for i, t in docs])
    it = spark.createDataFrame([(j, t, 1) for j, t in items], "item_id bigint, text string, doc_id int")
    got = [(r.doc_id, r.item_id) for r in leakage.find_leaks(d, it, block_words=block_words, rows=16).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items)
    assert leakage.find_leaks(d, it.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), it).count() == 0


def test_shift_table():
    p = leakage.Patterns([(1, " ".join(f"a{i}" for i in range(20)))])
    assert sorted(p.shift.tolist(), reverse=True)[:9] == [9, 8, 7, 6, 5, 4, 3, 2, 1] and p.full == 10


# problem 10

EN = "The court held that the seller had not given notice of the defect within the time allowed."
FR = "La cour a jugé que le vendeur n'avait pas donné avis du défaut dans le délai imparti."
DE = "Das Gericht entschied, dass der Verkäufer den Mangel nicht innerhalb der gesetzten Frist angezeigt hatte."


def test_paragraphs():
    assert [k for k, _ in languages.paragraphs("Head\n\n1) One.\n\n2) Two, see\n3 of it.\n\n3) Three.")] == [1, 2, 3]
    t = "§ 1 One.\r\n\r\nCase X — page 2 of 3\r\n\r\n§ 2 Two.\r\n§ 3 Three."
    got = languages.paragraphs(t)
    assert [k for k, _ in got] == [1, 2, 3] and "page" not in got[0][1]
    assert [k for k, _ in languages.paragraphs("1 One (see OBC 3,\n2 (32)). More.\n2 Two.")] == [1, 2]
    assert languages.paragraphs("1 One (see OBC 3,\n2 (32)). More.\n2 Two.")[1][1].strip() == "Two."
    assert languages.paragraphs("") == [] and languages.paragraphs("no numbers") == []


def test_labels(spark):
    names = ["en", " EN", "en-GB", "English", "eng", "fr_BE", "Français", "DEU", "ger", "pt-BR", "xx", "", None, "n/a", "nederlands", "Español"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, lang string")
    got = [r.x for r in df.orderBy("i").select(languages.label_language("lang").alias("x")).collect()]
    assert got == ["en"] * 5 + ["fr"] * 2 + ["de"] * 2 + ["pt", None, None, None, None, "nl", "es"]


def test_masks_have_no_false_negatives():
    f = languages.Filters(["a", "b"], slots=1 << 12)
    f.add("a", ["alpha", "beta"])
    f.add("b", ["beta", "gamma"])
    f.seal()
    assert [int(m) & 3 for m in f.masks(["alpha", "beta", "gamma"])] == [1, 3, 2]


def test_segments(spark):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    en, fr, de = (" ".join(r[0] for r in duckdb.sql(f"select text from '{DATA}/lang_samples.parquet' where lang = '{l}' order by sample_id limit 3").fetchall()) for l in ("en", "fr", "de"))
    rows = [(1, f"Head\n\n1) {en}\n\n2) {fr}\n\n3) {en}", "fr"), (2, f"[1] {de}\n[2] {de}", "de-AT"), (3, None, "en"), (4, "", None), (5, "███ 12 ???", "en"), (6, fr, None), (6, fr, None), (None, f"1. {de}", "en"), (7, f"1. {en}\n\n2. {fr}", "en")]
    out = languages.label_segments(table(spark, rows), samples)
    got = Counter((r.doc_id, r.par_no, r.lang) for r in languages.mislabelled(out).collect())
    assert got[1, 0, "en"] == got[1, 2, "fr"] == 1 and got[6, 0, "fr"] == 2 and got[None, 0, "de"] == 1
    assert not [k for k in got if k[0] in (2, 3, 4, 5)]
    assert {r.par_no: r.lang for r in out.filter("doc_id = 7").collect()}[1] == "en"
    assert all(0 <= r.confidence <= 1 for r in out.collect())
    assert languages.label_segments(table(spark, []), samples).count() == 0


def test_segments_without_numbers(spark):
    samples = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    text = {l: " ".join(r[0] for r in duckdb.sql(f"select text from '{DATA}/lang_samples.parquet' where lang = '{l}' order by sample_id limit 4").fetchall()) for l in ("en", "fr")}
    rows = [(1, text["en"] + "\n" + text["fr"], "en"), (2, text["en"], "en"), (3, "", None), (4, f"{text['fr']} {text['en']} {text['fr']}", "fr")]
    out = languages.label_segments(table(spark, rows), samples)
    got = {i: [(r.lang, r.seg_start, r.seg_end) for r in out.filter(f"doc_id = {i} and par_no < 0").orderBy(F.desc("par_no")).collect()] for i in range(1, 5)}
    assert [l for l, _, _ in got[1]] == ["en", "fr"] and got[1][0][1] == 0 and got[1][1][2] == len(rows[0][1])
    assert abs(got[1][1][1] - len(text["en"]) - 1) < 3 and got[2] == got[3] == [] and [l for l, _, _ in got[4]] == ["fr", "en", "fr"]


def test_any_language_of_the_samples(spark):
    samples = spark.createDataFrame([("zz", "qorvex blanit drumpol skaven tirrel moqua"), ("yy", "halimo peshta grundel vicoma rasteny")], "lang string, text string")
    rows = [(1, "1) qorvex blanit drumpol skaven\n\n2) halimo peshta grundel vicoma\n\n3) tirrel moqua", "zz"), (2, "tirrel moqua qorvex", "YY-aa"), (3, "halimo peshta", "yy")]
    wrong = {(r.doc_id, r.par_no, r.lang) for r in languages.mislabelled(languages.label_segments(table(spark, rows), samples)).collect()}
    assert wrong == {(1, 2, "yy"), (2, 0, "zz")}


def test_containers_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, i, i, i]), "goods " * rng.choice([1, 3, 3, 3, 40, 70, 130]), None) for i in range(400)]
    got = [Counter(map(tuple, containers.fill_containers(table(spark, rows).repartition(n), capacity=64, per_salt=50).collect())) for n in (2, 7)]
    assert got[0] == got[1]


def test_leaks_with_other_ids(spark):
    t = " ".join(f"w{i}" for i in range(15))
    for kind, ids in (("string", ("a", "b")), ("int", (1, 2)), ("smallint", (1, 2))):
        d = spark.createDataFrame([(ids[0], t), (ids[1], "x")], f"doc_id {kind}, text string")
        it = spark.createDataFrame([(ids[1], "Yes, " + t)], f"item_id {kind}, text string")
        assert [tuple(r) for r in leakage.find_leaks(d, it).collect()] == [(ids[0], ids[1], 4)]


def test_held_out_accuracy():
    """Fitted without half of the samples' sentences, the filters tell the other half's languages."""
    rows = duckdb.sql(f"select lang, text from '{DATA}/lang_samples.parquet' order by sample_id").fetchall()
    docs = [r[0] for r in duckdb.sql(f"select text from '{DATA}/documents.parquet' order by hash(doc_id) limit 400").fetchall()]
    by = defaultdict(list)
    for l, t in rows:
        by[l].append(t)
    known = [(l, t) for l, ts in by.items() for t in ts[::2]]
    first = languages.fit(known)
    counts = languages.WordCounts(first)
    counts.add(docs)
    count = counts.take()
    total = {l: n for (w, l), n in count.items() if w is None}
    assert all(n > 0 for n in count.values()) and counts.take() == Counter()
    f = languages.fit(known, {first.langs[l]: [w for (w, k), n in count.items() if w and k == l and n >= 3 and n / total[l] >= 0.1 * max(count[w, j] / total[j] for j in total)] for l in total})
    held = [(l, t) for l, ts in by.items() for t in ts[1::2]]
    got, _ = languages.decide(languages.Voter(f).votes([t for _, t in held]))
    assert sum(f.langs[g] == l for g, (l, _) in zip(got, held) if g >= 0) >= 0.97 * len(held)
