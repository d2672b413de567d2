"""Problem 10: missing or wrong language labels, by language-bitmask n-gram filters.

One table of slots holds a Bloom filter for every language side by side: bit ``l`` of a slot belongs to language ``l``,
and the AND over an n-gram's slots is the set of all languages that contain it. For a word the bits of its n-grams of 3
and 4 letters are counted by language; each count is corrected by the share of slots that are set by chance, and the
languages whose corrected count is complete enough and largest keep the word. A text's counts are the words kept by
each language; the largest decides, and the confidence is its lead over the next one as a share of both.

The languages are those of the samples of certain language, of which at most ``fit_rows`` are taken. Filters of the
samples alone decide the paragraphs of all documents first; the words of clear ones are counted by language over the
whole corpus, and those that are frequent enough in a language, and not far more so in another, widen its filter. Then all
documents, whole texts and all paragraphs are labelled.

A document without numbered paragraphs is cut into sentences, and these are put together into its segments of one
language by the cheapest path: a change of language costs ``SWITCH`` words.

Defined results: a null or empty text, or one without a known word, has a null language and confidence 0 and is never
reported as wrong; a paragraph without a known word takes the document's language; ties go to the language with more
words in the document, then by name; null ids and repeated rows are kept, each row on its own; an empty table gives no
rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize

SLOTS, HASHES, KEEP_SHARE = 1 << 17, 2, 0.8
#: Samples of certain language that are taken, those of the smallest hash.
FIT_ROWS = 10_000
#: Paragraphs of a language that must hold a word, in any one form, at least and as a share of all: a filter has at most the mean paragraph's words / MIN_SHARE.
MIN_COUNT, MIN_SHARE = 3, 2e-4
#: Least confidence of a clear paragraph.
CLEAR = 0.18
#: Words that a change of language within a text without numbers must gain.
SWITCH = 6
#: Usual codes and names of languages, in lower case and without accents. Any other language is named by its code.
NAMES = {
    "en": ["en", "eng", "english", "anglais", "ingles", "inglese", "englisch", "engels"],
    "fr": ["fr", "fra", "fre", "french", "francais", "frances", "francese", "franzosisch", "frans"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "aleman", "tedesco", "alemao", "duits"],
    "es": ["es", "spa", "spanish", "espanol", "castellano", "castilian", "espagnol", "spagnolo", "spanisch", "espanhol", "spaans"],
    "it": ["it", "ita", "italian", "italiano", "italien", "italienisch", "italiaans"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish", "vlaams", "neerlandais", "holandes", "olandese", "niederlandisch"],
    "pt": ["pt", "por", "portuguese", "portugues", "portugais", "portoghese", "portugiesisch", "portugees"],
    "sv": ["sv", "swe", "swedish", "svenska"],
    "da": ["da", "dan", "danish", "dansk"],
    "no": ["no", "nor", "nb", "nn", "norwegian", "norsk"],
    "fi": ["fi", "fin", "finnish", "suomi"],
    "pl": ["pl", "pol", "polish", "polski"],
    "cs": ["cs", "ces", "cze", "czech", "cestina"],
    "ro": ["ro", "ron", "rum", "romanian", "romana"],
    "hu": ["hu", "hun", "hungarian", "magyar"],
    "tr": ["tr", "tur", "turkish", "turkce"],
    "ca": ["ca", "cat", "catalan", "catala"],
    "la": ["la", "lat", "latin"],
}
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKER = re.compile(r"^[ \t]*(?:(\()(\d+)\)|(\[)(\d+)\]|(§) ?(\d+)(?=\s)|()(\d+)([).]?))(?=[ \t]+\S|[ \t]*$)", re.M)
_PAGE = re.compile(r"^.*—\s+\S+\s+\d+\s+\S+\s+\d+\s*$", re.M)
#: What a paragraph begins with that a wrapped line after a bare number does not.
_BEGIN = re.compile(r"[ \t]+(?:[*█…]|[(\[][^\d\s]|[^\W\d_a-zß-öø-ÿ])")
_END = tuple(".?!:;)]\"»”’…█*")
_SENTENCE = re.compile(r"(?:[^.!?;\n]|[.!?;](?!\s))*(?:[.!?;]+\s+|\n\s*|$)")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def words_in(chunk: str) -> list[str]:
    return [w.lower() for w in _LETTERS.findall(chunk if chunk.isascii() else fold(chunk))]


def label_language(c: Column | str, langs: list[str] | None = None) -> Column:
    """The language a label names, whatever its case, blanks and region; null where it names none that is known.

    ``langs``: codes that are known beside those with names.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = F.translate(F.lower(F.trim(c)), "àáâãäçèéêëìíîïñòóôõöùúûü", "aaaaaceeeeiiiinooooouuuu")
    head = F.element_at(F.split(plain, r"[-_ (,;./]"), 1)
    out = F.lit(None).cast("string")
    for lang, names in ({l: [l.lower()] for l in langs or []} | NAMES).items():
        out = F.when(head.isin(names), lang).otherwise(out)
    return out


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(number, text) of the numbered paragraphs: the longest chain 1, 2, 3, ... of markers in one style.

    A marker stands at the start of a line. A bare number counts only after a blank line, the end of a sentence or a page
    header, or where what follows looks like the beginning of a paragraph.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    chains: dict[tuple, list[tuple[int, int, int]]] = {}
    for m in _MARKER.finditer(text):
        g = m.groups()
        style = (g[0], g[2], g[4], g[8])
        number = int((g[1] or g[3] or g[5] or g[7])[:9])
        chain = chains.setdefault(style, [])
        if number != len(chain) + 1:
            continue
        before = text[: m.start()].rstrip(" \t")
        if chain and not before.endswith("\n\n"):
            line = before.rstrip("\n").rpartition("\n")[2].rstrip()
            if not any(style) and not line.endswith(_END) and not _PAGE.match(line) and not _BEGIN.match(text, m.end()):
                continue
        chain.append((number, m.start(), m.end()))
    best = max(chains.values(), key=len, default=[])
    ends = [s for _, s, _ in best[1:]] + [len(text)]
    return [(k, _PAGE.sub("", text[e:end])) for (k, _, e), end in zip(best, ends)]


def sentences(text: str) -> list[tuple[int, int]]:
    """The spans of a text's sentences and lines, without those that are blank."""
    return [m.span() for m in _SENTENCE.finditer(text) if m.group().strip()]


def segments(votes: np.ndarray, switch: float = SWITCH) -> list[tuple[int, int, int]]:
    """(first, end, language number) of the segments of a sequence of units, from their votes: the path that keeps most words, less ``switch`` a change."""
    n, size = len(votes), votes.shape[1] - 1
    score, back = votes[0, :size].astype(float), np.zeros((n, size), np.int64)
    for t in range(1, n):
        top = int(score.argmax())
        stay = score >= score[top] - switch
        back[t] = np.where(stay, np.arange(size), top)
        score = np.where(stay, score, score[top] - switch) + votes[t, :size]
    path = [int(score.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    path = np.array(path[::-1])
    cut = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1, [n]))
    return [(int(a), int(b), int(path[a])) for a, b in zip(cut, cut[1:])]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of all n-grams of 3 and 4 letters of the words, their edges included."""
    raw = ("\1" + "\1\1".join(words) + "\1").encode("utf-32-le")
    c = np.frombuffer(raw, np.uint32).astype(np.uint64)
    word = np.cumsum(np.concatenate(([False], (c[1:] == 1) & (c[:-1] == 1))))
    rows, out = [], []
    for n in (3, 4):
        at = np.arange(len(c) - n + 1)
        at = at[word[at] == word[at + n - 1]]
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ c[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        rows.append(word[at])
        out.append(h)
    return np.concatenate(rows), np.concatenate(out)


class Filters:
    """Bit-sliced Bloom filters, one bit of each slot for each language."""

    def __init__(self, langs: list[str], slots: int = SLOTS, hashes: int = HASHES):
        self.langs, self.slots, self.hashes = langs, slots, hashes
        if len(langs) > 64:
            raise ValueError("at most 64 languages")
        self.table = np.zeros(slots, np.uint64)
        self.chance = np.zeros(len(langs))

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(20 * k)) ^ (h >> np.uint64(51))) & np.uint64(self.slots - 1)

    def add(self, lang: str, words: list[str]) -> None:
        if words:
            bit = np.uint64(1 << self.langs.index(lang))
            h = _grams(words)[1]
            for k in range(self.hashes):
                np.bitwise_or.at(self.table, self._slot(h, k), bit)

    def seal(self) -> None:
        for i in range(len(self.langs)):
            self.chance[i] = ((self.table >> np.uint64(i)) & np.uint64(1)).mean() ** self.hashes

    def masks(self, words: list[str]) -> np.ndarray:
        """For each word the set of languages that keep it."""
        if not words:
            return np.zeros(0, np.uint64)
        word, h = _grams(words)
        held = self.table[self._slot(h, 0)]
        for k in range(1, self.hashes):
            held &= self.table[self._slot(h, k)]
        n = np.bincount(word, minlength=len(words))
        share = np.empty((len(self.langs), len(words)))
        for i, chance in enumerate(self.chance):
            hits = np.bincount(word, weights=((held >> np.uint64(i)) & np.uint64(1)).astype(float), minlength=len(words))
            share[i] = (hits / np.maximum(n, 1) - chance) / (1 - chance)
        top = share.max(0)
        out = np.zeros(len(words), np.uint64)
        for i in range(len(self.langs)):
            out |= ((share[i] >= KEEP_SHARE) & (share[i] >= top - 1e-9)).astype(np.uint64) << np.uint64(i)
        return out


class Voter:
    """Votes of the chunks between white space, each of which has a number; the n-grams of unseen ones are looked up together."""

    def __init__(self, filters: Filters, keep: int = 400_000):
        self.filters, self.keep = filters, keep
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.mask = np.zeros(0, np.uint64)

    def full(self) -> bool:
        return len(self.number) > self.keep

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the chunk) for every chunk of the texts."""
        chunks = [t.split() for t in texts]
        new = [c for c in set().union(*chunks) if c not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            mask = np.zeros(len(new), np.uint64)
            words, owner = [], []
            for i, c in enumerate(new):
                for w in words_in(c):
                    words.append(w)
                    owner.append(i)
            if words:
                # of a chunk of several words the longest decides
                m, o = self.filters.masks(words), np.array(owner)
                order = np.lexsort((np.array([len(w) for w in words]), o))
                mask[o[order]] = m[order] | np.uint64(1 << 63)
            self.mask = np.concatenate((self.mask, mask))
        sizes = [len(cs) for cs in chunks]
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(chunks)), np.int64, sum(sizes))
        return np.repeat(np.arange(len(texts)), sizes), flat

    def count(self, row: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """Texts x languages: how many chunks of each text each language keeps; the last column counts chunks with letters."""
        size = len(self.filters.langs)
        flat = self.mask[number]
        out = np.zeros((n, size + 1), np.int64)
        for i in [*range(size), 63]:
            out[:, min(i, size)] = np.bincount(row[((flat >> np.uint64(i)) & np.uint64(1)).astype(bool)], minlength=n)
        return out

    def votes(self, texts: list[str]) -> np.ndarray:
        if self.full():
            self.forget()
        return self.count(*self.numbers(texts), len(texts))


def decide(votes: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, confidence) by row; ``prior`` breaks ties, then the order of the languages."""
    size = votes.shape[1] - 1
    v = votes[:, :size].astype(float)
    if prior is not None:
        v = v + prior * 1e-6 / (1 + prior.max(1, keepdims=True))
    best = v.argmax(1)
    r = np.arange(len(v))
    top = votes[r, best].astype(float)
    rest = v.copy()
    rest[r, best] = -1
    second = np.maximum(rest.max(1), 0) if size > 1 else np.zeros(len(v))
    second = np.floor(second + 0.5)
    confidence = np.round(np.where(top > 0, (top - second) / np.maximum(top + second, 1), 0), 4)
    return np.where(top > 0, best, -1), np.clip(confidence, 0, 1)


def fit(samples: list[tuple[str, str]], more: dict[str, list[str]] | None = None, slots: int = SLOTS) -> Filters:
    """Filters from (language, text) samples, and from further words by language."""
    langs = sorted({l for l, t in samples if l and t})
    words = {l: set((more or {}).get(l, ())) for l in langs}
    for l, t in samples:
        if l and t:
            words[l].update(_LETTERS.findall(fold(t)))
    out = Filters(langs, slots)
    for l in langs:
        out.add(l, sorted(words[l]))
    out.seal()
    return out


class WordCounts:
    """By language, in how many clear paragraphs each chunk stands, for the chunks that a voter knows."""

    def __init__(self, filters: Filters):
        self.voter, self.total = Voter(filters), np.zeros(len(filters.langs), np.int64)
        self.seen = np.zeros((len(filters.langs), 0), np.int64)

    def add(self, texts: list[str | None]) -> None:
        pars = [p for t in texts if t for _, p in paragraphs(t)]
        if not pars:
            return
        row, number = self.voter.numbers(pars)
        lang, sure = decide(self.voter.count(row, number, len(pars)))
        lang = np.where(sure >= CLEAR, lang, -1)
        self.total += np.bincount(lang[lang >= 0], minlength=len(self.total))
        size = len(self.voter.number)
        self.seen = np.pad(self.seen, ((0, 0), (0, size - self.seen.shape[1])))
        once = np.unique((row * size + number)[lang[row] >= 0])
        np.add.at(self.seen, (lang[once // size], once % size), 1)

    def take(self) -> Counter:
        """Counts by (word, language number), those of all paragraphs under a word of None; nothing is kept."""
        out = Counter({(None, l): int(n) for l, n in enumerate(self.total) if n})
        chunks = list(self.voter.number)
        for l, c in zip(*np.nonzero(self.seen)):
            for w in set(words_in(chunks[c])):
                out[w, int(l)] += int(self.seen[l, c])
        self.__init__(self.voter.filters)
        return out


def frequent_words(docs: DataFrame, text_col: str, first: Filters) -> dict[str, list[str]]:
    """By language the words of clear paragraphs, counted over all documents, that speak for it.

    Counts are summed up by the workers first. What comes back is bounded by MIN_SHARE: each word stands in at least that
    share of the language's clear paragraphs.
    """
    held = docs.sparkSession.sparkContext.broadcast(first)

    def count(batches):
        counts = WordCounts(held.value)

        def batch():
            found = counts.take()
            word, lang = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(lang, pa.int32()), pa.array(found.values(), pa.int64())], ["word", "lang", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                counts.add(b.column(0).slice(at, 256).to_pylist())
                if counts.voter.full():
                    yield batch()
        yield batch()

    rows = materialize(docs.select(text_col).mapInArrow(count, "word string, lang int, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n")), "p10-words")
    total = {r.lang: r.n for r in rows.filter("word is null").collect()}  # one row for each language
    if not total:
        return {}
    of = F.create_map(*[F.lit(x) for l, n in total.items() for x in (l, float(n))])[F.col("lang")]
    share = rows.filter("word is not null").select("word", "lang", "n", (F.col("n") / of).alias("share"))
    top = share.groupBy("word").agg(F.max("share").alias("top"))
    often = share.filter((F.col("n") >= MIN_COUNT) & (F.col("share") >= MIN_SHARE))
    kept = often.join(top, "word").filter(F.col("share") >= 0.1 * F.col("top")).select("lang", "word").toArrow()
    out = defaultdict(list)
    for l, w in zip(kept.column("lang").to_pylist(), kept.column("word").to_pylist()):
        out[first.langs[l]].append(w)
    return out


def fit_filters(docs: DataFrame, samples: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> Filters:
    pairs = samples.filter("lang is not null and text is not null").select("lang", "text").orderBy(F.xxhash64("lang", "text")).limit(fit_rows).toArrow()
    known = list(zip(pairs.column("lang").to_pylist(), pairs.column("text").to_pylist()))
    return fit(known, frequent_words(docs, text_col, fit(known)))


def label_segments(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, rows: int = 256) -> DataFrame:
    """(doc_id, par_no, lang, confidence, n_words, doc_lang, label_lang, seg_start, seg_end), for each row of ``docs``.

    par_no 0 is the document, k > 0 the paragraph numbered k. In a document without numbers -1, -2, ... are its segments
    from the first to the last, where it has more than one language; they have their places in the text.
    """
    found = fit_filters(docs, samples, text_col, fit_rows)
    filters = docs.sparkSession.sparkContext.broadcast(found)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        f = filters.value
        voter = Voter(f)
        names = pa.array([*f.langs, None], pa.string())
        n = len(f.langs)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                doc, no, texts, spans = [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    t = t or ""
                    units = [(k, p, None) for k, p in paragraphs(t)] or [(-1, t[x:y], (x, y)) for x, y in sentences(t)] or [(-1, t, (0, 0))]
                    for k, p, span in units:
                        doc.append(i)
                        no.append(k)
                        texts.append(p)
                        spans.append(span)
                doc, no = np.array(doc, np.int64), np.array(no, np.int64)
                votes = voter.votes(texts)
                per_doc = np.zeros((part.num_rows, votes.shape[1]), np.int64)
                np.add.at(per_doc, doc, votes)
                numbered = no > 0
                lang, sure = decide(votes, per_doc[doc, :-1])
                ballots = np.zeros_like(per_doc)
                np.add.at(ballots, (doc[(lang >= 0) & numbered], lang[(lang >= 0) & numbered]), 1)
                free = np.flatnonzero(np.bincount(doc[~numbered], minlength=part.num_rows))
                ballots[free] = per_doc[free]
                main, _ = decide(ballots, per_doc[:, :-1])
                r = np.arange(part.num_rows)
                share = np.where(main >= 0, per_doc[r, main] / np.maximum(per_doc[:, :-1].max(1), 1), 0)
                _, lead = decide(per_doc)
                out = [(int(i), 0, int(main[i]), float(c), int(w), None) for i, c, w in zip(r, np.round(share * lead, 4), per_doc[:, -1])]
                lang = np.where(lang < 0, main[doc], lang)
                out += zip(doc[numbered].tolist(), no[numbered].tolist(), lang[numbered].tolist(), sure[numbered].tolist(), votes[numbered, -1].tolist(), [None] * int(numbered.sum()))
                for i in free:
                    unit = np.flatnonzero(doc == i)
                    found_ = segments(votes[unit])
                    for k, (x, y, l) in enumerate(found_ if len(found_) > 1 else [], 1):
                        own = votes[unit[x:y]].sum(0, keepdims=True)
                        out.append((int(i), -k, l, float(decide(own)[1][0]), int(own[0, -1]), (spans[unit[x]][0], spans[unit[y - 1]][1])))
                rec, par, got, conf, words, place = zip(*out)
                rec, got = np.array(rec), np.array(got)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rec)),
                        pa.array(par, pa.int64()),
                        names.take(pa.array(np.where(got < 0, n, got))),
                        pa.array(conf, pa.float64()),
                        pa.array(words, pa.int64()),
                        names.take(pa.array(np.where(main[rec] < 0, n, main[rec]))),
                        part.column(2).take(pa.array(rec)),
                        *(pa.array([None if x is None else x[k] for x in place], pa.int64()) for k in (0, 1)),
                    ],
                    ["doc_id", "par_no", "lang", "confidence", "n_words", "doc_lang", "label_lang", "seg_start", "seg_end"],
                )

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), label_language(lang_col, found.langs).alias("label_lang"))
    return src.mapInArrow(run, f"doc_id {id_type}, par_no bigint, lang string, confidence double, n_words bigint, doc_lang string, label_lang string, seg_start bigint, seg_end bigint")


def mislabelled(segments: DataFrame) -> DataFrame:
    """Rows of ``label_segments`` that differ: documents whose label does not name their language, paragraphs in another one."""
    doc = (F.col("par_no") == 0) & F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("label_lang"))
    return segments.filter(doc | ((F.col("par_no") > 0) & (F.col("lang") != F.col("doc_lang"))))
