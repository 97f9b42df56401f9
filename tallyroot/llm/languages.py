"""Missing or wrong language labels: Bayesian fusion of text, declared label, address suffix and host.

Each sentence has a likelihood under every language: a naive Bayes over character n-grams of
its words, fitted on a bounded sample of labelled rows, its temperature on sentences held out
of it. A document is a chain of sentences that seldom changes its language. The chain begins
in a language by the prior of the document's host, by the label it declares and by the suffix
of its address, and goes on in another by the host's prior; the most likely chain gives the
segments. A host's prior is smoothed by that of the whole corpus, which is smoothed by the
uniform one; how far labels and suffixes can be trusted is counted too. All of these counts are
grouped aggregations over all documents.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroot.work import Workspace

# Codes (ISO 639-1, 639-2) and names of the languages, in English and their own spelling.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "sv": "sv swe swedish svenska",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
}
# Address suffixes that speak for a language.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "pt": "pt", "br": "pt", "it": "it", "nl": "nl", "se": "sv", "pl": "pl", "ru": "ru"}

#: Labelled documents that the likelihoods are fitted on, at most, and characters of each, at a place given by its hash.
SAMPLE_DOCS, SAMPLE_CHARS = 6_000, 16_000
BUCKETS = 1 << 17
WORD_BITS = 1 << 20
MEMORY = 400_000
#: Cost of a change of language from one sentence to the next, besides the new language's prior.
SWITCH = 4.0
#: n-grams of one word are not independent: their log likelihoods count by a factor that is
#: fitted, on beginnings of so many words, of held-out sentences.
TEMPERS, SHORT = (0.05, 0.1, 0.2, 0.3, 0.4, 0.6), 3
#: A word's evidence is its mean per letter, times its letters up to so many.
WORD_LETTERS = 16
#: A word is known if one language uses it at least so many times as often as the mean of all (0.8 times their number, if that is less).
SPECIFIC = 2.5
#: Documents that a host's, the corpus's and a label's counts are smoothed by.
HOST_STRENGTH, CORPUS_STRENGTH, LABEL_STRENGTH = 20.0, 10.0, 20.0
#: Before counting: labels and address suffixes that name a document's own language.
LABEL_RIGHT, SUFFIX_RIGHT = 0.8, 0.5
HOST_SALTS = 16
MOST_LANGUAGES = 200

SENTENCE = regex.compile(r"""(?<=[\p{L}\p{N})\]"'”’»][.!?…]["'”’»)]*)\s+|[\r\n  \x0b\x0c\x85]+""")
#: Code between fences is no sentence.
FENCED = regex.compile(r"^[ \t]*(```|~~~).*?^[ \t]*\1[^\S\n]*$", regex.M | regex.S)
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
CODE = regex.compile(r"</?[^<>\s][^<>\n]{0,200}>|\[[\w ]{1,24}\]|[\p{L}]*\p{N}[\p{L}\p{N}_-]*|\S*(?:://|@)\S*")


def declared(label: Column) -> Column:
    """The code of a label in any customary spelling, with or without a country; null if it names none of the languages."""
    word = F.regexp_extract(F.lower(F.regexp_replace(label, r"^[\s ]+", "")), r"^([\p{L}]+)", 1)
    pairs = [x for code, names in NAMES.items() for name in names.split() for x in (F.lit(name), F.lit(code))]
    return F.when(F.length(word) > 0, F.create_map(*pairs)[word])


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text that hold anything but white space."""
    if "```" in text or "~~~" in text:
        text = FENCED.sub(lambda m: "\n" * len(m[0]), text)
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


_ascii_words = re.compile(r"[a-z]+(?:'[a-z]+)*")
_digit = re.compile(r"\d")


def words(sentence: str) -> list[str]:
    if not sentence.isascii() and not unicodedata.is_normalized("NFC", sentence):
        sentence = unicodedata.normalize("NFC", sentence)
    # Marks that code, tags, references and addresses cannot be without.
    if "<" in sentence or "[" in sentence or "@" in sentence or "://" in sentence or _digit.search(sentence):
        sentence = CODE.sub(" ", sentence)
    low = sentence.lower()
    return (_ascii_words if low.isascii() else WORD).findall(low)


def _grams(word: str) -> list[int]:
    """Buckets of the word's n-grams."""
    w = f"_{word}_"
    out = [zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    return out + [zlib.crc32(f"#{w}".encode()) % BUCKETS]


class Model:
    """Log likelihoods of n-gram buckets for each language, and which words were seen in the sample."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.table = np.zeros((BUCKETS, len(langs)), dtype="float32")
        self.seen = np.zeros(WORD_BITS, dtype=bool)
        self.temper = 0.4
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.letters = 0
        self.vectors = np.zeros((1024, len(self.langs)), dtype="float32")
        self.known = np.zeros(1024, dtype=bool)

    def __getstate__(self):
        return {"langs": self.langs, "table": self.table, "seen": self.seen, "temper": self.temper}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def fit(self, counted: dict[int, Counter]) -> None:
        """counted: words with their numbers for each language's index."""
        counts = np.zeros((BUCKETS, len(self.langs)))
        total: dict[str, np.ndarray] = {}
        for lang, c in counted.items():
            for word, n in c.items():
                np.add.at(counts[:, lang], _grams(word), n)
                total.setdefault(word, np.zeros(len(self.langs)))[lang] += n
        rates = (counts + 0.05) / (counts.sum(axis=0) + 0.05 * BUCKETS)
        self.table = np.log(rates).astype("float32")
        sizes = np.array([max(1, sum(counted.get(i, {}).values())) for i in range(len(self.langs))])
        for word, n in total.items():
            # Words that are as usual in all languages are names, units or code, and speak for none.
            rate = n / sizes
            if n.sum() > 2 and rate.max() >= min(SPECIFIC, 0.8 * len(self.langs)) * rate.mean():
                self.seen[zlib.crc32(word.encode()) % WORD_BITS] = True
        self._forget()

    def _evidence(self, word: str) -> np.ndarray:
        v = self.table[_grams(word)].sum(axis=0)
        return (v - v.max()) * (self.temper * min(1.0, WORD_LETTERS / len(word)))

    def _row(self, word: str) -> int:
        row = self.at.get(word)
        if row is None:
            row = self.at[word] = len(self.at)
            self.letters += len(word)
            if row == len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.vectors[row] = self._evidence(word)
            self.known[row] = len(word) > 1 and self.seen[zlib.crc32(word.encode()) % WORD_BITS]
        return row

    def score(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence its log likelihoods, and whether it is in any language at all.

        A sentence is in a language if at least three of its words, and two in five, are known
        words of more than one letter.
        """
        if len(self.at) > MEMORY or self.letters > 32 * MEMORY:
            self._forget()
        sizes = np.array([len(p) for p in parts], dtype="int64")
        out = np.zeros((len(parts), len(self.langs)), dtype="float32")
        share = np.zeros(len(parts))
        flat = np.array([self._row(w) for p in parts for w in p], dtype="int64")
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] = np.add.reduceat(self.vectors[flat], starts)
            share[full] = np.add.reduceat(self.known[flat].astype("int64"), starts)
        return out, (share >= 3) & (share * 5 >= sizes * 2)


def fit(sample: list[tuple[str, str]], langs: list[str]) -> Model:
    """The model of (label, text) rows. Fitted twice: the second time without the sentences that contradict their label."""
    at = {code: i for i, code in enumerate(langs)}
    rows = [(at[label], words(text[a:b])) for label, text in sample if label in at and text for a, b in sentences(text)]
    model = Model(langs)
    keep = np.ones(len(rows), dtype=bool)
    held = np.arange(len(rows)) % 5 == 0
    for turn in range(3):
        # The temperature comes from a model that has not seen the held-out sentences.
        counted: dict[int, Counter] = {i: Counter() for i in at.values()}
        for i, (lang, ws) in enumerate(rows):
            if keep[i] and not (turn == 1 and held[i]):
                counted[lang].update(ws)
        temper = model.temper
        model = Model(langs)
        model.temper = temper
        model.fit(counted)
        if rows and turn == 0:
            scores, real = model.score([ws for _, ws in rows])
            keep = real & (scores.argmax(axis=1) == np.array([lang for lang, _ in rows]))
        if rows and turn == 1 and held.any():
            model.temper = best_temper(model, [row for row, out in zip(rows, held) if out])
    return model


def best_temper(model: Model, rows: list[tuple[int, list[str]]]) -> float:
    """The factor under which the labels of the rows' beginnings are the most likely, if some labels are wrong."""
    short = [(lang, ws[:SHORT]) for lang, ws in rows if ws]
    if not short:
        return model.temper
    scores = model.score([ws for _, ws in short])[0].astype("float64") / model.temper
    right = np.array([lang for lang, _ in short])
    best = []
    for t in TEMPERS:
        p = np.exp(scores * t)
        p = (p / p.sum(axis=1, keepdims=True))[np.arange(len(right)), right]
        best.append((max(float(np.log((1 - e) * p + e / len(model.langs)).sum()) for e in (0.02, 0.05, 0.1, 0.2)), t))
    model._forget()
    return max(best)[1]


def chain(scores: np.ndarray, first: np.ndarray | None = None, enter: np.ndarray | None = None, switch: float = SWITCH) -> np.ndarray:
    """The most likely language of each sentence (Viterbi).

    first: log evidence for the language of the first sentence; enter: the same for a language
    that a later one changes to, at the cost of `switch`.
    """
    n, k = scores.shape
    total = scores[0] + (0 if first is None else first)
    enter = np.zeros(k) if enter is None else enter
    best = scores.argmax(axis=1)
    if (best == total.argmax()).all():
        return best  # every sentence, and what is known besides, agrees
    back = np.zeros((n, k), dtype="int64")
    for i in range(1, n):
        top = int(total.argmax())
        come = total[top] - switch + enter
        stay = total >= come
        back[i] = np.where(stay, np.arange(k), top)
        total = np.where(stay, total, come) + scores[i]
    out = np.zeros(n, dtype="int64")
    out[-1] = int(total.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


SCORED = "doc_id long, host string, label string, stated boolean, suffix string, main int, starts array<int>, stops array<int>, full array<boolean>, ll array<float>"
SEGMENTS = "doc_id long, label string, stated boolean, seg int, start int, stop int, sentences int, lang string, confidence double"


def _score(shared):
    """Each document's sentences with words and their likelihoods; main: its language by its text alone, -1 without a full sentence."""

    def run(batches):
        model: Model = shared.value
        for frame in batches:
            docs = [t if isinstance(t, str) else "" for t in frame["text"]]
            spans = [sentences(t) for t in docs]
            parts = [words(t[a:b]) for t, s in zip(docs, spans) for a, b in s]
            scores, real = model.score(parts)
            some = np.array([bool(p) for p in parts], dtype=bool)
            out, at = {c: [] for c in ("main", "starts", "stops", "full", "ll")}, 0
            for span in spans:
                to = at + len(span)
                ok = np.flatnonzero(some[at:to])
                own, full = scores[at:to][ok], real[at:to][ok]
                out["main"].append(int(own[full].sum(axis=0).argmax()) if full.any() else -1)
                out["starts"].append([span[i][0] for i in ok])
                out["stops"].append([span[i][1] for i in ok])
                out["full"].append(full.tolist())
                out["ll"].append(own.ravel())
                at = to
            yield pd.concat([frame.drop(columns="text"), pd.DataFrame(out)], axis=1)

    return run


def _fuse(langs: list[str], labels: dict, suffixes: dict):
    k = len(langs)

    def run(batches):
        for frame in batches:
            rows = []
            for key, label, stated, suffix, prior, starts, stops, full, ll in zip(frame["doc_id"], frame["label"], frame["stated"], frame["suffix"], frame["prior"], frame["starts"], frame["stops"], frame["full"], frame["ll"]):
                enter = np.asarray(prior, dtype="float64")
                first = enter + labels[(label or "", bool(stated))] + suffixes[suffix or ""]
                scores, full = np.asarray(ll, dtype="float64").reshape(-1, k), np.asarray(full, dtype=bool)
                path = chain(scores, first, enter) if len(scores) else np.array([first.argmax()])
                for i, group in enumerate(np.split(np.arange(len(path)), np.flatnonzero(np.diff(path)) + 1)):
                    post = (scores[group].sum(axis=0) if len(scores) else 0) + (enter if i else first)
                    sure = 1 / np.exp(post - post[path[group[0]]]).sum()
                    place = (int(starts[group[0]]), int(stops[group[-1]]), int(full[group].sum())) if len(scores) else (0, 0, 0)
                    rows.append((key, label, stated, i, *place, langs[path[group[0]]], round(float(sure), 6)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return run


def _trust(counts: dict, said: list, named, langs: list[str], right: float) -> dict:
    """For each value that is said, the log probability of it under each language, from counts by (value, language)."""
    k, out = len(langs), {}
    per = [sum(counts.get((v, i), 0) for v in said) for i in range(k)]
    total = max(sum(counts.values()), 1)
    for v in said:
        share = sum(counts.get((v, i), 0) for i in range(k)) / total
        rest = share if named(v) is None else (1 - right) / k
        before = [right if named(v) == langs[i] else rest for i in range(k)]
        out[v] = np.log([(counts.get((v, i), 0) + LABEL_STRENGTH * max(before[i], 1e-3)) / (per[i] + LABEL_STRENGTH) for i in range(k)])
    return out


def languages(docs: DataFrame, codes: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", host: str = "source", address: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, label, stated, seg, start, stop, sentences, lang, confidence): the language of every document and segment.

    A segment is a run of sentences in one language, as characters start to stop of the text;
    sentences: how many of them are full ones, with three known words or more. label: the declared label
    as a code, null if it names none of the languages; stated: whether it names any. confidence:
    posterior probability of the segment's language, from the text's likelihood, the host's
    prior and, in a document's first segment, the declared label and the address suffix. A
    document without words (null, blank, code) is one segment without place and sentences, whose
    language is that of its label, host and suffix. `codes`: the languages to tell apart, more
    than MOST_LANGUAGES are refused.

    The likelihoods are fitted on at most `sample_docs` labelled rows, chosen by a hash of the
    key, and SAMPLE_CHARS characters of each; counts of hosts, labels and suffixes are taken over
    all documents. Repeated rows are each a document. Extra columns are not read. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "languages")
    langs = sorted({r[0] for r in codes.select("code").where("code is not null").limit(MOST_LANGUAGES + 1).collect()})
    if len(langs) > MOST_LANGUAGES:
        raise ValueError("too many languages")
    suffix = F.lit(None).cast("string")
    if address:
        ending = F.regexp_extract(F.lower(F.col(address)), r"^(?:\w+://)?[^/:?#]*\.([a-z]{2,})(?:[/:?#]|$)", 1)
        suffix = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[ending]
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.when(declared(F.col(label)).isin(langs), declared(F.col(label))).alias("label"), declared(F.col(label)).isNotNull().alias("stated"), F.when(suffix.isin(langs), suffix).alias("suffix"))
    labelled = base.where("label is not null and text is not null and doc_id is not null")
    n = labelled.select("doc_id").count()
    part = min(1.0, 1.2 * sample_docs / max(n, 1))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(part * 1_000_003) + 1
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    chosen = labelled.where(pick).select("label", F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("t"), F.xxhash64("doc_id").alias("h"), "doc_id")
    sample = [(r.label, r.t) for r in chosen.orderBy("h", "doc_id").limit(sample_docs).select("label", "t").collect()]
    shared = spark.sparkContext.broadcast(fit(sample, langs))  # 2^17 floats a language, whatever the corpus
    scored = work.keep(base.mapInPandas(_score(shared), SCORED))

    k = len(langs)
    counted = work.keep(scored.where("main >= 0").groupBy("host", "label", "stated", "suffix", "main").agg(F.count("*").alias("n")))
    overall = dict(counted.groupBy("main").agg(F.sum("n")).collect())  # one row a language
    by_label = {((r[0] or "", r[1]), r[2]): r[3] for r in counted.groupBy("label", "stated", "main").agg(F.sum("n")).collect()}  # k * (k + 2) rows at most
    by_suffix = {(r[0] or "", r[1]): r[2] for r in counted.groupBy("suffix", "main").agg(F.sum("n")).collect()}
    labels = _trust(by_label, [("", False), ("", True), *[(x, True) for x in langs]], lambda v: v[0] or None, langs, LABEL_RIGHT)
    suffixes = _trust(by_suffix, ["", *langs], lambda v: v or None, langs, SUFFIX_RIGHT)
    total = sum(overall.values())
    corpus = [(overall.get(i, 0) + CORPUS_STRENGTH / k) / (total + CORPUS_STRENGTH) for i in range(k)]
    sums = [F.sum(F.when(F.col("main") == i, F.col("n")).otherwise(0)) for i in range(k)]
    prior = counted.groupBy("host").agg(F.sum("n").alias("n"), F.array(*sums).alias("c"))
    smooth = F.array(*map(F.lit, corpus))
    prior = prior.select("host", F.transform("c", lambda c, i: F.log((c + F.lit(HOST_STRENGTH) * F.element_at(smooth, i + 1)) / (F.col("n") + F.lit(HOST_STRENGTH)))).alias("prior"))
    # A host may hold a large part of the rows: its documents are spread, its one prior row is repeated.
    prior = prior.withColumn("salt", F.explode(F.array(*map(F.lit, range(HOST_SALTS)))))
    joined = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.size("ll")), F.lit(HOST_SALTS)).cast("int")).join(prior, ["host", "salt"], "left")
    known = joined.select("doc_id", "label", "stated", "suffix", F.coalesce("prior", F.array(*[F.lit(float(np.log(p))) for p in corpus])).alias("prior"), "starts", "stops", "full", "ll")
    return known.mapInPandas(_fuse(langs, labels, suffixes), SEGMENTS)


def mislabelled(segments: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of documents whose label is missing or wrong, or whose text is mixed.

    A language is one of the text's if a segment in it has a full sentence.
    """
    docs = segments.where("sentences > 0").groupBy("doc_id").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.max("label").alias("label"))
    case = (F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label"))
    return docs.where(F.coalesce(case, F.lit(True))).select("doc_id", F.explode("langs").alias("lang"))
