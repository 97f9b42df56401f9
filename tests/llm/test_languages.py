"""Labels, segments and held-out accuracy on a small corpus of four languages."""

import random

import pytest
from pyspark.sql import functions as F

from tallyroot.llm import languages as lang

PARTS = {
    "en": (["the nightly index", "our review queue", "an archived folder", "the second attempt"], ["returns", "keeps", "compares", "replaces"], ["the wrong parent", "all postings of the folder", "the shared glossary"], ["by hand", "under heavy load", "after every restart"]),
    "de": (["der nächtliche Indexlauf", "die Warteschlange", "das alte Archiv", "der zweite Versuch"], ["liefert", "behält", "vergleicht", "ersetzt"], ["den falschen Eintrag", "alle Einträge des Ordners", "das gemeinsame Glossar"], ["von Hand", "am Ende der Woche", "nach jedem Neustart"]),
    "es": (["el índice nocturno", "la cola de revisión", "el viejo archivo", "el segundo intento"], ["devuelve", "conserva", "compara", "reemplaza"], ["el padre equivocado", "todas las entradas de la carpeta", "el glosario común"], ["a mano", "con mucha carga", "después de cada reinicio"]),
    "ru": (["ночной индекс", "очередь на проверку", "старый архив", "вторая попытка"], ["находит", "хранит", "сравнивает", "заменяет"], ["неверный узел", "все записи из папки", "общий словарь"], ["вручную", "под нагрузкой", "после каждого запуска"]),
}


def sentence(rnd, code):
    s = " ".join(rnd.choice(p) for p in PARTS[code]) + "."
    return s[0].upper() + s[1:]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    rows, truth = [], {}
    for i in range(400):
        code = rnd.choice(list(PARTS))
        text = " ".join(sentence(rnd, code) for _ in range(rnd.randrange(1, 6)))
        label, kind = rnd.choice([code.upper(), code, f"{code}-XX"]), rnd.random()
        if kind < 0.08:
            label = rnd.choice([None, "", "und", " - ", "mul"])
            truth[i] = {code}
        elif kind < 0.16:
            label = rnd.choice([c for c in PARTS if c != code])
            truth[i] = {code}
        elif kind < 0.24:
            other = rnd.choice([c for c in PARTS if c != code])
            text += "\n\n" + sentence(rnd, other) + " " + sentence(rnd, other)
            truth[i] = {code, other}
        rows.append((i, text, label, rnd.choice(["hot", "hot", "hot", None, "s1"]), 1))
    rows += [(900, None, None, "hot", 1), (901, "", "en", "hot", 1), (902, "12 3.5; 99\n4", None, "hot", 1), (903, "a[3:9] += b[0]\n{}", None, "s1", 1), (None, sentence(rnd, "en"), None, "hot", 1)]
    return rows, truth


SCHEMA = "doc_id long, text string, lang string, source string, seg int"


def test_found(spark, corpus):
    rows, truth = corpus
    codes = spark.createDataFrame([(c,) for c in PARTS] + [(None,)], "code string")
    segments = lang.languages(spark.createDataFrame(rows, SCHEMA), codes)
    got = {}
    for r in lang.mislabelled(segments).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got.pop(None) == {"en"}
    assert got == truth
    # Documents without words get the language of their label and host, without a sentence.
    bare = {r.doc_id: r for r in segments.where("sentences = 0").collect()}
    assert set(bare) >= {900, 901, 902} and bare[901].lang == "en" and all(0 < r.confidence < 1 for r in bare.values())
    assert segments.where("sentences > 0 and (confidence < 0.5 or confidence > 1 or start >= stop)").count() == 0


def test_labels(spark):
    cases = {"en": "en", " EN_gb ": "en", "English": "en", "Deutsch (AT)": "de", "français": "fr", "ger": "de", "dut": "nl", "русский": "ru", "pt-BR": "pt", "": None, "und": None, "-": None, "n/a": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", lang.declared(F.col("v")).alias("x"))
    assert {r.v: r.x for r in df.collect()} == cases


def test_evidence(spark):
    """Texts that say nothing are decided by label, address suffix and host; and the confidence is the share of right ones."""
    rnd = random.Random(3)
    shared, rows, truth = ["radio hotel", "taxi hotel", "hotel taxi radio", "radio taxi"], [], {}
    for i in range(3000):
        host = rnd.choice(["hot", "hot", "half", "spanish"])
        code = "es" if rnd.random() < {"hot": 0.25, "half": 0.5, "spanish": 0.9}[host] else "de"
        words = [rnd.choice(shared) + " " + sentence(rnd, code)] * rnd.randrange(1, 3)
        plain = i % 3 == 0
        label = code if rnd.random() < 0.9 else "de" if code == "es" else "es"
        url = f"https://www.x{i}.{'es' if code == 'es' else 'de'}/a" if rnd.random() < 0.5 else "https://x.com/b.es" if i % 2 else None
        if plain:
            label, url = (label, None) if i % 2 else (None, url if i % 4 else None)
        rows.append((i, rnd.choice(shared) if plain else " ".join(words), label, host, url))
        if plain:
            truth[i] = code
    codes = spark.createDataFrame([(c,) for c in PARTS], "code string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string")
    got = {r.doc_id: r for r in lang.languages(docs, codes, address="url").collect() if r.doc_id in truth}
    assert set(got) == set(truth) and all(r.sentences == 0 for r in got.values())
    given = {r[0]: r for r in rows}
    right = lambda keys: sum(got[i].lang == truth[i] for i in keys) / len(keys)
    assert right([i for i in truth if given[i][2]]) > 0.85  # the label decides
    assert right([i for i in truth if given[i][4] and not given[i][4].startswith("https://x.com")]) > 0.95  # the suffix
    alone = [i for i in truth if given[i][2] is None and given[i][3] == "spanish" and (given[i][4] is None or given[i][4].startswith("https://x.com"))]
    assert {got[i].lang for i in alone} == {"es"}  # the host
    for low, high in ((0.45, 0.65), (0.65, 0.85), (0.85, 0.95), (0.95, 1.01)):
        group = [i for i in truth if low <= got[i].confidence < high]
        if len(group) >= 40:
            mean = sum(got[i].confidence for i in group) / len(group)
            assert abs(right(group) - mean) < 0.12, (low, len(group), mean, right(group))
    assert len({round(got[i].confidence, 2) for i in truth}) > 5


def test_long_words():
    model = lang.fit([("en", sentence(random.Random(i), "en")) for i in range(200)] + [("ru", sentence(random.Random(i), "ru")) for i in range(200)], ["en", "ru"])
    scores, real = model.score([["очередь" * 40], ["the" * 100]])
    assert scores.argmax(axis=1).tolist() == [1, 0] and not real.any() and abs(scores).max() < 400
    parts = [lang.words(t) for t in ("a <b>tag</b> [x] 12ab c@d.e https://f.g end", "cafe\u0301 noir")]
    assert parts == [["a", "tag", "end"], ["café", "noir"]]


def test_empty(spark):
    codes = spark.createDataFrame([("en",)], "code string")
    df = spark.createDataFrame([], SCHEMA)
    assert lang.mislabelled(lang.languages(df, codes)).count() == 0
    one = spark.createDataFrame([(1, "No label anywhere here.", None, None, 1)], SCHEMA)
    got = lang.languages(one, codes).collect()
    assert [(r.lang, r.confidence, r.sentences) for r in got] == [("en", 1.0, 0)]
