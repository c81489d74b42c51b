import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm.language import BACKING, TEMPER, fit, identify, trigrams, visible
from tests.llm.helpers import AWKWARD, reports, rows_of

WORDS = {
    "en": "the worker entered a confined space without gas test and with no permit on the site of this tank".split(),
    "de": "der Arbeiter betrat den engen Raum ohne Gasmessung und mit keiner Erlaubnis auf dem Gelände dieses Tanks".split(),
    "fr": "le travailleur est entré dans un espace confiné sans mesure de gaz et avec aucune autorisation sur le site".split(),
}


def sample(n, seed, length=40):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        lang = draw.choice(list(WORDS))
        rows.append((k, " ".join(draw.choices(WORDS[lang], k=length)), f"{lang}.example.org", lang, None))
    return rows


def identified(spark, rows, train, **options):
    return {r.report_id: r for r in identify(reports(spark, rows), reports(spark, train), list(WORDS), **options).collect()}


def test_held_out_accuracy(spark):
    rows = sample(300, 2, length=6)
    got = identified(spark, rows, sample(200, 1))
    assert sum(got[r[0]].lang == r[3] for r in rows) >= 0.97 * len(rows)
    assert all(got[r[0]].accepted for r in rows)
    small = identified(spark, rows, sample(2000, 1), sample=100)
    assert sum(small[r[0]].lang == r[3] for r in rows) >= 0.9 * len(rows)


def test_other_evidence_decides_where_the_text_does_not(spark):
    rows = [(k, " ".join(WORDS["de"]), None, None, f"http://www.werk{k % 9}.de/{k}") for k in range(60)]
    rows += [(100 + k, " ".join(WORDS["fr"]), None, None, f"http://usine.example.fr/{k}") for k in range(60)]
    rows += [(200 + k, f'<html lang="fr"><p>{" ".join(WORDS["fr"])}</p></html>', None, None, f"http://x{k}.example.net/") for k in range(60)]
    rows += [(1, "123"), (500, "o", None, None, "http://www.werk1.de/o"), (501, "o", None, None, "http://usine.example.fr/o"),
             (502, '<html lang="fr"><body>o</body></html>', None, None, None), (503, "o", None, None, "http://new.werk.de/")]
    rows = [r for r in rows if r[0] != 1] + [(1, "123", None, None, None)]
    got = identified(spark, rows, sample(200, 1), least=0.3)
    assert got[500].lang == got[503].lang == "de" and got[501].lang == got[502].lang == "fr"
    assert got[1].lang == "und" and got[1].accepted is False
    assert got[502].declared == "fr" and got[500].host == "www.werk1.de"


def test_markup():
    text, declared = visible('<!DOCTYPE html><HTML dir="ltr" lang=DE-at><script>var x="<p>the</p>"</script><!-- the --><p>K&ouml;rper</p>')
    assert declared == "de" and text.split() == ["Körper"]
    assert visible("3 < 4 and a > b") == ("3 < 4 and a > b", None)


def test_awkward_rows(spark):
    found = identify(reports(spark, AWKWARD), reports(spark, sample(60, 1) + AWKWARD), list(WORDS))
    got = rows_of(found, "report_id", "lang", "accepted")
    assert len(got) == len(AWKWARD)
    for i, lang, accepted in got:
        assert (lang == "und") == (not accepted) == (i in (2, 3, 4) or (i is None and not accepted))
    assert {r[2] for r in rows_of(identify(reports(spark, AWKWARD), reports(spark, []), []), "report_id", "lang", "accepted")} == {None}
    assert len(rows_of(identify(reports(spark, AWKWARD), reports(spark, []), list(WORDS)))) == len(AWKWARD)
    assert rows_of(identify(reports(spark, []), reports(spark, []), list(WORDS))) == []


def test_confidence_is_a_probability(spark):
    assert identify(reports(spark, sample(50, 3)), reports(spark, sample(50, 1)), list(WORDS)).filter(~F.col("confidence").between(0.33, 1)).isEmpty()


#: A few sentences each, so that the model meets most trigrams of the language.
FOREIGN = {
    "it": "Il lavoratore è entrato in uno spazio confinato senza misurare il gas e senza alcuna autorizzazione del responsabile",
    "nl": "De werknemer betrad een besloten ruimte zonder gasmeting en zonder vergunning op het terrein van deze fabriek",
    "pl": "Pracownik wszedł do przestrzeni zamkniętej bez pomiaru gazu i bez zezwolenia na terenie zakładu produkcyjnego",
    "ru": "Рабочий вошёл в замкнутое пространство без проверки газа и без разрешения на этом участке",
    "zh": "工人在没有气体检测的情况下进入了密闭空间而且没有任何许可证明文件",
    "pt": "O trabalhador entrou em um espaço confinado sem medição de gás e sem nenhuma autorização no local da obra",
    "tr": "İşçi gaz ölçümü yapılmadan ve izin alınmadan bu sahadaki kapalı alana girdi ve hemen bayıldı",
    "fi": "Työntekijä meni suljettuun tilaan ilman kaasumittausta ja ilman lupaa tällä alueella eilen illalla",
}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_other_languages_and_noise_are_rejected(spark, folder):
    """The model of the given documents: texts of eight other languages, random letters and random consonants go, its own languages stay."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("report_id"), F.col("text").alias("report_text"), "source", "lang", F.lit(None).cast("string").alias("source_file_path"))
    draw = random.Random(7)
    noise = ["".join(draw.choices(letters, k=200)) for letters in ("bcdfghjklmnpqrstvwxz ", "abcdefghijklmnopqrstuvwxyz ") for _ in range(5)]
    strange = [(k, t, None, None, None) for k, t in enumerate([*FOREIGN.values(), *noise])]
    languages = ("de", "en", "es", "fr")
    found = identify(reports(spark, strange, clash=False), documents, languages).collect()
    assert not [r for r in found if r.accepted] and {r.lang for r in found} == {"und"}
    own = identify(documents, documents, languages).join(documents.select("report_id", "report_text", F.col("lang").alias("said")), "report_id")
    long = own.filter(F.length("report_text") > 100)
    assert long.filter("not accepted").count() <= 0.002 * long.count()


def plain(rows, table, languages):
    """The fusion in plain Python: (report_id, lang, confidence) of every report with letters."""
    seen, sums = [], {k: defaultdict(lambda: np.zeros(len(languages))) for k in ("all", "suffix", "domain", "host", "declared", "declaring")}
    for i, text, source, _, address in rows:
        text, declared = visible(text or "")
        codes = [c for block in trigrams(text) for c in block]
        if not codes:
            continue
        score = table[codes].sum(axis=0, dtype=np.float64)
        score = TEMPER * (score - score.max())
        share = np.exp(score) / np.exp(score).sum()
        host = address.split("//")[1].split("/")[0].split(":")[0].lower() if address and "://" in address else source
        labels = (host or "").split(".")
        domain, suffix = (".".join(labels[-2:]), labels[-1]) if host and len(labels) > 1 else (host, "")
        keys = {"all": 0, "suffix": suffix if host else None, "domain": (suffix, domain) if host else None, "host": host, "declared": declared, "declaring": 0 if declared else None}
        for level, key in keys.items():
            if key is not None:
                sums[level][key] += share
        # All shares under the same suffix count, those of reports without a host too.
        if not host:
            sums["suffix"][""] += share
        seen.append((i, score, share, keys))
    out = []
    for i, score, share, keys in seen:
        others = lambda level: np.maximum(0, sums[level][keys[level]] - share) if keys[level] is not None else np.zeros(len(languages))
        base = others("all")
        prior = (base + 1) / (base.sum() + len(languages))
        for level in ("suffix", "domain", "host"):
            parts = others(level)
            prior = (parts + BACKING * prior) / (parts.sum() + BACKING)
        points = score + np.log(prior)
        if keys["declared"]:
            points = points + np.log((others("declared") + 0.5) / (others("declaring") + 0.5 * (len(languages) + 1)))
        weight = np.exp(points - points.max())
        out.append((i, languages[int(points.argmax())], 1 / weight.sum()))
    return out


def test_fusion_equals_brute_force(spark):
    draw, languages = random.Random(11), list(WORDS)
    rows = []
    for k in range(120):
        lang = draw.choice(languages)
        text = " ".join(draw.choices(WORDS[lang], k=draw.randint(0, 3)))
        if draw.random() < 0.3:
            text = f'<html lang="{draw.choice(languages + ["xx"])}"><p>{text}</p></html>'
        host = draw.choice([None, "http://www.werk.de/x", "http://usine.example.fr:80/", "https://shop.example.org/a", "http://intranet/x", "http://other.example.org/"])
        rows.append((k, text, draw.choice([None, "app", "mail.example.org"]), None, host))
    train = sample(80, 5)
    table = fit(reports(spark, train), languages)
    got = {r.report_id: (r.lang, r.confidence) for r in identify(reports(spark, rows), reports(spark, train), languages, least=0.0).collect()}
    for i, lang, confidence in plain(rows, table, languages):
        assert math.isclose(got[i][1], confidence, rel_tol=1e-6), i
        assert got[i][0] in (lang, "und")
    assert sum(got[i][0] == lang for i, lang, _ in plain(rows, table, languages)) > 80
