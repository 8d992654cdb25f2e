"""Language, quality, secrets and personal data: held-out accuracy, exact base spans, edge cases."""

import random
import re
import time
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import langid, pii, quality, secrets

G = random.Random(9)
SYLLABLES = {"aa": ["tha", "ing", "er", "ound"], "bb": ["que", "eau", "é", "ou"], "cc": ["sch", "ung", "ß", "ver"]}


def words(lang, n):
    return " ".join("".join(G.choices(SYLLABLES[lang], k=G.randint(1, 3))) for _ in range(n))


LANG = [(i, words(lang, G.randint(5, 60)), lang, "x") for i, lang in enumerate(G.choices(list(SYLLABLES), k=240))]


def test_languages(spark):
    extra = [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "12 34 ?!", "bb", "x"), (None, words("aa", 30), "aa", "x"), (903, words("bb", 20), None, "x"), (904, words("cc", 60_000), "cc", "x"), (0, LANG[0][1], LANG[0][2], "x")]
    df = spark.createDataFrame(LANG + extra, "doc_id long, text string, lang string, score string")
    model = langid.train(df.where(langid.may_learn()))
    got = langid.predict(df, model).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert len(got) == len(LANG) + len(extra)
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (900, 901, 902))
    real = [r for r in got if r.lang and r.doc_id not in (900, 901, 902)]
    assert np.mean([r.lang == r.lang_pred for r in real if r.held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_no_language_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.train(df)).first().lang_pred == "und"
    assert langid.predict(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_every_language_gives_its_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "ftrl", lambda examples, n: seen.extend(e[2] for e in examples) or np.zeros((langid.BUCKETS + 1, n)))
    monkeypatch.setattr(langid, "temperature", lambda z, y: seen.extend(y.tolist()) or 1.0)
    rows = [(i, "abc", f"l{i % 11:02}") for i in range(6600)] + [(7000 + i, "xyz", "rare") for i in range(3)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert np.bincount(seen).tolist() == [600] * 11 + [3]


def test_ngrams_in_pieces(monkeypatch):
    text = words("bb", 400)
    whole = np.sort(np.concatenate(list(langid.ngrams(text))))
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (np.sort(np.concatenate(list(langid.ngrams(text)))) == whole).all()


def test_ftrl_is_sparse():
    examples = [(np.array([k % 5, 9]), np.array([1.0, 1.0]), int(k % 5 > 2)) for k in range(200)]
    w = langid.ftrl(examples, 2, l1=0.5, size=20)
    assert (w[10:20] == 0).all() and all((w[k] + w[-1] + w[9]).argmax() == (k > 2) for k in range(5))


def test_quality(spark):
    good = [(i, words("aa", G.randint(0, 80)), 1) for i in range(200)]
    bad = [(i, " ".join(w + G.choice(["###", " |", "$$$"]) for w in words("aa", G.randint(3, 80)).split()), 0) for i in range(200, 400)]
    rows = good + bad
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (900, None), (901, "w " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(5, None), (None, 1), (12345, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels.where(langid.may_learn()))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], q) for i, t, q in rows if langid_held(i) and len(t.split()) > 3]
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.95
    one = quality.train(docs, labels.where("quality = 1"))
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


def langid_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 3 == 1


def test_word_vectors_do_not_depend_on_the_deal(spark):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in LANG], "doc_id long, text string")
    assert (quality.context(docs.repartition(1)) == quality.context(docs.repartition(7))).all()


# ---- secrets ----

_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
_ASSIGN = re.compile(rf"""({_KEY}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(x):
    x = x or ""
    o = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(x) if len(m[2]) >= 6]
    o += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    o += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(o)]


def test_secrets(spark):
    pieces = ["token", "Secret", "api_key", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "é😀", "x", "-", "ſecret", "password"]
    rows = [(i, "".join(G.choices(pieces, k=G.randint(0, 25)))) for i in range(400)] + [(900, None), (901, ""), (902, " ".join(f"{i:024x}" for i in range(3000))), (None, "token=abcdefgh"), (1, "x")]
    plain = spark.createDataFrame([(i, words("aa", 60)) for i in range(30)], "doc_id long, text string")
    model = secrets.train(secrets.samples(plain))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, base string")
    got = secrets.find(df, model).select("doc_id", "text", "base", secrets.listed(F.col("secrets")).alias("s")).collect()
    assert len(got) == len(rows) and all(r.base == "clash" for r in got)
    for r in got:
        assert [x for x in r.s.split(",") if x and not x.startswith("markov")] == secret_base(r.text)
    text = "name Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg== then thaing_ounder_ingtha_1234 and thingerounding_42_ingthaer"
    s = secrets.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).select(secrets.listed(F.col("secrets"))).first()[0]
    assert s == f"markov:5:{5 + len('Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg==')}"


def test_secrets_without_samples(spark):
    model = secrets.train(spark.createDataFrame([(None, True), ("a", True)], "token string, random boolean"))
    df = spark.createDataFrame([(1, "Zm9vYmFyMTIzNDU2Nzg5MGFiY2RlZg")], "doc_id long, text string")
    assert secrets.find(df, model).first().secrets == []
    assert secrets.find(df.limit(0), model).count() == 0


# ---- personal data ----


def pii_base(x):
    o = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    o += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            o.append((m.start(), 2, m.end()))
    o += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(o)


def test_base_spans_equal_the_patterns():
    for _ in range(20_000):
        x = "".join(G.choice("ab@..+-123456789 ()é") for _ in range(G.randrange(50)))
        assert pii.base(x) == pii_base(x)


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "@" * 300_000])
def test_long_texts_in_linear_time(text):
    start = time.time()
    pii.spans(text, pii.trained())
    assert time.time() - start < 60


def test_the_field_learns_and_decodes_jointly():
    f = pii.trained()
    right = wanted = extra = 0
    for text, spans in pii.generated(150, seed=77):
        got = {x[:3] for row in pii.stretches(text) for x in f.best(f.segments(text, row))}
        right, wanted, extra = right + len(got & set(spans)), wanted + len(spans), extra + len(got - set(spans))
    assert right >= 0.97 * wanted and extra <= 0.03 * wanted
    text = "write to ann (at) host.example.com or call 415-555-2671, version 1.2.3"
    assert {pii.KINDS[k] for _, k, _ in f.find(text, [])} >= {"email", "phone"}


@pytest.mark.parametrize("n", range(397, 402))
def test_entities_across_pieces_of_a_stretch(n):
    f, s = pii.trained(), "ann (at) host.example.com"
    text = "7 " * n + s + " 7" * 450 + " " + s
    assert len(pii.stretches(text)) == 1
    assert f.find(text, []) == [(2 * n, 0, 2 * n + len(s)), (len(text) - len(s), 0, len(text))]


def test_marginals_add_up():
    f = pii.trained()
    text = "mail ann@host.example.com from 192.0.2.1 now"
    for row in pii.stretches(text):
        segs = f.segments(text, row)
        for j in range(len(segs)):
            over = sum(p for end, _, p, _, first in f.marginals(segs) if first <= j <= end)
            assert abs(over - 1) < 1e-6


def test_masking(spark):
    rows = [(1, "mail ann@host.example.com or +1 (415) 555-2671."), (2, None), (3, ""), (1, "mail ann@host.example.com or +1 (415) 555-2671."), (None, "192.0.2.1")]
    got = pii.find(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")).collect()
    assert sorted(str(r.masked) for r in got) == sorted(["mail [EMAIL] or [PHONE]."] * 2 + ["None", "", "[IP]"])
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sha256(b"").hexdigest() == sha256(b"".join([])).hexdigest()
