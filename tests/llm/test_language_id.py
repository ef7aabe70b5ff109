import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from recordkeep.llm.language_id import BUCKETS, LEAST, MOST, TextModel, accepted, fit_text_model, host_of, language_id, page_languages, suffix_of, visible

SYLLABLES = {"en": ["th", "er", "ing", "ou", "sh"], "fr": ["eau", "é", "qu", "oi", "ai"], "de": ["sch", "ä", "ung", "keit", "z"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def model():
    rng = random.Random(1)
    return TextModel.fit((text(x, 80, rng), x) for x in SYLLABLES for _ in range(10))


def test_text_model_held_out():
    rng, m = random.Random(2), model()
    for _ in range(60):
        for lang in SYLLABLES:
            n, ll = m.loglik(text(lang, 20, rng))
            assert n > 0 and m.languages[ll.argmax()] == lang
    assert m.loglik("")[0] == m.loglik("12 -- 34")[0] == 0
    assert visible("<p>a<br>b</p><script>var x='</p>'</script><!-- c -->&eacute;").split() == ["a", "b", "é"]


def test_addresses(spark):
    urls = [("https://www.a.example.com/fr/1?x=2", "www.a.example.com", "fr"), ("http://b.de", "b.de", "de"), ("http://u:p@c.example.org:80/other/en", "c.example.org", None), (None, "", None), ("junk", "", None), ("http://x.example.fr/en-GB/2", "x.example.fr", "en")]
    got = spark.createDataFrame([(u,) for u, *_ in urls], "url string").select(host_of(F.col("url")).alias("h"), suffix_of(F.col("url"), ["de", "en", "fr"]).alias("s")).collect()
    assert [(r.h, r.s) for r in got] == [(h, s) for _, h, s in urls]


def test_fusion(spark):
    """Text decides where there is enough; else the declared language, the suffix and the host do."""
    rng, m = random.Random(3), model()
    page = '<html lang="{}"><body><p>{}</p></body></html>'.format
    rows = [(i, f"http://h{x}.example.com/{x}/{i}", page(x, text(x, 60, rng))) for i, x in enumerate(["en", "fr", "de"] * 20)]
    rows += [
        (100, "http://hfr.example.com/p", "<html><body>77</body></html>"),
        (101, "http://hen.example.com/x", page("de", text("fr", 80, rng))),
        (102, "http://new.example.org/", page("de-AT", "")),
        (103, "http://new.example.org/fr", None),
        (104, None, None),
        (105, "http://hfr.example.com/p", "é " + "1" * 10),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, p0 string")
    got = {r.id: r for r in page_languages(df, m).collect()}
    assert all(got[i].lang == x for i, x in enumerate(["en", "fr", "de"] * 20))
    assert got[100].lang == "und" and got[101].lang == "fr" and got[102].lang == "de" and got[103].lang == "fr"
    assert got[104].lang == "und" and got[104].confidence == 0 and got[105].lang == "fr"
    assert page_languages(df.limit(0), m).collect() == []


def test_without_languages(spark):
    m = fit_text_model(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, 2, "abc", "h", "h", None, None)], "id long, version long, text string, host string, domain string, declared string, suffix string")
    assert [r.lang for r in language_id(rows, m).collect()] == ["und"]


def test_accepted_documents(spark):
    rng = random.Random(5)
    rows = [(i, text(x, 40, rng), x, "s%d" % (i % 2), 1) for i, x in enumerate(["en", "fr", "de"] * 10)]
    rows += [(50, None, None, "s0", 1), (51, "123", None, None, 1), (52, text("fr", 60, rng), "en", "s1", 1), (53, "...", "en", "s1", 1), (None, rows[0][1], "en", "s0", 1), (0, rows[0][1], "en", "s0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _lang int")
    m = fit_text_model(df)
    out = accepted(df.drop("_lang"), m)
    got = sorted(((r.doc_id, r.lang) for r in out.collect()), key=repr)
    want = sorted([(i, x) for i, _, x, *_ in rows[:30]] + [(52, "fr"), (53, "en"), (None, "en"), (0, "en")], key=repr)
    assert got == want and out.columns == ["doc_id", "text", "lang", "source"]


def test_declared_language_alone_saves_no_text(spark):
    rng = random.Random(6)
    rows = [(i, text(x, 2500, rng), x, "s%d" % (i % 2)) for i, x in enumerate(["en", "fr", "de"] * 20)]
    junk = ["", None, "1234 567", "--- ...", " ".join("".join(rng.choice("bcdfjklmpvwxyz") for _ in range(9)) for _ in range(40)), "日本語の文章です 東京都の天気"]
    rows += [(100 + i, t, "en", "s1") for i, t in enumerate(junk)] + [(200, text("fr", 60, rng), "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, df, "").collect()}
    assert got == {i: x for i, _, x, _ in rows[:60]} | {200: "fr"}


def test_unsure_texts_are_rejected(spark):
    both = TextModel(["en", "fr"], np.full((BUCKETS, 2), -8.0, np.float32))  # texts say nothing
    df = spark.createDataFrame([(1, "some words here", None, "s")], "doc_id long, text string, lang string, source string")
    assert accepted(df, both).count() == 1 and accepted(df, both, LEAST).count() == 0


def test_rare_languages_are_known(spark):
    """A language outside the smallest hashed ids is fitted, and one without texts is found where it is said."""
    rng = random.Random(7)
    rows = [(i, text("en" if i % 2 else "fr", 20, rng), "en" if i % 2 else "fr", "s0") for i in range(400)]
    rows += [(1000 + i, text("de", 40, rng), "de-AT", "s1") for i in range(2)] + [(2000, "12", "sw", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = fit_text_model(df, 40, df.selectExpr("'zu' lang"))
    assert m.languages == ["de", "en", "fr", "sw", "zu"] and m.bare.tolist() == [False, False, False, True, True]
    out = {r.doc_id: r.lang for r in accepted(df, m, LEAST).collect()}
    assert out == {i: x for i, _, x, _ in rows[:402]}
    page = '<html lang="{}"><body>{}</body></html>'.format
    pages = [(1, "http://a.example.com/", page("zu", "日本語の文章です")), (2, "http://a.example.com/", page("zu", text("fr", 60, rng))), (3, "http://b.example.com/", "日本語の文章です"), (4, "http://c.example.com/sw/", page("sw", ""))]
    got = {r.id: r.lang for r in page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), m).collect()}
    assert got[1] == "zu" and got[2] == "fr" and got[3] not in ("sw", "zu") and got[4] == "sw"


def test_posterior_against_plain_loops(spark):
    """Evidence, grouped counts, smoothed priors and the fused posterior, recomputed row by row without Spark."""
    rng, m = random.Random(17), model()
    k, langs, smoothing = len(m.languages), m.languages, 5.0
    rows = []
    for i in range(120):
        lang = rng.choice(langs)
        host = rng.choice(["a.x.org", "b.x.org", "c.y.net", ""])
        said = lambda: rng.choice([None, lang, lang, rng.choice(langs)])  # noqa: B023, E731
        body = rng.choice([text(lang, rng.choice([1, 3, 30]), rng), "12 34", None])
        rows.append((i // 2, i, body, host, ".".join(host.split(".")[-2:]), said(), said()))
    df = spark.createDataFrame(rows, "id long, version long, text string, host string, domain string, declared string, suffix string").repartition(4)
    got = {r.version: (r.lang, r.confidence) for r in language_id(df, m, smoothing=smoothing).collect()}
    share, best, cells = {}, {}, {}
    for _, v, body, *_ in rows:
        n, cells[v] = m.loglik(body or "")
        p = np.exp(cells[v] - cells[v].max())
        share[v], best[v] = (p / p.sum(), langs[int(cells[v].argmax())]) if n else (np.zeros(k), None)
    overall = sum(share.values())
    base = (overall + 1) / (overall.sum() + k)
    table = {}
    for part in (5, 6):
        counts = np.ones((k, k))
        for r in rows:
            if r[part] and best[r[1]]:
                counts[langs.index(r[part]), langs.index(best[r[1]])] += 1
        table[part] = np.log(counts / counts.sum(axis=0))
    for r in rows:
        v = r[1]
        at_host = sum(share[x[1]] for x in rows if x[3] == r[3]) - share[v]
        at_domain = sum(share[x[1]] for x in rows if x[4] == r[4]) - share[v]
        domain = (at_domain + smoothing * base) / (at_domain.sum() + smoothing)
        value = cells[v] + np.log((at_host + smoothing * domain) / (at_host.sum() + smoothing))
        for part in (5, 6):
            if r[part]:
                value = value + table[part][langs.index(r[part])]
        post = np.exp(value - value.max())
        post /= post.sum()
        if not (best[v] or r[5] or r[6]):
            assert got[v] == ("und", 0.0)
            continue
        assert abs(got[v][1] - post.max()) < 1e-9 and (got[v][0] == langs[int(post.argmax())] or np.sort(post)[-1] - np.sort(post)[-2] < 1e-9)


def test_very_long_and_tied_texts(spark):
    rng, m = random.Random(19), model()
    long = text("fr", 200_000, rng)
    kinds = "id long, version long, text string, host string, domain string, declared string, suffix string"
    one = language_id(spark.createDataFrame([(1, 1, long, "h", "", None, None)], kinds), m).first()
    assert (one.lang, one.text_lang) == ("fr", "fr")
    tied = language_id(spark.createDataFrame([(2, 2, "", "k", "", "fr", "en")], kinds), m).first()  # says nothing of any language yet
    assert (tied.lang, tied.text_lang) == ("de", None) and abs(tied.confidence - 1 / 3) < 1e-9


def test_thousands_of_codes_stay_bounded(spark):
    rng = random.Random(23)
    rows = [(i, text("en" if i % 2 else "fr", 20, rng), "en" if i % 2 else "fr", "s0") for i in range(200)]
    junk = [(1000 + i, text("fr", 40, rng), f"junk {i}", "s1") for i in range(2000)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    m = fit_text_model(docs, declared=spark.range(3000).selectExpr("concat('x', chr(97 + id % 26), chr(97 + id div 26 % 26)) lang"))
    assert len(m.languages) == MOST and {"en", "fr"} <= set(m.languages) and m.table.nbytes == 4 * BUCKETS * MOST
    got = {r.doc_id: r.lang for r in accepted(docs.where("doc_id < 1000 or doc_id >= 2500"), m, LEAST).collect()}
    assert all(got[i] == x for i, _, x, _ in rows)
    few = fit_text_model(docs.where("doc_id < 1000"), declared=docs.select(F.lit("zu").alias("lang")))
    assert few.languages == ["en", "fr", "zu"]
    assert len(page_languages(spark.createDataFrame([(1, "http://a.example.com/", '<html lang="xq">' + text("en", 30, rng))], "page_id long, url string, html string"), few).collect()) == 1
