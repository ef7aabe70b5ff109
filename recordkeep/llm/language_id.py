"""Language ID by Bayesian fusion of four kinds of evidence.

1. *Text*: byte-trigram likelihoods, tempered so that dependent trigrams do not count as independent ones. The model is
   fitted on a bounded sample of each language's documents. Known are the languages that documents, then pages, are
   most often declared to have, MOST at most, as each is a column of the model and of the evidence; a code beyond these
   counts as not declared. All trigrams are alike to a language without texts, which needs a declaration, suffix or host
   that says it.
2. *Declared language* of the markup and 3. *address suffix* (first path part, else country domain). What each says is
   weighted by P(said | language), counted over all rows by grouped aggregation against what their texts say.
4. *Host priors*: expected languages of a host's texts, smoothed towards its domain, and that towards all rows. The
   counts are partial sums per host; a row's own text is taken out of its host's counts, so it is not used twice.

The priors are joined back to narrow rows as written tables: a host with a third of all rows is split as a skewed key,
and only tables that Spark has measured as small are broadcast.

Defined cases: null or empty text gives no text evidence; an address that is null or has no host has an empty host; a
row with neither letters, a known declared language nor a known suffix is ``und`` with confidence 0; ties go to the
language that sorts first; very long texts are weighed whole; rows repeat as they come and count for their host each;
extra columns, whatever their names, are ignored; without a fitted language everything is ``und``.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordkeep.llm.tables import table
from recordkeep.plans.lineage import cut

#: Documents that the text model is fitted on, at most.
FIT_ROWS = 2000
#: And of each language at least so many; texts count up to so many characters, fewer if there are many languages.
LEAST_ROWS, LONGEST = 20, 100_000
#: A text counts as at most so many independent trigrams.
EFFECTIVE = 40.0
#: Rows that a domain's counts weigh in its hosts, and all rows' in a domain.
SMOOTHING = 5.0
#: A document stays in the pipeline if its language is at least so sure; the least sure one of sf0.1 is at 0.9935.
LEAST = 0.9
BUCKETS = 1 << 16
#: Languages that are known, at most: the table has BUCKETS x languages cells of four bytes, 16 MB for 64.
MOST = 64
NO_TEXT = re.compile(r"(?is)<(script|style|template|noscript)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>")
TAG = r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)"
LETTERS = re.compile(r"[^\W\d_]+")


def _trigrams(text: str) -> np.ndarray:
    words = " ".join(LETTERS.findall(text.lower()))
    raw = np.frombuffer(f" {words} ".encode(), np.uint8).astype(np.uint32)
    if not words or len(raw) < 3:
        return np.empty(0, np.int64)
    return ((raw[:-2] * 0x9E3779B1 ^ raw[1:-1] * 0x85EBCA6B ^ raw[2:] * 0xC2B2AE35) * np.uint32(0x27D4EB2F) >> 16).astype(np.int64)


class TextModel:
    """Trigram log-likelihoods of ``languages``."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        self.bare = (np.abs(table + np.log(BUCKETS)) < 1e-4).all(axis=0)  # languages without texts

    @classmethod
    def fit(cls, rows: Iterable[tuple[str, str]], languages: Iterable[str] = ()) -> TextModel:
        """Fit on (text, language). ``languages`` are known besides; all trigrams are alike to one without texts."""
        counts: dict[str, np.ndarray] = {lang: np.zeros(BUCKETS) for lang in languages}
        for text, lang in rows:
            counts.setdefault(lang, np.zeros(BUCKETS))
            counts[lang] += np.bincount(_trigrams(text or ""), minlength=BUCKETS)
        languages = sorted(counts)
        if not languages:
            return cls([], np.zeros((BUCKETS, 0), np.float32))
        all_counts = np.stack([counts[x] for x in languages], axis=1) + 0.1
        return cls(languages, np.log(all_counts / all_counts.sum(axis=0)).astype(np.float32))

    def loglik(self, text: str) -> tuple[int, np.ndarray]:
        """Number of trigrams, and tempered log-likelihoods relative to the best."""
        return self.weighed(text)[:2]

    def weighed(self, text: str) -> tuple[int, np.ndarray, float | None]:
        """What :meth:`loglik` gives, and the best mean log-likelihood of a trigram over that of a random one."""
        grams = _trigrams(text)
        if not len(grams) or not self.languages:
            return 0, np.zeros(len(self.languages)), None
        total = np.zeros(len(self.languages))
        for at in range(0, len(grams), 1 << 20):
            total += self.table[grams[at : at + (1 << 20)]].sum(axis=0, dtype=np.float64)
        likely = float(total[~self.bare].max(initial=-np.inf)) / len(grams) + float(np.log(BUCKETS))
        total *= min(1.0, EFFECTIVE / len(grams))
        return len(grams), total - total.max(), likely


def visible(page: str) -> str:
    return markup.unescape(NO_TEXT.sub(" ", page))


def fit_text_model(docs: DataFrame, rows: int = FIT_ROWS, declared: DataFrame | None = None) -> TextModel:
    """Know the languages of ``docs`` (doc_id, text, lang), and of ``declared`` (lang), and fit on a bounded sample of each.

    Of more than MOST languages those with the most rows are taken, documents first.

    Each language gets an equal share of ``rows``, and LEAST_ROWS at least, so that a rare one is fitted as a common one.
    The characters of all samples together are bounded: with many languages, texts are cut.
    """
    own = _code(F.col("lang"))
    every = {r["lang"]: r["n"] for r in docs.select(own.alias("lang")).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST).collect()}
    more: set[str] = set()
    if declared is not None and len(every) < MOST:
        others = declared.select(_code(F.col("lang")).alias("lang")).where(F.col("lang").isNotNull() & ~F.col("lang").isin(list(every)))
        more = {r["lang"] for r in others.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST - len(every)).collect()}
    if not every:
        return TextModel.fit([], more)
    share = max(LEAST_ROWS, rows // len(every))
    order = F.xxhash64(F.col("doc_id"))
    # The ids that can be among a language's smallest, by its count; then the hash up to which they are taken.
    spark, spread = docs.sparkSession, 2.0**63
    tops = [(x, int(min(spread * (2 * (share + 6 * share**0.5) / n - 1), 2**63 - 1))) for x, n in every.items()]
    top = F.broadcast(spark.createDataFrame(tops, "l_lang string, l_top long"))  # a row for each language
    ids = docs.select(own.alias("lang"), order.alias("o")).join(top, F.col("lang") == F.col("l_lang")).where("o <= l_top")
    ranked = ids.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).where(F.col("at") <= share)
    last = F.broadcast(spark.createDataFrame([tuple(r) for r in ranked.groupBy("lang").agg(F.max("o")).collect()], "l_lang string, l_last long"))
    longest = max(1, min(LONGEST, rows * LONGEST // (share * len(every))))
    picked = docs.select(order.alias("o"), F.substring("text", 1, longest).alias("text"), own.alias("lang")).join(last, F.col("lang") == F.col("l_lang")).where("o <= l_last")
    found = picked.select("o", "text", "lang").orderBy("o", F.xxhash64("text")).limit(2 * share * len(every)).collect()  # ids may repeat
    return TextModel.fit(((r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["o"], str(r["text"])))), {*every, *more})


def _code(code: Column) -> Column:
    """A language tag's first part, else all of it, in lower case; null if there is nothing."""
    first = F.lower(F.regexp_extract(code, TAG, 1))
    return F.when(first != "", first).when(F.trim(code) != "", F.lower(F.trim(code)))


def primary(code: Column, languages: list[str]) -> Column:
    """A language tag's first part if it is one of ``languages``, else null."""
    first = F.lower(F.regexp_extract(code, TAG, 1))
    return F.when(first.isin(languages), first) if languages else F.lit(None).cast("string")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(url: Column, languages: list[str]) -> Column:
    """The first part of the path, else the country domain, if it names a language."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2,3}(?:-[A-Za-z]+)?)(?:[/?#]|$)", 1)
    return F.coalesce(primary(path, languages), primary(F.substring_index(host_of(url), ".", -1), languages))


def posterior(values: np.ndarray) -> np.ndarray:
    """Rows of log values to rows of probabilities."""
    parts = np.exp(values - values.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def language_id(rows: DataFrame, model: TextModel, is_markup: bool = False, smoothing: float = SMOOTHING) -> DataFrame:
    """``rows`` (id, version, text, host, domain, declared, suffix) -> id, version, lang, confidence, text_lang, declared, suffix, host, likely.

    ``likely`` is null without letters, and under 0 if random trigrams explain the text better than any language.
    ``declared`` and ``suffix`` are null or one of the model's languages; ``version`` tells apart rows of one id.
    """
    langs, k = model.languages, len(model.languages)
    if not k:
        void = F.lit(None).cast("string")
        return rows.select("id", "version", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), void.alias("text_lang"), void.alias("declared"), void.alias("suffix"), "host", F.lit(None).cast("double").alias("likely"))
    sent = rows.sparkSession.sparkContext.broadcast((langs, model.table))  # fixed size: buckets x languages
    ll, p, n, d = ([f"{x}{i}" for i in range(k)] for x in ("ll", "p", "n", "d"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextModel(*sent.value)
        bare = {x for x, b in zip(own.languages, own.bare, strict=True) if b}
        for batch in batches:
            found = [own.weighed(visible(text.as_py() or "") if is_markup else text.as_py() or "") for text in batch.column(2)]
            grams = np.array([g for g, *_ in found], bool)
            cells = np.stack([v for _, v, _ in found]) if found else np.zeros((0, k))
            share = posterior(cells) * grams[:, None]
            best = [langs[j] if g else None for g, j in zip(grams, cells.argmax(axis=1), strict=True)]
            if own.bare.any():
                unlike = np.flatnonzero(~grams | own.bare[cells.argmax(axis=1)])  # no language with texts is like these
                share[:, own.bare] = 0
                for i in unlike:
                    said = [x for x in (batch.column(5)[i].as_py(), batch.column(6)[i].as_py()) if x in bare]
                    best[i], share[i] = said[0] if said and grams[i] else None, 0
                    if said:
                        share[i, langs.index(said[0])] = 1
            columns = [*[batch.column(i) for i in (0, 1, 3, 4, 5, 6)], pa.array(best, pa.string()), pa.array([x for *_, x in found], pa.float64()), *[pa.array(x[:, i], pa.float64()) for x in (cells, share) for i in range(k)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "host", "domain", "declared", "suffix", "text_lang", "likely", *ll, *p])

    schema = "id long, version long, host string, domain string, declared string, suffix string, text_lang string, likely double, " + ", ".join(f"{x} double" for x in (*ll, *p))
    seen = cut(rows.select("id", "version", "text", "host", "domain", "declared", "suffix").mapInArrow(weigh, schema), "language-evidence")

    hosts = cut(seen.groupBy("host", "domain").agg(*[F.sum(p[i]).alias(n[i]) for i in range(k)]).withColumnsRenamed({"host": "h_host", "domain": "h_domain"}), "language-hosts")
    domains = cut(hosts.groupBy(F.col("h_domain").alias("d_domain")).agg(*[F.sum(n[i]).alias(d[i]) for i in range(k)]), "language-domains")
    overall = np.array([x or 0.0 for x in hosts.agg(*[F.sum(x) for x in n]).first()])
    base = (overall + 1) / (overall.sum() + k)
    bare = model.bare
    said = {part: _said(seen, part, langs, [x for x, b in zip(langs, bare, strict=True) if b]) for part in ("declared", "suffix")}

    prior = cut(hosts.join(domains, F.col("h_domain").eqNullSafe(F.col("d_domain"))).drop("d_domain"), "language-priors")
    joined = seen.join(prior, F.col("host").eqNullSafe(F.col("h_host")) & F.col("domain").eqNullSafe(F.col("h_domain"))).drop("h_host", "h_domain", "domain")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {name: batch.column(name) for name in batch.schema.names}
            text, own, at_host, at_domain = (np.stack([get[x].to_numpy() for x in part], axis=1) for part in (ll, p, n, d))
            at_domain, at_host = np.maximum(at_domain - own, 0), np.maximum(at_host - own, 0)
            domain_prior = (at_domain + smoothing * base) / (at_domain.sum(axis=1, keepdims=True) + smoothing)
            host_prior = (at_host + smoothing * domain_prior) / (at_host.sum(axis=1, keepdims=True) + smoothing)
            value = text + np.log(host_prior)
            if bare.any():  # a language without texts needs someone who says it
                told = np.array([[x in (a, b) for x in langs] for a, b in zip(get["declared"].to_pylist(), get["suffix"].to_pylist(), strict=True)], bool).reshape(-1, k)
                value = np.where(bare & ~told & (at_host <= 0), -1e9, value)
            silent = np.ones(len(value), bool)
            for part in ("declared", "suffix", "text_lang"):
                words = get[part].to_pylist()
                silent &= np.array([w is None for w in words], bool)
                if part in said:
                    value += np.array([said[part][w] if w is not None else np.zeros(k) for w in words]).reshape(-1, k)
            post = posterior(value) if len(value) else value
            top = post.argmax(axis=1)
            lang = ["und" if s else langs[j] for s, j in zip(silent, top, strict=True)]
            sure = np.where(silent, 0.0, post.max(axis=1))
            yield pa.RecordBatch.from_arrays([get["id"], get["version"], pa.array(lang, pa.string()), pa.array(sure, pa.float64()), *[get[x] for x in ("text_lang", "declared", "suffix", "host", "likely")]], names=["id", "version", "lang", "confidence", "text_lang", "declared", "suffix", "host", "likely"])

    return joined.mapInArrow(fuse, "id long, version long, lang string, confidence double, text_lang string, declared string, suffix string, host string, likely double")


def _said(seen: DataFrame, part: str, langs: list[str], bare: list[str]) -> dict[str, np.ndarray]:
    """What is said -> log P(said | each language), from all rows that say something and have text; languages^2 counts.

    A language without texts (``bare``) is also what rows without text say.
    """
    known = seen.where(F.col(part).isNotNull() & (F.col("text_lang").isNotNull() | F.col(part).isin(bare)))
    counts = np.ones((len(langs), len(langs)))
    for r in known.groupBy(part, "text_lang").count().collect():
        counts[langs.index(r[part]), langs.index(r["text_lang"] or r[part])] += r["count"]
    return dict(zip(langs, np.log(counts / counts.sum(axis=0)), strict=True))


def declared_of(html: Column) -> Column:
    """The language tag of the markup, or an empty string."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3}(?:[-_][A-Za-z0-9]+)*)", 1)


def page_languages(pages: DataFrame, model: TextModel) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, lang, confidence, text_lang, declared, suffix, host."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"),
        F.xxhash64("url", "html").alias("version"),
        F.col("html").alias("text"),
        host_of(F.col("url")).alias("host"),
        domain_of(host_of(F.col("url"))).alias("domain"),
        primary(declared_of(F.col("html")), model.languages).alias("declared"),
        suffix_of(F.col("url"), model.languages).alias("suffix"),
    )
    return language_id(rows, model, is_markup=True).drop("likely")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, lang, confidence, text_lang, declared, suffix, host."""
    pages = table(spark, sf_dir, "pages")
    model = fit_text_model(table(spark, sf_dir, "documents"), declared=pages.select(declared_of(F.col("html")).alias("lang")))
    return page_languages(pages, model).withColumnRenamed("id", "page_id").drop("version")


def accepted(docs: DataFrame, model: TextModel, least: float | None = None) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, ...) whose language is found, with ``lang`` set to it.

    The source stands for the host and the ``lang`` column for the declared language. Documents that say nothing
    about their language (``und``) are rejected. With ``least``, so are texts without letters, texts that random
    trigrams explain better than any language, and those whose language is less sure, whatever they declare. Only rows
    that change are joined back to the texts.
    """
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        version.alias("version"),
        "text",
        source.alias("host"),
        F.lit("").alias("domain"),
        primary(F.col("lang"), model.languages).alias("declared"),
        F.lit(None).cast("string").alias("suffix"),
    )
    found = language_id(rows, model)
    if least is not None:
        bare = [x for x, b in zip(model.languages, model.bare, strict=True) if b]
        out = F.col("likely").isNull() | (F.col("likely") < 0) & ~F.col("lang").isin(bare) | (F.col("confidence") < least)
        found = found.withColumn("lang", F.when(out, "und").otherwise(F.col("lang")))
    change = found.where((F.col("lang") == "und") | ~F.col("lang").eqNullSafe(F.col("declared"))).select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("lang").alias("_lang"), F.coalesce("declared", F.lit("")).alias("_declared"), F.col("host").alias("_host")).distinct()
    change = cut(change, "language-changes")
    said = F.coalesce(primary(F.col("lang"), model.languages), F.lit(""))
    joined = docs.join(change, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (version == F.col("_version")) & (said == F.col("_declared")) & (source == F.col("_host")), "left")
    stay = joined.where("_lang is null or _lang <> 'und'")
    return stay.select(*[F.coalesce("_lang", "lang").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])
