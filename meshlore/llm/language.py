"""Language identification of web pages by Bayesian fusion of evidence.

Four pieces of evidence speak for a page's language: how likely its text is under
each language's byte n-gram model, the language that its markup declares, the
suffix of its address, and what languages its host's other pages are in.

1. The n-gram models are learned from texts of known language.
2. A first posterior (text alone, uniform prior) gives every page soft counts.
3. Grouped sums of the soft counts give P(declared | language), P(suffix | language)
   and the host priors.  A host's prior is smoothed towards its domain's, a
   domain's towards that of all pages, each by a pseudo-count.  A page's own
   count is taken out of what is used for it.
4. The final posterior is proportional to the product of all four.

Bound: ``SAMPLE`` texts at most (smallest hash of the id), of ``common.SAMPLE_CHARS``
characters at most, are read to learn the n-gram models.  Counts, priors and posteriors cover all pages.

Defined cases: a page with null or empty markup has no text evidence and no
declared language; a null or unreadable address has no host and no suffix.
Missing evidence leaves the posterior to the rest.  Declared languages count by
their primary subtag in lower case.  Ties go to the language first in the
alphabet.  Rows that repeat are pages of their own; other columns are not read.
Without texts of known language the result is empty languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .blocks import LOWER, WHITE, blocks

SAMPLE = 2000
BUCKET_BITS = 14
NGRAMS = (1, 2, 3)

#: The text counts as so many n-grams at most: they aren't independent.
EVIDENCE = 20

#: Pseudo-counts: of a host towards its domain, of a domain towards all, of a declared language or suffix.
HOST_WEIGHT, DOMAIN_WEIGHT, VALUE_WEIGHT = 5.0, 20.0, 1.0

#: Elements whose content isn't the page's text, and classes of those that are advertisements.
SILENT = ("script", "style", "nav", "header", "footer", "aside", "noscript")
ADVERTISED = ("ad", "ads", "advert", "advertisement", "banner", "sponsored")

_NAME = re.compile(r"<([A-Za-z][A-Za-z0-9]*)")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,8})")
_CLASS = re.compile(r"(?i)\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_CLOSING = {name: re.compile(rf"(?i)</{name}\s*>") for name in (*SILENT, "div")}


def scanned(html: str) -> tuple[str, str | None]:
    """The text of a page without scripts, navigation and advertisements, and the language it declares.

    One pass: what is known to be missing from here on isn't looked for again.
    """
    out, declared, missing, at = [], None, set(), 0
    while (begin := html.find("<", at)) >= 0:
        out.append(html[at:begin])
        if "--" not in missing and html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            if end >= 0:
                out.append(" ")
                at = end + 3
                continue
            missing.add("--")
        end = html.find(">", begin + 1)
        if end < 0:
            at = begin
            break
        out.append(" ")
        at = end + 1
        name = _NAME.match(html, begin)
        name = name[1].lower() if name else ""
        if name == "html" and declared is None:
            found = _LANG.search(html, begin, end)
            declared = found[1].lower() if found else None
        if name not in missing and (name in SILENT or (name == "div" and _is_advertised(html, begin, end))):
            found = _CLOSING[name].search(html, at)
            if found:
                at = found.end()
            else:
                missing.add(name)
    out.append(html[at:])
    return unescape("".join(out)), declared


def _is_advertised(html: str, begin: int, end: int) -> bool:
    found = _CLASS.search(html, begin, end)
    return bool(found) and any(x in ADVERTISED for x in (found[1] or found[2] or found[3] or "").lower().split())


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix) of an address."""
    try:
        host = urlsplit(url or "").hostname
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.rstrip(".").split(".")
    return host, ".".join(labels[-3:] if len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3 else labels[-2:]), labels[-1]


@dataclass
class TextModel:
    """Log probabilities of hashed n-grams in each language."""

    languages: list[str]
    table: np.ndarray

    @classmethod
    def learn(cls, texts: list[tuple[str, str]]) -> TextModel:
        languages = sorted({lang for _, lang in texts})
        table = np.full((len(languages), 1 << BUCKET_BITS), 0.5)
        for k, lang in enumerate(languages):
            for block in blocks(pa.array([t for t, other in texts if other == lang], pa.large_string())):
                table[k] += np.bincount(_ngrams(block)[0], minlength=1 << BUCKET_BITS)
        return cls(languages, np.log(table / table.sum(axis=1, keepdims=True)) if languages else table)

    def likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihood of each text in each language, and the numbers of n-grams."""
        out, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for block in blocks(pa.array(texts, pa.large_string())):
            bucket, of = _ngrams(block)
            n = np.bincount(of, minlength=len(block))
            count[block.first : block.first + len(block)] = n
            for k in range(len(self.languages)):
                total = np.bincount(of, self.table[k][bucket], minlength=len(block))
                out[block.first : block.first + len(block), k] = total * np.minimum(1, EVIDENCE / np.maximum(n, 1))
        return out, count


def _ngrams(block) -> tuple[np.ndarray, np.ndarray]:
    white = WHITE[block.data]
    data = np.where(white, np.uint8(0x20), LOWER[block.data]).astype(np.uint64)
    of = np.repeat(np.arange(len(block)), np.diff(block.offsets))
    buckets, texts = [], []
    for n in NGRAMS:
        size = len(data) - n + 1
        if size <= 0:
            continue
        code = np.full(size, n, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + data[k : k + size]
        own = of[:size] == of[n - 1 :]
        buckets.append(((code[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        texts.append(of[:size][own])
    return np.concatenate(buckets or [np.zeros(0, np.int64)]), np.concatenate(texts or [np.zeros(0, np.int64)])


def fitted(docs: DataFrame, bound: int = SAMPLE) -> TextModel:
    """N-gram models from up to ``bound`` texts of known ``lang``, one for each id, of ``common.SAMPLE_CHARS`` at most."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) <= common.SAMPLE_CHARS))
    ids = known.groupBy("doc_id").agg(F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(bound).select("doc_id").collect()
    if not ids:
        return TextModel([], np.zeros((0, 1 << BUCKET_BITS)))
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in ids], "doc_id bigint")
    rows = known.select("doc_id", F.struct("lang", F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("own")).join(F.broadcast(wanted), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("own").alias("own")).select("doc_id", "own.lang", "own.text").collect()
    return TextModel.learn([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def evidence(pages: DataFrame, model: TextModel, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, host, domain, suffix, declared, n_grams, likelihood): one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, declared = zip(*(scanned(h or "") for h in part.column("html").to_pylist()), strict=True)
                likelihood, n = model.likelihoods(list(texts))
                host, domain, suffix = zip(*(address(u) for u in part.column("url").to_pylist()), strict=True)
                strings = [pa.array(x, pa.string()) for x in (host, domain, suffix, declared)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *strings, pa.array(n.astype(np.int64)), pa.array(likelihood.tolist(), pa.list_(pa.float64()))], ["id", "host", "domain", "suffix", "declared", "n_grams", "likelihood"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.transform(common.arrow(run, f"id {kind}, host string, domain string, suffix string, declared string, n_grams bigint, likelihood array<double>"))


def _softmax(values: Column) -> Column:
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, key: str | None, n: int, name: str) -> DataFrame:
    """Sums of the soft counts for each value of ``key`` as an array column."""
    sums = [F.sum(F.col("soft")[k]).alias(f"__{k}") for k in range(n)]
    grouped = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*sums) if key else rows.agg(*sums)
    return grouped.select(*([key] if key else []), F.array(*[F.coalesce(f"__{k}", F.lit(0.0)) for k in range(n)]).alias(name))


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, lang, probability, text_lang, declared, suffix, host and n_grams."""
    n = len(model.languages)
    names = F.array(*[F.lit(x) for x in model.languages]) if n else F.array().cast("array<string>")
    found = common.written(evidence(pages, model, id_col, url_col, html_col))
    if not n:
        return found.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host", "n_grams")
    # A page without text says nothing of its host.
    rows = found.withColumn("soft", F.when(F.col("n_grams") > 0, _softmax(F.col("likelihood"))).otherwise(F.array_repeat(F.lit(0.0), n)))
    everything = _sums(rows, None, n, "all").first()["all"]
    total = sum(everything) + n
    base = [(x + 1.0) / total for x in everything]
    globally = F.array(*[F.lit(x) for x in base])

    def smoothed(counts: Column, own: Column, parent: Column, weight: float) -> Column:
        less = F.zip_with(F.coalesce(counts, F.array_repeat(F.lit(0.0), n)), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(less, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(less, parent, lambda a, p: (a + p * weight) / (size + weight))

    none = F.array_repeat(F.lit(0.0), n)
    hosts = rows.where("host IS NOT NULL").groupBy("host").agg(F.first("domain").alias("domain"), *[F.sum(F.col("soft")[k]).alias(f"__{k}") for k in range(n)])
    hosts = hosts.select("host", "domain", F.array(*[f"__{k}" for k in range(n)]).alias("host_counts"))
    domains = _sums(rows, "domain", n, "domain_counts")
    hosts = common.durable(common.salted_left_join(hosts, domains, "domain").drop("domain"))
    joined = common.salted_left_join(rows, hosts, "host")
    for value in ("declared", "suffix"):
        joined = common.salted_left_join(joined, common.durable(_sums(rows, value, n, f"{value}_counts")), value)

    def chance(counts: Column) -> Column:
        """P(value | language) without the page itself; a value nobody else has says nothing."""
        less = F.zip_with(F.coalesce(counts, none), F.col("soft"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(less, F.lit(0.0), lambda a, b: a + b)
        per_language = F.array(*[F.lit(x + VALUE_WEIGHT) for x in everything])
        return F.zip_with(less, per_language, lambda a, m: (a + VALUE_WEIGHT * (size + 1) / (total + 1)) / m)

    own = F.col("soft")
    prior = smoothed(F.col("host_counts"), own, smoothed(F.col("domain_counts"), own, globally, DOMAIN_WEIGHT), HOST_WEIGHT)
    fused = joined.select("*", prior.alias("prior"), chance(F.col("declared_counts")).alias("p_declared"), chance(F.col("suffix_counts")).alias("p_suffix"))
    logs = F.col("likelihood")
    for part, known in (("prior", F.lit(True)), ("p_declared", F.col("declared").isNotNull()), ("p_suffix", F.col("suffix").isNotNull())):
        logs = F.zip_with(logs, F.when(known, F.transform(part, lambda v: F.log(v))).otherwise(none), lambda a, b: a + b)
    result = fused.withColumn("posterior", _softmax(logs))

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    return result.select(
        F.col("id").alias(id_col), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), F.when(F.col("n_grams") > 0, best(F.col("likelihood"))).alias("text_lang"), "declared", "suffix", "host", "n_grams"
    )
