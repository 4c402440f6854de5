"""Language of web pages by Bayesian evidence fusion.

Three kinds of evidence are multiplied: how likely the page's text is in each language
(naive Bayes over byte trigrams), which language its markup declares, and which one its
address suggests (a path segment or a top-level domain). Their product with a prior gives
the posterior. The prior of a page is what the evidence of all other pages of its host says,
smoothed towards that of its parent domain's other pages, which is smoothed towards that of
all others: counted by grouped aggregation, with the page's own vote taken off. Pages
without any evidence have no vote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm.store import batchwise, materialize, table
from stratavox.llm.urlgraph import HOST, LOWER, PATH, UPPER
from stratavox.llm.words import SLICE_BYTES, U64, slices

#: Documents of each language that the text model may be trained on, about.
MAX_TRAIN = 2_000
#: Languages that documents may state: more than there are codes in ISO 639-3.
MAX_LANGUAGES = 8192
#: Bits of a trigram's hash; with many languages fewer, so that a model has at most 2**MODEL_BITS numbers.
TRIGRAM_BITS, MODEL_BITS = 16, 24
#: Trust in a declaration and in an address: the rate at which each is right.
DECLARED_RIGHT, ADDRESS_RIGHT = 0.9, 0.8
#: Pages that the prior of a level above weighs.
SMOOTHING = 20.0
#: Units of a page's vote, so that sums of votes do not depend on their order.
VOTE = 1_000_000
#: Weight of one trigram; neighbours overlap, so their evidence is not independent.
TRIGRAM_WEIGHT = 0.3
#: Log-likelihood that the text of one page may move two languages apart, at most.
TEXT_LIMIT = 40.0
#: Trigrams that are looked up at once.
_GATHERED = 1 << 17

_LANG_TAG = re.compile(rb"""<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2})""", re.I)
_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->")
#: A tag, whose quoted values may hold brackets; without group 1 it does not end, and is text.
#: It takes in what it has looked at, so no byte is looked at again from a later start.
_TAG = re.compile(rb"""<[A-Za-z/!?](?:[^<>=]++|=\s*+(?:"[^"]{0,4096}+"|'[^']{0,4096}+')|=)*+(>)?""")

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[:65] = 32
_FOLDED[91:97] = 32
_FOLDED[123:128] = 32


def _trigrams(raw: np.ndarray, bits: int = TRIGRAM_BITS) -> Iterator[np.ndarray]:
    """Hashed trigrams of folded bytes, in pieces of bounded size; runs of separators count once."""
    last = np.zeros(0, dtype=np.uint8)
    for a in range(0, len(raw), SLICE_BYTES):
        b = np.concatenate([last, _FOLDED[raw[a : a + SLICE_BYTES]]])
        b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
        x = b.astype(U64)
        h = (x[:-2] << U64(16) | x[1:-1] << U64(8) | x[2:]) * U64(0x9E3779B97F4A7C15)
        yield (h >> U64(64 - bits)).astype(np.int64)
        last = b[-2:]


def visible(html: bytes) -> np.ndarray:
    """Bytes of a page's text: without comments, scripts, styles and tags. A bracket that is no tag's is text."""
    return np.frombuffer(_TAG.sub(lambda m: b"" if m[1] else m[0], _HIDDEN.sub(b" ", html)), dtype=np.uint8)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by trigram and language) from documents that state theirs.

    Counts come from a sample of about MAX_TRAIN documents of each language at most, spread
    over all by a hash; they are added up on the executors, over whole texts.
    """
    stated = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    totals = stated.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1)
    languages = sorted(r["lang"] for r in totals.collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"documents state more than {MAX_LANGUAGES} languages")
    if not languages:
        return [], np.zeros((1 << TRIGRAM_BITS, 0), dtype=np.float32)
    k, index = len(languages), {c: i for i, c in enumerate(languages)}
    bits = min(TRIGRAM_BITS, MODEL_BITS - (k - 1).bit_length())
    share = F.least(F.lit(1.0), MAX_TRAIN / F.col("n")) * (1 << 30)
    sample = stated.join(F.broadcast(totals), "lang").where(F.pmod("h", F.lit(1 << 30)) < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits, k), dtype=np.int64)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j, raw, off in slices(batch.column(1)):
                for row in range(i, j):
                    for g in _trigrams(raw[off[row - i] : off[row - i + 1]], bits):
                        np.add.at(total[:, index[langs[row]]], g, 1)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["k", "n"])

    rows = sample.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    table = np.full(k << bits, 0.5)
    table[rows.column("k").to_numpy()] += rows.column("n").to_numpy()
    table = table.reshape(-1, k)
    return languages, np.log(table / table.sum(0)).astype(np.float32)


def text_scores(texts: list[np.ndarray], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each text in each language, relative to the best, and whether there was any trigram."""
    bits = int(model.shape[0]).bit_length() - 1
    out, seen = np.zeros((len(texts), model.shape[1])), np.zeros(len(texts), dtype=bool)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if held:
            first = np.cumsum([0] + [len(g) for _, g in held[:-1]])
            np.add.at(out, [i for i, _ in held], np.add.reduceat(model[np.concatenate([g for _, g in held])], first, axis=0, dtype=float))

    for i, raw in enumerate(texts):
        for piece in _trigrams(raw, bits):
            for a in range(0, len(piece), _GATHERED):
                held.append((i, piece[a : a + _GATHERED]))
                seen[i] = True
                size += len(held[-1][1])
                if size >= _GATHERED:
                    flush()
                    held, size = [], 0
    flush()
    out *= TRIGRAM_WEIGHT
    return np.maximum(out - out.max(1, keepdims=True), -TEXT_LIMIT), seen


def _voted(codes: list[str | None], index: dict[str, int], right: float) -> np.ndarray:
    """Log-likelihood of what pages say about their language, by language; 0 where they say nothing."""
    out = np.zeros((len(codes), len(index)))
    if len(index) > 1:
        for i, c in enumerate(codes):
            if c in index:
                out[i] = np.log((1 - right) / (len(index) - 1))
                out[i, index[c]] = np.log(right)
    return out


def votes(scores: np.ndarray, evident: np.ndarray) -> np.ndarray:
    """What each page's evidence says by itself, in units of which VOTE are a page; zeros without evidence."""
    p = np.exp(scores - scores.max(1, keepdims=True))
    return np.where(evident[:, None], np.rint(VOTE * p / p.sum(1, keepdims=True)), 0).astype(np.int64)


def _evidence(pages: DataFrame, languages: list[str], model: np.ndarray, extra: list[str]) -> DataFrame:
    """The given columns (the last is the suggested language), the declared language, the best by text, scores and votes."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    index = {c: k for k, c in enumerate(languages)}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        declared, texts = [], []
        for value in batch.column(batch.num_columns - 1):
            html = (value.as_py() or "").encode()
            tag = _LANG_TAG.search(html)
            code = tag[1].decode().lower() if tag else None
            declared.append(code if code in index else None)
            texts.append(visible(html))
        scores, seen = text_scores(texts, shared.value)
        text_lang = [languages[k] for k in scores.argmax(1)]
        suggested = batch.column(batch.num_columns - 2).to_pylist()
        scores += _voted(declared, index, DECLARED_RIGHT) + _voted(suggested, index, ADDRESS_RIGHT)
        evident = seen | np.array([d is not None or s is not None for d, s in zip(declared, suggested, strict=True)], dtype=bool)
        own = votes(scores, evident)
        page, lang = np.nonzero(own)
        ends = np.searchsorted(page, np.arange(len(texts) + 1)).astype(np.int32)
        pair = pa.StructArray.from_arrays([pa.array(lang, pa.int32()), pa.array(own[page, lang], pa.int64())], names=["k", "v"])
        lists = pa.ListArray.from_arrays(np.arange(0, scores.size + 1, len(languages), dtype=np.int32), scores.ravel())
        columns = batch.columns[:-1] + [pa.array(declared, pa.string()), pa.array(text_lang, pa.string()), lists, pa.ListArray.from_arrays(ends, pair)]
        yield pa.RecordBatch.from_arrays(columns, names=[*extra, "declared", "text_lang", "scores", "votes"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in extra), "declared string, text_lang string, scores array<double>, votes array<struct<k:int,v:bigint>>"])
    return pages.select(*extra, "html").mapInArrow(batchwise(run), schema)


def _counted(seen: DataFrame, *by: str) -> DataFrame:
    """(*by, k, v): votes for each language that has any."""
    return seen.groupBy(*by, "k").agg(F.sum("v").alias("v"))


def _map(name: str):
    """Votes of a group by language, at most one entry for each."""
    return F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, suggested, text_lang, lang, posterior per row of ``pages``.

    The posterior is the product of the page's evidence and its prior. A page without any
    evidence gets its prior: what the other pages of its host say, of a host without others
    what those of its parent say, then all others; without any the languages are equal. Null
    urls share the empty host. Rows that repeat a page are pages each, and vote each. Without
    documents that state a language, lang and posterior are null. Of equal posteriors the
    alphabetically first wins.
    """
    languages, model = train(docs)
    lower = lambda c: F.translate(c, UPPER, LOWER)
    host = lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    path = lower(F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")))
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    none = F.lit(None).cast("string")
    if not languages:
        return placed.select("page_id", "host", none.alias("declared"), none.alias("suggested"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("posterior"))
    known = F.array(*map(F.lit, languages))
    segments = F.filter(F.split("path", "/"), lambda s: F.array_contains(known, s))
    domain = F.substring_index("host", ".", -1)
    placed = placed.withColumn("suggested", F.coalesce(F.try_element_at(segments, F.lit(1)), F.when(F.array_contains(known, domain), domain)))
    parent = F.when(F.size(F.split("host", "[.]")) > 2, F.expr("substring(host, instr(host, '.') + 1)")).otherwise(F.col("host"))
    placed = placed.withColumn("parent", parent)
    seen = materialize(_evidence(placed, languages, model, ["page_id", "host", "parent", "suggested"]), "evidence")

    cast = materialize(_counted(seen.select("parent", "host", F.inline("votes")), "parent", "host"), "votes")
    by_host = cast.groupBy("host").agg(_map("of_host"))
    of_parents = _counted(cast, "parent")
    by_parent = of_parents.groupBy("parent").agg(_map("of_parent"))
    k = len(languages)
    everywhere = {r["k"]: r["v"] for r in _counted(of_parents).collect()}
    overall = F.array(*[F.lit(int(everywhere.get(i, 0))) for i in range(k)])

    dense = lambda m: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0).cast("long")))
    others = lambda a: F.transform(F.zip_with(a, "own", lambda x, v: x - v), lambda x: x.cast("double") / VOTE)
    smoothed = lambda counts, above: F.zip_with(counts, above, lambda n, p: n + SMOOTHING * p)
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    joined = seen.join(by_host, "host", "left").join(by_parent, "parent", "left").withColumn("own", dense(F.map_from_entries("votes")))
    joined = joined.withColumn("p", share(F.transform(others(overall), lambda n: n + 1.0)))
    for level in ("of_parent", "of_host"):
        joined = joined.withColumn("p", share(smoothed(others(dense(F.col(level))), F.col("p"))))
    fused = joined.withColumn("fused", F.zip_with("scores", "p", lambda s, p: s + F.log(p)))
    top_score = F.array_max("fused")
    spread = F.aggregate("fused", F.lit(0.0), lambda t, x: t + F.exp(x - top_score))
    return fused.select(
        "page_id", "host", "declared", "suggested", "text_lang", F.element_at(known, F.array_position("fused", top_score).cast("int")).alias("lang"), (1 / spread).alias("posterior")
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
