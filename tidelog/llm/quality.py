"""Document quality: a classifier's evidence combined with what its site is worth.

Two logistic models over plain text measures and telling words, one for poor and
one for toxic text, give each document the probability of being neither.  Sites are two levels,
host and path below it.  Grouped sums of the probabilities give each host a
posterior rate shrunk toward the global rate, and each path one shrunk toward its
host; how strongly is estimated from the spread of the groups themselves (beta
priors by moments), so a sparse site falls back on the level above.  The final
log-odds are those of the document plus what its path's rate differs from the
global one.

The model is fitted on at most ``MAX_LABELLED`` labelled documents, those first in
the order of a hash of the id; everything else covers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.scratch import Scratch

MAX_LABELLED = 20_000
MIN_Z = 5.0
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCTUATION = bytes(c for c in range(33, 127) if c not in LETTERS and c not in DIGITS)
TO_WORDS = bytes(32 if c < 128 and c not in LETTERS + DIGITS else c for c in range(256))
SENTENCE = b".,;:?'\"()-"


def words_of(text: str | None) -> set[bytes]:
    """The distinct lower-cased words of a text."""
    return set((text or "").encode("utf-8", "surrogatepass").lower().translate(TO_WORDS).split())


def measures(text: str | None, evidence: list[dict[bytes, float]]) -> list[float]:
    """Measures of one whole text; all are finite, also for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(raw))

    def share(chars: bytes) -> float:
        return (len(raw) - len(raw.translate(None, chars))) / size

    tokens, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n = max(1, len(tokens))
    letters = share(LETTERS)
    marks = share(PUNCTUATION) - share(SENTENCE)
    words = words_of(text)
    out = [
        math.log1p(len(tokens)), len(raw) / n, share(UPPER) / (letters + 0.01), math.sqrt(share(PUNCTUATION)),
        math.sqrt(max(0.0, marks)), math.sqrt(share(DIGITS)), 1 - len(set(lines)) / max(1, len(lines)),
        len(set(tokens)) / n, letters, len(lines) / n,
    ]
    for ratios in evidence:
        found = [ratios[w] for w in ratios.keys() & words]
        out += [math.fsum(w for w in found if w > 0), math.fsum(w for w in found if w < 0), max([0.0, *found]), min([0.0, *found])]
    return out


def _score_batches(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            if model is None:
                p = np.ones(len(texts))
            else:
                x = np.array([measures(t, model["evidence"]) for t in texts]).reshape(len(texts), -1)
                p = _probability(x, model)
            yield pa.record_batch([batch.column("row_key"), pa.array(p, pa.float64())], names=["row_key", "p_doc"])

    return run


def _measure_batches(evidence: list[dict[bytes, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [measures(t.as_py(), evidence) for t in batch.column("text")]
            yield pa.record_batch([batch.column("poor"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["poor", "toxic", "x"])

    return run


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [list(words_of(t.as_py())) for t in batch.column("text")]
        yield pa.record_batch([batch.column("poor"), batch.column("toxic"), pa.array(words, pa.list_(pa.binary()))], names=["poor", "toxic", "words"])


def _probability(x: np.ndarray, model: dict) -> np.ndarray:
    """Of being neither poor nor toxic."""
    x = (x - model["mean"]) / model["scale"]
    out = np.ones(len(x))
    for head in model["heads"]:
        out *= 1 / (1 + np.exp(np.clip(x @ head["w"] + head["b"], -20, 20)))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(poor, toxic, text)`` of labelled documents; several label rows of one count as their worst."""
    verdict = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id"))
    verdict = verdict.agg((F.min("quality") < 1).alias("poor"), (F.coalesce(F.max("toxic"), F.lit(0)) > 0).alias("toxic"))
    first = verdict.orderBy(F.md5(F.col("label_id").cast("string")), "label_id").limit(max_labelled)
    return docs.join(first, docs.doc_id == first.label_id).select("poor", "toxic", "text")


def _evidence(words: DataFrame, label: str, rows: int, positive: int) -> dict[bytes, float]:
    """Log odds ratios of the words whose presence depends on ``label``: root of G squared at least ``MIN_Z``."""
    counts = words.groupBy("word").agg(F.count_if(label).alias("a"), F.count("*").alias("n"))

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    share = positive / rows
    cells = [(a, n * share), (n - a, n * (1 - share)), (positive - a, (rows - n) * share), (rows - positive - n + a, (rows - n) * (1 - share))]
    g2 = 2 * sum((term(seen, expected) for seen, expected in cells), F.lit(0.0))
    ratio = F.ln((a + 0.5) / (positive - a + 0.5)) - F.ln((n - a + 0.5) / (rows - positive - n + a + 0.5))
    strong = counts.where("n >= 3").select("word", ratio.alias("ratio"), g2.alias("g2")).where(F.col("g2") >= MIN_Z**2)
    return {bytes(r.word): max(-6.0, min(6.0, r.ratio)) for r in strong.collect()}


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_labelled: int = MAX_LABELLED) -> dict | None:
    """The document model, or None where no label tells documents apart.

    Only the telling words and 18 measures a row of the sample reach the driver;
    both are bounded by ``max_labelled``.
    """
    sample = scratch.write(labelled_sample(docs, labels, max_labelled), "sample")
    rows, poor, toxic = sample.agg(F.count("*"), F.count_if("poor"), F.count_if("toxic")).first()
    heads = [(label, n) for label, n in (("poor", poor), ("toxic", toxic)) if 0 < n < rows]
    if not heads:
        return None
    words = sample.mapInArrow(_word_batches, "poor boolean, toxic boolean, words array<binary>")
    words = words.select("poor", "toxic", F.explode("words").alias("word"))
    evidence = [_evidence(words, label, rows, n) for label, n in heads]
    found = sample.mapInArrow(_measure_batches(evidence), "poor boolean, toxic boolean, x array<double>").collect()
    found.sort()
    x = np.array([r.x for r in found])
    model = {"evidence": evidence, "mean": x.mean(0), "scale": x.std(0) + 1e-9}
    x = (x - model["mean"]) / model["scale"]
    return model | {"heads": [_logistic(x, np.array([float(r[label]) for r in found])) for label, _ in heads]}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> dict:
    """Ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -20, 20)))
        slope = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {"w": w[:-1], "b": float(w[-1])}


def _strength(groups: DataFrame, mean: str, prior: str) -> DataFrame:
    """One row ``kappa``: pseudo-counts of the beta prior, from the spread of group means around ``prior``.

    The spread beyond what groups of their size show by chance; without any the
    prior is as strong as a million rows, at least it is as strong as one.
    """
    chance = F.sum(F.col(prior) * (1 - F.col(prior)))
    spread = F.sum(F.col("n") * (F.col(mean) - F.col(prior)) ** 2) - chance
    between = spread / F.greatest(F.sum("n") - F.sum(F.col("n") ** 2) / F.sum("n"), F.lit(1.0))
    level = F.avg(F.col(prior) * (1 - F.col(prior)))
    kappa = F.when(between > 1e-12, level / between - 1).otherwise(1e6)
    return groups.agg(F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.coalesce(kappa, F.lit(1e6)))).alias("kappa"))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(p / (1 - p))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_labelled: int = MAX_LABELLED, threshold: float = 0.5) -> DataFrame:
    """``row_key, doc_id, p_doc, host_rate, site_rate, score, keep`` of every row of ``docs``.

    ``labels`` has ``doc_id, quality, toxic``.  ``host`` and ``path`` name the columns of
    the two site levels; null is a site like any other.  A null text is scored as
    an empty one.  ``row_key`` identifies id and text.  Without labelled examples
    of both classes every document is kept.  Rows that agree in id, text, host and
    path give one row each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    labels = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int"))
    site = [F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *site)
    model = fit(texts, labels, scratch, max_labelled)
    keyed = texts.withColumn("row_key", F.struct("doc_id", "host", "path", F.xxhash64("text").alias("text_hash")))
    scored = scratch.write(keyed.select("row_key", "text").mapInArrow(_score_batches(model), keyed.select("row_key").schema.add("p_doc", "double")), "scored")
    scored = scored.select("row_key", "p_doc", "row_key.doc_id", "row_key.host", "row_key.path")

    paths = scratch.write(scored.groupBy("host", "path").agg(F.sum("p_doc").alias("s"), F.count("*").cast("double").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rate = paths.agg((F.sum("s") / F.sum("n")).alias("rate")).scalar()
    hosts = hosts.withColumns({"mean": F.col("s") / F.col("n"), "rate": rate})
    of_hosts = _strength(hosts, "mean", "rate").scalar()
    hosts = hosts.select("host", "rate", ((F.col("s") + of_hosts * F.col("rate")) / (F.col("n") + of_hosts)).alias("host_rate"))
    joined = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    joined = scratch.write(joined.withColumn("mean", F.col("s") / F.col("n")), "sites")
    of_paths = _strength(joined, "mean", "host_rate").scalar()
    sites = joined.select(
        F.col("host").alias("_host"), F.col("path").alias("_path"), "rate", "host_rate",
        ((F.col("s") + of_paths * F.col("host_rate")) / (F.col("n") + of_paths)).alias("site_rate"),
    )
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    log_odds = _logit(F.col("p_doc")) + _logit(F.col("site_rate")) - _logit(F.col("rate"))
    out = out.withColumn("score", 1 / (1 + F.exp(-log_odds)))
    return out.select("row_key", "doc_id", "p_doc", "host_rate", "site_rate", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with their columns."""
    bad = score(docs, labels, host, path, **options).where("not keep").select("row_key.*").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", host, path, "text")
    same = (
        rows["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & rows[host].cast("string").eqNullSafe(bad["host"])
        & rows[path].cast("string").eqNullSafe(bad["path"]) & (F.xxhash64(rows["text"].cast("string")) == bad["text_hash"])
    )
    return rows.join(bad, same, "left_anti").select("row.*")
