"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model of a text's form (capitals, punctuation, repetition and the like), fitted on a bounded
sample of labelled rows, gives each document's evidence. Sites have two levels, host and path: the sums of
the evidence by path and host are Beta-binomial observations. A host's posterior is shrunk toward the global
mean, a path's toward its host's, by prior strengths that the method of moments takes from the corpus, so
sparse sites say little. A document's quality is its own evidence with the prior odds of its path in place of the
global ones. The path's posterior leaves out the document itself; its host's, to which the path is shrunk, does not.

``documents`` has no URLs: the host is ``source``, the path within it ``lang``.

Edge cases: null text is empty; a null host or path is a site of its own; without labels of both kinds every
document has quality 0.5 and is kept; repeated rows count as rows and each row has its own decision, also those
that share an id; an empty table gives no rows; other columns are ignored or, where rows are dropped, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, kernels, scratch

#: Labelled rows used for the fit, about; ridge penalty; quality below which a document is rejected.
SAMPLE = 20_000
RIDGE = 1e-3
REJECT_BELOW = 0.5
#: The rows of one path meet its posterior in up to so many tasks.
SALTS = 64
#: Bounds of prior strengths, in documents.
STRENGTH = (2.0, 1e6)

#: Text bytes that a worker handles at a time.
CHUNK = 2 << 20
FEATURES = 14
_U = np.uint64


def features(column) -> np.ndarray:
    """[row, FEATURES]: the form of each text."""
    buf, offsets = kernels.text_buffer(column)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts, ends, by_doc = kernels.words(buf, offsets)
    words = np.diff(by_doc)
    some, many = np.maximum(sizes, 1), np.maximum(words, 1)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def over_words(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[by_doc[1:]] - sums[by_doc[:-1]]) / many

    upper = (buf >= 65) & (buf <= 90)
    digit = (buf >= 48) & (buf <= 57)
    letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    sign = (buf > 32) & (buf < 127) & ~letter & ~digit
    lone_sign = sign & ((buf == 46) | (buf == 44))
    h = kernels.word_hashes(buf, starts, ends)
    marks = np.concatenate([[0], np.cumsum(sign & ~lone_sign, dtype=np.int64)])
    odd = marks[ends] - marks[starts]
    doc = np.repeat(np.arange(n), words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(by_doc[:-1].tolist(), by_doc[1:].tolist())], float) if n else np.zeros(0)
    letters = np.maximum(total(letter), 1)
    return np.stack(
        [
            np.ones(n),
            total(upper) / letters,
            total(digit) / some,
            total(sign & ~lone_sign) / some,
            total(lone_sign) / some,
            total(buf == 10) / some,
            total(letter) / some,
            over_words(ends - starts <= 2),
            over_words(odd >= 2),
            over_words(odd == ends - starts),
            over_words(same),
            distinct / many,
            np.log1p(words) / 10,
            np.log1p(words) / 10 * distinct / many,
        ],
        1,
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps on standardised columns."""
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[0] = 0, 1
    spread[spread < 1e-12] = 1
    z = (x - mean) / spread
    w = np.zeros(x.shape[1])
    penalty = ridge * len(y) * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + w @ penalty @ w / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty @ w
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    w = w / spread
    w[0] -= w[1:] @ mean[1:]
    return w


def _with_features(rows: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """The columns but ``text``, and the features, or with weights the log odds of the model."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bpe.chunks(batch, "text", CHUNK):
                x = features(part.column("text"))
                out = pa.array(x.tolist(), pa.list_(pa.float64())) if weights is None else pa.array(x @ weights)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), out], [*names, "x"])
        kernels.release()

    kind = F.array(F.lit(0.0)) if weights is None else F.lit(0.0)
    return rows.mapInArrow(run, rows.select(*names, kind.alias("x")).schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from about ``sample`` labelled rows: that many ids, and no more texts, are looked up."""
    labels = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = labels.count()
    part = min(1.0, sample / max(1, n))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < part * (1 << 30))
    rows = docs.join(F.broadcast(chosen), "doc_id").select("quality", "text")
    got = _with_features(rows, None).toArrow()
    y = got.column("quality").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return np.zeros(FEATURES)
    return fit_logistic(np.array(got.column("x").to_pylist()), (y > 0).astype(float))


def _logit(p):
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, near: str) -> float:
    """Prior strength, in documents, by the method of moments: the variance of the sites' means about
    ``near`` less what samples of their sizes would show."""
    m = F.col("s") / F.col("n")
    row = sites.agg(
        F.sum(F.col("n") * (m - F.col(near)) ** 2).alias("between"), F.sum(F.col(near) * (1 - F.col(near))).alias("within"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col(near) * (1 - F.col(near))).alias("spread")
    ).first()
    if not row["n"]:
        return STRENGTH[1]
    excess = (row["between"] - row["within"]) / row["n"]
    spread = row["spread"] / row["n"]
    return float(min(STRENGTH[1], max(STRENGTH[0], spread / excess - 1))) if excess > 0 else STRENGTH[1]


def _decided(rows: DataFrame, labels: DataFrame, carried: list[str], sample: int, reject_below: float, name: str) -> DataFrame:
    """Of rows doc_id, text, host, path and carried columns: doc_id, p_document, p_host, p_path, quality, keep and
    the carried columns."""
    weights = fit(rows.select("doc_id", "text"), labels, sample)
    odds = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.col("x")))
    scored = _with_features(rows, weights).withColumn("p", 1 / (1 + F.exp(-odds))).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).drop("x")
    scored = scratch.materialize(scored, name)
    mask = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    paths = scratch.materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), mask), name)
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(0.999, max(0.001, whole["s"] / whole["n"])) if whole["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("mean", F.lit(mean))
    k = _strength(hosts, "mean")
    hosts = hosts.select("host", ((k * F.col("mean") + F.col("s")) / (k + F.col("n"))).alias("p_host"))
    paths = scratch.materialize(paths.join(hosts, "host"), name)
    k = _strength(paths, "p_host")
    sites = paths.select("host", "path", "n", "s", "p_host", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)).alias("salt"))
    joined = scored.join(sites, ["host", "path", "salt"])
    p_path = (k * F.col("p_host") + F.col("s") - F.col("p")) / (k + F.col("n") - 1)
    p_path = F.greatest(F.lit(0.001), F.least(F.lit(0.999), p_path))
    quality = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("p_path")) - _logit(F.lit(mean)))))
    out = joined.withColumn("p_path", p_path).withColumn("quality", quality if weights.any() else F.lit(0.5))
    return out.select("doc_id", F.col("p").alias("p_document"), "p_host", "p_path", "quality", (F.col("quality") >= reject_below).alias("keep"), *carried)


def _site(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, reject_below: float = REJECT_BELOW, name: str = "quality") -> DataFrame:
    """doc_id, p_document, p_host, p_path, quality, keep of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _site(host).alias("host"), _site(path).alias("path"))
    return _decided(rows, labels, [], sample, reject_below, name)


def drop_rejected(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, reject_below: float = REJECT_BELOW, name: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns: every row goes through by itself."""
    carry = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _site(host).alias("host"), _site(path).alias("path"), *(docs[c].alias(n) for c, n in zip(docs.columns, carry)))
    return _decided(rows, labels, carry, sample, reject_below, name).where("keep").select(*carry).toDF(*docs.columns)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
