"""Toxic spans and document scores by a linear-chain conditional random field.

Two states per token, clean and toxic. Emissions are weights of hashed features of the token (the word, its first 4, 5 and 6
bytes), transitions are three weights. Labels exist per document, so token labels are derived first: a feature is
significant if it stands in toxic documents more often than chance allows among all features tested, and the tokens of
toxic documents that carry such a feature are toxic. The field is fitted on these tokens by gradient ascent; expected
counts come from forward-backward. Both recursions of a two-state chain are fractional linear maps of one ratio, so they run as
a blocked scan over all documents of a batch, which restarts at every document.

A document's score is a logistic function of the sum and the maximum of its tokens' toxic marginals, fitted on sample
documents the field was not fitted on. Tokens above one half are the offending spans (byte offsets).

The model is fitted on a bounded sample: the ``sample_docs`` labelled training documents with the smallest id hash.

Defined cases: null or empty text has no tokens and gets the score of a document without marginals; without labels of
both classes every score is the share of toxic labels (0.0 without any); several labels of one document count as their
maximum; an empty table gives no rows; other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import LOWER, U64, SpanHash, mix, text_slices

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
BLOCK, PART = 128, 200_000


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of letter runs, and each document's first token number."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = LETTER[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    starts = np.flatnonzero(solid & (~np.concatenate(([False], solid[:-1])) | edge[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate((solid[1:], [False])) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(tokens, 1 + prefixes) feature buckets; a word no longer than a prefix has its own bucket there."""
    h = SpanHash(buf, 21, LOWER)
    cols = [h.span(starts, ends)] + [mix(h.span(starts, np.minimum(starts + k, ends)) + U64(k)) for k in PREFIXES]
    return np.stack([(c & U64(BUCKETS - 1)).astype(np.int32) for c in cols], axis=1)


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]) with x before the first taken as 1."""
    n = len(a)
    if not n:
        return a
    k = -(-n // BLOCK)
    pad = k * BLOCK - n

    def blocks(v, fill):
        return np.ascontiguousarray(np.concatenate((v, np.full(pad, fill))).reshape(k, BLOCK).T)

    a, b, c, d = blocks(a, 1.0), blocks(b, 0.0), blocks(c, 0.0), blocks(d, 1.0)
    pa_, pb, pc_, pd = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()
    for i in range(1, BLOCK):
        na, nb, nc, nd = a[i] * pa_ + b[i] * pc_, a[i] * pb + b[i] * pd, c[i] * pa_ + d[i] * pc_, c[i] * pb + d[i] * pd
        s = 1.0 / (na + nb + nc + nd)
        pa_, pb, pc_, pd = na * s, nb * s, nc * s, nd * s
    x, into = 1.0, np.empty(k)
    for j, (p, q, r, s) in enumerate(zip(pa_.tolist(), pb.tolist(), pc_.tolist(), pd.tolist())):
        into[j] = x
        x = (p * x + q) / (r * x + s)
    out = np.empty((BLOCK, k))
    x = into
    for i in range(BLOCK):
        x = (a[i] * x + b[i]) / (c[i] * x + d[i])
        out[i] = x
    return out.T.ravel()[:n]


def forward_backward(emission: np.ndarray, first: np.ndarray, t01: float, t10: float, t11: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(toxic marginals, ratio of forward values, ratio of backward values) of every token."""
    g = np.exp(np.clip(emission, -30, 30))
    p, s, q = np.exp(t01), np.exp(t10), np.exp(t11)
    n = len(g)
    begin = np.zeros(n, dtype=bool)
    begin[first[:-1][np.diff(first) > 0]] = True
    a, b, c = np.where(begin, 0.0, g * q), np.where(begin, g * p, g * p), np.where(begin, 0.0, s)
    ahead = scan(a, b, c, np.ones(n))
    end = np.concatenate((begin[1:], [True]))[:n]
    nxt = np.concatenate((g[1:], [1.0]))[:n]
    a, b, c = np.where(end, 0.0, q * nxt), np.where(end, 1.0, s), np.where(end, 0.0, p * nxt)
    behind = scan(a[::-1], b[::-1], c[::-1], np.ones(n))[::-1]
    odds = ahead * behind
    return odds / (1 + odds), ahead, behind


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    t: tuple[float, float, float]
    logistic: tuple[float, float, float]
    prior: float | None = None

    def marginals(self, buf: np.ndarray, off: np.ndarray):
        starts, ends, first = tokens(buf, off)
        e = self.weights[features(buf, starts, ends)].sum(axis=1) + self.bias if len(starts) else np.zeros(0)
        return starts, ends, first, forward_backward(e, first, *self.t)[0]

    def scores(self, m: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(first) - 1, self.prior)
        a, b, c = self.logistic
        x = evidence(m, first)
        return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -40, 40)))


def evidence(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, 2): log of the summed marginals, largest marginal."""
    docs = len(first) - 1
    total = np.concatenate(([0.0], np.cumsum(m)))
    top = np.zeros(docs)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        top[full] = np.maximum.reduceat(m, first[full])
    return np.stack((np.log(np.maximum(total[first[1:]] - total[first[:-1]], 0) + 1e-3), top), axis=1)


def _adam(value: np.ndarray, rate: float):
    m, v, k = np.zeros_like(value), np.zeros_like(value), 0

    def step(grad):
        nonlocal m, v, k
        k += 1
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad * grad
        value[...] += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.98**k)) + 1e-8)

    return step


def token_table(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all tokens, and each document's first token number; read in slices to keep the hashing small."""
    parts, counts = [np.zeros((0, 1 + len(PREFIXES)), np.int32)], [np.zeros(0, np.int64)]
    for _, _, buf, off in text_slices(pa.array(texts, pa.large_string())):
        starts, ends, first = tokens(buf, off)
        if len(starts):
            parts.append(features(buf, starts, ends))
        counts.append(np.diff(first))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def token_labels(f: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Toxic tokens of the toxic documents by significant features."""
    share = toxic.mean()
    a, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, y in enumerate(toxic):
        own = np.unique(f[first[i] : first[i + 1]])
        n[own] += 1
        a[own] += y
    b = n - a
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(a > 0, a * np.log(a / (n * share)), 0) + np.where(b > 0, b * np.log(b / (n * (1 - share))), 0)
    good = (a > n * share) & (a >= 0.6 * n) & (gain > np.log((n > 0).sum() + 1) + 3)
    return good[f].any(axis=1) & np.repeat(toxic.astype(bool), np.diff(first))


def fit_model(texts: list[str | None], toxic: list[int], rounds: int = 40, l2: float = 1e-3) -> Model:
    y = np.array(toxic, dtype=float)
    plain = Model(np.zeros(BUCKETS, np.float32), 0.0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), float(y.mean()) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return plain
    held = np.arange(len(y)) % 10 >= 7
    own, other = np.flatnonzero(~held), np.flatnonzero(held)
    yt, yc = y[own], y[other]
    if not len(yt) or yt.min() == yt.max():
        return plain
    f, first = token_table([texts[i] for i in own])
    label = token_labels(f, first, yt).astype(float)
    used = np.flatnonzero(np.bincount(f.ravel(), minlength=BUCKETS))
    place = np.zeros(BUCKETS, dtype=np.int32)
    place[used] = np.arange(len(used))
    inside = place[f]
    del f
    begin = np.zeros(len(label), dtype=bool)
    begin[first[:-1][np.diff(first) > 0]] = True
    prev = np.concatenate(([0.0], label[:-1])) * ~begin
    w, rest = np.zeros(len(used)), np.array([-2.0, -2.0, 0.0, 0.0])  # bias, clean to toxic, toxic to clean, toxic to toxic
    step_w, step_r = _adam(w, 0.3), _adam(rest, 0.1)
    observed = np.array([label.sum(), (label * (1 - prev)).sum(), ((1 - label) * prev).sum(), (label * prev).sum()])
    wanted = np.zeros(len(used))
    for k in range(inside.shape[1]):
        wanted += np.bincount(inside[:, k], weights=label, minlength=len(used))
    cuts = np.unique(np.concatenate((np.searchsorted(first, np.arange(0, first[-1], PART)), [len(first) - 1])))
    for _ in range(rounds):
        expected, found = np.zeros(4), np.zeros(len(used))
        for lo, hi in zip(cuts[:-1], cuts[1:]):  # whole documents, about PART tokens at a time
            rows, local = slice(first[lo], first[hi]), first[lo : hi + 1] - first[lo]
            columns = [inside[rows, k] for k in range(inside.shape[1])]
            e = sum(w[c] for c in columns) + rest[0]
            m, ahead, behind = forward_backward(e, local, *rest[1:])
            g = np.exp(np.clip(e, -30, 30)) * behind
            before = np.where(begin[rows], 0.0, np.concatenate(([0.0], ahead[:-1]))[: len(e)])
            p, s, q = np.exp(rest[1:])
            cells = (p * g, before * s, before * q * g)
            total = 1.0 + cells[0] + cells[1] + cells[2]
            expected += [m.sum(), *((c / total).sum() for c in cells)]
            for c in columns:
                found += np.bincount(c, weights=m, minlength=len(used))
        step_w(wanted - found - l2 * len(label) ** 0.5 * w)
        step_r(observed - expected - l2 * len(label) ** 0.5 * rest)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[used] = w
    model = Model(weights, float(rest[0]), tuple(rest[1:].tolist()), (0.0, 1.0, 0.0))
    f, first = token_table([texts[i] for i in other])
    m = forward_backward(sum(weights[f[:, k]] for k in range(f.shape[1])) + model.bias, first, *model.t)[0]
    x = np.column_stack((np.ones(len(yc)), evidence(m, first)))
    if len(yc) and yc.min() != yc.max():
        c = np.zeros(3)
        for _ in range(30):
            z = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            h = (x * (z * (1 - z))[:, None]).T @ x + 0.05 * np.eye(3)
            c += np.linalg.solve(h, x.T @ (yc - z) - 0.05 * c)
        model.logistic = tuple(c.tolist())
    else:
        model.logistic = (1.0, 1.0, 2.0)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from at most ``sample_docs`` labelled training documents (crc32 of the id as text, modulo 4, not 2)."""
    key = F.col(ident).cast("string")
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("key")).agg(F.max(label).cast("int").alias("y"))
    known = known.where(F.crc32(F.col("key").cast("string").cast("binary")) % 4 != 2).orderBy(F.xxhash64("key"), "key").limit(sample_docs)
    picked = docs.where(F.crc32(key.cast("binary")) % 4 != 2).select(F.col(ident).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")
    rows = picked.groupBy("text", "y").agg(F.min("key").alias("key")).orderBy(F.xxhash64("key"), "key").collect()  # a text counts once
    return fit_model([r["text"] for r in rows], [r["y"] for r in rows])


def scored(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct(score, spans): spans are byte ranges of toxic tokens, neighbours joined."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, spans: array<struct<start: long, end: long>>>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model_ = sent.value
        for col in texts:
            values, starts_, ends_, counts = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, buf, off in text_slices(col):
                starts, ends, first, m = model_.marginals(buf, off)
                values.append(model_.scores(m, first))
                hot = m > 0.5
                doc = np.repeat(np.arange(b - a), np.diff(first))
                new = hot & ~(np.concatenate(([False], hot[:-1])) & (np.concatenate(([-1], doc[:-1])) == doc))
                stop = hot & ~(np.concatenate((hot[1:], [False])) & (np.concatenate((doc[1:], [-1])) == doc))
                at = np.flatnonzero(new)
                starts_.append(starts[at] - off[doc[at]])
                ends_.append(ends[np.flatnonzero(stop)] - off[doc[at]])
                counts.append(np.bincount(doc[at], minlength=b - a))
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts_)), pa.array(np.concatenate(ends_))], names=["start", "end"])
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(values)), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["score", "spans"])

    return score(text)


def document_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, ident: str = "doc_id", text: str = "text", **fit_args) -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    model = fit(docs, labels, ident=ident, text=text, **fit_args)
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    out = rows.select("doc_id", scored(rows, model).alias("s"))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"), F.col("s.score").alias("score"),
                      (F.col("s.score") >= cut).cast("int").alias("predicted"), F.col("s.spans").alias("spans"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.3, ident: str = "doc_id", text: str = "text", **fit_args) -> DataFrame:
    """``docs`` without the documents scored at ``cut`` or above."""
    model = fit(docs, labels, ident=ident, text=text, **fit_args)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return rows.withColumn("s", scored(rows, model)).where(F.col("s.score") < cut).select("row.*")
