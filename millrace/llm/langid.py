"""Operator 4 - language identification.

A text is the average of hashed subword embeddings (byte 2-, 3- and 4-grams of its lower-cased words, with word
boundaries), followed by a linear softmax.  Embeddings and weights are trained together by stochastic gradient descent
in numpy, on whole texts and on short windows of them, until a tenth of the sample that is set aside is predicted no better.
That tenth also fits a temperature and the probability under which a prediction is rejected.

Sample bound: labelled rows of at most `sample_bytes` in total (see `sampled`), drawn by a hash over the whole table; scoring
covers every whole text.

Defined results: null, empty and letterless texts are `und` with score 0 and rejected; without any labelled row all are;
null langs are not learned from; classes that tie go to the language that sorts first; repeated rows are scored alike; very
long texts are read whole in bounded slices; an empty table gives an empty result.  Kept columns named lang_pred, score or
rejected are left out where these are added; all other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import binary_parts, bites, held_out, index_ranges, runs, table, unless, with_text

BUCKETS, DIMS, ORDERS = 1 << 13, 16, (2, 3, 4)
SAMPLE_BYTES = 12_000_000
SLICE_BYTES = 1 << 19
UNDETERMINED = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def sampled(df: DataFrame, n_bytes: Column, key: list[str], limit: int) -> DataFrame:
    """A hash sample of whole rows of at most `limit` bytes in total; a row counts 64 bytes at least.

    Rows lie in bins by the logarithm of a hash of their key, so that the bins from any one on are a sample a tenth larger
    than from the next.  One pass sums them; the sample is what follows the first bin from which all fit.  Rows of over an
    eighth of `limit` are not drawn.
    """
    u = (F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    size, bin_ = F.greatest(n_bytes.cast("long"), F.lit(64)), F.floor(-10 * F.log(u)).cast("int")
    rows = df.withColumn("__bin", bin_).withColumn("__size", size).where(F.col("__size") <= limit // 8)
    sums = {r["__bin"]: r["n"] for r in rows.groupBy("__bin").agg(F.sum("__size").alias("n")).collect()}  # some 280 rows at most
    first, total = max(sums, default=0) + 1, 0
    while first > 0 and total + sums.get(first - 1, 0) <= limit:
        first -= 1
        total += sums.get(first, 0)
    return rows.where(F.col("__bin") >= first).drop("__bin", "__size")


def pieces(off: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, owning row) of the texts with those over `limit` bytes cut, so that memory stays bounded."""
    n = np.maximum(1, -(-(off[1:] - off[:-1]) // limit))
    owner = np.repeat(np.arange(len(off) - 1), n)
    return np.append(off[:-1][owner] + index_ranges(np.zeros(len(n), np.int64), n) * limit, off[-1]), owner


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the subwords at every byte, one column per order, 0 for none; offsets of the texts in them).

    A boundary is set before, between and after the texts, so no subword depends on a neighbour.
    """
    size = off[1:] - off[:-1]
    n = len(raw) + len(size) + 1
    b = np.full(n + 4, 0x20, np.uint32)
    b[np.arange(len(raw)) + np.repeat(np.arange(1, len(size) + 1), size)] = _FOLD[raw]
    edge = b == 0x20
    out = np.zeros((n, len(ORDERS)), np.int32)
    for k, order in enumerate(ORDERS):
        packed = np.zeros(n, np.uint32)
        ok = ~(edge[:n] & edge[1 : 1 + n])
        for j in range(order):
            packed |= b[j : j + n] << np.uint32(8 * j)
            if 0 < j < order - 1:
                ok &= ~edge[j : j + n]
        hashed = (packed * np.uint32(2654435761)) >> np.uint32(32 - 13)
        out[:, k] = np.where(ok, hashed.astype(np.int32) + np.int32(1 + k * BUCKETS), 0)
    # text i with its leading boundary starts at off[i] + i
    return out, np.append(off[:-1] + np.arange(len(size)), n)


def has_letter(raw: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in raw[:64]):
        return True
    return any(ch.isalpha() for ch in raw.decode("utf-8", "replace"))


@dataclass
class Model:
    langs: list[str]
    rows: np.ndarray  # one row of class scores per subword bucket; row 0 is zero
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        total, count = np.zeros((len(off) - 1, len(self.langs))), np.zeros(len(off) - 1)
        cut, owner = pieces(off, SLICE_BYTES)
        for i, j in runs(cut, SLICE_BYTES):
            ids, at = features(raw[cut[i] : cut[j]], cut[i : j + 1] - cut[i])
            got = self.rows[ids[:, 0]]
            for k in range(1, ids.shape[1]):
                got = got + self.rows[ids[:, k]]
            np.add.at(total, owner[i:j], np.add.reduceat(got, at[:-1], axis=0, dtype=np.float64))
            np.add.at(count, owner[i:j], np.add.reduceat((ids > 0).sum(1), at[:-1]))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        z = self.scores(raw, off) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        p = p / p.sum(1, keepdims=True) if len(z) else z
        best = p.argmax(1) if len(z) else np.zeros(0, int)
        score = p[np.arange(len(p)), best]
        lettered = np.array([has_letter(raw[off[i] : off[i + 1]].tobytes()) for i in range(len(off) - 1)], bool)
        langs = [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())]
        score = np.where(lettered, score, 0.0)
        return langs, score, ~lettered | (score < self.reject_below)


def _bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Subwords of each text with their shares, many texts at a time."""
    out, space = [], 1 + BUCKETS * len(ORDERS)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for i, j in runs(off, SLICE_BYTES):
        ids, at = features(np.frombuffer(b"".join(texts[i:j]), np.uint8), off[i : j + 1] - off[i])
        owner = np.repeat(np.arange(j - i), np.diff(at))
        both = (owner[:, None] * space + ids)[ids > 0]
        both, n = np.unique(both, return_counts=True)
        cuts = np.searchsorted(both, np.arange(j - i + 1) * space)
        ids, n = both % space, n.astype(np.float32)
        out += [(ids[a:b], n[a:b] / max(1.0, n[a:b].sum())) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return out


def _loss(bags, truth: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray) -> float:
    """Mean log loss; 0 where there is nothing to measure by."""
    if not len(truth):
        return 0.0
    z = np.stack([(emb[ids] * w[:, None]).sum(0) for ids, w in bags]) @ out + bias
    z = z - z.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]))


def train(texts: list[bytes], langs: list[str], epochs: int = 8, rate: float = 0.5, batch: int = 32, seed: int = 11) -> Model | None:
    """Fits the model; None where there is nothing to learn from."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.RandomState(seed)
    y = np.searchsorted(names, langs)
    set_aside = rng.rand(len(texts)) < 0.1
    fit, owner = [], []
    for i, t in enumerate(texts):
        if set_aside[i]:
            continue
        fit.append(t)
        owner.append(y[i])
        for size in (60, 250):  # short windows, so that short texts are met in training
            if len(t) > 2 * size:
                a = rng.randint(0, len(t) - size)
                fit.append(t[a : a + size])
                owner.append(y[i])
    bags, owner = _bags(fit), np.array(owner, np.int64)
    emb = (rng.randn(1 + BUCKETS * len(ORDERS), DIMS) * 0.1).astype(np.float32)
    emb[0] = 0
    out, bias = np.zeros((DIMS, len(names)), np.float32), np.zeros(len(names), np.float32)
    out += rng.randn(*out.shape).astype(np.float32) * 0.1
    aside = _bags([t for t, x in zip(texts, set_aside) if x and has_letter(t)])
    aside_y = np.array([y[i] for i in range(len(texts)) if set_aside[i] and has_letter(texts[i])], np.int64)
    steps, step, best = max(1, epochs * len(fit) // batch), 0, np.inf
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for a in range(0, len(order), batch):
            take = [i for i in order[a : a + batch] if len(bags[i][0])]
            if not take:
                continue
            ids = np.concatenate([bags[i][0] for i in take])
            w = np.concatenate([bags[i][1] for i in take])[:, None]
            cuts = np.concatenate([[0], np.cumsum([len(bags[i][0]) for i in take])[:-1]])
            avg = np.add.reduceat(emb[ids] * w, cuts, axis=0)
            z = avg @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(take)), owner[take]] -= 1
            lr = rate * (1 - step / steps) + 0.01
            back = (p @ out.T) / 4
            spread = np.repeat(back, [len(bags[i][0]) for i in take], axis=0) * w
            out -= lr * (avg.T @ p) / 4
            bias -= lr * p.sum(0) / 4
            # the rows of one subword are summed first
            order_, spread = np.argsort(ids, kind="stable"), lr * spread * 4
            ids, spread = ids[order_], spread[order_]
            heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            emb[ids[heads]] -= np.add.reduceat(spread, heads, axis=0)
            step += 1
        now = _loss(aside, aside_y, emb, out, bias)
        if now > 0.98 * best:
            break
        best = min(best, now)
    emb[0] = 0
    model = Model(names, (emb @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    check = [i for i in range(len(texts)) if set_aside[i] and has_letter(texts[i])] or list(range(min(len(texts), 50)))
    raw = np.frombuffer(b"".join(texts[i] for i in check), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in check])]).astype(np.int64)
    z, truth = model.scores(raw, off), y[check]

    def loss(t: float) -> float:
        v = z / t
        v = v - v.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(v).sum(1)) - v[np.arange(len(v)), truth]))

    model.temperature = min(np.geomspace(0.2, 5, 33).tolist(), key=loss) if len(check) else 1.0
    v = z / model.temperature
    p = np.exp(v - v.max(1, keepdims=True))
    p = (p / p.sum(1, keepdims=True)).max(1)
    # one correct prediction in five hundred may fall under the bound; never above one half
    right = p[z.argmax(1) == truth]
    model.reject_below = float(min(0.5, np.quantile(right, 0.002))) if len(right) else 0.0
    return model


def fit(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = sampled(rows.select("doc_id", "text", "lang"), F.octet_length("text"), ["doc_id", "text"], sample_bytes)
    got = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").toPandas().sort_values(["doc_id", "lang"], kind="stable")
    return train([bytes(x) for x in got["text"]], got["lang"].tolist())


def identify(docs: DataFrame, model: Model | None, keep: list[str], only_accepted: bool = False) -> DataFrame:
    """Columns `keep` with lang_pred, score and rejected; or just the rows that are not rejected, without these."""
    keep = keep if only_accepted else unless(keep, ["lang_pred", "score", "rejected"])
    added = [] if only_accepted else [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    source, at = with_text(docs, keep)
    schema = T.StructType([*(source.schema[c] for c in keep), *added])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in bites(batches, at):
            raw, off = binary_parts(batch.column(at))
            if model is None:
                langs, score, rejected = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            else:
                langs, score, rejected = model.predict(raw, off)
            out = [batch.column(i) for i in range(len(keep))]
            if only_accepted:
                mask = pa.array(~rejected)
                yield pa.RecordBatch.from_arrays([c.filter(mask) for c in out], schema=arrow)
            else:
                yield pa.RecordBatch.from_arrays([*out, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], schema=arrow)

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
