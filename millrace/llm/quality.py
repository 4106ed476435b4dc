"""Operator 3 - quality classifier: a byte-level convolutional network in numpy.

Filters of five bytes over one-hot bytes are learned as per-byte tables.  A text is cut into overlapping chunks that cover
all of it; in each chunk every filter keeps its largest response, and the chunks' responses, averaged and maximised over
the text, are combined by a logistic unit into one probability.  Training, like scoring, reads every chunk of a text; it ends
when a tenth of the sample that is set aside is predicted no better.

Sample bound: labelled rows of at most `sample_bytes` in total, drawn by a hash over the whole table; scoring covers every
whole text.

Defined results: null and empty texts are scored as one chunk of padding; very long texts are scored whole, slice by slice;
without labelled rows every score is 0.5; a score of exactly 0.3 predicts 1; a document labelled more than once is learned
once per label; null labels are not learned from; repeated rows score alike; an empty table gives an empty result.  Kept
columns named score or predicted are left out; all other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import binary_parts, bites, checkpointed, held_out, runs, table, unless, with_text
from .langid import sampled

WIDTH, FILTERS, CHUNK, STRIDE = 5, 12, 256, 192
BLOCK = 64  # chunk and stride are multiples of it
#: Chunks whose responses are held at a time.
HELD_CHUNKS = 512
SAMPLE_BYTES = 8_000_000
SLICE_BYTES = 1 << 19
THRESHOLD = 0.3


@dataclass
class Model:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # averages, then maxima
    offset: float

    def responses(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Averages and maxima over the chunks of each text."""
        n, size = len(off) - 1, off[1:] - off[:-1]
        # every text is followed by padding, up to a whole number of blocks and no less than one filter
        blocks = np.maximum(1, -(-size // BLOCK))
        at = np.concatenate([[0], np.cumsum(blocks)]) * BLOCK
        b = np.zeros(int(at[-1]) + WIDTH, np.uint8)
        b[np.arange(len(raw)) + np.repeat(at[:-1] - off[:-1], size)] = raw
        r = self.tables[0][b[: at[-1]]]
        for j in range(1, WIDTH):
            r += self.tables[j][b[j : j + at[-1]]]
        # a filter may not reach into the next text: there the last bytes see padding instead
        for j in range(1, WIDTH):
            tail = at[1:] - WIDTH + j
            for k in range(WIDTH - j, WIDTH):
                r[tail] += self.tables[k][0] - self.tables[k][b[tail + k]]
        top = r.reshape(-1, BLOCK, FILTERS).max(1)
        # chunks of CHUNK / BLOCK blocks, STRIDE / BLOCK apart; the last one of a text is cut short
        per, step = CHUNK // BLOCK, STRIDE // BLOCK
        first = at[:-1] // BLOCK
        chunks = np.maximum(1, -(-(blocks - (per - step)) // step))
        owner = np.repeat(np.arange(n), chunks)
        begin = first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * step
        end = first[owner] + blocks[owner]
        best = top[begin]
        for k in range(1, per):
            best = np.maximum(best, top[np.minimum(begin + k, end - 1)])
        act = np.maximum(best + self.bias, 0)
        cut = np.cumsum(chunks) - chunks
        return np.concatenate([np.add.reduceat(act, cut, axis=0) / chunks[:, None], np.maximum.reduceat(act, cut, axis=0)], axis=1)

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(off) - 1)
        for i, j in runs(off, SLICE_BYTES):
            if off[j] - off[i] > 2 * SLICE_BYTES:  # one very long text: its chunks are met slice by slice
                z = self._long(raw[off[i] : off[j]])
            else:
                z = self.responses(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            z = z @ self.weights + self.offset
            out[i:j] = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        return out

    def _long(self, raw: np.ndarray) -> np.ndarray:
        span = SLICE_BYTES // STRIDE * STRIDE
        mean, top, n = np.zeros(FILTERS), np.zeros(FILTERS), 0
        for a in range(0, len(raw), span):
            part = raw[a : a + span + CHUNK - STRIDE]
            chunks = max(1, -(-(-(-len(part) // BLOCK) - (CHUNK - STRIDE) // BLOCK) // (STRIDE // BLOCK)))
            got = self.responses(part, np.array([0, len(part)]))[0]
            mean, top, n = mean + got[:FILTERS] * chunks, np.maximum(top, got[FILTERS:]), n + chunks
        return np.concatenate([mean / n, top])[None]


def _chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, (chunks, CHUNK + WIDTH - 1) bytes with padding behind each text; first chunk of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    blocks = np.maximum(1, -(-size // BLOCK))
    n = np.maximum(1, -(-(blocks * BLOCK - (CHUNK - STRIDE)) // STRIDE))
    room = (n - 1) * STRIDE + CHUNK + WIDTH - 1
    at = np.concatenate([[0], np.cumsum(room)])
    b = np.zeros(int(at[-1]), np.uint8)
    for t, a in zip(texts, at.tolist()):
        b[a : a + len(t)] = np.frombuffer(t, np.uint8)
    first = np.concatenate([[0], np.cumsum(n)])
    begin = np.repeat(at[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * STRIDE
    return b[begin[:, None] + np.arange(CHUNK + WIDTH - 1)[None, :]], first[:-1]


def _peaks(x: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of every filter in every chunk and where it stands; a slice of chunks at a time."""
    top, where = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.int64)
    for a in range(0, len(x), HELD_CHUNKS):
        part = x[a : a + HELD_CHUNKS]
        r = tables[0][part[:, :CHUNK]]
        for j in range(1, WIDTH):
            r += tables[j][part[:, j : j + CHUNK]]
        at = r.argmax(1)
        where[a : a + len(part)], top[a : a + len(part)] = at, np.take_along_axis(r, at[:, None], 1)[:, 0]
    return top, where


def train(texts: list[bytes], labels: list[int], epochs: int = 10, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Model | None:
    if not texts:
        return None
    rng = np.random.RandomState(seed)
    y = np.array(labels, np.float64)
    prior = np.clip(y.mean(), 0.01, 0.99)
    p = {
        "t": (rng.randn(WIDTH, 256, FILTERS) * 0.1).astype(np.float32), "b": np.full(FILTERS, 0.1, np.float32),
        "w": (rng.randn(2 * FILTERS) * 0.1).astype(np.float32), "c": np.array(np.log(prior / (1 - prior)), np.float32),
    }
    set_aside = rng.rand(len(texts)) < (0.1 if len(texts) >= 200 else 0)
    ours, aside = np.flatnonzero(~set_aside), np.flatnonzero(set_aside)
    raw = np.frombuffer(b"".join(texts[i] for i in aside), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in aside])]).astype(np.int64)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    best, kept, worse = np.inf, None, 0
    for epoch in range(epochs):
        order = rng.permutation(ours)
        lr = rate * (1 - epoch / epochs) + 0.001
        for a in range(0, len(order), batch):
            take = order[a : a + batch]
            x, first = _chunks([texts[i] for i in take])
            top, where = _peaks(x, p["t"])
            n = np.diff(np.append(first, len(x)))
            owner = np.repeat(np.arange(len(take)), n)
            h = top + p["b"]
            act = np.maximum(h, 0)
            high = np.maximum.reduceat(act, first)
            feat = np.concatenate([np.add.reduceat(act, first) / n[:, None], high], 1)
            z = feat @ p["w"] + p["c"]
            dz = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[take]) / len(take)).astype(np.float32)
            g = {"w": feat.T @ dz + 1e-4 * p["w"], "c": dz.sum()}
            # the maximum's gradient goes to the first chunk that reaches it
            is_top = act == high[owner]
            seen = np.cumsum(is_top, axis=0)
            is_first = is_top & (seen - (seen[first] - is_top[first])[owner] == 1)
            d = (dz / n)[owner][:, None] * p["w"][:FILTERS] + is_first * (dz[owner][:, None] * p["w"][FILTERS:])
            d = np.where(h > 0, d, 0).astype(np.float32)
            g["b"] = d.sum(0)
            g["t"] = np.zeros_like(p["t"])
            i, f = np.nonzero(d)
            for j in range(WIDTH):
                np.add.at(g["t"][j], (x[i, where[i, f] + j], f), d[i, f])
            step += 1
            for k in p:  # Adam
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        now = Model(p["t"].astype(np.float32), p["b"].astype(np.float32), p["w"].astype(np.float64), float(p["c"]))
        if not len(aside):
            kept = now
            continue
        q = np.clip(now.score(raw, off), 1e-6, 1 - 1e-6)
        loss = float(-np.mean(np.where(y[aside] == 1, np.log(q), np.log(1 - q))))
        worse = 0 if loss < 0.98 * best else worse + 1
        if loss < best:
            best, kept = loss, now
        if worse == 2:
            break
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """The sample is drawn from the sizes of labelled rows; only the sample's texts are ever joined."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("__quality")).distinct()
    rows = docs.where(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("__row"))
    sizes = rows.select("doc_id", "__row", F.octet_length("text").alias("__n")).join(known, "doc_id")
    drawn = checkpointed(sampled(sizes, F.col("__n"), ["__row"], sample_bytes).select("doc_id", "__row", "__quality").distinct())
    # of sample_bytes / 64 rows at most
    share = rows.join(F.broadcast(drawn), ["doc_id", "__row"]).select("doc_id", F.col("text").cast("binary").alias("text"), "__quality")
    got = share.toPandas().sort_values(["doc_id", "__quality", "text"], kind="stable")
    return train([bytes(x) for x in got["text"]], got["__quality"].tolist())


def classify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Columns `keep` with score and predicted."""
    keep = unless(keep, ["score", "predicted"])
    source, at = with_text(docs, keep)
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in bites(batches, at):
            raw, off = binary_parts(batch.column(at))
            score = np.full(batch.num_rows, 0.5) if model is None else model.score(raw, off)
            out = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=arrow)

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
