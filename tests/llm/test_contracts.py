"""Clashing names, nulls, bounds and skew; operators that SQL cannot express against plain evaluations; the driver's tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, decontaminate, embeddings, exactdup, langid, lines, mixing, nearcopies, quality, sharding, urls
from millrace.llm.common import held_out, table

from .test_operators import classes_of

DATA = "/root/testdata/sf0.01"
TEXTS = [None, "", " ", "plain words follow here and there", "12 34", "same line\nsame line\nother", "é" * 40, "word " * 30_000, "x" * 20_000]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with a column of every name that an operator adds or uses, each with a value of its own."""
    names = ["score", "predicted", "lang_pred", "rejected", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "size", "taken", "target", "shard", "slot", "law", "grown_shard",
             "class_id", "n_lines", "n_removed", "n_runs", "key", "block", "start", "uid", "epoch", "cid", "id", "h1", "runs", "fp", "at", "kept", "k1", "item", "win", "__text", "__key", "__salt", "__row", "__hit", "n"]
    rows = [(i, t, ["en", None][i % 2], ["a", None, "b"][i % 3], *[f"own {n}" for n in names]) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "plain words follow here and there", "en", "a", *["x"] * len(names))]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(rows, schema).repartition(2).cache(), names


# ------------------------------------------------------------------------------------------------ clashing columns


def test_clashing_columns(spark, clashing):
    docs, names = clashing
    n, everything = docs.count(), docs.columns
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "plain words follow here"), (2, "same line same")], "item_id long, text string")

    def same(out, added):
        """All rows, results in the place of columns of their names, all others untouched."""
        rows = out.collect()
        assert len(rows) == n and set(out.columns) == set(everything) | set(added) and len(out.columns) == len(set(out.columns))
        left = [c for c in names if c not in added]
        assert all(r[c] in (f"own {c}", "x") for r in rows for c in left)
        return rows

    rows = same(quality.classify(docs, quality.fit(docs, labels), everything), ["score", "predicted"])
    assert all(0 <= r["score"] <= 1 for r in rows)
    rows = same(langid.identify(docs, langid.fit(docs), everything), ["lang_pred", "score", "rejected"])
    assert all(r["lang_pred"] == "und" for r in rows if not (r["text"] or "").strip())
    rows = same(decontaminate.contamination(docs, bench, everything), decontaminate.RESULT)
    assert {r["doc_id"] for r in rows if r["n_items"] == 1} == {None, 3, 5}
    same(lines.dedup_lines(docs), ["n_lines", "n_removed", "n_runs", "kept_text"])
    for out in (langid.identify(docs, langid.fit(docs), everything, only_accepted=True), decontaminate.contamination(docs, bench, everything, below=1), nearcopies.keep_one(docs), mixing.mixed_texts(docs)):
        assert out.columns == everything and all(r["score"] in ("own score", "x") and r["__text"] in ("own __text", "x") for r in out.collect())
    assert exactdup.remove_repeats(docs).count() == n and sharding.shard_documents(docs).count() == n and mixing.mix_digest(docs).count() == n
    assert nearcopies.near_copies(docs).count() == n - 1


def test_clashing_columns_of_other_tables(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0], "a", 5, "x"), (2, [1.0, 0.1], "a", 6, "x")], "vec_id long, embedding array<double>, label string, n_links long, key string")
    assert sorted(map(tuple, embeddings.near_embeddings(vec).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    pages = spark.createDataFrame([(1, "x://a.net/", "own", "own")], "page_id long, url string, rule string, key string")
    assert urls.judge(pages).collect()[0].asDict() == {"page_id": 1, "host": "a.net", "path": "/", "rule": "net/", "verdict": "block"}


# ------------------------------------------------------------------------------------------------ folders


def test_temporary_folders_are_for_local_sessions(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common._local_folder(Elsewhere)
    assert os.path.isdir(common._local_folder(spark))


# ------------------------------------------------------------------------------------------------ 2: embeddings


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200, 4e-310])
def test_vectors_of_any_magnitude(spark, scale):
    rng = np.random.RandomState(1)
    base = rng.randn(8)
    rows = [(i, [float(x) for x in (base + rng.randn(8) * 0.02) * (scale if i % 2 else 1.0)], "a") for i in range(10)] + [(20, [float(x) for x in -base * scale], "a")]
    rows += [(30, [1e200, 1e200], "a"), (31, [1.0, 1.0001], "a"), (32, [5e-324, 5e-324], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_embeddings(df).collect()}
    assert got == {**{i: (9, 0) for i in range(10)}, 20: (0, 20), **{i: (2, 30) for i in (30, 31, 32)}}


def test_dense_bucket_in_blocks(spark):
    """Hundreds of different vectors that all link: links are counted over pairs of blocks."""
    rng = np.random.RandomState(2)
    c = rng.randn(12)
    rows = [(i, [float(x) for x in c + rng.randn(12) * 0.02], "hot") for i in range(300)] + [(1000 + i, [float(x) for x in rng.randn(12)], "hot") for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(1) - 1
    for block in (None, 64):
        got = {r["vec_id"]: r["n_links"] for r in embeddings.near_embeddings(df, block=block).collect()}
        assert [got[r[0]] for r in rows] == want.tolist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="needs the check tool's tables")
def test_recall_on_the_drivers_vectors(spark):
    d = "/root/testdata/check_s"  # its embeddings hold links, those of the sf tables none
    rows = [r for r in table(spark, d, "embeddings").select("vec_id", "label", "embedding").collect() if r["label"] is not None and r["embedding"]]
    by_label = collections.defaultdict(list)
    for r in rows:
        by_label[r["label"]].append(r)
    want = 0
    for part in by_label.values():
        x = np.array([r["embedding"] for r in part], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want += int((x @ x.T >= 0.93).sum()) - len(x)
    got = embeddings.near_embeddings(table(spark, d, "embeddings")).agg(F.sum("n_links")).first()[0]
    assert want > 100 and 0.999 * want <= got <= want


# ------------------------------------------------------------------------------------------------ 3 and 4: classifiers


def language_by_hand(m, text):
    """Average of the rows of every subword of one text, in plain loops."""
    b = [0x20] + [c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in text] + [0x20] * 5
    total, n = [0.0] * len(m.langs), 0
    for i in range(len(text) + 2):
        if b[i] == 0x20 and b[i + 1] == 0x20:
            continue
        for k, order in enumerate(langid.ORDERS):
            if any(b[i + j] == 0x20 for j in range(1, order - 1)):
                continue
            packed = sum(b[i + j] << 8 * j for j in range(order))
            row = m.rows[((packed * 2654435761 & 0xFFFFFFFF) >> 19) + 1 + k * langid.BUCKETS]
            total, n = [t + float(x) for t, x in zip(total, row)], n + 1
    return [t / max(n, 1) + b for t, b in zip(total, m.bias)]


def test_language_against_plain_loops(spark):
    rng, r = np.random.RandomState(5), random.Random(5)
    m = langid.Model(["aa", "bb", "cc"], np.concatenate([np.zeros((1, 3)), rng.randn(3 * langid.BUCKETS, 3)]).astype(np.float32), rng.randn(3), 0.7, 0.6)
    texts = ["", "a", "A b", "12!", "été ñ", "x" * 50, "Word-word  and\tmore.\n"] + ["".join(r.choice("abC é.1 ") for _ in range(r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in langid.identify(df, m, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        z = [v / m.temperature for v in language_by_hand(m, t.encode())]
        p = [math.exp(v - max(z)) for v in z]
        best = max(p) / sum(p)
        assert got[i]["lang_pred"] == m.langs[p.index(max(p))] and abs(got[i]["score"] - best) < 1e-4
        assert got[i]["rejected"] == (got[i]["score"] < m.reject_below)


def test_sample_bound(spark):
    """Whatever the rows' sizes and however often a row repeats, the sample stays under its bound."""
    sizes = [(i, 100 + i % 900) for i in range(3000)] + [(9000, 70_000), (9001, 10_000_000)] + [(9002, 500)] * 800
    df = spark.createDataFrame(sizes, "doc_id long, n long")
    for limit in (8_000, 200_000, 1 << 40):
        got = langid.sampled(df, F.col("n"), ["doc_id"], limit).agg(F.sum("n"), F.max("n"), F.count("*")).first()
        assert (got[0] or 0) <= limit and (got[1] or 0) <= limit // 8
        assert got[2] > 0.4 * limit / 700 or limit > 1 << 30 and got[2] == len(sizes)


def test_quality_learns_from_whole_texts(spark):
    """What tells the classes apart stands in one place, anywhere in a long text."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        words = ["plain words follow here"] * rng.choice([100, 400])
        if i % 2:
            words.insert(rng.randrange(len(words)), "@@@@ " * 30)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality.classify(df, quality.fit(df, labels), ["doc_id"]).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == 1 - i % 2 for i in held) >= 0.95 * len(held)


def test_quality_chunks_cover_texts():
    texts = [bytes([i % 251 + 1]) * n for i, n in enumerate((0, 1, 63, 64, 192, 255, 256, 257, 1000, 70_000))]
    x, first = quality._chunks(texts)
    last = np.append(first[1:], len(x))
    for t, a, b in zip(texts, first, last):
        made = bytearray((b - a - 1) * quality.STRIDE + x.shape[1])
        for k in range(a, b):
            made[(k - a) * quality.STRIDE : (k - a) * quality.STRIDE + x.shape[1]] = x[k].tobytes()
        assert bytes(made).rstrip(b"\0") == t


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.classify(docs, quality.fit(docs, labels), ["doc_id"]).where(held_out(F.col("doc_id"))).join(labels.where("quality IS NOT NULL"), "doc_id").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert len(good) > 20 and len(bad) > 5 and (good[:, None] > bad[None, :]).mean() >= 0.98
    got = langid.identify(docs, langid.fit(docs), ["doc_id", "lang"]).where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() >= 0.97


# ------------------------------------------------------------------------------------------------ 6: near copies


@pytest.mark.parametrize("block", [2, 5])
def test_large_keys_in_blocks(spark, monkeypatch, block):
    """Common band keys that hold several components: outsiders meet all others, over blocks."""
    monkeypatch.setattr(nearcopies, "FEW", 1)
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 12])):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"z{rng.randrange(5000)}" for _ in range(30))) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes_of(rows)


# ------------------------------------------------------------------------------------------------ 7: mixing


def mix_by_hand(spark, rows, block_words, n_shards, seed, rows_per_chunk=50_000):
    """taken of every row: packing, slots and blocks in plain loops."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    hashed = {r["d"]: r["h"] for r in spark.createDataFrame([(d,) for d in {r[0] for r in rows}], "d long").select("d", F.xxhash64("d").alias("h")).collect()}
    by_source = collections.defaultdict(list)
    for k, (d, _, s) in enumerate(rows):
        by_source[s].append(k)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    total, weight = {s: sum(size[k] for k in by_source[s]) for s in order}, {s: i % 3 + 1 for i, s in enumerate(order)}
    want, capped = {}, set()
    while True:  # fill by weight; what would exceed three times its size is capped and the rest shared anew
        free = sum(total.values()) - sum(3 * total[s] for s in capped)
        unit = free / sum(weight[s] for s in order if s not in capped) if len(capped) < len(order) else 0.0
        over = {s for s in order if s not in capped and unit * weight[s] > 3 * total[s]}
        if not over:
            want = {s: 3.0 * total[s] if s in capped else unit * weight[s] for s in order}
            break
        capped |= over
    chunks = max(16, -(-max(map(len, by_source.values())) // rows_per_chunk))
    taken = [0] * len(rows)
    for ix, s in enumerate(order):
        queue = sorted(by_source[s], key=lambda k: (hashed[rows[k][0]] % chunks, rows[k][0] is not None, rows[k][0] or 0, size[k]))
        flat = [k for k in queue for _ in range(size[k])]  # the source's words, by the row they come from
        n = -(-len(flat) // block_words)
        slots = min(3 * n, round(want[s] * n / total[s])) if total[s] else 0
        for slot in range(slots):
            epoch = slot // n
            key = common.mix(np.array([ix], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) + np.array([epoch], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            block = int(mixing.permuted(np.array([slot % n]), np.array([n]), key)[0])
            for k in flat[block * block_words : (block + 1) * block_words]:
                taken[k] += 1
    return collections.Counter((rows[k][0], size[k], total[rows[k][2]], round(want[rows[k][2]], 6), taken[k]) for k in range(len(rows)))


@pytest.mark.parametrize("block_words", [7, 64])
def test_mixing_against_plain_loops(spark, block_words):
    rng = random.Random(block_words)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 90]))), rng.choice(["hot", "hot", "hot", "b", None, "Z", ""])) for i in range(200)]
    rows += [(500, "one word\tmore\x0bend\xa0tail", "tiny"), (501, None, "empty"), (None, "a b c", "b"), rows[3], rows[3], (502, "long " * 3000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_digest(df, block_words, n_shards=5, seed=99).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == mix_by_hand(spark, rows, block_words, 5, 99)


# ------------------------------------------------------------------------------------------------ 8: decontamination


def test_items_without_ids_and_equal_items(spark):
    items = [(None, "alpha beta gamma"), (None, "delta"), (7, "alpha beta gamma"), (8, None), (9, " .. "), (11, "nine")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha BETA gamma y"), (2, "delta delta"), (3, "alpha beta"), (4, None), (5, "alpha beta gammas"), (6, "thealpha beta gamma")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination(docs, bench, ["doc_id"]).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (5, 3, 2, sha("7")), 2: (2, 2, 1, sha("")), 3: (2, 0, 0, sha("")), 4: (0, 0, 0, sha("")), 5: (3, 0, 0, sha("")), 6: (3, 0, 0, sha(""))}
    assert {r["doc_id"] for r in decontaminate.contamination(docs, bench, ["doc_id"], below=1).collect()} == {3, 4, 5, 6}
    assert {r["doc_id"] for r in decontaminate.contamination(docs, bench, ["doc_id"], below=2).collect()} == {2, 3, 4, 5, 6}


def test_windows_choose_the_rarest_shingle(spark):
    """The prefix is the word pair that the fewest different windows of the whole benchmark hold."""
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 14)))) for i in range(60)] + [(70, "a b c d e f g h"), (71, "a b c d e f g h")]
    made = decontaminate.windows(spark.createDataFrame(items, "item_id long, text string").repartition(3)).cache()
    wins = {}
    for _, t in items:
        w = t.split()
        n = min(8, len(w))
        for k in range(len(w) - n + 1):
            wins[" ".join(w[k : k + n])] = w[k : k + n]
    pairs = {k: list(zip(w, w[1:])) or [tuple(w)] for k, w in wins.items()}
    held = collections.Counter(p for ps in pairs.values() for p in set(ps))
    got = {bytes(r["win"]).decode(): r for r in decontaminate.prefixed(made).collect()}
    assert set(got) == set(wins) and all(r["n"] == len(wins[k]) for k, r in got.items())
    for k, r in got.items():
        assert held[pairs[k][r["offset"]]] == min(held[p] for p in pairs[k])


def test_bitmap_is_bounded(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    for bits in (27, 12):
        mask = decontaminate.bitmap(keys, 5000, bits)
        assert len(mask) * 64 <= 1 << bits
        own = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
        assert decontaminate._held(mask, own).all()
    other = np.random.RandomState(0).randint(0, 2**63 - 1, 20_000).astype(np.uint64) * np.uint64(2)
    assert decontaminate._held(decontaminate.bitmap(keys, 5000), other).mean() < 0.01
