"""Each operator against brute force, on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import decontaminate, embeddings, exactdup, graph, langid, lines, mixing, nearcopies, quality, sharding, suffix, urls
from millrace.llm.common import slide_min

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def key(r):
    return (r[0] is not None, r[0] or 0, (r[1] or "").encode())


# ------------------------------------------------------------------------------------------------ kernels


def test_sliding():
    x = np.random.RandomState(0).randint(0, 100, 50)
    for w in (1, 2, 3, 7, 8, 50):
        assert slide_min(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]
    assert len(slide_min(x, 51)) == 0


@pytest.mark.parametrize("seed", range(30))
def test_suffix_array(seed):
    rng = np.random.RandomState(seed)
    t = rng.randint(97, 98 + seed % 4, rng.randint(1, 150)).astype(np.uint8)
    t = np.concatenate([t, t[: len(t) // 2], t]) if seed % 3 == 0 else t
    b = t.tobytes()
    sa, rank = suffix.suffix_array(t)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    assert rank[sa].tolist() == list(range(len(b)))
    lcp = suffix.common_prefixes(t, sa, rank, 10)
    for k in range(1, len(b)):
        x, y = b[sa[k] :], b[sa[k - 1] :]
        n = next((c for c, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert lcp[k] == n or (n < 10 and lcp[k] < 10)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 450)]
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    want = {v: root(v) for v in up if root(v) != v}
    df = spark.createDataFrame(pairs, "a long, b long")
    for bound in (1_000_000, 0):
        assert {r["node"]: r["root"] for r in graph.components(df, task_edges=bound).collect()} == want


# ------------------------------------------------------------------------------------------------ 1: repeated strings


def repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=key):
        t = (r[1] or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("shard_bytes", [3_000, 2_000_000])
def test_repeated_strings(docs, corpus, shard_bytes):
    got = exactdup.remove_repeats(docs, shard_bytes).drop("kept").collect()
    assert collections.Counter(tuple(r) for r in got) == repeats(corpus)


def test_repeated_strings_of_common_units(spark, monkeypatch):
    """One string stands in most documents with other surroundings: its least hashes are common in every shard."""
    monkeypatch.setattr(exactdup, "COMMON_UNITS", 2)
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(60)) + line + "".join(rng.choice("qrstuvw ") for _ in range(60))) for i in range(80)]
    got = exactdup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 1500).drop("kept").collect()
    assert collections.Counter(tuple(r) for r in got) == repeats(rows)


def test_repeated_strings_kept_texts_and_empty(spark, no_docs):
    df = spark.createDataFrame([(1, "x" * 50 + "y" * 100), (2, "y" * 100 + "é")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in exactdup.remove_repeats(df, texts=True).collect()}
    assert kept == {1: "x" * 50 + "y" * 100, 2: "é"}
    assert exactdup.remove_repeats(no_docs).count() == 0


def skewed_ids():
    """Ids in two far blocks, near 2**62, null ids of many bytes with repeated rows, one id of many texts and long texts."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, text(200)) for i in [*range(1500), *range(15_000, 16_500)]] + [((1 << 62) + i, text(150)) for i in range(60)]
    rows += [(None, text(120 + i)) for i in range(60)] + [(None, "same " * 40)] * 30 + [(None, None), (None, "")]
    rows += [(700, "one head " + text(160)) for _ in range(40)] + [(20_000 + i, text(3_000)) for i in range(20)]
    return rows


def test_shards_follow_bytes(spark):
    rows = skewed_ids()
    df, total = exactdup.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 100)
    got = [(r["shard"], r["doc_id"], bytes(r["text"] or b"")) for r in df.collect()]
    assert total == sum(len((t or "").encode()) for _, t in rows) and collections.Counter(r[1:] for r in got) == collections.Counter((i, (t or "").encode()) for i, t in rows)
    order = sorted(got, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))  # equal rows may part
    assert all(a[0] <= b[0] for a, b in zip(order, order[1:]))
    df, _ = exactdup.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 2_000)
    sizes = collections.defaultdict(list)
    for r in df.collect():
        sizes[r["shard"]].append(len(r["text"] or b""))
    assert all(len(s) == 1 or sum(s) <= 2 * 2_000 + 200 for s in sizes.values()) and len(sizes) < 2 * total / 2_000


def test_repeated_strings_of_skewed_ids(spark):
    rows = [r for k, r in enumerate(skewed_ids()) if r[0] is None or r[0] == 700 or k % 40 == 0 or r[0] >= 20_000]
    rows += [(i, t + rows[0][1]) for i, t in rows if i == 700] + [(None, rows[0][1] + "tail")]
    got = exactdup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 2_000).drop("kept").collect()
    assert collections.Counter(tuple(r) for r in got) == repeats(rows)


@pytest.mark.parametrize("most", [4, 40])
def test_few_pieces_for_the_driver(spark, monkeypatch, most):
    """Where the driver may be told of few pieces only, large ones are cut by running sums; shards keep their order and size."""
    monkeypatch.setattr(exactdup, "MOST_PIECES", most)
    rows = skewed_ids()
    df, total = exactdup.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2_000)
    got = [(r["shard"], r["doc_id"], bytes(r["text"] or b"")) for r in df.collect()]
    assert total == sum(len(r[2]) for r in got) and collections.Counter(r[1:] for r in got) == collections.Counter((i, (t or "").encode()) for i, t in rows)
    order = sorted(got, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[0]))
    assert all(a[0] <= b[0] for a, b in zip(order, order[1:]))
    sizes = collections.defaultdict(list)
    for r in got:
        sizes[r[0]].append(len(r[2]))
    assert all(len(s) == 1 or sum(s) <= 2 * 2_000 + 3_000 for s in sizes.values())
    few = [r for k, r in enumerate(rows) if r[0] is None or r[0] == 700 or k % 30 == 0] + [(9, rows[0][1] + rows[40][1])]
    got = exactdup.remove_repeats(spark.createDataFrame(few, "doc_id long, text string"), 1_500).drop("kept").collect()
    assert collections.Counter(tuple(r) for r in got) == repeats(few)


# ------------------------------------------------------------------------------------------------ 2: embeddings


def vectors():
    rng = np.random.RandomState(4)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(25):
            c = rng.randn(16)
            for spread in (0, 0, 0.05, 0.08, 0.1):
                rows.append((n, [float(x) for x in (c + rng.randn(16) * spread).astype(np.float32)], label))
                n += 1
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0, 2.0], [1.0, 2.0]]
    rows += [(n + i, v, 1) for i, v in enumerate(bad)]
    rows += [rows[0], (None, rows[0][1], 1), (7, [float(x) for x in rng.randn(16).astype(np.float32)], 2)]
    return rows


def test_near_embeddings(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = collections.Counter(), {k: k for k in range(len(rows))}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    want = collections.Counter((r[0], links[k], least.get(root(k))) for k, r in enumerate(rows))
    for block in (1024, 4):
        got = embeddings.near_embeddings(df, block=block).collect()
        assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_hashing_plan():
    n_hashes, n_tables = embeddings.plan(5000)
    near = embeddings.agreement(math.sqrt(2 - 2 * 0.93)) ** n_hashes
    assert (1 - near) ** n_tables <= embeddings.MISS


# ------------------------------------------------------------------------------------------------ 3 and 4: classifiers


def junk(rng, n):
    return " ".join(rng.choice(["###", "$$$", "!!", "XXQ", "|"]) + rng.choice("abc") for _ in range(n))


def test_quality(spark, docs, no_docs):
    rng = random.Random(1)
    rows = [(i, junk(rng, 60) if i % 4 == 0 else "plain words follow here " * 10, i % 4 != 0) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(q), 0) for i, _, q in rows] + [(1, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {r["doc_id"]: r for r in quality.classify(df, model, ["doc_id"]).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all(got[i]["predicted"] == int(i % 4 != 0) for i in held)
    out = quality.classify(docs, model, ["doc_id"]).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    # the whole text counts: junk at the very end of a long text is found
    late = spark.createDataFrame([(1, "plain words follow here " * 4000), (2, "plain words follow here " * 4000 + junk(rng, 2000))], "doc_id long, text string")
    a, b = (r["score"] for r in quality.classify(late, model, ["doc_id"]).orderBy("doc_id").collect())
    assert b < a
    none = quality.fit(no_docs, labels)
    assert none is None and {r["score"] for r in quality.classify(df, none, ["doc_id"]).collect()} == {0.5}
    assert quality.classify(no_docs, model, ["doc_id"]).count() == 0


def test_quality_scores_do_not_depend_on_neighbours():
    rng = np.random.RandomState(3)
    m = quality.Model(rng.randn(5, 256, 12).astype(np.float32), rng.randn(12).astype(np.float32), rng.randn(24), 0.1)
    texts = [bytes(rng.randint(0, 256, n).astype(np.uint8)) for n in (0, 1, 3, 63, 64, 65, 200, 256, 300, 449, 5000)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    together = m.score(np.frombuffer(b"".join(texts), np.uint8), off)
    alone = [m.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone)
    for t, s in zip(texts, alone):  # direct evaluation of every chunk
        t = np.frombuffer(t, np.uint8)
        padded = np.zeros(max(1, -(-len(t) // 64)) * 64 + 5, np.uint8)
        padded[: len(t)] = t
        n = len(padded) - 5
        r = sum(m.tables[j][padded[j : j + n]] for j in range(5))
        chunks = [np.maximum(r[a : a + 256].max(0) + m.bias, 0) for a in range(0, max(1, n - 64), 192)]
        z = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ m.weights + m.offset
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-5


def test_language(spark, docs, no_docs):
    rng = random.Random(2)
    stems = {"aa": ["tion", "the", "ing", "wha"], "bb": ["schen", "über", "ung", "der"], "cc": ["eau", "çois", "ment", "les"]}
    rows = [(i, " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 150)]
    rows += [(900 + i, t, None) for i, t in enumerate([None, "", "12 !! 34", "\n", "the whating"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model, ["doc_id"]).collect()}
    held = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.98 * len(held)
    for i in range(900, 904):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert got[904]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.identify(docs, model, docs.columns, only_accepted=True)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert langid.fit(no_docs) is None
    assert {r["lang_pred"] for r in langid.identify(df, None, ["doc_id"]).collect()} == {"und"}


def test_language_scores_do_not_depend_on_neighbours(monkeypatch):
    rng = np.random.RandomState(3)
    m = langid.Model(["a", "b"], np.concatenate([np.zeros((1, 2)), rng.randn(3 * langid.BUCKETS, 2)]).astype(np.float32), np.zeros(2), 1.0, 0.0)
    texts = [t.encode() for t in ["", "a", "ab", "word and word", "é", "x" * 30, "tail"]]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    together = m.scores(np.frombuffer(b"".join(texts), np.uint8), off)
    assert np.allclose(together, [m.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts], atol=1e-6)
    whole = m.scores(np.frombuffer(b"one two " * 50, np.uint8), np.array([0, 400]))
    monkeypatch.setattr(langid, "SLICE_BYTES", 64)
    assert np.abs(m.scores(np.frombuffer(b"one two " * 50, np.uint8), np.array([0, 400])) - whole).max() < 0.2


# ------------------------------------------------------------------------------------------------ 5: lines


@pytest.mark.parametrize("run_lines", [1, 2, 3])
def test_lines(spark, unique_docs, no_docs, run_lines):
    rng = random.Random(8)
    extra = [(1000 + i, "\n".join(rng.choice(["l1", "l2", "l3", "", "l4", " ", "l5 x"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    rows = [(r["doc_id"], r["text"]) for r in unique_docs.select("doc_id", "text").collect()] + extra
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        all_ = [] if t is None else t.split("\n")
        full = [k for k, x in enumerate(all_) if x.strip(" ")]
        gone, now = set(), []
        for p in range(len(full) - run_lines + 1):
            w = tuple(all_[k] for k in full[p : p + run_lines])
            if w in seen:
                gone.update(range(p, p + run_lines))
            seen.add(w)
            now.append(w)
        left = {full[p] for p in gone}
        want[i] = (len(full), len(gone), sum(1 for p in gone if p - 1 not in gone), t if not gone else "\n".join(x for k, x in enumerate(all_) if k not in left))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    got = lines.dedup_lines(df, run_lines).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_runs"], r["kept_text"]) for r in got} == want
    assert lines.dedup_lines(no_docs, run_lines).count() == 0


def lines_by_hand(rows, run_lines, long_words):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        all_ = [] if t is None else t.split("\n")
        full = [k for k, x in enumerate(all_) if x.strip(" ")]
        gone = set()
        for size, found in ((run_lines, lambda p: True), (1, lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", all_[full[p]])) > long_words)):
            for p in range(len(full) - size + 1):
                w = (size, *(all_[k] for k in full[p : p + size]))
                if found(p):
                    if w in seen:
                        gone.update(range(p, p + size))
                    seen.add(w)
        left = {full[p] for p in gone}
        out[i] = (len(full), len(gone), sum(1 for p in gone if p - 1 not in gone), t if not gone else "\n".join(x for k, x in enumerate(all_) if k not in left))
    return out


@pytest.mark.parametrize("run_lines", [2, 3, 4])
def test_maximal_runs_and_long_lines(spark, run_lines):
    """Runs that continue beyond a fingerprint's extensions, match several earlier places in turn, and a line in most documents."""
    rng = random.Random(run_lines)
    long_ = " ".join(f"w{i}" for i in range(8))
    alphabet = ["a", "b", "c", "hot", "hot", " ", "", "d e", long_, "\t", "x" * 30]
    rows = [(i, "\n".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    whole = "\n".join(str(i) for i in range(3000))
    rows += [(200, whole), (201, f"head\n{whole}\nhot\ntail"), (202, whole.replace("1500", "other")), (203, "hot\n" * 400), (204, None), (205, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.dedup_lines(df, run_lines, 7).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_runs"], r["kept_text"]) for r in got} == lines_by_hand(rows, run_lines, 7)
    # one row per selected position, and each run of lines is an extension of exactly one
    made = lines.fingerprints(df, run_lines).collect()
    runs = collections.Counter((r["__doc"]["id"], x["at"]) for r in made for x in r["runs"])
    assert set(runs.values()) == {1} and len(runs) == sum(max(0, n[0] - run_lines + 1) for n in lines_by_hand(rows, run_lines, 7).values()) and len(made) < len(runs)


def test_lines_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a\nb", "mine", "own")], "doc_id long, text string, kept_text string, other string")
    (r,) = lines.dedup_lines(df).collect()
    assert r.asDict() == {"doc_id": 1, "text": "a\nb", "other": "own", "n_lines": 2, "n_removed": 0, "n_runs": 0, "kept_text": "a\nb"}


def test_lines_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in lines.dedup_lines(df).collect())
    assert got == [(0, 0), (1, 2), (1, 2)]  # the null id comes first; equal rows are one document


def test_lines_of_many_words(spark, no_docs):
    """A repeated line of many words goes wherever it stands; short common lines stay unless they make a run."""
    long_, edge = " ".join(f"w{i}" for i in range(51)), " \t".join(f"v{i}" for i in range(50))
    rows = [(1, f"a\n{long_}\n\nb\n{edge}"), (2, f"c\n{long_}\n\nd\n{edge}\ne"), (3, long_), (4, edge), (5, f"{long_}\n{long_}"), (6, "a\nf\nb"), (7, f"x\na\n{long_}\ny"), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_runs"], r["kept_text"]) for r in lines.dedup_lines(df, long_words=50).collect()}
    want = {i: (0, 0, t) for i, t in rows}
    # in 2 the long line alone goes, as edge has 50 words only; in 7 the run of a and the long line stands in 1 already
    want.update({2: (1, 1, f"c\n\nd\n{edge}\ne"), 3: (1, 1, ""), 5: (2, 1, ""), 7: (2, 1, "x\ny")})
    assert got == want
    assert lines.dedup_lines(no_docs, long_words=50).count() == 0


# ------------------------------------------------------------------------------------------------ 6: near copies


def classes_of(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("few", [32, 1])
def test_near_copies(unique_docs, monkeypatch, few):
    monkeypatch.setattr(nearcopies, "FEW", few)
    rows = [(r["doc_id"], r["text"]) for r in unique_docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in nearcopies.near_copies(unique_docs).collect()}
    assert got == classes_of(rows)


def test_near_copies_keep_one(docs, no_docs):
    got = collections.Counter(r["doc_id"] for r in nearcopies.near_copies(docs).collect())
    assert got[3] == 3 and None not in got and sum(got.values()) == docs.count() - 1
    kept = nearcopies.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and None in ids
    assert nearcopies.near_copies(no_docs).count() == 0 and nearcopies.keep_one(no_docs).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(0)
    a = [rng.randrange(1 << 50) for _ in range(400)]
    b = a[:320] + [rng.randrange(1 << 50) for _ in range(80)]
    value = np.array(sorted(a) + sorted(b), np.uint64)
    doc = np.repeat([0, 1], 400)
    weight = np.array([1] * 700 + [3] * 100)
    s = nearcopies.signatures(*nearcopies.regions(doc, value, weight), 2)
    assert (s != ~np.uint64(0)).all()
    short = nearcopies.signatures(np.array([0]), np.array([12345], np.uint64), 2)
    assert (short[0] != ~np.uint64(0)).all() and (short[1] == ~np.uint64(0)).all()


# ------------------------------------------------------------------------------------------------ 7: mixing


def test_mixing(spark, docs, corpus, no_docs):
    got = [r.asDict() for r in mixing.mix_digest(docs, block_words=16).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], size(r[1])) for r in corpus)
    sums = collections.Counter()
    for r in corpus:
        sums[r[3]] += size(r[1])
    target = targets_by_hand(sums)
    assert abs(sum(target.values()) - sum(sums.values())) < 1e-6 and all(t <= 3 * sums[s] + 1e-9 for s, t in target.items())
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[sums[s]] - t) <= 32
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.mix_digest(docs, block_words=16).collect())
    assert mixing.mix_digest(no_docs).count() == 0


def targets_by_hand(sizes):
    """Weights 1, 2, 3, 1, ... by code point with null last; what would exceed three times a size is capped and reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped = {s: i % 3 + 1 for i, s in enumerate(order)}, set()
    while True:
        free = [s for s in order if s not in capped]
        unit = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if unit * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else unit * weight[s] for s in order}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 990}, {"a": 1, "b": 2, "c": 3, "d": 1_000_000, "": 40}, {"z": 0, "y": 0}, {"only": 5}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "__source string, source_size long").repartition(3)
    got = {r["__source"]: r for r in mixing.with_targets(rows).collect()}
    want = targets_by_hand(sizes)
    assert all(abs(got[s]["target"] - t) < 1e-6 for s, t in want.items())
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1]["source_ix"])] == sorted(sizes, key=lambda s: (s is None, s or ""))


def test_mixing_of_many_sources(spark, monkeypatch):
    """Buckets of sources, slots in short ranges and a join over salts give what single tasks give: every slot, once."""
    monkeypatch.setattr(mixing, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "RANGE_SLOTS", 5)
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), f"s{i % 40 if i % 3 else 0}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts, plan, slots = mixing.mix_documents(df, 16, 7, 5)
    want = {r["source_ix"]: (r["n_slots"], r["n_blocks"]) for r in plan.collect()}
    got = collections.defaultdict(list)
    sizes = collections.Counter()
    for r in slots.collect():
        got[r["source_ix"]].append((r["slot"], r["epoch"], r["block"]))
        sizes[r["out_shard"]] += 1
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    for ix, (n, blocks) in want.items():
        assert sorted(x[0] for x in got[ix]) == list(range(n)) and all(e == s // blocks for s, e, _ in got[ix])
        for epoch in {x[1] for x in got[ix]}:
            seen = [x[2] for x in got[ix] if x[1] == epoch]
            assert len(seen) == len(set(seen)) and all(0 <= b < blocks for b in seen)
    assert parts.count() == len(rows) and parts.where("target IS NULL").count() == 0


def test_mixed_texts(docs, no_docs):
    made = mixing.mixed_texts(docs, block_words=16)
    assert made.columns == docs.columns
    digest = collections.Counter()
    for r in mixing.mix_digest(docs, block_words=16).collect():
        digest[r["doc_id"]] += r["taken"]
    got = collections.Counter()
    for r in made.collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert +got == +digest
    assert mixing.mixed_texts(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
    assert sorted(p.tolist()) == list(range(n))


def test_shard_counts():
    c = mixing.shard_counts([100, 0, 7, 3000], 16, 3)
    assert c.sum(0).tolist() == [100, 0, 7, 3000] and (c >= 0).all() and c.sum(1).std() < 3
    assert mixing.shard_counts([], 4, 1).shape == (4, 0)


# ------------------------------------------------------------------------------------------------ 8: decontamination


def contaminated(rows, items):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in rows:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = wins.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2))
    return collections.Counter(out)


@pytest.mark.parametrize("bits", [27, 8])
def test_decontamination(spark, docs, corpus, no_docs, bits, monkeypatch):
    if bits == 8:  # nearly every place passes the bitmap, and both sides of the join are exchanged
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
        monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", 0)
        monkeypatch.setattr(decontaminate, "BATCH_ROWS", 7)
    texts = [r[1] for r in corpus]
    items = [(1, " ".join(texts[10].split()[:12])), (2, (texts[62] or "")[:200].upper()), (3, texts[62]), (4, "one"), (5, "ab ab ab"), (6, None), (7, ""), (8, "..."), (9, "no such words in here at all today"), (9, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, ["doc_id"], max_bits=bits)
    want = contaminated([(r[0], r[1]) for r in corpus], items)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    clean = decontaminate.contamination(docs, bench, docs.columns, below=1, max_bits=bits)
    assert clean.columns == docs.columns and clean.count() == sum(n for r, n in want.items() if r[3] == 0)
    assert decontaminate.contamination(docs, bench.limit(0), ["doc_id"]).where("n_items > 0").count() == 0
    assert decontaminate.contamination(no_docs, bench, ["doc_id"]).count() == 0


# ------------------------------------------------------------------------------------------------ 9: urls


PAGES = [
    ("http://a.net/x", "net/"), ("https://EXAMPLE.net/en/1?q=/de/", "example.net/en/"), ("https://www.example.net/EN/1", "net/"), ("x://example.com/de/", "example.com/de/"),
    ("x://example.com/de", None), ("http://m.example.org/fr/9#t", "org/fr/"), ("http://org/fr/", "org/fr/"), ("http://borg/fr/", None), ("http://a.net", None), ("http://a.net?x=/", None),
    ("nothing", None), (None, None), ("://", None), ("http://b.com/a://net/", None), ("http://Ünet.com/é", None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, (u, _) in enumerate(PAGES)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert [got[i]["rule"] for i in range(len(PAGES))] == [r for _, r in PAGES]
    assert [got[i]["host"] for i in (1, 10, 11, 12, 14)] == ["example.net", "", "", "", "Ünet.com"]
    assert [got[i]["path"] for i in (1, 5, 8, 9, 14)] == ["/en/1", "/fr/9", "", "", "/é"]
    assert all(r["verdict"] in ("allow", "block") for r in got.values()) and got[0]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert urls.judge(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(df.where("page_id = 4")).collect()} == {"allow"}  # nothing to learn from


def test_url_model(spark):
    rng = random.Random(3)
    name = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    rows = [f"http://{name('abcd')}.org/fr/{i}" for i in range(150)] + [f"http://{name('wxyz')}.net/{i}" for i in range(150)]
    rows += [f"http://{name('abcd')}.io/{i}" for i in range(40)] + [f"http://{name('wxyz')}.io/{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    for bound in (urls.BROADCAST_GRAMS, 0):
        got = {r["page_id"]: r["verdict"] for r in urls.judge(df, broadcast_grams=bound).collect()}
        assert sum(got[i] == "allow" for i in range(300, 340)) >= 36 and sum(got[i] == "block" for i in range(340, 380)) >= 36


def test_url_model_reads_the_whole_url(spark):
    """Digits, the scheme and what follows ? or # decide where nothing else tells urls apart."""
    rng = random.Random(4)
    n = lambda lo, hi: rng.randint(lo, hi)
    for made in (lambda good: f"?q={'abc' if good else 'xyz'}{n(1, 9)}", lambda good: f"#{n(1000, 1999) if good else n(8000, 8999)}"):
        rows = [f"http://h{n(1, 9)}.org/fr/{made(True)}" for _ in range(120)] + [f"http://h{n(1, 9)}.net/fr/{made(False)}" for _ in range(120)]
        rows += [f"http://h{n(1, 9)}.io/fr/{made(True)}" for _ in range(40)] + [f"http://h{n(1, 9)}.io/fr/{made(False)}" for _ in range(40)]
        df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
        got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
        assert sum(got[i] == "allow" for i in range(240, 280)) >= 34 and sum(got[i] == "block" for i in range(280, 320)) >= 34


def test_url_scores_against_a_model(spark):
    """The scores of a plain evaluation: at each character the longest context that was seen."""
    train = [("aab1", True), ("abba?x", True), ("bb2b", False), ("ba#b", False)]
    grams = collections.defaultdict(lambda: [0, 0])
    for k, ok in train:
        for i in range(len(k)):
            for n in range(1, min(urls.ORDER, len(k) - i) + 1):
                grams[k[i : i + n]][0 if ok else 1] += 1
    total = [sum(c[j] for g, c in grams.items() if len(g) == 1) for j in (0, 1)]

    def p(g, j):
        if len(g) == 1:
            return (grams[g][j] + 1) / (total[j] + urls.ALPHABET) if g in grams else 1.0
        if g not in grams:
            return p(g[1:], j)
        seen = sum(c[j] for x, c in grams.items() if len(x) == len(g) and x[:-1] == g[:-1])
        return (grams[g][j] + urls.BETA * p(g[1:], j)) / (seen + urls.BETA)

    keys = ["aabb", "bb#b2", "zz", "a", "abba?xabba?x"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    model = urls.fit(spark.createDataFrame(train, "key string, accepted boolean"))
    for bound in (urls.BROADCAST_GRAMS, 0):
        got = {r["key"]: r["score"] for r in urls.score(df, model, bound).collect()}
        for k in keys:
            want = sum(math.log(p(k[max(0, i - urls.ORDER + 1) : i + 1], 0) / p(k[max(0, i - urls.ORDER + 1) : i + 1], 1)) for i in range(len(k))) / len(k)
            assert abs(got.get(k, 0.0) - want) < 1e-9


# ------------------------------------------------------------------------------------------------ 10: sharding


def test_sharding(docs, corpus, no_docs):
    got = sharding.shard_documents(docs).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in corpus)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert sharding.shard_documents(no_docs).count() == 0


def test_sharding_balance_and_growth(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    now = {r["k"]: r["shard"] for r in sharding.assign(df, "k", 24).collect()}
    for n in (25, 26, 40):
        later = {r["k"]: r["shard"] for r in sharding.assign(df, "k", n).collect()}
        assert all(later[k] == s or later[k] >= 24 for k, s in now.items())
    sizes = collections.Counter(now.values())
    assert len(sizes) == 24 and max(sizes.values()) < 1.2 * 20_000 / 24
    # shard 5 stands in region 0 and rack 1: rows come in at the level where the weight changed, and move nowhere else
    heavy = {r["k"]: r["shard"] for r in sharding.assign(df, "k", 24, weights={5: 3.0}).collect()}
    for k, s in now.items():
        to = heavy[k]
        if s // 12 != to // 12:
            assert to // 12 == 0
        elif s // 4 != to // 4:
            assert to // 4 == 1
        else:
            assert to in (s, 5)
    assert sum(heavy[k] != s for k, s in now.items()) < 0.3 * 20_000
    assert 2.4 < collections.Counter(heavy.values())[5] / sizes[5] < 3.2


def placed_by_hand(key, n_shards, weights=None):
    """The descent in plain Python."""
    weights = weights or {}
    leaves = [(s // 12, s // 4, s, weights.get(s, 1.0)) for s in range(n_shards)]
    path, level = "", 0
    while level < 3:
        below = collections.Counter()
        for x in leaves:
            below[x[level]] += x[3]

        def arrival(node, w):
            h = hashlib.md5(f"{key}/{path}{node}".encode()).hexdigest()[:13]
            return -math.log((int(h, 16) + 0.5) * 2.0**-52) / w

        node = min(below, key=lambda i: arrival(i, below[i]))
        leaves = [x for x in leaves if x[level] == node]
        path, level = f"{path}{node}/", level + 1
    return leaves[0][2]


@pytest.mark.parametrize(("n", "weights"), [(1, None), (24, None), (25, None), (30, {3: 0.5, 17: 4.0, 29: 2.5})])
def test_sharding_descends_the_tree(spark, n, weights):
    df = spark.range(300).selectExpr("id AS k", "'x' AS shard", "1 AS region").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 'x' AS shard, 1 AS region"))
    got = sharding.assign(df, "k", n, weights=weights, grown="then").collect()
    for r in got:
        name = "null" if r["k"] is None else r["k"]
        assert r["shard"] == placed_by_hand(name, n, weights) and r["then"] == placed_by_hand(name, n + 1, weights) and r["region"] == 1
    with pytest.raises(ValueError):
        sharding.assign(df.withColumn("__place", df["k"]), "k", n)
    with pytest.raises(ValueError):
        sharding.topology(2, {0: 0.0})
