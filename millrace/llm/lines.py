"""Operator 5 - line dedup by winnowing over line hashes.  DataFrame functions only.

A document is the sequence of its lines that are not blank.  Of every `run_lines` consecutive line hashes the least is
selected as a fingerprint, so that any repeated run of that length shares one at the same place.  Only the selected positions
are shipped, each with its extensions: the hashes of the runs of `run_lines` lines that reach from it to the left and to the
right and have it as their least.  Positions are joined on their fingerprint; where it stands at several, each extension is
joined to the first place of the same run, and one that stands later (greater doc_id, or later in the same document) is a
match.  Matches that overlap in a document continue each other to maximal runs, and the lines of these are deleted.  With
`long_words`, a line of more words than that is a run of its own, whatever its neighbours, so that a long passage is caught
between lines that differ while a short common line stays.

Common fingerprints and runs are counted with partial sums and joined over the salts that they have, so no task holds all
their rows.  Lines are compared by two 64-bit hashes.

Defined results: null and empty texts have no lines and stay as they are; blank lines are never deleted; texts of fewer
lines than a run keep them all but repeated long ones; very long texts are one row of arrays that are walked in time linear
in their lines; rows equal in doc_id and text are one document and are judged alike; rows with equal doc_id and different
texts are ordered by a hash of the text; a null doc_id is the smallest; an empty table gives an empty result; columns of
`docs` named n_lines, n_removed, n_runs or kept_text are replaced by the operator's own, all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_salt, checkpointed, salt_mask, salted, table

#: Runs of RUN_LINES lines, and single lines of more than LONG_WORDS words, go where they stand again.
RUN_LINES, LONG_WORDS = 2, 50
WORD = r"[^\x20\x09-\x0D]+"
EXTRA = {"n_lines", "n_removed", "n_runs", "kept_text"}


def _identified(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__doc", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))


def _split(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def _dense(spots: Column, n: Column) -> Column:
    """n flags, true at the ascending positions `spots`, in time linear in n."""
    before = F.concat(F.array(F.lit(-1)), F.slice(spots, F.lit(1), F.greatest(F.size(spots) - 1, F.lit(0))))
    gaps = F.zip_with(spots, before, lambda s, b: F.concat(F.array_repeat(F.lit(False), s - b - 1), F.array(F.lit(True))))
    tail = n - 1 - F.element_at(spots, -1)
    return F.when(F.size(spots) == 0, F.array_repeat(F.lit(False), n)).otherwise(F.concat(F.flatten(gaps), F.array_repeat(F.lit(False), tail)))


def _made(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and new columns, each evaluated once for a row: what follows cannot be merged into a generator's input."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def fingerprints(docs: DataFrame, run_lines: int) -> DataFrame:
    """One row per selected position: __doc, fp (its line's hash) and `runs`, the (at, k1, k2) of its extensions."""
    df = _identified(docs.select("doc_id", "text"))
    df = _made(df, ["__doc"], full=F.filter(_split(F.col("text")), lambda x: F.trim(x) != ""))
    df = _made(df, ["__doc"], h1=F.transform("full", lambda x: F.xxhash64(x)), h2=F.transform("full", lambda x: F.xxhash64(F.lit("second"), x)))

    def run(i: Column) -> Column:  # i counts from 1
        here = F.slice("h1", i, run_lines)
        spot = i + F.array_position(here, F.array_min(here)) - 2
        return F.struct((i - 1).alias("at"), spot.alias("spot"), F.xxhash64(here).alias("k1"), F.xxhash64(F.slice("h2", i, run_lines)).alias("k2"))

    df = df.where(F.size("h1") >= run_lines)
    df = _made(df, ["__doc", "h1"], runs=F.transform(F.sequence(F.lit(1), F.size("h1") - (run_lines - 1)), run))
    # runs of one selected position stand together, as positions never decrease
    opens = F.transform("runs", lambda x, i: F.when((i == 0) | (F.get("runs", i - 1)["spot"] < x["spot"]), i))
    df = _made(df, ["__doc", "h1", "runs"], opens=F.filter(opens, lambda i: i.isNotNull()))

    def position(i: Column, j: Column) -> Column:
        until = F.coalesce(F.get("opens", j + 1), F.size("runs"))
        own = F.transform(F.slice("runs", i + 1, until - i), lambda x: F.struct(x["at"].alias("at"), x["k1"].alias("k1"), x["k2"].alias("k2")))
        return F.struct(F.get("h1", F.get("runs", i)["spot"].cast("int")).alias("fp"), own.alias("runs"))

    return df.select("__doc", F.inline(F.transform("opens", position)))


def long_lines(docs: DataFrame, long_words: int) -> DataFrame:
    """One row per line of more than `long_words` words: __doc, at, k1, k2."""
    df = _identified(docs.select("doc_id", "text"))
    df = _made(df, ["__doc"], full=F.filter(_split(F.col("text")), lambda x: F.trim(x) != ""))

    def line(x: Column, i: Column) -> Column:
        keys = F.struct(i.alias("at"), F.xxhash64(x).alias("k1"), F.xxhash64(F.lit("second"), x).alias("k2"))
        # n words and the spaces between them are 2 n - 1 characters at least
        return F.when((F.char_length(x) > 2 * long_words) & (F.regexp_count(x, F.lit(WORD)) > long_words), keys)

    return df.select("__doc", F.inline(F.filter(F.transform("full", line), lambda w: w.isNotNull())))


def _later(met: DataFrame) -> DataFrame:
    """__doc and at of the rows whose k1, k2 also stand earlier.  `met` has __salt."""
    place = F.struct("__doc", "at")
    firsts = met.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"), salt_mask()).where("first < last")
    firsts = by_salt(firsts.select("k1", "k2", "first", "__mask"))
    return met.join(firsts, ["k1", "k2", "__salt"]).where(place > F.col("first")).select("__doc", "at")


def repeated(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = None) -> DataFrame:
    """__doc and `starts`, the sorted (at, n) of the runs and long lines that also start earlier; n counts their lines."""
    # rows equal in doc_id and text are one document: their places are equal
    spots = checkpointed(salted(fingerprints(docs, run_lines), "__doc"))
    shared = by_salt(spots.groupBy("fp").agg(F.count("*").alias("n"), salt_mask()).where("n > 1").select("fp", "__mask"))
    met = spots.join(shared, ["fp", "__salt"]).select("__doc", "__salt", F.inline("runs"))
    later = _later(met).withColumn("n", F.lit(run_lines))
    if long_words is not None:
        single = checkpointed(salted(long_lines(docs, long_words), "__doc"))
        later = later.unionByName(_later(single).withColumn("n", F.lit(1)))
    return later.groupBy("__doc").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("starts"))


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int | None = None) -> DataFrame:
    """Columns of `docs` with n_lines, n_removed, n_runs and kept_text."""
    hits = repeated(docs, run_lines, long_words).select(F.col("__doc").alias("__hit"), "starts")
    packed = docs.select(F.struct("*").alias("__row"), "doc_id", "text")
    df = _identified(packed).join(hits, F.col("__doc").eqNullSafe(F.col("__hit")), "left")
    # functions that walk two arrays side by side instead of looking positions up keep very long texts linear
    df = df.withColumn("__lines", _split(F.col("text")))
    full = F.filter(F.transform("__lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    dropped = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["at"], s["at"] + (s["n"] - 1)))))
    df = df.withColumn("__full", full).withColumn("__drop", F.coalesce(dropped, F.array().cast("array<int>")))
    df = df.withColumn("__gone_full", _dense(F.col("__drop"), F.size("__full")))
    gone = F.filter(F.zip_with("__full", "__gone_full", lambda i, g: F.when(g, i)), lambda i: i.isNotNull())
    df = df.withColumn("__gone", gone).withColumn("__gone_lines", _dense(F.col("__gone"), F.size("__lines")))
    kept = F.array_join(F.filter(F.zip_with("__lines", "__gone_lines", lambda x, g: F.when(~g, x)), lambda x: x.isNotNull()), "\n")
    runs = F.size(F.filter(F.zip_with("__gone_full", F.concat(F.array(F.lit(False)), "__gone_full"), lambda g, b: F.coalesce(g, F.lit(False)) & ~F.coalesce(b, F.lit(False))), lambda x: x))
    kept_text = F.when(F.size("__drop") == 0, F.col("text")).otherwise(kept)
    cols = [F.col("__row").getField(c).alias(c) for c in docs.columns if c not in EXTRA]
    return df.select(*cols, F.size("__full").alias("n_lines"), F.size("__drop").alias("n_removed"), runs.alias("n_runs"), kept_text.alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), RUN_LINES, LONG_WORDS)
    sha = F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", sha.alias("kept_sha256"))
