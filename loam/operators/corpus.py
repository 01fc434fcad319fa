"""Documents: hash splits, records, routing, repeats, statistics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 64 bits of sha256("seed:key")."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def split_of(key: Column, fraction: float = 0.1, seed: int = 0) -> Column:
    """val for the given fraction of keys, else train; a fraction of 0 or less is all train."""
    return F.lit("train") if fraction <= 0 else F.when(hash_unit(key, seed) < fraction, "val").otherwise("train")


def records(docs: DataFrame, corpus: str = "source") -> DataFrame:
    """doc_id, corpus, split, char_length, byte_length and text_sha256 of every document."""
    return docs.select(
        "doc_id",
        F.col(corpus).alias("corpus"),
        split_of(F.col("doc_id")).alias("split"),
        F.length("text").cast("bigint").alias("char_length"),
        F.octet_length("text").cast("bigint").alias("byte_length"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def passing(docs: DataFrame, scores: DataFrame, languages: list[str], least_chars: int, floor: int) -> DataFrame:
    """Documents long enough, in one of the languages, with a score at the floor or none at all."""
    scored = docs.join(scores, "doc_id", "left").filter(F.col("quality").isNull() | (F.col("quality") >= floor))
    return scored.filter((F.length(F.trim("text")) >= least_chars) & (F.lit(not languages) | F.col("lang").isin(*languages)))


def rollup_counts(found: DataFrame) -> DataFrame:
    """Documents, characters and bytes by split and corpus, by split, and in all (total)."""
    sums = found.rollup("split", "corpus").agg(F.count("*").alias("n_docs"), F.sum("char_length").alias("n_chars"), F.sum("byte_length").alias("n_bytes"))
    return sums.select(F.coalesce("split", F.lit("total")).alias("split"), F.coalesce("corpus", F.lit("total")).alias("corpus"), "n_docs", "n_chars", "n_bytes")


def repeat_train(docs: DataFrame, times: int) -> DataFrame:
    """Train documents `times` times, the others once; the split is that of the base id."""
    split = split_of(F.col("doc_id"))
    copies = F.when(split == "train", F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))
    out = docs.select(F.col("doc_id").cast("string").alias("base"), split.alias("split"), F.explode(copies).alias("repeat_index"))
    name = F.when(F.col("repeat_index") == 0, F.col("base")).otherwise(F.concat("base", F.lit("::repeat_"), F.col("repeat_index").cast("string")))
    return out.select(name.alias("doc_name"), "split", "repeat_index")


def boost_train(docs: DataFrame, copies: int, tag: str) -> DataFrame:
    """Further copies of the train documents, named after the tag."""
    train = docs.filter(split_of(F.col("doc_id")) == "train").select(F.col("doc_id").cast("string").alias("base"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    return train.select(F.concat("base", F.lit(f"::{tag}_"), F.col("copy").cast("string")).alias("doc_name"), "copy")


def routed(docs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Documents go to their split, held-out items to their group, whatever a split would say."""
    own = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("holdout_group"), split_of(F.col("doc_id")).alias("split"))
    items = held_out.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("name"), F.lit("benchmark").alias("holdout_group"), split_of(F.col("item_id")).alias("split"))
    both = own.unionByName(items)
    return both.select("name", F.when(F.col("holdout_group").isNotNull(), F.concat(F.lit("holdout/"), "holdout_group")).otherwise(F.col("split")).alias("target"))


def band_fractions(docs: DataFrame, traces: DataFrame, probes: DataFrame) -> DataFrame:
    """Bytes and share of each band, and whether it keeps to its gate (pgen >= 0.7, 0.05 <= ptraj <= 0.3, pbench present)."""
    size = F.octet_length("text").cast("bigint").alias("n")
    bands = [t.select(F.lit(b).alias("band"), size) for t, b in ((docs, "pgen"), (traces, "ptraj"), (probes, "pbench"))]
    sums = bands[0].unionByName(bands[1]).unionByName(bands[2]).groupBy("band").agg(F.sum("n").alias("n_bytes"))
    trained = F.sum(F.when(F.col("band") != "pbench", F.col("n_bytes")).otherwise(0)).over(Window.partitionBy())
    share = F.when(F.col("band") == "pbench", 0.0).otherwise(F.coalesce(F.try_divide("n_bytes", trained), F.lit(0.0)))
    gate = F.when(F.col("band") == "pgen", F.col("share") >= 0.7).when(F.col("band") == "ptraj", F.col("share").between(0.05, 0.3)).otherwise(F.col("n_bytes") > 0)
    return sums.withColumn("share", share).select("band", "n_bytes", F.round("share", 6).alias("share"), gate.alias("passes"))


def least_hashes(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """The k documents with the smallest hashes: the same sample at every run."""
    return docs.select("doc_id", hash_unit(F.col("doc_id"), seed).alias("score")).orderBy("score", F.desc("doc_id")).limit(k)


def duplicate_profile(docs: DataFrame, by: str) -> DataFrame:
    """Rows, distinct texts and surplus copies of each group."""
    texts = docs.groupBy(by, F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"))
    return texts.groupBy(by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_surplus"))


#: Word runs of probes that are broadcast as hashes, at most (16 MB); beyond, documents' runs are joined by a shuffle.
BROADCAST_RUNS = 1 << 20


def contamination(docs: DataFrame, probes: DataFrame, size: int = 8) -> DataFrame:
    """For each probe, the number of documents that share a run of `size` words with it.

    Documents' runs meet the probes' by 64-bit hashes, on the map side as long as these are few; only the runs that meet
    are spelled out and compared word by word.
    """
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words")

    def places(rows: DataFrame, key: str) -> DataFrame:
        at = F.when(F.size("words") >= size, F.sequence(F.lit(1), F.size("words") - size + 1)).otherwise(F.array().cast("array<int>"))
        return rows.select(key, words).select(key, F.posexplode(F.transform(at, lambda i: F.xxhash64(F.slice("words", i, F.lit(size))))).alias("place", "hash"))

    def spelled(met: DataFrame, rows: DataFrame, key: str) -> DataFrame:
        """The runs at the places of met."""
        own = met.groupBy(key).agg(F.collect_set("place").alias("places"))
        runs = rows.select(key, words).join(own, key).select(key, F.explode(F.transform("places", lambda i: F.array_join(F.slice("words", i + 1, F.lit(size)), " "))).alias("run"))
        return runs.distinct()

    known = places(probes, "item_id").select("hash").distinct()
    few = known.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    met = places(docs, "doc_id").join(F.broadcast(known) if few else known, "hash", "left_semi")
    found = spelled(met, docs, "doc_id").join(spelled(places(probes, "item_id"), probes, "item_id"), "run").select("item_id", "doc_id").distinct()
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
