"""N-gram Jaccard join by parity sketches: exact links between texts that share enough word shingles.

A text's distinct shingles are dealt over the blocks of its size band and every block holds the XOR of its shingles'
hashes. A shingle that only one of two texts has changes one block, so the number of differing blocks is at most the
symmetric difference D, which J >= t bounds by n * (1 / t - 1). Two linked texts that each have more than D filled
blocks must then share one of the first D + 1 of them, in any one order of all possible blocks: that is the pigeonhole
join. Blocks made only of shingles that a sample finds common come last in that order, so common passages seldom serve
as keys; the sample changes the order alone, never the result.

Keys' least and greatest texts come from a map-side aggregation, and only texts of keys that two unlike texts share go
on. Every key's texts are compared with the key's least text first. Components of those links settle nearly all keys
(a group of near copies needs one star, not all pairs); what is left of a key is compared in bounded tiles, over
unlike components only, by the Hamming distance of narrow parity sketches. Candidates are verified by their real words.

Texts of the same words are one node, named by a keyed BLAKE2 digest of those words. Hashes and digests are made with a
secret that the driver draws for each run, so no texts can be made for which hashes meet and words do not.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import Bits, bits_of, id_key, split_join, text_digest, written
from loam.llm.components import components
from loam.llm.hashing import Words, chunks, mix, words_of

SHINGLE = 5
PERCENT = 75
#: A parity sketch has at least so many bits, and at least so many for each shingle, rounded up to a power of two.
LEAST_BITS, BITS_EACH = 512, 2
#: Documents, about, whose shingles order the keys; shingles in so many of them are common; of those at most so many.
ORDER_SAMPLE, COMMON_DOCS, COMMON_MOST = 4096, 6, 65_536
#: Rows of a key compared with each other at once, and rows in a task, about.
CHUNK, TASK_ROWS = 512, 2048
_BLOCK, _CELL = np.uint64(0x9FB21C651E98DF25), 0xC2B2AE3D27D4EB4F
_FIRST_BLOCKS = 64


def shingle_sets(texts: list[bytes], secret: int, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of all its words, if they are fewer than a shingle."""
    words: Words = words_of(texts, lower=True, secret=secret)
    windows = words.windows(size)
    for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if end - first >= size:
            yield np.unique(windows[first : end - size + 1])
        elif end > first:
            yield _short(words, first, end)
        else:
            yield windows[:0]


def _short(words: Words, first: int, end: int) -> np.ndarray:
    """The hash of a text of fewer words than a shingle."""
    own = words.hashes()[first:end]
    return mix(own[:1] + mix(np.array([xxhash.xxh3_64_intdigest(own.tobytes())], "u8")))


def most_different(n: int, percent: int) -> int:
    """The largest symmetric difference of a set of n elements and any set with that Jaccard similarity to it."""
    return n * (100 - percent) // percent


def block_keys(shingles: np.ndarray, common: np.ndarray, percent: int) -> list[np.ndarray]:
    """The join keys of a set: the first blocks of each size band that it may meet linked sets in."""
    n = len(shingles)
    band = 1 << (n.bit_length() - 1)
    bands = [band, 2 * band] if 100 * n >= 2 * band * percent else [band]
    at = np.searchsorted(common, shingles)
    rare = common[np.minimum(at, len(common) - 1)] != shingles if len(common) else np.ones(n, bool)
    found = []
    for b in bands:
        salt = np.uint64(b * _CELL & 0xFFFFFFFFFFFFFFFF)
        if b < _FIRST_BLOCKS:  # small sets: a block for each shingle
            keys, own = mix(shingles ^ salt), rare
        else:
            block = mix(shingles + _BLOCK) % np.uint64(b * 5 // 4)
            order = np.argsort(block)
            block = block[order]
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            keys = mix(np.bitwise_xor.reduceat(mix(shingles[order]), starts) + block[starts] * _BLOCK + salt)
            own = np.logical_or.reduceat(rare[order], starts)
        keys = (keys >> np.uint64(1)) | (np.where(own, 0, 1).astype("u8") << np.uint64(63))
        found.append(np.sort(keys)[: most_different(n, percent) + 1])
    return found


def key_of(secret: int) -> bytes:
    return secret.to_bytes(16, "little")


def node_of(text: bytes, secret: int) -> bytes:
    """Names a text's words, in lower case and in order: 128 bits."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16, key=key_of(secret)).digest()


def digest_of(text: bytes, secret: int) -> bytes:
    """What text_digest gives of a text under the secret's key."""
    return hashlib.sha256(key_of(secret) + text).digest()[:16]


def short_of(node: bytes) -> int:
    """The first 64 bits of a node's name: enough to find candidates by; nodes that share them all become candidates."""
    return int.from_bytes(node[:8], "big", signed=True)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """Bits that each hold the parity of the number of shingles that fall on them, more of them for larger sets."""
    bits = 1 << max(LEAST_BITS, BITS_EACH * len(shingles)).bit_length()
    return np.packbits(np.bincount((shingles >> np.uint64(20)).astype("i8") & (bits - 1), minlength=bits) & 1).tobytes()


def folded(sketch: bytes, n_bytes: int) -> np.ndarray:
    """The same set's sketch of n_bytes, in 64-bit words: parities of bits that fall together add up."""
    words = np.frombuffer(sketch, "u8")
    while 8 * len(words) > n_bytes:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _common_shingles(docs: DataFrame, secret: int) -> np.ndarray:
    """Shingles that many documents of a bounded sample hold; at most COMMON_MOST of them."""
    share = min(1.0, ORDER_SAMPLE / max(1, docs.count()))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            sets = list(shingle_sets(texts, secret))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view("i8"))], ["shingle"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(1 << 30)) < int(share * (1 << 30)))
    counted = sample.select(F.col("text").cast("binary")).mapInArrow(tasks, "shingle bigint").groupBy("shingle").count()
    rows = counted.filter(F.col("count") >= COMMON_DOCS).orderBy(F.desc("count"), "shingle").limit(COMMON_MOST).select("shingle").collect()
    return np.sort(np.array([r["shingle"] for r in rows], "i8").view("u8"))


def _keys(docs: DataFrame, common: np.ndarray, percent: int, secret: int) -> DataFrame:
    """key and node (its short name) of every text: see block_keys."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for _, texts in chunks(batches):
            keys, nodes, sizes, seen = [], [], [], set()
            for text, shingles in zip(texts, shingle_sets(texts, secret), strict=True):
                if len(shingles) and (node := short_of(node_of(text, secret))) not in seen:
                    seen.add(node)
                    own = block_keys(shingles, common, percent)
                    keys += own
                    nodes.append(node)
                    sizes.append(sum(map(len, own)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view("i8")), pa.array(np.repeat(np.array(nodes, "i8"), sizes))], ["key", "node"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(tasks, "key bigint, node bigint")


def _sketched(docs: DataFrame, common: np.ndarray, wanted: Bits, percent: int, secret: int) -> DataFrame:
    """doc_id, digest, n_shingles and node of every row; with its short name, sketch and those of its keys that are wanted, if any."""
    shared = docs.sparkSession.sparkContext.broadcast((common, wanted))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, wanted = shared.value
        for part, texts in chunks(batches, 1):
            sizes, nodes, shorts, sketches, found = [], [], [], [], []
            for text, shingles in zip(texts, shingle_sets(texts, secret), strict=True):
                node = node_of(text, secret) if len(shingles) else None
                keys = np.concatenate(block_keys(shingles, common, percent)) if len(shingles) else shingles
                keys = keys[wanted.has(keys)]
                sizes.append(len(shingles))
                nodes.append(node)
                shorts.append(short_of(node) if len(keys) else None)
                sketches.append(parity_sketch(shingles) if len(keys) else None)
                found.append(keys.view("i8") if len(keys) else None)
            digests = pa.array([digest_of(x, secret) for x in texts], pa.binary())
            arrays = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(shorts, pa.int64()), pa.array(sketches, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), digests, *arrays], ["doc_id", "digest", "n_shingles", "node", "short", "sketch", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary"))
    return rows.mapInArrow(tasks, "doc_id bigint, digest binary, n_shingles bigint, node binary, short bigint, sketch binary, keys array<bigint>")


def _head(digest: str) -> Column:
    """The first 64 bits of a digest."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("bigint")


def _texts(docs: DataFrame, digests: DataFrame, secret: int) -> DataFrame:
    """digest and text of the texts with those digests (and some others), once each."""
    found = written(digests.select(_head("digest").alias("hash")).distinct(), "parity-digests")
    shared = docs.sparkSession.sparkContext.broadcast(bits_of(found, found.count()))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            digests = [digest_of(x, secret) for x in texts]
            own = np.flatnonzero(shared.value.has(np.frombuffer(b"".join(x[:8] for x in digests), ">u8").astype("u8")))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in own.tolist()], pa.binary()) for x in (digests, texts)], ["digest", "text"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(tasks, "digest binary, text binary").dropDuplicates(["digest"])


def similar(one: bytes, two: bytes, percent: int, size: int = SHINGLE) -> bool:
    """Whether two texts link, by their words themselves: shingles are numbered step by step, not hashed."""
    a, b = one.lower().split(), two.lower().split()
    if min(len(a), len(b)) < size:
        return a == b
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for w in a + b), "i8", len(a) + len(b))
    number = words
    for k in range(1, size):  # runs of k + 1 words, those of k words numbered before
        number = np.unique(number[: len(words) - k] * len(known) + words[k:], return_inverse=True)[1]
    a_set, b_set = np.unique(number[: len(a) - size + 1]), np.unique(number[len(a) :])
    same = len(np.intersect1d(a_set, b_set, assume_unique=True))
    return 100 * same >= percent * (len(a_set) + len(b_set) - same)


def _bound(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of n and m elements."""
    return (n + m) * (100 - percent) // (100 + percent)


def _hamming(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of the sketches' sets."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def _with_both(pairs: DataFrame, values: DataFrame, name: str, columns: tuple[str, ...], sides: tuple[str, str]) -> DataFrame:
    """The written pairs with the columns that values has for both sides, as <column>_<side>; no side is in one task alone."""
    for side in sides:
        pairs = split_join(pairs, values.select(F.col(name).alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        if side == sides[0]:
            pairs = written(pairs, "parity-side")
    return pairs


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, other and their digests of the written pairs (node, other: short names) that sketches don't rule out."""
    columns = ["name_node", "name_other", "digest_node", "digest_other"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                alike = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                sketches = zip(batch.column(6), batch.column(7), alike, strict=True)
                far = np.array([_hamming(a.as_py(), b.as_py()) if ok else 0 for a, b, ok in sketches])
                kept = batch.filter(pa.array(alike & (far <= _bound(n, m, percent))))
                yield pa.RecordBatch.from_arrays(kept.columns[:4], ["node", "other", "digest_node", "digest_other"])

    both = _with_both(pairs, sets.withColumnRenamed("node", "name"), "short", ("name", "digest", "n_shingles", "sketch"), ("node", "other"))
    sides = both.select(*columns, "n_shingles_node", "n_shingles_other", "sketch_node", "sketch_other")
    return sides.mapInArrow(tasks, "node binary, other binary, digest_node binary, digest_other binary")


def _linked(docs: DataFrame, near: DataFrame, percent: int, secret: int) -> DataFrame:
    """The linked ones of the written pairs (node, other, digest_node, digest_other), by their words."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(a.as_py(), b.as_py(), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    digests = near.select(F.explode(F.array("digest_node", "digest_other")).alias("digest"))
    texts = written(_texts(docs, digests, secret), "parity-texts")
    both = _with_both(near, texts, "digest", ("text",), ("digest_node", "digest_other"))
    return written(both.select("node", "other", "text_digest_node", "text_digest_other").mapInArrow(tasks, "node binary, other binary"), "parity-links")


def _across(met: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (node, other, and their digests) of unlike components in the groups (lo, hi, node) that may still be linked.

    Every such pair, or of each two components that meet in a task only the pair whose sketches differ least.
    """
    roots = sets.select("short", "node", "digest", "n_shingles").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(met.withColumnRenamed("node", "short").join(roots, "short").withColumn("group", F.xxhash64("lo", "hi")), "parity-members")
    groups = rows.groupBy("group").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).filter("least <> most")
    tiles = written(groups.select("group", F.ceil(F.col("n") / CHUNK).alias("n_chunks"), "n"), "parity-open")
    n_rows = tiles.agg(F.sum(F.col("n") * F.col("n_chunks"))).first()[0]
    if n_rows is None:
        return rows.select("node", F.col("node").alias("other"), F.col("digest").alias("digest_node"), F.col("digest").alias("digest_other")).limit(0)
    chunked = split_join(rows, tiles, "group").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks")))
    # a chunk meets itself and each other one in a tile, which the pair of chunks names
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1), lambda c: F.struct(F.least("chunk", c).alias("i"), F.greatest("chunk", c).alias("j")))
    dealt = chunked.withColumn("meet", F.explode(meets)).withColumn("at", F.xxhash64("group", "meet.i", "meet.j"))
    dealt = dealt.select("at", "chunk", "n_shingles", "node", "digest", "root").join(sets.select("node", "sketch"), "node")  # sketches come last, as they are large

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("n_shingles", "ascending")])
        at, n, chunk = (rows[c].to_numpy() for c in ("at", "n_shingles", "chunk"))
        sketches = rows["sketch"].combine_chunks()
        size = np.diff(np.frombuffer(sketches.buffers()[1], "i4")[sketches.offset : sketches.offset + len(sketches) + 1])
        root = rows["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
        found: list[np.ndarray] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            apart = chunk[a:b].min() != chunk[a:b].max()
            for least in np.unique(size[a:b]).tolist():
                # sets of up to n * 100 / percent shingles have sketches of this size or twice that
                own = a + np.flatnonzero((size[a:b] == least) | (size[a:b] == 2 * least))
                bits = np.stack([folded(sketches[i].as_py(), least) for i in own.tolist()])
                for k in range(int((size[own] == least).sum())):
                    i, end = own[k], int(np.searchsorted(n[own], n[own[k]] * 100 // percent, "right"))
                    other = np.arange(k + 1, end)
                    other = other[(root[own[other]] != root[i]) & ((chunk[own[other]] != chunk[i]) if apart else True)]
                    if len(other):
                        far = np.bitwise_count(bits[other] ^ bits[k]).sum(axis=1, dtype="i8")
                        near = far <= _bound(n[own[other]], n[i], percent)
                        if near.any():
                            found.append(np.stack([np.full(int(near.sum()), i), own[other[near]], far[near]]))
        i, j, far = np.concatenate(found, axis=1) if found else np.zeros((3, 0), "i8")
        if not every and len(i):
            least, most = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            order = np.lexsort((far, most, least))
            first = np.concatenate(([True], (least[order][1:] != least[order][:-1]) | (most[order][1:] != most[order][:-1])))
            i, j = i[order[first]], j[order[first]]
        node, digest = rows["node"].combine_chunks(), rows["digest"].combine_chunks()
        return pa.table({"node": node.take(pa.array(i)), "other": node.take(pa.array(j)), "digest_node": digest.take(pa.array(i)), "digest_other": digest.take(pa.array(j))})

    n_tasks = max(1, n_rows // TASK_ROWS)
    task = F.pmod("at", F.lit(n_tasks)).alias("task")
    return dealt.withColumn("task", task).groupBy("task").applyInArrow(compare, "node binary, other binary, digest_node binary, digest_other binary").distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach: texts whose sets of distinct SHINGLE-word shingles, of words
    in lower case (A-Z), have a Jaccard similarity of `percent` hundredths or more. A text of fewer words has its whole
    word sequence as its one shingle. Null, empty and blank texts have no shingles and stay alone; so their
    component_id is their own doc_id. Repeated rows and copies link. Null ids are passed over for a component_id, which
    is null if there is no other. A row out for each row in; an empty table gives no rows; further columns don't matter.
    """
    rows, labels = _grouped(docs, percent, secrets.randbits(64))
    component: Column = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    own = _roots(rows, labels)
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(least, "root").select("node", "component_id")
    return rows.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))


def _grouped(docs: DataFrame, percent: int, secret: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest (of the text), n_shingles and node of every row, and the roots of nodes that have links."""
    common = _common_shingles(docs, secret)
    ends = _keys(docs, common, percent, secret).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    keys = written(ends.filter("lo <> hi"), "parity-keys")
    rows = written(_sketched(docs, common, bits_of(keys.select(F.col("key").alias("hash")), keys.count()), percent, secret), "parity-rows")
    of_node = [F.first(c).alias(c) for c in ("short", "n_shingles", "sketch", "keys")]
    sets = written(rows.filter("sketch IS NOT NULL").groupBy("node").agg(F.min("digest").alias("digest"), *of_node), "parity-nodes")
    holders = written(sets.select(F.col("short").alias("node"), F.explode("keys").alias("key")), "parity-holders")
    met = written(split_join(holders, keys, "key").filter("node <> lo").select("node", "lo", "hi").distinct(), "parity-met")
    stars = written(met.select("node", F.col("lo").alias("other")).distinct(), "parity-stars")
    labels = components(_linked(docs, written(_near(stars, sets, percent), "parity-near"), percent, secret))
    for every in (False, True):
        across = written(_across(met, sets, labels, percent, every), "parity-near")
        if across.isEmpty():  # of unlike components no pair may be linked, so there is none of every pair either
            break
        more = _linked(docs, across, percent, secret)
        if not more.isEmpty():  # the stars of the components so far stand for their links
            labels = components(more.unionByName(labels.select("node", F.col("root").alias("other"))))
    return rows.select("doc_id", "digest", "n_shingles", "node"), labels


def _roots(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """node, root and the least doc_id of every node."""
    own = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    return own.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with its columns, of which one of each component stays: that of the smallest doc_id.

    Of rows that share that id, the one with the least digest of its text stays, and of equal ones any one. Ids that
    are null come last. Rows without shingles (null or blank texts) all stay.
    """
    secret = secrets.randbits(64)
    rows, labels = _grouped(docs.select("doc_id", "text"), percent, secret)
    rooted = rows.filter("node IS NOT NULL").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = rooted.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("n_rows"))
    best = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n_rows")).alias("best"))
    blank = rows.filter("node IS NULL").select(id_key("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.lit(1).cast("bigint").alias("__n")).distinct()
    winners = best.select(id_key("best.doc_id").alias("__id"), F.col("best.digest").alias("__digest"), F.col("best.n_rows").alias("__n")).unionByName(blank)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({"__own_id": id_key("doc_id"), "__own_digest": text_digest("text", key_of(secret))})
    kept = keyed.join(winners, (F.col("__own_id") == F.col("__id")) & (F.col("__own_digest") == F.col("__digest")))
    repeated = kept.filter("__n > 1").dropDuplicates(["__own_id", "__own_digest"])
    return kept.filter("__n = 1").select(*columns).unionByName(repeated.select(*columns))
