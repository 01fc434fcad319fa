"""Documents that have a group or a concept in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.session import kept

#: Rows of one key that meet each other in one task, about, and keys that are split, at most.
BLOCK_ROWS, HOT_KEYS = 2000, 10_000
NO_GROUP = "unknown"


def met(index: DataFrame, key: list[str], item: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Key columns, a and b of all pairs of different items of index (key columns, item) that share a key, both ways.

    A key with more than `block` rows, and at least one in HOT_KEYS of all, is cut in blocks by hash; each two blocks meet
    in a cell of their own, so no task has all rows of a key and none is left out. At most HOT_KEYS keys are broadcast.
    """
    rows = index.select(*key, item).distinct()
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    bar = max(block, (rows.count() + HOT_KEYS - 1) // HOT_KEYS)
    hot = sizes.filter(F.col("__n") > bar).select(*key, F.ceil(F.col("__n") / bar).cast("int").alias("__k"))
    blocked = rows.join(F.broadcast(hot), key, "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    own = F.pmod(F.xxhash64(item), F.col("__k")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("__k") - 1))
    left = blocked.select(*key, F.col(item).alias("a"), own.alias("__i"), others.alias("__j"))
    right = blocked.select(*key, F.col(item).alias("b"), own.alias("__j"), others.alias("__i"))
    return left.join(right, [*key, "__i", "__j"]).filter("a <> b").select(*key, "a", "b")


def related(docs: DataFrame, doc: str, group: Column, concepts: Column, block: int = BLOCK_ROWS) -> DataFrame:
    """a, b, same_group, shared (the concepts both have, in order) of all pairs of documents with a group or a concept in common.

    One inverted index has the documents by group and by concept, so the either-or is one join by equal keys; what several
    keys say of a pair is added up. A null group is the group `unknown`; null concepts are none. Rows with one id are one
    document with all their concepts and groups.
    """
    by_group = docs.select(F.lit("g").alias("kind"), F.coalesce(group.cast("string"), F.lit(NO_GROUP)).alias("key"), F.col(doc).alias("item"))
    by_concept = docs.select(F.lit("c").alias("kind"), F.explode(concepts).alias("key"), F.col(doc).alias("item")).filter("key IS NOT NULL")
    pairs = met(by_group.unionByName(by_concept), ["kind", "key"], "item", block)
    shared = F.sort_array(F.collect_set(F.when(F.col("kind") == "c", F.col("key"))))  # as many as a document has concepts
    return pairs.groupBy("a", "b").agg(F.max(F.col("kind") == "g").alias("same_group"), shared.alias("shared"))


def nearest(pairs: DataFrame, titles: DataFrame, doc: str, title: str, most: int | None = None) -> DataFrame:
    """The pairs of `related` with place: for each a, most shared concepts first, then those of its group, then by title and id.

    With `most`, only so many for each document, which each task cuts before rows move.
    """
    named = pairs.join(titles.groupBy(F.col(doc).alias("b")).agg(F.min(F.lower(title)).alias("__title")), "b")
    order = Window.partitionBy("a").orderBy(F.size("shared").desc(), F.col("same_group").desc(), "__title", "b")
    placed = named.withColumn("place", F.row_number().over(order))
    return (placed if most is None else placed.filter(F.col("place") <= most)).drop("__title")


def _few(rows: DataFrame, by: list[str], order: list[str | Column], most: int) -> DataFrame:
    """The first rows of each key, which each task cuts before rows move."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__k") <= most).drop("__k")


def nearest_related(docs: DataFrame, doc: str, group: Column, concepts: Column, title: str, most: int, block: int = BLOCK_ROWS) -> DataFrame:
    """`nearest` of `related` with `most` for each document, without the pairs of documents, which grow with their square.

    What a document's order is depends on its groups and its set of concepts alone, so sets meet, not documents, and of the
    documents of one set only the first `most` by title and id can be wanted, and one more, as a document isn't its own
    neighbour. They are found three times: among all documents (by number of shared concepts), among those of a group
    (likewise), and those of a group whatever they share. A document that has `most` others before it in such a list to
    which it belongs has them before it in the whole order too, so these lists hold all that can be wanted.
    """
    few = most + 1
    rows = docs.select(F.col(doc).alias("a"), F.coalesce(group.cast("string"), F.lit(NO_GROUP)).alias("group"), concepts.alias("concepts"), F.lower(title).alias("title")).filter("a IS NOT NULL")
    all_concepts = F.sort_array(F.array_distinct(F.filter(F.flatten(F.collect_set("concepts")), lambda c: c.isNotNull())))
    one = kept(rows.groupBy("a").agg(F.sort_array(F.collect_set("group")).alias("groups"), all_concepts.alias("concepts"), F.min("title").alias("title")))
    # the scope '' has all documents, '=' and a group's name that group's
    scopes = F.explode(F.concat(F.array(F.lit("")), F.transform("groups", lambda g: F.concat(F.lit("="), g)))).alias("scope")
    entry = F.struct("title", F.col("a").alias("b"), "groups", "concepts").alias("e")
    best = _few(one.select(scopes, "concepts", "title", "a", "groups"), ["scope", "concepts"], ["title", "a"], few)
    lists = kept(best.groupBy("scope", "concepts").agg(F.sort_array(F.collect_list(entry)).alias("best")))

    met_sets = met(lists.select("scope", F.explode("concepts").alias("key"), "concepts"), ["scope", "key"], "concepts", block).groupBy("scope", "a", "b").agg(F.count("*").alias("n"))
    own = lists.filter(F.size("concepts") > 0).select("scope", F.col("concepts").alias("a"), F.col("concepts").alias("b"), F.size("concepts").cast("bigint").alias("n"))
    heads = lists.select("scope", F.col("concepts").alias("b"), F.col("best")[0]["title"].alias("title"), F.col("best")[0]["b"].alias("first"))
    sets = _few(met_sets.unionByName(own).join(heads, ["scope", "b"]), ["scope", "a"], [F.col("n").desc(), "title", "first"], few)
    by_concept = sets.join(lists.select("scope", F.col("concepts").alias("b"), "best"), ["scope", "b"]).select("scope", F.col("a").alias("concepts"), "n", F.explode("best").alias("e"))
    by_concept = _few(by_concept, ["scope", "concepts"], [F.col("n").desc(), "e.title", "e.b"], few).groupBy("scope", "concepts").agg(F.collect_list("e").alias("near"))
    by_group = _few(lists.filter("scope <> ''").select("scope", F.explode("best").alias("e")), ["scope"], ["e.title", "e.b"], few).groupBy("scope").agg(F.collect_list("e").alias("beside"))

    none = F.array().cast(by_group.schema["beside"].dataType)
    kinds = one.select("groups", "concepts").distinct()
    offered = kinds.select("groups", "concepts", scopes).join(by_concept, ["scope", "concepts"], "left").join(by_group, "scope", "left")
    offered = offered.groupBy("groups", "concepts").agg(F.flatten(F.collect_list(F.concat(F.coalesce("near", none), F.coalesce("beside", none)))).alias("es"))
    shared = lambda e: F.array_intersect("concepts", e["concepts"])
    ranked = lambda e: F.struct((-F.size(shared(e))).alias("less"), (~F.arrays_overlap("groups", e["groups"])).alias("other"), e["title"].alias("title"), e["b"].alias("b"), shared(e).alias("shared"))
    # kept, so that both sides of the join below are plain exchanges, of which Spark splits those with many rows of one key
    orders = kept(offered.select("groups", "concepts", F.slice(F.sort_array(F.array_distinct(F.transform("es", ranked))), 1, few).alias("order")))
    others = F.slice(F.filter("order", lambda e: e["b"] != F.col("a")), 1, most)
    placed = one.join(orders, ["groups", "concepts"]).select("a", F.posexplode(others).alias("__i", "e"))
    return placed.select("a", F.col("e.b").alias("b"), (~F.col("e.other")).alias("same_group"), F.col("e.shared").alias("shared"), (F.col("__i") + 1).alias("place"))


def concepts_of(text: Column, rules: dict[str, list[str]]) -> Column:
    """The concepts with a keyword inside the text, in lower case, in the order of rules."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in rules.items()]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def best_of_other_side(rows: DataFrame, motif: str, side: str, item: str, score: str) -> DataFrame:
    """Each row of rows with partner and partner_score: the best row of its motif that is of another side; none: it goes.

    Best is the highest score, then the smallest item. Only the best row of a motif and the best one of its other sides can
    be a partner, so no pairs are made: the two are found by aggregation and joined to the rows. Null motifs, sides or
    scores take no part.
    """
    whole = rows.filter(F.col(motif).isNotNull() & F.col(side).isNotNull() & F.col(score).isNotNull())
    rank = F.struct((-F.col(score)).alias("less"), F.col(item).alias("item"), F.col(side).alias("side"))
    by_side = whole.groupBy(motif, side).agg(F.min(rank).alias("best"))
    # by_side has a row for each motif and side; the two least of a motif by an aggregation that keeps two
    first = by_side.groupBy(F.col(motif).alias("__m")).agg(F.min("best").alias("one"))
    second = by_side.join(first, F.col(motif) == F.col("__m")).filter(F.col(side) != F.col("one.side")).groupBy(F.col("__m").alias("__m2")).agg(F.min("best").alias("two"))
    two = first.join(second, F.col("__m") == F.col("__m2")).select("__m", "one", "two")
    other = F.when(F.col(side) == F.col("one.side"), F.col("two")).otherwise(F.col("one"))
    found = whole.join(two, F.col(motif) == F.col("__m")).withColumn("__p", other)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__p.item").alias("partner"), (-F.col("__p.less")).alias("partner_score"))
