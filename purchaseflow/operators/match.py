"""Matching items: prioritised look-ups, fuzzy joins and greedy deduplication.

Fuzzy candidates come from shared q-grams of squeezed names. For a ratio of 90 the indel distance is a tenth of the
summed lengths at most, so by the q-gram count bound every qualifying pair of names shares a gram among the rarest
ones of either side (prefix filter); nothing is dropped by it. Names too short to have that many grams meet by length.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purchaseflow.sources.files import work_folder


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def first_of(rows: DataFrame, key: str, order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``place``; tasks drop what is beyond before rows are shuffled."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def prioritised_lookup(asked: DataFrame, asked_id: str, candidates: Sequence[Column], index: DataFrame, index_key: str, value: str, order: Sequence[str]) -> DataFrame:
    """(asked_id, value): the index value of the first candidate key that the index has; null if none does."""
    keys = asked.select(asked_id, F.posexplode(F.array(*candidates)).alias("_priority", "_key"))
    one = first_per_key(index.select(F.col(index_key).alias("_key"), value, *order), ["_key"], order)
    hit = keys.join(one, "_key").groupBy(asked_id).agg(F.min_by(value, "_priority").alias(value))
    return asked.select(asked_id).join(hit, asked_id, "left")


def grams(name: Column, q: int = 2) -> Column:
    """Distinct q-grams of a text, as an array."""
    last = F.greatest(F.length(name) - (q - 1), F.lit(0))
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(name, i, q)))).otherwise(F.array().cast("array<string>"))


def indel(a: str, b: str) -> int:
    """Insertions and deletions that turn ``a`` into ``b``: lengths less twice the longest common subsequence.

    The rows of its table are bits of one number: a bit turns 0 where the subsequence grows by one.
    """
    places: dict[str, int] = {}
    for k, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & whole
    return len(a) + len(b) - 2 * (len(b) - row.bit_count())


def _ratio_udf():
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([100.0 * (1 - indel(x, y) / (len(x) + len(y))) if x or y else 0.0 for x, y in zip(a, b)])

    return ratio


def _candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(id_a, key, id_b, key_b, ratio) of all pairs of distinct keys (id, key) with a ratio of at least ``least``, each once.

    Each side's distinct keys index their rarest grams: a pair within the distance shares all but 2 * d of the grams of
    either key, so one of the first 2 * d + 1 grams in order of rarity is common. Keys too short to have that many
    grams index them all and the marker of their length, so that they meet every key of a like length. A pair that meets
    at several of these is taken at the first one, so no shuffle is needed to make pairs distinct.
    """
    share = (100 - least) / 100 + 1e-9  # so that rounding loses no pair just at the bound

    def prepared(df: DataFrame, tag: str) -> DataFrame:
        return df.where(F.col("key") != "").groupBy("key").agg(F.min("id").alias(f"id_{tag}")).withColumn("grams", grams(F.col("key")))

    a, b = prepared(left, "a"), prepared(right, "b")
    rarity = a.select(F.explode("grams").alias("gram")).union(b.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def indexed(df: DataFrame, tag: str) -> DataFrame:
        # the other key is at most (1 + share) / (1 - share) times as long, which bounds the distance
        n = F.length("key")
        most = F.floor(n * (2 * share / (1 - share))).cast("int")
        need = 2 * most + 1
        # a key of one character has no gram, so it has its length alone
        listed = df.select(f"id_{tag}", "key", F.explode_outer("grams").alias("gram")).join(rarity, "gram", "left")
        ranked = listed.groupBy(f"id_{tag}", "key").agg(F.array_sort(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct("df", "gram")))).alias("g"))
        prefix = F.transform(F.slice("g", F.lit(1), F.greatest(need, F.lit(1))), lambda x: x["gram"])
        # keys with no more grams than that could share none: they meet by length
        lengths = F.transform(F.sequence(F.greatest(n - most, F.lit(1)), n + most), lambda k: F.concat(F.lit("#"), k.cast("string")))
        tokens = F.array_distinct(F.concat(prefix, F.when(F.size("g") <= need, lengths).otherwise(F.array().cast("array<string>"))))
        return ranked.select(f"id_{tag}", "key", tokens.alias(f"tokens_{tag}")).withColumn("token", F.explode(f"tokens_{tag}"))

    x, y = indexed(a, "a"), indexed(b, "b").withColumnRenamed("key", "key_b")
    bound = share * (F.length("key") + F.length("key_b"))
    met = x.join(y, "token").where((F.abs(F.length("key") - F.length("key_b")) <= bound) & (F.element_at(F.array_intersect("tokens_a", "tokens_b"), 1) == F.col("token")))
    near = met.where(F.levenshtein("key", "key_b") <= bound).select("id_a", "key", "id_b", "key_b")
    return near.withColumn("ratio", _ratio_udf()("key", "key_b")).where(F.col("ratio") >= least - 1e-7)


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 90.0) -> DataFrame:
    """(id, match_id, key, key_b, ratio) of all pairs of distinct keys (id, key) with a ratio of at least ``least``."""
    return _candidates(left, right, least).select(F.col("id_a").alias("id"), F.col("id_b").alias("match_id"), "key", "key_b", "ratio")


def best_match(left: DataFrame, right: DataFrame, least: float = 90.0) -> DataFrame:
    """Each left row (id, key) with the id of an equal right key, else of the most similar one; ties by least id.

    Keys that have an equal one are settled first. Of the others each task keeps the best match so far of every key, so one row a
    key and task is shuffled, however many are similar.
    """
    exact = right.where("key != ''").groupBy("key").agg(F.min("id").alias("exact_id"))
    open_ = left.select("key").distinct().join(exact, "key", "left_anti").withColumn("id", F.lit(0).cast("long"))
    found = _candidates(open_, right, least).groupBy("key").agg(F.min_by("id_b", F.struct(-F.col("ratio"), "id_b")).alias("near_id"), F.max("ratio").alias("ratio"))
    out = left.join(exact, "key", "left").join(found, "key", "left")
    return out.select("id", F.coalesce("exact_id", "near_id").alias("match_id"), F.when(F.col("exact_id").isNotNull(), 100.0).otherwise(F.col("ratio")).alias("ratio"))


def greedy_dropped(pairs: DataFrame, checkpoint) -> DataFrame | None:
    """Ids that the sequential rule drops: in order of id, an item goes if it matches an earlier kept one. None if no pair is there.

    In rounds, over undecided items only: those without an earlier undecided neighbour are kept, their later neighbours
    dropped, and the pairs of both are done with. ``pairs``: (earlier, later); ``checkpoint`` cuts lineage.
    """
    out, pairs = None, checkpoint(pairs)
    while not pairs.isEmpty():
        roots = pairs.select("earlier").distinct().join(pairs.select(F.col("later").alias("earlier")), "earlier", "left_anti")
        gone = checkpoint(pairs.join(roots, "earlier").select(F.col("later").alias("id")).distinct())
        out = gone if out is None else out.union(gone)
        pairs = checkpoint(pairs.join(gone, F.col("later") == F.col("id"), "left_anti").join(gone, F.col("earlier") == F.col("id"), "left_anti"))
    return out


def greedy_new(pairs: DataFrame, ids: DataFrame, checkpoint) -> DataFrame:
    """(id, kept) of all ``ids`` by the rule of ``greedy_dropped``."""
    gone = greedy_dropped(pairs, checkpoint)
    if gone is None:
        return ids.select("id", F.lit(True).alias("kept"))
    return ids.select("id").join(gone.withColumn("_gone", F.lit(True)), "id", "left").select("id", F.col("_gone").isNull().alias("kept"))


#: Items of the first portion of a batch; each next one is twice as large.
PORTION = 1000


def new_items(batch: DataFrame, master: DataFrame, checkpoint, least: float = 90.0) -> DataFrame:
    """(id, kept) of the batch (id, key, stored): an item is new unless its key matches the master's keys (id, key) or what an
    earlier new item is stored as.

    ``key`` is what an item asks with and ``stored`` what later ones meet (the key itself if the batch has no such column): names
    ask without a trailing remark in brackets, but are stored with it. An item with an empty key is always new. Items
    that ask and are stored alike are one, the first. ``checkpoint`` cuts lineage.

    Portions of the ids, in order and of growing size, are compared with the new items before them first; new items are
    unlike each other, so that finds a few for each. Only what is left of a portion is compared within it, so a family of
    like names costs the square of its part in the portion that it begins in, not of its size.
    """
    if "stored" not in batch.columns:
        batch = batch.withColumn("stored", F.col("key"))
    rows = batch.select("id", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("stored", F.lit("")).alias("stored"))
    asked = rows.where("key != ''")
    known = best_match(asked.select("id", "key"), master, least).where("match_id IS NOT NULL").select("id")
    alike = asked.where("key = stored").groupBy("key").agg(F.min("id").alias("_first"))
    copies = asked.where("key = stored").join(alike, "key").where("id > _first").select("id")
    left = checkpoint(rows.join(known.union(copies), "id", "left_anti"))
    new, seen = [], None
    for part in _portions(left):
        if seen is not None:
            met = _pairs(part, seen, least, checkpoint).select(F.col("later").alias("id")).distinct()
            part = checkpoint(part.join(met, "id", "left_anti"))
        gone = greedy_dropped(_pairs(part, part, least, checkpoint), checkpoint)
        own = part if gone is None else checkpoint(part.join(gone, "id", "left_anti"))
        new.append(own)
        seen = own if seen is None else seen.union(own)
    kept = seen.select("id", F.lit(True).alias("kept")) if new else left.select("id", F.lit(True).alias("kept"))
    return batch.select("id").join(kept, "id", "left").select("id", F.coalesce("kept", F.lit(False)).alias("kept"))


def _portions(rows: DataFrame) -> list[DataFrame]:
    """The rows by ranges of their id, the first of about PORTION rows, each next one of twice as many as the one before."""
    total = rows.count()
    shares, size = [], PORTION
    while sum(shares) < total:
        shares.append(size)
        size *= 2
    if not shares:
        return []
    places = [sum(shares[: k + 1]) / total for k in range(len(shares) - 1)]
    cuts = rows.stat.approxQuantile("id", places, min(0.01, PORTION / total / 2)) if places else []
    low = [None, *sorted(set(cuts))]
    return [rows.where((F.lit(True) if a is None else F.col("id") > a) & (F.lit(True) if b is None else F.col("id") <= b)) for a, b in zip(low, [*low[1:], None], strict=True)]


def _pairs(later: DataFrame, earlier: DataFrame, least: float, checkpoint) -> DataFrame:
    """(earlier, later) ids of which the later one's key matches what the earlier one is stored as."""
    texts = checkpoint(_candidates(later.select("id", "key"), earlier.select("id", F.col("stored").alias("key")), least).select("key", "key_b"))
    asks = later.select(F.col("id").alias("later"), "key")
    has = earlier.select(F.col("id").alias("earlier"), F.col("stored").alias("key_b"))
    return asks.join(texts, "key").join(has, "key_b").where("earlier < later").select("earlier", "later")


def _classes(items: DataFrame, texts: Sequence[str], asked: DataFrame, k: int) -> DataFrame:
    """(class_id, item_id, texts) of the items that can be among the ``k`` best of any query: the first ``k`` of each class.

    Items whose fields have the same of the queries' grams are a class: every query gives them one score, so only their ids
    decide between them. ``class_id`` is the least id of the class; the texts are each item's own.
    """
    known = asked.select(F.explode("g").alias("gram")).distinct()
    told = items
    for text in texts:
        found = items.select(text).distinct().select(text, F.explode(grams(F.col(text))).alias("gram")).join(known, "gram")
        # all grams have two characters, so they can be told apart in one text
        told = told.join(found.groupBy(text).agg(F.array_join(F.array_sort(F.collect_list("gram")), "").alias(f"{text}_met")), text, "left")
    alike = Window.partitionBy(*(f"{text}_met" for text in texts)).orderBy("item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = told.withColumns({"class_id": F.first("item_id").over(alike), "_place": F.row_number().over(alike)}).where(F.col("_place") <= k)
    return first.select("class_id", "item_id", *texts)


def search_top_k(queries: DataFrame, items: DataFrame, fields: dict[str, int], k: int = 5, most: float = 0.4) -> DataFrame:
    """The ``k`` best items of each query (query_id, text): score is the weighted mean over fields of one less the share
    of the query's 2-grams that the field has; scores over ``most`` don't count. Ties by item id.

    Queries with the same grams are searched once, and of items that no query can tell apart (``_classes``) only the first ``k``,
    so copies on either side cost nothing but their rows. Among classes in order of score and least id, the ``k`` best items
    are in the first ``k``.

    A weighted mean of shares is no more than the greatest of them, so an item within ``most`` has a field with
    ``(1 - most) * n`` of the query's n grams, and so one of any ``n - need + 1`` of them: only the rarest ones in
    that field are looked up (prefix filter), and what is found is scored in full. Nothing is lost by it.
    """
    total = sum(fields.values())
    each = queries.select("query_id", F.array_sort(grams(F.lower("text"))).alias("g")).where(F.size("g") > 0)
    asked = each.groupBy("g").agg(F.min("query_id").alias("search_id"))
    texts = [f"_{i}" for i in range(len(fields))]
    spark, path = items.sparkSession, work_folder(items.sparkSession)
    _classes(items.select("item_id", *(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(x) for f, x in zip(fields, texts))), texts, asked, k).write.parquet(path)
    members = spark.read.parquet(path)
    have = members.where("item_id = class_id").select("class_id", *(grams(F.col(x)).alias(x) for x in texts))
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(x).alias("gs")) for i, x in enumerate(texts))))
    index = have.select("class_id", listed.alias("e")).select("class_id", "e.field", F.explode("e.gs").alias("gram"))
    rarity = index.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("df"))
    need = F.ceil((1 - most) * F.size("g") - 1e-9).cast("int")
    wanted = asked.select("search_id", (F.size("g") - need + 1).alias("take"), F.explode("g").alias("gram"), F.lit(list(range(len(fields)))).alias("fs"))
    wanted = wanted.select("search_id", "take", "gram", F.explode("fs").alias("field")).join(rarity, ["field", "gram"], "left")
    rank = F.row_number().over(Window.partitionBy("search_id", "field").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    probes = wanted.withColumn("_r", rank).where((F.col("_r") <= F.col("take")) & F.col("df").isNotNull()).select("search_id", "field", "gram")
    met = probes.join(index, ["field", "gram"]).select("search_id", "class_id").distinct()
    shared = sum((F.size(F.array_intersect("g", x)) * w for x, w in zip(texts, fields.values())), F.lit(0))
    scored = met.join(asked, "search_id").join(have, "class_id").select("search_id", "class_id", (1 - shared / (F.size("g") * total)).alias("score")).where(F.col("score") <= most)
    best = first_of(scored, "search_id", ["score", "class_id"], k).select("search_id", "class_id", "score")
    found = first_of(best.join(members.select("class_id", "item_id"), "class_id"), "search_id", ["score", "item_id"], k)
    return each.join(asked, "g").select("query_id", "search_id").join(found, "search_id").select("query_id", "item_id", "score", "place")
