"""Operator 2 (native): benchmark decontamination with a broadcast set of normalised n-gram hashes.

Words: A-Z lower-cased, runs of digits, letters a-z and non-ASCII characters. A window is ``size`` consecutive item
words; an item of fewer words is one window. The hashes of all windows are a constant set in the scan of the
documents (their number is checked; a larger set is joined by shuffle); positions that hit are verified by joining
the words themselves. Documents without a hit never leave their scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

SET_LIMIT = 50_000  # hashes held in the scan's expression
BROADCAST_LIMIT = 500_000  # rows
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    split = F.array_remove(F.split(F.translate(text.cast("string"), UPPER, LOW), SEPARATORS), "")
    return F.coalesce(split, F.array().cast("array<string>"))


def gram_hash(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(size)])


def starts(n: Column, size: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def hash_of(size: int):
    return lambda i: gram_hash(F.col("w"), i, size)


def hit_of(size: int):
    return lambda i: F.struct(F.lit(size).alias("length"), i.alias("start"), F.concat_ws(" ", F.slice("w", i + 1, F.lit(size))).alias("gram"))


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """(length, gram, h, items) of every distinct window."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    w = w.withColumn("n", F.size("w")).where("n > 0").withColumn("length", F.least("n", F.lit(size)))
    w = w.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))))
    gram = F.slice("w", F.col("i") + 1, F.col("length"))
    full = F.when(F.col("length") == size, gram_hash(F.col("w"), F.col("i"), size))
    for k in range(1, size):
        full = full.when(F.col("length") == k, gram_hash(F.col("w"), F.col("i"), k))
    w = w.select("length", F.concat_ws(" ", gram).alias("gram"), full.alias("h"), "item")
    return w.groupBy("length", "gram", "h").agg(F.collect_set("item").alias("items"))


def candidates(docs: DataFrame, grams: DataFrame, size: int) -> DataFrame:
    """doc_id, th, n_words and hits: (length, start, gram) of every position whose hash is in the set."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    docs = docs.withColumn("n", F.size("w"))
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most ``size`` numbers
    if not lengths:
        return docs.select("doc_id", "th", F.col("n").cast("long").alias("n_words"), F.expr("cast(array() as array<struct<length:int,start:int,gram:string>>)").alias("hits"))
    n_grams = grams.count()
    if n_grams <= SET_LIMIT:
        held = {k: ",".join(str(r[0]) + "L" for r in grams.where(F.col("length") == k).select("h").distinct().collect()) for k in lengths}
        for k in lengths:
            args = ", ".join(f"get(w, i + {j})" for j in range(k))
            docs = docs.withColumn(f"at{k}", F.expr(
                f"case when n >= {k} then filter(sequence(0, n - {k}), i -> xxhash64({args}) in ({held[k]})) else cast(array() as array<int>) end"))
        hits = [F.transform(f"at{k}", hit_of(k)) for k in lengths]
        return docs.select("doc_id", "th", F.col("n").cast("long").alias("n_words"), F.concat(*hits).alias("hits"))
    # a large set: positions are joined by hash, then their documents are looked up again for the words
    each = None
    for k in lengths:
        at = docs.select("doc_id", "th", F.lit(k).alias("length"), F.posexplode(F.transform(starts(F.col("n"), k), hash_of(k))).alias("start", "h"))
        each = at if each is None else each.union(at)
    found = each.join(grams.select("length", "h").distinct(), ["length", "h"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct("length", "start")).alias("at"))
    docs = docs.withColumnRenamed("doc_id", "d").withColumnRenamed("th", "t")
    docs = docs.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th")), "left")
    hits = F.transform("at", lambda x: F.struct(x["length"].alias("length"), x["start"].alias("start"), F.concat_ws(" ", F.slice("w", x["start"] + 1, x["length"])).alias("gram")))
    return docs.select(F.col("d").alias("doc_id"), F.col("t").alias("th"), F.col("n").cast("long").alias("n_words"),
                       F.coalesce(hits, F.expr("cast(array() as array<struct<length:int,start:int,gram:string>>)")).alias("hits"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, n_items, item_ids, spans, contaminated per document.

    ``spans`` are the merged (start, stop) word ranges covered by occurrences, in order. Null and empty texts have no
    words; items without words have no window. Repeated rows give repeated rows; a null doc_id is a row like others
    (rows of one id with different texts are told apart by th). Repeated items count once per item_id. No documents:
    no rows; no items: no hits. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = C.stage(benchmark_windows(items.select("item_id", "text"), size), "grams")
    scanned = C.stage(candidates(docs, grams, size), "hits")
    small = F.broadcast(grams) if grams.count() <= BROADCAST_LIMIT else grams
    hit = (scanned.where(F.size("hits") > 0).select("doc_id", "th", F.explode(F.array_distinct("hits")).alias("x"))
           .select("doc_id", "th", "x.length", "x.start", "x.gram").join(small, ["length", "gram"]))
    # a document's occurrences are bounded by its words
    per_doc = hit.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    ends = F.aggregate("at", F.expr("cast(array() as array<struct<start:int,stop:int>>)"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))))
    per_doc = per_doc.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "item_ids", ends.alias("spans"))
    out = scanned.select("doc_id", "th", "n_words").join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select(
        "doc_id", "th", "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")).alias("spans"),
        F.col("spans").isNotNull().alias("contaminated")).withColumn("n_items", F.when(F.col("contaminated"), F.col("n_items")).otherwise(F.lit(0)).cast("long"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents, all columns, without those that hold an occurrence of an item's window."""
    bad = decontaminate(docs, items, size).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    hashed = docs.withColumn("_th", F.xxhash64(F.col("text").cast("string")))
    return hashed.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left_anti").drop("_th")
