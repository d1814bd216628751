"""SpotSigs fingerprints: a text is the set of its spot signatures, each a common word and the content words after it.

Common words stand evenly in prose and rarely in tables or menus, so the set follows the running text. Where none stands
near, in tables, lists or other languages, every word begins a chain, so that the set spans the whole text. Sets are compared
by Jaccard likeness, pruned by length: sets whose sizes differ by more than the threshold allows can't be that alike.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._cluster import cut, dealt_in_order, parts_for

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au avec dans de du en est et la le les par pas pour que qui sur un une "
    "con del el las los no para por se una y"
).split()
CHAIN = 2
#: A word without a common word among so many before and after it begins a chain itself.
GAP = 8
PART_BYTES = 16 << 20


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spots(text: Column) -> Column:
    """The sorted distinct spot signatures of a text, as 64-bit hashes.

    Each common word gives one signature with the next two content words. Every word with no common word within GAP words
    begins a chain of three; in a text without common words, that is every word. A text without a letter or digit has
    one signature, the text itself; an empty or null one has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def places(w: Column) -> Column:
        every = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(
            w.alias("w"),
            F.filter(every, lambda i: F.get(w, i).isin(ANCHORS)).alias("at"),
            F.filter(w, lambda x: ~x.isin(ANCHORS)).alias("rest"),
        )

    def chains(s: Column) -> Column:
        w, at, rest = s["w"], s["at"], s["rest"]
        # before the jth common word, at place p, stand p - j content words
        spotted = F.transform(at, lambda p, j: F.xxhash64(F.get(w, p), *[F.get(rest, p - j + k) for k in range(CHAIN)]))
        last = F.greatest(F.size(w) - CHAIN - 1, F.lit(0))

        def between(j: Column) -> Column:
            # places further than GAP from the common words before and after them; j counts those before
            low = F.coalesce(F.get(at, j - 1) + (GAP + 1), F.lit(0))
            high = F.least(F.get(at, j) - (GAP + 1), last)
            return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        bare = F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), between))
        plain = F.transform(bare, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(CHAIN + 1)]))
        return F.when(F.size(w) > 0, F.concat(spotted, plain)).otherwise(F.array().cast("array<bigint>"))

    found = F.array_sort(F.array_distinct(_let(_let(words, places), chains)))
    whole = F.when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    return _let(found, lambda s: F.when(F.size(s) == 0, whole).otherwise(s))


def fingerprint(sigs: Column) -> Column:
    """The set as text: equal sets give equal texts."""
    return F.array_join(F.transform(sigs, F.hex), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard likeness of two sets, 1 for two empty ones. Where lengths alone rule out ``floor``, the sets are not
    compared and the bound is given instead: it too lies below ``floor``."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (
        F.when(high == 0, F.lit(1.0))
        .when(low == 0, F.lit(0.0))
        .when(low < floor * high, low / high)
        .otherwise(_let(both, lambda n: n / (low + high - n)))
    )


def search(docs: DataFrame, queries: Column, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, match_id, likeness): for each row that ``queries`` selects, all rows at least ``threshold`` alike.

    Sets are dealt out by length: a band of lengths is as wide as the threshold allows, so a match lies in the query's
    band or a neighbouring one. Within a band, sets meet if they share one of the spots that a match must share (a prefix
    of n - ceil(t n) + 1 of them, rarest first, so common spots bring few together) and their lengths allow it; only then
    are they compared. Equal sets are compared once, as a class. Null ids and texts without a signature match nothing;
    repeated ids count once; no rows give no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), spots(F.col(text_col)).alias("s"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = cut(base.where("id is not null and size(s) > 0").select("id", "s", "q", F.xxhash64("s").alias("k")).distinct())
    sets = cut(rows.groupBy("k").agg(F.max("q").alias("q"), F.first("s").alias("s")))
    each = sets.select("k", "q", F.size("s").alias("n"), F.explode("s").alias("x"))
    known = each.groupBy("x").agg(F.count("*").alias("in"))
    ranked = each.join(known, "x").groupBy("k", "q", "n").agg(F.array_sort(F.collect_list(F.struct("in", "x"))).alias("o"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    prefix = F.slice("o.x", F.lit(1), F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)
    filed = ranked.select("k", "q", "n", band.alias("band"), F.explode(prefix).alias("x"))
    asked = filed.where("q").select(F.col("k").alias("ka"), F.col("n").alias("na"), "x", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"))
    low, high = F.least("na", "n"), F.greatest("na", "n")
    near = asked.join(filed.select("k", "n", "band", "x"), ["band", "x"]).where(low >= F.lit(threshold) * high - 1e-9).select("ka", "k").distinct()
    both = near.join(sets.select(F.col("k").alias("ka"), F.col("s").alias("sa")), "ka").join(sets.select("k", "s"), "k")
    alike = both.withColumn("likeness", likeness(F.col("sa"), F.col("s"), threshold)).where(F.col("likeness") >= threshold)
    left = rows.where("q").select(F.col("id").alias("query_id"), F.col("k").alias("ka")).distinct()
    right = rows.select(F.col("id").alias("match_id"), "k").distinct()
    return alike.select("ka", "k", "likeness").join(left, "ka").join(right, "k").where("query_id <> match_id").select("query_id", "match_id", "likeness")


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, next_id): the next smaller id; after the smallest comes the largest. Null ids have none."""
    ids = dealt_in_order(docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "doc_id")
    ends = ids.groupBy("pid").agg(F.max("doc_id").alias("high"))  # a row a range
    carried = ends.select("pid", F.lag("high").over(Window.orderBy("pid")).alias("carry"), F.max("high").over(Window.partitionBy()).alias("top"))
    before = F.lag("doc_id").over(Window.partitionBy("pid").orderBy("doc_id"))
    return ids.withColumn("before", before).join(F.broadcast(carried), "pid").select("doc_id", F.coalesce("before", "carry", "top").alias("next_id"))


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_text, sigs, edited_sigs, next_sigs) for each input row: the text's signatures, those of
    the text whose last third is replaced by the beginning of the next row's (descending id), and the next row's.

    Null texts count as empty. Repeated ids come back as often as they stand; as somebody's next, the least of their
    texts counts. A row with a null id has itself as next. Other columns are ignored; no rows give no rows."""
    n = parts_for(docs, F.octet_length(F.col(text_col)), PART_BYTES)
    # texts are dealt out once, by id; every join below finds them where they are (one exchange, as the key has a new name)
    every = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = every.where("key is not null").repartition(n, "key")
    longest = rows.groupBy("key").agg(F.max(F.floor(F.length("text") / 3)).alias("m"))
    links = next_ids(docs, id_col).join(longest, F.col("doc_id") == F.col("key")).select(F.col("doc_id").alias("id"), F.col("next_id").alias("key"), "m")
    # a row for each row and its next: only as much of the next text is moved as the edit takes
    heads = rows.join(links.repartition(n, "key"), "key").select(
        F.col("id").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("m").cast("int")).alias("head"), spots(F.col("text")).alias("next_sigs")
    )
    heads = heads.repartition(n, "key").groupBy("key").agg(F.min(F.struct("head", "next_sigs")).alias("h")).select("key", "h.*")
    nameless = every.where("key is null").select("*", F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<bigint>").alias("next_sigs"))
    joined = rows.join(heads, "key", "left").unionByName(nameless).select(
        F.col("key").alias("doc_id"), "text", F.length("text").cast("long").alias("n_chars"), spots(F.col("text")).alias("sigs"), "head", "next_sigs"
    )
    third = F.floor(F.col("n_chars") / 3).cast("int")
    keep = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third)
    head = F.substring(F.coalesce("head", "text"), F.lit(1), third)
    edited = joined.select(
        "doc_id", "n_chars", F.concat(keep, head).alias("edited_text"), "sigs", F.coalesce("next_sigs", "sigs").alias("next_sigs")
    )
    return edited.withColumn("edited_sigs", spots(F.col("edited_text")))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all documents and of their edited texts, and how like they are."""
    rows = compared_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
