"""Chat formatting by linking quotations.

A message's lines are parsed into nested quote levels. Each run of quoted lines of one level is a passage; its
normalised text is hashed, whole and line by line, and joined to the hashes of what messages say themselves. A reply's
parent is the message that the first of its outermost passages to match quotes: the latest earlier one of the
conversation that says it, else the first that says it in another conversation; the other passages, of all levels, keep links of their
own. Messages come back without their quotes, in an order in which replies follow what
they reply to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._cluster import cut, dealt_in_order

#: Shortest normalised line that is matched on its own; shorter ones ("yes", "thanks") say too little.
LEAST_LINE = 12


def levels(text: str) -> list[tuple[int, str]]:
    """(level, content) of each line: as many levels as leading '>' signs, blanks between them allowed."""
    out = []
    for line in text.split("\n"):
        level, at = 0, 0
        while at < len(line) and line[at] in "> \t":
            if line[at] == ">":
                level += 1
                end = at + 1
            at += 1
        out.append((level, line[end:].strip() if level else line))
    return out


def normal(text: str) -> str:
    """Text for hashing: lower case, white space as single blanks."""
    return " ".join(text.lower().split())


def _hash(text: str) -> int:
    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parsed(text: str) -> tuple[str, list[tuple[int, int, list[int]]], list[tuple[int, int]]]:
    """A message's own text, its passages (number, level, hashes from whole to lines), and (weight, hash) of what it says."""
    lines = levels(text)
    own = "\n".join(c for lv, c in lines if lv == 0).strip()
    passages: list[tuple[int, int, list[int]]] = []
    i = 0
    while i < len(lines):
        level = lines[i][0]
        j = i
        while j < len(lines) and lines[j][0] == level:
            j += 1
        if level:
            said = [normal(c) for _, c in lines[i:j]]
            whole = normal(" ".join(said))
            if whole:
                keys = [_hash(whole)] + [_hash(s) for s in said if len(s) >= LEAST_LINE and s != whole]
                passages.append((len(passages), level, keys))
        i = j
    says: dict[int, int] = {}
    for c in own.split("\n"):
        if len(normal(c)) >= LEAST_LINE:
            says[_hash(normal(c))] = 1
    for part in own.split("\n\n"):
        if normal(part):
            says[_hash(normal(part))] = 2
    if normal(own):
        says[_hash(normal(own))] = 3
    return own, passages, [(w, h) for h, w in says.items()]


def _parsed(messages: DataFrame) -> DataFrame:
    passage = pa.struct([("n", pa.int32()), ("level", pa.int32()), ("keys", pa.list_(pa.int64()))])
    says = pa.struct([("weight", pa.int32()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([[{"n": n, "level": lv, "keys": k} for n, lv, k in r[1]] for r in rows], pa.list_(passage)),
                    pa.array([[{"weight": w, "h": h} for w, h in r[2]] for r in rows], pa.list_(says)),
                ],
                ["conv_id", "turn", "role", "text", "passages", "says"],
            )

    return messages.mapInArrow(
        run,
        "conv_id long, turn long, role string, text string, passages array<struct<n:int,level:int,keys:array<long>>>, says array<struct<weight:int,h:long>>",
    )


def passage_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, n, level, parent_conv, parent_turn) for each passage of each message of _parsed(): the latest
    earlier message of the conversation that says it, else the first that says it in another conversation, else null. A passage is
    looked for whole before its lines are. Messages with one conv_id and turn are taken as one and share their links."""
    asked = rows.where("size(passages) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*").distinct()
    keys = asked.select("conv_id", "turn", "n", "level", F.posexplode("keys").alias("k", "h"))
    said = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("says").alias("s")).select("conv_id", "turn", "s.h")
    wanted = keys.select("h").distinct()
    said = said.join(wanted, "h", "left_semi")
    # what is quoted and what is said meet per (conversation, hash), in turn order: the latest said before is carried on
    both = said.select("conv_id", "h", "turn", F.col("turn").alias("said"), *[F.lit(None).cast("int").alias(c) for c in ("n", "level", "k")]).distinct().unionByName(
        keys.select("conv_id", "h", "turn", F.lit(None).cast("long").alias("said"), "n", "level", "k")
    )
    earlier = F.last("said", ignorenulls=True).over(Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    near = both.withColumn("near", earlier).where("k is not null").select("conv_id", "turn", "n", "level", "h", "k", "near")
    # the first two conversations that say it: one of them is another than the quoting one's
    firsts = said.groupBy("h", "conv_id").agg(F.min("turn").alias("turn")).withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("conv_id"))).where("r <= 2")
    place = F.struct("conv_id", "turn")
    anywhere = firsts.groupBy("h").agg(F.min(place).alias("far"), F.max(place).alias("next"))
    found = near.join(anywhere, "h", "left").withColumn(
        "far", F.when(F.col("far.conv_id") != F.col("conv_id"), F.col("far")).when(F.col("next.conv_id") != F.col("conv_id"), F.col("next"))
    )
    hit = F.when(F.col("near").isNotNull(), F.struct(F.lit(0).alias("o"), "k", F.col("conv_id").alias("c"), F.col("near").alias("t"))).when(
        F.col("far").isNotNull(), F.struct(F.lit(1).alias("o"), "k", F.col("far.conv_id").alias("c"), F.col("far.turn").alias("t"))
    )
    best = found.withColumn("b", hit).groupBy("conv_id", "turn", "n", "level").agg(F.min("b").alias("b"))
    return best.select("conv_id", "turn", "n", "level", F.col("b.c").alias("parent_conv"), F.col("b.t").alias("parent_turn"))


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, parent_conv, parent_turn, links, reply_path) for each message.

    ``messages`` has conv_id, turn, role, text (others are ignored). ``text`` is the message without quoted lines,
    stripped; n_quotes its passages; ``links`` has (n, level, parent_conv, parent_turn) of each passage, parents null where
    nothing says it; parent_* is the message quoted by the first passage of least level that has one, or null.
    ``reply_path`` orders a conversation: sort by (conv_id, reply_path, turn), and a message that quotes one before the
    last comes, with what follows it, after the rest of the branch it answers. A null text is empty, a null conv_id or
    turn links to nothing; repeated rows stay, and count as one original. No rows give no rows.
    """
    rows = cut(_parsed(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))))
    links = passage_links(rows)
    per = links.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("n", "level", "parent_conv", "parent_turn"))).alias("links"),
        # of the passages that match, the first of least level
        F.min(F.when(F.col("parent_turn").isNotNull(), F.struct("level", "n", "parent_conv", "parent_turn"))).alias("b"),
    )
    best = per.select("conv_id", "turn", "links", F.col("b.parent_conv").alias("parent_conv"), F.col("b.parent_turn").alias("parent_turn"))

    unlinked = F.array().cast("array<struct<n:int,level:int,parent_conv:bigint,parent_turn:bigint>>")
    dealt = dealt_in_order(rows.drop("says").join(best, ["conv_id", "turn"], "left").withColumn("links", F.coalesce("links", unlinked)).withColumn("n_quotes", F.size("passages").cast("long")).drop("passages"), "conv_id", "turn")
    # a branch begins where a message answers another one than the last of its conversation
    own = (F.col("parent_conv") == F.col("conv_id")) & F.col("parent_turn").isNotNull()
    in_part = Window.partitionBy("pid", "conv_id").orderBy("turn")
    before = F.max("turn").over(in_part.rangeBetween(Window.unboundedPreceding, -1))
    tops = dealt.groupBy("conv_id", "pid").agg(F.max("turn").alias("_top"))
    prior = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("conv_id", "pid", F.max("_top").over(prior).alias("_top")).where("_top is not null")
    previous = dealt.withColumn("_before", before).where(own).join(tops, ["conv_id", "pid"], "left")
    skip = previous.where(F.coalesce("_before", "_top") > F.col("parent_turn")).select("conv_id", "turn", "parent_turn").distinct()
    breaks = cut(skip)
    marked = dealt.join(breaks.select("conv_id", "turn", F.col("turn").alias("_break")), ["conv_id", "turn"], "left")
    run = F.last("_break", ignorenulls=True).over(in_part.rangeBetween(Window.unboundedPreceding, 0))
    ends = marked.groupBy("conv_id", "pid").agg(F.max("_break").alias("_end"))
    carry = ends.select("conv_id", "pid", F.max("_end").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    branched = marked.withColumn("_b", run).join(carry.where("_carry is not null"), ["conv_id", "pid"], "left").withColumn("branch", F.coalesce("_b", "_carry"))
    # where each branch hangs: the branch of the message it answers, found the same way; then paths double in length
    heads = breaks.join(branched.select("conv_id", F.col("turn").alias("parent_turn"), F.col("branch").alias("up")).distinct(), ["conv_id", "parent_turn"])
    paths = cut(heads.select("conv_id", F.col("turn").alias("branch"), "up", F.array(F.struct((-F.col("parent_turn")).alias("after"), F.col("turn").alias("start"))).alias("path")))
    while paths.where("up is not null").limit(1).count():
        above = paths.select("conv_id", F.col("branch").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        paths = cut(paths.join(above, ["conv_id", "up"], "left").select("conv_id", "branch", F.col("next").alias("up"), F.when(F.col("head").isNotNull(), F.concat("head", "path")).otherwise(F.col("path")).alias("path")))
    none = F.array().cast("array<struct<after:bigint,start:bigint>>")
    return branched.join(paths.select("conv_id", "branch", "path"), ["conv_id", "branch"], "left").select(
        "conv_id", "turn", "role", "text", "n_quotes", "parent_conv", "parent_turn", "links", F.coalesce("path", none).alias("reply_path")
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all conversations without quotes, each message with its parent and its place in reply order."""
    rows = linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return rows.withColumn("links", F.to_json("links", {"ignoreNullFields": "false"})).withColumn("reply_path", F.to_json("reply_path"))
