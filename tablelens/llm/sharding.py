"""Sharding by balanced label propagation, in DataFrame functions only.

Rows start in shards by a hash.  Links go from members to heads.  In turns all
heads, then all members, count their neighbours' shards and ask to move to the
shard most of them are in.  No two rows that ask are linked, so each move cuts
fewer links, and the rounds end when neither side has a request that passes.  For
each shard as many may come as ask to leave, plus the room under its capacity,
so sizes stay even; which requests pass is decided by gain and a hashed order,
through a small histogram and without sorting all requests.
Links to a row with very many neighbours are salted.

A final step makes the law ``rows`` exact: the counts differ by one at most.
Rows beyond a shard's quota, unlinked ones first and then those of groups
larger than a shard, fill shards below theirs,
and every row gets its place in its shard.  Ranks come from counts of bounded
buckets, so no window holds a whole shard.

Defined results: a null text is as an empty one (size 8, checksum 0); a null
key is carried along; repeated rows and equal texts are linked and placed
each; an empty table gives an empty result; fewer rows than shards leave
shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.frames import stored

#: A row with more neighbours than this, or than a ten-thousandth of all links, has its label sent to salted copies.
HOT_LINKS, SALTS = 100_000, 64
#: Capacity of a shard during the rounds, as a share of an even one; buckets of the hashed order of requests.
SLACK, STEPS = 1.1, 256
BUCKET_ROWS = 20_000


def propagate(nodes: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """id, shard of the linked rows after the rounds.

    nodes: id, shard (every row, linked or not).  links: a, b (ids of a member and its head), each link once; no row is both.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = stored(both.filter("src <> dst"))
    total = both.count()
    # At most 10,000 rows have that many neighbours.
    hot = stored(both.groupBy("dst").count().filter(F.col("count") > max(HOT_LINKS, total // 10_000)).select(F.col("dst").alias("id")))
    salted = both.join(F.broadcast(hot.withColumn("hot", F.lit(True))), F.col("dst") == F.col("id"), "left")
    edges = salted.select("src", "dst", F.when(F.col("hot"), F.pmod(F.xxhash64("src"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")).alias("salt"))
    linked = both.select(F.col("src").alias("id")).distinct()
    heads = links.select(F.col("b").alias("id")).distinct().withColumn("head", F.lit(True))
    labels = stored(nodes.select("id", "shard").join(linked, "id", "left_semi").join(heads, "id", "left").select("id", "shard", F.coalesce("head", F.lit(False)).alias("head")))
    rest = stored(nodes.select("id", "shard").join(linked, "id", "left_anti").groupBy("shard").agg(F.count("*").alias("n")))
    capacity = int(SLACK * ((rest.agg(F.sum("n")).first()[0] or 0) + labels.count()) / shards) + 1
    k = still = 0  # rounds, and how many of the last ones moved nothing
    while still < 2:
        copies = labels.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "id", "left").select(
            F.col("id").alias("dst"), F.col("shard").alias("there"), F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("salt")
        )
        votes = edges.join(copies, ["dst", "salt"]).groupBy("src", "there").agg(F.count("*").alias("n"))
        wish = votes.groupBy("src").agg(F.max_by("there", F.struct("n", -F.col("there"))).alias("to"), F.max("n").alias("best"), F.map_from_entries(F.collect_list(F.struct("there", "n"))).alias("seen"))
        ask = labels.join(wish.withColumnRenamed("src", "id"), "id").withColumn("gain", F.col("best") - F.coalesce(F.try_element_at("seen", F.col("shard")), F.lit(0).cast("long")))
        # Larger gains come first, then a hashed order that differs by round.
        step = F.when(F.col("gain") > 1, F.lit(0)).otherwise(1) * STEPS + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(STEPS))
        # One side of the links asks in a round, or two linked rows would swap shards forever.
        ask = stored(ask.filter((F.col("gain") > 0) & (F.col("head") == F.lit(k % 2 == 0))).select("id", F.col("shard").alias("from"), "to", step.alias("step")))
        counts = ask.groupBy("to", "step").agg(F.count("*").alias("n"))
        leaving = ask.groupBy(F.col("from").alias("shard")).agg(F.count("*").alias("out"))
        sizes = labels.groupBy("shard").agg(F.count("*").alias("n")).unionByName(rest).groupBy("shard").agg(F.sum("n").alias("size"))
        every = nodes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(sizes, "shard", "left").join(leaving, "shard", "left").na.fill(0, ["size", "out"])
        quota = every.select(F.col("shard").alias("to"), F.greatest(F.lit(0), F.lit(capacity) - F.col("size") + F.col("out")).alias("quota"))
        upto = F.sum("n").over(Window.partitionBy("to").orderBy("step"))
        passed = counts.withColumn("upto", upto).join(quota, "to").filter("upto <= quota").select("to", "step")
        # At most shards * 2 * STEPS rows.
        moves = stored(ask.join(F.broadcast(passed), ["to", "step"]).select("id", F.col("to").alias("next")))
        k, still = k + 1, still + 1
        if not moves.isEmpty():
            still = 0
            labels = stored(labels.join(moves, "id", "left").select("id", F.coalesce("next", "shard").alias("shard"), "head"))
    return labels.drop("head")


def level(nodes: DataFrame, shards: int) -> DataFrame:
    """The rows (id, shard, linked, ...) with ``shard`` moved to quotas one apart at most, and ``slot``."""
    rows = stored(nodes)
    total = rows.count()
    buckets = max(1, total // (shards * BUCKET_ROWS))
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    part = ["shard", "linked", "bucket"]
    counts = stored(placed.groupBy(*part).agg(F.count("*").alias("n")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(F.desc("linked"), "bucket")) - F.col("n")
    starts = counts.withColumn("before", before).select(*part, "before")
    nth = F.row_number().over(Window.partitionBy(*part).orderBy(F.xxhash64("id"), "id"))
    ranked = placed.withColumn("nth", nth).join(starts, part).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("nth", "before", "bucket")
    # One number a shard: its rows, its quota, and where its surplus and its free places lie among all.
    n = {r.shard: r.n for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    size = [n.get(s, 0) for s in range(shards)]
    larger = set(sorted(range(shards), key=lambda s: (-size[s], s))[: total % shards])
    quota = [total // shards + (s in larger) for s in range(shards)]
    surplus, free = [0], [0]
    for s in range(shards):
        surplus.append(surplus[-1] + max(0, size[s] - quota[s]))
        free.append(free[-1] + max(0, quota[s] - size[s]))
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard").cast("int") + 1)
    extra = of(surplus[:-1]) + F.col("rank") - of(quota)
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s in reversed(range(shards)):
        if free[s + 1] > free[s]:
            here = F.col("extra") < free[s + 1]
            to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("extra") - free[s] + size[s]).otherwise(slot)
    moved = F.col("rank") >= of(quota)
    out = ranked.withColumn("extra", extra).withColumn("moved", moved)
    out = out.withColumn("slot", F.when(F.col("moved"), slot).otherwise(F.col("rank"))).withColumn("shard", F.when(F.col("moved"), to).otherwise(F.col("shard")).cast("int"))
    return out.drop("rank", "extra", "moved", "linked")


def shard_rows(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard; equal texts are linked."""
    full: Column = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), (F.octet_length(full) + 8).cast("long").alias("size"), F.crc32(full.cast("binary")).alias("text_crc32"), F.xxhash64(full).alias("group")
        )
    )
    start = rows.select("id", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "group", "size")
    # Each row of a group is linked to the group's first row: as many links as rows, not all pairs.
    groups = rows.groupBy("group", "size").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    links = rows.join(groups, ["group", "size"]).filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    moved = propagate(start, links, shards).withColumnRenamed("shard", "next")
    # Rows of groups that no shard can hold leave a full shard before those of groups that fit.
    fits = F.when(F.col("n").isNull(), 0).when(F.col("n") > rows.count() // shards, 1).otherwise(2)
    sizes = groups.select("group", "size", "n")
    placed = start.join(moved, "id", "left").join(sizes, ["group", "size"], "left").select("id", F.coalesce("next", "shard").cast("int").alias("shard"), fits.alias("linked"))
    out = rows.drop("group").join(level(placed, shards), "id")
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
