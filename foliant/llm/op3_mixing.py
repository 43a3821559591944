"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

A source's documents form one word stream in a seeded order, cut into blocks of equal word count. Block seats go to sources
by the highest quotients weight / (2 k - 1), cumulatively for every output shard, which gives integer quotas per shard. A
source fills its seats from a seeded order of its blocks, going round again when it has more seats than blocks.
Everything is DataFrame work; no source list or quota is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.ordering import prefix_offsets
from foliant.scale import read_table, sized, stash

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MAX_EPOCHS = 3
#: Blocks in the whole corpus for each source that it has; a target is then off by under one per cent.
BLOCKS_PER_SOURCE = 1024
SHARDS = 40
SEED = 20_240_607
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> and weight, target, capped, block (words a block), level.

    Sources in code-point order, null last, take ``weights`` in turn; targets share the sum of all sizes, stop at
    max_epochs times the source's size, and the excess is shared anew by weight. One row a source, in one task.
    """
    alone = Window.partitionBy()
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(ranked) - 1) % len(weights) + 1)
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs)
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(alone) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(alone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / weight_left)
    # Levels rise to the right one, where the ratio first reaches them, and fall beyond it.
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(alone)
    t = t.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    t = t.withColumn("capped", F.col("ratio") <= F.col("level"))
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
    block = F.expr(f"greatest(1, sum(source_size) over () div (count(*) over () * {BLOCKS_PER_SOURCE}))")
    return t.withColumn("block", block.cast("long")).select("source", "source_size", "weight", "target", "capped", "block")


def sainte_lague(parties: DataFrame, house: str, party: str, weight: str, cap: str, seats: str, out: str) -> DataFrame:
    """Exact highest-quotient apportionment of ``seats`` (one number a house) to the parties of each house; ties by party.

    Each party starts near its rounded share; only the quotients that rounding can move are ranked (about ten a party).
    A party gets at most ``cap`` seats. Rows with weight 0 get none.
    """
    h = Window.partitionBy(house)
    share = F.col("__w") * F.col(seats) / F.sum("__w").over(h)
    t = parties.withColumn("__w", F.when(F.col(cap) > 0, F.col(weight)).otherwise(F.lit(0.0)))
    t = t.withColumn("__x", F.when(F.col("__w") > 0, share).otherwise(F.lit(0.0)))
    t = t.withColumn("__m", F.ceil(F.when(F.col("__w") > 0, 2 * F.count(F.lit(1)).over(h) * F.col("__w") / F.sum("__w").over(h)).otherwise(F.lit(0.0))) + 2)
    near = F.floor(F.col("__x") + 0.5)
    t = t.withColumn("__lo", F.greatest(F.lit(0), near - F.col("__m"))).withColumn("__hi", F.when(F.col("__w") > 0, F.least(F.col(cap), near + F.col("__m"))).otherwise(F.lit(0)))
    t = t.withColumn("__hi", F.greatest("__lo", "__hi")).withColumn("__open", F.col(seats) - F.sum("__lo").over(h))
    k = F.when(F.col("__hi") > F.col("__lo"), F.sequence(F.col("__lo") + 1, F.col("__hi")))
    q = t.select(house, party, "__open", F.explode(k).alias("__k"), "__w").withColumn("__q", F.col("__w") / (2 * F.col("__k") - 1))
    rank = F.row_number().over(Window.partitionBy(house).orderBy(F.desc("__q"), party, "__k"))
    won = q.withColumn("__r", rank).where("__r <= __open").groupBy(house, party).agg(F.count(F.lit(1)).alias("__won"))
    t = t.join(won, [house, party], "left")
    return t.withColumn(out, (F.col("__lo") + F.coalesce("__won", F.lit(0))).cast("long")).drop("__w", "__x", "__m", "__lo", "__hi", "__open", "__won")


def block_plan(targets: DataFrame, n_shards: int = SHARDS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row a block: party (the source's number), block number, its words, ``times`` it is taken, ``before`` (words taken from
    earlier blocks of the source) and ``shards`` (the output shard of each time). Its size follows the number of sources only."""
    n = F.expr("int((source_size + block - 1) div block)")
    t = targets.withColumn("blocks", n).withColumn("cap", F.col("blocks") * max_epochs)
    houses = F.explode(F.sequence(F.lit(1), F.lit(n_shards)))
    # Targets strictly under their cap are apportioned; capped ones take all their blocks max_epochs times.
    open_words = F.sum(F.when(~F.col("capped"), F.col("target")).otherwise(F.lit(0.0))).over(Window.partitionBy())
    t = t.withColumn("seats_all", F.round(open_words / F.col("block")).cast("long"))
    free = t.where(~F.col("capped")).select("party", "weight", "cap", "seats_all", houses.alias("house"))
    free = sainte_lague(free.withColumn("seats", F.expr(f"seats_all * house div {n_shards}")), "house", "party", "weight", "cap", "seats", "upto").select("party", "house", "upto")
    full = t.where("capped").select("party", houses.alias("house"), "cap").select("party", "house", F.expr(f"cap * house div {n_shards}").alias("upto"))
    quotas = free.unionByName(full).groupBy("party").agg(F.array_sort(F.collect_list(F.struct("house", "upto"))).alias("upto"))
    t = t.join(quotas, "party", "left").withColumn("quota", F.coalesce(F.get("upto", F.lit(n_shards - 1))["upto"], F.lit(0)))
    b = t.where("blocks > 0").select("party", "source_size", "block", "blocks", "quota", "upto", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"))
    drawn = Window.partitionBy("party").orderBy(F.xxhash64(F.lit(seed), "party", "number"), "number")
    b = b.withColumn("rank", F.row_number().over(drawn) - 1)
    b = b.withColumn("times", F.greatest(F.lit(0), F.expr("int((quota - rank + blocks - 1) div blocks)")))
    b = b.withColumn("words", F.least(F.col("block"), F.col("source_size") - F.col("number") * F.col("block")))
    before = Window.partitionBy("party").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.coalesce(F.sum(F.col("words") * F.col("times")).over(before), F.lit(0)))
    seats = F.when(F.col("times") > 0, F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda e: F.size(F.filter("upto", lambda u: u["upto"] <= F.col("rank") + e * F.col("blocks"))))).otherwise(F.array().cast("array<int>"))
    return b.select("party", "number", "words", "times", "before", seats.alias("shards"))


def apportion(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, n_shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The stored targets (a row a source, numbered by ``party``) and block plan for (source, source_size)."""
    targets = source_targets(sizes, weights, max_epochs).withColumn("party", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    targets = stash(targets)
    return targets, sized(stash(block_plan(targets, n_shards, max_epochs, seed)))


#: What ``mix`` adds; input columns of these names are replaced.
RESULTS = ("source_size", "target", "taken", "shards")


def mix(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of ``rows`` (doc_id, source, size, ...) with source_size, target, ``taken`` (words the mix takes, repeats
    counted), ``shards`` (where the first word's block goes).

    Document order within a source is a hash of the seed, doc_id and size, so reruns agree; equal rows are interchangeable.
    Null sources form one source, the last. Documents of size 0 take nothing. An empty table gives no rows. No document is taken
    more than max_epochs times. Input columns named like a result (RESULTS) are replaced; names that begin with two underscores
    are the operator's own. ``rows`` is read several times: pass a stash of the few columns.
    """
    rows = rows.drop(*RESULTS)
    targets, plan = apportion(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs, n_shards, seed)
    small = sized(targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__total"), F.col("target").alias("__target"), F.col("party").alias("__party"), F.col("block").alias("__block")))
    t = rows.join(small, rows["source"].eqNullSafe(F.col("__source")))
    t = prefix_offsets(t, "__party", F.col("size"), [F.col("doc_id"), F.col("size")], seed, "__a")
    t = t.withColumn("__e", F.col("__a") + F.col("size"))
    t = t.withColumn("__f", F.expr("case when size > 0 then int(__a div __block) end")).withColumn("__l", F.expr("case when size > 0 then int((__e - 1) div __block) end"))
    first = plan.select(F.col("party").alias("__fp"), F.col("number").alias("__fn"), F.col("times").alias("__ft"), F.col("before").alias("__fb"), F.col("shards").alias("__fs"))
    last = plan.select(F.col("party").alias("__lp"), F.col("number").alias("__ln"), F.col("times").alias("__lt"), F.col("before").alias("__lb"))
    t = t.join(first, (F.col("__party") == F.col("__fp")) & (F.col("__f") == F.col("__fn")), "left").join(last, (F.col("__party") == F.col("__lp")) & (F.col("__l") == F.col("__ln")), "left")
    upto = lambda at, number, before, times: F.col(before) + (F.col(at) - F.col(number) * F.col("__block")) * F.col(times)
    taken = upto("__e", "__l", "__lb", "__lt") - upto("__a", "__f", "__fb", "__ft")
    added = {"source_size": F.col("__total"), "target": F.col("__target"), "taken": F.coalesce(taken, F.lit(0)).cast("long"), "shards": F.col("__fs")}
    return t.select(*[F.col(f"`{c}`") for c in rows.columns], *[v.alias(k) for k, v in added.items()])


#: A copy of a document, in the whole units that running totals are kept in.
UNIT = 1 << 20


def mixed(df: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix as whole documents, same columns: each is taken as often as the blocks that its words lie in are drawn.

    A document inside blocks that are drawn k times comes k times, one inside blocks that aren't drawn never. Where its blocks
    differ, the share of its words that they take is rounded: along the source's documents by size class and seeded hash the
    copies follow the running total of these shares, so a source misses its share by about one document. Documents without words
    are left out; rows equal in every column are one document of so many times its words; null sources are one source; an empty
    table gives no rows; other columns pass through, names that begin with two underscores are the operator's own.
    """
    every = [F.col(f"`{c}`") for c in df.columns]
    t = df.withColumn("__k1", F.xxhash64(*every, F.lit(1))).withColumn("__k2", F.xxhash64(F.lit(2), *every))
    narrow = t.select("__k1", "__k2", F.col("source"), word_count(F.col("text")).alias("__n")).where("__n > 0")
    narrow = stash(narrow.groupBy("__k1", "__k2", "source").agg(F.first("__n").alias("__n"), F.count(F.lit(1)).alias("__c")))
    items = narrow.withColumn("doc_id", F.col("__k1")).withColumn("size", F.col("__n") * F.col("__c"))
    shares = mix(items, weights, max_epochs, SHARDS, seed).withColumn("__share", F.round(F.col("taken") * UNIT / F.col("__n")).cast("long"))
    shares = stash(shares.select("__k1", "__k2", "source", "__n", "__c", "__share"))
    shares = prefix_offsets(shares, "source", F.col("__share"), [F.col("__k1"), F.col("__k2")], seed + 1, "__at", F.floor(8 * F.log2("__n")), 256)
    step = lambda x: F.shiftright(x + UNIT // 2, 20)
    shares = shares.withColumn("__times", (step(F.col("__at") + F.col("__share")) - step(F.col("__at"))).cast("int")).where("__times > 0")
    shares = stash(shares.select(F.col("__k1").alias("__j1"), F.col("__k2").alias("__j2"), "__times", "__c"))
    same = (F.col("__k1") == F.col("__j1")) & (F.col("__k2") == F.col("__j2"))
    out = t.join(sized(shares.where("__c = 1")), same)
    if not shares.where("__c > 1").isEmpty():
        out = out.unionByName(t.join(sized(shares.where("__c > 1")), same).dropDuplicates(["__k1", "__k2"]))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*every)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    rows = stash(d.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken", "source")
