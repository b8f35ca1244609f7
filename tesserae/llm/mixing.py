"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents in order of doc_id, form a stream that is packed into blocks of BLOCK words (the
last may be shorter). A source's target is turned into slots of one block each, the last cut to the exact word. The
slots of each source are thrown over the output shards (a multinomial draw of source counts per output shard, given
each source's total, so a shard has SHARD_SLOTS slots in the mean and not exactly); the counts' running sums give every
shard a range of the source's indexes. An index names a pass
over the source and a place in it; the place goes through a pseudorandom permutation of that pass (a swap-or-not
network, which permutes any domain size and has an exact inverse) to a block. Joining blocks by index gives the words.

Targets: weights 3, 1, 2, repeating in code point order of the sources (null last), share 150 % of all words; a target
stops at twice its source's words and the excess is shared again by weight. That fixed point has a closed form over the
sources in order of capacity over weight.

Nothing is proportional to a source in one task: running sums go over ranges of documents and of shards at two levels,
and a source's slots are made in chunks and placed by shard. Ranges are as wide as the ids are sparse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, md5_int

BLOCK = 512
#: Slots of an output shard, and of a chunk in which a source's slots are made.
SHARD_SLOTS, CHUNK_SLOTS = 1024, 1024
SHARE, MAX_REPEAT, WEIGHTS = 1.5, 2, (3, 1, 2)
ROUNDS, PRIME = 24, 2147483647
#: Documents of one range of ids (in the mean), ranges of one coarse range, and shards of a range, for running sums.
FINE, COARSE, SHARD_RANGE = 128, 1024, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_plan(by_source: DataFrame, block: int = BLOCK) -> DataFrame:
    """by_source (skey, source, source_size: one row per source) with target, passes, slots and all that a slot needs."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    everything = W.partitionBy()
    ranked = by_source.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("bigint")
    )
    caps = ranked.withColumn("cap", F.col("source_size") * MAX_REPEAT).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    line = W.orderBy("ratio", "rank")
    level = (
        caps.withColumn("cap_before", F.sum("cap").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weight_after", F.sum("weight").over(everything) - F.sum("weight").over(line.rowsBetween(W.unboundedPreceding, 0)) + F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything).cast("double") * SHARE - F.col("cap_before")) / F.col("weight_after"))
        .withColumn("place", F.row_number().over(line))
        .withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level")))
        .withColumn("fit", F.min("fits").over(everything)["level"])
    )
    words = level.withColumn("target", F.least(F.col("cap").cast("double"), F.col("fit") * F.col("weight"))).withColumn("words", F.floor(F.col("target") + 0.5).cast("bigint"))
    passes = (
        words.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(float(block))).cast("bigint"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.expr("words div source_size"))).otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn("tail", F.col("source_size") - (F.col("n_blocks") - 1) * block)
    )
    keyed = passes.filter("n_blocks > 0").select("skey", "rank", "n_blocks", "passes", "rest", "tail", "words", "source_size", "target")
    backward = F.reverse(round_keys(F.col("rank"), F.col("passes"), F.col("n_blocks")))
    at = permute(F.col("n_blocks") - 1, F.col("n_blocks"), backward)
    cut = (
        keyed.withColumn("tail_at", at)
        .withColumn(
            "last_slots",
            F.when(F.col("rest") <= F.col("tail_at") * block, F.ceil(F.col("rest") / F.lit(float(block))))
            .when(F.col("rest") <= F.col("tail_at") * block + F.col("tail"), F.col("tail_at") + 1)
            .otherwise(F.ceil((F.col("rest") + block - F.col("tail")) / F.lit(float(block))))
            .cast("bigint"),
        )
        .withColumn("short", F.when((F.col("last_slots") - 1) > F.col("tail_at"), block - F.col("tail")).otherwise(0))
        .withColumn("last_words", F.col("rest") + F.col("short") - (F.col("last_slots") - 1) * block)
        .withColumn("slots", F.col("passes") * F.col("n_blocks") + F.col("last_slots"))
    )
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(everything) / F.lit(float(SHARD_SLOTS)))).cast("bigint")
    return cut.withColumn("n_shards", shards).select("skey", "rank", "source_size", "target", "n_blocks", "passes", "last_slots", "last_words", "slots", "n_shards")


def round_keys(rank: Column, epoch: Column, n: Column) -> Column:
    """The permutation's round keys as an array of structs (k, a, b)."""
    draw = lambda what, r: md5_int(F.concat_ws("|", F.lit(what), rank.cast("string"), epoch.cast("string"), r.cast("string")))
    return F.transform(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        lambda r: F.struct((draw("k", r) % n).alias("k"), (draw("a", r) % (PRIME - 1) + 1).alias("a"), (draw("b", r) % PRIME).alias("b")),
    )


def permute(x: Column, n: Column, keys: Column) -> Column:
    """x of [0, n) through the swap-or-not rounds; with the keys reversed, the inverse."""

    def one(at, key):
        partner = (key["k"] - at + n) % n
        bit = ((F.greatest(at, partner) % PRIME) * key["a"] + key["b"]) % PRIME % 2
        return F.when(bit == 1, partner).otherwise(at)

    return F.aggregate(keys, x.cast("bigint"), one)


def before(column: str, window) -> Column:
    """The sum of the column over the rows before, in the window's order."""
    return F.coalesce(F.sum(column).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def draw_slots(plan: DataFrame) -> DataFrame:
    """One row per slot: skey, shard, block (permuted) and the words of the block that it takes at most."""
    chunks = plan.filter("slots > 0").withColumn("chunk", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK_SLOTS})")))
    thrown = (
        chunks.select("skey", "rank", "slots", "n_shards", "chunk")
        .repartition("skey", "chunk")
        .withColumn("i", F.explode(F.expr(f"sequence(chunk * {CHUNK_SLOTS}L, least(slots, (chunk + 1) * {CHUNK_SLOTS}L) - 1)")))
        .withColumn("shard", md5_int(F.concat_ws("|", F.lit("shard"), F.col("rank").cast("string"), F.col("i").cast("string"))) % F.col("n_shards"))
    )
    counts = thrown.groupBy("skey", "shard").agg(F.count("*").alias("n"))
    counts = counts.withColumn("range", F.expr(f"shard div {SHARD_RANGE}"))
    base = counts.groupBy("skey", "range").agg(F.sum("n").alias("n")).select("skey", "range", before("n", W.partitionBy("skey").orderBy("range")).alias("base"))
    inside = before("n", W.partitionBy("skey", "range").orderBy("shard"))
    ranged = counts.withColumn("from", inside).join(base, ["skey", "range"]).withColumn("from", F.col("from") + F.col("base")).repartition("skey", "shard")
    epochs = plan.filter("slots > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, (slots - 1) div n_blocks)")))
    keyed = epochs.withColumn("keys", round_keys(F.col("rank"), F.col("epoch"), F.col("n_blocks"))).select("skey", "epoch", "n_blocks", "passes", "last_slots", "last_words", "keys")
    indexed = ranged.withColumn("index", F.explode(F.expr("sequence(`from`, `from` + n - 1)"))).select("skey", "shard", "index")
    placed = indexed.join(plan.select("skey", F.col("n_blocks").alias("n")), "skey").withColumn("epoch", F.expr("index div n")).join(keyed, ["skey", "epoch"])
    place = F.col("index") - F.col("epoch") * F.col("n_blocks")
    last = (F.col("epoch") == F.col("passes")) & (place == F.col("last_slots") - 1)
    return placed.select("skey", "shard", permute(place, F.col("n_blocks"), F.col("keys")).alias("block"), F.when(last, F.col("last_words")).alias("cut"))


def taken_pieces(documents: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, source, text) -> (pieces, empty). pieces: a row for each piece of a document with words that
    lies in one block and each slot that takes the block (one with nulls if none does): skey, start (of the document
    in its source's stream), doc_id, size, source_size, target, shard, first (the piece's first word in the document)
    and got (words taken). empty: the documents without words, with their source's size and target."""
    whole = dict(documents.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    place = F.col("doc_id").cast("bigint") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # deals rows without an id over ranges of their own
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), place.alias("place"), spread.alias("spread"))
    docs = materialize(sized.withColumn("skey", source_key(F.col("source"))), "mix-sizes")
    rows, low, high = docs.agg(F.count("*"), F.min("place"), F.max("place")).first()
    width, ranges = max(FINE, FINE * ((high or 0) - (low or 0)) // max(1, rows)), rows // FINE + 1
    lowest = (low or 0) // width - 1
    docs = docs.withColumn("fine", F.coalesce(F.floor(F.col("place").cast("double") / float(width)), F.lit(lowest - 1) - F.pmod("spread", F.lit(ranges))).cast("bigint"))
    fine = docs.groupBy("skey", "fine").agg(F.sum("size").alias("words"), F.min("source").alias("source")).withColumn("coarse", F.expr(f"floor(fine / {COARSE}D)").cast("bigint"))
    plan = materialize(source_plan(fine.groupBy("skey").agg(F.min("source").alias("source"), F.sum("words").alias("source_size")), block), "mix-plan")
    coarse = fine.groupBy("skey", "coarse").agg(F.sum("words").alias("words"))
    coarse = coarse.select("skey", "coarse", before("words", W.partitionBy("skey").orderBy("coarse")).alias("base"))
    starts = fine.withColumn("inner", before("words", W.partitionBy("skey", "coarse").orderBy("fine"))).join(coarse, ["skey", "coarse"])
    starts = starts.join(plan.select("skey", "target", "source_size"), "skey", "left").select("skey", "fine", (F.col("base") + F.col("inner")).alias("base"), "source_size", "target")
    inside = W.partitionBy("skey", "fine").orderBy(F.col("place").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "size")
    placed = docs.withColumn("start", before("size", inside)).join(starts, ["skey", "fine"]).withColumn("start", F.col("start") + F.col("base"))
    placed = placed.select("skey", "start", "doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    pieces = pieces.withColumn("low", F.greatest(F.lit(0), F.col("start") - F.col("block") * block)).withColumn("high", F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block))
    got = F.greatest(F.lit(0), F.least(F.col("high"), F.coalesce("cut", F.lit(block))) - F.col("low"))
    joined = pieces.join(draw_slots(plan), ["skey", "block"], "left").withColumn("got", F.when(F.col("shard").isNotNull(), got).otherwise(0))
    first = F.col("block") * block + F.col("low") - F.col("start")
    return joined.select("skey", "start", "doc_id", "size", "source_size", "target", "shard", first.alias("first"), "got"), placed.filter("size = 0")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """documents (doc_id, source, text) -> doc_id, size, source_size, target, taken, first_shard.

    taken counts the words that the mix takes from the row's text, repeats counted; first_shard is the smallest output
    shard that holds any of them, else null. One row per input row. Null text counts as empty, null source is a source
    of its own, null doc_ids come first in their source's stream, by hashes of their texts; rows that agree in doc_id
    and size are interchangeable. Ids that are no integers are ordered by their hash. Empty sources have target 0; an
    empty table gives an empty result. Other columns are ignored."""
    pieces, empty = taken_pieces(documents, block)
    taken = pieces.groupBy("skey", "start", "doc_id", "size", "source_size", "target").agg(F.sum("got").cast("bigint").alias("taken"), F.min(F.when(F.col("got") > 0, F.col("shard"))).alias("first_shard"))
    none = empty.select("doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("bigint").alias("first_shard"))
    return taken.select(*none.columns).unionByName(none)


def mixed_documents(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """documents (doc_id, source, text, others) -> the mix as documents with the same columns: a row for each document
    that words are taken from. Its text is the words taken, a second pass on a new line after the first; a pass that
    takes the whole document keeps its text as it is, another joins the words with spaces. n_chars, where it is a
    column, is counted anew. Documents that nothing is taken from, empty ones included, have no row."""
    pieces, _ = taken_pieces(documents.select("doc_id", "source", "text"), block)
    each = pieces.filter("got > 0").groupBy("skey", "start", "doc_id", "size", "first").agg(F.sort_array(F.collect_list("got"), asc=False).alias("gots"))  # one or two
    row = each.groupBy("skey", "start", "doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("first", "gots"))).alias("_pieces"))
    same = ["doc_id", "skey", "size"]
    row = row.withColumn("copy", F.row_number().over(W.partitionBy(*same).orderBy("start")))
    every = pieces.select("skey", "start", "doc_id", "size").distinct().withColumn("copy", F.row_number().over(W.partitionBy(*same).orderBy("start")))
    row = row.drop("copy").join(every.drop("doc_id", "size"), ["skey", "start"])
    keyed = documents.select(F.struct(*documents.columns).alias("_row")).withColumn("_skey", source_key(F.col("_row.source"))).withColumn("_size", word_count(F.col("_row.text")))
    keyed = keyed.withColumn("_copy", F.row_number().over(W.partitionBy("_row.doc_id", "_skey", "_size").orderBy(F.xxhash64("_row.text"))))
    match = keyed["_row.doc_id"].eqNullSafe(row["doc_id"]) & (keyed["_skey"] == row["skey"]) & (keyed["_size"] == row["size"]) & (keyed["_copy"] == row["copy"])
    joined = keyed.join(row.select("doc_id", "skey", "size", "copy", "_pieces"), match).select("_row", "_size", "_pieces")

    def one_pass(u: int) -> Column:
        words = F.regexp_extract_all(F.col("_row.text"), F.lit(f"({WORD})"))
        used = F.filter("_pieces", lambda p: F.size(p["gots"]) >= u)
        total = F.aggregate(used, F.lit(0).cast("bigint"), lambda n, p: n + F.element_at(p["gots"], u))
        part = F.flatten(F.transform(used, lambda p: F.slice(words, (p["first"] + 1).cast("int"), F.element_at(p["gots"], u).cast("int"))))
        return F.when(total == F.col("_size"), F.col("_row.text")).when(total > 0, F.array_join(part, " "))

    text = F.concat_ws("\n", one_pass(1), one_pass(2))
    built = joined.withColumn("_text", text)
    kept = {c: F.col("_row")[c] for c in documents.columns} | {"text": F.col("_text")}
    if "n_chars" in kept:
        kept["n_chars"] = F.length("_text").cast(dict(documents.dtypes)["n_chars"])
    return built.select(*[v.alias(c) for c, v in kept.items()])
