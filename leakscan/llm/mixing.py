"""Mixing sources to target weights with a low-discrepancy schedule.

``targets`` shares the corpus's words over the sources by weight; a source stops at
``max_epochs`` times its own size and the excess goes to the others by weight until none is
above (water level found from running sums over the sources in order of size by weight).
``blocks`` shuffles the documents of a source by a hash, lays their words end to end and
cuts them into equal blocks of about ``block_words`` words. ``schedule`` maps golden-ratio
points through the cumulative slot shares of the sources: slot i goes to the source whose
share covers the point; slots are ranked per source; rank r takes block r mod n. Ranks that
the points leave open at the end follow as a tail, ranks beyond a source's quota are
passed over, so each source gets its quota exactly. ``mix`` joins blocks and schedule and
sums what each document gives.

No text is shuffled. A source may hold any share of the rows: its documents are ranked
within hash buckets first and across buckets by sums. Tables of one row per source are small
(one row per distinct source) and are joined without hints; slots find their source by an
equality join on cells of the unit interval.

Defined results: null texts have size 0; documents of size 0 are never taken; null sources
form one source, last in order; an empty table gives an empty result; repeated rows are
documents of their own with equal results; ties of the hash are broken by doc_id, a hash of the
text and size. Rows of one doc_id with different texts lie in different buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, put


@dataclass(frozen=True)
class Mix:
    weights: tuple = (1, 2, 3)     # of the sources in order, repeating
    share: float = 1.0             # of all words
    max_epochs: int = 3
    block_words: int = 256
    cells: int = 4096
    chunk: int = 1 << 16           # slots ranked together
    bucket_rows: int = 20_000      # documents ranked together, about
    seed: int = 9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: words of the whole text; mark: a hash of the text, by which rows of one doc_id differ."""
    return docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """source, source_no, source_size, target, n_blocks, quota; one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # UTF-8 byte order is code point order; windows here see one row per source
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(mix.weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in mix.weights]), (F.pmod(F.col("source_no"), F.lit(n)) + 1).cast("int"))
    per = per.withColumn("source_no", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * mix.max_epochs)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"total": F.sum("source_size").over(everything) * mix.share, "all_w": F.sum("w").over(everything),
                           "used": F.coalesce(F.sum("cap").over(fill), F.lit(0)), "gone": F.coalesce(F.sum("w").over(fill), F.lit(0.0))})
    # with the smaller sources full, this would be the level; the first source below its cap sets it
    per = per.withColumn("level", (F.col("total") - F.col("used")) / (F.col("all_w") - F.col("gone")))
    per = per.withColumn("water", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything))
    per = per.withColumn("target", F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("water") * F.col("w"))))
    per = per.withColumn("n_blocks", F.ceil(F.col("source_size") / mix.block_words))
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("bigint"),
                                                     F.col("n_blocks") * mix.max_epochs)).otherwise(F.lit(0).cast("bigint"))
    return per.withColumn("quota", quota).select("source", "source_no", "source_size", "target", "n_blocks", "quota")


def schedule(per: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """slot, source_no, rank, epoch, block: which block each slot of the mix takes.
    The slots of the tail (``slot`` null) come after all others."""
    spark = per.sparkSession
    total = per.agg(F.sum("quota")).first()[0] or 0      # one number
    shares = per.where("quota > 0").withColumn("hi", F.sum("quota").over(Window.orderBy("source_no")))
    shares = shares.withColumn("lo", F.col("hi") - F.col("quota")).select("source_no", "quota", "n_blocks", (F.col("lo") / F.lit(max(total, 1))).alias("lo"), (F.col("hi") / F.lit(max(total, 1))).alias("hi"))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * mix.cells), F.least(F.floor(F.col("hi") * mix.cells), F.lit(mix.cells - 1)))))
    # frac(i * golden ratio) without loss: high and low parts of i by 2^20
    step = 0.6180339887498949
    high = (step * (1 << 20)) % 1.0
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn(
        "p", F.expr(f"pmod(pmod(floor(slot / 1048576) * {high!r}D, 1D) + pmod(slot, 1048576) * {step!r}D, 1D)"))
    slots = slots.withColumn("cell", F.floor(F.col("p") * mix.cells))
    hits = slots.join(cells, "cell").where("p >= lo AND (p < hi OR hi >= 1D)").withColumn("chunk", F.floor(F.col("slot") / mix.chunk))
    hits = hits.select("slot", "source_no", "chunk", "quota", "n_blocks")
    before = hits.groupBy("source_no", "chunk").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("n"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = hits.join(before.drop("n"), ["source_no", "chunk"]).withColumn("rank", rank).where("rank < quota")
    got = before.groupBy("source_no").agg(F.sum("n").alias("got"))
    tail = shares.join(got, "source_no", "left").where("coalesce(got, 0) < quota").select(
        F.lit(None).cast("bigint").alias("slot"), "source_no", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("quota") - 1)).alias("rank"), "n_blocks")
    out = ranked.select("slot", "source_no", "rank", "n_blocks").unionByName(tail)
    return out.select("slot", "source_no", "rank", F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"), F.pmod("rank", "n_blocks").alias("block"))


def blocks(sized: DataFrame, per: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, first_word (its place among its source's shuffled words) and the columns of ``per``."""
    n = max(1, -(-(sized.count()) // mix.bucket_rows))   # one number
    d = sized.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumn("h", F.xxhash64(F.lit(mix.seed), "doc_id", "mark"))
    # buckets are ranges of the hash, so that (bucket, hash) is the hash's order
    d = d.withColumn("bucket", F.floor((F.col("h") / 18446744073709551616.0 + 0.5) * n))
    sums = d.groupBy("source_no", "bucket").agg(F.sum("size").alias("n")).withColumn(
        "base", F.sum("n").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("n")).drop("n")
    within = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(sums, ["source_no", "bucket"]).withColumn("first_word", F.col("base") + F.sum("size").over(within) - F.col("size")).drop("bucket", "base")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies (times that the block
    with the document's first word is taken) for every document."""
    sized = put(sizes(docs), "sizes")
    per = put(targets(sized, mix), "targets")
    times = schedule(per, mix).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # a row of its own for each (document, block); block k covers words floor(k * size / n) and on
    laid = put(blocks(sized, per, mix).drop("h"), "laid")
    edge = "floor(block * (source_size / n_blocks))"
    at = "least(n_blocks - 1, floor({} * (n_blocks / source_size)))"
    cover = laid.where("size > 0").withColumn("block", F.expr(
        f"explode(sequence(greatest(0, {at.format('first_word')} - 1), least(n_blocks - 1, {at.format('(first_word + size - 1)')} + 1)))"))
    cover = cover.withColumns({"lo": F.expr(edge), "hi": F.expr("CASE WHEN block + 1 = n_blocks THEN source_size ELSE floor((block + 1) * (source_size / n_blocks)) END")})
    cover = cover.withColumn("part", F.expr("least(hi, first_word + size) - greatest(lo, first_word)")).where("part > 0")
    cover = cover.withColumn("holds_first", F.expr("first_word >= lo AND first_word < hi"))
    taken = cover.join(times, ["source_no", "block"], "left").groupBy("source_no", "first_word").agg(
        F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"),
        F.max(F.when(F.col("holds_first"), F.coalesce("times", F.lit(0)))).alias("copies"))
    out = laid.where("size > 0").join(taken, ["source_no", "first_word"], "left").unionByName(
        laid.where("size = 0").withColumns({"taken": F.lit(0).cast("bigint"), "copies": F.lit(0).cast("bigint")}))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"))


def repeat_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as rows: each document as often as the block with its first word is taken.
    Documents without words are never taken. Rows that share doc_id and source share the mean
    of their copies, rounded up, so that repeated rows can't multiply."""
    times = mix_documents(docs, mix).groupBy("doc_id", F.col("source").alias("m_source")).agg(
        F.ceil(F.avg("copies")).alias("copies__")).where("copies__ > 0").withColumnRenamed("doc_id", "m_id")
    d = docs.join(times, docs.doc_id.eqNullSafe(times.m_id) & docs.source.eqNullSafe(times.m_source))
    d = d.withColumn("copy__", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies__")))
    return d.where(F.regexp_count("text", F.lit(WORD)) > 0).select(*docs.columns)
