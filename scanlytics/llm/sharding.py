"""Uniform random sharding with exact shard sizes, by a hypergeometric communication matrix.

Documents lie in blocks (by a hash, so that the result does not depend on the
files). How many documents of each block go to each shard is drawn exactly: the
matrix of a uniform shuffle has hypergeometric entries under its row and column
sums. It is drawn in a tree: the shards' places are split between two halves of
the blocks, then within each half, down to single blocks. Each block is then
permuted locally and dealt to the shards by its row of the matrix, and each
shard is permuted again. Block and shard counts are parameters, so the matrix
does not grow with the data. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

RANK_BUCKETS = 256  # at least; more where buckets would hold over BLOCK_ROWS rows
BLOCK_ROWS = 1 << 18


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def _span(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not at each place where it stands."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(u: Column, total: Column, good: Column, draws: Column) -> Column:
    """The number of good ones among ``draws`` of ``total``, by inversion of ``u`` in [0, 1).

    Weights are relative to the mode's and run outward from it for 9 standard deviations and 10
    more: what lies beyond is below double precision.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"), draws.cast("double").alias("d"), F.greatest(zero, draws - (total - good)).alias("low"), F.least(draws, good).alias("high"))

    def centre(v: Column) -> Column:
        n, k, d, n1 = v["n"], v["k"], v["d"], F.greatest(v["n"], F.lit(1.0))
        mode = F.greatest(v["low"], F.least(v["high"], F.floor((d + 1) * (k + 1) / (n + 2)).cast("long")))
        reach = F.ceil(9 * F.sqrt(d * k / n1 * (n1 - k) / n1 * (n1 - d) / F.greatest(n1 - 1, F.lit(1.0)))).cast("long") + 10
        return F.struct(mode.alias("mode"), reach.alias("reach"))

    def pick(v: Column, c: Column) -> Column:
        n, k, d, mode = v["n"], v["k"], v["d"], c["mode"]
        up = _span(mode + 1, F.least(v["high"], mode + c["reach"]))
        down = F.reverse(_span(F.greatest(v["low"], mode - c["reach"]), mode - 1))
        rise = lambda w, x: w * (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))
        fall = lambda w, x: w * (x + 1) * (n - k - d + x + 1) / ((k - x) * (d - x))

        def weights(places: Column, step) -> Column:
            """Value, weight and running sum of weights, outward."""
            first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            return F.aggregate(places, first, lambda a, x: _let(step(a["w"], x), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))), lambda a: a["s"])

        def search(places: Column, step, goal: Column) -> Column:
            first = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(-1).cast("long").alias("at"))

            def walk(a: Column, x: Column) -> Column:
                return _let(step(a["w"], x), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"), F.when((a["at"] < 0) & (a["s"] + w > goal), x).otherwise(a["at"]).alias("at")))

            return F.aggregate(places, first, walk, lambda a: a["at"])

        def choose(p: Column, sums: Column, goal: Column) -> Column:
            end = F.coalesce(F.try_element_at(p["down"], F.lit(-1)), F.try_element_at(p["up"], F.lit(-1)), mode)
            # beyond the mode's own weight: first upward, then downward
            above = F.when(goal < sums["up"], search(p["up"], rise, goal)).otherwise(search(p["down"], fall, goal - sums["up"]))
            return F.when(goal < 0, mode).otherwise(_let(above, lambda x: F.when(x >= 0, x).otherwise(end)))

        places = F.struct(up.alias("up"), down.alias("down"))
        return _let(places, lambda p: _let(F.struct(weights(p["up"], rise).alias("up"), weights(p["down"], fall).alias("down")), lambda t: _let(u * (1 + t["up"] + t["down"]) - 1, lambda goal: choose(p, t, goal))))

    return _let(start, lambda v: _let(centre(v), lambda c: pick(v, c)))


def _draw(places: Column, amount: Column, seed: Column) -> Column:
    """Multivariate: how many of ``amount`` random places fall to each entry of ``places``."""
    start = F.struct(F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), amount.alias("left"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        got = hypergeometric(_uniform(seed, F.size(a["out"])), a["total"], x, a["left"])
        return _let(got, lambda g: F.struct((a["total"] - x).alias("total"), (a["left"] - g).alias("left"), F.concat(a["out"], F.array(g)).alias("out")))

    return F.aggregate(places, start, step, lambda a: a["out"])


def communication_matrix(counts: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """``block, upto``: running sums over the shards of a block's row of the matrix. ``counts`` is ``block, n``; ``blocks`` a power of two."""
    spark = counts.sparkSession
    every = spark.range(blocks).select(F.col("id").cast("int").alias("block")).join(counts, "block", "left")
    root = every.agg(F.sort_array(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("rows")).select(F.lit(0).alias("block"), F.col("rows.n").alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    tree = root.withColumn("total", total).select("block", "n", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.expr("1L") * F.floor(F.col("total") / shards).cast("long") + F.when(s < F.pmod(F.col("total"), F.lit(shards)), 1).otherwise(0)).alias("places"))
    size, level = blocks, 0
    while size > 1:
        size //= 2
        level += 1
        left = F.slice("n", 1, size)
        tree = tree.withColumn("left", F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x))
        tree = tree.withColumn("drawn", _draw(F.col("places"), F.col("left"), F.xxhash64(F.lit(seed), F.lit(level), "block")))
        halves = F.array(
            F.struct(F.col("block").alias("block"), left.alias("n"), F.col("drawn").alias("places")),
            F.struct((F.col("block") + size).alias("block"), F.slice("n", size + 1, size).alias("n"), F.zip_with("places", "drawn", lambda p, d: p - d).alias("places")),
        )
        tree = tree.select(F.explode(halves).alias("h")).select("h.*")
        if level == 4:
            tree = written(tree, "matrix").repartition(16, "block")
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice(F.col("places"), F.lit(1), s), F.lit(0).cast("long"), lambda a, x: a + x))
    return tree.select("block", upto.alias("upto"))


def ranked(rows: DataFrame, group: str, order: list[Column], chance: Column, name: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """A rank from 0 within ``group`` in the order of random buckets and, inside them, of ``order``; no task holds a whole group."""
    rows = rows.withColumn("__bucket", F.pmod(chance, F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    counts = counts.select(group, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__bucket").orderBy(*order)
    return rows.join(counts, [group, "__bucket"]).withColumn(name, F.col("__before") + F.row_number().over(inside) - 1).drop("__bucket", "__before")


def shuffle_into_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 20, blocks: int | None = None) -> DataFrame:
    """Puts every document into one of ``shards`` shards: ``doc, size, text_crc32, shard, slot``.

    Shard sizes in documents differ by one at most; which documents go where, and their order
    within the shard (``slot``, from 0 without gaps), is a uniform random permutation fixed by
    ``seed``. ``size`` is the UTF-8 bytes of the text and 8 more, ``text_crc32`` its unsigned
    CRC-32; a null text counts as empty. A null id is an id like others; equal rows get places
    of their own; other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # repeated rows are told apart by a number, so that they too are spread
    rows = rows.groupBy("doc", "size", "text_crc32").agg(F.count("*").alias("n")).select("doc", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    of = [F.col("doc"), F.col("size"), F.col("text_crc32"), F.col("copy")]
    rows = written(rows, "sizes")
    count = rows.count()
    blocks = blocks or 1 << min(15, max(8, (count // BLOCK_ROWS).bit_length()))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(blocks)).cast("int"))
    matrix = written(communication_matrix(rows.groupBy("block").agg(F.count("*").alias("n")), shards, blocks, seed), "matrix")
    dealt = ranked(rows, "block", [F.xxhash64(F.lit(seed + 1), *of), *of], F.xxhash64(F.lit(seed + 2), *of), "place", max(RANK_BUCKETS, count // blocks // BLOCK_ROWS))
    # one row for each block: 2^15 at most
    dealt = dealt.join(F.broadcast(matrix), "block").withColumn("shard", F.size(F.filter("upto", lambda c: c <= F.col("place"))))
    dealt = written(dealt.select("doc", "size", "text_crc32", "copy", "shard"), "dealt")
    out = ranked(dealt, "shard", [F.xxhash64(F.lit(seed + 3), *of), *of], F.xxhash64(F.lit(seed + 4), *of), "slot", max(RANK_BUCKETS, count // shards // BLOCK_ROWS))
    return out.drop("copy")
