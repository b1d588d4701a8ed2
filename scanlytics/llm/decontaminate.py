"""Benchmark passages in training documents, by winnowing.

Every run of ``span`` words keeps its least k-gram hash as a fingerprint, with
k about half the span; equal runs keep equal fingerprints, so each shared run
of that length is met in a join on fingerprints, wherever it stands. Consecutive
runs that keep the same one give it once. A hit is then extended to all the runs
of its fingerprint, and each is compared word by word. Items shorter than a run
are one run of their own length; documents are cut and hashed once for all lengths.

Built-in functions only. The fingerprints of the benchmark are broadcast if
they are counted to be few, and joined by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chain, text_key, written

SEND_FINGERPRINTS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # in text whose A-Z are lower-cased
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def folded_words(text: Column) -> Column:
    """The words of a text whose A-Z are lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def word_count(text: Column) -> Column:
    """How many words ``folded_words`` gives. The text is split, as matching its words one by one takes several times as long."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), "")).cast("long")


def _join_runs(rows: DataFrame, name: str, long: str, short: str, shift: int, length: Column, step) -> DataFrame:
    """Column ``name``: ``step`` of ``long`` and of ``short`` from ``shift`` places on."""
    ahead = F.slice(F.col(short), F.lit(shift + 1), F.greatest(F.size(short) - shift, F.lit(0)))
    return rows.withColumn(name, F.slice(F.zip_with(F.col(long), ahead, step), F.lit(1), F.greatest(length, F.lit(0))))


def _over(rows: DataFrame, source: str, width: int, prefix: str, step) -> DataFrame:
    """Column ``prefix`` + width: ``step`` over every ``width`` consecutive entries of ``source``, by doubling."""
    have, steps, size = {1: source}, 1, F.size(source)
    while steps * 2 <= width:
        rows = rows.withColumn(f"{prefix}{steps * 2}", chain(F.col(have[steps]), steps, step))
        steps *= 2
        have[steps] = f"{prefix}{steps}"
    done, rest = steps, width - steps
    while rest:
        part = max(p for p in have if p <= rest)
        rows = _join_runs(rows, f"{prefix}_{done + part}", have.get(done, f"{prefix}_{done}"), have[part], done, size - (done + part - 1), step)
        done, rest = done + part, rest - part
    return rows.withColumn(f"{prefix}{width}", F.col(have[width] if width in have else f"{prefix}_{width}")) if width not in have or have[width] != f"{prefix}{width}" else rows


def _prints(rows: DataFrame, span: int) -> DataFrame:
    """Adds ``prints<span>``: for each run of ``span`` entries of ``__h`` its fingerprint."""
    kept = rows.columns
    k = span // 2 if span > 3 else span
    rows = _over(rows, "__h", k, "__g", lambda a, b: F.xxhash64(a, b)) if k > 1 else rows.withColumn("__g1", F.col("__h"))
    rows = _over(rows.select(*kept, F.col(f"__g{k}").alias("__g")), "__g", span - k + 1, "__m", lambda a, b: F.least(a, b)) if span > k else rows.withColumn("__m1", F.col(f"__g{k}"))
    return rows.select(*kept, F.col(f"__m{span - k + 1}").alias(f"prints{span}"))


def _winnowed(prints: str, span: int) -> Column:
    """``span, pos, n, print`` of each stretch of ``n`` runs from ``pos`` that keep one fingerprint."""
    all_ = F.transform(prints, lambda x, i: F.struct(i.alias("pos"), x.alias("print")))
    first = F.filter(all_, lambda x: (x["pos"] == 0) | (F.get(F.col(prints), x["pos"] - 1) != x["print"]))
    ends = F.concat(F.transform(F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))), lambda x: x["pos"]), F.array(F.size(prints)))
    return F.zip_with(first, ends, lambda x, e: F.when(x.isNotNull(), F.struct(F.lit(span).alias("span"), x["pos"].alias("pos"), (e - x["pos"]).alias("n"), x["print"].alias("print"))))


def fingerprints(rows: DataFrame, spans: list[int]) -> DataFrame:
    """One row for each fingerprint of ``words`` that winnowing keeps, for every length of ``spans``: the other columns and ``span, pos, n, print``."""
    kept = rows.columns
    rows = rows.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))
    for span in spans:
        rows = _prints(rows, span)
    # posexplode_outer and explode_outer: of inner ones Catalyst makes a filter on the array and copies its whole expression
    rows = rows.select(*kept, F.explode_outer(F.concat(*[_winnowed(f"prints{x}", x) for x in spans])).alias("p"))
    return rows.select(*kept, "p.span", "p.pos", "p.n", "p.print").where("print is not null")


def _same_row() -> Column:
    return F.col("doc").eqNullSafe(F.col("hd")) & F.col("key").eqNullSafe(F.col("hk"))


def _hits(docs: DataFrame, items: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Occurrences ``doc, key, pos, span, run`` in ``docs`` and the ``run, item`` table; both from rows with ``words``."""
    spans = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(span))).distinct().collect())  # ``span`` lengths at most
    run = F.array_join(F.slice("words", F.col("at") + 1, F.col("span")), " ").alias("run")
    each = F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("at")
    runs = fingerprints(items, spans).where(F.col("span") == F.least(F.size("words"), F.lit(span)))
    runs = written(runs.select("item", "words", "span", "print", each).select("item", "span", "print", run).distinct(), "runs")
    prints = runs.select("span", "print").distinct()
    places = fingerprints(docs, spans)
    if prints.count() <= SEND_FINGERPRINTS:
        near = places.join(F.broadcast(prints), ["span", "print"], "left_semi")
    else:
        at = places.select("doc", "key", "span", "pos", "n", "print").join(prints, ["span", "print"], "left_semi").groupBy("doc", "key").agg(F.collect_set(F.struct("span", "pos", "n", "print")).alias("at"))
        at = at.select(F.col("doc").alias("hd"), F.col("key").alias("hk"), "at")
        near = docs.join(at, _same_row()).select("doc", "key", "words", F.explode("at").alias("p")).select("doc", "key", "words", "p.*")
    near = near.select("doc", "key", "words", "span", "print", each).select("doc", "key", F.col("at").alias("pos"), "span", "print", run)
    hits = near.join(runs.select("span", "print", "run").distinct(), ["span", "print", "run"], "left_semi").select("doc", "key", "pos", "span", "run")
    return hits, runs.select("run", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = 10) -> DataFrame:
    """Per document: ``doc, key, n_words, n_hit, n_items, items, contaminated``.

    A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A run is ``span``
    consecutive words of an item; an item of fewer words, but not none, is one run. Words inside
    any occurrence of a run are hit. ``items`` are the sorted ids (as strings) of items with
    occurring runs.

    Null texts have no words; items without a word or an id take no part; equal rows, and rows of
    one id with equal texts, get equal results; other columns are ignored. With an empty benchmark
    nothing is hit; no documents give no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = base.where("text is not null").select("doc", "key", folded_words(F.col("text")).alias("words"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), folded_words(F.col(item_text)).alias("words")).where("item is not null and size(words) > 0")
    items = written(items, "items")
    empty = items.isEmpty()
    found, named = _hits(rows, items, span) if not empty else (rows.select("doc", "key", F.lit(0).alias("pos"), F.lit(0).alias("span"), F.lit("").alias("run")).limit(0), items.select(F.lit("").alias("run"), "item"))
    found = written(found, "hits")
    covered = F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + F.col("span") - 1)))
    hit = found.groupBy("doc", "key").agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    held = found.select("doc", "key", "run").distinct().join(named, "run").groupBy("doc", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = hit.select(F.col("doc").alias("hd"), F.col("key").alias("hk"), "n_hit")
    both = held.join(hit, _same_row()).select("hd", "hk", "n_hit", "items")
    counted = base.select("doc", "key", word_count(F.col("text")).alias("n_words"))
    out = counted.join(both, _same_row(), "left")
    none = F.expr("cast(array() as array<string>)")
    items_of = F.coalesce("items", none)
    return out.select("doc", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
