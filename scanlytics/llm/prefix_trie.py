"""The trie of all prefixes of conversations, by recursion over halved sequences (van Emde Boas).

A table of all sequences is cut at half its depth: the upper parts stay in their group, the lower parts
go to the group named by the prefix that was cut off; upper and lower parts are then sequences of half the depth in
one table, and are cut again, all at the same time. After as many rounds as the depth has binary digits each part is one turn, and every
prefix has a name. A cut prefix is named exactly, by the least conversation with the same group and the same turns;
the turns of an upper part go by one number, as aligned blocks of turns were named before from pairs of blocks of half the size.

Totals of subtrees go the same way back: the totals of the forests at a cut are handed to the nodes of the upper
trie that lead there, for small parts first. So depth costs rounds by its logarithm, and no group of
prefixes, children or conversations is held in one task: names and totals are summed before they are shuffled,
and names are handed back by salted keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, shuffle_partitions, written

SALTS = 32  # tasks that take back the names of one frequent key
_WORDS = r"[^\x20\x09-\x0D]+"


def _named(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``rows`` with ``name``: the least ``conv`` of those with the same ``keys``. Keys of one conversation are not sent back."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int"))
    parts = rows.groupBy(*keys, "salt").agg(F.min("conv").alias("least"), F.count("*").alias("n"))
    whole = parts.groupBy(*keys).agg(F.min("least").alias("name"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    back = whole.select(*keys, "name", F.explode("salts").alias("salt"))
    out = rows.join(back, [*keys, "salt"], "left").withColumn("name", F.coalesce("name", "conv"))
    return written(out.drop("salt"), label)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of turns in the part of their conversation that this task has; the rows come sorted."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        place = []
        for conv in batch.column("conv").to_pylist():
            at = at + 1 if conv == last else 0
            last = conv
            place.append(at)
        columns = [pa.array([part] * len(place), pa.int32()), pa.array(place, pa.int64()), *batch.columns]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "at", *batch.schema.names])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, which come together and in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for name, depth, text in zip(*(batch.column(c).to_pylist() for c in ("name", "pos", "text")), strict=True):
            if node != (name, depth):
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (name, depth), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("name", "pos", "ends_sha256"), map(list, zip(*out)))))
    if node:
        yield pa.RecordBatch.from_pydict({"name": [node[0]], "pos": [node[1]], "ends_sha256": [state.hexdigest()]})


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, at, digest, words``: all turns, numbered from 0 in their conversation by turn (null first), role and text.

    Conversations are sorted by ranges, so that one with very many turns is numbered by several tasks. Rows without a conversation go.
    """
    own = [F.col(f"`{c}`") for c in (id_col, turn_col, role_col, text_col)]
    rows = conversations.select(own[0].cast("long").alias("conv"), own[1].cast("long").alias("turn"), F.coalesce(own[2], F.lit("")).alias("role"), F.coalesce(own[3], F.lit("")).alias("text")).where("conv is not null")
    n = shuffle_partitions(conversations.sparkSession)
    rows = rows.repartitionByRange(n, "conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.select("conv", digest.alias("digest"), F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("words"))
    table = written(rows.mapInArrow(_numbered, "part int, at long, conv long, digest binary, words long"), "turns")
    sizes = table.groupBy("conv", "part").agg(F.count("*").alias("n"))
    later = sizes.alias("a").join(sizes.alias("b"), "conv").where("a.part > b.part").groupBy("conv", F.col("a.part").alias("part")).agg(F.sum("b.n").alias("before"))
    # a part can go on with one conversation at most, so there are no more rows than parts
    return table.join(F.broadcast(later), ["conv", "part"], "left").select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "digest", "words")


def with_shared_openings(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that up to ``every`` of them open alike: ``conv, len``, and ``conv, at, digest, words``.

    The first ``h`` turns of ``conv - conv % every`` come before the turns after the first ``h`` of ``conv``; ``h`` is a checksum of ``conv`` modulo ``most``.
    """
    heads = turns.where((F.col("conv") % every == 0) & (F.col("at") < most)).groupBy(F.col("conv").alias("lead")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "words"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"lead": F.col("conv") - F.col("conv") % every, "h": (F.crc32(F.col("conv").cast("string")) % most).cast("int")})
    convs = convs.join(heads, "lead", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("cast(array() as array<struct<at:bigint,digest:binary,words:bigint>>)")))
    convs = written(convs.withColumn("len", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    opened = convs.select("conv", F.inline("head"))
    moved = convs.where("size(head) != h").select("conv", (F.size("head") - F.col("h")).alias("move"))
    h = F.crc32(F.col("conv").cast("string")) % most
    own = turns.where(F.col("at") >= h).join(moved, "conv", "left").select("conv", (F.col("at") + F.coalesce("move", F.lit(0))).alias("at"), "digest", "words")
    return convs.select("conv", "len"), opened.unionByName(own)


def prefix_names(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``conv, len, pos, name`` for every prefix of ``pos`` turns of every conversation, the named turns, and the number of rounds."""
    depth, root = convs.agg(F.max("len"), F.min("conv")).first()
    rounds = int(depth or 0).bit_length()
    blocks = [_named(turns, ["at", "digest"], "turn-names").drop("digest")]
    half = lambda of, rest: F.max(F.when(F.col("at") % 2 == rest, F.col(of)))
    for _ in range(1, rounds):
        pairs = blocks[-1].groupBy("conv", F.shiftright("at", 1).alias("at")).agg(half("name", 0).alias("first"), half("name", 1).alias("second")).where("first is not null and second is not null")
        blocks.append(_named(pairs, ["at", "first", "second"], "block-names").drop("first", "second"))
    names = written(convs.select("conv", "len", F.lit(0).cast("long").alias("pos"), F.lit(root).cast("long").alias("name")), "prefixes")
    for level in reversed(range(rounds)):
        step = 1 << level
        upper = names.select("conv", "len", "pos", F.col("name").alias("held")).withColumn("at", F.shiftright("pos", level))
        cut = upper.join(blocks[level].select("conv", "at", F.col("name").alias("block")), ["conv", "at"]).select("conv", "len", (F.col("pos") + step).alias("pos"), "held", "block")
        names = names.unionByName(_named(cut, ["pos", "held", "block"], "prefixes").select("conv", "len", "pos", "name"))
    return names, blocks[0], rounds


def _subtree_sums(nodes: DataFrame, names: DataFrame, rounds: int) -> DataFrame:
    """``name, pos`` of every node and the sums of ``leaves`` and ``saved`` over its subtree; for each but the root as parts to be added up."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    parts = nodes.where("pos > 0").select("name", "pos", "parent", "leaves", "saved")
    made = []
    for level in range(rounds):
        step = 1 << level
        tops = parts.where((F.col("pos") - 1) % (2 * step) == step)
        forests = tops.groupBy(F.col("parent").alias("conv"), (F.col("pos") - 1).alias("cut")).agg(*sums).where("leaves != 0 or saved != 0")
        leads = names.where((F.col("pos") > 0) & (F.shiftright(F.col("pos") - 1, level) % 2 == 0)).withColumn("cut", F.shiftleft(F.shiftright(F.col("pos") - 1, level) + 1, level))
        given = leads.join(forests, ["conv", "cut"]).groupBy("name", "pos", "parent").agg(*sums)
        made.append(written(given, "grafts"))
        parts = parts.unionByName(made[-1])
    root = parts.where("pos = 1").groupBy(F.col("parent").alias("name")).agg(*sums).select("name", F.lit(0).cast("long").alias("pos"), "leaves", "saved")
    root = root.unionByName(nodes.where("pos = 0").select("name", "pos", "leaves", "saved"))
    return parts.drop("parent").unionByName(root).groupBy("name", "pos").agg(*sums)


def _end_digests(names: DataFrame) -> DataFrame:
    """Digest of the sorted ids that end at each node. Ids are joined by ranges of ids, so no list has more than a range holds."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    ends = names.where("pos = len").groupBy("name", "pos", F.shiftright("conv", 8).alias("chunk")).agg(text.alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda s: s["text"]), ",")
    chunks = ends.groupBy("name", "pos", F.shiftright("chunk", 8).alias("wide")).agg(joined.alias("text"))
    return chunks.repartition("name", "pos").sortWithinPartitions("name", "pos", "wide").select("name", "pos", "text").mapInArrow(_digests, "name long, pos long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations: ``conv, len`` (turnless ones too) and their turns ``conv, at, digest, words`` with ``at`` from 0.

    One row per node: ``conv_id`` (the least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (of the subtree: members beyond the first times the words of the node's last turn) and ``ends_sha256``
    (of the ids that end here). Turns with equal ``digest`` are the same turn. An empty table has no root.
    """
    names, first, rounds = prefix_names(convs, turns)
    above = names.select("conv", (F.col("pos") + 1).alias("pos"), F.col("name").alias("parent"))
    names = written(names.join(above, ["conv", "pos"], "left"), "named")
    words = first.select(F.col("conv").alias("name"), (F.col("at") + 1).alias("pos"), "words")
    nodes = names.groupBy("name", "pos").agg(F.count("*").alias("n_convs"), F.min("parent").alias("parent"))
    children = nodes.where("pos > 0").groupBy(F.col("parent").alias("name"), (F.col("pos") - 1).alias("pos")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(words, ["name", "pos"], "left").join(children, ["name", "pos"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))})
    nodes = written(nodes, "nodes")
    sums = _subtree_sums(nodes, names, rounds).select("name", "pos", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    out = nodes.join(sums, ["name", "pos"]).join(_end_digests(names), ["name", "pos"], "left")
    return out.select(F.col("name").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """``prefix_trie`` of a table of turns, rebuilt with shared openings unless ``rebuild`` is false.

    Turns are ordered by turn (null first), then role and text; a null role or text is an empty one; repeated rows are turns of their
    own; rows without a conversation take no part; other columns do not matter. An empty table gives an empty table.
    """
    table = ordered_turns(conversations, id_col, turn_col, role_col, text_col)
    if rebuild:
        convs, turns = with_shared_openings(table)
        turns = written(turns, "openings")
    else:
        convs, turns = table.groupBy("conv").agg(F.count("*").alias("len")), table
    out = written(prefix_trie(convs, turns), "trie")
    if rebuild:
        discard(turns)
    return out
