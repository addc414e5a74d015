"""Prefix trie of conversations by van Emde Boas recursion.

A sequence of turns is cut at half its depth. The cut prefix gets a name, which stands for it in the lower half; the
upper trie and the lower forests are cut in the same way, all at once, until single turns are left. A name is the first
half of a SHA-256 over the names that it joins, so equal prefixes get equal names wherever they are computed. Totals go
the other way: what hangs below a cut is grafted onto the rows above it, level by level.

The lower levels run inside tiles of 2**TILE_BITS turns, as window functions over one shuffle and one sort; the ends of
tiles are sequences again, 2**TILE_BITS times shorter, for the next recursion. So a conversation of any length spreads
over tasks, and the number of jobs grows with the logarithm of the longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.scratch import stored

TILE_BITS = 6
#: Characters of ids in one piece of a list of ids.
PIECE = 1 << 12
NO_ENDS = hashlib.sha256(b"").hexdigest()


def digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def ordered_turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, name, size) of every turn: its place in the conversation from 0, a digest of role and text, and the
    text's bytes in UTF-8.

    Turns are ordered by turn, nulls first, then role, then text; a null role or text is empty. Rows without a
    conversation id take no part. Places are counted inside range partitions and shifted by the turns of the same
    conversation in earlier ones, so a conversation that holds most rows is no single task's work.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = table.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "text", "row"]
    name = digest(F.octet_length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("conv", name.alias("name"), F.octet_length("text").cast("long").alias("size"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    ranged = stored(ranged, "turns")
    inside = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv", "part").orderBy("row")).cast("long") - 1)
    sizes = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    return inside.join(shifts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("at"), "name", "size")


def spliced(turns: DataFrame, step: int = 5, heads: int = 9) -> DataFrame:
    """(conv, at, name, size, length): every conversation c begins with the first h turns of conversation c - c % step, or
    as many as that has, and goes on with its own turns after its first h, where h is CRC-32 of c in decimals modulo
    heads. at counts from 1; a row with at 0 and no name stands for the conversation itself."""
    turns = stored(turns, "ordered")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).select("conv", "own", (F.col("conv") - F.col("conv") % step).alias("base"), h)
    first = turns.where(F.col("at") < heads - 1).select(F.col("conv").alias("base"), "at", "name", "size")
    convs = convs.join(first.groupBy("base").agg(F.count(F.lit(1)).alias("given")), "base", "left")
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    convs = stored(convs.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "convs")
    head = convs.join(first, "base").where("at < h").select("conv", (F.col("at") + 1).alias("at"), "name", "size", "length")
    rest = turns.join(convs, "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("at"), "name", "size", "length")
    top = convs.select("conv", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("name"), F.lit(0).cast("long").alias("size"), "length")
    return head.unionByName(rest).unionByName(top)


def tile(at: str | Column) -> Column:
    return F.shiftright(at, TILE_BITS)


def place(at: str | Column) -> Column:
    """Of a row in its tile."""
    return F.col("at").bitwiseAND((1 << TILE_BITS) - 1)


def named(rows: DataFrame) -> DataFrame:
    """Adds prefix, the name of all from 0 to the row, and parent, the same without the row (null at 0)."""
    rows = rows.withColumn("tile", tile("at")).withColumn("prefix", F.col("name"))
    span = Window.partitionBy("conv", "tile").orderBy("at")
    for level in range(TILE_BITS):
        half = 1 << level
        cut = F.last(F.when(place("at").bitwiseAND(half - 1) == half - 1, F.col("prefix")), ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, -1))
        lower = place("at").bitwiseAND(half) != 0
        rows = rows.withColumn("cut", cut).withColumn("prefix", F.when(lower, digest(F.col("cut"), F.col("prefix"))).otherwise(F.col("prefix"))).drop("cut")
    rows = stored(rows.withColumn("parent", F.lag("prefix").over(span)), "tiles")
    ends = rows.where(place("at") == (1 << TILE_BITS) - 1).select("conv", F.col("tile").alias("at"), F.col("prefix").alias("name"))
    if ends.isEmpty():
        return rows.drop("tile")
    # above names all tiles before the row's; before names the same turns as the last row of those does
    before = F.when(F.col("parent").isNull(), F.col("name")).otherwise(digest(F.col("parent"), F.col("name")))
    above = named(ends).select("conv", (F.col("at") + 1).alias("tile"), F.col("prefix").alias("above"), before.alias("before"))
    joined = rows.where("tile > 0").join(above, ["conv", "tile"])
    parent = F.when(F.col("parent").isNull(), F.col("before")).otherwise(digest(F.col("above"), F.col("parent")))
    joined = joined.withColumns({"parent": parent, "prefix": digest(F.col("above"), F.col("prefix"))})
    return rows.where("tile = 0").unionByName(joined.drop("above", "before")).drop("tile")


def grafted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds to each of the columns what the later rows of the same conversation hold."""
    rows = rows.withColumn("tile", tile("at"))
    span = Window.partitionBy("conv", "tile").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    for level in range(TILE_BITS):
        half = 1 << level
        below = {f"_{c}": F.last(F.when(place("at").bitwiseAND(half - 1) == 0, F.col(c)), ignorenulls=True).over(span) for c in columns}
        upper = place("at").bitwiseAND(half) == 0
        rows = rows.withColumns(below).withColumns({c: F.col(c) + F.when(upper, F.coalesce(F.col(f"_{c}"), F.lit(0))).otherwise(0) for c in columns}).drop(*below)
    rows = stored(rows, "grafts")
    if rows.where("tile > 0").isEmpty():
        return rows.drop("tile")
    tops = rows.where(place("at") == 0).select("conv", F.col("tile").alias("at"), *columns)
    below = grafted(tops, columns).where("at > 0").select("conv", (F.col("at") - 1).alias("tile"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(below, ["conv", "tile"], "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in columns}).drop("tile", *[f"_{c}" for c in columns])


def id_digests(ends: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, sha256) over the ids of each key, ascending, in decimals, joined by commas.

    The ids are sorted over range partitions and joined to pieces there; a key's pieces are then hashed as a stream,
    which a digest of one long text can't do in parallel, with one piece in memory.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, kinds, strict=True)), pa.array([first], pa.int64()), pa.array([",".join(held)])], [*keys, "first", "piece"])

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            for *now, number in zip(*(batch.column(k).to_pylist() for k in [*keys, id_col]), strict=True):
                if now != key or size >= PIECE:
                    if held:
                        yield piece()
                    key, first, held, size = now, number, [], 0
                held.append(str(number))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            kinds, done = [batch.column(k).type for k in keys], []
            for *now, text in zip(*(batch.column(k).to_pylist() for k in [*keys, "piece"]), strict=True):
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield as_batch(done, kinds)
        if key is not None:
            yield as_batch([(*key, state.hexdigest())], kinds)

    def as_batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([*kinds, pa.string()])], [*keys, "sha256"])

    key_types = ", ".join(f"{k} {ends.schema[k].dataType.simpleString()}" for k in keys)
    ids = ends.select(*keys, id_col).repartitionByRange(*keys, id_col).sortWithinPartitions(*keys, id_col)
    parts = ids.mapInArrow(pieces, f"{key_types}, first long, piece string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(hashed, f"{key_types}, sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv, at, name, size, length), as spliced() gives them: conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved (the sum over the subtree of size times
    members but one) and ends_sha256 over the members that end there. No rows: no node, not even a root.

    A node's own figures are put on the path of its smallest member, so the totals of a subtree are sums of path totals.
    Joins that meet a node with many members or many children (the root has all) are joins with one row a key on the
    other side, which adaptive execution splits.
    """
    rows = stored(named(sequences).select("conv", F.col("at").alias("depth"), "prefix", "parent", "size", (F.col("at") == F.col("length")).alias("ends")), "prefixes")
    nodes = rows.groupBy("depth", "prefix").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min("parent").alias("parent"))
    nodes = stored(nodes, "nodes")
    own = nodes.select("depth", "prefix", "conv_id", "n_convs", (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    first = F.col("conv") == F.col("conv_id")
    paths = rows.where("depth > 0").join(own, ["depth", "prefix"]).select(
        "conv", F.col("depth").alias("at"), "prefix", F.when(first, (F.col("n_convs") - 1) * F.col("size")).otherwise(0).alias("saved"), (first & F.col("leaf")).cast("long").alias("n_leaves")
    )
    paths = paths.unionByName(rows.where("depth = 0").select("conv", F.col("depth").alias("at"), "prefix", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("n_leaves")))
    totals = grafted(paths, ["saved", "n_leaves"]).groupBy(F.col("at").alias("depth"), "prefix").agg(F.sum("saved").alias("saved"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"))
    digests = id_digests(rows.where("ends"), ["depth", "prefix"], "conv")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    key = ["depth", "prefix"]
    joined = nodes.join(totals, key).join(children, key, "left").join(digests, key, "left").join(parents, ["depth", "parent"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved", F.coalesce("sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    )
