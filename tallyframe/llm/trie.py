"""The trie of conversations' turns: distributed MSD radix partitioning over turn ids, multikey quicksort within small buckets.

Turns (role, text) get ids from a dictionary, conversations become arrays of ids, and equal conversations become one sequence. All
sequences start in one bucket. A bucket of more than LOCAL turns is split by the turn that follows what its sequences have in common
(their least and greatest array tell how much that is, so a bucket splits each time), in place: rows stay where they are and only
their bucket's name changes. Once no bucket is larger, each goes to one task, which sorts it by multikey quicksort and emits a node
each time it goes one turn deeper. Nodes of buckets that were split come from their aggregates; totals go up bucket by bucket.

A conversation is one row of 16 bytes a turn, and the digest of a node's ends is streamed, since SHA-256 is sequential.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

#: Turns of a bucket up to which one task finishes it.
LOCAL = 20_000
#: A row for each of at most so many buckets is broadcast; more are joined by shuffle.
FEW_BUCKETS = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), id (equal for equal turns only), size (UTF-8 bytes of the text) of each turn of a conversation.

    In order of turn, null first; turns with the same number in order of their digest. Null role or text is empty; rows without conv_id
    are no conversation's.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    # The role's length keeps role and text apart.
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = stored(rows)
    # Ids count up within each part of the stored dictionary, so they are the same whenever it is read.
    ids = stored(rows.select("digest").distinct()).select("digest", F.monotonically_increasing_id().alias("id"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.withColumn("place", place.cast("long")).join(stored(ids), "digest").select("conv_id", "place", "id", "size")


def sequences(turns: DataFrame, head: str | None, base: str) -> DataFrame:
    """conv_id, turns (ids), sizes of every conversation.

    head: SQL for the number of first turns that conversation `base` (SQL too) gives in place of the conversation's own; None: none.
    A base gives to as many conversations as have it for base.
    """
    turns = cut(turns)
    every = turns.select("conv_id").distinct()
    if head is None:
        parts = turns.select("conv_id", F.lit(1).alias("part"), "place", "id", "size")
    else:
        own = turns.withColumn("h", F.expr(head)).filter("place > h").select("conv_id", F.lit(1).alias("part"), "place", "id", "size")
        takers = every.select(F.col("conv_id").alias("c"), F.expr(base).alias("base"), F.expr(head).alias("h"))
        given = turns.join(takers, (F.col("conv_id") == F.col("base")) & (F.col("place") <= F.col("h")))
        parts = own.union(given.select("c", F.lit(0), "place", "id", "size"))
    made = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "id", "size"))).alias("s"))
    none = F.array().cast("array<long>")
    whole = every.join(made, "conv_id", "left")
    return whole.select("conv_id", F.coalesce(F.col("s.id"), none).alias("turns"), F.coalesce(F.col("s.size"), none).alias("sizes"))


def distinct_sequences(whole: DataFrame) -> DataFrame:
    """turns, sizes, n (conversations), least (conv_id) and ends (digest of their ids) of each distinct sequence."""

    def digests(batches):
        import pyarrow as pa

        last, found = None, None
        for batch in batches:
            out = []
            for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seq == last:
                    found[0].update(b",%d" % conv)
                    found[1] += 1
                    continue
                if last is not None:
                    out.append((*found[1:], found[0].hexdigest()))
                last, found = seq, [hashlib.sha256(b"%d" % conv), 1, conv]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["n", "least", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*found[1:], found[0].hexdigest())], ["n", "least", "ends"])

    named = stored(whole.withColumn("seq", F.sha2(F.array_join(F.col("turns").cast("array<string>"), ","), 256)))
    ends = named.select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(digests, "n long, least long, ends string")
    return named.join(ends, F.col("conv_id") == F.col("least")).select("turns", "sizes", "n", "least", "ends")


def local_nodes(rows: list[tuple], start: int) -> list[list]:
    """Nodes of a bucket (turns, sizes, n, least, ends), whose sequences are different and have the first `start` turns in common:
    [least, depth, parent's place in the list, n, children, leaves, saved, ends], the bucket's own first, each before those below it.
    """
    nodes: list[list] = []

    def node(members, depth, above):
        n = sum(r[2] for r in members)
        nodes.append([min(r[3] for r in members), depth, above, n, 0, 0, (n - 1) * members[0][1][depth - 1] if depth else 0, NO_ENDS])
        if above is not None:
            nodes[above][4] += 1
        return len(nodes) - 1

    todo = [(rows, start, node(rows, start, None))]
    while todo:
        members, depth, top = todo.pop()
        if len(members) == 1:  # a chain to the end
            for depth in range(depth + 1, len(members[0][0]) + 1):
                top = node(members, depth, top)
            nodes[top][7] = members[0][4]
            continue
        pivot = members[len(members) // 2][0]
        key = pivot[depth] if depth < len(pivot) else -1
        less, same, more = [], [], []
        for r in members:
            k = r[0][depth] if depth < len(r[0]) else -1
            (less if k < key else more if k > key else same).append(r)
        if key < 0:
            nodes[top][7] = same[0][4]
        else:
            todo.append((same, depth + 1, node(same, depth + 1, top)))
        todo += [(part, depth, top) for part in (less, more) if part]
    for one in reversed(nodes):
        one[5] = one[5] or 1
        if one[2] is not None:
            nodes[one[2]][5] += one[5]
            nodes[one[2]][6] += one[6]
    return nodes


def _finish(batches):
    """Nodes of whole buckets, whose rows stand together: bucket, depth, up (the conv_id of what is above), turns, sizes, n, least, ends."""
    import pyarrow as pa

    kinds = [pa.string(), *[pa.int64()] * 7, pa.string()]
    names = ["bucket", *(c.split()[0] for c in NODE.split(", "))]

    def rows_of(bucket, depth, up, members):
        nodes = local_nodes(members, depth)
        for k, (least, at, above, n, children, leaves, saved, ends) in enumerate(nodes):
            yield (bucket if k == 0 else None, least, at, up if above is None else nodes[above][0], n, children, leaves, saved, ends)

    last, members, out = None, [], []
    for batch in batches:
        for bucket, depth, up, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if last and bucket != last[0]:
                out += rows_of(*last, members)
                members = []
            last = (bucket, depth, up)
            members.append(tuple(row))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
    if last:
        out += rows_of(*last, members)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def _joined(rows: DataFrame, table: DataFrame, on: str, how: str) -> DataFrame:
    return rows.join(F.broadcast(table) if table.limit(FEW_BUCKETS + 1).count() <= FEW_BUCKETS else table, on, how)


def prefix_trie(conversations: DataFrame, head: str | None = None, base: str = "conv_id", local: int = LOCAL) -> DataFrame:
    """One row per node, which is a distinct sequence of first turns; see NODE for the columns.

    conv_id: the smallest conversation that starts with it (a member); depth: turns; parent_conv_id: the parent's conv_id, null for the
    root; n_convs: members; n_children; n_leaves: childless nodes at or below it; saved_tokens: (n_convs - 1) times the bytes of the
    last text, summed at and below it; ends_sha256: SHA-256 of the decimal ids of members that end there, ascending, by commas.

    No conversation, no node. Columns besides conv_id, turn, role and text aren't read; repeated rows are turns of their own.
    """
    seqs = stored(distinct_sequences(sequences(turns_of(conversations), head, base)))
    nothing = F.lit(None).cast("long")
    rows = seqs.select(F.lit("").alias("bucket"), F.lit(0).alias("depth"), nothing.alias("up"), "turns", "sizes", "n", "least", "ends")
    finished, splits = [], []
    while True:
        sums = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("turns") + 1).alias("length"))
        large = cut(sums.filter((F.col("length") > local) & (F.col("rows") > 1)).select("bucket"))
        if large.isEmpty():
            finished.append(rows)
            break
        finished.append(_joined(rows, large, "bucket", "left_anti"))
        # What a bucket's sequences have in common is what its least and its greatest have.
        large = _joined(rows, large, "bucket", "left_semi").groupBy("bucket").agg(
            F.sum("n").alias("all_n"), F.min("least").alias("top"), F.first("depth").alias("from"), F.first("up").alias("above"),
            F.min("turns").alias("low"), F.max("turns").alias("high"), F.max_by("sizes", "turns").alias("chain"),
        )
        differ = F.array_position(F.transform(F.arrays_zip("low", "high"), lambda p: p["low"].eqNullSafe(p["high"])), False)
        large = large.withColumn("to", F.when(differ > 0, differ - 1).otherwise(F.least(F.size("low"), F.size("high"))).cast("int"))
        large = cut(large.select("bucket", "from", "above", "all_n", "top", "to", F.slice("chain", 1, F.col("to")).alias("chain")))
        split = _joined(rows, large.select("bucket", "to", "top"), "bucket", "inner")
        # A sequence that ends where the bucket splits has no bucket below: it is the end of the bucket's last node.
        below = F.when(F.size("turns") > F.col("to"), F.md5(F.concat_ws(",", "bucket", F.get("turns", F.col("to")).cast("string"))))
        split = stored(split.select(F.col("bucket").alias("within"), below.alias("bucket"), (F.col("to") + 1).alias("depth"), F.col("top").alias("up"), "turns", "sizes", "n", "least", "ends"))
        ended = split.filter("bucket IS NULL").select(F.col("within").alias("bucket"), "ends")
        splits.append((large, ended, split.filter("bucket IS NOT NULL").select("within", "bucket").distinct()))
        rows = split.filter("bucket IS NOT NULL").drop("within")
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.unionByName(more)
    made = whole.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_finish, f"bucket string, {NODE}")
    made = stored(made)
    nodes = made.drop("bucket")
    totals = made.filter("bucket IS NOT NULL").select("bucket", "n_leaves", "saved_tokens")
    for large, ended, children in reversed(splits):
        under = children.join(totals, "bucket").groupBy(F.col("within").alias("bucket")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        found = cut(large.join(under, "bucket", "left").join(ended, "bucket", "left").na.fill(0, ["n_children", "below"]))
        found = found.withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1).cast("long")))
        # The bucket's nodes are a chain: from where it came from to where it splits, all with the same members.
        depth = F.explode(F.sequence(F.col("from"), F.col("to"))).alias("depth")
        chain = found.select("*", depth)
        saved = F.col("below") + (F.col("all_n") - 1) * F.aggregate(F.slice("chain", F.greatest("depth", F.lit(1)), F.col("to") + 1), F.lit(0).cast("long"), lambda a, b: a + b)
        last = F.col("depth") == F.col("to")
        chain = chain.select(
            "bucket", F.col("top").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
            F.when(F.col("depth") == F.col("from"), F.col("above")).otherwise(F.col("top")).alias("parent_conv_id"), F.col("all_n").alias("n_convs"),
            F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"), (F.col("depth") == F.col("from")).alias("first"),
        )
        nodes = nodes.unionByName(chain.drop("bucket", "first"))
        totals = totals.unionByName(chain.filter("first").select("bucket", "n_leaves", "saved_tokens"))
    return nodes
