"""Conversation prefix trie, finished by leaf-peeling message passing.

Every distinct sequence of first turns is a node.  A sequence is named by the XOR of
128-bit hashes of its (place, role, text) entries, so a node's parent is its own name
without its last entry, names of all prefixes are one running XOR, and nodes and their
members are counted by one aggregation that combines in the map tasks.

Peeling: the nodes whose smallest member is the same conversation are one downward run
of the trie, and every node lies in one run.  A run waits for as many messages as runs
hang below it.  Runs that wait for none are complete: they send the totals of their
subtree to the run above and leave; the runs above count down, until only the root's run
finishes.  So a round costs what is still open, and there are as many rounds as runs are
nested, not as conversations are long.  A last pass sums each run from its lower end.

No step holds a conversation, a run or a node's members in one task: places come from a
range-partitioned order, running values are taken in blocks of bounded length whose sums
go ahead of them, and a node's member list is hashed as a stream of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm._common import compact, durable, name

#: Rows of a group that are summed in one sorted run; the sums of such blocks are summed before.
BLOCK = 4096
#: Ids in one piece of a node's member list, at the most.
PIECE = 4096
#: Rounds whose finished runs are kept as separate tables before they are written as one.
ROUNDS_A_TABLE = 16


def ordered_turns(df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), mark1, mark2 (a 128-bit hash of role and text), size (code points of the text).

    Turns are ordered by ``turn``, null first, ties by role and text; a null role or text
    is empty.  Repeated rows are turns of their own.  Rows without a conversation take no
    part; other columns, whatever their names, are not read; an empty table gives no rows.
    """
    role_, text_ = (F.coalesce(name(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.select(name(key).cast("long").alias("conv_id"), name(turn).alias("turn"), role_.alias("role"), text_.alias("text")).where("conv_id is not null")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id counts the rows of a partition in their order, and partitions ascend: a place is a difference of ids.
    at = F.monotonically_increasing_id()
    marked = durable(
        dealt.select(
            "conv_id", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
            F.xxhash64("role", "text").alias("mark1"), F.xxhash64("text", "role", F.lit("twin")).alias("mark2"), F.length("text").cast("long").alias("size"),
        )
    )
    held = marked.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.col("at") - F.col("first") + F.col("before") + 1
    return marked.join(held.select("conv_id", "part", "first", "before"), ["conv_id", "part"]).select("conv_id", place.alias("place"), "mark1", "mark2", "size")


def running(df: DataFrame, group: str, at: str, values: list[str], sum_of, add, none: Column) -> DataFrame:
    """``df`` with each value replaced by its running total along ``at`` (whole numbers, no gaps) within ``group``.

    ``sum_of`` is an aggregate and ``add`` joins two of its results; ``none`` is the total of
    nothing.  Groups are cut into blocks, so none is sorted in one task.
    """
    df = df.withColumn("block", F.floor(F.col(at) / BLOCK))
    blocks = df.groupBy(group, "block").agg(*[sum_of(v).alias(f"before_{v}") for v in values])
    earlier = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(group, "block", *[F.coalesce(sum_of(f"before_{v}").over(earlier), none).alias(f"before_{v}") for v in values], F.row_number().over(Window.partitionBy(group).orderBy("block")).alias("nth"))
    within = Window.partitionBy(group, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = df.join(blocks.where("nth > 1").drop("nth"), [group, "block"], "left")
    totals = {v: add(sum_of(v).over(within), F.coalesce(f"before_{v}", none)) for v in values}
    return joined.withColumns(totals).drop("block", *[f"before_{v}" for v in values])


def member_digests(ends: DataFrame, node: list[str]) -> DataFrame:
    """The node columns and ends_sha256: SHA-256 of the node's conversations, ascending, in decimals joined by commas.

    ``ends`` has each (node, conv_id) once.  Ids are joined in pieces of bounded width, which are hashed one after another.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*node, F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(text.alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            found = []
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == key:
                    digest.update(b",")
                else:
                    if digest is not None:
                        found.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in found], schema=arrow)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, digest.hexdigest()), strict=True))], schema=arrow)

    names = [*node, "ends_sha256"]
    arrow = pa.schema([(c, pa.int64()) for c in node] + [("ends_sha256", pa.string())])
    dealt = pieces.repartition(*node).sortWithinPartitions(*node, "piece").select(*node, "ids")
    return dealt.mapInArrow(digests, ", ".join([f"{c} long" for c in node] + ["ends_sha256 string"]))


def peel(runs: DataFrame) -> DataFrame:
    """run, leaves, saved: totals of the subtree below each run's upper end.

    ``runs``: run, above (the run it hangs from; null for the root's), waits (runs that
    hang from it), leaves, saved (of its own nodes).  Each round is checkpointed.
    """
    open_, finished = durable(runs), []
    while True:
        ready = compact(open_.where("waits = 0"))
        if ready.isEmpty():
            break
        finished.append(ready.select("run", "leaves", "saved"))
        if len(finished) > ROUNDS_A_TABLE:
            whole = finished[0]
            for f in finished[1:]:
                whole = whole.unionByName(f)
            finished = [compact(whole)]
        sent = ready.where("above is not null").groupBy("above").agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = open_.where("waits > 0").join(sent.withColumnRenamed("above", "to"), F.col("run") == F.col("to"), "left")
        more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        open_ = compact(rest.select("run", "above", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), more("leaves", "more_leaves"), more("saved", "more_saved")))
    whole = finished[0] if finished else runs.select("run", "leaves", "saved").limit(0)
    for f in finished[1:]:
        whole = whole.unionByName(f)
    return whole


def build(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, place (from 1, no gaps), mark1, mark2, size, as ``ordered_turns``
    returns them; ``members``: conv_id, once each, also those without turns, who end at the
    root.  saved_tokens sums (n_convs - 1) x size of the last turn over the node's subtree;
    n_leaves counts the childless nodes there.  Without members there is no node at all.
    """
    entry = [F.xxhash64("place", m).alias(m) for m in ("mark1", "mark2")]
    steps = turns.select("conv_id", "place", *entry, "size", *[e.alias(f"own{i}") for i, e in enumerate(entry, 1)])
    steps = running(steps, "conv_id", "place", ["mark1", "mark2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b), F.lit(0).cast("long"))
    steps = durable(
        steps.select(
            "conv_id", F.col("place").alias("depth"), "mark1", "mark2", "size",
            *[F.col(f"mark{i}").bitwiseXOR(F.col(f"own{i}")).alias(f"up{i}") for i in (1, 2)],
        )
    )
    zero = lambda c: F.lit(0).cast("long").alias(c)
    top = members.select("conv_id", zero("depth"), zero("mark1"), zero("mark2"), zero("size"), F.lit(None).cast("long").alias("up1"), F.lit(None).cast("long").alias("up2"))
    nodes = steps.unionByName(top).groupBy("depth", "mark1", "mark2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("size").alias("size"), F.first("up1").alias("up1"), F.first("up2").alias("up2")
    )
    nodes = durable(nodes)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("mark1").alias("up1"), F.col("mark2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = durable(nodes.join(above, ["depth", "up1", "up2"], "left").drop("up1", "up2"))
    # From here on a node is (conv_id, depth): a conversation has one node of a depth.
    children = nodes.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = durable(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("size")).withColumn("leaves", (F.col("n_children") == 0).cast("long")))

    upper = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))  # the upper end of a run
    runs = nodes.groupBy(F.col("conv_id").alias("run")).agg(
        F.max(F.when(upper, F.col("parent_conv_id"))).alias("above"),
        (F.sum("n_children") - F.count("*") + 1).alias("waits"),
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
    )
    totals = peel(runs)
    ends = nodes.where(upper & F.col("parent_conv_id").isNotNull()).select(F.col("conv_id").alias("run"), F.col("parent_conv_id").alias("at"), (F.col("depth") - 1).alias("at_depth"))
    arrived = totals.join(ends, "run").groupBy(F.col("at").alias("conv_id"), F.col("at_depth").alias("depth")).agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    summed = nodes.join(arrived, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "mark1", "mark2", "parent_conv_id", "n_convs", "n_children", (-F.col("depth")).alias("up"),
        *[(F.col(c) + F.coalesce(f"in_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")],
    )
    summed = running(summed, "conv_id", "up", ["leaves", "saved"], F.sum, lambda a, b: a + b, F.lit(0).cast("long"))

    last = steps.groupBy("conv_id").agg(F.max(F.struct("depth", "mark1", "mark2")).alias("last"))
    at_end = members.select("conv_id").join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"last.{c}"), F.lit(0)).alias(c) for c in ("depth", "mark1", "mark2")])
    named = summed.join(member_digests(at_end, ["depth", "mark1", "mark2"]), ["depth", "mark1", "mark2"], "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame, *, span: int = 100, heads: int = 6) -> DataFrame:
    """Turns of every conversation c: the first h of conversation c - c % span, then its own after its first h; h = crc32(c) % heads."""
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % span)
    firsts = turns.where((F.col("conv_id") % span == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    taken = sizes.where("h > 0").select("conv_id", "h", "base").join(firsts, "base").where("place <= h")
    own = turns.withColumn("h", head).where("place > h").withColumn("base", F.col("conv_id") - F.col("conv_id") % span)
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")).where(F.col("base") % span == 0)
    own = own.join(of_base, "base", "left").withColumn("place", F.col("place") - F.col("h") + F.least("h", F.coalesce("base_n", F.lit(0))))
    return taken.select("conv_id", "place", "mark1", "mark2", "size").unionByName(own.select("conv_id", "place", "mark1", "mark2", "size"))
