"""The tree of all conversations' prefixes, without holding any conversation in one task.

A conversation's turns stand in the order of ``turn`` (null first; ties by role, then by the MD5 of the text; equal rows are
all kept), null roles and texts are empty.  ``rebuilt`` gives each conversation the first turns of another one, as its id
says.  A node is a distinct sequence of the first d turns of some conversations, its members; the root has d = 0 and all of
them.  The smallest member owns the node.

A prefix is known by the sum of hashes of its turns and their places (4 x 32 bits of hashes, so that no two prefixes are
taken for one by chance), which is a running sum and needs no order of evaluation.  The owner of a prefix is the minimum
over its digest.  If a conversation owns its prefix of some depth, it owns all deeper ones, so its first owned depth is found
by binary search: in each round every conversation that is still open asks for one digest, and one join answers all.
Owned depths of a conversation are a chain, which hangs on a chain of a smaller id.  What concerns subtrees is summed over
the tree of chains, in as many rounds as its height has binary digits, then along each chain.

Long conversations are worked on in blocks of BLOCK turns, and the turns of one are numbered from several ranges of the
sorted table; keys that many rows share meet the other side of a join by a broadcast of at most HOT_KEYS keys.  The hash of
the ids that end at a node must read them in order: they come as blocks of sorted ids, and one task streams through them.

Rows without a conversation id belong to no conversation.  A conversation that is left without turns is a member of the root
alone.  Texts are read whole, once.  An empty table has no node.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densigrid.llm.ship import cut, ship

#: Conversations are built in groups of so many ids, and share fewer than so many first turns.
FAMILY, SHARED = 5, 9
#: Turns of a conversation that one window adds up, and ids that one row of a hash's input holds.
BLOCK, IDS = 1024, 1024
#: A key with more than 1 / HOT_KEYS of all rows is met by broadcast; there are at most that many.
HOT_KEYS = 20_000

_LANES = ("s0", "s1", "s2", "s3")
_KEY = ["k0", "k1"]


def block(at: Column) -> Column:
    return F.floor(at / BLOCK)


def looked_up(left: DataFrame, right: DataFrame, on: list[str], weight: str, rows: int) -> DataFrame:
    """Left join with a table of unique keys, whose ``weight`` says how many of the ``rows`` rows of ``left`` have the key at
    most; weights add up to ``rows`` or less, so at most HOT_KEYS keys are heavy."""
    heavy = F.col(weight) * HOT_KEYS > rows
    values = [c for c in right.columns if c not in on and c != weight]
    hot = right.where(heavy).select(*on, F.struct(F.lit(1), *values).alias("__hot"))
    rest = right.where(~heavy).select(*on, F.struct(F.lit(1), *values).alias("__rest"))
    met = left.join(F.broadcast(hot), on, "left")
    # Rows that are met already look for no other key, so the shuffle does not bring them together.
    keys = [F.when(F.col("__hot").isNull(), F.col(c)).alias(f"__{c}") for c in on]
    asks = met.select("*", *keys, F.when(F.col("__hot").isNotNull(), F.xxhash64(*left.columns)).otherwise(0).alias("__away"))
    rest = rest.select(*[F.col(c).alias(f"__{c}") for c in on], F.lit(0).cast("long").alias("__away"), "__rest")
    out = asks.join(rest, [F.coalesce(asks[f"__{c}"], F.lit(0)) == rest[f"__{c}"] for c in on] + [asks["__away"] == rest["__away"]], "left")
    return out.select(*[asks[c] for c in left.columns], *[F.coalesce(F.col(f"__hot.{v}"), F.col(f"__rest.{v}")).alias(v) for v in values])


def running(df: DataFrame, group: str, at: str, sums: list[str], longest: Column, backwards: bool = False) -> DataFrame:
    """``sums`` added up over the rows of a group in the order of ``at``, this one included; ``longest`` (a bound on the last
    ``at`` of the row's group) says which groups have more than one block."""
    df = df.withColumn("__b", block(F.col(at)))
    order = F.col(at).desc() if backwards else F.col(at)
    within = Window.partitionBy(group, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = df.where(longest >= BLOCK).groupBy(group, "__b").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(group).orderBy(F.col("__b").desc() if backwards else F.col("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(group, "__b", *[F.sum(c).over(before).alias(f"__{c}") for c in sums])
    others = [c for c in df.columns if c not in sums]
    added = df.select(*others, *[F.sum(c).over(within).alias(c) for c in sums]).join(carried, [group, "__b"], "left")
    return added.select(*[c for c in others if c != "__b"], *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums])


def placed(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place from 0, said, bytes) of each turn, and (conv_id, n_own)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.md5(text)).alias("tie"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["turn", "role", "tie"]
    # Ranges of the whole order, equal rows dealt out by a random number: no conversation need fit one task.
    dealt = cut(rows.withColumn("salt", F.rand(11)).repartitionByRange("conv_id", *order, "salt").withColumn("part", F.spark_partition_id()).drop("salt"))
    counts = dealt.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Of each range only its first conversation can have turns in a range before, so there are no more rows than ranges.
    shift = counts.select("part", "conv_id", before.alias("before")).where("before > 0")
    local = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    numbered = dealt.select("part", "conv_id", "said", "bytes", local.alias("local")).join(F.broadcast(shift), ["part", "conv_id"], "left")
    return (
        numbered.select("conv_id", (F.col("local") - 1 + F.coalesce("before", F.lit(0))).alias("place"), "said", "bytes"),
        counts.groupBy("conv_id").agg(F.sum("n").alias("n_own")),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, total, said, bytes) of the rebuilt conversations' turns, and (conv_id, total) of all of them.

    A conversation c has the first h turns of c - c % FAMILY (all if fewer, none if that is absent), then its own after its
    first h; h is the remainder of its id's CRC-32 by SHARED.
    """
    turns, own = placed(conversations)
    turns, own = cut(turns), cut(own)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")
    mine = own.select("conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("root"), h)
    heads = mine.join(own.select(F.col("conv_id").alias("root"), F.col("n_own").alias("n_root")), "root", "left")
    n_head = F.least("h", F.coalesce("n_root", F.lit(0)))
    shape = cut(heads.select("conv_id", "root", "h", "n_own", n_head.alias("n_head"), (n_head + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("total")))
    rows = turns.count()
    rest = looked_up(turns, shape.select("conv_id", "h", "n_head", "total", "n_own"), ["conv_id"], "n_own", rows).where("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("n_head") + 1).alias("depth"), "total", "said", "bytes")
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED)).withColumnRenamed("conv_id", "root")
    first = first.join(shape.select("conv_id", "root", "h", "total"), "root").where("place < h")
    return first.select("conv_id", (F.col("place") + 1).alias("depth"), "total", "said", "bytes").unionByName(rest), shape.select("conv_id", "total")


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, total, bytes, k0, k1): the digest of each prefix."""
    halves = [h for i in (1, 2) for x in (F.xxhash64(F.lit(i), F.col("depth"), F.col("said")),) for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = running(turns.select("conv_id", "depth", "total", "bytes", *[v.alias(n) for v, n in zip(halves, _LANES)]), "conv_id", "depth", list(_LANES), F.col("total"))
    low = [F.col(n).bitwiseAND(F.lit(0xFFFFFFFF)) for n in _LANES]
    return sums.select("conv_id", "depth", "total", "bytes", *[F.shiftleft(low[2 * i], 32).bitwiseOR(low[2 * i + 1]).alias(k) for i, k in enumerate(_KEY)])


def first_owned(prefixes: DataFrame, nodes: DataFrame, shape: DataFrame, rows: int, longest: int) -> DataFrame:
    """(conv_id, first, above): the first depth that each conversation owns (one more than its turns if none), and the owner of
    the prefix before, null where that is the root."""
    shared = nodes.where("n > 1").select(*_KEY, F.col("conv_id").alias("owner"), "n")
    none = F.lit(None).cast("long")
    open_ = prefixes.select("conv_id", "depth", *_KEY, F.lit(1).cast("long").alias("lo"), (F.col("total") + 1).alias("hi"), none.alias("was"))
    told = [shape.select("conv_id", F.lit(0).alias("round"), F.lit(1).cast("long").alias("lo"), F.lit(1).cast("long").alias("hi"), none.alias("above"))]
    for i in range(longest.bit_length()):
        probes = open_.where(F.col("depth") == F.floor((F.col("lo") + F.col("hi")) / 2))
        # A prefix of one member is its own; the owner of any other stands among the shared ones.
        met = looked_up(probes, shared, _KEY, "n", rows)
        mine = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        now = cut(met.select("conv_id", F.lit(i + 1).alias("round"), F.when(mine, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("was")).otherwise(F.col("owner")).alias("above")))
        told.append(now)
        if i + 1 < longest.bit_length():
            # What is left to ask halves in each round; long conversations meet their new bounds block by block.
            bounds = now.where("lo < hi").select("conv_id", "lo", "hi", F.col("above").alias("was"), F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))).alias("b"))
            left = open_.select("conv_id", "depth", *_KEY, block(F.col("depth")).alias("b")).join(bounds, ["conv_id", "b"]).where("depth >= lo AND depth < hi")
            open_ = cut(left.drop("b"))
    every = told[0]
    for t in told[1:]:
        every = every.unionByName(t)
    return every.groupBy("conv_id").agg(F.max_by(F.struct("lo", "above"), "round").alias("s")).select("conv_id", F.col("s.lo").alias("first"), "s.above")


def totals(chains: DataFrame, sums: list[str]) -> DataFrame:
    """(conv_id, sums): over the chain and all that hang on it.  ``chains`` has conv_id, above and the chain's own sums.

    After k rounds a chain holds what is less than 2^k steps below it, and points to the chain 2^k steps above.
    """
    now = cut(chains.select("conv_id", F.col("above").alias("up"), *sums))
    rows = now.count()
    while not now.where("up IS NOT NULL").isEmpty():
        below = now.where("up IS NOT NULL").groupBy("up").agg(F.count("*").alias("n"), *[F.sum(s).alias(f"__{s}") for s in sums])
        added = cut(now.join(below.withColumnRenamed("up", "conv_id"), "conv_id", "left"))
        # Where a chain points next is where the one that it points to does.
        ways = added.where("n IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("next"), "n")
        grown = added.select("conv_id", "up", *[(F.col(s) + F.coalesce(f"__{s}", F.lit(0))).alias(s) for s in sums])
        done, going = grown.where("up IS NULL"), grown.where("up IS NOT NULL")
        going = looked_up(going, ways, ["up"], "n", rows).select("conv_id", F.col("next").alias("up"), *sums)
        now = cut(done.unionByName(going))
    return now.drop("up")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = made = None
    done = ([], [], [])

    def ended():
        if key is not None:
            for column, value in zip(done, (*key, made.hexdigest())):
                column.append(value)

    for batch in batches:
        for k0, k1, ids in zip(*(batch.column(n).to_pylist() for n in ("k0", "k1", "ids"))):
            if (k0, k1) != key:
                ended()
                key, made = (k0, k1), hashlib.sha256(ids.encode())
            else:
                made.update(b",")
                made.update(ids.encode())
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["k0", "k1", "ends_sha256"])
            done = ([], [], [])
    ended()
    if done[0]:
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], names=["k0", "k1", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(k0, k1, ends_sha256): hash of the ids that end at a node, ascending, joined by commas."""
    ship(ends.sparkSession)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = cut(ends.groupBy(*_KEY, F.floor(F.col("conv_id") / IDS).alias("b")).agg(ids.alias("ids")))
    counts = blocks.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    one = counts.where("n = 1").select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))
    many = blocks.join(counts.where("n > 1").select(*_KEY), _KEY, "left_semi")
    streamed = many.repartition(*_KEY).sortWithinPartitions(*_KEY, "b").select(*_KEY, "ids").mapInArrow(_streamed, "k0 long, k1 long, ends_sha256 string")
    return one.unionByName(streamed)


def tree(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt
    conversations' tree."""
    turns, shape = rebuilt(conversations)
    prefixes = cut(digested(turns))
    everyone = shape.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where("n > 0")
    root = everyone.select(*[F.lit(0).cast("long").alias(k) for k in _KEY], "conv_id", "n", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"))
    made = prefixes.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"))
    made = cut(made)
    size = prefixes.agg(F.count("*").alias("rows"), F.max("total").alias("longest")).first()
    rows, longest = size.rows, size.longest or 0
    top = everyone.first()
    owner = top.conv_id if top else None
    found = first_owned(prefixes, made, shape, rows, longest).join(shape, "conv_id")
    # The smallest conversation of all owns the root too, and hangs on nothing.
    is_top = F.col("conv_id") == F.lit(owner).cast("long")
    chains = found.where((F.col("first") <= F.col("total")) | is_top).select("conv_id", F.when(is_top, 0).otherwise(F.col("first")).alias("first"), F.when(~is_top, F.coalesce("above", F.lit(owner).cast("long"))).alias("above"), F.col("total").alias("last"))
    chains = cut(chains)
    nodes = cut(looked_up(made.unionByName(root).withColumn("saved", (F.col("n") - 1) * F.col("bytes")), chains.withColumn("w", F.col("last") - F.col("first") + 1), ["conv_id"], "w", rows + 1))
    joints = chains.where("above IS NOT NULL").select(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    kinds = cut(joints.groupBy("conv_id", "depth").agg(F.count("*").alias("kids")))
    closed = kinds.join(chains.select("conv_id", F.col("last").alias("depth")), ["conv_id", "depth"], "left_semi").select("conv_id", F.lit(0).cast("long").alias("open"))
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    chains = cut(chains.join(closed, "conv_id", "left").join(own, "conv_id").select("conv_id", "first", "above", "last", F.coalesce("open", F.lit(1)).cast("long").alias("leaves"), "saved"))
    whole = chains.select("conv_id", "above", "first").join(totals(chains, ["leaves", "saved"]), "conv_id")
    hung = whole.where("above IS NOT NULL").groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    own_leaf = F.when((F.col("depth") == F.col("last")) & F.col("kids").isNull(), 1).otherwise(0)
    parts = nodes.join(hung, ["conv_id", "depth"], "left").select(
        *_KEY, "conv_id", "depth", "last", "n",
        F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        (F.coalesce("kids", F.lit(0)) + F.when(F.col("depth") < F.col("last"), 1).otherwise(0)).alias("n_children"),
        (F.coalesce("more_leaves", F.lit(0)) + own_leaf).alias("n_leaves"),
        (F.coalesce("more_saved", F.lit(0)) + F.col("saved")).alias("saved_tokens"),
    )
    told = running(parts, "conv_id", "depth", ["n_leaves", "saved_tokens"], F.col("last"), backwards=True)
    nobody = shape.where("total = 0").select("conv_id", *[F.lit(0).cast("long").alias(k) for k in _KEY])
    ends = end_hashes(prefixes.where("depth = total").select("conv_id", *_KEY).unionByName(nobody))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return told.join(ends, _KEY, "left").select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
