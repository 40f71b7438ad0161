"""Operator 13: a trie of conversation prefixes, summed up by heavy-path decomposition.

A node is a sequence of turns (role, text) with which some conversation begins. Its key is a sum of
128-bit hashes of (position, role, text) over the sequence, so all keys of a conversation are running
sums, and a parent's key is a subtraction. Nodes are what grouping rows by key leaves.

Each node's child with most members (ties: smallest member) is heavy, the others are light; heavy
edges form paths from a head down to a leaf. A light child has at most half of its parent's members,
so a walk from the root crosses a logarithmic number of light edges. A node's path head is the last light node on the walk
of its smallest member, and the path's level is how many there are: two running values along that
walk. Subtree sums then take three steps. Paths add up what their own nodes have. Level by level from
the deepest, in logarithmically many rounds, a path's total goes to the path of the node that its head hangs on. Last, every node adds
the totals that hang on it, and suffix sums along each path give the sums of all subtrees.

No step holds a conversation, a path or a node's members together. Running values are taken within
blocks of BLOCK positions, and what earlier blocks leave is added; positions are ranked within ranges
in which equal turns have been counted first. Digests of members are formed from pieces of PIECE bytes
that tasks make of sorted ranges; a node's task reads its pieces in order and holds one of them.

Turns are ordered by turn (null first); ties by SHA-256 of role and text; repeated rows are repeated
turns. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left
out. conv_id % 100 has the sign of conv_id. An empty table has no nodes, not even a root. Other
columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, table
from ledgerloom.lineage import remove

#: Positions that are summed together, and bytes of a piece of a digest's text.
BLOCK, PIECE = 4096, 1 << 16
#: Conversations share turns with the one at the last multiple of this; up to MOST - 1 of them.
FAMILY, MOST = 100, 6
ROOT = "0" * 32
LANES = [f"lane{i}" for i in range(4)]
EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, at: str, sums: list[str], last: list[str] = (), back: bool = False) -> DataFrame:
    """rows with columns replaced by their running sums, or last values that aren't null, along `at` within key.

    back: from the highest position down. `at` has whole numbers without gaps, so a block is bounded."""
    rows = rows.withColumn("__block", F.floor(F.col(at) / BLOCK))
    ordered = lambda c: F.desc(c) if back else F.asc(c)
    here = Window.partitionBy(key, "__block").orderBy(ordered(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy(ordered("__block")).rowsBetween(Window.unboundedPreceding, -1)
    final = F.min if back else F.max
    left = rows.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__at")).agg(*(F.sum(c).alias(c) for c in sums), *(F.max_by(c, F.when(F.col(c).isNotNull(), -F.col(at) if back else F.col(at))).alias(c) for c in last), final(at).alias("__end"))
    across = Window.partitionBy("__key").orderBy(ordered("__at")).rowsBetween(Window.unboundedPreceding, -1)
    # only keys of more than one block have anything to carry
    carried = left.select("__key", "__at", *(F.sum(c).over(across).alias(f"__{c}") for c in sums), *(F.last(c, ignorenulls=True).over(across).alias(f"__{c}") for c in last), F.count("*").over(across).alias("__before")).where("__before > 0").drop("__before")
    local = rows.withColumns({c: F.sum(c).over(here) for c in sums} | {c: F.last(c, ignorenulls=True).over(here) for c in last})
    both = local.join(carried, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__at")), "left")
    added = {c: F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in sums} | {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in last}
    return both.withColumns(added).select(*(c for c in rows.columns if c != "__block"))


def positions(rows: DataFrame) -> DataFrame:
    """conv_id, pos from 1, said (SHA-256 of role and text) and chars of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.char_length(text).cast("long").alias("chars"))
    order = [F.asc_nulls_first("turn"), F.asc("said")]
    counted = turns.groupBy("conv_id", "turn", "said", "chars").agg(F.count("*").alias("n"))
    dealt = cut(counted.repartitionByRange("conv_id", *order).withColumn("__part", F.spark_partition_id()), "turns")
    within = Window.partitionBy("conv_id", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a conversation has as many rows here as ranges that it spans
    starts = dealt.groupBy("conv_id", "__part").agg(F.sum("n").alias("m")).withColumn("start", F.sum("m").over(before)).where("start > 0").select("conv_id", "__part", "start")
    placed = dealt.withColumn("local", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["conv_id", "__part"], "left")
    first = F.coalesce("start", F.lit(0)) + F.col("local")
    some = placed.select("conv_id", "said", "chars", "n", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("b"))
    last = F.least(F.col("n"), (F.col("b") + 1) * BLOCK) - 1
    return some.select("conv_id", F.explode(F.sequence(F.col("first") + F.col("b") * BLOCK + 1, F.col("first") + last + 1)).alias("pos"), "said", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, said, chars, ends) of each rebuilt turn, and (conv_id, n_turns) of every conversation."""
    length = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    borrowed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    bases = length.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("held"))
    known = length.withColumn("h", borrowed).withColumn("base", base).join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("held", F.lit(0))))
    plan = cut(known.select("conv_id", "base", "h", "b", (F.col("b") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n_turns")), "plan")
    # a family has at most 2 * FAMILY - 1 conversations and MOST - 1 turns to lend
    lent = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST)).select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "said", "chars")
    head = plan.join(lent, "base").where("d <= b").select("conv_id", "d", "said", "chars", (F.col("d") == F.col("n_turns")).alias("ends"))
    tail = turns.join(plan, "conv_id").where("pos > h").withColumn("d", F.col("pos") - F.col("h") + F.col("b")).select("conv_id", "d", "said", "chars", (F.col("d") == F.col("n_turns")).alias("ends"))
    return head.unionByName(tail), plan.select("conv_id", "n_turns")


def key_of(lanes: list[Column]) -> Column:
    """Sums modulo 2 ** 32, as hexadecimal digits."""
    return F.concat(*(F.lower(F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0")) for x in lanes))


def walks(turns: DataFrame) -> DataFrame:
    """conv_id, d, key, parent, chars and ends of each rebuilt turn."""
    digits = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), F.hex("said")), 256)
    lanes = {n: F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i, n in enumerate(LANES)}
    own = turns.withColumns(lanes | {f"own{i}": x for i, x in enumerate(lanes.values())}).drop("said")
    summed = running(own, "conv_id", "d", LANES)
    sums = [F.col(n) for n in LANES]
    return summed.select("conv_id", "d", key_of(sums).alias("key"), key_of([x - F.col(f"own{i}") for i, x in enumerate(sums)]).alias("parent"), "chars", "ends")


def node_table(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node, root included: key, parent, conv_id, depth, n_convs, n_children, leaf, saved (its own), head, level."""
    found = rows.groupBy("key").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("first"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"))
    everyone = conversations.agg(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.min("conv_id").alias("first"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("chars")).where("n_convs > 0")
    grouped = cut(found.unionByName(everyone), "nodes")
    largest = F.max(F.struct("n_convs", -F.col("first"), "key"))
    of_parent = cut(grouped.where("depth > 0").groupBy(F.col("parent").alias("__parent")).agg(F.count("*").alias("n_children"), largest["key"].alias("heavy")), "children")
    nodes = grouped.join(of_parent.select("__parent", "n_children"), F.col("key") == F.col("__parent"), "left").drop("__parent")
    nodes = nodes.join(of_parent.select("heavy"), F.col("key") == F.col("heavy"), "left").withColumn("light", F.col("heavy").isNull() & (F.col("depth") > 0)).drop("heavy")
    own = nodes.select("key", "parent", "first", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), "light")
    own = cut(own, "nodes")
    # along each walk: how many nodes are light so far, and the last of them; the smallest member's walk speaks for a node
    along = rows.select("conv_id", "d", "key").join(own.where("depth > 0"), "key").withColumn("level", F.col("light").cast("long")).withColumn("head", F.when(F.col("light"), F.col("key")))
    mine = running(along, "conv_id", "d", ["level"], ["head"]).where("conv_id = first")
    columns = ["key", "parent", F.col("first").alias("conv_id"), "depth", "n_convs", "n_children", "leaf", "saved"]
    top = own.where("depth = 0").select(*columns, F.lit(ROOT).alias("head"), F.lit(0).cast("long").alias("level"))
    trie = cut(mine.select(*columns, F.coalesce("head", F.lit(ROOT)).alias("head"), "level").unionByName(top), "trie")
    for spent in (grouped, of_parent, own):
        remove(spent)
    return trie


def path_totals(nodes: DataFrame) -> DataFrame:
    """up, leaves and saved of each path but the root's: the node it hangs on, and the sums of its head's subtree."""
    own = nodes.groupBy("head").agg(F.max("level").alias("level"), F.max(F.when(F.col("key") == F.col("head"), F.col("parent"))).alias("up"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    above = nodes.select(F.col("key").alias("up"), F.col("head").alias("up_head"))
    paths = cut(own.where("level > 0").join(above, "up"), "paths")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done, below = [], None
    for level in range(deepest, 0, -1):
        here = paths.where(F.col("level") == level)
        if below is not None:
            here = here.join(below.groupBy(F.col("up_head").alias("head")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("gain")), "head", "left")
            here = here.withColumns({"leaves": F.col("leaves") + F.coalesce("more", F.lit(0)), "saved": F.col("saved") + F.coalesce("gain", F.lit(0))}).drop("more", "gain")
        below = cut(here.select("head", "up", "up_head", "leaves", "saved"), "level")
        done.append(below)
    out = nodes.select(F.col("key").alias("up"), "leaf", "saved").where("false").withColumnRenamed("leaf", "leaves")
    for part in done:
        out = out.unionByName(part.select("up", "leaves", "saved"))
    return out


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """nodes with n_leaves and saved_tokens of their subtrees."""
    hanging = path_totals(nodes).groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
    held = nodes.join(hanging, "key", "left").withColumns({"n_leaves": F.col("leaf") + F.coalesce("__leaves", F.lit(0)), "saved_tokens": F.col("saved") + F.coalesce("__saved", F.lit(0))}).drop("__leaves", "__saved")
    # a path's positions have no gaps, though they begin anywhere
    return running(held, "head", "depth", ["n_leaves", "saved_tokens"], back=True)


def pieces(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """key, first and piece: members in ascending order, joined by commas, in pieces of about `most` bytes. rows: key, conv_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size = None, [], 0
        piece = lambda: pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "first", "piece"])
        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or size >= most):
                    yield piece()
                    ids, size = [], 0
                key = k
                ids.append(c)
                size += len(str(c)) + 1
        if ids:
            yield piece()

    return rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key string, first long, piece string")


def digests(parts: DataFrame) -> DataFrame:
    """key and ends_sha256, from pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if k != key:
                    done += [(key, state.hexdigest())] if state else []
                    key, state = k, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], names=["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return parts.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(run, "key string, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row for each node; rows: conv_id, turn, role, text."""
    turns = cut(positions(rows), "positions")
    said, conversations = rebuilt(turns)
    steps = cut(walks(said), "walks")
    remove(turns)
    nodes = node_table(steps, conversations)
    ends = steps.where("ends").select("key", "conv_id").unionByName(conversations.where("n_turns = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = subtree_sums(nodes).join(digests(pieces(ends)), "key", "left").join(parents, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def sql() -> str:
    """The same by whole sequences and joins with every descendant, for DuckDB."""
    byte = "case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"""
with recursive table_steps as (
  select range as n, cast(range as bigint) as c, 0 as step from range(256)
  union all select n, {byte}, step + 1 from table_steps where step < 8),
crc_table as (select list(c order by n) as t from table_steps where step = 8),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
convs as (
  select conv_id, own, conv_id - conv_id % {FAMILY} as base, xor(4294967295, list_reduce(
    list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % {MOST} as h
  from (select conv_id, max(pos) as own from turns group by conv_id), crc_table),
plan as (select convs.conv_id, convs.base, convs.h, least(convs.h, coalesce(b.own, 0)) as b from convs left join convs as b on b.conv_id = convs.base),
said as (
  select plan.conv_id, pos as d, role, text from plan join turns on turns.conv_id = base where pos <= b
  union all select plan.conv_id, pos - h + b, role, text from plan join turns using (conv_id) where pos > h),
walks as (
  select conv_id, 0 as d, cast([] as struct(r varchar, t varchar)[]) as seq, '' as text from convs
  union all select conv_id, d, list({{'r': role, 't': text}}) over (partition by conv_id order by d), text from said),
seqs as (select conv_id, d, seq, text, d = max(d) over (partition by conv_id) as ends from walks),
nodes as (
  select min(conv_id) as conv_id, d as depth, seq, any_value(text) as text, count(*) as n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '') as ends
  from seqs group by d, seq),
placed as (
  select nodes.conv_id, nodes.depth, p.conv_id as parent_conv_id
  from nodes left join seqs as s on s.conv_id = nodes.conv_id and s.d = nodes.depth - 1 left join nodes as p on p.depth = s.d and p.seq = s.seq),
children as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n from placed where parent_conv_id is not null group by 1, 2),
subtrees as (
  select top.conv_id, top.depth, count(*) filter (where c.n is null) as n_leaves, sum((u.n_convs - 1) * length(u.text)) as saved_tokens
  from nodes as top join seqs as s on s.d = top.depth and s.seq = top.seq join nodes as u on u.conv_id = s.conv_id and u.depth >= top.depth
  left join children as c on c.conv_id = u.conv_id and c.depth = u.depth group by 1, 2)
select nodes.conv_id, cast(nodes.depth as bigint) as depth, parent_conv_id, nodes.n_convs, coalesce(children.n, 0) as n_children, n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(nodes.ends) as ends_sha256
from nodes join placed using (conv_id, depth) join subtrees using (conv_id, depth) left join children using (conv_id, depth)
"""
