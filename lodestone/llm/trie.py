"""Prefix trie of conversations (operator 11).

Turns become 128-bit ids, so texts are hashed where they are read and never moved. Conversations, cut into strips of
WIDTH turns, are dealt by range into shards of rows in order; a shard is a padded matrix of turn ids, sorted
by ``np.lexsort``. A row's change mask against the row before, OR-accumulated over the columns, tells how many turns
both share, so it marks where the node of each depth starts, and ``reduceat`` over these starts adds up every depth. All sums
of a node are sums over its rows:

* a row starts a child below depth d if it shares d turns or fewer with the row before and has more;
* a leaf ends at each row that shares less than itself with the row after;
* a turn shared with the row before is one that a cache need not read again.

Each shard also sees the last row of the shard before it and the first of the one after, so these counts are exact at
its edges too; nodes that reach over an edge, at most two for each depth, are added up over the shards. Strips after the first start
with a digest of all turns before them; what they hold is added to the rows of the strips above. No row is ever longer than
a strip, and a sequence that many conversations share is dealt over shards by conv_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.textbytes import buffer_of
from lodestone.operators.ordering import numbered
from lodestone.runtime import materialize, push, small, spread_join

#: Turns of a strip, and rows of a shard: a shard's matrix has at most WIDTH * SHARD_ROWS ids, but for the sampling's error.
WIDTH, SHARD_ROWS = 64, 1 << 15
#: Conversations of a family, of so many consecutive ids, begin like its first one.
FAMILY, MOST_SHARED = 100, 6
ID_BYTES = 16
NOTHING = hashlib.sha256(b"").hexdigest()

PARTS = (
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "node string, parent string, first_end long, ends string, shown boolean"
)
ROWS = "conv_id long, strip long, leaf long, saved long, child long"
_ORDER = ["strip", "p_hi", "p_lo", "key", "conv_id"]
_HELD = [*_ORDER, "chars", "ends", "deep_leaf", "deep_saved", "next_child"]


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rn, id, chars): all turns in order of conversation and turn; ties go by role, then text."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Texts are moved only where the turn's number and role leave the order open.
    tied = materialize(rows.groupBy("conv_id", "turn", "role").count().where("count > 1").select("conv_id", F.struct("turn", "role").alias("at"), F.lit(True).alias("tied")), "tied")
    tie = F.lit("")
    if not tied.isEmpty():
        rows = rows.withColumn("at", F.struct("turn", "role"))
        t = small(tied.withColumnsRenamed({"conv_id": "t_conv", "at": "t_at"}))
        rows = rows.join(t, (F.col("conv_id") == F.col("t_conv")) & F.col("at").eqNullSafe(F.col("t_at")), "left")
        tie = F.when(F.col("tied"), F.col("text")).otherwise("")
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    short = rows.select("conv_id", "turn", "role", tie.alias("tie"), F.substring(name, 1, 2 * ID_BYTES).alias("id"), F.length("text").cast("long").alias("chars"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie"), F.asc("id")]
    return numbered(short, order).select("conv_id", "rn", "id", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (conv_id, pos, id, chars, len) and all conversations (conv_id, len), the turnless too.

    Conversation c begins with the first h turns of conversation c - c % FAMILY (all if it has fewer, none if there is no such
    conversation) and goes on with its own turns after its first h; h is the CRC-32 of c's decimal digits modulo MOST_SHARED.
    """
    placed = _turns(conversations)
    c = F.col("conv_id")
    base = c - c % FAMILY
    found = placed.groupBy("conv_id").agg(F.min("rn").alias("start"), F.count(F.lit(1)).alias("n"))
    found = found.withColumn("base", base).withColumn("h", F.crc32(c.cast("string").cast("binary")) % MOST_SHARED)
    found = materialize(found, "conversations")
    bases = found.where(c == F.col("base")).select("base", F.col("n").alias("base_n"))
    given = F.when(c == F.col("base"), F.least("h", "n")).otherwise(F.least("h", F.coalesce("base_n", F.lit(0))))
    info = found.join(bases, "base", "left").withColumn("given", given).withColumn("len", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    info = materialize(info.select("conv_id", "base", "start", "n", "h", "given", "len"), "conversations")
    own = spread_join(placed, info.drop("base"), ["conv_id"], "n", "rn").withColumn("pos", F.col("rn") - F.col("start"))
    tails = own.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "id", "chars", "len")
    first = own.where((c % FAMILY == 0) & (F.col("pos") < MOST_SHARED)).select(c.alias("base"), "pos", "id", "chars")
    heads = info.select("conv_id", "base", "given", "len").join(first, "base").where("pos < given").select("conv_id", "pos", "id", "chars", "len")
    return tails.unionByName(heads), info.select("conv_id", "len")


def _strips(turns: DataFrame, all_convs: DataFrame, width: int) -> DataFrame:
    """One row for each conversation and strip; a conversation whose length is a whole number of strips has an empty one at its end."""
    strip = F.floor(F.col("pos") / width)
    packed = F.sort_array(F.collect_list(F.struct("pos", "id", "chars")))
    rows = turns.groupBy("conv_id", strip.alias("strip")).agg(packed.alias("t"), F.max("len").alias("len"))
    rows = rows.select("conv_id", "strip", F.unhex(F.array_join(F.transform("t", lambda x: x["id"]), "")).alias("key"), F.transform("t", lambda x: x["chars"]).alias("chars"), "len")
    empty = all_convs.where(F.col("len") % width == 0).select("conv_id", F.floor(F.col("len") / width).alias("strip"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("chars"), "len")
    rows = rows.unionByName(empty).withColumn("ends", F.col("len") <= (F.col("strip") + 1) * width)
    zero = F.lit(0).cast("long")
    if all_convs.where(F.col("len") >= width).isEmpty():
        return rows.withColumn("p_hi", zero).withColumn("p_lo", zero)
    # What went before a strip: digests of its strips, each mixed with its number.
    before = Window.partitionBy("conv_id").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)

    def prefix(seed: int):
        digest = F.xxhash64(F.sha2("key", 256), "strip", F.lit(seed))
        return F.coalesce(F.expr("bit_xor(_d)").over(before), zero), digest

    for name, seed in (("p_hi", 1), ("p_lo", 2)):
        total, digest = prefix(seed)
        rows = rows.withColumn("_d", digest).withColumn(name, total)
    return rows.drop("_d")


def _dealt(strips: DataFrame, shard_rows: int) -> DataFrame:
    """The strips by shard, in ranges of their order, with copies (ghost -1 and 1) of the rows before and after each shard."""
    n = strips.count()
    held = materialize(strips.select(*_HELD).repartitionByRange(n // shard_rows + 1, *_ORDER).withColumn("shard", F.spark_partition_id()), "shards")
    row = F.struct(*_HELD)
    heads = held.groupBy("shard").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    by = Window.orderBy("shard")  # one row for each shard
    near = heads.select("shard", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    near = near.select("shard", F.explode(F.array(F.struct(F.lit(-1).alias("ghost"), F.col("before").alias("r")), F.struct(F.lit(1).alias("ghost"), F.col("after").alias("r")))).alias("x"))
    ghosts = near.where("x.r is not null").select("shard", "x.ghost", "x.r.*")
    return held.withColumn("ghost", F.lit(0)).unionByName(ghosts)


class _Shard:
    """The padded matrix of a shard in order, and how many turns each row shares with the row before."""

    def __init__(self, t: pa.Table):
        def whole(name: str) -> np.ndarray:
            return t.column(name).to_numpy(zero_copy_only=False)

        buf, off = buffer_of(t.column("key"))
        n, lens = t.num_rows, np.diff(off) // ID_BYTES
        self.width = int(lens.max(initial=0))
        ids = np.zeros((n, 2 * self.width), np.uint64)
        owner = np.repeat(np.arange(n), 2 * lens)
        at = np.arange(len(owner)) - np.repeat(2 * (np.cumsum(lens) - lens), 2 * lens)
        ids[owner, at] = buf.view(">u8")
        chars = np.zeros((n, self.width), np.int64)
        flat = t.column("chars").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        chars[owner[::2], at[::2] // 2] = flat
        group = np.column_stack([whole(c).astype(np.int64) for c in ("strip", "p_hi", "p_lo")])
        conv = whole("conv_id").astype(np.int64)
        order = np.lexsort((conv, lens, *ids.T[::-1], *group.T[::-1]))
        ids, self.chars, group, self.lens, self.conv = ids[order], chars[order], group[order], lens[order], conv[order]
        self.group, self.key, self.off, self.order = group, buf, off, order
        column = np.arange(self.width)
        change = (ids[1:, ::2] != ids[:-1, ::2]) | (ids[1:, 1::2] != ids[:-1, 1::2]) | (column >= np.minimum(self.lens[1:], self.lens[:-1])[:, None])
        shared = (~np.logical_or.accumulate(change, axis=1)).sum(axis=1)
        other = (group[1:] != group[:-1]).any(axis=1)
        self.shared = np.concatenate(([-1], np.where(other, -1, shared)))[:n]
        self.shared_after = np.concatenate((self.shared[1:], [-1]))[:n]
        real = np.flatnonzero(whole("ghost")[order] == 0)
        self.low, self.high = (int(real[0]), int(real[-1]) + 1) if len(real) else (0, 0)
        self.ends = whole("ends")[order].astype(bool)
        self.deep = {c: whole(c)[order].astype(np.int64) for c in ("deep_leaf", "deep_saved", "next_child")}

    def saved(self) -> np.ndarray:
        """For each row and depth, the characters of turns from that depth on that it shares with the row before."""
        repeated = np.where(np.arange(self.width) < self.shared[:, None], self.chars, 0)
        out = np.cumsum(repeated[:, ::-1], axis=1)[:, ::-1]
        return np.column_stack([out[:, :1] if self.width else np.zeros((len(out), 1), np.int64), out])

    def leaves(self, width: int) -> np.ndarray:
        return ((self.lens < width) & (self.shared_after < self.lens)).astype(np.int64)

    def name(self, row: int, depth: int) -> str:
        at = self.off[self.order[row]]
        strip, hi, lo = self.group[row]
        return f"{strip}:{hi}:{lo}:{depth}:{hashlib.sha256(self.key[at : at + ID_BYTES * depth].tobytes()).hexdigest()}"


def _row_sums(width: int):
    """What each strip adds to the strips above it in its conversation."""

    def run(t: pa.Table) -> pa.Table:
        m = _Shard(t)
        cut = slice(m.low, m.high)
        child = ((m.shared <= 0) & (m.lens > 0)).astype(np.int64)
        cols = [m.conv, m.group[:, 0], m.leaves(width), m.saved()[:, 0], child]
        return pa.table([pa.array(c[cut], pa.int64()) for c in cols], names=["conv_id", "strip", "leaf", "saved", "child"])

    return run


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _nodes(width: int):
    """All nodes of a shard, whole ones and the parts of those that reach over its edges."""

    def run(t: pa.Table) -> pa.Table:
        m = _Shard(t)
        low, high, names = m.low, m.high, [x.split()[0] for x in PARTS.split(", ")]
        out: dict[str, list] = {c: [] for c in names}
        n = high - low
        if n:
            shared, lens, conv, strip, ends = m.shared[low:high], m.lens[low:high], m.conv[low:high], m.group[low:high, 0], m.ends[low:high]
            saved, leaves = m.saved()[low:high] + m.deep["deep_saved"][low:high, None], m.leaves(width)[low:high] + m.deep["deep_leaf"][low:high]
            after = m.shared_after[high - 1]
            for depth in range(m.width + 1):
                cuts = shared < depth
                cuts[0] = True
                first = np.flatnonzero(cuts)
                last = np.append(first[1:], n)
                child = m.deep["next_child"][low:high] if depth == width else ((shared <= depth) & (lens > depth)).astype(np.int64)
                smallest = np.minimum.reduceat(conv, first)
                is_open = np.zeros(len(first), bool)
                is_open[0] = shared[0] >= depth
                is_open[-1] |= after >= depth
                here = lens[first] >= depth
                label = {k: m.name(low + first[k], depth) for k in np.flatnonzero(is_open & here)}
                if depth:
                    up = np.searchsorted(above[0], first, "right") - 1
                    parents = np.where(above[2][up], 0, above[1][up])
                ending = ends & (lens == depth)
                shown = (strip[first] == 0) if depth == 0 else np.ones(len(first), bool)
                take = np.flatnonzero(here & (shown | is_open))
                n_ends = np.add.reduceat(ending.astype(np.int64), first)[take]
                digests, lists, firsts = [NOTHING] * len(take), [None] * len(take), [None] * len(take)
                for j in np.flatnonzero(n_ends):
                    k = take[j]
                    members = conv[first[k] : last[k]][ending[first[k] : last[k]]]
                    if is_open[k]:
                        lists[j], firsts[j] = _joined(members), int(members[0])
                    else:
                        digests[j] = hashlib.sha256(_joined(members).encode()).hexdigest()
                out["depth"].append(strip[first][take] * width + depth)
                out["conv_id"].append(smallest[take])
                out["n_convs"].append((last - first)[take])
                for name, values in (("n_children", child), ("n_leaves", leaves), ("saved_tokens", saved[:, depth])):
                    out[name].append(np.add.reduceat(values, first)[take])
                out["ends_sha256"] += digests
                out["node"] += [label.get(k) for k in take]
                if depth:
                    out["parent_conv_id"] += [None if o else int(p) for o, p in zip(above[2][up][take], parents[take])]
                    out["parent"] += [above[3].get(u) for u in up[take]]
                else:
                    out["parent_conv_id"] += [None] * len(take)
                    out["parent"] += [None] * len(take)
                out["first_end"] += firsts
                out["ends"] += lists
                out["shown"].append(shown[take])
                above = first, smallest, is_open, label
        cols = []
        for field in PARTS.split(", "):
            name, kind = field.split()
            parts, to = out[name], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[kind]
            cols.append(pa.array(np.concatenate(parts) if parts and isinstance(parts[0], np.ndarray) else parts, to))
        return pa.table(cols, names=names)

    return run


def _hashed_ends(batches):
    """(node, ends_sha256) of lists that come in order of node and place: one running hash, whatever a node's length."""
    node, running = None, None
    for batch in batches:
        done = []
        for name, part in zip(batch.column("node").to_pylist(), batch.column("ends")):
            if name == node:
                running.update(b",")
            else:
                if node is not None:
                    done.append((node, running.hexdigest()))
                node, running = name, hashlib.sha256()
            running.update(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], names=["node", "ends_sha256"])


def prefix_trie(turns: DataFrame, conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, pos, id, chars, len), over ``conversations`` (conv_id, len) with their lengths.

    ``id`` is a turn's 32 hexadecimal digits, equal only for equal turns; pos runs from 0 to len - 1 in each conversation.
    """
    strips = materialize(_strips(turns, conversations, width), "strips")
    zero = F.lit(0).cast("long")
    deep = strips.where("strip > 0")
    plain = {"deep_leaf": zero, "deep_saved": zero, "next_child": zero}
    if deep.isEmpty():
        strips = strips.withColumns(plain)
    else:
        sums = _dealt(deep.withColumns(plain), shard_rows).groupBy("shard").applyInArrow(_row_sums(width), ROWS)
        below = Window.partitionBy("conv_id").orderBy(F.desc("strip")).rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.select("conv_id", (F.col("strip") - 1).alias("strip"), F.sum("leaf").over(below).alias("deep_leaf"), F.sum("saved").over(below).alias("deep_saved"), F.col("child").alias("next_child"))
        strips = strips.join(small(materialize(sums, "deep")), ["conv_id", "strip"], "left").na.fill(0, list(plain))
    parts = materialize(_dealt(strips, shard_rows).groupBy("shard").applyInArrow(_nodes(width), PARTS), "nodes")
    pieces = parts.where("node is not null")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = materialize(pieces.groupBy("node").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("parent").alias("parent"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("shown").alias("shown")), "open")
    lists = pieces.where("ends is not null").select("node", "first_end", F.col("ends").cast("binary").alias("ends"))
    ends = lists.repartition("node").sortWithinPartitions("node", "first_end").mapInArrow(_hashed_ends, "node string, ends_sha256 string")
    merged = merged.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = parts.where("node is null").select(*final, "parent").unionByName(merged.where("shown").select(*final, "parent"))
    owners = materialize(merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("owner")), "owners")
    given = push(whole.where("parent is not null"), owners, ["parent"], "conv_id").withColumn("parent_conv_id", F.col("owner"))
    return whole.where("parent is null").select(*final).unionByName(given.select(*final))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node over the rebuilt conversations.

    Turns are ordered by turn, null first, then by role and text, so repeated rows are turns of their own; null role and text count as
    empty and very long texts count whole. Rows with a null conv_id belong to no conversation and are left out; extra columns are
    ignored; an empty table has no nodes, not even a root.
    """
    return prefix_trie(*rebuilt(conversations))


def oracle() -> str:
    """Every prefix of every rebuilt conversation, and each node joined with the nodes below it."""
    bit = "list_reduce(list_prepend(xor(c, x), range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    text = "CAST(conv_id AS VARCHAR)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, x: {bit}), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc} % {MOST_SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
s AS (SELECT conv_id, length(text) AS chars, sha256(concat(length(role), ':', role, text)) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
p AS (SELECT conv_id, depth, chars, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY 1),
n AS (SELECT p.path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, max(len) = p.depth AS leaf, coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (len = p.depth), '') AS ends FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY p.path, p.depth),
d AS (SELECT DISTINCT a.path AS top, b.path AS path, b.depth AS depth FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
u AS (SELECT d.top, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (n.leaf) AS leaves FROM d JOIN n ON n.path = d.path GROUP BY 1),
k AS (SELECT left(path, 64 * (depth - 1)) AS up, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u ON u.top = n.path LEFT JOIN n m ON n.depth > 0 AND m.path = left(n.path, 64 * (n.depth - 1)) LEFT JOIN k ON k.up = n.path"""
