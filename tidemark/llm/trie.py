"""Prefix trie of rebuilt conversations, built as a burst trie.

A turn's id is a digest of its role and text (16 bytes); texts are never shuffled. Turns get their places from one range
sort and prefix sums over its partitions, so a conversation of any length is spread. Conversations are rebuilt (the first h
turns come from the first conversation of their group of 20), and equal ones become one path with a count, its smallest
member and a hash of the members that end there.

Paths live in containers under trie heads; the first container hangs under the root. A container of more than ``PATHS`` paths
or ``TURNS`` turns bursts: the head walks down to where its paths part, and each next turn id gets a container of its own.
When no container is oversized, each is sorted by its turn ids and swept: a path shares as many nodes with the one before it
as leading turns are equal. Sums over subtrees follow inside a container from its last node to its first, and over heads
from the last burst to the first.

A path has ``LONG`` turns at most. The rest of a longer conversation is a path of the next level, whose containers hang under
the node where the path before it ends; levels are built from the deepest up, and hand up what lies below such a node.

Rows with a null conv_id take no part. A null turn comes first; equal turns of a conversation are ordered by role, then by
digest of role and text, so repeated rows are turns of their own. Null roles and texts are empty. Conversations that stay
without a turn are members of the root. An empty table has no root, for a root needs a smallest member. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, with_part_offsets

#: A container bursts beyond so many paths or turns; a path holds ``LONG`` turns at most.
PATHS, TURNS, LONG = 1024, 1 << 16, 4096
#: Conversations of a group, whose first one lends its first turns; at most ``LENT - 1`` of them.
GROUP, LENT = 20, 4
#: Characters of joined ids in a row on their way into a hash.
JOINED = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "at binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _down(start, turns):
    """The id of the node that ``turns`` lead to from the node ``start``."""
    return F.aggregate(turns, start, lambda a, x: F.unhex(F.md5(F.concat(a, x))))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, tid, words): turns with their places, from 0, and the number of turns of their conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("tid"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"),
    )
    order = ["conv_id", "turn", "role", "tid"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(rows.select("conv_id", "tid", "words", "_at"))
    rows = rows.select("*", F.shiftright("_at", 33).alias("_part"), F.lit(1).alias("_one"))
    rows = with_part_offsets(rows, "_part", "_one", "_before").withColumn("_at", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
    return rows.select("conv_id", "_at", "tid", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, n), (conv_id, idx, tid, words)): rebuilt conversations with their lengths, and their turns."""
    rows = stored(turns(conversations))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    own = rows.groupBy("conv_id").agg(F.min("_at").alias("start"), F.count("*").alias("had"))
    own = own.select("*", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).alias("h"))
    lends = own.filter(F.col("conv_id") == F.col("base")).select("base", F.col("start").alias("base_start"), F.col("had").alias("base_had"))
    own = own.join(lends, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_had", F.lit(0))))
    own = stored(own.withColumn("n", F.col("taken") + F.greatest(F.col("had") - F.col("h"), F.lit(0))))
    placed = rows.join(own.select("conv_id", "start", "h", "taken"), "conv_id").withColumn("pos", F.col("_at") - F.col("start"))
    kept = placed.filter("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("idx"), "tid", "words")
    first = placed.filter((F.col("conv_id") == base) & (F.col("pos") < LENT - 1)).select(F.col("conv_id").alias("base"), "pos", "tid", "words")
    lent = own.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter("pos < taken")
    return own.select("conv_id", "n"), kept.unionByName(lent.select("conv_id", F.col("pos").alias("idx"), "tid", "words"))


def _joined(batches):
    """Sorted (key, conv_id) rows to (key, first, ids): ids of a key joined by commas, in rows of bounded length."""
    key, ids, size, out = None, [], 0, ([], [], [])

    def close():
        if ids:
            for column, value in zip(out, (key, ids[0], ",".join(map(str, ids)))):
                column.append(value)

    for b in batches:
        for k, c in zip(b["key"].to_pylist(), b["conv_id"].to_pylist()):
            if k != key or size > JOINED:
                close()
                key, ids, size = k, [], 0
            ids.append(c)
            size += 12
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["key", "first", "ids"])
        out = ([], [], [])
    close()
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["key", "first", "ids"])


def _hashed(batches):
    """Sorted (key, first, ids) rows to (key, ends): the hash of all ids of a key, fed row by row."""
    key, state = None, None
    for b in batches:
        keys, ends = [], []
        for k, ids in zip(b["key"].to_pylist(), b["ids"].to_pylist()):
            if k != key:
                if state is not None:
                    keys.append(key)
                    ends.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends"])


def ends_of(members: DataFrame) -> DataFrame:
    """(key, ends) from (key, conv_id): SHA-256 of each key's ids in ascending order.

    The hash is sequential by nature; ids are sorted and joined in parallel, and only joined rows reach its task."""
    rows = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = rows.mapInArrow(_joined, "key binary, first long, ids string")
    return blocks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


def swept(at, parent, depth: int, head_conv, paths: list, base: int) -> list[tuple]:
    """Rows of ``NODE`` for one container; ``paths`` are (seq, words, n, first, ends, x_children, x_leaves, x_saved),
    sorted by seq, all through the head at ``depth``. The head's own row comes first and bears ``at`` and ``parent``."""
    deep, up, word, n, first, kids, leaves, saved, ends = ([] for _ in range(9))

    def add(d, p, w):
        for column, value in ((deep, d), (up, p), (word, w), (n, 0), (first, None), (kids, 0), (leaves, 0), (saved, 0), (ends, NO_ENDS)):
            column.append(value)
        return len(deep) - 1

    way, before = [add(depth, -1, paths[0][1][depth - 1] if depth else 0)], paths[0][0][:depth]
    for seq, words, count, least, ended, x_children, x_leaves, x_saved in paths:
        same = depth
        while same < len(seq) and same < len(before) and seq[same] == before[same]:
            same += 1
        del way[same - depth + 1 :]
        for j in range(same, len(seq)):
            way.append(add(j + 1, way[-1], words[j]))
        i, before = way[-1], seq
        n[i] += count
        first[i] = least if first[i] is None else min(first[i], least)
        ends[i], kids[i], leaves[i], saved[i] = ended, x_children, x_leaves, x_saved
    for i in range(len(deep) - 1, -1, -1):  # children come after their parents
        leaves[i] = leaves[i] if kids[i] else 1
        saved[i] += (n[i] - 1) * word[i]
        if i:
            p = up[i]
            n[p] += n[i]
            first[p] = first[i] if first[p] is None else min(first[p], first[i])
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    over = [head_conv if depth == 0 and head_conv is not None else first[0], *first[1:]]
    return [
        (None if i else at, None if i else parent, first[i], base + deep[i], over[up[i]] if i else None, n[i], kids[i], leaves[i], saved[i], ends[i])
        for i in range(len(deep))
    ]


def _sweep(paths: DataFrame, base: int) -> DataFrame:
    def run(batches):
        schema = pa.schema([(x.split()[0], {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[x.split()[1]]) for x in NODE.split(", ")])
        place, held = None, []

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        for b in batches:
            found = []
            for at, parent, depth, head_conv, *path in zip(*(b[c].to_pylist() for c in ("at", "parent", "depth", "head_conv", *PATH))):
                if place is None or place[0] != at:
                    if held:
                        found += swept(*place, held, base)
                    place, held = (at, parent, depth, head_conv), []
                held.append(path)
                if len(found) > 50_000:
                    yield rows(found)
                    found = []
            if found:
                yield rows(found)
        if held:
            yield rows(swept(*place, held, base))

    return paths.repartition("at").sortWithinPartitions("at", "seq").mapInArrow(run, NODE)


PATH = ["seq", "words", "n", "first", "ends", "x_children", "x_leaves", "x_saved"]


def _burst(live: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(containers' paths, heads that burst, by round) of paths that hang under (at, depth, parent)."""
    rest, heads = [], []
    while True:
        size = live.groupBy("at", "depth", "parent", "head_conv").agg(
            F.count("*").alias("paths"), F.sum(F.size("seq") - F.col("depth")).alias("turns"), F.min(F.struct("seq", "words")).alias("low"),
            F.max("seq").alias("high"), F.sum("n").alias("n"), F.min("first").alias("conv_id"),
        )
        # the paths part where the smallest and the largest differ first
        part = F.array_position(F.zip_with("low.seq", "high", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int") - 1
        big = size.filter(f"paths > 1 and (paths > {PATHS} or turns > {TURNS})").withColumn("part", part)
        big = big.withColumn("bottom", _down(F.col("at"), F.expr("slice(low.seq, depth + 1, part - depth)")))
        weights = F.expr("if(depth = 0, concat(array(0), slice(low.words, 1, part)), slice(low.words, depth, part - depth + 1))")
        big = stored(big.select("at", "depth", "parent", "head_conv", "part", "bottom", weights.alias("weights"), "n", "conv_id"))
        rest.append(live.join(big.select("at"), "at", "left_anti"))
        if big.isEmpty():
            return rest, heads
        moved = live.drop("depth", "parent").join(big.select("at", "part", "bottom"), "at")
        ended = moved.filter(F.size("seq") == F.col("part")).select("bottom", *PATH[4:])  # one path at most
        heads.append(stored(big.join(ended, "bottom", "left")))
        following = F.unhex(F.md5(F.concat("bottom", F.expr("seq[part]"))))
        moved = moved.filter(F.size("seq") > F.col("part"))
        live = stored(moved.select(following.alias("at"), (F.col("part") + 1).alias("depth"), F.col("bottom").alias("parent"), F.lit(None).cast("long").alias("head_conv"), *PATH))


def _level(paths: DataFrame, base: int) -> DataFrame:
    """Rows of ``NODE`` for all heads of a level; the level's own roots bear ``at`` and have no parent."""
    start = paths.select(F.col("head").alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("parent"), "head_conv", *PATH)
    rest, heads = _burst(stored(start))
    nodes = stored(_sweep(reduce(DataFrame.unionByName, rest), base))
    tops = nodes.filter("at is not null and parent is not null")
    for found in reversed(heads):
        kids = tops.groupBy("parent").agg(F.count("*").alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        own = found.join(kids.withColumnRenamed("parent", "bottom"), "bottom")
        x = lambda c: F.coalesce(f"x_{c}", F.lit(0))
        own = own.select("*", (F.col("k") + x("children")).alias("children"), (F.col("l") + x("leaves")).alias("leaves"), (F.col("s") + x("saved")).alias("below"))
        own = own.select("*", F.posexplode("weights").alias("step", "weight"))
        last, tail = F.col("step") == F.col("part") - F.col("depth"), F.expr("aggregate(slice(weights, step + 1, size(weights)), 0L, (a, w) -> a + w)")
        top = F.col("step") == 0
        above = F.when(top, None).otherwise(F.when((F.col("step") == 1) & (F.col("depth") == 0), F.coalesce("head_conv", "conv_id")).otherwise(F.col("conv_id")))
        rows = own.select(
            F.when(top, F.col("at")).alias("at"), F.when(top, F.col("parent")).alias("parent"), "conv_id", (F.lit(base) + F.col("depth") + F.col("step")).cast("long").alias("depth"),
            above.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n") - 1) * tail).alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        )
        rows = stored(rows)
        nodes, tops = nodes.unionByName(rows), tops.unionByName(rows.filter("at is not null and parent is not null"))
    if heads:  # tops take their parents' conversation from the heads they hang under
        over = F.when((F.col("depth") == 0) & (F.col("part") == 0), F.coalesce("head_conv", "conv_id")).otherwise(F.col("conv_id"))
        known = reduce(DataFrame.unionByName, (x.select(F.col("bottom").alias("parent"), over.alias("_over")) for x in heads))
        nodes = nodes.join(known, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_over")).drop("_over")
    return nodes


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row of ``RESULT`` per node."""
    lengths, rows = rebuilt(conversations)
    held = rows.groupBy("conv_id", F.floor(F.col("idx") / LONG).cast("int").alias("level")).agg(F.sort_array(F.collect_list(F.struct("idx", "tid", "words"))).alias("s"))
    held = held.select("conv_id", "level", F.expr("transform(s, x -> x.tid)").alias("seq"), F.expr("transform(s, x -> x.words)").alias("words"))
    bare = lengths.filter("n = 0").selectExpr("conv_id", "0 as level", "cast(array() as array<binary>) as seq", "cast(array() as array<int>) as words")
    held = stored(held.unionByName(bare).join(lengths, "conv_id"))
    deepest = held.agg(F.max("level")).first()[0]
    if deepest is None:
        return conversations.sparkSession.createDataFrame([], NODE).select(*RESULT)
    paths, key = [], None
    for level in range(deepest + 1):
        part = held.filter(F.col("level") == level)
        if level == 0:
            part = part.withColumns({"head": F.lit(b"root"), "head_conv": F.lit(None).cast("long")})
        else:  # what the paths of the level above lead to, with that node's smallest member
            node = paths[-1].select(F.col("key").alias("head"), F.col("first").alias("head_conv"))
            part = part.join(key.select("conv_id", F.col("key").alias("head")), "conv_id").join(node, "head")
        key = stored(part.withColumn("key", _down(F.col("head"), F.col("seq"))))
        ends = ends_of(key.filter(F.col("n") <= (level + 1) * LONG).select("key", "conv_id"))
        found = key.groupBy("head", "head_conv", "key").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
        paths.append(stored(found.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))))
    out, below = None, None
    for level in range(deepest, -1, -1):
        p = paths[level]
        if below is not None:
            p = p.join(below, "key", "left")
        else:
            p = p.withColumns({f"x_{c}": F.lit(0) for c in ("children", "leaves", "saved")})
        p = p.withColumns({f"x_{c}": F.coalesce(f"x_{c}", F.lit(0)).cast("long") for c in ("children", "leaves", "saved")})
        nodes = _level(p, level * LONG)
        root = F.col("at").isNotNull() & F.col("parent").isNull()
        below = nodes.filter(root).select(F.col("at").alias("key"), F.col("n_children").alias("x_children"), F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"))
        rows = nodes.select(*RESULT) if level == 0 else nodes.filter(~root).select(*RESULT)
        out = rows if out is None else out.unionByName(rows)
    return out
