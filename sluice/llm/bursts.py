"""Prefix trie of conversations by burst tries.

Turns get 256-bit ids (SHA-256 of role and text; equal ids count as equal turns).  A
conversation is cut into segments of SEGMENT turns, so a very long one is many short rows; a
segment hangs below the node that its predecessor ends at.  Equal segments under one node are
one suffix with a count.

Suffixes start in one container per segment root.  A container with more than LIMIT suffixes
bursts: its top becomes a trie head and its suffixes move to one container per next turn id.
Several levels burst in one round (2, 4, 16, ... of them), so the number of rounds follows
the logarithm of SEGMENT.  Containers that stay are dealt out by key, sorted by turn ids and
swept into nodes by one stack of open nodes; a task holds at most LIMIT rows that wait for
their parent.  Heads add up their containers in a grouped sum.

Turns are numbered along a range partitioning and conversations of any length are laid in
many tasks.  The lists of members that end at a node are hashed from blocks of BLOCK ids, in
their order, as a stream.

Rebuilding: a conversation of id c takes the first h turns of conversation c - c % 5, then its
own turns after the first h; h is crc32 of the decimal c, modulo 9.  ``%`` truncates.

Defined cases: NULL role or text is empty; a NULL turn comes first; turns of equal number are
ordered by role, then text; repeated rows are repeated turns; rows without conv_id belong to no
conversation; no rows give no nodes.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import cut
from sluice.operators.ranges import dense_index
from sluice.operators.skew import lookup

SEGMENT = 256
LIMIT = 1024
BLOCK = 4096
MOST_SHARED = 8
FAMILY = 5
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------- conversations

def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, depth, turn_id, bytes, length)`` of all rebuilt turns, and ``(conv, length)``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", role.alias("role"),
        text.alias("text"))
    named = own.withColumns({
        "turn_id": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
                          .cast("binary"), 256),
        "bytes": F.octet_length("text").cast("bigint")})
    placed = dense_index(named, ["conv", "turn", "role", "text"], ["conv", "turn_id", "bytes"],
                         index="at")
    sizes = cut(placed.groupBy("conv").agg(F.min("at").alias("first"),
                                           F.count(F.lit(1)).alias("n")), "conversations")
    crc = F.crc32(F.col("conv").cast("string").cast("binary"))
    shared = sizes.select("*", F.pmod(crc, F.lit(MOST_SHARED + 1)).alias("h"),
                          (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    # At most 2 * FAMILY - 1 conversations have one base.
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint")))
    convs = cut(shared.join(bases, "base", "left").select(
        "conv", "base", "first", "n", "h", taken.alias("taken"),
        (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("bigint"))).alias("length")),
        "rebuilt")
    facts = convs.select("conv", "first", "h", "taken", "length")
    known = cut(lookup(placed, facts, ["conv"], spread=["at"],
                       weights=convs.select("conv", F.col("n").alias("_n")))
                .withColumn("pos", F.col("at") - F.col("first") + 1), "turns")
    later = known.filter(F.col("pos") > F.col("h")).select(
        "conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "turn_id", "bytes",
        "length")
    early = (known.filter(F.col("pos") <= MOST_SHARED)
             .select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "turn_id", "bytes")
             .join(convs.select("conv", "base", "h", "length"), "base")
             .filter(F.col("depth") <= F.col("h")))
    columns = ["conv", "depth", "turn_id", "bytes", "length"]
    return later.select(*columns).unionByName(early.select(*columns)), convs.select(
        "conv", "length")


def segments(turns: DataFrame, convs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``(conv, k, head, head_bytes, ids, sizes, last)``: the k-th ``size`` turns of each.

    Each conversation has length div size + 1 of them; the last one may be empty.  ``head``
    names the node that a segment hangs below ('' for the root).
    """
    turn = F.struct("depth", "turn_id", "bytes")
    k = F.floor((F.col("depth") - 1) / size).cast("int")
    full = turns.groupBy("conv", k.alias("k"), "length").agg(
        F.array_sort(F.collect_list(turn)).alias("t"))
    parts = full.select("conv", "k", "length", F.transform("t", lambda x: x["turn_id"]).alias("ids"),
                        F.transform("t", lambda x: x["bytes"]).alias("sizes"))
    ended = convs.filter(F.col("length") % size == 0).select(
        "conv", (F.col("length") / size).cast("int").alias("k"), "length",
        F.array().cast("array<string>").alias("ids"), F.array().cast("array<bigint>").alias("sizes"))
    parts = cut(parts.unionByName(ended), "segments").withColumn(
        "last", F.col("k") == F.floor(F.col("length") / size))
    whole = parts.filter(F.col("length") < size).select(
        "conv", "k", F.lit("").alias("head"), F.lit(0).cast("bigint").alias("head_bytes"), "ids",
        "sizes", "last")
    # What came before a segment: a running exclusive or of hashes of segments with their numbers.
    before = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    joined = F.array_join("ids", "")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "k", joined)).over(before) for seed in (1, 2)]
    head = F.coalesce(F.concat(F.hex(marks[0]), F.lit("-"), F.hex(marks[1])), F.lit(""))
    previous = F.lag(F.try_element_at("sizes", F.lit(-1))).over(
        Window.partitionBy("conv").orderBy("k"))
    cut_up = parts.filter(F.col("length") >= size).select(
        "conv", "k", head.alias("head"),
        F.coalesce(previous, F.lit(0).cast("bigint")).alias("head_bytes"), "ids", "sizes", "last")
    return whole.unionByName(cut_up)


def key(depth: Column) -> Column:
    """Name of the node ``depth`` turns into a segment."""
    return F.sha2(F.concat_ws("|", F.col("k").cast("string"), "head",
                              F.array_join(F.slice("ids", F.lit(1), depth.cast("int")), ""))
                  .cast("binary"), 256)


# ----------------------------------------------------- members that end at a node

def ends(enders: DataFrame) -> DataFrame:
    """``(suffix, sha)``: hash of the decimal ids of each suffix's members, in their order."""
    def flush(suffix, ids):
        return pa.RecordBatch.from_pydict({
            "suffix": [suffix], "first": pa.array([ids[0]], pa.int64()),
            "text": [",".join(map(str, ids))]})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffix, ids = None, []
        for batch in batches:
            for s, c in zip(batch.column("suffix").to_pylist(), batch.column("conv").to_pylist()):
                if ids and (s != suffix or len(ids) == BLOCK):
                    yield flush(suffix, ids)
                    ids = []
                suffix = s
                ids.append(c)
        if ids:
            yield flush(suffix, ids)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffix, state = None, None
        for batch in batches:
            for s, text in zip(batch.column("suffix").to_pylist(), batch.column("text").to_pylist()):
                if s != suffix:
                    if state:
                        yield pa.RecordBatch.from_pydict({"suffix": [suffix],
                                                          "sha": [state.hexdigest()]})
                    suffix, state = s, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if state:
            yield pa.RecordBatch.from_pydict({"suffix": [suffix], "sha": [state.hexdigest()]})

    in_order = enders.repartitionByRange("suffix", "conv").sortWithinPartitions("suffix", "conv")
    packed = in_order.select("suffix", "conv").mapInArrow(
        blocks, "suffix string, first bigint, text string")
    return packed.repartition("suffix").sortWithinPartitions("suffix", "first").mapInArrow(
        chain, "suffix string, sha string")


def suffixes(parts: DataFrame) -> DataFrame:
    """Equal segments under one node as one row, with its members' figures.

    ``more_leaves`` and ``more_saved`` of a segment are what its conversation adds from below.
    """
    one = parts.withColumn("suffix", key(F.size("ids")))
    last = F.col("last")
    grouped = one.groupBy("suffix", "k", "head", "head_bytes", "ids", "sizes").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep"),
        F.count_if(last).alias("n_end"), F.min(F.when(last, F.col("conv"))).alias("first_end"),
        F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    grouped = cut(grouped, "suffixes")
    shared = grouped.filter(F.col("n_end") > 1).select("suffix", F.lit(True).alias("many"),
                                                       F.col("n_end").alias("_n"))
    enders = lookup(one.filter(last).select("suffix", "conv"), shared, ["suffix"],
                    spread=["conv"]).filter("many")
    listed = grouped.join(ends(enders), "suffix", "left")
    own = F.when(F.col("n_end") == 1, F.sha2(F.col("first_end").cast("string").cast("binary"), 256))
    return listed.select("suffix", "k", "head", "head_bytes", "ids", "sizes", "n", "rep",
                         F.coalesce("sha", own).alias("end_sha"), "more_leaves", "more_saved")


# --------------------------------------------------------------- burst and sweep

def burst(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``at``, the depth of the container a suffix ends up in, and ``over``: whether it
    ends at a trie head instead, being used up there."""
    going = rows.withColumn("at", F.lit(0))
    settled, reach = None, 1
    while True:
        going = cut(going, "burst")
        explored = going.select("suffix", F.explode(F.transform(
            F.sequence("at", F.least(F.col("at") + reach, F.size("ids"))), key)).alias("box"))
        heads = cut(explored.groupBy("box").agg(F.count(F.lit(1)).alias("_n"))
                    .filter(F.col("_n") > limit), "heads")
        marked = lookup(explored, heads.withColumn("head_here", F.lit(True)), ["box"],
                        spread=["suffix"])
        # A head's prefixes are heads: their number is how far the suffix moves.
        moved = marked.groupBy("suffix").agg(F.count_if("head_here").alias("moved"))
        now = going.join(moved, "suffix").select(
            *rows.columns, (F.col("at") + F.col("moved")).cast("int").alias("at"),
            ((F.col("moved") == reach + 1) & (F.col("at") + reach < F.size("ids"))).alias("open"))
        now = cut(now, "burst")
        done = now.filter(~F.col("open")).select(
            *rows.columns, F.least("at", F.size("ids")).alias("at"),
            (F.col("at") > F.size("ids")).alias("over"))
        settled = done if settled is None else settled.unionByName(done)
        going = now.filter("open").drop("open")
        if going.isEmpty():
            return settled
        reach = 3 if reach == 1 else reach * 4


NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved bigint, end_sha string, k int, level int, head string, "
        "head_bytes bigint, top boolean, ids array<string>, sizes array<bigint>")


class Open:
    """A node of the sweep whose subtree is not complete yet."""

    __slots__ = ("n", "rep", "children", "leaves", "saved", "end_sha", "waiting")

    def __init__(self) -> None:
        self.n, self.rep, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.end_sha, self.waiting = None, []

    def add(self, n: int, rep: int, leaves: int, saved: int) -> None:
        self.n += n
        self.rep = rep if self.rep is None else min(self.rep, rep)
        self.leaves += leaves
        self.saved += saved


def sweep(records: Iterator[dict], size: int) -> Iterator[list]:
    """Nodes of containers whose suffixes come one after the other, sorted by turn ids.

    A row that waits for its parent's smallest member is given out when the parent closes.
    A segment's full length is a node of the next segment: its row only tells the parent.
    """
    stack: list[Open] = []
    now: dict = {}

    def close() -> Iterator[list]:
        level = now["at"] + len(stack) - 1
        node = stack.pop()
        for row in node.waiting:
            row[2] = node.rep
            yield row
        if level == size:
            leaves, saved = node.leaves, node.saved
        else:
            turn = now["sizes"][level - 1] if level else now["head_bytes"]
            leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * turn
        row = [node.rep, now["k"] * size + level, None, node.n, node.children, leaves, saved,
               node.end_sha, now["k"], level, now["head"], now["head_bytes"], not stack, None, None]
        if stack:
            stack[-1].add(node.n, node.rep, leaves, saved)
            stack[-1].children += 1
            stack[-1].waiting.append(row)
        else:
            row[13], row[14] = now["ids"][:level], now["sizes"][:level]
            yield row

    for r in records:
        same = 0
        if stack and r["box"] == now["box"]:
            both = min(len(now["ids"]), len(r["ids"]))
            while same < both and now["ids"][same] == r["ids"][same]:
                same += 1
            keep = same - r["at"] + 1
        else:
            keep = 0
        while len(stack) > keep:
            yield from close()
        now = r
        while r["at"] + len(stack) <= len(r["ids"]):
            stack.append(Open())
        stack[-1].add(r["n"], r["rep"], r["more_leaves"], r["more_saved"])
        stack[-1].end_sha = r["end_sha"]
    while stack:
        yield from close()


def _swept(contained: DataFrame, size: int) -> DataFrame:
    names = ["box", "k", "head", "head_bytes", "at", "ids", "sizes", "n", "rep", "end_sha",
             "more_leaves", "more_saved"]
    kinds = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()),
                       ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                       ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                       ("saved", pa.int64()), ("end_sha", pa.string()), ("k", pa.int32()),
                       ("level", pa.int32()), ("head", pa.string()), ("head_bytes", pa.int64()),
                       ("top", pa.bool_()), ("ids", pa.list_(pa.string())),
                       ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (dict(zip(names, values)) for b in batches
                   for values in zip(*(b.column(c).to_pylist() for c in names)))
        rows: list[list] = []
        for row in sweep(records, size):
            rows.append(row)
            if len(rows) == BLOCK:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    dealt = (contained.withColumn("box", key(F.col("at"))).select(*names).repartition("box")
             .sortWithinPartitions("box", "ids"))
    return cut(dealt.mapInArrow(run, NODE), "swept")


def trie(rows: DataFrame, limit: int = LIMIT, size: int = SEGMENT) -> DataFrame:
    """Nodes of all segments: the columns of the result and ``(k, level)``, ``parent_conv_id``
    still open for the first node of a later segment."""
    placed = cut(burst(rows, limit), "placed")
    swept = _swept(placed.filter(~F.col("over")), size)
    tops, used_up = swept.filter("top"), placed.filter("over")

    def levels(stop: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), stop), lambda j: j <= stop)

    def add_up(parts: DataFrame, stop: Column, figures: dict[str, Column]) -> DataFrame:
        """One row per trie head on the way to each of ``parts``."""
        paths = F.transform(levels(stop), lambda j: F.struct(
            j.alias("level"), key(j).alias("box"), F.when(j > 0, key(j - 1)).alias("above"),
            F.when(j > 0, F.try_element_at("sizes", j)).otherwise(F.col("head_bytes"))
            .alias("turn"), F.transform(levels(j), key).alias("path")))
        return parts.select("k", "head", *[c.alias(n) for n, c in figures.items()],
                            stop.alias("stop"), F.explode(paths).alias("p")).select(
            "k", "head", *figures, "stop", "p.*")

    zero = F.lit(0).cast("bigint")
    below = add_up(tops.filter(F.col("level") > 0).withColumnRenamed("level", "low"),
                   F.col("low") - 1, {
        "n": F.col("n_convs"), "rep": F.col("conv_id"), "leaves": F.col("n_leaves"),
        "saved": F.col("saved"), "child": F.lit(1), "end_sha": F.lit(None).cast("string")})
    here = add_up(used_up, F.col("at"), {
        "n": F.col("n"), "rep": F.col("rep"), "leaves": zero, "saved": zero,
        "child": F.lit(0), "end_sha": F.col("end_sha")})
    at_stop = F.col("level") == F.col("stop")
    heads = cut(below.unionByName(here).groupBy("box", "above", "path", "k", "head", "level").agg(
        F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
        F.sum(F.when(at_stop, F.col("child")).otherwise(0)).alias("children"),
        F.max(F.when(at_stop, F.col("end_sha"))).alias("end_sha"),
        F.max("turn").alias("turn")), "trie-heads")
    own = heads.select(F.explode("path").alias("box"),
                       ((F.col("n_convs") - 1) * F.col("turn")).alias("own"))
    own = own.groupBy("box").agg(F.sum("own").alias("own"))
    heads_below = heads.groupBy(F.col("above").alias("box")).agg(
        F.count(F.lit(1)).alias("heads_below"))
    named = heads.select(F.col("box").alias("above"), F.col("conv_id").alias("parent_conv_id"))

    def with_parent(nodes: DataFrame) -> DataFrame:
        return lookup(nodes, named, ["above"], spread=["conv_id"])

    figures = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved",
               "end_sha", "k", "level"]
    of_heads = with_parent(heads.join(own, "box", "left").join(heads_below, "box", "left").select(
        "conv_id", (F.col("k") * size + F.col("level")).cast("bigint").alias("depth"), "above",
        "n_convs", (F.col("children") + F.coalesce("heads_below", zero)).alias("n_children"),
        "n_leaves", (F.col("saved") + F.coalesce("own", zero)).alias("saved"), "end_sha", "k",
        "level"))
    of_tops = with_parent(tops.withColumn(
        "above", F.when(F.col("level") > 0, key(F.col("level") - 1))).drop("parent_conv_id"))
    return (swept.filter(~F.col("top")).select(*figures)
            .unionByName(of_tops.select(*figures)).unionByName(of_heads.select(*figures)))


def nodes(turns: DataFrame, limit: int = LIMIT, size: int = SEGMENT) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    rebuilt, convs = rebuild(turns)
    parts = cut(segments(rebuilt, convs, size), "parts")
    nothing = F.lit(0).cast("bigint")
    plain = parts.withColumns({"more_leaves": nothing, "more_saved": nothing})
    found = cut(trie(suffixes(plain), limit, size), "nodes")
    if not parts.filter(F.col("k") > 0).isEmpty():
        # What a later segment's trie adds up to goes to its smallest member's earlier segments.
        totals = found.filter((F.col("k") > 0) & (F.col("level") == 0)).select(
            F.col("conv_id").alias("conv"), "k", "n_leaves", "saved")
        after = Window.partitionBy("conv").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
        more = parts.select("conv", "k").join(totals, ["conv", "k"], "left").select(
            "conv", "k", F.coalesce(F.sum("n_leaves").over(after), nothing).alias("more_leaves"),
            F.coalesce(F.sum("saved").over(after), nothing).alias("more_saved"))
        found = cut(trie(suffixes(parts.join(more, ["conv", "k"])), limit, size), "nodes")
    links = found.filter(F.col("level") == size).select(
        (F.col("k") + 1).cast("int").alias("k"), "conv_id", F.col("parent_conv_id").alias("linked"))
    first = (F.col("level") == 0) & (F.col("k") > 0)
    rows = found.filter((F.col("level") < size) & ~first).unionByName(
        found.filter(first).join(links, ["k", "conv_id"]).withColumn(
            "parent_conv_id", F.col("linked")).select(*found.columns))
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                       F.col("saved").alias("saved_tokens"),
                       F.coalesce("end_sha", F.lit(NO_ENDS)).alias("ends_sha256"))
