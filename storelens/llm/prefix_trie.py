"""Conversation prefix trie (operator 12): shared beginnings of conversations, found by blocks of turns.

1. ``numbered`` gives every turn its place by one range sort over all turns; a conversation
   may span any number of tasks.  From here on a turn is two 64-bit hashes and a length.
2. ``blocks`` folds each fixed-length run of ``BLOCK`` turns into a digest (exclusive or of
   hashes salted by place) and runs the digests on to that of the whole beginning.
3. Conversations are grouped by those block digests first.  Where all members of a group
   share the next block, its turns need no grouping of their own; where only one
   member is left, nothing does.
4. Only blocks in which siblings part (or members end) are refined turn by turn.
5. A node is named by its smallest member and depth.  As a conversation that is the smallest
   of a node is so in all deeper nodes on its way, sums over a subtree are plain sums over
   members: leaves whose smallest member passes here, and the lengths of the turns that a
   member shares with a smaller one.  No tree is walked.

Hot groups meet in map-side sums, or in joins whose large side the session's adaptive
skew join may split; ids that end at one node are joined in chunks of ``CHUNK``, hashed as a stream.

Defined cases: rows with a null conv_id take no part; turns of one place are ordered by role,
then text (repeated turns are turns of their own); null role or text is empty; a conversation whose
base is absent begins with its own turns after its first h; an empty table gives an empty table; extra columns are not read.
Digests are of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storelens.llm.common import keep

BLOCK = 4  # turns of a block
MOST = 5  # turns taken from the base conversation, at most
CHUNK = 4096  # ids of a chunk
RUN = 1024  # blocks whose digests are run on in one window
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def _base(c: Column) -> Column:
    return c - c % 100


def _taken(c: Column) -> Column:
    return (F.crc32(c.cast("string")) % (MOST + 1)).cast("long")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, pid, mid, x, y, size) in the order of c and turn, and each task's share (pid, c, first, n, before)."""
    src = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"),
                                                    F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    by = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    # a block's digest must tell places apart, so the turn's place is hashed in later, with these two
    rows = keep(src.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "c", F.monotonically_increasing_id().alias("mid"), F.xxhash64("role", "text").alias("x"),
        F.xxhash64(F.lit(7), "text", F.lit("|"), "role").alias("y"), F.char_length("text").cast("long").alias("size")))
    pid = F.shiftright("mid", 33)
    shares = rows.groupBy(pid.alias("pid"), "c").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("c").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("pid", pid), keep(shares.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (c, pos, x, y, size) a turn, and (c, length) of all, turnless ones too."""
    rows, shares = numbered(turns)
    own = shares.groupBy("c").agg(F.sum("n").alias("n"))
    base = own.where("c % 100 = 0").select(F.col("c").alias("base"), F.least("n", F.lit(MOST)).alias("base_n"))
    h = _taken(F.col("c"))
    convs = keep(own.withColumn("base", _base(F.col("c"))).join(base, "base", "left").select(
        "c", "base", h.alias("h"), F.least(h, F.coalesce("base_n", F.lit(0))).alias("got"), "n")
        .withColumn("length", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    places = shares.join(convs.select("c", "h", "got"), "c")
    placed = rows.join(places, ["pid", "c"]).withColumn("at", F.col("mid") - F.col("first") + F.col("before"))
    later = placed.where("at >= h").select("c", (F.col("at") - F.col("h") + F.col("got")).alias("pos"), "x", "y", "size")
    # the first turns of base conversations, known without their conversation's other rows
    firsts = rows.where("c % 100 = 0").join(shares.where(f"c % 100 = 0 and before < {MOST}").select("pid", "c", "first", "before"), ["pid", "c"])
    firsts = firsts.select(F.col("c").alias("base"), (F.col("mid") - F.col("first") + F.col("before")).alias("pos"), "x", "y", "size").where(F.col("pos") < MOST)
    borrowed = convs.where("got > 0").select("c", "base", "got").join(firsts, "base").where("pos < got").select("c", "pos", "x", "y", "size")
    return later.unionByName(borrowed), convs.select("c", "length")


def blocks(rows: DataFrame) -> DataFrame:
    """(c, k, turns, full, px, py, before, ex, ey): block k of c, with digests and letters before it and the digest after it."""
    salted = rows.select("c", F.floor(F.col("pos") / BLOCK).alias("k"), F.struct(
        "pos", F.xxhash64("x", "pos").alias("x"), F.xxhash64("y", F.lit("y"), "pos").alias("y"), "size").alias("t"))
    cut = salted.groupBy("c", "k").agg(F.array_sort(F.collect_list("t")).alias("turns"), F.bit_xor("t.x").alias("x"), F.bit_xor("t.y").alias("y"), F.sum("t.size").alias("size"))
    cut = keep(cut.withColumn("run", F.floor(F.col("k") / RUN)))
    # running digests within a run of blocks; longer conversations add those of the runs before
    sums = cut.groupBy("c", "run").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("size"))
    earlier = W.partitionBy("c").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("c", "run", F.bit_xor("x").over(earlier).alias("rx"), F.bit_xor("y").over(earlier).alias("ry"), F.sum("size").over(earlier).alias("rsize")).where("run > 0")
    upto = W.partitionBy("c", "run").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    ran = cut.withColumns({"ex": F.bit_xor("x").over(upto), "ey": F.bit_xor("y").over(upto), "after": F.sum("size").over(upto)})
    ran = ran.join(sums, ["c", "run"], "left")
    zero = F.lit(0)

    def plus(a: str, b: str) -> Column:
        return F.col(a).bitwiseXOR(F.coalesce(b, zero))

    out = ran.withColumns({"ex": plus("ex", "rx"), "ey": plus("ey", "ry"), "before": F.col("after") - F.col("size") + F.coalesce("rsize", zero)})
    return out.select("c", "k", "turns", (F.size("turns") == BLOCK).alias("full"), F.col("ex").bitwiseXOR(F.col("x")).alias("px"),
                      F.col("ey").bitwiseXOR(F.col("y")).alias("py"), "before", "ex", "ey")


def _turns(members: DataFrame) -> DataFrame:
    """Each turn of some blocks with the digest of the beginning up to it (qx, qy) and that before it (ox, oy)."""
    def digest(name: str, start: str, end: Column) -> Column:
        return F.aggregate(F.slice("turns", F.lit(1), end), F.col(start), lambda acc, t: acc.bitwiseXOR(t[name]))

    i = F.col("i") + 1
    rest = [c for c in members.columns if c != "turns"]
    return members.select("*", F.posexplode("turns").alias("i", "t")).select(
        *rest, F.col("i"), (F.col("t.pos") + 1).alias("depth"), F.col("t.size").alias("size"), digest("x", "px", i).alias("qx"), digest("y", "py", i).alias("qy"),
        digest("x", "px", F.col("i")).alias("ox"), digest("y", "py", F.col("i")).alias("oy"),
        (F.col("before") + F.aggregate(F.slice("turns", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, t: a + t["size"])).alias("read"))


def _hashed(batches) -> Iterator:
    """Chunks of ids, sorted by node and chunk, to one digest a node; a node's chunks pass as a stream."""
    import hashlib

    import pyarrow as pa

    node, h, out = None, None, []

    def flush():
        t = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i in range(4)], names=["depth", "ex", "ey", "ends_sha256"])
        out.clear()
        return t

    for batch in batches:
        for depth, x, y, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("depth", "ex", "ey", "ids")), strict=True):
            if node != (depth, x, y):
                if node is not None:
                    out.append((*node, h.hexdigest()))
                node, h = (depth, x, y), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if len(out) > 10_000:
            yield flush()
    if node is not None:
        out.append((*node, h.hexdigest()))
    yield flush()


def _ends(ended: DataFrame) -> DataFrame:
    """(depth, ex, ey, ends_sha256) of (c, depth, ex, ey): the digest of the ids that end at a node, ascending."""
    node = ["depth", "ex", "ey"]
    chunks = ended.groupBy(*node, F.floor(F.col("c") / CHUNK).alias("chunk")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string"))).alias("ids"))
    return chunks.repartition(*node).sortWithinPartitions(*node, "chunk").select(*node, "ids").mapInArrow(_hashed, "depth long, ex long, ey long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(turns)
    convs = keep(convs)
    cut = keep(blocks(rows))
    whole = convs.agg(F.count("*").alias("n"), F.min("c").alias("rep"), F.max("length").alias("longest")).first()
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    # conversations by successive block digests; groups of one need not be known
    shared = cut.where("full").groupBy("k", "ex", "ey").agg(F.count("*").alias("n_end"), F.min("c").alias("rep_end")).where("n_end > 1")
    known = keep(cut.join(shared, ["k", "ex", "ey"], "left").withColumn("n_end", F.when(F.col("full"), F.coalesce("n_end", F.lit(1))).otherwise(0)))
    above = known.select("c", (F.col("k") + 1).alias("k"), F.col("n_end").alias("n_par"), F.coalesce("rep_end", "c").alias("rep_par"))
    known = keep(known.join(above, ["c", "k"], "left").withColumns({"n_par": F.coalesce("n_par", F.lit(whole["n"])), "rep_par": F.coalesce("rep_par", F.lit(whole["rep"]))}))
    alone, agree = F.col("n_par") == 1, (F.col("n_par") > 1) & (F.col("n_end") == F.col("n_par"))
    part = (F.col("n_par") > 1) & (F.col("n_end") != F.col("n_par"))
    last = F.col("k") * BLOCK + F.size("turns") == F.col("length")

    # refined turn by turn where siblings part: who is smallest, and from which depth on
    with_length = known.join(convs, "c").withColumn("last", last)
    parted = keep(with_length.where(part))
    refined = _turns(parted)
    first = refined.groupBy("depth", "qx", "qy").agg(F.min("c").alias("rep"), F.count("*").alias("n"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"))
    first = keep(first)
    since = first.groupBy(F.col("rep").alias("c")).agg(F.min("depth").alias("since")).where(F.col("c") != F.lit(whole["rep"]))
    agreed = with_length.where(agree).groupBy("k", "ex", "ey").agg(F.min("rep_end").alias("c"), F.count("*").alias("n"), F.count_if("last").alias("n_ends"))
    leaves = first.where("n = n_ends").select(F.col("rep").alias("c")).unionByName(agreed.where("n = n_ends").select("c")) \
        .unionByName(with_length.where(alone & F.col("last")).select("c"))
    if whole["longest"] == 0:
        leaves = leaves.unionByName(convs.where(F.col("c") == whole["rep"]).select("c"))
    # letters of the turns that a conversation shares with a smaller one: those before depth `since`
    turned = refined.join(since, "c").where("depth = since").select("c", F.col("read").alias("shared"))
    total = cut.groupBy("c").agg(F.sum(F.aggregate("turns", zero, lambda a, t: a + t["size"])).alias("total"))
    stats = convs.join(since, "c", "left").join(turned, "c", "left").join(total, "c", "left").join(leaves.distinct().withColumn("leaf", F.lit(1)), "c", "left").select(
        "c", "length", F.coalesce("leaf", F.lit(0)).alias("leaf"),
        F.when(F.col("c") == F.lit(whole["rep"]), 0).otherwise(F.coalesce("shared", "total", zero)).alias("shared"))
    stats = keep(stats)

    sums = [F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves")]
    tail = F.greatest(F.col("shared") - F.col("read"), zero)  # of a member, from this turn on
    members = keep(known.where("n_par > 1").join(stats.drop("length"), "c"))
    by_turn = _turns(members.where(part)).groupBy("depth", "qx", "qy").agg(
        F.min("c").alias("conv_id"), *sums, F.sum(tail).alias("saved_tokens"), F.any_value(F.when(F.col("i") == 0, F.col("rep_par"))).alias("rep_par"),
        F.any_value("ox").alias("ox"), F.any_value("oy").alias("oy"))
    up = first.select((F.col("depth") + 1).alias("depth"), F.col("qx").alias("ox"), F.col("qy").alias("oy"), F.col("rep").alias("up"))
    by_turn = by_turn.join(up, ["depth", "ox", "oy"], "left").select(
        "conv_id", "depth", F.coalesce("rep_par", "up").alias("parent_conv_id"), "n_convs", "n_leaves", "saved_tokens", F.col("qx").alias("ex"), F.col("qy").alias("ey"))
    lengths = F.transform("turns", lambda t: t["size"])
    whole_blocks = members.where(agree).withColumn("read", F.col("before")).groupBy("k", "ex", "ey").agg(
        F.min("c").alias("conv_id"), *sums, F.sum(tail).alias("saved"), F.any_value(lengths).alias("sizes"))
    # inside a block that all share, what is saved from a turn on is less by that of the turns before it
    by_block = whole_blocks.select("*", F.posexplode("sizes").alias("i", "size")).select(
        "conv_id", (F.col("k") * BLOCK + F.col("i") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_convs", "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.aggregate(F.slice("sizes", F.lit(1), F.col("i")), zero, lambda a, s: a + s)).alias("saved_tokens"),
        F.when(F.col("i") == BLOCK - 1, F.col("ex")).alias("ex"), F.when(F.col("i") == BLOCK - 1, F.col("ey")).alias("ey"))
    by_one = known.where(alone).select("c", "ex", "ey", F.explode("turns").alias("t")).select(
        F.col("c").alias("conv_id"), (F.col("t.pos") + 1).alias("depth"), F.col("c").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), none.alias("ex"), none.alias("ey"))
    root = stats.agg(F.min("c").alias("conv_id"), zero.alias("depth"), none.alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
                     F.sum("shared").alias("saved_tokens"), zero.alias("ex"), zero.alias("ey")).where("conv_id is not null")
    nodes = keep(by_turn.unionByName(by_block).unionByName(by_one).unionByName(root))

    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ended = parted.where("last").unionByName(with_length.where(agree & F.col("last"))).select("c", F.col("length").alias("depth"), "ex", "ey") \
        .unionByName(convs.where("length = 0").select("c", zero.alias("depth"), zero.alias("ex"), zero.alias("ey")))
    out = nodes.join(children, ["conv_id", "depth"], "left").join(_ends(ended), ["depth", "ex", "ey"], "left")
    solo = with_length.where(alone & F.col("last")).select(F.col("c").alias("conv_id"), F.col("length").alias("depth"), F.sha2(F.col("c").cast("string"), 256).alias("own"))
    return out.join(solo, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", "own", F.lit(EMPTY)).alias("ends_sha256"))
