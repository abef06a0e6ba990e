"""The trie of all conversations' prefixes, without walking it: smallest-member ownership.

A node is a sequence of first turns that some conversation has, and its smallest
member owns it. The members of a node's child are among its own, so a
conversation that owns a node owns all deeper ones of its path: what it owns is
a suffix of the path, told by the first owned depth alone. A subtree's nodes are
each owned by one of its members, hence for every node

* tokens saved below it: its occurrences' tokens less the owned ones, which for
  a member are the tokens between the node and the member's first owned depth;
* leaves below it: members that own the childless end of their path;
* children: members that own the next turn of their path,

and one grouping by prefix sums them all. Owners are marked by a least value for
each prefix, joined back to the rows, as a window over a prefix would be one task
for a first turn that a third of all conversations share.

A prefix is told by its depth and 128 bits: the exclusive or of an MD5 of each
turn with its place. That sum runs along a conversation in windows of ``BLOCK``
turns and over the blocks' own sums, and turns are numbered within ranges of all
rows, so one conversation may hold any share of them. The SHA-256 of the ids
that end at a node takes them in order by its nature: ids come as sorted strings
of up to 1024 and pass through the hash one string at a time.

Defined results: null role or text is empty; a null turn comes first; rows of
one conversation and turn are ordered by the MD5 of role and text, and repeated
rows are turns of their own; rows without a conversation belong to none; an
empty table has no node, not even the root; texts of any length count by their
words; columns beyond the four do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Workspace, table

#: Turns of a conversation that one window runs over.
BLOCK = 1024
#: Ids of so many successive numbers are sorted together, by their lower bits.
ID_BITS = 10
NODE = ["depth", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _halves(md5: Column) -> tuple[Column, Column]:
    """The two signed 64-bit integers of a hex string of 128 bits."""
    return tuple(F.conv(F.substring(md5, at, 16), 16, -10).cast("long") for at in (1, 17))


def numbered_turns(conversations: DataFrame, space: Workspace, texts: bool = False) -> DataFrame:
    """(conv_id, place, digest, words) and, if wanted, role and text of each turn; places count from 1."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("words"), *((role.alias("role"), text.alias("text")) if texts else ()))
    # in ranges of all rows, so that a long conversation is several tasks' work
    order = ["conv_id", "turn", "digest"]
    dealt = space.keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    own = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest")))
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = space.keep(counts.withColumn("before", before).filter("before > 0").select("conv_id", "part", "before"), "later")
    placed = own.join(later, ["conv_id", "part"], "left")
    return space.keep(placed.select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "digest", "words", *(("role", "text") if texts else ())), "turns")


def plan_heads(turns: DataFrame, space: Workspace, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, base, h, m, len): whose first turns each conversation takes, how many it may take and takes, and its length then."""
    ids = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads)
    first = turns.filter((F.col("place") < heads) & (F.col("conv_id") % group == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("has"))
    taken = F.least("h", F.coalesce("has", F.lit(0)))
    return space.keep(ids.join(first, "base", "left").select("conv_id", "base", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "plan")


def rebuilt_turns(turns: DataFrame, plan: DataFrame, heads: int = 4) -> DataFrame:
    """(conv_id, depth, digest, words, len) of the rebuilt conversations."""
    head = turns.filter(F.col("place") < heads).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    taken = plan.join(head, "base").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "digest", "words", "len")
    own = turns.join(plan, "conv_id").filter("place > h").select("conv_id", (F.col("m") + F.col("place") - F.col("h")).alias("depth"), "digest", "words", "len")
    return taken.unionByName(own)


def prefixes(rebuilt: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, depth, p1, p2, upto, words, len): each prefix's 128 bits and its words so far."""
    one, two = _halves(F.md5(F.concat("digest", F.lit(":"), F.col("depth").cast("string")).cast("binary")))
    tagged = space.keep(rebuilt.select("conv_id", "depth", ((F.col("depth") - 1) / BLOCK).cast("long").alias("block"), one.alias("x1"), two.alias("x2"), "words", "len"), "tagged")
    sums = {"p1": (F.bit_xor, "x1"), "p2": (F.bit_xor, "x2"), "upto": (F.sum, "words")}
    along = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = tagged.select("conv_id", "depth", "block", "words", "len", *(f(c).over(along).alias(k) for k, (f, c) in sums.items()))
    blocks = tagged.filter(F.col("len") > BLOCK).groupBy("conv_id", "block").agg(*(f(c).alias(k) for k, (f, c) in sums.items()))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *(f(k).over(earlier).alias(f"before_{k}") for k, (f, _) in sums.items())).filter("block > 0")
    joined = own.join(carried, ["conv_id", "block"], "left")
    zero = F.lit(0).cast("long")
    return space.keep(joined.select("conv_id", "depth", *(F.col(k).bitwiseXOR(F.coalesce(f"before_{k}", zero)).alias(k) for k in ("p1", "p2")), (F.col("upto") + F.coalesce("before_upto", zero)).alias("upto"), "words", "len"), "paths")


def owned_suffixes(paths: DataFrame, space: Workspace) -> DataFrame:
    """(conv_id, first, before, above, leaf): first owned depth (one past the end if none), words before it, who owns the node above, and whether the path ends in an owned leaf."""
    nodes = space.keep(paths.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.sum((F.col("depth") == F.col("len")).cast("long")).alias("ends")), "nodes")
    marked = paths.join(nodes, NODE)
    mine, end = F.col("conv_id") == F.col("owner"), F.col("depth") == F.col("len")
    return space.keep(
        marked.groupBy("conv_id").agg(
            F.coalesce(F.min(F.when(mine, F.col("depth"))), F.max("len") + 1).alias("first"),
            F.coalesce(F.min(F.when(mine, F.col("upto") - F.col("words"))), F.max("upto")).alias("before"),
            F.max(F.when(~mine, F.struct("depth", "owner")))["owner"].alias("above"),
            F.max((mine & end & (F.col("n") == F.col("ends"))).cast("long")).alias("leaf"),
        ),
        "owned",
    )


def hashed_ends(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the nodes at which conversations end, from rows (depth, p1, p2, conv_id)."""
    packed = ends.groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        node, state, done = None, None, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [*NODE, "ends_sha256"])

        for batch in batches:
            for *key, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield rows(done)
                done = []
        if node:
            yield rows([(*node, state.hexdigest())])

    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4, texts: bool = False) -> DataFrame:
    """Every node: its owner's conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt first: their leading turns, less than ``heads``,
    come from the first of each ``group`` ids. With ``texts`` each node has the
    role and text of its last turn as well (the root nulls).
    """
    space = Workspace(conversations.sparkSession, "trie")
    turns = numbered_turns(conversations, space, texts)
    plan = plan_heads(turns, space, group, heads)
    paths = prefixes(rebuilt_turns(turns, plan, heads), space)
    space.drop("dealt", "later", "tagged", *(() if texts else ("turns",)))
    owned = owned_suffixes(paths, space)
    # one row
    top = plan.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    if top["least"] is None:
        top = None
    least = F.lit(top["least"] if top else None).cast("long")

    rows = paths.join(owned, "conv_id")
    depth, first = F.col("depth"), F.col("first")
    parent = F.when(depth > first, F.col("conv_id")).otherwise(F.coalesce("above", least))
    nodes = (
        rows.groupBy(*NODE)
        .agg(
            F.min(F.struct("conv_id", parent.alias("parent"))).alias("owner"),
            F.count("*").alias("n_convs"),
            F.sum(((depth < F.col("len")) & (depth + 1 >= first)).cast("long")).alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.greatest(F.lit(0).cast("long"), F.col("before") - F.col("upto") + F.col("words"))).alias("saved_tokens"),
        )
        .select(*NODE, F.col("owner.conv_id").alias("conv_id"), F.col("owner.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    )
    zero = F.lit(0).cast("long")
    root = owned.agg(F.coalesce(F.sum((first == 1).cast("long")), zero).alias("n_children"), F.greatest(F.coalesce(F.sum("leaf"), zero), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("before"), zero).alias("saved_tokens"))
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), least.alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top["n"] if top else 0).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens").filter("n_convs > 0")
    ends = paths.filter("depth = len").select(*NODE, "conv_id").unionByName(plan.filter("len = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id"))
    told = nodes.unionByName(root).join(space.keep(hashed_ends(ends), "ends"), NODE, "left")
    out = told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return _with_turns(out, turns, plan) if texts else out


def _with_turns(nodes: DataFrame, turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Each node with the turn that its owner's path has at that depth."""
    taken = F.col("depth") <= F.col("m")
    source = nodes.join(plan, "conv_id").select(*nodes.columns, F.when(taken, F.col("base")).otherwise(F.col("conv_id")).alias("_conv"), F.when(taken, F.col("depth")).otherwise(F.col("depth") - F.col("m") + F.col("h")).alias("_place"))
    said = turns.select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"), "role", "text")
    return source.join(said, ["_conv", "_place"], "left").select(*nodes.columns, *(F.when(F.col("depth") > 0, F.col(c)).alias(c) for c in ("role", "text")))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The checksum's table and its sum over a list of bytes, in DuckDB.
CRC_TABLE = "SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)"


def crc_of(bytes_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH crc AS ({CRC_TABLE}),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
      FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, {crc_of("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 4 AS h
      FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY 1), crc),
b AS (SELECT i.conv_id, o.place AS depth, role, text FROM i JOIN o ON o.conv_id = i.base AND o.place <= i.h
      UNION ALL
      SELECT i.conv_id, o.place - i.h + least(i.h, coalesce(c.n, 0)), role, text FROM i JOIN o ON o.conv_id = i.conv_id AND o.place > i.h LEFT JOIN i c ON c.conv_id = i.base),
p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM b
      UNION ALL SELECT conv_id, 0, 0, '' FROM i),
e AS (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY 1),
s AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM e GROUP BY 1),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
             CASE WHEN depth > 0 THEN path[: greatest(0, 33 * (depth - 1) - 1)] END AS above FROM p GROUP BY 1, 2),
k AS (SELECT above, count(*) AS n_children FROM n GROUP BY 1),
g AS (SELECT a.path, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved
      FROM n a JOIN n d ON d.depth >= a.depth AND (a.depth = 0 OR d.path[: 33 * a.depth - 1] = a.path) LEFT JOIN k ON k.above = d.path GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, g.n_leaves, g.saved::BIGINT AS saved_tokens, coalesce(s.ends, sha256('')) AS ends_sha256
FROM n JOIN g ON g.path = n.path LEFT JOIN n u ON u.path = n.above LEFT JOIN k ON k.above = n.path LEFT JOIN s ON s.path = n.path
"""
