"""The prefix trie of rebuilt conversations, by fingerprints that compose.

A turn is two elements of the field of 2^61 - 1, from a hash of its role and text. The fingerprint
of a sequence is the pair (B^length, sum of element * B^position) for each of two bases; such pairs
form a monoid under (q, s) (r, t) = (q r, s + q t), and a prefix can be divided out again. So the
fingerprint of a base's first turns followed by a conversation's own turns after its first ones
comes from two stored prefix products and a power of B; no rebuilt text is ever put together.
A node of the trie is a group of equal (depth, fingerprint). Groups are verified: members agree in
the fingerprint one turn before and in the last turn's hash, and turns of equal hash agree in role
and text (read again by reference to the table). If a check fails, all is done again with other
bases and hashes.

Subtree sums need no ancestors' list: each node's weight lies with its smallest member, whose
nodes are the tail of its path, so a sum over a node's subtree is a sum over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.llm.common import written
from locus.llm.repair import CRC_TABLE_SQL, crc_sql
from locus.llm.streams import mapped, runs

FIELD, HEAD, SEEDS, SENT, IDS, STEPS = (1 << 61) - 1, 6, 8, 1_000_000, 4096, 4096
NODE = ["_d", "_f1", "_f2"]


def bases(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{lane}".encode()).digest()[:7]) for lane in (1, 2)]


def times(a: Column, b: Column) -> Column:
    """Product in the field; both factors are below 2^61, the product has at most 37 digits."""
    wide = "decimal(19,0)"
    return ((a.cast(wide) * b.cast(wide)) % F.lit(FIELD).cast(wide)).cast("long")


def plus(a: Column, b: Column) -> Column:
    return (a + b) % FIELD


def minus(a: Column, b: Column) -> Column:
    return F.pmod(a - b, F.lit(FIELD))


def hashed_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """_id, _turn, _role, _text and two 60-bit numbers of a hash of role and text; rows without conv_id are left out."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    salt = "" if seed == 0 else f"{seed}#"
    digest = F.sha2(F.concat(F.lit(salt), F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("_id"), F.col("turn").cast("long").alias("_turn"), role.alias("_role"), text.alias("_text"), digest.alias("_hash"))
    number = lambda at: F.conv(F.substring("_hash", at, 15), 16, 10).cast("long")
    return rows.select("_id", "_turn", "_role", "_text", number(1).alias("_e1"), number(16).alias("_e2"))


def prefix_products(turns: DataFrame, base: list[int]) -> DataFrame:
    """Turns in order: _id, _at, the fingerprint before and after each (_p1, _p2, _f1, _f2), _e1, _e2, _chars.

    The table is range-partitioned by conversation and turn, so one long conversation is dealt over
    several tasks; products inside a part are put behind those of the parts before it.
    """

    def local(stream: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for conv, held in runs(stream):
            power, total = [1, 1], [0, 0]
            for at, (_, e1, e2, chars) in enumerate(held):
                after = [(t + e * w) % FIELD for t, e, w in zip(total, (e1, e2), power)]
                yield conv, part, at, *total, *after, e1, e2, chars
                total, power = after, [w * b % FIELD for w, b in zip(power, base)]

    order = ["_id", F.col("_turn").asc_nulls_first(), "_e1", "_e2"]
    light = turns.select("_id", "_turn", "_e1", "_e2", F.length("_text").cast("long").alias("_chars"))
    spec = "_id long, _part int, _at long, _p1 long, _p2 long, _f1 long, _f2 long, _e1 long, _e2 long, _chars long"
    parts = written(mapped(light.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_e1", "_e2", "_chars"), spec, local), "trie-turns")
    # of neighbouring parts only the first and last conversation can go on: at most two rows a part
    ends = parts.groupBy("_id", "_part").agg((F.max("_at") + 1).alias("_n"), F.max_by(F.struct("_f1", "_f2"), "_at").alias("_f"))
    several = ends.withColumn("_k", F.count("*").over(W.partitionBy("_id"))).filter("_k > 1").select("_id", "_part", "_n", "_f._f1", "_f._f2")

    def offsets(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, held in runs(stream):
            before, power, total = 0, [1, 1], [0, 0]
            for _, part, n, f1, f2 in held:
                yield conv, part, before, *power, *total
                total = [(t + f * w) % FIELD for t, f, w in zip(total, (f1, f2), power)]
                before, power = before + n, [w * pow(b, n, FIELD) % FIELD for w, b in zip(power, base)]

    spec = "_id long, _part int, _before long, _w1 long, _w2 long, _o1 long, _o2 long"
    moved = mapped(several.repartition("_id").sortWithinPartitions("_id", "_part"), spec, offsets)
    out = parts.join(F.broadcast(moved), ["_id", "_part"], "left")
    col, shifted = F.col, F.col("_before").isNotNull()
    behind = lambda f, lane: F.when(shifted, plus(col(f"_o{lane}"), times(col(f), col(f"_w{lane}")))).otherwise(col(f))
    return out.select("_id", (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("_at"), *[behind(f"_{k}{lane}", lane).alias(f"_{k}{lane}") for k in "pf" for lane in (1, 2)], "_e1", "_e2", "_chars")


def rebuilt(turns: DataFrame, base: list[int]) -> tuple[DataFrame, DataFrame]:
    """Members (one row per rebuilt turn) and ends (one row per conversation) of turns with prefix products.

    A member row has _id, _d, its fingerprint _f1, _f2, the one before it _g1, _g2, the last turn's
    hash _e1, _e2 and length _chars, and the reference _src, _src_at of the stored turn.
    """
    first = F.when(F.col("_at") < HEAD - 1, F.struct("_at", "_f1", "_f2", "_p1", "_p2", "_e1", "_e2", "_chars"))
    convs = turns.groupBy("_id").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(first)).alias("_heads"), F.max_by(F.struct("_f1", "_f2"), "_at").alias("_all"))
    convs = written(convs.withColumn("_h", (F.crc32(F.col("_id").cast("string").cast("binary")) % HEAD).cast("int")).withColumn("_b", F.col("_id") - F.col("_id") % 100), "trie-conversations")
    lent = convs.filter("_id % 100 = 0").select(F.col("_id").alias("_b"), F.col("_heads").alias("_lent"))
    info = convs.join(lent, "_b", "left").withColumn("_hh", F.least("_h", F.coalesce(F.size("_lent"), F.lit(0))))
    entry = lambda heads, k, f: F.when(F.col(k) > 0, F.get(F.col(heads)[f], F.col(k) - 1)).otherwise(F.lit(0).cast("long"))
    info = info.withColumn("_depth", F.col("_hh") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0)))
    for lane, b in zip((1, 2), base):
        powers = F.array(*[F.lit(pow(b, -k, FIELD)) for k in range(HEAD)])
        info = info.withColumns({
            f"_s{lane}": entry("_lent", "_hh", f"_f{lane}"),  # the base's head
            f"_o{lane}": F.when(F.col("_n") > F.col("_h"), entry("_heads", "_h", f"_f{lane}")),  # what the own turns begin after
            f"_k{lane}": F.get(powers, F.col("_h") - F.col("_hh")),
        })
    composed = lambda f, lane: plus(F.col(f"_s{lane}"), times(F.col(f"_k{lane}"), minus(f, F.col(f"_o{lane}"))))
    terms = [f"_{x}{lane}" for x in "sok" for lane in (1, 2)]
    own = turns.join(info.filter("_n > _h").select("_id", "_h", "_hh", *terms), "_id").filter("_at >= _h")
    own = own.select(
        "_id", (F.col("_hh") + F.col("_at") - F.col("_h") + 1).alias("_d"), *[composed(F.col(f"_f{i}"), i).alias(f"_f{i}") for i in (1, 2)], *[composed(F.col(f"_p{i}"), i).alias(f"_g{i}") for i in (1, 2)],
        "_e1", "_e2", "_chars", F.col("_id").alias("_src"), F.col("_at").alias("_src_at"),
    )
    heads = info.filter("_hh > 0").select("_id", "_b", F.explode(F.slice("_lent", F.lit(1), F.col("_hh"))).alias("_t"))
    heads = heads.select(
        "_id", (F.col("_t._at") + 1).alias("_d"), "_t._f1", "_t._f2", F.col("_t._p1").alias("_g1"), F.col("_t._p2").alias("_g2"), "_t._e1", "_t._e2", "_t._chars", F.col("_b").alias("_src"), F.col("_t._at").alias("_src_at"),
    )
    last = [F.when(F.col("_n") > F.col("_h"), composed(F.col("_all")[f"_f{i}"], i)).otherwise(F.col(f"_s{i}")).alias(f"_f{i}") for i in (1, 2)]
    return own.unionByName(heads), info.select("_id", F.col("_depth").alias("_d"), *last)


def turns_agree(turns: DataFrame) -> bool:
    """Whether turns of equal hash have equal role and text; only texts of hashes met twice are compared."""
    twice = written(turns.groupBy("_e1", "_e2").agg(F.count("*").alias("_k")).filter("_k > 1").drop("_k"), "trie-repeated")
    if twice.count() <= SENT:
        turns = turns.join(F.broadcast(twice), ["_e1", "_e2"], "left_semi")
    return turns.select("_e1", "_e2", "_role", "_text").distinct().groupBy("_e1", "_e2").count().filter("count > 1").isEmpty()


def joined_ids(ends: DataFrame) -> DataFrame:
    """ends_sha256 of each node where conversations end: their ids in order, joined by commas.

    Ids are joined in pieces over all tasks first; a node's pieces are hashed as a stream.
    """

    def pieces(stream: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for (d, f1, f2), held in runs(((r[:3], r[3]) for r in stream)):
            ids = []
            for _, i in held:
                ids.append(str(i))
                if len(ids) == IDS:
                    yield d, f1, f2, part, number, ",".join(ids)
                    ids, number = [], number + 1
            if ids:
                yield d, f1, f2, part, number, ",".join(ids)
                number += 1

    def hashes(stream: Iterator[tuple]) -> Iterator[tuple]:
        for node, held in runs(((r[:3], r[3]) for r in stream)):
            h, between = hashlib.sha256(), ""
            for _, piece in held:
                h.update(f"{between}{piece}".encode())
                between = ","
            yield *node, h.hexdigest()

    spec = "_d long, _f1 long, _f2 long, _part int, _piece int, _ids string"
    cut = mapped(ends.repartitionByRange(*NODE, "_id").sortWithinPartitions(*NODE, "_id").select(*NODE, "_id"), spec, pieces)
    ordered = written(cut, "trie-ends").repartition(*NODE).sortWithinPartitions(*NODE, "_part", "_piece").select(*NODE, "_ids")
    return mapped(ordered, "_d long, _f1 long, _f2 long, ends_sha256 string", hashes)


def _nodes(conversations: DataFrame, seed: int) -> DataFrame | None:
    """The trie, or None if hashes or fingerprints collide."""
    base = bases(seed)
    turns = hashed_turns(conversations, seed)
    if not turns_agree(turns):
        return None
    members, ends = rebuilt(prefix_products(turns, base), base)
    members, ends = written(members, "trie-members"), written(ends, "trie-ends")
    checks = ["_g1", "_g2", "_e1", "_e2"]
    nodes = members.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("_id").alias("conv_id"), F.max("_chars").alias("_chars"), F.min(F.struct("_src", "_src_at")).alias("_ref"),
        *[F.min(c).alias(c) for c in checks], F.max(F.struct(*checks)).alias("_most"), F.min(F.struct(*checks)).alias("_least"),
    )
    nodes = written(nodes.withColumn("_differs", F.col("_most") != F.col("_least")).drop("_most", "_least"), "trie-nodes")
    if not nodes.filter("_differs").isEmpty():
        return None
    above = nodes.filter("_d > 1").groupBy((F.col("_d") - 1).alias("_d"), F.col("_g1").alias("_f1"), F.col("_g2").alias("_f2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(above, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("_w", (F.col("n_convs") - 1) * F.col("_chars"))
    nodes = written(nodes, "trie-children")
    root = ends.agg(F.min("_id").alias("_root"), F.count("*").alias("_all"))
    parents = nodes.filter("n_children > 0").select((F.col("_d") + 1).alias("_d"), F.col("_f1").alias("_g1"), F.col("_f2").alias("_g2"), F.col("conv_id").alias("parent_conv_id"))
    deeper = nodes.filter("_d > 1").join(parents, ["_d", "_g1", "_g2"])
    placed = deeper.unionByName(nodes.filter("_d = 1").crossJoin(F.broadcast(root.select(F.col("_root").alias("parent_conv_id")))))
    # sums over the tail of each smallest member's path, in stretches of depths
    tails = nodes.select("conv_id", "_d", "_w", F.floor(F.col("_d") / STEPS).alias("_step"))
    stretches = tails.groupBy("conv_id", "_step").agg(F.sum("_w").alias("_sum"))
    later = stretches.withColumn("_later", F.sum("_sum").over(W.partitionBy("conv_id").orderBy(F.desc("_step")).rowsBetween(W.unboundedPreceding, -1))).filter("_later > 0").drop("_sum")
    within = F.sum("_w").over(W.partitionBy("conv_id", "_step").orderBy(F.desc("_d")))
    placed = placed.withColumn("_step", F.floor(F.col("_d") / STEPS)).join(later, ["conv_id", "_step"], "left").withColumn("_tail", within + F.coalesce("_later", F.lit(0)))
    carried = nodes.groupBy(F.col("conv_id").alias("_id")).agg(F.sum("_w").alias("_t"), F.max((F.col("n_children") == 0).cast("long")).alias("_leaf"))
    sums = members.select("_id", *NODE).join(carried, "_id").groupBy(*NODE).agg(F.sum("_t").alias("_sum"), F.sum("_leaf").alias("n_leaves"))
    own = carried.select(F.col("_id").alias("conv_id"), "_t")
    placed = placed.join(sums, NODE).join(own, "conv_id").withColumn("saved_tokens", F.col("_sum") - F.col("_t") + F.col("_tail"))
    total = carried.agg(F.coalesce(F.sum("_t"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("_leaf"), F.lit(1)).alias("n_leaves"))
    tops = nodes.filter("_d = 1").agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    top = root.filter("_all > 0").crossJoin(total).crossJoin(tops).select(
        F.col("_root").alias("conv_id"), zero.alias("_d"), zero.alias("_f1"), zero.alias("_f2"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("_all").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.lit(None).cast("struct<_src:long,_src_at:long>").alias("_ref"),
    )
    rows = placed.select(top.columns).unionByName(top).join(joined_ids(ends), NODE, "left")
    return rows.select(
        "conv_id", F.col("_d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.col("_ref._src").alias("turn_conv_id"), F.col("_ref._src_at").alias("turn_number"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations(conv_id, turn, role, text), one row per node (see op12_trie), with
    turn_conv_id and turn_number (from 0): where a stored copy of the node's last turn is."""
    for seed in range(SEEDS):
        nodes = _nodes(conversations, seed)
        if nodes is not None:
            return nodes
    raise RuntimeError("fingerprints collide under every seed")


def op12_trie(conversations: DataFrame) -> DataFrame:
    """Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty and a null turn comes first; rows of one turn go by a hash of role
    and text. Repeated rows are turns of their own. Rows of a null conv_id belong to no
    conversation. An empty table has no root and gives no rows; other columns are ignored.
    """
    return prefix_trie(conversations).drop("turn_conv_id", "turn_number")


OP12_SQL = f"""
WITH {CRC_TABLE_SQL},
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(length(role) || ':' || role || text), 1, 30)) AS said FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, said, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM whole, crc_table),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.said, 1, c.h), []), list_slice(c.said, c.h + 1, len(c.said))) AS said
  FROM heads c LEFT JOIN heads b ON b.conv_id = c.conv_id - c.conv_id % 100),
members AS (
  SELECT conv_id, d AS depth, list_slice(said, 1, d) AS path, len(said) = d AS ends FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids,
    (count(*) - 1) * coalesce(length(path[depth].text), 0) AS saved FROM members GROUP BY depth, path),
below AS (
  SELECT p.depth, p.path, count(*) FILTER (c.depth = p.depth + 1) AS n_children FROM nodes p JOIN nodes c ON c.depth = p.depth + 1 AND list_slice(c.path, 1, p.depth) = p.path GROUP BY p.depth, p.path),
full_nodes AS (
  SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM nodes n LEFT JOIN below b ON b.depth = n.depth AND b.path = n.path),
subtree AS (
  SELECT u.depth, u.path, sum(v.saved) AS saved_tokens, count(*) FILTER (v.n_children = 0) AS n_leaves
  FROM full_nodes u JOIN full_nodes v ON v.depth >= u.depth AND list_slice(v.path, 1, u.depth) = u.path GROUP BY u.depth, u.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM full_nodes n JOIN subtree s ON s.depth = n.depth AND s.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""
