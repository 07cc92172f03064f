"""Structure repair of conversations at least cost, by the auction algorithm for shortest paths.

A conversation of n rows is a lattice of nodes (rows consumed, state): state 0 before any turn,
1 after the system turn, 2 after a user turn, 3 after an assistant turn. Arcs keep, rerole or
delete the next row or insert an empty turn; their costs are whole numbers. The auction keeps a
path from the entry and a price for every node, never above any arc's cost plus the price of its
end. If the last node's price can rise, it rises and the path gives up that node (contraction);
else the path grows along the arc that fixes the price (extension) until it reaches the exit.
The entry's price is then the least cost, and every path of least cost runs along tight arcs
only, of which the trace takes the edit with the least letter that still leads to the exit.

Conversations of at most BLOCK rows and LARGE bytes are repaired in one pass over rows sorted by
conversation, one conversation in memory at a time. Longer ones, whatever share of the table
they hold, are cut into blocks over all tasks: auctions give a block's costs between states,
one pass over blocks (no texts) from the end gives the cost to go, blocks are traced for each
entry state, and one pass from the start picks the entries. Their texts meet again only to be
hashed, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locus.llm.common import written
from locus.llm.streams import mapped, runs

BLOCK, LARGE, SENT = 512, 32 << 20, 1_000_000
#: The costs of edits, blanks of a text and marks that end a sentence.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLANKS, MARKS = " \t\n\x0b\x0c\r", ".!?"
#: What it costs to end a conversation in each state, and the inserts that do it.
END_COST, END_EDITS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: State after keeping a row whose role has this initial, by the state before.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

Row = tuple[str, str]  # fault ('b' blank, 'd' duplicate, 't' truncated, '-' none) and role initial


def turn_of(state: int) -> int:
    """State after an inserted or rerolled turn."""
    return 3 if state == 2 else 2


def arcs(rows: list[Row], node: int, exits: list[int | None]) -> list[tuple[str, int, int]]:
    """Edits out of a node (4 * rows consumed + state) as letter, cost and end, by letter; the exit is -1."""
    i, state = divmod(node, 4)
    if i == len(rows):
        return [] if exits[state] is None else [("", exits[state], -1)]
    fault, initial = rows[i]
    out = [("D", DELETE, node + 4), ("I", INSERT, 4 * i + turn_of(state))]
    if fault not in "bd":
        more = TRUNCATED if fault == "t" else 0
        if initial in KEEPS[state]:
            out.append(("K", more, 4 * i + 4 + KEEPS[state][initial]))
        out.append(("R", REROLE + more, 4 * i + 4 + turn_of(state)))
    return out


def auction(rows: list[Row], entry: int, exits: list[int | None]) -> tuple[int, list[int]]:
    """Least cost from the entry state to the exit, and the prices of nodes at that time.

    Prices start at what faults cost in any case: a lower bound by which no arc is underpriced.
    """
    least = min(e for e in exits if e is not None)
    ends = [None if e is None else e - least for e in exits]
    price, rest = [0] * (4 * len(rows) + 4), 0
    for i in range(len(rows) - 1, -1, -1):
        rest += {"b": DELETE, "d": DELETE, "t": TRUNCATED}.get(rows[i][0], 0)
        price[4 * i : 4 * i + 4] = [rest] * 4
    path = [entry]
    while True:
        node, best, to = path[-1], None, None
        for _, cost, end in arcs(rows, node, ends):
            through = cost if end < 0 else cost + price[end]
            if best is None or through < best:
                best, to = through, end
        if best is None:
            price[node] = 1 << 60  # leads nowhere
            path.pop()
        elif best > price[node]:
            price[node] = best
            if len(path) > 1:
                path.pop()
        elif to < 0:
            return price[entry] + least, price
        else:
            path.append(to)


def trace(rows: list[Row], entry: int, exits: list[int | None], price: list[int]) -> tuple[str, int]:
    """Letters of the least path of tight arcs to the exit, and the state it leaves in."""
    least = min(e for e in exits if e is not None)
    ends = [None if e is None else e - least for e in exits]

    def tight(node: int) -> Iterator[tuple[str, int]]:
        return ((letter, end) for letter, cost, end in arcs(rows, node, ends) if price[node] == cost + (0 if end < 0 else price[end]))

    letters, nodes, ways, dead = [], [entry], [tight(entry)], set()
    while True:
        letter, end = next(ways[-1], (None, 0))
        if letter is None:
            dead.add(nodes.pop())
            ways.pop()
            letters.pop()
        elif end < 0:
            return "".join(letters), nodes[-1] % 4
        elif end not in dead:
            letters.append(letter)
            nodes.append(end)
            ways.append(tight(end))


def solve(rows: list[Row], entry: int = 0, exits: list[int | None] = list(END_COST)) -> tuple[int, str, int]:
    """Least cost, its least audit and the state at the end, from a state to the block's exits."""
    cost, price = auction(rows, entry, exits)
    return cost, *trace(rows, entry, exits, price)


def replay(rows: list[Row], audit: str, state: int) -> list[tuple[int | None, str | None]]:
    """Turns that an audit leaves: the row's number (None if inserted) and the new role (None if kept)."""
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            state = turn_of(state)
            out.append((None, "assistant" if state == 3 else "user"))
            continue
        if letter == "K":
            state = KEEPS[state][rows[i][1]]
            out.append((i, None))
        elif letter == "R":
            state = turn_of(state)
            out.append((i, "assistant" if state == 3 else "user"))
        i += 1
    return out


def repaired(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, counts of faults, illegal pairs, cost, audit and hash of one conversation's rows (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in MARKS else "-")
        seen.add((role, text))
    lattice = [(fault, role[:1]) for fault, (_, role, _) in zip(faults, rows)]
    cost, audit, state = solve(lattice)
    audit += END_EDITS[state]
    lines = [f"{role or rows[i][1]}:{'' if i is None else rows[i][2]}" for i, role in replay(lattice, audit, 0)]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a, b) not in LEGAL for (_, a), (_, b) in zip(lattice, lattice[1:]))
    return gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """_id, _turn, _role, _text and _copies (0: dropped) of conversations after the damage; nulls of role and text are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("_id"), F.col("turn").cast("long").alias("_turn"), space("role").alias("_role"), space("text").alias("_text"), kind.alias("_kind"))
    return rows.select(
        "_id", "_turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("_role"),
        F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate("_text", MARKS, "")).otherwise(F.col("_text")).alias("_text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("_copies"),
    )


def whole(rows: DataFrame) -> DataFrame:
    """Repairs conversations that fit in memory: one shuffle of texts, one conversation held at a time."""

    def make(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, held in runs(stream):
            yield (conv, *repaired([(turn, role, text) for _, turn, role, text, copies in held for _ in range(copies)]))

    ordered = rows.repartition("_id").sortWithinPartitions("_id", F.col("_turn").asc_nulls_first(), "_role", F.sha2("_text", 256))
    return mapped(ordered.select("_id", "_turn", "_role", "_text", "_copies"), f"_id long, {RESULT}", make)


BLOCKS = "_id long, _part int, _block int, _codes string, _roles array<string>, _digests array<binary>, _dist array<long>"


def lattice_of(codes: str) -> list[Row]:
    return [(codes[k], codes[k + 1].replace("x", "")) for k in range(0, len(codes), 2)]


def crossing(rows: list[Row]) -> list[int]:
    """Least costs of a block from each state to each state; -1 where there is no way."""
    starts = any(f not in "bd" and a == "s" for f, a in rows)
    out = []
    for s in range(4):
        for t in range(4):
            way = t > 1 or s == t or (s, t) == (0, 1) and starts
            out.append(auction(rows, s, [0 if k == t else None for k in range(4)])[0] if way else -1)
    return out


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Repairs conversations of any length over all tasks; rows as damaged() gives them."""
    blank = F.rtrim("_text", F.lit(BLANKS)) == ""
    cut = ~F.substring(F.rtrim("_text", F.lit(BLANKS)), -1, 1).isin(*MARKS)
    digest = F.unhex(F.sha2("_text", 256))
    light = rows.filter("_copies > 0").select("_id", "_turn", "_role", digest.alias("_digest"), F.when(blank, "b").when(cut, "t").otherwise("-").alias("_fault"), F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))
    # blank rows are one key in a conversation, and can't be duplicates: spread them
    salt = F.when(F.col("_fault") == "b", F.pmod(F.xxhash64("_turn", "_copy"), F.lit(256))).otherwise(F.lit(0))
    nth = F.row_number().over(W.partitionBy("_id", "_role", "_digest", "_salt").orderBy(F.col("_turn").asc_nulls_first(), "_copy"))
    initial = F.substring("_role", 1, 1)
    code = F.concat(F.when((F.col("_fault") != "b") & (F.col("_nth") > 1), "d").otherwise(F.col("_fault")), F.when(initial.isin("s", "u", "a"), initial).otherwise("x"))
    light = light.withColumn("_salt", salt).withColumn("_nth", nth).withColumn("_code", code)

    def cut_blocks(stream: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for conv, held in runs(stream):
            rows_ = []
            for r in held:
                rows_.append(r)
                if len(rows_) == block:
                    yield made(conv, part, number, rows_)
                    rows_, number = [], number + 1
            if rows_:
                yield made(conv, part, number, rows_)
                number += 1

    def made(conv: int | None, part: int, number: int, held: list[tuple]) -> tuple:
        codes = "".join(r[1] for r in held)
        return conv, part, number, codes, [r[2] for r in held], [r[3] for r in held], crossing(lattice_of(codes))

    order = ["_id", F.col("_turn").asc_nulls_first(), "_role", "_digest", "_nth"]
    blocks = written(mapped(light.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_code", "_role", "_digest"), BLOCKS, cut_blocks), "repair-blocks")

    def backward(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, held in runs(stream):
            togo = list(END_COST)
            for _, part, number, dist in held:
                yield conv, part, number, togo
                togo = [min(dist[4 * s + t] + togo[t] for t in range(4) if dist[4 * s + t] >= 0) for s in range(4)]

    key = ["_id", "_part", "_block"]
    last_first = blocks.select(*key, "_dist").repartition("_id").sortWithinPartitions("_id", F.desc("_part"), F.desc("_block"))
    togo = mapped(last_first, "_id long, _part int, _block int, _togo array<long>", backward)

    def traced(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, number, codes, roles, digests, exits in stream:
            ways = [solve(lattice_of(codes), s, exits) for s in range(4)]
            yield conv, part, number, codes, roles, digests, [w[0] for w in ways], [w[1] for w in ways], [w[2] for w in ways]

    same = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._part") == F.col("b._part")) & (F.col("a._block") == F.col("b._block"))

    def beside(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        return left.alias("a").join(right.alias("b"), same).select("a.*", f"b.{column}")

    spec = "_id long, _part int, _block int, _codes string, _roles array<string>, _digests array<binary>, _costs array<long>, _audits array<string>, _exits array<int>"
    traces = written(mapped(beside(blocks.drop("_dist"), togo, "_togo"), spec, traced), "repair-traces")

    def forward(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, held in runs(stream):
            state, before, cost = 0, None, None
            for _, part, number, codes, costs, exits in held:
                cost = costs[0] if cost is None else 0
                first, pairs = codes[1], [(codes[k], codes[k + 2]) for k in range(1, len(codes) - 2, 2)]
                illegal = sum(p not in LEGAL for p in pairs) + (before is not None and (before, first) not in LEGAL)
                yield conv, part, number, state, cost, illegal, *(codes[::2].count(f) for f in "bdt"), exits[state]
                state, before = exits[state], codes[-1]

    spec = "_id long, _part int, _block int, _entry int, cost long, illegal long, blank long, duplicate long, truncated long, _exit int"
    picked = written(mapped(traces.select(*key, "_codes", "_costs", "_exits").repartition("_id").sortWithinPartitions(*key), spec, forward), "repair-entries")
    chosen = traces.alias("a").join(picked.alias("b"), same).select("a.*", "b._entry", "b._exit").withColumn("_audit", F.element_at("_audits", F.col("_entry") + 1))
    ending = F.element_at(F.array(*map(F.lit, END_EDITS)), F.max_by("_exit", F.struct("_part", "_block")) + 1)
    audits = chosen.groupBy("_id").agg(F.concat(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_part", "_block", "_audit"))), lambda x: x["_audit"])), ending).alias("audit"), F.max(F.struct("_part", "_block", "_exit")).alias("_last"))
    counts = picked.groupBy("_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])

    def lines(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, number, codes, roles, digests, audit, entry in stream:
            for at, (i, role) in enumerate(replay(lattice_of(codes), audit, entry)):
                yield conv, part, number, at, None if i is None else roles[i], None if i is None else digests[i], role

    spec = "_id long, _part int, _block int, _at int, _role string, _digest binary, _new string"
    turns = mapped(chosen.select(*key, "_codes", "_roles", "_digests", "_audit", "_entry"), spec, lines)
    # the inserts at the end: their roles follow from the state, one row of at most two turns
    tails = {1: ["user", "assistant"], 2: ["assistant"]}
    tail = F.coalesce(*[F.when(F.col("_last._exit") == s, F.array(*map(F.lit, t))) for s, t in tails.items()])
    ends = audits.select("_id", "_last", F.posexplode(tail).alias("_at", "_new")).select("_id", "_last._part", "_last._block", (F.col("_at") + (1 << 30)).alias("_at"), F.lit(None).cast("string").alias("_role"), F.lit(None).cast("binary").alias("_digest"), "_new")
    texts = rows.filter("_copies > 0").select("_id", "_role", digest.alias("_digest"), "_text").dropDuplicates(["_id", "_role", "_digest"])
    on = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._role") == F.col("b._role")) & (F.col("a._digest") == F.col("b._digest"))
    said = turns.filter("_digest is not null").alias("a").join(texts.alias("b"), on).select("a._id", "_part", "_block", "_at", F.coalesce("_new", "a._role").alias("_who"), "_text")
    silent = turns.filter("_digest is null").unionByName(ends).select("_id", "_part", "_block", "_at", F.col("_new").alias("_who"), F.lit("").alias("_text"))

    def hashed(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, held in runs(stream):
            h, between = hashlib.sha256(), ""
            for _, who, text in held:
                h.update(f"{between}{who}:{text}".encode())
                between = "\n"
            yield conv, h.hexdigest()

    streams = said.unionByName(silent).repartition("_id").sortWithinPartitions("_id", "_part", "_block", "_at").select("_id", "_who", "_text")
    hashes = mapped(streams, "_id long, repaired_sha256 string", hashed)
    span = F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn")
    # every conversation of rows, also one of which nothing is left
    gaps = rows.groupBy("_id").agg(F.lit(0).alias("_none")).join(rows.filter("_copies > 0").groupBy(F.col("_id").alias("_g")).agg(span.alias("gaps")), F.col("_id").eqNullSafe(F.col("_g")), "left").drop("_g", "_none")
    out = gaps
    for part in (counts, audits.drop("_last"), hashes):
        out = out.alias("a").join(part.alias("b"), F.col("a._id").eqNullSafe(F.col("b._id")), "left").select("a.*", *[f"b.{c}" for c in part.columns[1:]])
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}).select("_id", *[c.split()[0] for c in RESULT.split(", ")])


def repair(rows: DataFrame, *, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """Repairs of rows(_id, _turn, _role, _text, _copies): one row per _id (see op11_auction)."""
    sizes = rows.groupBy("_id").agg(F.sum(F.greatest("_copies", F.lit(1))).alias("_n"), F.sum(F.octet_length("_text") * F.col("_copies")).alias("_b"))
    long_ids = written(sizes.filter((F.col("_n") > block) | (F.col("_b") > large)).select(F.col("_id").alias("_long")), "repair-long")
    n = long_ids.count()
    if n == 0:
        return whole(rows)
    known = F.broadcast(long_ids) if n <= SENT else long_ids
    on = F.col("_id").eqNullSafe(F.col("_long"))
    return whole(rows.join(known, on, "left_anti")).unionByName(in_blocks(rows.join(known, on, "left_semi"), min(block, BLOCK)))


def op11_auction(conversations: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Damages conversations(conv_id, turn, role, text) by a rule and repairs them; one row per conv_id.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A null
    role or text counts as one space, as a null conv_id or turn does in the rule's key; rows of a
    null conv_id are one conversation. Null turns come first and make no gap; rows of one turn go
    by role, then by the SHA-256 of their text. A role is known by its first character; an empty or other one is never
    kept. A conversation of which the damage leaves nothing has zeros, an empty audit and the hash
    of an empty string. An empty table gives no rows; other columns are ignored.
    """
    return repair(damaged(conversations), block=block).withColumnRenamed("_id", "conv_id")


#: The table of CRC-32 as a CTE of one row, for the checks in SQL.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_tab)"""


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, where crc_table is in the FROM clause."""
    chars = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {chars}), lambda c, b: xor(c >> 8, crc_tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _edit(path: str, cost: str, letter: str) -> str:
    """A path (nine digits of cost, then letters) with one more edit."""
    return f"lpad(CAST(substr({path}, 1, 9)::INT + {cost} AS VARCHAR), 9, '0') || substr({path}, 10) || '{letter}'"


def _step_sql() -> str:
    may, more = "fault NOT IN ('b', 'd')", "(CASE WHEN fault = 't' THEN 1 ELSE 0 END)"
    keep = lambda v, role: f"CASE WHEN {may} AND initial = '{role}' THEN {_edit(v, more, 'K')} END"
    new = lambda v: f"CASE WHEN {may} THEN {_edit(v, '2 + ' + more, 'R')} END"
    gone = lambda v: _edit(v, "3", "D")
    users = ", ".join(f"{keep(v, 'u')}, {new(v)}" for v in ("v0", "v1", "v3"))
    return f"{gone('v0')} AS n0, least({gone('v1')}, {keep('v0', 's')}) AS n1, least({gone('v2')}, {users}) AS n2, least({gone('v3')}, {keep('v2', 'a')}, {new('v2')}) AS n3"


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, substr(role, 1, 1) AS initial
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS follows
  FROM numbered),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (follows IS NOT NULL AND initial || follows NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, '000000002I' AS v2, '000000004II' AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, least(n3, {_edit("m2", "2", "I")}) FROM (
    SELECT *, least(n2, {_edit("n0", "2", "I")}, {_edit("n1", "2", "I")}, {_edit("n3", "2", "I")}) AS m2 FROM (
      SELECT w.conv_id, f.i, {_step_sql()} FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
ends AS (
  SELECT c.*, least(w.v0, w.v3) AS best FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n),
replay AS (
  SELECT conv_id, substr(best, 10) AS audit, 0::BIGINT AS k, 0::BIGINT AS i, 0 AS state, '' AS letter FROM ends
  UNION ALL
  SELECT conv_id, audit, k + 1, i + (letter <> 'I')::INT,
    CASE WHEN letter = 'D' THEN state WHEN letter <> 'K' THEN CASE WHEN state = 2 THEN 3 ELSE 2 END WHEN state = 2 THEN 3 WHEN state = 0 AND initial = 's' THEN 1 ELSE 2 END, letter
  FROM (SELECT r.conv_id, r.audit, r.k, r.i, r.state, substr(r.audit, r.k + 1, 1) AS letter, f.initial
        FROM replay r LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 WHERE r.k < length(r.audit))),
texts AS (
  SELECT r.conv_id, string_agg(CASE WHEN r.letter = 'K' THEN f.role ELSE CASE WHEN r.state = 3 THEN 'assistant' ELSE 'user' END END || ':' || CASE WHEN r.letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY r.k) AS repaired
  FROM replay r LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i WHERE r.letter IN ('I', 'K', 'R') GROUP BY r.conv_id)
SELECT a.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal,
  coalesce(substr(e.best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(e.best, 10), '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
