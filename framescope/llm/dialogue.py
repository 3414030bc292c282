"""Conversation structure repair: the cheapest edits that turn a conversation's
rows into ``(s?(ua)+)?`` (roles by their initials), by the auction
shortest-path algorithm.

A conversation is a lattice: a layer for each place between rows and four
nodes a layer (nothing yet, after the system row, after a user row, after an
assistant row). Arcs are edits with integer costs: Keep 0, Rerole 1, Delete 2,
Insert 5 (inside a layer); a truncated row that stays adds 5. Blank rows and
repeats must go, so they are no layer: their deletion costs 2 and stands first
in its gap ("D" is the least initial). :func:`auction` keeps a price for each
node and a path from the origin: the path's last node either raises its price
to the cheapest arc plus that arc's end and is contracted, or extends the path
along that arc. Prices then show which arcs are tight; the audit is the
lexicographically least tight path (:func:`trace`).

At scale:

* Rows get their place by a range partitioning on (conversation, turn, role,
  text) and a sort inside each partition; equal rows are combined before, so
  neither a long conversation nor a much repeated row is one task's.
* A repeat is a row whose place is not the least of its (conversation, role,
  text), a partially aggregated minimum; the winners meet the rows in the
  grouping into segments, not in a join on the text.
* Segments have at most ``SEGMENT`` rows. Conversations of one segment (nearly
  all) are solved at once. Others climb a tree with ``SEGMENT`` children a node:
  4 x 4 matrices of cheapest costs go up, prices of the boundaries come down,
  the states that each segment leaves go up and those it enters come down, each
  a small grouped job; the last solve is then local to each segment.
* The hash of a whole conversation is one stream by its nature:
  :func:`digests` feeds the sorted rows to it one by one in constant memory
  (and holds the audit, a letter an edit, which is one value of the result).

Defined results: null role or text is one space, a null turn sorts first and
counts in no gap; rows that tie on the turn are taken by role, then text; null
``conv_id`` is a conversation of its own; equal rows all count; other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framescope.llm.common import written

#: Rows of a segment and children of a tree node: a power of two.
SEGMENT = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES = 4
USER, ASSISTANT = 2, 3
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Cheapest way from each state to an accepted end, by insertions alone.
END = (0, 2 * INSERT, INSERT, 0)
#: Spaces in ``[^\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\f\r"


# ---- damage ---------------------------------------------------------------

def conversation_key(conv_id: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``conv, turn, role, text, copies`` after the damage that the crc32
    of ``conv_id:turn`` (nulls: a space) modulo 20 chooses: 0 drops a row, 1
    empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the
    user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        conversation_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("fate"))
    text = (F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    return rows.where("fate <> 0").select(
        "conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))


# ---- places ---------------------------------------------------------------

def placed(rows: DataFrame) -> DataFrame:
    """Rows in order, written: equal rows as one with their ``copies``, its
    number ``mid`` (ascending by conversation, turn, role, text), and its
    faults that need no other row."""
    one = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    ranged = (one.withColumn("head", F.substring("text", 1, 64))
              .repartitionByRange("conv", "turn", "role", "head")
              .sortWithinPartitions("conv", "turn", "role", "text").drop("head"))
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    return written(ranged.select(
        "*", F.monotonically_increasing_id().alias("mid"), F.substring("role", 1, 1).alias("initial"),
        (F.length(stripped) == 0).alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same")), "turns")


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds ``block``: the row's place in the whole table by ``SEGMENT``. The
    offsets joined are one number for each partition of ``turns``."""
    spark = turns.sparkSession
    part = F.shiftrightunsigned("mid", 33)
    sizes = turns.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r["part"], at))
        at += r["count"]
    known = F.broadcast(spark.createDataFrame(offsets, "part long, offset long"))
    place = F.col("offset") + F.col("mid").bitwiseAND((1 << 33) - 1)
    return (turns.withColumn("part", part).join(known, "part")
            .withColumn("block", F.floor(place / SEGMENT)).drop("part", "offset"))


def _read_segment(mid, initial, blank, open_, copies, firsts) -> tuple[str, int, int, int, int]:
    """Symbols of a segment's rows (``x``: must go; else the role's class, in
    capitals when truncated) and its blank, duplicate, truncated rows and
    illegal neighbours."""
    firsts, symbols, n_blank, n_dup, n_open, illegal, before = set(firsts), [], 0, 0, 0, 0, None
    for m, role, is_blank, is_open, n in zip(mid, initial, blank, open_, copies):
        if is_blank:
            n_blank += n
            symbols.append("x")
        elif m not in firsts:
            n_dup += n
            symbols.append("x")
        else:
            n_dup += n - 1
            n_open += bool(is_open)
            symbol = role if role in ("s", "u", "a") else "o"
            symbols.append(symbol.upper() if is_open else symbol)
        illegal += n - 1 + (before is not None and before + role not in ("su", "ua", "au"))
        before = role
    return "".join(symbols), n_blank, n_dup, n_open, illegal


def segments(turns: DataFrame) -> DataFrame:
    """One row for at most ``SEGMENT`` rows of a conversation, written."""
    rows = _numbered(turns)
    first = rows.where(~F.col("blank")).groupBy("conv", "same").agg(F.min(F.struct("mid", "block")).alias("f"))
    row = F.struct("mid", "initial", "blank", "open", "copies")
    both = (rows.select("conv", "block", row.alias("row"), F.lit(None).cast("long").alias("first"))
            .unionByName(first.select("conv", F.col("f.block").alias("block"), F.lit(None).cast(row_type()).alias("row"),
                                      F.col("f.mid").alias("first"))))
    held = (both.groupBy("conv", "block").agg(F.sort_array(F.collect_list("row")).alias("r"),
                                              F.collect_list("first").alias("firsts")))
    flat = held.select("conv", "block", "firsts", *[F.col(f"r.{c}").alias(c) for c in ("mid", "initial", "blank", "open", "copies")])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            facts = [_read_segment(*x) for x in zip(f["mid"], f["initial"], f["blank"], f["open"], f["copies"], f["firsts"])]
            out = f[["conv", "block", "mid", "copies"]].copy()
            for i, c in enumerate(("symbols", "blank", "duplicate", "truncated", "illegal")):
                out[c] = [x[i] for x in facts]
            out["head"], out["tail"] = [x[0] for x in f["initial"]], [x[-1] for x in f["initial"]]
            yield out

    return written(flat.mapInPandas(read, "conv string, block long, mid array<long>, copies array<long>, symbols string, "
                                          "blank long, duplicate long, truncated long, illegal long, head string, tail string"),
                   "segments")


def row_type() -> str:
    return "struct<mid: bigint, initial: string, blank: boolean, open: boolean, copies: bigint>"


# ---- auction --------------------------------------------------------------

@functools.cache
def moves(symbol: str, q: int) -> tuple[tuple[str, int, int, int], ...]:
    """Edits in state ``q`` before a row: (initial, cost, layers, next state),
    least initial first."""
    more, role = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
    due = ASSISTANT if q == USER else USER
    kept = 1 if role == "s" and q == 0 else due if role == ROLES[due][0] else None
    out = [("D", DELETE, 1, q), ("I", INSERT, 0, due)]
    if kept is not None:
        out.append(("K", KEEP + more, 1, kept))
    if kept != due:
        out.append(("R", REROLE + more, 1, due))
    return tuple(out)


def row_lattice(symbols: str) -> list[list[tuple[str, int, int]]]:
    """Arcs (initial, cost, node) of each node ``4 * layer + state``; the last
    layer has none yet."""
    out = [[(label, cost, STATES * (i + step) + to) for label, cost, step, to in moves(s, q)]
           for i, s in enumerate(symbols) for q in range(STATES)]
    return out + [[] for _ in range(STATES)]


def matrix_lattice(matrices: Sequence[Sequence[int]]) -> list[list[tuple[str, int, int]]]:
    """Arcs between boundaries of segments; -1 in a matrix is no way."""
    out = [[("", m[STATES * q + to], STATES * (i + 1) + to) for to in range(STATES) if m[STATES * q + to] >= 0]
           for i, m in enumerate(matrices) for q in range(STATES)]
    return out + [[] for _ in range(STATES)]


def closed(lattice: list[list[tuple[str, int, int]]], exits: Sequence[int]) -> list[list[tuple[str, int, int]]]:
    """The lattice with a destination (its last node) that each state of the
    last layer reaches at its price (-1: never), without arcs that lead
    nowhere."""
    goal = len(lattice)
    out = [list(a) for a in lattice] + [[]]
    for q, price in enumerate(exits):
        out[goal - STATES + q] = [("", price, goal)] if price >= 0 else []
    leads = [False] * goal + [True]
    for layer in range(goal - STATES, -1, -STATES):
        for _ in range(STATES):  # arcs inside a layer
            for u in range(layer, layer + STATES):
                leads[u] = leads[u] or any(leads[v] for _, _, v in out[u])
    return [[a for a in arcs if leads[a[2]]] for arcs in out]


def auction(arcs: list[list[tuple[str, int, int]]], prices: list[int], origin: int) -> int | None:
    """Cheapest cost from the origin to the last node; ``prices`` (which must
    not exceed any arc's cost plus its end's price) are raised in place.

    The path's last node either raises its price to the cheapest continuation
    and is contracted away, or the path extends along that arc. Costs are
    integers and no circle of arcs is free, so this ends."""
    goal, path = len(arcs) - 1, [origin]
    if origin != goal and not arcs[origin]:
        return None
    while (u := path[-1]) != goal:
        best, to = min((cost + prices[v], v) for _, cost, v in arcs[u])
        if prices[u] < best:
            prices[u] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return prices[origin] - prices[goal]


def trace(arcs: list[list[tuple[str, int, int]]], prices: list[int], origin: int) -> list[tuple[str, int]]:
    """The tight path with the least labels: (label, node reached) of each
    arc. Tight arcs need not lead on to the goal off the shortest paths;
    nodes that do not are left again."""
    goal, dead = len(arcs) - 1, set()
    steps, nodes = [], [origin]
    while nodes[-1] != goal:
        u = nodes[-1]
        for label, cost, v in arcs[u]:
            if prices[u] == cost + prices[v] and v not in dead:
                steps.append((label, v))
                nodes.append(v)
                break
        else:
            dead.add(nodes.pop())
            steps.pop()
    return steps


@functools.lru_cache(maxsize=20_000)
def solve(symbols: str, exits: tuple[int, ...], entry: int) -> tuple[str, tuple[int, ...], int] | None:
    """Cheapest edits of a segment's rows that may stay, from a state and with
    prices of the states after it: (initials, state after each, cost without
    the price of the last); None where there is no way."""
    arcs = closed(row_lattice(symbols), exits)
    prices = [0] * len(arcs)
    total = auction(arcs, prices, entry)
    if total is None:
        return None
    steps = trace(arcs, prices, entry)[:-1]
    states = tuple(v % STATES for _, v in steps)
    last = states[-1] if states else entry
    return "".join(label for label, _ in steps), states, total - exits[last]


def matrix(symbols: str) -> list[int]:
    """Cheapest cost from each state to each state over a segment, -1 for none."""
    stay = symbols.replace("x", "")
    ways = [solve(stay, tuple(0 if q == to else -1 for q in range(STATES)), start)
            for start in range(STATES) for to in range(STATES)]
    return [-1 if w is None else w[2] for w in ways]


def product(matrices: Sequence[Sequence[int]]) -> list[int]:
    """Cheapest costs over consecutive segments."""
    out = []
    lattice = matrix_lattice(matrices)
    for to in range(STATES):
        arcs = closed(lattice, [0 if q == to else -1 for q in range(STATES)])
        prices = [0] * len(arcs)
        out.append([auction(arcs, prices, start) for start in range(STATES)])
    return [-1 if out[to][start] is None else out[to][start] for start in range(STATES) for to in range(STATES)]


def boundary_prices(matrices: Sequence[Sequence[int]], exits: Sequence[int]) -> list[list[int]]:
    """Prices of the states after each segment, given those after the last."""
    arcs = closed(matrix_lattice(matrices), exits)
    prices = [0] * len(arcs)
    found = [[auction(arcs, prices, STATES * k + q) for q in range(STATES)] for k in range(len(matrices) - 1, 0, -1)]
    return found[::-1] + [list(exits)]


# ---- the tree over long conversations -------------------------------------

def _per_parent(nodes: DataFrame, work, schema: str, name: str) -> DataFrame:
    """``work(children in order)`` for each tree node; at most ``SEGMENT``
    children each."""
    def each(f: pd.DataFrame) -> pd.DataFrame:
        return work(f.sort_values("rel"))

    return written(nodes.withColumn("parent", F.floor(F.col("rel") / SEGMENT)).groupBy("conv", "parent")
                   .applyInPandas(each, schema), name)


def _with_parent(nodes: DataFrame, parents: DataFrame, value: str) -> DataFrame:
    up = parents.select("conv", F.col("rel").alias("parent"), F.col(value).alias(f"parent_{value}"))
    return nodes.withColumn("parent", F.floor(F.col("rel") / SEGMENT)).join(up, ["conv", "parent"])


def boundaries(leaves: DataFrame, height: int) -> DataFrame:
    """State that each segment of a long conversation is entered in and the
    prices after it: ``conv, rel, entry, exits``."""
    spark = leaves.sparkSession

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["conv", "rel"]].assign(m=[matrix(s) for s in f["symbols"]])

    def up(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv": f["conv"][:1], "rel": f["parent"][:1], "m": [product(list(f["m"]))]})

    def down(f: pd.DataFrame) -> pd.DataFrame:
        return f[["conv", "rel"]].assign(exits=boundary_prices(list(f["m"]), [int(x) for x in f["parent_exits"].iloc[0]]))

    def exit_states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["conv", "rel"]].assign(to=[[_exit(s, x, q) for q in range(STATES)] for s, x in zip(f["symbols"], f["exits"])])

    def composed(f: pd.DataFrame) -> pd.DataFrame:
        to = list(range(STATES))
        for step in f["to"]:
            to = [int(step[q]) for q in to]
        return pd.DataFrame({"conv": f["conv"][:1], "rel": f["parent"][:1], "to": [to]})

    def entered(f: pd.DataFrame) -> pd.DataFrame:
        q, out = int(f["parent_entry"].iloc[0]), []
        for step in f["to"]:
            out.append(q)
            q = int(step[q])
        return f[["conv", "rel"]].assign(entry=out)

    levels = [written(leaves.select("conv", "rel", "symbols").mapInPandas(matrices, "conv string, rel long, m array<long>"), "tree")]
    for _ in range(height - 1):
        levels.append(_per_parent(levels[-1], up, "conv string, rel long, m array<long>", "tree"))
    exits = levels[-1].select("conv").distinct().select("conv", F.lit(0).cast("long").alias("rel"),
                                                         F.array(*map(F.lit, END)).cast("array<long>").alias("exits"))
    for nodes in reversed(levels):
        exits = _per_parent(_with_parent(nodes, exits, "exits"), down, "conv string, rel long, exits array<long>", "prices")
    priced = leaves.select("conv", "rel", "symbols").join(exits, ["conv", "rel"])
    steps = [written(priced.mapInPandas(exit_states, "conv string, rel long, to array<long>"), "steps")]
    for _ in range(height - 1):
        steps.append(_per_parent(steps[-1], composed, "conv string, rel long, to array<long>", "steps"))
    entry = steps[-1].select("conv").distinct().select("conv", F.lit(0).cast("long").alias("rel"), F.lit(0).alias("entry"))
    for nodes in reversed(steps):
        entry = _per_parent(_with_parent(nodes, entry, "entry"), entered, "conv string, rel long, entry int", "entries")
    return exits.join(entry, ["conv", "rel"])


def _exit(symbols: str, exits, entry: int) -> int:
    """State after a segment on its least tight path."""
    _, states, _ = solve(symbols.replace("x", ""), tuple(int(x) for x in exits), entry)
    return states[-1] if states else entry


# ---- edits ----------------------------------------------------------------

def spelled(symbols: str, mid, copies, exits: tuple[int, ...], entry: int, last: bool):
    """A segment's edits in order: lists of row numbers (-1 for inserted),
    initials, how often, new roles (None: as it is); and their cost."""
    stay = symbols.replace("x", "")
    labels, states, cost = solve(stay, exits, entry)
    rows, ops, times, roles, at = [], [], [], [], 0

    def put(row: int, op: str, n: int, role: str | None) -> None:
        rows.append(row)
        ops.append(op)
        times.append(n)
        roles.append(role)

    for symbol, m, n in zip(symbols, mid, copies):
        m, n = int(m), int(n)
        if symbol == "x":
            put(m, "D", n, None)
            cost += DELETE * n
            continue
        while labels[at] == "I":
            put(-1, "I", 1, ROLES[states[at]])
            at += 1
        put(m, labels[at], 1, ROLES[states[at]] if labels[at] == "R" else None)
        at += 1
        if n > 1:
            put(m, "D", n - 1, None)
            cost += DELETE * (n - 1)
    state = states[-1] if states else entry
    if last:
        cost += END[state]
        for role in {1: ("user", "assistant"), USER: ("assistant",)}.get(state, ()):
            put(-1, "I", 1, role)
    return rows, ops, times, roles, cost


EDITS = "conv string, rel long, mid array<long>, op array<string>, n array<long>, role array<string>, cost long"


def edited(parts: DataFrame) -> DataFrame:
    """Edits of every segment, written: ``conv``, ``rel`` (place in the
    conversation), and in order ``mid`` (row, -1 for inserted), ``op``, ``n``,
    ``role`` (new role or null); ``cost``."""
    span = parts.groupBy("conv").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    leaves = parts.join(span, "conv").select("conv", (F.col("block") - F.col("lo")).alias("rel"),
                                             (F.col("block") == F.col("hi")).alias("last"), "symbols", "mid", "copies")
    longest, height = span.agg(F.max(F.col("hi") - F.col("lo"))).head()[0] or 0, 0
    while longest:
        longest, height = longest // SEGMENT, height + 1
    if height:
        several = span.where("hi > lo").select("conv")
        known = boundaries(leaves.join(several, "conv", "left_semi"), height)
        leaves = leaves.join(known, ["conv", "rel"], "left")
    else:
        leaves = leaves.withColumns({"entry": F.lit(None).cast("int"), "exits": F.lit(None).cast("array<long>")})
    leaves = leaves.withColumns({"entry": F.coalesce("entry", F.lit(0)), "exits": F.coalesce("exits", F.array(*map(F.lit, END)).cast("array<long>"))})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [spelled(s, m, c, tuple(int(x) for x in e), int(q), bool(z))
                    for s, m, c, e, q, z in zip(f["symbols"], f["mid"], f["copies"], f["exits"], f["entry"], f["last"])]
            out = f[["conv", "rel"]].copy()
            for i, c in enumerate(("mid", "op", "n", "role", "cost")):
                out[c] = [x[i] for x in made]
            yield out

    return written(leaves.mapInPandas(work, EDITS), "edits")


def repaired(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows that stay, inserted ones among them: ``conv, rel, place, turn,
    role, text, op``; (rel, place) orders a conversation."""
    each = edits.select("conv", "rel", F.posexplode(F.arrays_zip("mid", "op", "role")).alias("place", "e"))
    each = each.select("conv", "rel", "place", "e.mid", "e.op", F.col("e.role").alias("new"))
    kept = each.where(F.col("op").isin("K", "R")).join(turns.select("mid", "turn", "role", "text"), "mid")
    made = each.where("op = 'I'").select("conv", "rel", "place", F.lit(None).cast("long").alias("turn"),
                                         F.col("new").alias("role"), F.lit("").alias("text"), "op")
    return kept.select("conv", "rel", "place", "turn", F.coalesce("new", "role").alias("role"), "text", "op").unionByName(made)


def digests(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv, audit, repaired_sha256``: sorted rows of a conversation stream
    through one hash."""
    initials = F.array_join(F.zip_with("op", "n", lambda o, n: F.repeat(o, n.cast("int"))), "")
    line = (edits.select("conv", "rel", F.lit(-1).alias("place"), initials.alias("audit"), F.lit(None).cast("string").alias("line"))
            .unionByName(rows.select("conv", "rel", "place", F.lit(None).cast("string").alias("audit"),
                                     F.concat("role", F.lit(":"), "text").alias("line"))))
    ordered = line.repartition("conv").sortWithinPartitions("conv", "rel", "place").drop("rel", "place")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, audit, sha, any_line = None, [], hashlib.sha256(), False
        for f in frames:
            out = []
            for c, a, text in zip(f["conv"], f["audit"], f["line"]):
                if c != conv:
                    if conv is not None:
                        out.append((conv, "".join(audit), sha.hexdigest()))
                    conv, audit, sha, any_line = c, [], hashlib.sha256(), False
                if a is not None:
                    audit.append(a)
                if text is not None:
                    sha.update(("\n" if any_line else "").encode() + text.encode("utf-8", "surrogatepass"))
                    any_line = True
            yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])
        if conv is not None:
            yield pd.DataFrame([(conv, "".join(audit), sha.hexdigest())], columns=["conv", "audit", "repaired_sha256"])

    return ordered.mapInPandas(work, "conv string, audit string, repaired_sha256 string")


def audited(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the table: ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256`` of its
    damaged rows."""
    turns = placed(damaged(conversations))
    parts = segments(turns)
    edits = edited(parts)
    found = digests(edits, repaired(turns, edits))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    texts = ("audit", "repaired_sha256")

    def piece(frame: DataFrame, **known: Column) -> DataFrame:
        return frame.select("conv", known.get("conv_id", F.lit(None).cast(conversations.schema["conv_id"].dataType)).alias("conv_id"),
                            *[known.get(c, F.lit(None)).cast("long").alias(c) for c in numbers],
                            *[known.get(c, F.lit(None)).cast("string").alias(c) for c in texts])

    ids = conversations.select(conversation_key(F.col("conv_id")).alias("conv"), "conv_id").distinct()
    turned = turns.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    edge = (parts.select("conv", "block", "head", F.lit(None).cast("string").alias("tail"))
            .unionByName(parts.select("conv", (F.col("block") + 1).alias("block"), F.lit(None).cast("string").alias("head"), "tail")))
    pairs = edge.groupBy("conv", "block").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    wrong = pairs.where(F.col("head").isNotNull() & F.col("tail").isNotNull()
                        & ~F.concat("tail", "head").isin("su", "ua", "au"))
    pieces = [piece(ids, conv_id=F.col("conv_id")), piece(turned, gaps=F.col("gaps")), piece(wrong, illegal=F.lit(1)),
              piece(parts, **{c: F.col(c) for c in numbers[1:5]}), piece(edits, cost=F.col("cost")),
              piece(found, **{c: F.col(c) for c in texts})]
    whole = functools.reduce(DataFrame.unionByName, pieces).groupBy("conv").agg(
        F.max("conv_id").alias("conv_id"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    return whole.drop("conv")
