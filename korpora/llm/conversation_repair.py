r"""Cheapest repair of conversations, by cost layers of reachable grammar states.

``damaged`` makes faulty conversations of sound ones, as a test bed; ``repaired`` repairs any. Rows of a conversation are taken by turn (nulls first; ties by role, then by the
first characters of the text, then by a hash of both; equal rows are interchangeable). A row is blank (no character but white space), else a duplicate (role and text were there before), else truncated (its last such
character is none of ``.!?``), else sound. Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows have no other choice), Insert an empty user or assistant turn
anywhere 5; a truncated row that stays costs 5 more. The initials of the roles must then fit ``(s?(ua)+)?``. A role's initial is its first character; an empty role has none and can't be kept.

Method: the grammar has four states. For each turn, from the last to the first, a bitset holds one layer of states for each increasing cost, relative to the cheapest: bit (cost, state) says that the rest of the
conversation can be accepted from the state at that cost. An edit of cost c is a permutation of the states' bits and a shift by c layers. Inserting reaches any state that matters within
two edits, so the layers that matter span a few costs and fit 64 bits. The first layer with the start state gives the cost; following the bits from the first turn on, the least letter first, gives the
cheapest audit that is least in ASCII.

Plan: rows are sorted globally by conversation and turn (a range shuffle; equal rows are spread by a running number), so a conversation of any length lies in neighbouring partitions. One that lies inside a partition is repaired there at
once. The others are cut into pieces of bounded size: the first appearance of each (role, text) is an aggregation over hashes, each piece gives the costs from each state to each state, a scan
over these small matrices gives the costs to go at the end of every piece, and the pieces stream by once more, in order, for trace and hash. No conversation is held whole; only its audit (a letter an edit) and
its hash pass through one task, as both are one value of the result.

Nulls: a null role or text, and a null in a damage key, is one space; a null turn sorts first and is no gap; rows with a null conv_id are one conversation. Repeated rows are duplicates. Empty
tables give no rows; other columns, clashing names included, are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpora.llm.common import mapped, stored

SPACES = " \t\n\x0b\x0c\r"
#: Rows and characters of a piece of a long conversation.
PIECE_ROWS, PIECE_CHARS = 1 << 14, 8 << 20
#: Characters of role and text that range bounds hold.
BOUND = 32
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
EDITS = {"K": 0, "R": 1, "D": 2, "I": 5}
KEEP, REROLE, DELETE, INSERT = EDITS.values()
#: What a truncated row that stays costs more.
CUT = 5

# ---- layers ----

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES, START, ACCEPTING = 4, 0, (0, 3)
BY_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: What a turn with a role of choice leads to; the role that fits is never in doubt.
BY_CHOICE, ROLE = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
LAYERS = 16
EVERY = sum(1 << 4 * i for i in range(LAYERS + 12))
MASK = (1 << 4 * LAYERS) - 1
FAR = 1 << 62


def chosen(bits: int) -> int:
    """States from which a turn with a role of choice leads to one in ``bits``."""
    return (bits >> 3 & EVERY) << 2 | (bits >> 2 & EVERY) * 0b1011


def kept(bits: int, initial: str) -> int:
    if initial == "u":
        return (bits >> 2 & EVERY) * 0b1011
    if initial == "a":
        return (bits >> 3 & EVERY) << 2
    return bits >> 1 & EVERY if initial == "s" else 0


def closed(base: int, bits: int) -> tuple[int, int]:
    """With up to two inserted turns; the layers start at the cheapest."""
    bits |= chosen(bits) << 4 * INSERT
    bits |= chosen(bits) << 4 * INSERT
    low = ((bits & -bits).bit_length() - 1) // 4
    return base + low, bits >> 4 * low & MASK


def from_costs(costs: list[int]) -> tuple[int, int]:
    base = min(costs)
    return base, sum(1 << 4 * (c - base) + s for s, c in enumerate(costs) if c - base < LAYERS)


def to_costs(base: int, bits: int) -> list[int]:
    """The least cost of each state."""
    out = []
    for s in range(STATES):
        own = bits >> s & EVERY
        out.append(base + ((own & -own).bit_length() - 1) // 4 if own else FAR)
    return out


#: A row as the grammar sees it: None if it must go, else its initial and whether it is truncated.
Turn = tuple[str, bool] | None


def layers(turns: list[Turn], end: list[int]) -> list[tuple[int, int]]:
    """Before each turn, and after the last, the layers of states; ``end``: costs to go after the last."""
    base, bits = closed(*from_costs(end))
    out = [(base, bits)]
    for t in reversed(turns):
        if t is None:
            base += DELETE
        else:
            more = CUT if t[1] else 0
            base, bits = closed(base, bits << 4 * DELETE | kept(bits, t[0]) << 4 * (KEEP + more) | chosen(bits) << 4 * (REROLE + more))
        out.append((base, bits))
    return out[::-1]


def traced(turns: list[Turn], end: list[int], state: int, last: bool) -> tuple[str, int]:
    """The least of the cheapest audits from ``state``, and the state after it; a piece that isn't the last leaves what may be inserted after it to the next one."""
    steps = layers(turns, end)
    costs = [to_costs(*x) if i == len(turns) or turns[i] is not None else None for i, x in enumerate(steps)]
    for i in range(len(turns) - 1, -1, -1):
        if costs[i] is None:
            costs[i] = [c + DELETE for c in costs[i + 1]]
    letters = []
    for i, t in enumerate(turns):
        if t is None:
            letters.append("D")
            continue
        more = CUT if t[1] else 0
        while True:
            here, there, own = costs[i][state], costs[i + 1], BY_KEEP.get(t[0], {}).get(state)
            if DELETE + there[state] == here:
                letters.append("D")
            elif INSERT + costs[i][BY_CHOICE[state]] == here:
                letters.append("I")
                state = BY_CHOICE[state]
                continue
            elif own is not None and KEEP + more + there[own] == here:
                letters.append("K")
                state = own
            else:
                letters.append("R")
                state = BY_CHOICE[state]
            break
    while last and costs[-1][state]:
        letters.append("I")
        state = BY_CHOICE[state]
    return "".join(letters), state


ACCEPTED = to_costs(*closed(*from_costs([0 if s in ACCEPTING else FAR for s in range(STATES)])))

# ---- conversations ----

FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repair:
    """A conversation that comes in pieces."""

    def __init__(self):
        self.n = dict.fromkeys(FIGURES, 0)
        self.first = self.turn = self.before = None
        self.distinct, self.state, self.audits, self.hash, self.empty = 0, START, [], hashlib.sha256(), True

    def piece(self, rows: list[tuple], end: list[int], last: bool) -> str:
        """Takes rows (turn, role, text, fault); gives the repaired text of the piece."""
        turns: list[Turn] = []
        for turn, role, _, fault in rows:
            for k, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated")):
                self.n[name] += fault == k
            if turn is not None:
                self.distinct += turn != self.turn
                self.first = turn if self.first is None else self.first
                self.turn = turn
            initial = role[:1]
            self.n["illegal"] += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
            turns.append(None if fault in (BLANK, DUPLICATE) else (initial, fault == TRUNCATED))
        audit, state = traced(turns, end, self.state, last)
        lines, i, at = [], 0, self.state
        for letter in audit:
            row = rows[i] if letter != "I" else None
            i += letter != "I"
            if letter == "K":
                at = BY_KEEP[row[1][:1]][at]
                lines.append(f"{row[1]}:{row[2]}")
            elif letter != "D":
                at = BY_CHOICE[at]
                lines.append(f"{ROLE[at]}:{row[2] if row else ''}")
            self.n["cost"] += EDITS[letter] + (CUT if letter in "KR" and row[3] == TRUNCATED else 0)
        self.state = state
        text = "\n".join(lines)
        if lines:
            self.hash.update(("" if self.empty else "\n").encode() + text.encode("utf-8", "replace"))
            self.empty = False
        self.audits.append(audit)
        return text

    def result(self) -> dict:
        gaps = self.turn - self.first + 1 - self.distinct if self.first is not None else 0
        return self.n | {"gaps": gaps, "audit": "".join(self.audits), "repaired_sha256": self.hash.hexdigest()}


RESULT = "conv_id long, block int, last boolean, repaired string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECES = "part long, piece int, turns array<long>, roles array<string>, texts array<string>, faults array<int>"
COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: one row in twenty each is dropped (0 copies), emptied, loses its full stops, is repeated (2 copies) or becomes the user's, by the crc32 of ``conv_id:turn``."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_k"))
    k = F.col("_k")
    return rows.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"),
    )


def sound(conversations: DataFrame) -> DataFrame:
    """Rows as they are, as ``repaired`` wants them."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def in_order(rows: DataFrame) -> DataFrame:
    """Sorted over all partitions by conversation and place, with the fault that needs no other row."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    keyed = rows.select("*", fault.alias("fault"), F.substring("role", 1, BOUND).alias("_r"), F.substring("text", 1, BOUND).alias("_t"), F.xxhash64("role", "text").alias("_h"), F.monotonically_increasing_id().alias("_i"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "_r", "_t", "_h"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(n, *keys, "_i").sortWithinPartitions(*keys, "role", "text").select("conv_id", "turn", "role", "text", "fault", "copies")


def first_pass(rows: DataFrame) -> DataFrame:
    """Results of conversations that lie inside a partition; pieces of those that may go on in another, or are long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, n = TaskContext.get().partitionId(), 0
        names = [*COLUMNS, *[x.split()[0] for x in PIECES.split(", ")]]
        flat = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "copies")), strict=True))
        out: list[dict] = []
        waiting = None  # the last conversation so far, if it is whole; it may go on in the next partition

        def piece(conv, rows):
            nonlocal n
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            out.append({"conv_id": conv, "part": part, "piece": n} | {k: list(c) for k, c in zip(("turns", "roles", "texts", "faults"), columns, strict=True)})
            n += 1

        def table():
            done = {c: [r.get(c) for r in out] for c in names}
            out.clear()
            return done

        for k, (conv, group) in enumerate(groupby(flat, key=lambda r: r[0])):
            if waiting:
                whole(out, *waiting)
                waiting = None
            rows, held, cut = [], 0, k == 0
            for _, turn, role, text, fault, copies in group:
                rows += [(turn, role, text, fault)] * copies
                held += len(text)
                if len(rows) >= PIECE_ROWS or held >= PIECE_CHARS:
                    piece(conv, rows)
                    yield table()
                    rows, held, cut = [], 0, True
            if cut:
                piece(conv, rows)
            else:
                waiting = (conv, rows)
            if len(out) >= 512:
                yield table()
        if waiting:
            piece(*waiting)
        yield table()

    return mapped(rows, work, f"{RESULT}, {PIECES}")


def whole(out: list[dict], conv: int | None, rows: list[tuple]) -> None:
    """Repairs a conversation that is all there."""
    seen = set()
    for i, (turn, role, text, fault) in enumerate(rows):
        if fault != BLANK and (role, text) in seen:
            rows[i] = (turn, role, text, DUPLICATE)
        seen.add((role, text))
    r = Repair()
    text = r.piece(rows, ACCEPTED, True)
    out.append({"conv_id": conv, "block": 0, "last": True, "repaired": text} | r.result())


def with_duplicates(pieces: DataFrame) -> DataFrame:
    """The pieces, with the rows marked whose role and text were there before."""
    rows = pieces.select("conv_id", "part", "piece", F.explode(F.arrays_zip("roles", "texts", F.sequence(F.lit(0), F.size("roles"))).alias("x")).alias("x")).filter("x.roles IS NOT NULL")
    place = F.struct("part", "piece", F.col("x.2").alias("i"))
    firsts = rows.groupBy("conv_id", F.xxhash64("x.roles", "x.texts").alias("h"), F.xxhash64(F.lit(1), "x.texts", "x.roles").alias("g")).agg(F.min(place).alias("p"))
    own = firsts.groupBy("p.part", "p.piece").agg(F.sort_array(F.collect_list("p.i")).alias("new"))
    marked = F.transform("faults", lambda f, i: F.when((f == BLANK) | F.array_contains("new", i), f).otherwise(F.lit(DUPLICATE)))
    return pieces.join(own, ["part", "piece"], "left").withColumn("new", F.coalesce("new", F.array().cast("array<int>"))).withColumn("faults", marked).drop("new")


def grammar(roles: list[str], faults: list[int]) -> list[Turn]:
    return [None if f in (BLANK, DUPLICATE) else (r[:1], f == TRUNCATED) for r, f in zip(roles, faults, strict=True)]


def matrices(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, piece, costs): costs[4 s + e] of the way from state s to state e through a piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for conv, part, piece, roles, faults in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "piece", "roles", "faults")), strict=True):
                turns = grammar(roles, faults)
                to = [to_costs(*layers(turns, [0 if s == e else FAR for s in range(STATES)])[0]) for e in range(STATES)]
                yield {"conv_id": [conv], "part": [part], "piece": [piece], "costs": [[to[e][s] for s in range(STATES) for e in range(STATES)]]}

    return mapped(pieces.select("conv_id", "part", "piece", "roles", "faults"), work, "conv_id long, part long, piece int, costs array<long>")


def costs_to_go(steps: DataFrame) -> DataFrame:
    """(part, piece, end, last): the costs to go at the end of each piece, from the last to the first. A row of some bytes stands for a piece of thousands of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "piece", "costs")), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            end, last = ACCEPTED, True
            for _, part, piece, costs in group:
                yield {"part": [part], "piece": [piece], "end": [end], "last": [last]}
                end, last = [min(min(costs[STATES * s + e] + end[e] for e in range(STATES)), FAR) for s in range(STATES)], False

    by = [F.desc("part"), F.desc("piece")]
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(steps.repartition(n, "conv_id").sortWithinPartitions("conv_id", *by), work, "part long, piece int, end array<long>, last boolean")


def streamed(pieces: DataFrame) -> DataFrame:
    """Result rows, one a piece; the last of a conversation has its figures."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turns", "roles", "texts", "faults", "end", "last")), strict=True))
        for conv, group in groupby(rows, key=lambda r: r[0]):
            repair = Repair()
            for block, (_, turns, roles, texts, faults, end, last) in enumerate(group):
                text = repair.piece(list(zip(turns, roles, texts, faults, strict=True)), end, last)
                row = {"conv_id": conv, "block": block, "last": last, "repaired": text} | (repair.result() if last else {})
                yield {c: [row.get(c)] for c in COLUMNS}

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mapped(pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "piece"), work, RESULT)


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation (conv_id, repaired text, figures, audit, hash), or one a piece of a long one, numbered by ``block``; the figures stand in the row that is ``last``.

    ``rows``: conv_id, turn, role, text, copies, as ``damaged`` and ``sound`` give them; a row of 0 copies only says that there is such a conversation.
    """
    found = stored(first_pass(in_order(rows)), "repair-first-pass")
    pieces = stored(with_duplicates(found.filter("piece IS NOT NULL").select("conv_id", *[x.split()[0] for x in PIECES.split(", ")])), "repair-pieces")
    ends = costs_to_go(matrices(pieces))
    return found.filter("piece IS NULL").select(*COLUMNS).unionAll(streamed(pieces.join(ends, ["part", "piece"])))


def figures(results: DataFrame) -> DataFrame:
    """conv_id, the figures, audit and hash: one row a conversation."""
    return results.filter("last").select("conv_id", *FIGURES, "audit", "repaired_sha256")
