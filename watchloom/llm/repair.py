"""Conversation repair: the cheapest edits that give every conversation a legal order of roles, by Hirschberg's division.

A conversation is read as steps between four states: nothing said, a system message, a user's turn, an assistant's turn. For
a stretch of rows, what it costs to get from state to state is a 4 x 4 table; tables of two halves give the table of the
whole. To find the edits, the costs from the front and from the back meet in the middle of a stretch, the state of least
audit among the cheapest is fixed, and both halves are solved alike. Space is linear in the rows of a chunk, and a
conversation of any length is cut into chunks that meet in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import SPACES
from watchloom.session import materialize

#: Bits of the number of a row in a chunk: chunks have at most 8,192 rows.
CHUNK = 13
#: Bytes of repaired text that are handed on at a time, where a conversation goes on in another chunk.
PIECE = 1 << 20
#: States: nothing yet, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: Fixed values of the costs.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Classes of rows: kept ones by role (system, user, assistant, other), whole and truncated, and those that must go.
ROLES, MUST_GO = "sua", 8
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# -- costs ---------------------------------------------------------------------------------


def insertions(state: int) -> list[tuple[int, str]]:
    """(state, audit) after no, one or two insertions; more never pay."""
    turn = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    return [(state, ""), (turn[state], "I"), (turn[turn[state]], "II")]


def row_paths(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of the best way over a row of a class, by the states before and after it.

    A way ends with the edit of the row, so no audit of one state continues that of another: the least audits of longer
    stretches follow from the order of these.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        for state, audit in insertions(before):
            ways = [(state, "D", DELETE)]
            if kind != MUST_GO:
                role, extra = kind % 4, TRUNCATED * (kind // 4)
                if role == 0 and state == NOTHING:
                    ways.append((SYSTEM, "K", extra))
                follows = ASSISTANT if state == USER else USER
                if role < 3 and "  ua"[follows] == ROLES[role]:
                    ways.append((follows, "K", extra))
                ways.append((follows, "R", REROLE + extra))
            for after, letter, cost in ways:
                found = cost + INSERT * len(audit), audit + letter
                if (before, after) not in best or found < best[before, after]:
                    best[before, after] = found
    return best


PATHS = [row_paths(kind) for kind in range(MUST_GO + 1)]
#: What it costs to end in a state, and how.
END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
END_AUDIT = ["", "II", "I", ""]


def row_tables() -> tuple[np.ndarray, np.ndarray]:
    """(costs, orders) of the classes: orders[k, s] ranks the audits of a row's ways from state s."""
    costs = np.full((len(PATHS), 4, 4), FAR, dtype=np.int64)
    orders = np.zeros_like(costs)
    for kind, paths in enumerate(PATHS):
        for before in range(4):
            ways = sorted((paths[before, after][1], after) for after in range(4) if (before, after) in paths)
            for rank, (_, after) in enumerate(ways):
                costs[kind, before, after] = paths[before, after][0]
                orders[kind, before, after] = rank
    return costs, orders


ROW_COSTS, ROW_ORDERS = row_tables()


def joined(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of stretches from the tables of their halves: cheapest crossing, of those the one of least audit."""
    cost = np.minimum(first[0][:, :, :, None] + second[0][:, None, :, :], FAR)
    via = (cost * 4 + first[1][:, :, :, None]).argmin(axis=2)[:, :, None, :]
    total = np.take_along_axis(cost, via, axis=2)[:, :, 0]
    # The audit of the first half decides, then that of the second.
    half = np.take_along_axis(np.broadcast_to(first[1][:, :, :, None], cost.shape), via, axis=2)[:, :, 0]
    rest = np.take_along_axis(np.broadcast_to(second[1][:, None, :, :], cost.shape), via, axis=2)[:, :, 0]
    key = np.where(total >= FAR, 1 << 20, half * 4 + rest)
    order = (key[:, :, None, :] < key[:, :, :, None]).sum(axis=3)
    return total, order


class Halves:
    """Tables of all stretches that arise when conversations are halved again and again, from their elements up.

    ``lengths`` says how many elements belong to each conversation, in order. A level holds half as many tables as the one
    below, so all of them together are linear in the elements.
    """

    def __init__(self, costs: np.ndarray, orders: np.ndarray, lengths: np.ndarray) -> None:
        self.levels = [(costs, orders)]
        self.lengths = [np.asarray(lengths)]
        while (self.lengths[-1] > 1).any():
            cost, order = self.levels[-1]
            length = self.lengths[-1]
            starts, half = np.cumsum(length) - length, (length + 1) // 2
            own = np.repeat(starts, half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
            pair = own + 1 < np.repeat(starts + length, half)
            up = cost[own].copy(), order[own].copy()
            both = joined((cost[own[pair]], order[own[pair]]), (cost[own[pair] + 1], order[own[pair] + 1]))
            up[0][pair], up[1][pair] = both
            self.levels.append(up)
            self.lengths.append(half)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[-1]

    def states(self, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state before, state after) of every element, given those of the conversations."""
        for level in range(len(self.levels) - 2, -1, -1):
            cost, order = self.levels[level]
            length = self.lengths[level]
            half = self.lengths[level + 1]
            starts = np.cumsum(length) - length
            own = np.repeat(starts, half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
            pair = own + 1 < np.repeat(starts + length, half)
            first = own[pair]
            # Costs from the front and from the back meet here.
            front, back = cost[first, enter[pair]], cost[first + 1, :, leave[pair]]
            middle = (np.minimum(front + back, FAR) * 4 + order[first, enter[pair]]).argmin(axis=1)
            before, after = np.empty(len(cost), dtype=np.int64), np.empty(len(cost), dtype=np.int64)
            before[own], after[own] = enter, leave
            after[first], before[first + 1], after[first + 1] = middle, middle, leave[pair]
            enter, leave = before, after
        return enter, leave


def last_states(costs: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The state behind the last row of each conversation that begins with nothing said."""
    return (np.minimum(costs[:, NOTHING] + END, FAR) * 4 + orders[:, NOTHING]).argmin(axis=1)


# -- rows ----------------------------------------------------------------------------------


def damaged(talks: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows of ``talks`` after damage, which the id and the turn decide.

    Missing ids and turns count as one blank there, as do missing roles and texts. Rows to drop stay as gone, so that no
    conversation is lost; a row to repeat comes twice.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = talks.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), hit.alias("hit"), F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text", (F.col("hit") == 0).alias("gone"))


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with pos, which orders them by conversation and turn, as a table.

    Turns that are null come first; rows of one turn go by role and text. The sort deals ranges of rows to tasks, so a
    conversation may take any number of them; rows that are equal in everything are dealt by their place in the input.
    """
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "spread")]
    sort = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys).sortWithinPartitions(*keys)
    bare = F.btrim("text", F.lit(SPACES))
    return materialize(sort.select(
        F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text", "gone",
        F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")).alias("same"),
    ), "turns")


def fault_rows(turns: DataFrame) -> DataFrame:
    """pos, conv_id, fault (blank, duplicate, truncated, '' or gone) and kind, the class of costs, without texts."""
    # One row per different message, by partial aggregation; each is joined to its own row by place, so no key is hot.
    heard = turns.where("NOT gone AND NOT blank").groupBy("conv_id", "same").agg(F.min("pos").alias("pos"))
    rows = turns.select("pos", "conv_id", "initial", "gone", "blank", "cut").join(heard.select("pos", F.lit(True).alias("first")), "pos", "left")
    fault = (
        F.when(F.col("gone"), "gone").when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
        .when(F.col("cut"), "truncated").otherwise("")
    )
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(role + F.when(F.col("fault") == "truncated", 4).otherwise(0))
    return rows.withColumn("fault", fault).select("pos", "conv_id", "fault", kind.cast("int").alias("kind"))


# -- chunks --------------------------------------------------------------------------------


class Chunk:
    """The rows of a chunk that are not gone, cut into runs of one conversation, with the tables of all halves."""

    def __init__(self, table: pa.Table) -> None:
        pos = table.column("pos").to_numpy()
        order = np.argsort(pos)
        table = table.take(pa.array(order))
        self.pos = pos[order]
        conv = table.column("conv_id").combine_chunks()
        codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        self.convs = conv.take(pa.array(starts))
        self.begins = self.pos[starts]
        self.sizes = np.diff(np.append(starts, len(codes)))
        self.fault = np.array(table.column("fault").to_pylist(), dtype=object)
        there = self.fault != "gone"
        run = np.repeat(np.arange(len(starts)), self.sizes)
        self.kinds = table.column("kind").to_numpy()[there]
        self.rows = np.flatnonzero(there)
        lengths = np.bincount(run[there], minlength=len(starts))
        #: Runs that have a row left. The others have nothing to solve.
        self.runs = np.flatnonzero(lengths)
        self.lengths = lengths[self.runs]
        self.halves = Halves(ROW_COSTS[self.kinds], ROW_ORDERS[self.kinds], self.lengths)


def edge_tables(faults: DataFrame) -> DataFrame:
    """begin, conv_id, cost, rank: the tables of the first and the last run of each chunk, whose conversations may go on."""
    kind = faults.schema["conv_id"].dataType.simpleString()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        runs = sorted({0, len(chunk.begins) - 1})
        at = {int(r): k for k, r in enumerate(chunk.runs)}
        cost, rank = chunk.halves.whole()
        found = [at.get(r) for r in runs]
        return pa.table({
            "begin": pa.array(chunk.begins[runs]), "conv_id": chunk.convs.take(pa.array(runs)),
            "cost": pa.array([None if k is None else cost[k].ravel().tolist() for k in found], pa.list_(pa.int64())),
            "rank": pa.array([None if k is None else rank[k].ravel().tolist() for k in found], pa.list_(pa.int64())),
        })

    return faults.withColumn("chunk", F.shiftright("pos", CHUNK)).groupBy("chunk").applyInArrow(
        run, f"begin long, conv_id {kind}, cost array<bigint>, rank array<bigint>"
    )


def edge_states(edges: DataFrame) -> DataFrame:
    """begin, enter, leave, ends: the states at the edges of the runs of ``edge_tables``, and whether a run is the last one.

    A conversation has one row here for each chunk it touches, that is one for some thousand of its own.
    """
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("begin")
        cost, rank = table.column("cost"), table.column("rank")
        some = np.flatnonzero(cost.is_valid().to_numpy(zero_copy_only=False))
        enter = np.zeros(table.num_rows, dtype=np.int64)
        leave = np.zeros(table.num_rows, dtype=np.int64)
        ends = np.zeros(table.num_rows, dtype=bool)
        if len(some):
            keep = pa.array(some)
            tables = [c.take(keep).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4) for c in (cost, rank)]
            halves = Halves(*tables, np.array([len(some)]))
            enter[some], leave[some] = halves.states(np.array([NOTHING]), last_states(*halves.whole()))
            ends[some[-1]] = True
        return pa.table({"begin": table.column("begin"), "enter": enter, "leave": leave, "ends": ends})

    # A null id is a conversation of its own; as it shares no group with others, a flag beside it is not needed.
    return edges.groupBy("conv_id").applyInArrow(run, "begin long, enter long, leave long, ends boolean")


def edits(faults: DataFrame, edges: DataFrame) -> DataFrame:
    """chunk, audits, faults: for each chunk, what is done at each of its rows, by order of pos.

    The audit of a row holds the insertions in front of it and its own letter, that of the last row of a conversation
    those behind it, too; a row that is gone has none.
    """
    states = edges.withColumn("chunk", F.shiftright("begin", CHUNK))

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left)
        size = len(chunk.runs)
        given = {b: (s, t, e) for b, s, t, e in zip(*(right.column(c).to_pylist() for c in ("begin", "enter", "leave", "ends")), strict=True)}
        enter, leave, ends = np.zeros(size, np.int64), last_states(*chunk.halves.whole()), np.ones(size, bool)
        for k, begin in enumerate(chunk.begins[chunk.runs].tolist()):
            if begin in given:
                enter[k], leave[k], ends[k] = given[begin]
        before, after = chunk.halves.states(enter, leave)
        audits = [""] * len(chunk.pos)
        for row, kind, s, t in zip(chunk.rows.tolist(), chunk.kinds.tolist(), before.tolist(), after.tolist(), strict=True):
            audits[row] = PATHS[kind][s, t][1]
        for last, state, end in zip((np.cumsum(chunk.lengths) - 1).tolist(), leave.tolist(), ends.tolist(), strict=True):
            if end:
                audits[int(chunk.rows[last])] += END_AUDIT[state]
        return pa.table({
            "chunk": pa.array([key[0].as_py()], pa.int64()), "audits": pa.array([audits], pa.list_(pa.string())),
            "faults": pa.array([chunk.fault.tolist()], pa.list_(pa.string())),
        })

    return faults.withColumn("chunk", F.shiftright("pos", CHUNK)).groupBy("chunk").cogroup(states.groupBy("chunk")).applyInArrow(
        run, "chunk long, audits array<string>, faults array<string>"
    )


# -- results -------------------------------------------------------------------------------


class Piece:
    """What is known of a stretch of a conversation: counts, edges, audit, and its repaired text."""

    def __init__(self, conv, pos: int) -> None:
        self.conv, self.pos = conv, pos
        self.rows, self.counts = 0, dict.fromkeys(FIELDS, 0)
        self.low = self.high = None
        self.first_initial = self.last_initial = None
        self.audit: list[str] = []
        self.lines: list[str] = []
        self.held = 0

    def add(self, turn, role: str, text: str, fault: str, audit: str, state: int) -> int:
        """Takes a row in and gives the state behind it."""
        if fault == "gone":
            return state
        counts = self.counts
        self.rows += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            counts["gaps"] += turn != self.high
            self.high = turn
        initial = role[:1]
        if self.rows == 1:
            self.first_initial = initial
        else:
            counts["illegal"] += self.last_initial + initial not in ("su", "ua", "au")
        self.last_initial = initial
        if fault:
            counts[fault] += 1
        self.audit.append(audit)
        for letter in audit:
            if letter == "D":
                counts["cost"] += DELETE
                continue
            follows = ASSISTANT if state == USER else USER
            if letter == "K":
                state = SYSTEM if initial == "s" else follows
                line = f"{role}:{text}"
            else:
                state = follows
                line = ("assistant:" if state == ASSISTANT else "user:") + (text if letter == "R" else "")
                counts["cost"] += REROLE if letter == "R" else INSERT
            counts["cost"] += TRUNCATED * (letter != "I" and fault == "truncated")
            self.lines.append(line)
            self.held += len(line) + 1
        return state


PIECE_SCHEMA = (
    "pos long, rows long, low long, high long, first_initial string, last_initial string, gaps long, blank long, duplicate long, "
    "truncated long, illegal long, cost long, audit string, text binary"
)


def pieces(turns: DataFrame, edits: DataFrame, edges: DataFrame) -> DataFrame:
    """Pieces of conversations, in order of pos: one for each conversation in a chunk, more where its text is long.

    Each chunk's edits come first, then its rows one by one, so that a task holds the edits of one chunk and one piece of
    text. gaps counts different turns here.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    none = [F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "role", "text")]
    states = edges.select(F.shiftright("begin", CHUNK).alias("chunk"), F.struct("begin", "enter").alias("e"))
    starts = states.groupBy("chunk").agg(F.collect_list("e").alias("starts"))  # two at most
    heads = edits.join(starts, "chunk", "left").select(
        "chunk", F.lit(-1).cast("long").alias("pos"), *none, "audits", "faults",
        F.transform("starts", lambda e: e["begin"]).alias("begins"), F.transform("starts", lambda e: e["enter"]).alias("enters"),
    )
    empty = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in ("audits", "faults", "begins", "enters")]
    rows = turns.select(F.shiftright("pos", CHUNK).alias("chunk"), "pos", "conv_id", "turn", "role", "text", *empty)
    stream = heads.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", "pos")

    def table(done: list[Piece], conv: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([p.conv for p in done], conv), *[pa.array([getattr(p, c) for p in done], pa.int64()) for c in ("pos", "rows", "low", "high")],
            pa.array([p.first_initial for p in done], pa.string()), pa.array([p.last_initial for p in done], pa.string()),
            *[pa.array([p.counts[c] for p in done], pa.int64()) for c in FIELDS],
            pa.array(["".join(p.audit) for p in done], pa.string()),
            pa.array(["".join([x + "\n" for x in p.lines]).encode() for p in done], pa.binary()),
        ], names=["conv_id", "pos", "rows", "low", "high", "first_initial", "last_initial", *FIELDS, "audit", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[Piece] = []
        held, piece, state, at = 0, None, NOTHING, 0
        audits: list[str] = []
        faults: list[str] = []
        enters: dict[int, int] = {}
        conv_type = pa.int64()
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            rows = zip(*[batch.column(c).to_pylist() for c in ("pos", "conv_id", "turn", "role", "text")], strict=True)
            for row, (pos, conv, turn, role, text) in enumerate(rows):
                head = pos < 0
                if piece and (head or conv != piece.conv or pos in enters or piece.held >= PIECE):
                    # A piece that ends for its size leaves its state to the next one.
                    goes_on = not head and conv == piece.conv and pos not in enters
                    state = state if goes_on else NOTHING
                    done.append(piece)
                    held += piece.held
                    piece = None
                    if held > PIECE or len(done) >= 4096:
                        yield table(done, conv_type)
                        done, held = [], 0
                if head:
                    audits, faults, begins, states = [batch.column(c)[row].as_py() or [] for c in ("audits", "faults", "begins", "enters")]
                    enters, at = dict(zip(begins, states, strict=True)), 0
                    continue
                if piece is None:
                    piece, state = Piece(conv, pos), enters.get(pos, state)
                state = piece.add(turn, role, text, faults[at], audits[at], state)
                at += 1
        if piece:
            done.append(piece)
        if done:
            yield table(done, conv_type)

    return stream.mapInArrow(run, f"conv_id {kind}, {PIECE_SCHEMA}")


def assembled(parts: DataFrame) -> DataFrame:
    """One row per conversation from its ``pieces``; a task holds one piece of text at a time."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    stream = parts.repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def closed(s: dict) -> dict:
            # Only then is it known which line feed stood behind the last line.
            if s["tail"]:
                s["hash"].update(s["tail"][:-1])
            spread = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
            return {
                "conv_id": s["conv_id"], "gaps": spread, **{c: s[c] for c in FIELDS[1:]}, "audit": "".join(s["audit"]),
                "repaired_sha256": s["hash"].hexdigest(),
            }

        def table(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
            types = [conv, *[pa.int64()] * len(FIELDS), pa.string(), pa.string()]
            names = ["conv_id", *FIELDS, "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)

        conv = pa.int64()
        for batch in batches:
            conv = batch.schema.field("conv_id").type
            rows = []
            for p in batch.to_pylist():
                if state is None or p["conv_id"] != state["conv_id"]:
                    if state:
                        rows.append(closed(state))
                    state = {
                        "conv_id": p["conv_id"], "low": None, "high": None, "turns": 0, "last": None, "audit": [], "tail": b"",
                        "hash": hashlib.sha256(), **dict.fromkeys(FIELDS, 0),
                    }
                if p["rows"]:
                    # A turn that goes on from the piece before was counted there.
                    state["turns"] += p["gaps"] - (p["low"] is not None and p["low"] == state["high"])
                    state["low"] = p["low"] if state["low"] is None else state["low"]
                    state["high"] = state["high"] if p["high"] is None else p["high"]
                    if state["last"] is not None:
                        state["illegal"] += state["last"] + p["first_initial"] not in ("su", "ua", "au")
                    state["last"] = p["last_initial"]
                    for c in FIELDS[1:]:
                        state[c] += p[c]
                    state["audit"].append(p["audit"])
                    if p["text"]:
                        state["hash"].update(state["tail"])
                        state["tail"] = p["text"]
            if rows:
                yield table(rows, conv)
        if state:
            yield table([closed(state)], conv)

    fields = ", ".join(f"{c} long" for c in FIELDS)
    return stream.mapInArrow(run, f"conv_id {kind}, {fields}, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """A row per conv_id of ``rows`` (conv_id, turn, role, text, gone): faults, the cost of repair, its audit and digest.

    gaps, blank, duplicate, truncated and illegal count what is wrong with the rows as they are; cost and audit are those
    of the cheapest edits, of several the ones whose audit comes first; repaired_sha256 is the digest of the repaired
    ``role:text`` lines. Roles and texts must not be null. A null conv_id is a conversation of its own. Conversations with
    nothing but gone rows have zeros, an empty audit and the digest of nothing. An empty table gives none.
    """
    turns = ordered(rows)
    faults = materialize(fault_rows(turns), "turn-faults")
    edges = materialize(edge_states(edge_tables(faults)), "turn-edges")
    done = materialize(edits(faults, edges), "turn-edits")
    return assembled(pieces(turns, done, edges))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def sql() -> str:
    """The same in DuckDB, row by row: every state keeps its cheapest edits and, of several, those of least audit."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE ins(st, audit, said, nst) AS (VALUES
  ('n', '', '', 'n'), ('n', 'I', chr(10) || 'user:', 'u'), ('n', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'a'),
  ('s', '', '', 's'), ('s', 'I', chr(10) || 'user:', 'u'), ('s', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'a'),
  ('u', '', '', 'u'), ('u', 'I', chr(10) || 'assistant:', 'a'), ('u', 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 'u'),
  ('a', '', '', 'a'), ('a', 'I', chr(10) || 'user:', 'u'), ('a', 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 'a')),
raw AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS name
  FROM conversations),
hit AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, name), lambda c, b: list_reduce(
    list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  )), 4294967295::BIGINT) % 20 AS hit FROM raw),
after AS (SELECT k, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS init,
    rtrim(text, {spaces}) AS bare FROM after),
rows AS (SELECT *, CASE WHEN bare = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(init) OVER (PARTITION BY k ORDER BY i) || init AS pair FROM placed),
best AS (
  SELECT DISTINCT k, 0::BIGINT AS i, 'n' AS st, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS v FROM raw
  UNION ALL
  SELECT k, i, st, min(v) AS v FROM (
    SELECT r.k, r.i, m.st, {{'cost': b.v.cost + {INSERT} * length(ins.audit) + m.cost, 'audit': b.v.audit || ins.audit || m.letter,
      'said': b.v.said || ins.said || m.said}} AS v
    FROM best b JOIN rows r ON r.k = b.k AND r.i = b.i + 1 JOIN ins ON ins.st = b.st,
    LATERAL (
      SELECT ins.nst AS st, 'D' AS letter, {DELETE} AS cost, '' AS said
      UNION ALL SELECT r.init, 'K', (r.fault = 'truncated')::INT, chr(10) || r.role || ':' || r.text
        WHERE r.fault IN ('', 'truncated') AND (ins.nst || r.init IN ('ns', 'nu', 'su', 'au', 'ua'))
      UNION ALL SELECT CASE ins.nst WHEN 'u' THEN 'a' ELSE 'u' END, 'R', {REROLE} + (r.fault = 'truncated')::INT,
        chr(10) || CASE ins.nst WHEN 'u' THEN 'assistant:' ELSE 'user:' END || r.text
        WHERE r.fault IN ('', 'truncated')) AS m)
  GROUP BY k, i, st),
size AS (SELECT raw.k, any_value(conv_id) AS conv_id, (SELECT count(*) FROM rows WHERE rows.k = raw.k) AS n FROM raw GROUP BY raw.k),
done AS (SELECT size.k, min({{'cost': v.cost + {INSERT} * length(ins.audit), 'audit': v.audit || ins.audit, 'said': v.said || ins.said}}) AS v
  FROM size JOIN best ON best.k = size.k AND best.i = size.n JOIN ins ON ins.st = best.st WHERE ins.nst IN ('n', 'a') GROUP BY size.k),
counts AS (SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, done.v.cost::BIGINT AS cost,
  done.v.audit AS audit, sha256(substr(done.v.said, 2)) AS repaired_sha256
FROM size JOIN done ON done.k = size.k LEFT JOIN counts ON counts.k = size.k"""
