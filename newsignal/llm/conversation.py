"""Repair of the structure of conversations at the least cost, by a cost DP and prefix-doubling path ranking.

Rows of a conversation are taken by turn (nulls first; rows of one turn by role, then by a digest of role and text).
Each row has at most one fault: blank, duplicate (role and text seen earlier) or truncated. Edits turn the row of role
initials into ``(s?(ua)+)?``: keep (0), rerole to user or assistant (1), delete (2, the only way for blank and duplicate
rows), insert an empty user or assistant (5); a truncated row that stays adds 5.

*Cost DP.* A node is a gap before a row (inserted there already or not) with the state reached: start, after system,
after user, after assistant. Costs to the end are computed backwards, for all conversations of a batch at once. Two
inserts in one gap are never part of a cheapest repair: what they reach, deletion or nothing reaches more cheaply.

*Path ranking.* Arcs on cheapest paths form the optimal graph. The letters of the arcs of a node differ, so a least
letter fixes a pointer. Nodes are ranked by the audits of the next 1, 2, 4, ... edits: the rank of twice the length is
the rank of the pair (own rank, rank of the node that the pointer of that length reaches), and pointers double along.
The doubled pointers then lay out the least path from the start, all steps of a power of two at a time.

*Size.* Rows are dealt by range of (conversation, turn, ...), so even one conversation that holds a third of all rows
lies in many tasks. A task finishes the conversations that lie wholly within it. Its first and last may go on in its
neighbours: their rows are handed on, and each task's share of such a conversation is a segment. A segment is a
4 x 4 matrix of least costs from state to state; a scan over the (at most as many as tasks) matrices of a conversation
gives the costs behind each segment, then the state in which each is entered, and each segment is laid out by itself.

Defined results: nulls of role and text are one space; a null conversation id is a conversation of its own; null turns
come first and count for no gap. Repeated rows are duplicates. A conversation whose rows are all ``dropped`` has zeros
and no edits. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsignal.llm.shared import changes, joined_batches, materialise, whole_groups

_NEVER = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"
_TURN = np.array([2, 2, 3, 2])  # state after an inserted or reroled row, by state
# state after a kept row, by state and initial (other, s, u, a); -1: not legal
_KEEP = np.array([[-1, 1, 2, -1], [-1, -1, 2, -1], [-1, -1, -1, 3], [-1, -1, 2, -1]])
_COSTS = {"D": 2, "I": 5, "K": 0, "R": 1}
_LETTERS = np.array(["", *sorted(_COSTS)])
_END = np.array([0, _NEVER, _NEVER, 0])
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` after damage that the crc32 of ``conv_id:turn`` chooses: one row in twenty
    each is dropped, emptied, freed of its ``.!?``, repeated, or given the role user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    chosen = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                         (F.crc32(key) % 20).alias("fate"))
    fate = F.col("fate")
    return chosen.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate.isin(0, 1), "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fate == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("_")).drop("_")


class Costs:
    """Least costs to the end for segments of rows, and the optimal graph.

    ``starts``: first row of each segment, and the number of rows. ``initial``, ``banned``, ``cut`` by row; ``leave``:
    costs behind each segment by state; ``last``: whether the segment ends its conversation.
    """

    def __init__(self, starts: np.ndarray, initial, banned, cut, leave: np.ndarray, last: np.ndarray) -> None:
        length = np.diff(starts)
        n_segments, n_rows = len(length), int(starts[-1])
        self.starts, self.length = starts, length
        self.base = starts[:-1] + np.arange(n_segments)  # gap before the first row; a segment has a gap more than rows
        gap_of_row = np.arange(n_rows) + np.repeat(np.arange(n_segments), length)
        extra = 5 * cut.astype(np.int64)
        # costs[gap, inserted, state]
        costs = np.full((n_rows + n_segments, 2, 4), _NEVER, np.int64)
        end = self.base + length
        costs[end] = leave[:, None, :]
        costs[end[last], 0] = np.minimum(leave[last], 5 + leave[last][:, _TURN])
        keep = np.where(banned[:, None], -1, _KEEP[:, initial].T) if n_rows else np.zeros((0, 4), int)
        order = np.argsort(-length, kind="stable")
        for step in range(1, int(length.max(initial=0)) + 1):
            active = order[: np.searchsorted(-length[order], -step, side="right")]
            row = starts[:-1][active] + length[active] - step
            gap = self.base[active] + length[active] - step
            after = costs[gap + 1, 0]
            by_keep = np.where(keep[row] >= 0, extra[row][:, None] + np.take_along_axis(after, np.maximum(keep[row], 0), 1), _NEVER)
            by_role = np.where(banned[row][:, None], _NEVER, 1 + extra[row][:, None] + after[:, _TURN])
            costs[gap, 1] = np.minimum(np.minimum(2 + after, np.minimum(by_keep, by_role)), _NEVER)
            costs[gap, 0] = np.minimum(costs[gap, 1], 5 + costs[gap, 1][:, _TURN])
        self.costs = costs
        # the least optimal letter of each node (0: none), and the node that it leads to
        self.letter = np.zeros(costs.shape, np.int8)
        self.to = np.arange(costs.size).reshape(costs.shape)
        state = np.arange(4)
        if n_rows:
            after = costs[gap_of_row + 1, 0]
            for flag in (0, 1):
                here = costs[gap_of_row, flag]
                ahead = ((gap_of_row + 1) * 8)[:, None]
                offers = {1: (2 + after, ahead + state),
                          3: (np.where(keep >= 0, extra[:, None] + np.take_along_axis(after, np.maximum(keep, 0), 1), _NEVER), ahead + np.maximum(keep, 0)),
                          4: (np.where(banned[:, None], _NEVER, 1 + extra[:, None] + after[:, _TURN]), ahead + _TURN)}
                if flag == 0:
                    offers[2] = (5 + costs[gap_of_row, 1][:, _TURN], (gap_of_row * 8 + 4)[:, None] + _TURN)
                self._choose(gap_of_row, flag, here, offers)
        close = end[last]
        if len(close):
            self._choose(close, 0, np.where(leave[last] == costs[close, 0], -1, costs[close, 0]),
                         {2: (5 + leave[last][:, _TURN], (close * 8 + 4)[:, None] + _TURN)})

    def _choose(self, gap, flag, here, offers) -> None:
        letter, to = self.letter[gap, flag], self.to[gap, flag]
        for code in sorted(offers, reverse=True):  # the least one is written last
            value, target = offers[code]
            hit = (value == here) & (here < _NEVER)
            letter = np.where(hit, np.int8(code), letter)
            to = np.where(hit, target, to)
        self.letter[gap, flag], self.to[gap, flag] = letter, to

    def entry(self) -> np.ndarray:
        """Least cost of each segment, by the state in which it is entered."""
        return self.costs[self.base, 0] if len(self.base) else np.zeros((0, 4), np.int64)

    def paths(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least cheapest paths from ``state`` of each segment: segment, letter, row and state reached of each step, in
        order; and the state in which each segment is left."""
        rank, jump, jumps = self.letter.ravel().astype(np.int64), self.to.ravel(), []
        longest = 2 * int(self.length.max(initial=0)) + 2
        classes = np.ceil(np.log2(2 * self.length + 2)).astype(int)
        for _ in range(max(1, int(np.ceil(np.log2(longest))))):
            jumps.append(jump)
            pair = rank * (int(rank.max(initial=0)) + 1) + rank[jump]
            rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
            jump = jump[jump]
        segments, nodes = [np.zeros(0, int)], [np.zeros(0, int)]
        left = np.zeros(len(self.base), int)
        letter = self.letter.ravel()
        for size in np.unique(classes).tolist():
            own = np.flatnonzero(classes == size)
            path = (self.base[own] * 8 + state[own])[:, None]
            for k in range(size - 1, -1, -1):
                path = np.stack([path, jumps[k][path]], axis=2).reshape(len(own), -1)
            used = letter[path] > 0
            segments.append(own[np.nonzero(used)[0]])
            nodes.append(path[used])
            left[own] = jumps[0][path[:, -1]] & 3
        segment, node = np.concatenate(segments), np.concatenate(nodes)
        order = np.argsort(segment, kind="stable")
        segment, node = segment[order], node[order]
        return segment, letter[node], (node >> 3) - segment, self.to.ravel()[node] & 3, left


def _laid_out(path, roles: pa.Array, texts: pa.Array, n_segments: int) -> pa.Array:
    """The edits of each segment: an array of (edit, role, text); role and text are those after the edit."""
    segment, letter, row, state, _ = path
    none = len(roles)
    made = (letter == 2) | (letter == 4)
    role_at = np.where(made, none + (state == 3), row)
    text_at = np.where(letter == 2, none, row)
    edits = pa.StructArray.from_arrays([
        pa.array(_LETTERS[letter], pa.string()),
        pa.concat_arrays([roles, pa.array(["user", "assistant"], roles.type)]).take(pa.array(role_at)),
        pa.concat_arrays([texts, pa.array([""], texts.type)]).take(pa.array(text_at))], names=["edit", "role", "text"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(segment, minlength=n_segments))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), edits)


def _illegal(initial: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Whether the pair of each row and the next one, in the same segment, has initials other than su, ua, au."""
    a, b = initial[:-1], initial[1:]
    legal = ((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))
    return inside & ~legal


def _finished(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Whole conversations: their counts and edits. Rows are in order; ``kind`` is -1 for dropped ones."""
    fresh = changes(batch.column("conv_id"))
    number = np.cumsum(fresh) - 1
    n = int(number[-1]) + 1
    ids = batch.column("conv_id").filter(pa.array(fresh))
    alive = batch.column("kind").to_numpy() >= 0
    rows = batch.filter(pa.array(alive))
    number = number[alive]
    kind = rows.column("kind").to_numpy()
    initial, blank, cut = kind & 3, kind & 4 > 0, kind & 8 > 0
    repeated = pd.DataFrame({"number": number, "digest": rows.column("digest").to_numpy(zero_copy_only=False)}).duplicated().to_numpy()
    repeated &= ~blank
    cut &= ~blank & ~repeated
    starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=n))])
    costs = Costs(starts, initial, blank | repeated, cut, np.tile(_END, (n, 1)), np.ones(n, bool))
    pairs = number[:-1] == number[1:]
    turn = rows.column("turn")
    known = turn.is_valid().to_numpy(zero_copy_only=False)
    turns, of = turn.drop_null().to_numpy(), number[known]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (turns[1:] != turns[:-1])
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    ends = np.append(first[1:], True) if len(of) else first
    gaps = np.zeros(n, np.int64)
    gaps[of[first]] = turns[ends] - turns[first] + 1 - np.bincount(of[new], minlength=n)[of[first]]
    counts = {"gaps": gaps, "blank": np.bincount(number[blank], minlength=n), "duplicate": np.bincount(number[repeated], minlength=n),
              "truncated": np.bincount(number[cut], minlength=n),
              "illegal": np.bincount(number[:-1][_illegal(initial, pairs)], minlength=n) if len(number) else gaps,
              "cost": costs.entry()[:, 0]}
    edits = _laid_out(costs.paths(np.zeros(n, int)), rows.column("role"), rows.column("text"), n)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS), edits], names=["conv_id", *_COUNTS, "edits"])


def repair(rows: DataFrame) -> DataFrame:
    """Segments of repaired conversations: conv_id, segment, n_segments, gaps, blank, duplicate, truncated, illegal, cost
    and ``edits``, an array of (edit, role, text) in order; deleted rows are in it with edit D.

    ``rows``: conv_id, turn, role, text and, if present, dropped (rows that are not there, but whose conversation is
    reported). A conversation is one segment unless it lies in several tasks; the counts are those of the whole.
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    ended = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    kind = (F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
            + F.when(ended == "", 4).otherwise(0) + F.when(F.substring(ended, -1, 1).isin(".", "!", "?"), 0).otherwise(8))
    taken = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), dropped.alias("dropped"))
    taken = taken.select("conv_id", "turn", "role", "text", F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")).alias("digest"),
                         F.when(F.col("dropped"), -1).otherwise(kind).alias("kind"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "digest", "tie"]
    dealt = taken.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    id_field = rows.select("conv_id").schema.fields[0]
    edit = "edit string, role string, text string"
    done = StructType([id_field] + StructType.fromDDL(
        ", ".join(f"{c} long" for c in _COUNTS) + f", edits array<struct<{edit.replace(' ', ':')}>>".replace(",:", ",")).fields)
    open_type = StructType([id_field] + StructType.fromDDL("turn long, role string, text string, digest string, kind int").fields)
    both = StructType(done.fields + StructType.fromDDL("part int, at long").fields + open_type.fields[1:])

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        seen = 0

        def handed_on(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal seen
            size = batch.num_rows
            at = np.arange(seen, seen + size)
            seen += size
            empty = [pa.nulls(size, t) for t in [*[pa.int64()] * len(_COUNTS), _edits_type()]]
            return pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *empty, pa.array(np.full(size, part, np.int32)), pa.array(at, pa.int64()),
                 *(batch.column(f.name) for f in open_type.fields[1:])], names=both.names)

        def complete(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = _finished(batch)
            size = made.num_rows
            blank = [pa.nulls(size, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())]
            return pa.RecordBatch.from_arrays([*made.columns, *blank], names=both.names)

        # the first conversation streams through; after it one conversation at most is kept besides a batch
        first, before = True, None
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                if before is not None:
                    joint = pa.concat_arrays([before, batch.column("conv_id").slice(0, 1)])
                    if changes(joint)[1]:
                        first = False
                if first:
                    fresh = changes(batch.column("conv_id"))
                    at = int(np.argmax(fresh[1:])) + 1 if fresh[1:].any() else batch.num_rows
                    yield handed_on(batch.slice(0, at))
                    before = batch.column("conv_id").slice(at - 1, 1)
                    if at == batch.num_rows:
                        continue
                    first, batch = False, batch.slice(at)
            if rest and changes(pa.concat_arrays([rest[-1].column("conv_id").slice(rest[-1].num_rows - 1), batch.column("conv_id").slice(0, 1)]))[1]:
                yield complete(joined_batches(rest))
                rest = []
            last = batch.num_rows - 1 - int(np.argmax(changes(batch.column("conv_id"))[::-1]))
            if last:
                yield complete(joined_batches([*rest, batch.slice(0, last)]))
                rest = []
            rest.append(batch.slice(last))
        for batch in rest:  # the last conversation may go on in the next task
            yield handed_on(batch)

    found = materialise(dealt.mapInArrow(run, both))
    whole = found.filter("part is null").select("conv_id", F.lit(0).alias("segment"), F.lit(1).alias("n_segments"), *_COUNTS, "edits")
    return whole.unionByName(_stitched(found.filter("part is not null").select("conv_id", "part", "at", *open_type.names[1:])))


def _edits_type() -> pa.DataType:
    return pa.list_(pa.struct([pa.field(name, pa.string()) for name in ("edit", "role", "text")]))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; columns of ``left``, then the others of ``right``."""
    other = right.select(*[F.col(k).alias(f"other_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(other, F.expr(" and ".join(f"{k} <=> other_{k}" for k in keys)), how).drop(*[f"other_{k}" for k in keys])


def _stitched(rows: DataFrame) -> DataFrame:
    """Conversations that may lie in several tasks: conv_id, part, at, turn, role, text, digest, kind by row."""
    id_field = rows.schema["conv_id"]
    alive = rows.filter("kind >= 0")
    firsts = alive.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "at")).alias("first"))
    blank = F.col("kind").bitwiseAND(F.lit(4)) > 0
    repeated = ~blank & (F.struct("part", "at") != F.col("first"))
    coded = materialise(_same(alive, firsts, ["conv_id", "digest"]).select(
        "conv_id", "part", "at", "turn", "role", "text", F.col("kind").bitwiseAND(F.lit(3)).alias("initial"), blank.alias("blank"),
        repeated.alias("repeated"), (~blank & ~repeated & (F.col("kind").bitwiseAND(F.lit(8)) > 0)).alias("cut")))
    count = [F.count_if(F.col(c)).alias(name) for c, name in (("blank", "blank"), ("repeated", "duplicate"), ("cut", "truncated"))]
    turns = coded.groupBy("conv_id", "turn").agg(*count).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    def typed(ddl: str) -> StructType:
        return StructType([id_field] + StructType.fromDDL(ddl).fields)

    def by_segment(frame: DataFrame, columns: list[str], schema: StructType, work) -> DataFrame:
        """``work`` of runs of whole segments (starts, batch) in order of (conv_id, part, at)."""
        placed = frame.select("conv_id", "part", "at", *columns).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "at")

        def run(batches):
            def whole(batch):
                fresh = changes(batch.column("conv_id")) | changes(batch.column("part"))
                starts = np.append(np.flatnonzero(fresh), batch.num_rows)
                lead = [batch.column(name).take(pa.array(starts[:-1])) for name in ("conv_id", "part")]
                return pa.RecordBatch.from_arrays([*lead, *work(starts, batch)], names=schema.names)

            yield from whole_groups(batches, ["conv_id", "part"], whole)

        return placed.mapInArrow(run, schema)

    def codes(batch):
        flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("blank", "repeated", "cut")]
        return batch.column("initial").to_numpy(), flags[0] | flags[1], flags[2]

    def matrices(starts, batch):
        initial, banned, cut = codes(batch)
        n = len(starts) - 1
        costs = [Costs(starts, initial, banned, cut, np.tile(np.where(np.arange(4) == to, 0, _NEVER), (n, 1)), np.zeros(n, bool)).entry()
                 for to in range(4)]
        inside = np.ones(max(len(initial) - 1, 0), bool)
        inside[starts[1:-1] - 1] = False
        wrong = np.concatenate([[0], np.cumsum(_illegal(initial, inside))])
        illegal = wrong[starts[1:] - 1] - wrong[starts[:-1]]
        table = np.stack(costs, axis=2).reshape(n, 16)
        return [pa.array(list(table), pa.list_(pa.int64())), *(pa.array(x.astype(np.int64)) for x in (illegal, initial[starts[:-1]], initial[starts[1:] - 1]))]

    flags = ["initial", "blank", "repeated", "cut"]
    first = by_segment(coded, flags, typed("part int, costs array<long>, wrong long, head long, tail long"), matrices)

    def behind(rows: pd.DataFrame) -> Iterator[tuple]:
        """Costs behind each segment of a conversation, from the last to the first."""
        leave, out = np.array([0, _NEVER, 5, 0]), []
        for segment in reversed(rows):
            out.append((segment["part"], np.minimum(leave, _NEVER).tolist()))
            leave = np.minimum((np.array(segment["costs"]).reshape(4, 4) + leave[None, :]).min(axis=1), _NEVER)
        return out, int(leave[0])

    def scanned(batches):
        for batch in batches:
            out: dict[str, list] = {name: [] for name in scan_type.names}
            for conv, segments in zip(batch.column("conv_id"), batch.column("segments").to_pylist()):
                back, cost = behind(segments)
                heads, tails = np.array([s["head"] for s in segments[1:]], int), np.array([s["tail"] for s in segments[:-1]], int)
                pair = np.stack([tails, heads], axis=1).ravel()
                joints = int(_illegal(pair, np.arange(max(len(pair) - 1, 0)) % 2 == 0).sum()) if len(pair) else 0
                for place, (part, leave) in enumerate(reversed(back)):
                    for name, value in zip(scan_type.names, (conv.as_py(), part, place, len(segments), leave, cost, sum(s["wrong"] for s in segments) + joints)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], t) for f, t in zip(scan_type.fields, arrow_types(scan_type))], names=scan_type.names)

    def arrow_types(schema):
        from pyspark.sql.pandas.types import to_arrow_type
        return [to_arrow_type(f.dataType) for f in schema.fields]

    scan_type = typed("part int, segment int, n_segments int, leave array<long>, cost long, illegal long")
    # a conversation has at most as many segments as there were tasks
    listed = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs", "wrong", "head", "tail"))).alias("segments"))
    scan = materialise(listed.mapInArrow(scanned, scan_type))

    def solve(starts, batch):
        head = batch.take(pa.array(starts[:-1]))
        last = (pc.equal(pc.add(head.column("segment"), 1), head.column("n_segments"))).to_numpy(zero_copy_only=False)
        leave = np.array(head.column("leave").to_pylist(), np.int64).reshape(-1, 4)
        leave = np.where(last[:, None], _END, leave)
        return Costs(starts, *codes(batch), leave, last)

    def left_in(starts, batch):
        costs = solve(starts, batch)
        n = len(starts) - 1
        states = np.stack([costs.paths(np.full(n, s))[4] for s in range(4)], axis=1)
        return [batch.column("segment").take(pa.array(starts[:-1])), pa.array(list(states.astype(np.int32)), pa.list_(pa.int32()))]

    wide = _same(coded, scan.select("conv_id", "part", "segment", "n_segments", "leave"), ["conv_id", "part"])
    steps = ["segment", "n_segments", "leave", *flags]
    moves = by_segment(wide, steps, typed("part int, segment int, states array<int>"), left_in)
    path = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks
    entered = F.aggregate(F.collect_list("states").over(path), F.lit(0), lambda state, move: F.get(move, state))
    entries = materialise(moves.select("conv_id", "part", entered.alias("entry")))

    def edits(starts, batch):
        costs = solve(starts, batch)
        entry = batch.column("entry").take(pa.array(starts[:-1])).to_numpy()
        return [batch.column(c).take(pa.array(starts[:-1])) for c in ("segment", "n_segments")] + [
            _laid_out(costs.paths(entry), batch.column("role"), batch.column("text"), len(starts) - 1)]

    made = by_segment(_same(wide, entries, ["conv_id", "part"]), [*steps, "entry", "role", "text"],
                      typed("part int, segment int, n_segments int, edits array<struct<edit:string,role:string,text:string>>"), edits)
    costs = scan.select("conv_id", "cost", "illegal").filter("segment = 0")
    counted = _same(_same(made, costs, ["conv_id"]), turns, ["conv_id"])
    kept = counted.select("conv_id", "segment", "n_segments", *_COUNTS, "edits")
    gone = rows.groupBy("conv_id").agg(F.max("kind").alias("kind")).filter("kind < 0")
    nothing = gone.select("conv_id", F.lit(0).alias("segment"), F.lit(1).alias("n_segments"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS],
                          F.array().cast("array<struct<edit:string,role:string,text:string>>").alias("edits"))
    return kept.unionByName(nothing)


def repaired_rows(segments: DataFrame) -> DataFrame:
    """conv_id, segment, place, edit, role, text of the rows of the repaired conversations, in order of (segment, place)."""
    rows = segments.select("conv_id", "segment", F.posexplode("edits").alias("place", "row")).filter("row.edit <> 'D'")
    return rows.select("conv_id", "segment", "place", "row.edit", "row.role", "row.text")


def report(segments: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, the audit of its edits and the SHA-256 of the repaired rows.

    Hashes chain, so a conversation of several segments streams through one task, a segment at a time; its audit is
    one value.
    """
    lines = F.array_join(F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")
    single = segments.filter("n_segments = 1").select(
        "conv_id", *_COUNTS, F.array_join(F.col("edits.edit"), "").alias("audit"), F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    several = segments.filter("n_segments > 1").select(
        "conv_id", "segment", *_COUNTS, F.array_join(F.col("edits.edit"), "").alias("audit"), lines.alias("lines"),
        F.exists("edits", lambda e: e["edit"] != "D").alias("some"))
    schema = single.schema

    def run(batches):
        current, digest, audit, any_line = None, None, [], False
        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] == 0:
                    if current is not None:
                        yield closed(current, digest, audit)
                    current, digest, audit, any_line = row, hashlib.sha256(), [], False
                audit.append(row["audit"])
                if row["some"]:
                    digest.update((("\n" if any_line else "") + row["lines"]).encode("utf-8", "surrogatepass"))
                    any_line = True
        if current is not None:
            yield closed(current, digest, audit)

    def closed(row, digest, audit) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema
        values = {**{c: row[c] for c in ("conv_id", *_COUNTS)}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        return pa.RecordBatch.from_pylist([values], to_arrow_schema(schema))

    joined = several.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(run, schema)
    return single.unionByName(joined)


ORACLE = r"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
crc as (
  select *, xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(k, ''),
           lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, 3988292384 * (acc & 1)) end), 4294967295) % 20 as d from src),
hit as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
         case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, r
  from crc, lateral unnest(case d when 0 then []::int[] when 3 then [1, 2] else [1] end) t(r)),
seq as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, r) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, r) as copy,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') as ended, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '?' end as c
  from hit),
fault as (
  select *, case when ended = '' then 'blank' when copy > 1 then 'duplicate' when right(ended, 1) not in ('.', '!', '?') then 'truncated' else '' end as f,
         lag(c) over (partition by conv_id order by i) || c as pair from seq),
numbers as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 'blank') as blank,
         count(*) filter (f = 'duplicate') as duplicate, count(*) filter (f = 'truncated') as truncated,
         count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from fault group by 1),
rules(s, e, t) as (values ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
turns(s, t, made) as (values ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
dp(conv_id, i, s, best) as (
  select conv_id, 0, '', {'cost': 0, 'audit': '', 'rows': []::varchar[]} from numbers
  union all
  select conv_id, i, s, min(best) from (
    select g.conv_id, g.i + 1 as i, o.s, {'cost': g.best.cost + o.cost, 'audit': g.best.audit || o.letter, 'rows': g.best.rows || o.made} as best
    from (select conv_id, i, s, best from dp
          union all
          select d.conv_id, d.i, t.t, {'cost': d.best.cost + 5, 'audit': d.best.audit || 'I', 'rows': d.best.rows || [t.made || ':']}
          from dp d join turns t on t.s = d.s) g
    join fault r on r.conv_id = g.conv_id and r.i = g.i + 1
    join lateral (
      select g.s as s, 2 as cost, 'D' as letter, []::varchar[] as made
      union all select u.t, case r.f when 'truncated' then 5 else 0 end, 'K', [r.role || ':' || r.text]
        from rules u where u.s = g.s and u.e = r.c and r.f in ('', 'truncated')
      union all select t.t, case r.f when 'truncated' then 6 else 1 end, 'R', [t.made || ':' || r.text]
        from turns t where t.s = g.s and r.f in ('', 'truncated')) o on true) step
  group by 1, 2, 3),
done as (
  select conv_id, min(best) as best from (
    select d.conv_id, d.best from dp d join numbers n on n.conv_id = d.conv_id and n.n = d.i where d.s in ('', 'a')
    union all
    select d.conv_id, {'cost': d.best.cost + 5, 'audit': d.best.audit || 'I', 'rows': d.best.rows || ['assistant:']}
    from dp d join numbers n on n.conv_id = d.conv_id and n.n = d.i where d.s = 'u') x group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
       sha256(coalesce(array_to_string(best.rows, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join numbers n using (conv_id) left join done using (conv_id)
"""
