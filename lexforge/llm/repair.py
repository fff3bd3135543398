"""Conversation structure repair: the cheapest edits that give role initials (s?(ua)+)?, ties by the least edit letters.

Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (required for blank and duplicate rows), Insert of an empty user or
assistant turn 5; a truncated row that isn't deleted adds 5. A node of the graph is (rows consumed, grammar state). Forward
and backward minimum costs mark every arc that lies on some cheapest path (a tight arc), and a walk over the set of reached nodes takes
the least letter that a tight arc out of it bears.

Conversations of any length are cut into segments of SEGMENT rows. A segment is a (min, +) matrix of the four states; those
are combined along each conversation to the costs at the segments' ends, and then every segment is walked by itself. Segments are
worked on side by side as numpy lanes. Only the SHA-256 of a conversation's repaired text is sequential: it is
hashed as a stream of sorted rows, in memory that doesn't grow with the conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import map_arrow, materialize

#: rows of a segment, as a power of two
SEGMENT_BITS = 10
#: costs of the edits, and of a truncated row that stays
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
USER, ASSISTANT = "user", "assistant"

# states of the grammar by the last initial: nothing yet, s, u, a
N_STATES, START, AFTER_S, AFTER_U, AFTER_A = 4, 0, 1, 2, 3
FINAL = (START, AFTER_A)
#: state after a user or an assistant turn, where the grammar allows one
_NEXT = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])
#: state after keeping a turn by its initial (s, u, a, any other): -1 where the grammar allows none
_KEEP = np.array([[AFTER_S, -1, -1, -1], [AFTER_U, AFTER_U, -1, AFTER_U], [-1, -1, AFTER_A, -1], [-1, -1, -1, -1]])
FAR = 1 << 50
_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
#: cells (steps x lanes) worked on at a time
_CELLS = 1 << 17


# -- rows in order, with their faults ------------------------------------------------------------------


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _marked(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows in their order: (id, pos, role, text, copies, init, fault) and turn; equal rows of one turn are one row with copies."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    r = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    r = r.groupBy("id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    r = materialize(r.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))))
    # role and text of several turns: the first turn (null before all) has the original
    seen = r.groupBy("id", "same").agg(F.min("turn").alias("t0"), F.max(F.col("turn").isNull()).alias("t_null"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("id").alias("i"), F.col("same").alias("s"), "t0", "t_null")
    r = r.join(seen, F.col("id").eqNullSafe(F.col("i")) & (F.col("same") == F.col("s")), "left")
    later = F.col("s").isNotNull() & F.col("turn").isNotNull() & (F.col("t_null") | (F.col("turn") > F.col("t0")))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), _BLANK).when(later, _DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), _TRUNCATED).otherwise(_FINE)
    r = r.select("id", "turn", "role", "text", "same", "copies", _initial(F.col("role")).alias("init"), fault.alias("fault"))
    # one order over all conversations, cut anywhere: a conversation with a third of the rows is many partitions
    order = ["id", "turn", "role", "same"]
    placed = r.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(placed.select("id", F.monotonically_increasing_id().alias("pos"), "turn", "role", "text", "copies", "init", "fault"))


def _segments(placed: DataFrame, bits: int) -> DataFrame:
    entry = F.struct("pos", "init", "fault", "copies")
    segs = placed.groupBy("id", F.shiftright("pos", bits).alias("seg")).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    of = lambda name: F.transform("rows", lambda x: x[name])
    return materialize(segs.select("id", "seg", of("pos").alias("pos"), of("init").alias("init"), of("fault").alias("fault"), of("copies").alias("copies")))


# -- costs and tight arcs, many segments at a time ------------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _lanes(batch: pa.RecordBatch):
    """Yield (row numbers, lengths, init, fault, copies) of segments of like length, padded to [steps, lanes]."""
    init, size = _lists(batch.column("init"))
    fault, copies = _lists(batch.column("fault"))[0], _lists(batch.column("copies"))[0]
    start = np.concatenate(([0], np.cumsum(size)))[:-1]
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        steps = max(1, int(size[order[at]]))
        rows = order[at : at + max(1, _CELLS // steps)]
        at += len(rows)
        where = np.minimum(start[rows] + np.arange(steps)[:, None], len(init) - 1)
        yield rows, size[rows], init[where], fault[where], copies[where]


def _inserted(f: np.ndarray) -> np.ndarray:
    """Costs of the states of [..., 4] once any turns have been inserted; two are as many as ever help."""
    for _ in range(2):
        f = f.copy()
        for q in range(N_STATES):
            np.minimum(f[..., _NEXT[q]], f[..., q] + INSERT, out=f[..., _NEXT[q]])
    return f


def _inserted_back(b: np.ndarray) -> np.ndarray:
    for _ in range(2):
        b = np.minimum(b, b[..., _NEXT] + INSERT)
    return b


def _arcs(init: np.ndarray, fault: np.ndarray, copies: np.ndarray):
    """Of one row of each lane: cost of D, of K by state, of R, and the state that K leads to by state (-1: none).

    The copies after the first of a row are duplicates (or blank) and go, for DELETE each.
    """
    more = DELETE * (copies - 1)
    stays = np.where(fault == _TRUNCATED, TRUNCATED, 0) + more
    free = (fault == _FINE) | (fault == _TRUNCATED)
    to = _KEEP[init]
    return DELETE + more, np.where((to >= 0) & free[:, None], stays[:, None], FAR), np.where(free, REROLE + stays, FAR), to


def _step(f: np.ndarray, arcs) -> np.ndarray:
    """Costs [lanes, ..., 4] after one more row, from those before it."""
    delete, keep, rerole, to = arcs
    wide = lambda x: x.reshape(x.shape + (1,) * (f.ndim - 1 - x.ndim))
    out = f + wide(delete)[..., None]
    for q in range(N_STATES):
        np.minimum(out[..., _NEXT[q]], f[..., q] + wide(rerole), out=out[..., _NEXT[q]])
        for t in range(N_STATES):
            np.minimum(out[..., t], f[..., q] + wide(np.where(to[:, q] == t, keep[:, q], FAR)), out=out[..., t])
    return np.minimum(out, FAR)


def _step_back(b: np.ndarray, arcs) -> np.ndarray:
    delete, keep, rerole, to = arcs
    kept = np.take_along_axis(b, np.maximum(to, 0), 1) + keep
    return np.minimum(np.minimum(b + delete[:, None], b[:, _NEXT] + rerole[:, None]), np.minimum(kept, FAR))


_MATRIX = "id {id}, seg long, matrix array<long>, first long, last long, illegal long"


def _matrices(batches):
    """Each segment as a (min, +) matrix, with its first and last initial and its illegal pairs."""
    for batch in batches:
        n = batch.num_rows
        matrix, ends = np.zeros((n, N_STATES, N_STATES), np.int64), np.zeros((n, 2), np.int64)
        bad = np.zeros(n, np.int64)
        for rows, size, init, fault, copies in _lanes(batch):
            f = np.broadcast_to(np.where(np.eye(N_STATES, dtype=bool), 0, FAR), (len(rows), N_STATES, N_STATES)).copy()
            illegal = np.zeros(len(rows), np.int64)
            for t in range(len(init)):
                live = t < size
                k = int(live.sum())  # lanes go by length, the longest first
                f[:k] = _step(_inserted(f[:k]), _arcs(init[t, :k], fault[t, :k], copies[t, :k]))
                # su, ua and au are the legal pairs of initials; two copies of a row never are one
                if t:
                    illegal[:k] += ~((init[t - 1, :k] <= 1) & (init[t, :k] == init[t - 1, :k] + 1) | (init[t - 1, :k] == 2) & (init[t, :k] == 1))
                illegal[:k] += copies[t, :k] - 1
            matrix[rows], bad[rows] = f, illegal
            ends[rows, 0], ends[rows, 1] = init[0], init[size - 1, np.arange(len(rows))]
        flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * N_STATES**2, pa.array(matrix.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("seg"), flat, *map(pa.array, (ends[:, 0], ends[:, 1], bad))], ["id", "seg", "matrix", "first", "last", "illegal"])


_COSTS = "id {id}, seg long, ahead array<long>, behind array<long>, cost long, is_last boolean, n_segs long, illegal long"


def _combined(batches):
    """From the matrices of a conversation's segments, in order: costs before each segment (ahead), after it (behind), and of the whole."""
    for batch in batches:
        out = {k: [] for k in ("id", "seg", "ahead", "behind", "cost", "is_last", "n_segs", "illegal")}
        for row in batch.to_pylist():
            segs = row["segs"]
            m = np.array([s["matrix"] for s in segs], np.int64).reshape(-1, N_STATES, N_STATES)
            ahead = np.full((len(segs) + 1, N_STATES), FAR, np.int64)
            ahead[0, START] = 0
            for k in range(len(segs)):
                ahead[k + 1] = np.minimum((ahead[k][:, None] + m[k]).min(0), FAR)
            behind = np.full((len(segs) + 1, N_STATES), FAR, np.int64)
            behind[-1, list(FINAL)] = 0
            behind[-1] = _inserted_back(behind[-1])
            for k in range(len(segs) - 1, -1, -1):
                behind[k] = np.minimum((m[k] + behind[k + 1][None, :]).min(1), FAR)
            pairs = sum((a["last"], b["first"]) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(segs, segs[1:]))
            for k, s in enumerate(segs):
                values = (row["id"], s["seg"], ahead[k].tolist(), behind[k + 1].tolist(), int(behind[0, START]), k == len(segs) - 1, len(segs), sum(x["illegal"] for x in segs) + pairs)
                for name, value in zip(out, values):
                    out[name].append(value)
        types = [batch.schema.field("id").type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def _walk(rows, size, init, fault, copies, ahead, behind, cost, last, entry):
    """Letters of the lanes from the entry states: (inserts before each row, letter of each row, state before that row's letter, trailing inserts, exit state).

    The frontier starts as one state and each letter leads every state to one, so that it never has two members in this grammar;
    it is kept as a set all the same.
    """
    steps, lanes = init.shape
    arcs = [_arcs(init[t], fault[t], copies[t]) for t in range(steps)]
    f = np.full((steps + 1, lanes, N_STATES), FAR, np.int64)
    b = np.full((steps + 1, lanes, N_STATES), FAR, np.int64)
    f[0] = _inserted(ahead)
    for t in range(steps):
        k = int((t < size).sum())
        f[t + 1, :k] = _inserted(_step(f[t, :k], tuple(x[:k] for x in arcs[t])))
    b[size, np.arange(lanes)] = behind
    for t in range(steps - 1, -1, -1):
        k = int((t < size).sum())
        b[t, :k] = _inserted_back(_step_back(b[t + 1, :k], tuple(x[:k] for x in arcs[t])))
    total = cost[:, None]
    reached = np.zeros((lanes, N_STATES), bool)
    reached[np.arange(lanes), entry] = True
    n_ins, letter, state = np.zeros((steps, lanes), np.int64), np.zeros((steps, lanes), np.int64), np.zeros((steps, lanes), np.int64)

    def moved(tight, to):
        out = np.zeros_like(tight)
        for q in range(N_STATES):
            np.logical_or.at(out, (np.arange(len(tight)), np.maximum(to[:, q], 0)), tight[:, q])
        return out

    def insert(t, k, allowed):
        """One insert in the lanes allowed where it is tight; which lanes had one."""
        tight = reached[:k] & (f[t, :k] + INSERT + b[t, :k][:, _NEXT] == total[:k]) & allowed[:, None]
        took = tight.any(1)
        reached[:k][took] = moved(tight, np.broadcast_to(_NEXT, tight.shape))[took]
        return took

    for t in range(steps):
        k = int((t < size).sum())
        delete, keep, rerole, to = (x[:k] for x in arcs[t])
        here, there = f[t, :k], b[t + 1, :k]
        dropped = lambda: reached[:k] & (here + delete[:, None] + there == total[:k])  # noqa: E731,B023
        for _ in range(2):
            n_ins[t, :k] += insert(t, k, ~dropped().any(1))
        tights = (
            dropped(),
            reached[:k] & (here + keep + np.take_along_axis(there, np.maximum(to, 0), 1) == total[:k]),
            reached[:k] & (here + rerole[:, None] + there[:, _NEXT] == total[:k]),
        )
        targets = (np.broadcast_to(np.arange(N_STATES), (k, N_STATES)), to, np.broadcast_to(_NEXT, (k, N_STATES)))
        state[t, :k] = reached[:k].argmax(1)
        done, after = np.zeros(k, bool), np.zeros((k, N_STATES), bool)
        for number, (tight, target) in enumerate(zip(tights, targets)):  # D, then K, then R: I has had its turn
            here_now = tight.any(1) & ~done
            after[here_now] = moved(tight, target)[here_now]
            letter[t, :k][here_now] = number
            done |= here_now
        reached[:k] = after
    trail = np.zeros(lanes, np.int64)
    for _ in range(2):
        end = reached & last[:, None] & (f[size, np.arange(lanes)] + INSERT + b[size, np.arange(lanes)][:, _NEXT] == total)
        took = end.any(1)
        trail += took
        reached[took] = moved(end, np.broadcast_to(_NEXT, end.shape))[took]
    return n_ins, letter, state, trail, np.where(reached.any(1), reached.argmax(1), -1)


def _wide(column: pa.Array) -> np.ndarray:
    return _lists(column)[0].reshape(-1, N_STATES).astype(np.int64)


def _transfers(batches):
    """Exit state of each segment for each entry state."""
    for batch in batches:
        ahead, behind = _wide(batch.column("ahead")), _wide(batch.column("behind"))
        cost, last = batch.column("cost").to_numpy(), batch.column("is_last").to_numpy(zero_copy_only=False)
        out = np.zeros((batch.num_rows, N_STATES), np.int64)
        for rows, *lane in _lanes(batch):
            for q in range(N_STATES):
                out[rows, q] = _walk(rows, *lane, ahead[rows], behind[rows], cost[rows], last[rows], np.full(len(rows), q))[-1]
        flat = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * N_STATES, pa.array(out.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("seg"), flat], ["id", "seg", "leads"])


def _edits(batches):
    """The edits of every row: (pos, n_ins, letter 0 D 1 K 2 R, state, trail)."""
    for batch in batches:
        ahead, behind = _wide(batch.column("ahead")), _wide(batch.column("behind"))
        cost, last = batch.column("cost").to_numpy(), batch.column("is_last").to_numpy(zero_copy_only=False)
        entry = batch.column("entry").to_numpy()
        pos, sizes = _lists(batch.column("pos"))
        start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        out = [np.zeros(len(pos), np.int64) for _ in range(4)]
        for rows, size, *lane in _lanes(batch):
            n_ins, letter, state, trail, _ = _walk(rows, size, *lane, ahead[rows], behind[rows], cost[rows], last[rows], entry[rows])
            t, lane_no = np.nonzero(np.arange(len(n_ins))[:, None] < size)
            where = start[rows][lane_no] + t
            for to, got in zip(out, (n_ins, letter, state)):
                to[where] = got[t, lane_no]
            out[3][start[rows] + size - 1] = trail
        yield pa.RecordBatch.from_arrays([pa.array(pos), *map(pa.array, out)], ["pos", "n_ins", "letter", "state", "trail"])


# -- the operator ---------------------------------------------------------------------------------------


def repaired_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """(edits, facts) of the conversations in rows.

    edits has one row per distinct row, in the order of pos: (id_col, pos, turn, letters, turns array<struct<role, text>>); letters
    are its edits, inserts before it included, and turns the repaired turns that they give. facts has one row per
    conversation: (id_col, gaps, blank, duplicate, truncated, illegal, cost).

    Rows go by turn (nulls first), then role, then the text's digest. Null roles and texts are one space. A role's
    initial is its first character; one other than s, u and a (an empty role has none) can't be kept. Equal rows are
    duplicates from the second on; a null id is a conversation of its own. An empty table gives empty tables; other columns are ignored.
    """
    placed = _marked(rows, id_col, turn_col, role_col, text_col)
    kind = placed.schema["id"].dataType.simpleString()
    segs = _segments(placed, bits)
    matrices = map_arrow(segs.drop("pos"), _matrices, _MATRIX.format(id=kind))
    whole = matrices.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seg", "matrix", "first", "last", "illegal"))).alias("segs"))
    costs = materialize(map_arrow(whole, _combined, _COSTS.format(id=kind)))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.seg") == F.col(f"{b}.seg"))
    lanes = segs.alias("s").join(costs.alias("c"), same("s", "c")).select("s.*", "c.ahead", "c.behind", "c.cost", "c.is_last", "c.n_segs")
    cut = lanes.where("n_segs > 1").drop("pos")
    entries = None
    if not costs.where("n_segs > 1").isEmpty():
        leads = map_arrow(cut, _transfers, f"id {kind}, seg long, leads array<long>")
        runs = leads.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seg", "leads"))).alias("segs"))
        # entry states one after the other: each segment's exit for its entry is the next one's entry
        chain = F.aggregate("segs", F.array(F.lit(START).cast("long")), lambda a, x: F.concat(a, F.array(x.leads[F.element_at(a, -1).cast("int")])))
        entries = runs.select("id", F.explode(F.arrays_zip(F.transform("segs", lambda x: x.seg).alias("seg"), F.slice(chain, 1, F.size("segs")).alias("entry"))).alias("e")).select("id", "e.seg", "e.entry")
    lanes = lanes.withColumn("entry", F.lit(START).cast("long")) if entries is None else lanes.alias("l").join(entries.alias("e"), same("l", "e"), "left").select("l.*", F.coalesce("e.entry", F.lit(START)).cast("long").alias("entry"))
    edits = map_arrow(lanes.drop("n_segs"), _edits, "pos long, n_ins long, letter long, state long, trail long")

    turn = lambda role, text=F.lit(""): F.struct(role.alias("role"), text.alias("text"))
    asks = lambda state: F.when(state == AFTER_U, ASSISTANT).otherwise(USER)
    # an odd number of inserts before the row: the first of them answers the state before, which is not the one before its letter
    first = F.when(F.col("n_ins") % 2 == 0, asks(F.col("state"))).otherwise(F.when(F.col("state") == AFTER_U, USER).otherwise(ASSISTANT))
    other = F.when(first == USER, ASSISTANT).otherwise(USER)
    new = lambda n, a, b: F.when(n == 0, F.array().cast("array<struct<role:string,text:string>>")).when(n == 1, F.array(turn(a))).otherwise(F.array(turn(a), turn(b)))
    none = F.array().cast("array<struct<role:string,text:string>>")
    own = F.when(F.col("letter") == 1, F.array(turn(F.col("role"), F.col("text")))).when(F.col("letter") == 2, F.array(turn(asks(F.col("state")), F.col("text")))).otherwise(none)
    letters = F.concat(F.repeat(F.lit("I"), F.col("n_ins").cast("int")), F.substring(F.lit("DKR"), F.col("letter").cast("int") + 1, F.lit(1)), F.repeat(F.lit("D"), (F.col("copies") - 1).cast("int")), F.repeat(F.lit("I"), F.col("trail").cast("int")))
    # trailing inserts end in an assistant turn
    after = new(F.col("trail"), F.when(F.col("trail") == 1, ASSISTANT).otherwise(USER), F.lit(ASSISTANT))
    done = placed.join(edits, "pos").select(F.col("id").alias(id_col), "pos", "turn", letters.alias("letters"), F.concat(new(F.col("n_ins"), first, other), own, after).alias("turns"))

    extra = F.col("copies") - 1
    facts = placed.groupBy("id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("fault") == _BLANK, F.col("copies")).otherwise(0)).cast("long").alias("blank"),
        F.sum(F.when(F.col("fault") == _BLANK, 0).when(F.col("fault") == _DUPLICATE, F.col("copies")).otherwise(extra)).cast("long").alias("duplicate"),
        F.sum(F.when(F.col("fault") == _TRUNCATED, 1).otherwise(0)).cast("long").alias("truncated"),
    )
    total = costs.where("is_last").select(F.col("id").alias("i"), "illegal", "cost")
    facts = facts.join(total, F.col("id").eqNullSafe(F.col("i"))).select(F.col("id").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return done, facts


def _digests(batches):
    """(id, audit, sha) of rows sorted by id and pos: a conversation's hash and letters are carried from batch to batch."""
    open_id, digest, letters, begun = None, None, [], False
    field = None

    def close():
        return pa.RecordBatch.from_arrays([pa.array([open_id], field), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], ["id", "audit", "repaired_sha256"])

    for batch in batches:
        field = batch.schema.field("id").type
        for key, said, lines in zip(*(batch.column(c).to_pylist() for c in ("id", "letters", "lines"))):
            if digest is None or key != open_id:
                if digest is not None:
                    yield close()
                open_id, digest, letters, begun = key, hashlib.sha256(), [], False
            letters.append(said)
            if lines is not None:
                digest.update(("\n" * begun + lines).encode())
                begun = True
    if digest is not None:
        yield close()


def repair(rows: DataFrame, ids: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per conversation of ids: (id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    audit is the letters of all edits, repaired_sha256 the digest of the repaired turns as role:text lines. A conversation of ids
    without rows has zeros, an empty audit and the digest of nothing. For the rest see repaired_rows().
    """
    edits, facts = repaired_rows(rows, id_col, turn_col, role_col, text_col, bits)
    lines = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n"))
    stream = edits.select(F.col(id_col).alias("id"), "pos", "letters", lines.alias("lines")).repartition("id").sortWithinPartitions("id", "pos")
    kind = stream.schema["id"].dataType.simpleString()
    said = map_arrow(stream.drop("pos"), _digests, f"id {kind}, audit string, repaired_sha256 string")
    out = ids.select(F.col(f"`{id_col}`").alias("k")).distinct().join(facts, F.col("k").eqNullSafe(F.col(id_col)), "left")
    out = out.join(said.alias("d"), F.col("k").eqNullSafe(F.col("d.id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("k").alias(id_col), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
