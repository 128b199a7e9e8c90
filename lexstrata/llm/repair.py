"""Conversation structure repair: the cheapest edits that make a conversation a legal one.

Rows of a conversation and the states of a legal one span a lattice, whose
edges are edits.  Heaps from both ends meet in it; all crossings of the least
cost are finished, and the least audit of these is taken.  Conversations that
are long, or that reach over the edge of a task, are cut into segments: each
is searched for every pair of states at its ends, and the segments' ways are
chained, so that no task holds a long conversation's texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexstrata.llm.common import trimmed, weighted_join, written
from lexstrata.llm.pieces import batches_of, piece_digests, rows_of

#: A segment has at most so many rows, or characters, before the next row begins another one.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 4 << 20
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: B nothing said yet, S behind the system row, U behind a user row, A behind an assistant row.
STATES = "BSUA"
#: The state that a user or assistant row leads to; the row's role follows from it.
NEXT = {"B": "U", "S": "U", "U": "A", "A": "U"}
BEFORE = {"U": "BSA", "A": "U"}
ROLE = {"U": "user", "A": "assistant"}
#: Initials that a row may be kept with: state, initial, state behind it.
KEEP = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
KEPT_BEFORE = {x: [(a, i) for (a, i), b in KEEP.items() if b == x] for x in STATES}
#: What a conversation may end with.
ENDS = "BA"
#: Characters that a text is blank without.
WORDLIKE = r"[^\x20\x09-\x0D]"

Row = tuple[str, int, bool]  # initial of the role; copies that must go, 0 for a row that may stay; truncated
Way = tuple[int, str]  # cost, audit


def _onward(rows: list[Row], i: int, state: str) -> Iterator[tuple[int, str, int, str]]:
    """Edits that leave a node: place and state behind them, cost, initials."""
    yield i, NEXT[state], INSERT, "I"
    if i < len(rows):
        initial, gone, cut = rows[i]
        yield i + 1, state, DELETE * max(gone, 1), "D" * max(gone, 1)
        if not gone:
            more = TRUNCATED if cut else 0
            yield i + 1, NEXT[state], REROLE + more, "R"
            if (state, initial) in KEEP:
                yield i + 1, KEEP[state, initial], more, "K"


def _backward(rows: list[Row], i: int, state: str) -> Iterator[tuple[int, str, int, str]]:
    """Edits that lead to a node: place and state before them, cost, initials."""
    for before in BEFORE.get(state, ""):
        yield i, before, INSERT, "I"
    if i > 0:
        initial, gone, cut = rows[i - 1]
        yield i - 1, state, DELETE * max(gone, 1), "D" * max(gone, 1)
        if not gone:
            more = TRUNCATED if cut else 0
            for before in BEFORE.get(state, ""):
                yield i - 1, before, REROLE + more, "R"
            for before, kept in KEPT_BEFORE[state]:
                if kept == initial:
                    yield i - 1, before, more, "K"


def cheapest(rows: list[Row], entry: str = "B", exits: str = ENDS) -> Way | None:
    """The least cost from ``entry`` to one of ``exits`` over all rows, and the ASCII-least audit of that cost; None without a way.

    A node's key is its cost, then its place: edits that cost nothing move
    the place, so a node's least audit is final when its turn comes.  Two
    ways of one cost between two nodes never have audits of which one begins
    with the other (what is longer has more insertions), so least parts make
    least wholes.
    """
    n = len(rows)
    sides = []
    for at, states, edges, sign in ((0, entry, _onward, 1), (n, exits, _backward, -1)):
        known = {(at, s): (0, "") for s in states}
        sides.append((known, [(0, 0, at, s) for s in states], set(), edges, sign))
        heapq.heapify(sides[-1][1])
    best = min((0 for x in sides[0][0] if x in sides[1][0]), default=None)
    while sides[0][1] and sides[1][1] and (best is None or sides[0][1][0][0] + sides[1][1][0][0] <= best):
        side = 0 if sides[0][1][0][:2] <= sides[1][1][0][:2] else 1
        known, heap, settled, edges, sign = sides[side]
        other = sides[1 - side][0]
        cost, _, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        audit = known[i, state][1]
        for j, to, price, letters in edges(rows, i, state):
            way = (cost + price, audit + letters if sign > 0 else letters + audit)
            if (j, to) not in known or way < known[j, to]:
                if (j, to) not in known or way[0] < known[j, to][0]:
                    heapq.heappush(heap, (way[0], j if sign > 0 else n - j, j, to))
                known[j, to] = way
            if (j, to) in other:
                met = way[0] + other[j, to][0]
                best = met if best is None else min(best, met)
    if best is None:
        return None
    (ahead, _, gone_ahead, _, _), (behind, _, gone_behind, _, _) = sides
    gone_ahead.add((0, entry))
    gone_behind.update((n, s) for s in exits)
    audits = [ahead[x][1] + behind[x][1] for x in gone_ahead & gone_behind if ahead[x][0] + behind[x][0] == best]
    for i, state in gone_ahead:
        cost, audit = ahead[i, state]
        audits += [audit + letters + behind[j, to][1] for j, to, price, letters in _onward(rows, i, state) if (j, to) in gone_behind and cost + price + behind[j, to][0] == best]
    return best, min(audits)


def all_ways(rows: list[Row]) -> list[Way | None]:
    """The cheapest way from each state to each, in the order of ``STATES`` x ``STATES``."""
    ways = {(a, b): cheapest(rows, a, b) for a, b in ("BB", "BS", "BU", "BA", "SA", "SS", "UU", "UA", "AU", "AA")}
    ways["S", "U"] = ways["A", "U"]  # behind S and A the same rows may follow
    return [ways.get((a, b)) for a in STATES for b in STATES]


def mended(rows: list[dict], audit: str, state: str) -> list[dict]:
    """The messages that an audit leaves of rows with ``role, text, gone``."""
    out, at = [], iter(rows)
    letters = iter(audit)
    for letter in letters:
        row = None if letter == "I" else next(at)
        if letter == "D":
            for _ in range(row["gone"] - 1):
                next(letters)
        elif letter == "K":
            state = KEEP[state, row["role"][:1]]
            out.append({"role": row["role"], "text": row["text"]})
        else:
            state = NEXT[state]
            out.append({"role": ROLE[state], "text": row["text"] if row else ""})
    return out


def _end_state(audit: str, rows: list[dict], state: str) -> str:
    """The state behind an audit."""
    for m in mended(rows, audit, state):
        state = KEEP[state, m["role"][:1]]
    return state


def damaged(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with one row in twenty dropped, emptied, unpunctuated, repeated or made a user's, by the checksum of ``conv_id:turn``; a null is one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one(conv_col), F.lit(":"), one(turn_col)).cast("binary")), F.lit(20))
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_time"))
    return rows.drop("_time")


def _grouped(messages: DataFrame) -> DataFrame:
    """Rows that are alike as one with ``copies``, and ``again`` where an earlier turn of the conversation has the same role and text."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = messages.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").isNull().alias("no_conv"),
        "conv_id",
        F.col("turn").isNotNull().alias("placed"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.sha2(text, 256).alias("print"),
    )
    groups = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "repair-rows")
    same = ["conv", "no_conv", "role", "print"]
    place = F.struct("placed", "turn")
    repeated = groups.groupBy(*same).agg(F.min(place).alias("first_place"), F.count("*").alias("_turns")).filter("_turns > 1")
    marked = weighted_join(groups, repeated, same, F.col("turn"), "left", "_turns")
    last = F.regexp_extract("text", rf"(?s)({WORDLIKE})[\x20\x09-\x0D]*\z", 1)
    return marked.select(
        "conv", "no_conv", "conv_id", "placed", "turn", "role", "text", "copies",
        F.coalesce(F.col("first_place") != place, F.lit(False)).alias("again"),
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
    )


#: Counts of a segment and its edges, then its ways (a part of a conversation) or its way (a whole one).
SEGMENT = (
    "part int, seq int, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
    "first_turn long, last_turn long, turns long, cost long, audit string, ways array<struct<cost: long, audit: string>>, rows array<struct<role: string, text: string, gone: long>>"
)
COUNTS = ["n", "blank", "duplicate", "truncated", "illegal"]


class _Segment:
    """Rows of a conversation next to each other, as a task reads them."""

    def __init__(self, conv: tuple):
        self.conv, self.rows, self.shapes, self.chars = conv, [], [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_initial = self.last_initial = self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, placed, turn, role, text, copies, again, blank, truncated):
        c, initial = self.counts, role[:1]
        c["n"] += copies
        pair = (self.last_initial or "") + initial
        c["illegal"] += (self.first_initial is not None and pair not in ("su", "ua", "au")) + copies - 1
        self.first_initial, self.last_initial = initial if self.first_initial is None else self.first_initial, initial
        if placed and turn != self.last_turn:
            self.first_turn, self.last_turn, self.turns = turn if self.first_turn is None else self.first_turn, turn, self.turns + 1
        gone = copies if blank or again else copies - 1
        c["blank"] += copies if blank else 0
        c["duplicate"] += 0 if blank else gone
        if not blank and not again:
            c["truncated"] += truncated
            self.rows.append({"role": role, "text": text, "gone": 0})
            self.shapes.append((initial, 0, truncated))
            self.chars += len(text)
        if gone:
            self.rows.append({"role": role, "text": "", "gone": gone})
            self.shapes.append((initial, gone, False))

    def row(self, part: int, seq: int, whole: bool) -> tuple:
        cost, audit = cheapest(self.shapes) if whole else (None, None)
        ways = None if whole else [w and {"cost": w[0], "audit": w[1]} for w in all_ways(self.shapes)]
        edges = (self.first_initial, self.last_initial, self.first_turn, self.last_turn, self.turns)
        return (*self.conv, part, seq, whole, *self.counts.values(), *edges, cost, audit, ways, self.rows)


def _segments(groups: DataFrame) -> DataFrame:
    """Segments in the order of conversations and rows, dealt by ranges: a long conversation lies in many tasks.

    The first and the last conversation of a task may go on in another one,
    so these count as parts, as those do that are longer than a segment.
    """
    ids = ["conv", "no_conv", "conv_id"]
    schema = StructType([*groups.select(*ids).schema.fields, *StructType.fromDDL(SEGMENT).fields])
    made = batches_of(schema)
    columns = [*ids, "placed", "turn", "role", "text", "copies", "again", "blank", "truncated"]
    rows_most, chars_most = SEGMENT_ROWS, SEGMENT_CHARS

    def cut(batches):
        from pyspark import TaskContext

        part, seq, now, broken, done = TaskContext.get().partitionId(), 0, None, True, []
        for *conv, placed, turn, role, text, copies, again, blank, truncated in rows_of(batches, columns):
            new = now is None or tuple(conv) != now.conv
            if now is not None and (new or len(now.rows) >= rows_most or now.chars >= chars_most):
                done.append(now.row(part, seq, new and not broken))
                seq, broken, now = seq + 1, not new, None
            if now is None:
                now = _Segment(tuple(conv))
            now.add(placed, turn, role, text, copies, again, blank, truncated)
            if len(done) >= 256:
                yield made(done)
                done = []
        if now is not None:
            done.append(now.row(part, seq, False))
        yield made(done)

    keys = ["conv", "no_conv", "placed", "turn", "role"]
    dealt = groups.repartitionByRange(*keys, F.substring("text", 1, 256)).sortWithinPartitions(*keys, "text")
    return dealt.select(*columns).mapInArrow(trimmed(cut), schema)


def _chained(parts: DataFrame) -> DataFrame:
    """For the parts of each conversation, in order: the audit that the cheapest way has in them, and on the first part the sums.

    What a task holds of a conversation is a few letters for each of its
    rows, as the one audit that is asked for is too.
    """
    sums = "cost long, n long, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, turns long, audit string"
    schema = StructType([*parts.select("conv", "no_conv", "conv_id", "part", "seq").schema.fields, *StructType.fromDDL("state string, own string, head boolean, " + sums).fields])
    made = batches_of(schema)

    def chain(table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        reached, trail = {"B": (0, "")}, []
        for r in rows:
            steps = {}
            for k, way in enumerate(r["ways"]):
                a, b = STATES[k // 4], STATES[k % 4]
                if way and a in reached:
                    found = (reached[a][0] + way["cost"], reached[a][1] + way["audit"], a, way["audit"])
                    if b not in steps or found < steps[b]:
                        steps[b] = found
            trail.append({b: x[2:] for b, x in steps.items()})
            reached = {b: x[:2] for b, x in steps.items()}
        state = min((reached[e], e) for e in ENDS if e in reached)[1]
        cost, audit = reached[state]
        own = []
        for step in reversed(trail):
            state, letters = step[state]
            own.append((state, letters))
        total = {c: sum(r[c] for r in rows) for c in [*COUNTS, "turns"]}
        for left, right in zip(rows, rows[1:], strict=False):
            total["illegal"] += left["last_initial"] + right["first_initial"] not in ("su", "ua", "au")
        placed = [r for r in rows if r["first_turn"] is not None]
        total["turns"] -= sum(left["last_turn"] == right["first_turn"] for left, right in zip(placed, placed[1:], strict=False))
        edges = (placed[0]["first_turn"], placed[-1]["last_turn"]) if placed else (None, None)
        sums = (cost, *(total[c] for c in COUNTS), *edges, total["turns"], audit)
        out = []
        for k, (r, (state, letters)) in enumerate(zip(rows, reversed(own), strict=True)):
            out.append((r["conv"], r["no_conv"], r["conv_id"], r["part"], r["seq"], state, letters, k == 0, *(sums if k == 0 else (None,) * len(sums))))
        import pyarrow as pa

        return pa.Table.from_batches([made(out)])

    slim = parts.drop("rows", "whole", "cost", "audit")
    return slim.groupBy("conv", "no_conv").applyInArrow(chain, schema)


def _messages(segments: DataFrame) -> DataFrame:
    """``messages``, an array of role and text, in place of the rows of a segment with ``state`` and ``own``, its audit."""
    fields = [f for f in segments.schema.fields if f.name != "rows"]
    schema = StructType([*fields, *StructType.fromDDL("messages array<struct<role: string, text: string>>").fields])
    made, names = batches_of(schema), [f.name for f in fields]
    state, own = names.index("state"), names.index("own")

    def mend(batches):
        for batch in batches:
            rows = rows_of([batch], [*names, "rows"])
            yield made([(*r, mended(items, r[own], r[state])) for *r, items in rows])

    return segments.mapInArrow(trimmed(mend), schema)


def repaired(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair conversations given as ``conv_id, turn, role, text``.

    The first result has one row for each conversation: ``conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    The second has one row for each segment of a repaired conversation, in
    order of ``part, seq``: ``conv_id, part, seq, messages``, an array of
    role and text, from which ``exploded`` makes rows.

    Rows are taken by turn, nulls first; rows of one turn by role and text.
    A null role or text is one space; a null conversation is one of its own.
    Rows that are alike are one with a count, and all but the first of them
    are duplicates.  Other columns are ignored.  An empty table gives empty
    results.
    """
    segments = written(_segments(_grouped(messages)), "repair-segments")
    ids = ["conv", "no_conv", "conv_id"]
    whole = segments.filter("whole").withColumns({"state": F.lit("B"), "own": F.col("audit")})
    parts = segments.filter("not whole")
    chained = written(_chained(parts), "repair-chained")
    links = chained.select("conv", "no_conv", "part", "seq", "state", "own")
    said = written(
        _messages(whole.select(*ids, "part", "seq", "whole", "state", "own", "rows").unionByName(parts.select(*ids, "part", "seq", "whole", "rows").join(links, ["conv", "no_conv", "part", "seq"]).select(*ids, "part", "seq", "whole", "state", "own", "rows"))),
        "repair-messages",
    )
    spoken = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    pieces = said.filter(~F.col("whole") & (F.size("messages") > 0)).select("conv", "no_conv", "part", "seq", spoken.alias("_data"))
    long = piece_digests(pieces, ["conv", "no_conv"], ["part", "seq"], "_data", b"\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    sums = [gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    short = said.filter("whole").select("conv", "no_conv", F.sha2(spoken, 256).alias("sha256"))
    heads = whole.select(*ids, *sums).unionByName(chained.filter("head").select(*ids, *sums))
    digests = short.unionByName(long)
    found = heads.join(digests, ["conv", "no_conv"], "left").drop("conv", "no_conv")
    return found.withColumn("repaired_sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).drop("sha256"), said.select("conv_id", "part", "seq", "messages")


def exploded(said: DataFrame) -> DataFrame:
    """``conv_id, part, seq, at, role, text``: the rows of repaired conversations."""
    return said.select("conv_id", "part", "seq", F.posexplode("messages").alias("at", "_m")).select("conv_id", "part", "seq", "at", "_m.role", "_m.text")


def damage_and_repair(messages: DataFrame) -> DataFrame:
    """``repaired`` over ``damaged`` rows, with a row for every conversation, also one that has lost all its rows."""
    found, _ = repaired(damaged(messages))
    everyone = messages.select(F.col("conv_id").alias("_all")).distinct()
    zero: Column = F.lit(0).cast("long")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    both = everyone.join(found, F.col("_all").eqNullSafe(F.col("conv_id")), "left")
    return both.select(
        F.col("_all").alias("conv_id"),
        *(F.coalesce(c, zero).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
