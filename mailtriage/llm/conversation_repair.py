"""Structure repair of conversations: the cheapest edits after which roles alternate.

A conversation's rows are kept, given another role or deleted, and empty turns are inserted, so that the
role initials read `(s?(ua)+)?`. Costs: keep 0, rerole 2, delete 3, insert 2; a truncated row that stays
costs 1 more; blank and repeated rows must go. The edit lattice has a node for each (rows read, last
role); A* searches it with the key (cost so far plus heuristic, audit so far), where the audit is the
initials of the edits and the heuristic sums what the rows ahead cost in any case: 3 for each row that
must go, 1 for each truncated one. The heuristic is consistent, and of two equally cheap ways to a node
neither audit is the start of the other (it would have fewer inserts and cost less), so the node is first
reached by the ASCII-least one.

Spark deals the rows by conversation once, marks repeats with a window and sorts; a task then streams its
conversations in blocks of BLOCK rows or BLOCK_BYTES. At the end of a block the cheapest way to each of
the four last roles survives, with its cost, its place in audit order and the state of its hash, so memory
holds a block whatever the length of the conversation (and its audit, a letter a row). One conversation
stays one sequence: the SHA-256 of its repaired text has no parallel form.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BLOCK_BYTES = 512, 4 << 20
RESULT_ROWS, RESULT_BYTES = 4096, 8 << 20
#: Last roles: nothing yet, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What an inserted row or one with a new role becomes after each last role.
WANTED = [(USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user")]
WHOLE = (NOTHING, ASSISTANT)
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
_FULL_STOP = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: conversations with one fault in four rows, by the remainder of
    crc32(`conv_id:turn`) by 20: 0 marks the row as lost, 1 empties its text, 2 takes out `.`, `!` and
    `?`, 3 repeats the row, 4 makes it the user's.

    Null role and text are one space, as are null ids and turns inside the checksum (the columns keep
    their nulls). Other columns are left out.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    rows = rows.withColumn("copies", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("lost"))


def cheapest(rows: list[tuple[str, bool, bool]], start: int, last: bool) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the best way through rows of (role initial, must go, truncated), by last role.

    Inserts come before a row; only where last is set also behind all rows, and then just the best
    whole conversation is looked for.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if rows[i][1] else rows[i][2])
    heap, closed, found = [(ahead[0], "", 0, start)], set(), {}
    while heap:
        key, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and (not last or state in WHOLE):
            found[state] = (key, audit)
            if last or len(found) == 4:
                break
            continue
        cost, (wanted, _) = key - ahead[i], WANTED[state]
        heapq.heappush(heap, (cost + INSERT + ahead[i], audit + "I", i, wanted))
        if i == n:
            continue
        initial, must_go, truncated = rows[i]
        rest = cost + ahead[i + 1]
        heapq.heappush(heap, (rest + DELETE, audit + "D", i + 1, state))
        if not must_go:
            heapq.heappush(heap, (rest + REROLE + truncated, audit + "R", i + 1, wanted))
            if (kept := FOLLOWS.get((state, initial))) is not None:
                heapq.heappush(heap, (rest + KEEP + truncated, audit + "K", i + 1, kept))
    return found


@dataclass
class _Way:
    """The cheapest edits so far that end in one last role. audit and text are linked pieces."""

    cost: int = 0
    place: int = 0
    audit: tuple | None = None
    text: tuple | None = None
    any_line: bool = False
    digest: object = field(default_factory=hashlib.sha256)

    def then(self, state: int, cost: int, audit: str, block: list[tuple[str, str]], keep_text: bool) -> _Way:
        lines, at = [], 0
        for edit in audit:
            wanted, name = WANTED[state]
            role, text = (name, "") if edit == "I" else block[at]
            at += edit != "I"
            if edit != "D":
                state, role = (FOLLOWS[state, role[:1]], role) if edit == "K" else (wanted, name)
                lines.append(f"{role}:{text}")
        piece = ("\n" if self.any_line and lines else "") + "\n".join(lines)
        digest = self.digest.copy()
        digest.update(piece.encode())
        return _Way(self.cost + cost, 0, (self.audit, audit), (self.text, piece) if keep_text else None, self.any_line or bool(lines), digest)


def _joined(pieces: tuple | None) -> str:
    out = []
    while pieces:
        pieces, piece = pieces
        out.append(piece)
    return "".join(reversed(out))


class _Conversation:
    """Reads one conversation's rows in order."""

    def __init__(self, conv_id, keep_text: bool):
        self.conv_id, self.keep_text = conv_id, keep_text
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.before = None
        self.turns, self.initial = 0, None
        self.ways = {NOTHING: _Way()}
        self.held: list[tuple[str, str]] = []
        self.kinds: list[tuple[str, bool, bool]] = []
        self.size = 0

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        if len(self.held) >= BLOCK or self.size >= BLOCK_BYTES:
            self._close(False)
        initial = role[:1]
        self.counts["illegal"] += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        blank = not text.strip(_BLANK)
        truncated = not (blank or repeated) and not _FULL_STOP.search(text[-64:] if text[-1] not in _BLANK else text.rstrip(_BLANK)[-1:])
        for name, is_so in (("blank", blank), ("duplicate", repeated and not blank), ("truncated", truncated)):
            self.counts[name] += is_so
        self.held.append((role, text))
        self.kinds.append((initial, blank or repeated, truncated))
        self.size += len(text)

    def _close(self, last: bool) -> None:
        """Extends every surviving way over the block. Ways differ before either ends, so their order
        is that of the ways they extend, and then of the audits in this block."""
        best: dict[int, tuple] = {}
        for state, way in self.ways.items():
            for end, (cost, audit) in cheapest(self.kinds, state, last).items():
                mine = (way.cost + cost, way.place, audit, state)
                to = NOTHING if last else end
                best[to] = min(best.get(to, mine), mine)
        ways = {}
        order = sorted((place, audit, end) for end, (_, place, audit, _) in best.items())
        for place, (_, audit, end) in enumerate(order):
            total, _, _, state = best[end]
            ways[end] = self.ways[state].then(state, total - self.ways[state].cost, audit, self.held, self.keep_text)
            ways[end].place = place
        self.ways, self.held, self.kinds, self.size = ways, [], [], 0

    def result(self) -> tuple:
        if self.held:
            self._close(True)
        way = self.ways[NOTHING]
        gaps = 0 if self.most is None else int(self.most - self.least) + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), way.cost, _joined(way.audit), way.digest.hexdigest(), _joined(way.text) if self.keep_text else None)


def repair(conversations: DataFrame, lost: str | None = None, with_text: bool = True) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, if asked
    for, repaired (`role:text` lines): a row for each conv_id.

    Rows are taken by turn (nulls first, then role and text). lost names a boolean column; rows where it
    is true count for their conv_id only, and a conversation without other rows has zeros, an empty audit
    and the hash of the empty text. Null role or text is one space; a null conv_id is a conversation like
    others. A row's initial is the first character of its role. Equal rows are repeats of the first one.
    Other columns are ignored. An empty table gives no rows. With with_text a repaired conversation must
    fit a row; the hash alone is made in bounded memory.
    """
    gone = F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)

    def value(name: str) -> Column:
        return F.when(~gone, F.coalesce(F.col(name).cast("string"), F.lit(" "))).alias(name)

    rows = conversations.select("conv_id", "turn", value("role"), value("text")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("repeated", F.row_number().over(same) > 1)
    # Of equal rows in one turn the first of all comes first.
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "repeated")
    kind = conversations.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
    arrow = pa.schema([(n, pa.int64()) for n in "gaps blank duplicate truncated illegal cost".split()] + [(n, pa.string()) for n in ("audit", "repaired_sha256", "repaired")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        done: list[tuple] = []
        size, id_type = 0, pa.null()

        def packed() -> pa.RecordBatch:
            ids, *columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, columns, arrow.types)], ["conv_id", *arrow.names])

        for batch in batches:
            id_type = batch.schema.types[0]
            for conv_id, turn, role, text, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now:
                        done.append(now.result())
                        size += len(done[-1][-3]) + len(done[-1][-1] or "")
                        if len(done) >= RESULT_ROWS or size >= RESULT_BYTES:
                            yield packed()
                            done, size = [], 0
                    now = _Conversation(conv_id, with_text)
                if role is not None:
                    now.add(turn, role, text, repeated)
        if now:
            done.append(now.result())
            yield packed()

    found = rows.mapInArrow(run, schema)
    return found if with_text else found.drop("repaired")
