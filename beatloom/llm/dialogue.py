"""Repair of conversation structure by alignment with the grammar ``(s?(ua)+)?``.

A conversation is a string of turns, the target an alternating string of role
initials. For every feasible length of the target Wagner and Fischer's table gives
the cheapest edits. Lengths are tried by their least possible cost until that
exceeds the cheapest alignment so far (the incumbent); by the same bound only a
band of diagonals of each table (Ukkonen) is filled. The table holds costs of what
is left, so the trace runs forward and takes the least letter at each step; audits
of equal cost are compared over all targets.

Long conversations are cut into blocks of turns. A block is aligned from each state
of the grammar to each other one, and the states carry cost, audit and a running
digest; of two ways to one state the cheaper, then the ASCII-smaller audit goes on.
This is exact: two equally cheap audits of the same turns between the same states
are never prefixes of one another, for the longer would have insertions to pay.
So a task holds one block of turns at a time, however long the conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beatloom.llm.text import map_batches

REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1  # costs; an undeleted truncated turn adds CUT_OFF
BLOCK_TURNS = 32
SPACE = "[\\x20\\x09-\\x0D]"
ROLES = {"u": "user", "a": "assistant"}

BEGIN, SYSTEM, USER, ASSISTANT = "Bsua"
ENDS = (BEGIN, ASSISTANT)  # states in which a conversation may end
# (from, to): (is a system turn first, initial of the first other turn, that part's fewest turns)
TARGETS = {
    (BEGIN, BEGIN): [(False, "", 0)],
    (BEGIN, SYSTEM): [(True, "", 0)],
    (BEGIN, USER): [(False, "u", 1), (True, "u", 1)],
    (BEGIN, ASSISTANT): [(False, "u", 2), (True, "u", 2)],
    (SYSTEM, SYSTEM): [(False, "", 0)],
    (SYSTEM, USER): [(False, "u", 1)],
    (SYSTEM, ASSISTANT): [(False, "u", 2)],
    (USER, USER): [(False, "a", 0)],
    (USER, ASSISTANT): [(False, "a", 1)],
    (ASSISTANT, ASSISTANT): [(False, "u", 0)],
    (ASSISTANT, USER): [(False, "u", 1)],
}

Turn = tuple[str, str, int]  # role, text, fault
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)


def _targets(start: str, end: str, n: int, gone: int) -> list[tuple[int, str]]:
    """(least cost, target) of every length that no cost rules out yet."""
    out = []
    for system, first, fewest in TARGETS.get((start, end), ()):
        top = 3 * n + 4  # deleting all turns and inserting two is never dearer
        m = fewest
        while True:
            size = m + system
            drops = max(gone, n - size)
            least = DELETE * drops + INSERT * (size - n + drops)
            if size > n and least > top:
                break
            if least <= top:
                pair = first + ("a" if first == "u" else "u")
                out.append((least, "s" * system + (pair * (m // 2 + 1))[:m] if m else "s" * system))
            if not first:
                break
            m += 2
    return sorted(out)


def _band(n: int, m: int, most: int) -> tuple[int, int]:
    """Diagonals (column minus row) on which a path of at most ``most`` can run."""
    cost = lambda k: INSERT * k if k > 0 else -DELETE * k
    inside = [k for k in range(-n, m + 1) if cost(k) + cost(m - n - k) <= most]
    return (inside[0], inside[-1]) if inside else (1, 0)


def _align(turns: list[Turn], target: str, most: int) -> tuple[int, str] | None:
    """Cost and least audit of turning ``turns`` into ``target``, if at most ``most``."""
    n, m = len(turns), len(target)
    low, high = _band(n, m, most)
    big = 1 << 60
    left = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        row, below = left[i], left[i + 1]
        if i < n:
            role, _, fault = turns[i]
            forced, extra = fault in (BLANK, DUPLICATE), CUT_OFF * (fault == TRUNCATED)
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            best = 0 if i == n and j == m else big
            if i < n:
                best = below[j] + DELETE
                if j < m and not forced:
                    c = target[j]
                    step = 0 if role[:1] == c else big if c == "s" else REROLE
                    best = min(best, below[j + 1] + step + extra)
            if j < m and target[j] != "s":
                best = min(best, row[j + 1] + INSERT)
            row[j] = best
    total = left[0][0]
    if total > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        rest = left[i][j]
        if i < n and left[i + 1][j] + DELETE == rest:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and left[i][j + 1] + INSERT == rest:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i][0][:1] == target[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def align_block(turns: list[Turn], start: str, end: str) -> tuple[int, str] | None:
    """Cost and least audit from one state of the grammar to another."""
    gone = sum(t[2] in (BLANK, DUPLICATE) for t in turns)
    found: tuple[int, str] | None = None
    for least, target in _targets(start, end, len(turns), gone):
        most = 3 * len(turns) + 4 if found is None else found[0]
        if least > most:
            break
        other = _align(turns, target, most)
        if other is not None and (found is None or other < found):
            found = other
    return found


def repaired(turns: list[Turn], audit: str, state: str) -> tuple[list[tuple[str, str]], str]:
    """(role, text) of the turns after the edits, and the state they end in."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = ROLES["a" if state == USER else "u"], ""
        if edit != "I":
            text = turns[i][1]
            role = turns[i][0] if edit == "K" else role
            i += 1
        out.append((role, text))
        state = role[:1]
    return out, state


Path = tuple | None  # (path before, audit of the block)


def _smaller(x: Path, y: Path) -> bool:
    """Is audit x smaller than y? They share all blocks before they part."""
    a, b = [], []
    while x is not y:
        a.append(x[1])
        b.append(y[1])
        x, y = x[0], y[0]
    return "".join(reversed(a)) < "".join(reversed(b))


class Conversation:
    """Report of one conversation whose turns come in order, block by block."""

    def __init__(self) -> None:
        self.block: list[Turn] = []
        self.n = self.illegal = self.turns = 0
        self.faults = [0, 0, 0, 0]
        self.first = self.last = None
        self.before: str | None = None
        # state: cost, audit so far, digest of the repaired turns, is it empty
        self.ways: dict[str, tuple[int, Path, object, bool]] = {BEGIN: (0, None, hashlib.sha256(), True)}

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if len(self.block) == BLOCK_TURNS:
            self._close(tuple("Bsua"))
        self.n += 1
        self.faults[fault] += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.block.append((role, text, fault))

    def _close(self, ends: tuple[str, ...]) -> None:
        ways = {}
        for end in ends:
            best = None
            for start, (cost, path, digest, empty) in self.ways.items():
                found = align_block(self.block, start, end)
                if found is None:
                    continue
                here = (cost + found[0], (path, found[1]), start, digest, empty)
                if best is None or here[0] < best[0] or here[0] == best[0] and _smaller(here[1], best[1]):
                    best = here
            if best is not None:
                cost, path, start, digest, empty = best
                rows, _ = repaired(self.block, path[1], start)
                if rows:
                    digest = digest.copy()
                    digest.update((b"" if empty else b"\n") + "\n".join(f"{r}:{t}" for r, t in rows).encode())
                ways[end] = (cost, path, digest, empty and not rows)
        self.ways, self.block = ways, []

    def report(self) -> tuple:
        if self.n:
            self._close(ENDS)
        best = None
        for cost, path, digest, _ in self.ways.values():
            if best is None or cost < best[0] or cost == best[0] and _smaller(path, best[1]):
                best = (cost, path, digest)
        cost, path, digest = best
        parts = []
        while path is not None:
            parts.append(path[1])
            path = path[0]
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.n, gaps, *self.faults[1:], self.illegal, cost, "".join(reversed(parts)), digest.hexdigest())


FIELDS = (
    "turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def _judged(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """Turns with their fault, all turns of a conversation in one partition."""
    q = lambda c: F.col(f"`{c}`")
    filled = lambda c: F.coalesce(q(c).cast("string"), F.lit(" "))
    d = turns.select(
        q(conv).alias("_conv"), q(turn).cast("long").alias("_turn"), filled(role).alias("_role"), filled(text).alias("_text"),
        (F.coalesce(q(present), F.lit(False)) if present else F.lit(True)).alias("_there"),
    ).repartition("_conv")
    same = Window.partitionBy("_conv", "_role", "_text", "_there").orderBy(F.col("_turn").asc_nulls_first())
    fault = (
        F.when(~F.col("_text").rlike(f"[^{SPACE[1:]}"), BLANK)
        .when(F.row_number().over(same) > 1, DUPLICATE)
        .when(~F.col("_text").rlike(f"[.!?]{SPACE}*\\z"), TRUNCATED)
        .otherwise(NONE)
    )
    return d.withColumn("_fault", fault)


def _order() -> list[Column]:
    """By turn, nulls first; equal rows stand side by side, the repeated ones last."""
    return [F.col("_turn").asc_nulls_first(), F.col("_role").asc(), F.col("_text").asc(), (F.col("_fault") == DUPLICATE).asc()]


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None
) -> DataFrame:
    """One row per conversation: its number of ``turns``, faults, and cheapest repair.

    Turns stand in the order of ``turn`` (nulls first), those of one turn in the
    order of role and text. A null role or text is one space. Each turn's first
    fault counts: ``blank`` (no character but white space), ``duplicate`` (role and
    text seen before), ``truncated`` (does not end in ``.``, ``!`` or ``?``).
    ``gaps`` are missing turn numbers, ``illegal`` are neighbours other than su, ua,
    au. ``audit`` has a letter per edit (Keep, Rerole, Delete, Insert). Roles that
    do not begin with s, u or a cannot be kept, empty ones neither. Rows where
    ``present`` is not true only name their conversation; one without turns has
    zeros, an empty audit and the digest of nothing. Null conversation keys are one
    conversation; an empty table gives no rows.

    The digest needs a conversation's turns in order, so one task reads them; it
    holds ``BLOCK_TURNS`` of them at a time.
    """
    d = _judged(turns, conv, turn, role, text, present)
    d = d.sortWithinPartitions(F.col("_conv"), *_order())
    key = turns.schema[conv]
    schema = StructType([key, *StructType.fromDDL(FIELDS)])
    names, read = schema.fieldNames(), d.columns

    def columns(done: list[tuple]) -> dict:
        return dict(zip(names, map(list, zip(*done))))

    def run(batches) -> Iterator[dict]:
        now, open_ = object(), None
        for batch in batches:
            done = []
            for conv_, turn_, role_, text_, there, fault in zip(*(batch.column(c).to_pylist() for c in read)):
                if open_ is None or conv_ != now:
                    if open_ is not None:
                        done.append((now, *open_.report()))
                    now, open_ = conv_, Conversation()
                if there:
                    open_.add(turn_, role_, text_, fault)
            if done:
                yield columns(done)
        if open_ is not None:
            yield columns([(now, *open_.report())])

    return map_batches(d, run, schema)


def repaired_turns(
    turns: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None
) -> DataFrame:
    """The edits of ``report`` applied: a row per edit with ``conv``, ``edit``, the
    ``place`` in the repaired conversation (null: deleted), ``role`` and ``text``."""
    d = _judged(turns, conv, turn, role, text, present).filter("_there")
    by = Window.partitionBy("_conv").orderBy(*_order())
    d = d.withColumn("_i", F.row_number().over(by)).select("_conv", "_i", "_role", "_text")
    e = report.select(F.col(f"`{conv}`").alias("_conv2"), F.posexplode(F.split("audit", "")).alias("_at", "edit")).filter("edit != ''")
    upto = Window.partitionBy("_conv2").orderBy("_at")
    e = e.withColumn("_i2", F.sum((F.col("edit") != "I").cast("int")).over(upto)).withColumn(
        "place", F.when(F.col("edit") != "D", F.sum((F.col("edit") != "D").cast("int")).over(upto) - 1)
    )
    on = F.col("_conv2").eqNullSafe(F.col("_conv")) & (F.col("_i2") == F.col("_i")) & (F.col("edit") != "I")
    j = e.join(d, on, "left")
    system = F.max((F.col("place") == 0) & (F.col("edit") == "K") & F.col("_role").startswith("s"))
    shift = F.coalesce(system.over(Window.partitionBy("_conv2")), F.lit(False)).cast("int")
    made: Column = F.when((F.col("place") - shift) % 2 == 0, "user").otherwise("assistant")
    return j.select(
        F.col("_conv2").alias(conv), "edit", "place", "_at",
        F.when(F.col("edit").isin("K", "D"), F.col("_role")).otherwise(made).alias("role"),
        F.coalesce("_text", F.lit("")).alias("text"),
    ).drop("_at")


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations damaged by the checksum of ``conv:turn`` modulo 20: 0 drops the
    turn (``present`` false), 1 empties its text, 2 removes its ``.``, ``!`` and
    ``?``, 3 repeats it, 4 gives it the role user. Nulls are one space; a null
    ``turn`` stays null in its own column."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    d = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"),
        filled(text).alias("text"), kind.alias("_kind"),
    )
    k = F.col("_kind")
    return d.select(
        "conv_id", "turn",
        F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (k != 0).alias("present"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations, one row per original ``conv_id``."""
    d = repair(damage(conversations), present="present")
    first = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return d.select(*first, "turns")
