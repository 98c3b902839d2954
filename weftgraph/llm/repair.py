"""Repair of conversation structure: the cheapest edits after which roles follow the grammar ``(s?(ua)+)?``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.turns import CRC_TABLE, crc_sql, in_order, stream

#: Costs, and by how much a state may exceed the best one before it can't win: from any state, three inserted or
#: deleted turns more reach what any other can.
REROLE, DELETE, INSERT, TRUNCATED, HOPELESS = 3, 4, 3, 3, 16
#: Grammar states: nothing written, after s, after u, after a. NEXT[state] has the state that each initial leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SPACE = "\\x20\\x09-\\x0D"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: each row's fate by its CRC, as the query's contract says; nulls are one space.

    Rows that are dropped stay with ``gone`` set, so that their conversation is known.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), fate.alias("_fate"))
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_fate") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row of REPORT for each conv_id of ``rows(conv_id, turn, role, text, gone)``; ``gone`` rows only name theirs.

    Rows go by turn (null first), role, text. Turns' first faults are counted: blank, duplicate of a role and text seen
    before, truncated (the last character that is no space is not one of ``.!?``). A forward Viterbi pass holds, for each
    of the four grammar states, the least (cost, audit string) that ends there, and the digest of the conversation so
    repaired; after each turn at most two inserts close the layer. One shuffle by conv_id serves the search for
    duplicates and the pass. SHA-256 takes a conversation in one piece, so it is read by one task, turn by turn: of a
    conversation with a third of all rows four digests and four bytes a turn are held, no text but one.

    Null conv_id is one conversation, other nulls are as ``damage`` leaves them (one space; a null that comes all the
    same is empty), an empty table gives no row, other columns are left aside.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    clean = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), "gone").repartition("conv_id")
    spaces = F.lit(" \t\n\x0b\x0c\r")
    shown = F.rtrim(F.col("text"), spaces)
    same = Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy(F.asc_nulls_first("turn"))
    fault = F.when(shown == "", 0).when(F.row_number().over(same) > 1, 1).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), 2)
    marked = clean.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"))

    def step(turns: Iterator[tuple]) -> Iterator[tuple]:
        conv, state = object(), None
        for conv_id, turn, role, text, gone, fault in turns:
            if conv_id != conv:
                if state:
                    yield state.row()
                conv, state = conv_id, Repair(conv_id)
            if not gone:
                state.add(turn, role, text, fault)
        if state:
            yield state.row()

    # a duplicate has its first copy's role and text, so only the fault tells the two apart: null (no fault) and 2 first
    return stream(marked.sortWithinPartitions("conv_id", "turn", "role", "text", F.col("fault") == 1), REPORT, step)


class _Path:
    """The best way to one state: its cost, its audit string's place among the four, and the digest of what it writes.

    ``rank`` orders the audit strings up to their last letter that is no I; ``inserts`` counts the I that follow. Such
    strings of one layer have equally many letters that are no I, so none begins another, and whatever is appended keeps
    their order. ``came`` and ``letter`` are the step that the layer takes.
    """

    __slots__ = ("cost", "rank", "inserts", "sha", "came", "letter")

    def __init__(self, cost: int, rank: int, inserts: int, sha, came: int, letter: str) -> None:
        self.cost, self.rank, self.inserts, self.sha, self.came, self.letter = cost, rank, inserts, sha, came, letter

    def key(self) -> tuple:
        return self.cost, self.rank, self.inserts


def _written(sha, first: bool, role: str, text: str):
    sha = sha.copy()
    if not first:
        sha.update(b"\n")
    sha.update(role.encode() + b":")
    sha.update(text.encode())
    return sha


class Repair:
    """The forward pass over one conversation's turns."""

    LETTERS = "KRD"

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.states: list[_Path | None] = [_Path(0, 0, 0, hashlib.sha256(), NOTHING, ""), None, None, None]
        self.layers = bytearray()
        self.counts = [0, 0, 0]
        self.illegal = self.distinct = 0
        self.before: str | None = None
        self.least = self.most = None
        self._close()

    def add(self, turn: int | None, role: str, text: str, fault: int | None) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most, self.distinct = turn, self.distinct + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault is not None:
            self.counts[fault] += 1
        self._advance(initial, role, text, fault)
        self._close()

    def _steps(self, came: int, initial: str, fault: int | None) -> Iterator[tuple[int, int, str]]:
        """(state, cost, letter) of each edit of a turn with this initial and fault."""
        extra = TRUNCATED if fault == 2 else 0
        yield came, DELETE, "D"
        if fault in (0, 1):
            return
        if initial in NEXT[came]:
            yield NEXT[came][initial], extra, "K"
        for new in ("u", "a"):
            if new in NEXT[came]:
                yield NEXT[came][new], REROLE + extra, "R"

    def _advance(self, initial: str, role: str, text: str, fault: int | None) -> None:
        best: list[tuple | None] = [None] * 4
        for came, old in enumerate(self.states):
            if old is not None:
                for to, cost, letter in self._steps(came, initial, fault):
                    offer = (old.cost + cost, (old.rank, "I" * old.inserts + letter), came, letter)
                    if best[to] is None or offer[:2] < best[to][:2]:
                        best[to] = offer
        order = sorted({b[1] for b in best if b})
        worst = min(b[0] for b in best if b) + HOPELESS
        after: list[_Path | None] = [None] * 4
        for to, b in enumerate(best):
            if b is not None and b[0] <= worst:
                cost, audit, came, letter = b
                sha = self.states[came].sha
                if letter != "D":
                    sha = _written(sha, came == NOTHING, role if letter == "K" else ROLES[to], text)
                after[to] = _Path(cost, order.index(audit), 0, sha, came, letter)
        self.states = after

    def _close(self) -> None:
        """Inserts after a turn, two at most: u after nothing, s or a, then a after u; a third only leads back. Then the
        layer is closed, and one byte for each state says how it was reached."""
        for to, sources in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for source in sources:
                old, now = self.states[source], self.states[to]
                if old is not None and (now is None or (old.cost + INSERT, old.rank, old.inserts + 1) < now.key()):
                    sha = _written(old.sha, source == NOTHING, ROLES[to], "")
                    self.states[to] = _Path(old.cost + INSERT, old.rank, old.inserts + 1, sha, old.came, old.letter)
        self.layers += bytes(0 if s is None else s.came << 4 | self.LETTERS.find(s.letter) << 2 & 12 | s.inserts for s in self.states)

    def _audit(self, state: int) -> str:
        out = []
        for at in range(len(self.layers) - 4, -1, -4):
            step = self.layers[at + state]
            out.append("I" * (step & 3))
            if at:
                out.append(self.LETTERS[step >> 2 & 3])
            state = step >> 4
        return "".join(reversed(out))

    def row(self) -> tuple:
        last = min((s for s in (NOTHING, ASSISTANT) if self.states[s]), key=lambda s: self.states[s].key())
        path = self.states[last]
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return self.conv_id, gaps, *self.counts, self.illegal, path.cost, self._audit(last), path.sha.hexdigest()


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The query: the table's conversations, damaged as the contract says, and their repair."""
    return repair(damage(conversations))


def _add(path: str, cost: str, letter: str, line: str) -> str:
    """SQL for a path (its cost in eight digits, its audit string, a separator, what it writes) and one more edit."""
    first = f"instr({path}, chr(1)) + 1 > length({path})"
    written = f"CASE WHEN {first} THEN '' ELSE chr(10) END || {line}" if line else "''"
    return f"""(printf('%08d', CAST(left({path}, 8) AS INT) + {cost}) || substr({path}, 9, instr({path}, chr(1)) - 9) || '{letter}' || substr({path}, instr({path}, chr(1))) || {written})"""


def _closed(states: str) -> str:
    """SQL for the four states after the inserts; ``states`` selects n0 to n3 and what is carried."""
    user = f"least(n2, {', '.join(_add(f'n{k}', str(INSERT), 'I', chr(39) + 'user:' + chr(39)) for k in (0, 1, 3))})"
    third = _add("c2", str(INSERT), "I", "'assistant:'")
    return f"SELECT * EXCLUDE (n0, n1, n2, n3, c2), n0 AS c0, n1 AS c1, c2, least(n3, {third}) AS c3 FROM (SELECT *, {user} AS c2 FROM ({states}))"


def _choices(to: int) -> str:
    """SQL for the least of all edits of row r that lead to state ``to`` from states s.c0 to s.c3; null paths are none."""
    kept, new = f"CASE WHEN fault = 2 THEN {TRUNCATED} ELSE 0 END", ROLES.get(to)
    offers = [_add(f"c{to}", str(DELETE), "D", "")]
    for came in range(4):
        for initial in (i for i, at in NEXT[came].items() if at == to):
            offers.append(f"CASE WHEN initial = '{initial}' AND coalesce(fault, 2) = 2 THEN {_add(f'c{came}', kept, 'K', 'role || chr(58) || text')} END")
            if new:
                offers.append(f"CASE WHEN coalesce(fault, 2) = 2 THEN {_add(f'c{came}', f'{REROLE} + {kept}', 'R', f'{chr(39)}{new}:{chr(39)} || text')} END")
    return f"least({', '.join(offers)})"


_START = "'00000000' || chr(1)"
_CRC = crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
#: The same pass as a recursion over turns; paths are whole strings here, so their order is the order of strings.
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
fates AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS fate FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fates WHERE fate <> 0),
shown AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
faulty AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, CASE WHEN ink = '' THEN 0 WHEN nth > 1 THEN 1 WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 2 END AS fault,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS place
  FROM shown),
neighbours AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM faulty),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate,
    count(*) FILTER (fault = 2) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM neighbours GROUP BY conv_id),
convs AS (SELECT DISTINCT conv_id FROM conversations),
passes AS (
  {_closed(f"SELECT conv_id, 0 AS place, {_START} AS n0, CAST(NULL AS VARCHAR) AS n1, CAST(NULL AS VARCHAR) AS n2, CAST(NULL AS VARCHAR) AS n3 FROM convs")}
  UNION ALL
  {_closed(f"SELECT s.conv_id, CAST(r.place AS INT) AS place, {', '.join(f'{_choices(to)} AS n{to}' for to in range(4))} FROM passes AS s JOIN faulty AS r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.place = s.place + 1")}),
best AS (SELECT p.conv_id, least(p.c0, p.c3) AS path FROM passes AS p LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.place = coalesce(c.n, 0))
SELECT b.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, CAST(left(path, 8) AS BIGINT) AS cost, substr(path, 9, instr(path, chr(1)) - 9) AS audit, sha256(substr(path, instr(path, chr(1)) + 1)) AS repaired_sha256
FROM best AS b LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""
