"""Conversation structure repair: the cheapest edits that make roles alternate, with a persistent audit.

A dynamic programme goes over a conversation's rows with four states (nothing yet, after a system turn,
after a user turn, after an assistant turn). Its edit strings are linked nodes that share their prefixes:
a node knows its parent, its length, a rolling hash of the whole string and its ancestors at powers of two.
Of equal costs the string that comes first in ASCII wins: the longest common prefix of two nodes is found by lifting
both to one length and going down the powers of two, where hashes tell whether prefixes are equal; equal
hashes of different nodes are verified letter by letter. At a state, strings of equal cost are never prefixes of one another.

A conversation of up to ``most_rows`` rows and ``most_chars`` characters is repaired in one pass over its sorted rows. A larger one is
cut into blocks of rows in order. Each block gives its cheapest strings from every state to every state;
the same programme then goes over blocks instead of rows, with a block's string as one letter, and the chosen
strings go back to the blocks, which write their repaired text. No task holds such a conversation's rows;
only its audit, and the digest of its repaired text, which is one stream by its definition, are made in one place.

Defined results: null role or text is one space, and so is a null conv_id or turn in the key of the damage; rows
of one turn stand in the order of role and text; rows without conv_id are one conversation; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
BLANKS = " \t\n\x0b\x0c\r"
SOUND, GONE, CUT = range(3)  # a row's fault: none, blank or duplicate, truncated
_MASK = (1 << 61) - 1
# inserted turns that lead from a state to another, and from a state to an end
_INSERTS = {START: ((START, 0), (USER, 1), (ASSISTANT, 2)), SYSTEM: ((SYSTEM, 0), (USER, 1), (ASSISTANT, 2)), USER: ((USER, 0), (ASSISTANT, 1)), ASSISTANT: ((ASSISTANT, 0), (USER, 1))}
_ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the turn that may follow


def _moves(initial: str, fault: int) -> dict[int, list[tuple[str, int, int]]]:
    """For each state the (edits, cost, next state) that end with the given row."""
    kept = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}.get(initial, {})
    out = {}
    for state, ways in _INSERTS.items():
        out[state] = []
        for at, n in ways:
            out[state].append(("I" * n + "D", 2 * n + 3, at))
            if fault != GONE:
                out[state].append(("I" * n + "R", 2 * n + 2 + (fault == CUT), _TURN[at]))
                if at in kept:
                    out[state].append(("I" * n + "K", 2 * n + (fault == CUT), kept[at]))
    return out


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in (SOUND, GONE, CUT)}


class Trail:
    """Strings as linked nodes; node 0 is the empty one. A letter may be a string of its own."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]

    def push(self, node: int, letter: str) -> int:
        up, k = [node], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * 1_000_003 + hash(letter) + 1) & _MASK)
        self.up.append(up)
        return len(self.letter) - 1

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of one length hold the same string."""
        while x != y:
            if self.hash[x] != self.hash[y] or self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]  # equal hashes: verified letter by letter
        return True

    def lifted(self, x: int, depth: int) -> int:
        n, k = self.depth[x] - depth, 0
        while n:
            if n & 1:
                x = self.up[x][k]
            n, k = n >> 1, k + 1
        return x

    def before(self, x: int, y: int) -> bool:
        """Whether the string of ``x`` comes before that of ``y``."""
        least = min(self.depth[x], self.depth[y])
        p, q = self.lifted(x, least), self.lifted(y, least)
        if self.same(p, q):
            return self.depth[x] < self.depth[y]
        for k in range(len(self.up[p]) - 1, -1, -1):
            if k < len(self.up[p]) and not self.same(self.up[p][k], self.up[q][k]):
                p, q = self.up[p][k], self.up[q][k]
        return self.letter[p] < self.letter[q]

    def letters(self, node: int) -> list[str]:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return out[::-1]


class Best:
    """The cheapest and then least string of each state."""

    def __init__(self, trail: Trail, state: int | None = None):
        self.trail, self.cost, self.node, self.edits = trail, {}, {}, {}
        if state is not None:
            self.cost[state], self.node[state], self.edits[state] = 0, 0, ""

    def offer(self, state: int, cost: int, node: int, edits: str) -> None:
        was = self.cost.get(state)
        if was is None or cost < was or cost == was and self._first(node, edits, self.node[state], self.edits[state]):
            self.cost[state], self.node[state], self.edits[state] = cost, node, edits

    def _first(self, node: int, edits: str, other: int, others: str) -> bool:
        return edits < others if node == other else self.trail.before(node, other)

    def settle(self, whole: bool = False) -> Best:
        """The edits offered last become nodes, one a letter or ``whole``."""
        for state, edits in self.edits.items():
            for letter in (edits,) if whole and edits else edits:
                self.node[state] = self.trail.push(self.node[state], letter)
        self.edits = dict.fromkeys(self.edits, "")
        return self


def walked(codes: list[tuple[str, int]], state: int) -> Best:
    """The best strings from ``state`` over rows of (initial, fault)."""
    trail = Trail()
    best = Best(trail, state)
    for code in codes:
        moves, after = MOVES[code], Best(trail)
        for at, cost in best.cost.items():
            for edits, more, to in moves[at]:
                after.offer(to, cost + more, best.node[at], edits)
        best = after.settle()
    return best


def ended(best: Best, whole: bool = False) -> tuple[int, list[str]]:
    """Cost and letters of the best string that may end."""
    last = Best(best.trail)
    for state, cost in best.cost.items():
        last.offer(START, cost + 2 * len(_ENDS[state]), best.node[state], _ENDS[state])
    last.settle(whole)
    return last.cost[START], best.trail.letters(last.node[START])


def initial_of(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def repaired(audit: str, rows: list[tuple[str, str]], state: int = START) -> Iterator[str]:
    """role:text of each turn that the edits leave or make."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]] if edit == "K" else _TURN[state]
        yield f"{role if edit == 'K' else 'assistant' if state == ASSISTANT else 'user'}:{text}"


def legal(one: str, two: str) -> bool:
    return one[:1] + two[:1] in ("su", "ua", "au")


def _ended_well(text: str) -> bool:
    return text.rstrip(BLANKS)[-1:] in (".", "!", "?")


def repair_one(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of sorted (turn, role, text) rows."""
    seen, codes, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        which = 0 if not text.strip(BLANKS) else 1 if (role, text) in seen else 2 if not _ended_well(text) else None
        seen.add((role, text))
        if which is not None:
            counts[which] += 1
        codes.append((initial_of(role), SOUND if which is None else CUT if which == 2 else GONE))
    turns = {t for t, _, _ in rows if t is not None}
    cost, letters = ended(walked(codes, START))
    audit, digest = "".join(letters), hashlib.sha256()
    for i, turn in enumerate(repaired(audit, [r[1:] for r in rows])):
        digest.update((("\n" if i else "") + turn).encode("utf-8", "replace"))
    illegal = sum(not legal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, digest.hexdigest())


SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0 to 2) of each row, with the faults that the row's key tells."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


ORDER = ("conv_id", "turn", "role", "text")  # ascending: nulls first, strings by bytes


def repair(rows: DataFrame, *, most_rows: int = 20_000, most_chars: int = 50_000_000, block: int = 1024) -> DataFrame:
    """conv_id and the columns of SCHEMA, a row per conversation of (conv_id, turn, role, text, copies) rows; copies 0 leaves a row out."""
    sizes = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("copies").alias("_n"), F.sum(F.length("text") * F.col("copies")).alias("_chars"))
    large = materialise(sizes.where((F.col("_n") > most_rows) | (F.col("_chars") > most_chars)).select("_conv"), "conversation-large")
    if large.isEmpty():
        return repaired_whole(rows)
    is_large = F.col("conv_id").eqNullSafe(F.col("_conv"))
    large = F.broadcast(large)  # each stands for most_rows rows or most_chars characters at least
    some = repaired_whole(rows.join(large, is_large, "left_anti"))
    return some.unionByName(repaired_in_blocks(rows.join(large, is_large, "left_semi"), block))


def repaired_whole(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    small = F.when(F.col("copies") > 0, F.col("text")).otherwise("").alias("text")
    by_conversation = rows.select("conv_id", "turn", "role", small, "copies").repartition("conv_id").sortWithinPartitions(*ORDER)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        conv, held, out, started = None, [], [], False

        def made() -> pa.RecordBatch:
            columns = [*zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=["conv_id", *(c.split()[0] for c in SCHEMA.split(", "))])

        for batch in batches:
            schema = schema or [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for one, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if started and one != conv:
                    out.append((conv, *repair_one(held)))
                    held = []
                    if len(out) >= 1000:
                        yield made()
                conv, started = one, True
                held += [(turn, role, text)] * copies
        if started:
            out.append((conv, *repair_one(held)))
            yield made()

    return by_conversation.mapInArrow(stream, f"conv_id {kind}, {SCHEMA}")


def _told(conv, **columns) -> pd.DataFrame:
    """Columns beside the conversation's id."""
    out = pd.DataFrame(columns)
    out.insert(0, "conv_id", pd.Series([None if conv != conv else conv] * len(out), dtype=object))
    return out


def repaired_in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """As ``repaired_whole``, for conversations of any size: blocks of rows, then blocks of their strings."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    many = rows.where("copies > 0").withColumn("_row", F.monotonically_increasing_id()).withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    keys = (*ORDER, "_row", "_copy")
    placed = many.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed.select("conv_id", "turn", "role", "text", "at", F.floor(F.col("at") / block).alias("block")), "conversation-rows")
    first = placed.groupBy("conv_id", F.sha2("role", 256).alias("r"), F.sha2("text", 256).alias("t")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    bare = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+\\z", "")
    which = F.when(F.length(bare) == 0, 0).when(F.col("first").isNull(), 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 2)
    coded = materialise(placed.join(first, "at", "left").select("conv_id", "turn", "at", "block", F.left("role", F.lit(1)).alias("initial"), which.alias("which")), "conversation-codes")

    def transfer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        codes = [(initial_of(i), SOUND if w != w else CUT if w == 2 else GONE) for i, w in zip(pdf["initial"], pdf["which"], strict=True)]
        found = []
        for state in range(4):
            best = walked(codes, state)
            found += [(state, to, cost, "".join(best.trail.letters(best.node[to]))) for to, cost in best.cost.items()]
        illegal = sum(not legal(a, b) for a, b in zip(pdf["initial"], pdf["initial"][1:], strict=False))
        told = {c: [f[i] for f in found] for i, c in enumerate(("state", "next", "cost", "edits"))}
        return _told(key[0], block=key[1], **told, head=pdf["initial"].iloc[0], tail=pdf["initial"].iloc[-1], illegal=illegal)

    steps = coded.groupBy("conv_id", "block").applyInPandas(transfer, f"conv_id {kind}, block long, state int, next int, cost long, edits string, head string, tail string, illegal long")

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        trail, illegal, tail, blocks = Trail(), 0, None, []
        best = Best(trail, START)
        for number, some in pdf.groupby("block", sort=True):
            after = Best(trail)
            for state, to, cost, edits in zip(some["state"], some["next"], some["cost"], some["edits"], strict=True):
                if state in best.cost:
                    after.offer(to, best.cost[state] + cost, best.node[state], edits)
            best = after.settle(whole=True)
            illegal += int(some["illegal"].iloc[0]) + (tail is not None and not legal(tail, some["head"].iloc[0]))
            tail = some["tail"].iloc[0]
            blocks.append(number)
        cost, letters = ended(best, whole=True)
        letters += [""] * (len(blocks) + 1 - len(letters))
        letters[-2:] = [letters[-2] + letters[-1]]  # what is inserted at the end goes with the last block
        state, states = START, []
        for number, letter in zip(blocks, letters, strict=True):
            states.append(state)
            if number != blocks[-1]:
                state = int(pdf["next"][(pdf["block"] == number) & (pdf["state"] == state) & (pdf["edits"] == letter)].iloc[0])
        n = len(blocks) - 1
        return _told(key[0], block=blocks, state=states, edits=letters, illegal=[illegal] + [0] * n, cost=[cost] + [0] * n)

    chosen = materialise(steps.groupBy("conv_id").applyInPandas(compose, f"conv_id {kind}, block long, state int, edits string, illegal long, cost long"), "conversation-chosen")

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        turns = repaired(pdf["edits"].iloc[0], list(zip(pdf["role"], pdf["text"], strict=True)), int(pdf["state"].iloc[0]))
        return _told(key[0], block=[key[1]], part=["".join(f"\n{t}" for t in turns).encode("utf-8", "replace")])

    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    told = placed.join(chosen.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "state", "edits"), same)
    parts = told.select("conv_id", "block", "at", "role", "text", "state", "edits").groupBy("conv_id", "block").applyInPandas(write, f"conv_id {kind}, block long, part binary")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, empty = None, None, True
        for batch in batches:
            for one, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sha is None or one != conv:
                    if sha is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field(0).type), pa.array([sha.hexdigest()])], names=["conv_id", "sha"])
                    conv, sha, empty = one, hashlib.sha256(), True
                if part:
                    sha.update(part[1:] if empty else part)
                    empty = False
            kind_ = batch.schema.field(0).type
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind_), pa.array([sha.hexdigest()])], names=["conv_id", "sha"])

    shas = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(digest, f"conv_id {kind}, sha string")
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda b: b["edits"]), "").alias("audit"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    faults = coded.groupBy("conv_id").agg(*[F.count_if(F.col("which") == i).alias(c) for i, c in enumerate(("blank", "duplicate", "truncated"))])
    turns = coded.where("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = audits
    for more in (shas, faults, turns):
        more = more.withColumnRenamed("conv_id", "_conv")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def query(conversations: DataFrame, **options) -> DataFrame:
    return repair(damaged(conversations), **options)


ORACLE = """WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT keyed.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) % 20 AS kind FROM keyed, tab),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy, rid FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS bare FROM rows),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
ways AS (SELECT * FROM (VALUES ('', '', '', 0), ('', 'u', 'I', 2), ('', 'a', 'II', 4), ('s', 's', '', 0), ('s', 'u', 'I', 2), ('s', 'a', 'II', 4), ('u', 'u', '', 0), ('u', 'a', 'I', 2), ('a', 'a', '', 0), ('a', 'u', 'I', 2)) w(was, mid, ins, paid)),
best AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit FROM faulty UNION ALL
 SELECT conv_id, i, state, cost, audit FROM (SELECT f.conv_id, f.i, CASE e.edit WHEN 'D' THEN w.mid WHEN 'R' THEN CASE WHEN w.mid = 'u' THEN 'a' ELSE 'u' END ELSE f.initial END AS state,
 b.cost + w.paid + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS cost, b.audit || w.ins || e.edit AS audit
 FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN ways w ON w.was = b.state JOIN (VALUES ('D'), ('K'), ('R')) e(edit)
 ON e.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR (f.initial = 's' AND w.mid = '') OR (f.initial = 'u' AND w.mid <> 'u') OR (f.initial = 'a' AND w.mid = 'u'))))
 QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
ended AS (SELECT * FROM (SELECT b.conv_id, b.cost + CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost, b.audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit FROM best b JOIN (SELECT conv_id, max(i) AS n FROM faulty GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.n = b.i) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
letters AS (SELECT conv_id, p, audit[p] AS edit, length(replace(audit[1 : p], 'I', '')) AS i FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM ended)),
turns AS (SELECT l.*, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) - 1 AS t, first_value(edit = 'K' AND f.initial = 's') OVER (PARTITION BY l.conv_id ORDER BY p) AS led FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE edit <> 'D'),
said AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (t - CAST(led AS INTEGER)) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said FROM turns GROUP BY 1),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN fault = 'blank' THEN 1 END) AS blank, count(CASE WHEN fault = 'duplicate' THEN 1 END) AS duplicate, count(CASE WHEN fault = 'truncated' THEN 1 END) AS truncated, count(CASE WHEN i > 1 AND before || initial NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal FROM faulty GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM c.conv_id"""
