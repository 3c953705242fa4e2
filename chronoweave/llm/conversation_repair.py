"""Repair of damaged conversations by depth-first branch-and-bound over edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.staging import Staging

#: A conversation with more rows or characters is repaired chunk by chunk.
LONG_ROWS = 4096
LONG_CHARS = 1 << 24
CHUNK_ROWS = 2048

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: What the roles kept so far end in: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Where a row of that initial leads from each state.
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The role that a state asks for next, and the state it leads to.
_WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_LEGAL = ("su", "ua", "au")

#: A row as the search sees it: (initial of its role, whether it must be deleted, whether it is truncated).
Code = tuple[str, bool, bool]


class Bounds:
    """Lower bounds of what the rows from a place on must cost.

    Rows that must go cost a deletion, truncated rows 1 more than nothing. Of the other rows, and of what stands
    before them and must stand at the end, take disjoint neighbours that no legal conversation has side by side: each
    such pair needs an edit of a row or an insertion between, of 2 at least beyond that 1.
    """

    def __init__(self, rows: list[Code], ends: int):
        n = len(rows)
        self.ends, self.forced, self.next = ends, [0] * (n + 1), [n] * (n + 1)
        self.initial = [x[0] for x in rows]
        self.pairs = [0] * (n + 2)  # from a row that can stay on
        after = n
        for k in range(n - 1, -1, -1):
            initial, must_go, truncated = rows[k]
            self.forced[k] = self.forced[k + 1] + (COSTS[DELETE] if must_go else TRUNCATED_COST * truncated)
            if must_go:
                self.pairs[k] = self.pairs[k + 1]
            else:
                bad = initial + self.initial[after] not in _LEGAL if after < n else not self._may_end(initial)
                beyond = self.pairs[self.next[after + 1] if after < n else n + 1]
                self.pairs[k] = max(self.pairs[after], bad + beyond)
                after = k
            self.next[k] = after

    def _may_end(self, initial: str) -> bool:
        return any(to == self.ends for to in _AFTER.get(initial, {}).values())

    def of(self, place: int, state: int) -> int:
        first = self.next[place]
        if first < len(self.initial):
            bad, beyond = state not in _AFTER.get(self.initial[first], {}), self.pairs[self.next[first + 1]]
        else:
            bad, beyond = state != self.ends and not (self.ends == ASSISTANT and state == START), 0
        return self.forced[place] + COSTS[INSERT] * max(self.pairs[first], bad + beyond)


def _steps(rows: list[Code], place: int, state: int, last: bool) -> Iterator[tuple[str, int, int, int]]:
    """(edit, next place, next state, cost) in the order of the edits' letters."""
    inside = place < len(rows)
    if inside:
        yield DELETE, place + 1, state, COSTS[DELETE]
    if inside or last:
        yield INSERT, place, _WANTED[state][1], COSTS[INSERT]
    if inside and not rows[place][1]:
        initial, _, truncated = rows[place]
        to = _AFTER.get(initial, {}).get(state)
        if to is not None:
            yield KEEP, place + 1, to, TRUNCATED_COST * truncated
        if to is None or initial == "s":
            yield REROLE, place + 1, _WANTED[state][1], COSTS[REROLE] + TRUNCATED_COST * truncated


def _word(node: tuple | None) -> str:
    """The edits on the way to a node of the search."""
    out = []
    while node is not None:
        node, edit = node
        out.append(edit)
    return "".join(reversed(out))


def search(rows: list[Code], entry: int = START, ends: int = ASSISTANT, last: bool = True) -> tuple[int, str] | None:
    """The cheapest edits of ``rows``, and of those the least by letters: (cost, audit), or None if there are none.

    The search starts in state ``entry`` and has to end in ``ends`` (with ASSISTANT and ``last`` an empty
    conversation ends well too); only the ``last`` rows of a conversation may be followed by insertions.

    A dive along the least bound gives the first incumbent. Then an explicit stack is searched depth first,
    letters in order. A prefix goes if its cost and bound exceed the incumbent, or are equal to one that was
    found in this order; or if an earlier prefix, less by letters, came to its place and state at no
    higher cost. So each place and state is entered once for each cost between the bound and the first incumbent at most.
    """
    n, bounds = len(rows), Bounds(rows, ends)

    def good(state: int) -> bool:
        return state == ends or (last and ends == ASSISTANT and state == START)

    def open_(state: int) -> bool:
        return ends >= USER or state <= ends

    def run(ordered: bool, incumbent: tuple[int, str] | None) -> tuple[int, str] | None:
        seen: dict[tuple[int, int], int] = {}
        stack, found = [(0, entry, 0, None)], False
        while stack:
            place, state, cost, node = stack.pop()
            if incumbent is not None:
                least = cost + bounds.of(place, state)
                if least > incumbent[0] or (found and least == incumbent[0]):
                    continue
            if seen.get((place, state), cost + 1) <= cost:
                continue
            seen[place, state] = cost
            if place == n and good(state):
                reached = cost, _word(node)
                if incumbent is None or reached < incumbent:
                    incumbent = reached
                if not ordered:
                    return incumbent
                found = True
            steps = [(e, p, s, cost + c, (node, e)) for e, p, s, c in _steps(rows, place, state, last) if open_(s)]
            if ordered:
                steps.reverse()
            else:
                steps.sort(key=lambda x: (x[3] + bounds.of(x[1], x[2]), x[0]), reverse=True)
            stack += [(p, s, c, w) for _, p, s, c, w in steps]
        return incumbent

    return run(True, run(False, None)) if open_(entry) else None


def edited(audit: str, entry: int, initials: Iterable[str]) -> Iterator[tuple[str, str | None, int]]:
    """(edit, new role or None, state after it) for each letter of ``audit``."""
    state, rows = entry, iter(initials)
    for edit in audit:
        role = None
        initial = next(rows) if edit != INSERT else ""
        if edit in (INSERT, REROLE):
            role, state = _WANTED[state]
        elif edit == KEEP:
            state = _AFTER[initial][state]
        yield edit, role, state


_BLANK = " \t\n\x0b\x0c\r"


def code(role: str, text: str, repeated: bool) -> tuple[Code, str]:
    """A row as the search sees it, and its first fault."""
    left = text.rstrip(_BLANK)
    fault = "blank" if not left else "duplicate" if repeated else "truncated" if left[-1] not in ".!?" else ""
    return (role[:1], fault in ("blank", "duplicate"), fault == "truncated"), fault


_FAULTS = ("blank", "duplicate", "truncated")
_NUMBERS = ("gaps", *_FAULTS, "illegal", "cost")


def repaired(turns: list[int | None], roles: list[str], texts: list[str]) -> dict[str, int | str]:
    """The faults and the repair of one conversation, whose rows are in order."""
    seen, codes, faults = set(), [], dict.fromkeys(_FAULTS, 0)
    for role, text in zip(roles, texts, strict=True):
        own, fault = code(role, text, (role, text) in seen)
        seen.add((role, text))
        codes.append(own)
        if fault:
            faults[fault] += 1
    known = [t for t in turns if t is not None]
    cost, audit = search(codes)
    lines, row = [], 0
    for edit, role, _ in edited(audit, START, (x[0] for x in codes)):
        if edit == INSERT:
            lines.append(f"{role}:")
            continue
        if edit != DELETE:
            lines.append(f"{role or roles[row]}:{texts[row]}")
        row += 1
    return faults | {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "illegal": sum(x[0] + y[0] not in _LEGAL for x, y in zip(codes, codes[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired": "\n".join(lines), "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damage(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` damaged by a hash of id and turn; (conv_id, turn, role, text, gone).

    Nulls stand for one space. Of 20 equal parts one is dropped (gone), one has no text, one no ``.!?``, one
    comes twice, and one says user.
    """
    blank = F.lit(" ")
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    told = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), part.alias("part"))
    text = F.when(F.col("part") <= 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("part") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    out = told.select("conv_id", "turn", F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("part") == 0).alias("gone"), times.alias("time"))
    return out.drop("time")


_RESULT = ", ".join(f"{c} long" for c in _NUMBERS) + ", audit string, repaired_sha256 string"
_ORDER = ["turn", "role", "text"]


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repair of each conversation of rows sorted by conversation and place."""
    ids, held, kind = [], [], None
    done: list[dict] = []

    def settle() -> None:
        there = [x for x in held if not x[3]]
        done.append(repaired(*([x[k] for x in there] for k in range(3))))

    def out() -> pa.RecordBatch:
        columns = [pa.array(ids[: len(done)], kind), *(pa.array([x[c] for x in done], pa.int64()) for c in _NUMBERS)]
        columns += [pa.array([x[c] for x in done], pa.string()) for c in ("audit", "repaired_sha256")]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_NUMBERS, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv_id, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", *_ORDER, "gone")), strict=True):
            if not ids or conv_id != ids[-1]:
                if held:
                    settle()
                ids.append(conv_id)
                held = []
            held.append(row)
        if len(done) > 1000:
            yield out()
            ids, done = ids[len(done) :], []
    if held:
        settle()
    if done:
        yield out()


def repair(rows: DataFrame) -> DataFrame:
    """The faults and the cheapest repair of each conversation of ``rows(conv_id, turn, role, text, gone)``.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Rows come by turn
    (nulls first), then role and text. Rows that are gone don't count, but each conv_id gives a row, null too; one
    without other rows has zeros, an empty audit and the digest of the empty text. role and text are not null.
    An empty table gives no row.

    Conversations of up to LONG_ROWS rows and LONG_CHARS characters are searched where their sorted rows lie. A longer one
    is cut into chunks of CHUNK_ROWS, which are searched for each pair of states at their ends; the costs of its
    chunks are then joined, and only its digest, which is of all its text in order, passes through one task as a stream.
    """
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = counts.where((F.col("n") > LONG_ROWS) | (F.col("chars") > LONG_CHARS)).select(F.col("conv_id").alias("long_id"))
    some = not long.isEmpty()
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(long, same, "left_anti") if some else rows
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    done = short.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_short, f"{kind}, {_RESULT}")
    return done.unionByName(_repair_long(rows.join(long, same, "left_semi"), kind)) if some else done


def _repair_long(rows: DataFrame, kind: str) -> DataFrame:
    """As ``repair``, for conversations of any length."""
    staging = Staging(rows.sparkSession, "repair")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    there = rows.where(~F.col("gone")).repartitionByRange(*order).sortWithinPartitions(*order)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    ordered = staging.write(there.select("conv_id", "turn", "role", "text", digest.alias("digest"), F.monotonically_increasing_id().alias("place")), "ordered")
    # Places within a conversation: those within a partition, and the rows of the partitions before.
    parts = ordered.groupBy("conv_id", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")
    begins = parts.select(F.col("conv_id").alias("p_id"), "part", "begin", before.alias("before"))
    firsts = ordered.groupBy("conv_id", "digest").agg(F.min("place").alias("first"))
    white = "\\x20\\x09-\\x0D"
    blank, whole = ~F.col("text").rlike(f"[^{white}]"), F.col("text").rlike(f"[.!?][{white}]*\\z")
    fault = F.when(blank, "blank").when(F.col("first").isNull(), "duplicate").when(~whole, "truncated").otherwise("")
    coded = ordered.join(begins, ordered["conv_id"].eqNullSafe(F.col("p_id")) & (F.shiftright("place", 33) == F.col("part"))).join(
        firsts.select("first"), F.col("place") == F.col("first"), "left"
    )
    at = F.col("place") - F.col("begin") + F.col("before")
    coded = staging.write(
        coded.select("conv_id", "place", at.alias("at"), F.floor(at / CHUNK_ROWS).alias("chunk"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "coded"
    )
    sizes = coded.groupBy("conv_id").agg(F.max("chunk").alias("last"), *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in _FAULTS])
    told = coded.join(sizes.select(F.col("conv_id").alias("s_id"), "last"), F.col("conv_id").eqNullSafe(F.col("s_id")))

    def solve(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("at")
        codes = [(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(chunk["initial"], chunk["fault"], strict=True)]
        is_last = bool(chunk["chunk"].iloc[0] == chunk["last"].iloc[0])
        out = []
        for entry in STATES:
            own = [(ends, search(codes, entry, ends, is_last)) for ends in ((ASSISTANT,) if is_last else STATES)]
            own = sorted(((x[1], x[0], ends) for ends, x in own if x is not None))
            out += [(entry, ends, cost, audit, rank) for rank, (audit, cost, ends) in enumerate(own)]
        found = pd.DataFrame(out, columns=["entry", "ends", "cost", "audit", "rank"])
        initials = [x[0] for x in codes]
        found["illegal"] = sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:], strict=False))
        found["first"], found["final"], found["initials"] = initials[0], initials[-1], "".join(x or " " for x in initials)
        found["conv_id"], found["chunk"] = chunk["conv_id"].iloc[0], chunk["chunk"].iloc[0]
        return found

    fields = f"{kind}, chunk long, entry int, ends int, cost long, audit string, rank int, illegal long, first string, final string, initials string"
    solved = staging.write(told.groupBy("conv_id", "chunk").applyInPandas(solve, fields), "solved")

    def choose(costs: pd.DataFrame) -> pd.DataFrame:
        """The states at the chunks' ends: the least cost from the end backwards, then the least letters forwards."""
        chunks = [x for _, x in costs.sort_values("chunk").groupby("chunk")]
        ahead = {s: 0 for s in STATES}
        options = []
        for x in reversed(chunks):
            tables = list(zip(x["entry"], x["ends"], x["cost"], x["rank"], strict=True))
            options.append((tables, ahead))
            ahead = {s: min((c + ahead[t] for e, t, c, _ in tables if e == s and t in ahead), default=None) for s in STATES}
            ahead = {s: c for s, c in ahead.items() if c is not None}
        state, out = START, []
        for x, (tables, ahead) in zip(chunks, reversed(options), strict=True):
            _, _, ends = min((c + ahead[t], r, t) for e, t, c, r in tables if e == state and t in ahead)
            out.append((x["chunk"].iloc[0], state, ends))
            state = ends
        found = pd.DataFrame(out, columns=["chunk", "entry", "ends"])
        joints = [x["final"].iloc[0] + y["first"].iloc[0] for x, y in zip(chunks, chunks[1:], strict=False)]
        found["joint"] = [*(int(x not in _LEGAL) for x in joints), 0]
        found["conv_id"] = costs["conv_id"].iloc[0]
        return found

    small = solved.select("conv_id", "chunk", "entry", "ends", "cost", "rank", "first", "final")
    chosen = small.groupBy("conv_id").applyInPandas(choose, f"{kind}, chunk long, entry int, ends int, joint long")
    key = ["chunk", "entry", "ends"]
    met = solved.join(
        chosen.select(F.col("conv_id").alias("c_id"), *[F.col(c).alias(f"c_{c}") for c in key], "joint"),
        F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("chunk") == F.col("c_chunk")) & (F.col("entry") == F.col("c_entry")) & (F.col("ends") == F.col("c_ends")),
    )
    audits = staging.write(met.select("conv_id", "chunk", "entry", "cost", "audit", "illegal", "joint", "initials"), "audits")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each row what is inserted before it, its edit and new role; the insertions at the end go with the row after the last."""
        for batch in batches:
            for x in batch.itertuples():
                out, inserted, row = [], [], x.chunk * CHUNK_ROWS
                for edit, role, _ in edited(x.audit, x.entry, ("" if c == " " else c for c in x.initials)):
                    if edit == INSERT:
                        inserted.append(role)
                        continue
                    out.append((row, inserted, edit, role))
                    inserted, row = [], row + 1
                if inserted:
                    out.append((row, inserted, DELETE, None))
                found = pd.DataFrame(out, columns=["at", "inserted", "edit", "new_role"])
                found["conv_id"] = pd.Series([x.conv_id] * len(found), dtype=batch["conv_id"].dtype)
                yield found[["conv_id", "at", "inserted", "edit", "new_role"]]

    edits = audits.select("conv_id", "chunk", "entry", "audit", "initials").mapInPandas(lines, f"{kind}, at long, inserted array<string>, edit string, new_role string")
    texts = coded.select("conv_id", "at", "place").join(ordered.select("place", "role", "text"), "place").withColumnRenamed("conv_id", "t_id").withColumnRenamed("at", "t_at")
    written = edits.join(texts, F.col("conv_id").eqNullSafe(F.col("t_id")) & (F.col("at") == F.col("t_at")), "left").select("conv_id", "at", "inserted", "edit", "new_role", "role", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, empty, begun, field = None, hashlib.sha256(), True, False, None

        def put(line: str) -> None:
            nonlocal empty
            sha.update(("" if empty else "\n").encode() + line.encode())
            empty = False

        for batch in batches:
            field = batch.schema.field("conv_id").type
            ids, digests = [], []
            for conv_id, inserted, edit, new_role, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "inserted", "edit", "new_role", "role", "text")), strict=True):
                if begun and conv_id != current:
                    ids.append(current)
                    digests.append(sha.hexdigest())
                    sha, empty = hashlib.sha256(), True
                current, begun = conv_id, True
                for other in inserted:
                    put(f"{other}:")
                if edit != DELETE:
                    put(f"{new_role or role}:{text}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, field), pa.array(digests, pa.string())], names=["h_id", "repaired_sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([current], field), pa.array([sha.hexdigest()])], names=["h_id", "repaired_sha256"])

    digests = written.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(hashed, f"{kind.replace('conv_id', 'h_id')}, repaired_sha256 string")
    ids = rows.select("conv_id").distinct()
    turns = ordered.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    parts = F.sort_array(F.collect_list(F.struct("chunk", "audit")))
    totals = audits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum(F.col("illegal") + F.col("joint")).alias("illegal"), F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    out = ids
    for k, other in enumerate((turns, sizes.drop("last"), totals, digests.withColumnRenamed("h_id", "conv_id"))):
        out = out.join(other.withColumnRenamed("conv_id", f"o{k}"), F.col("conv_id").eqNullSafe(F.col(f"o{k}")), "left").drop(f"o{k}")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _NUMBERS]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
