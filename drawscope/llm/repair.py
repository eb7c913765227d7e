"""Conversation structure repair: cheapest edits on a lattice of (turn index, grammar state).

The roles' first letters of a sound conversation are ``(s?(ua)+)?``. Rows are taken by turn; each
one's first fault counts: *blank* (nothing but white space), *duplicate* (role and text seen
earlier) or *truncated* (last character not one of ``.!?``). The edits:

======  ==========================================================  ====
K       keep the row as it is                                       0
R       keep its text, as user or assistant                         2
D       delete the row; blank and duplicate rows must be            3
I       insert a user or assistant turn without text, anywhere      2
======  ==========================================================  ====

A truncated row that is not deleted costs 1 more. Dijkstra's search goes over nodes (rows consumed,
grammar state), made as they are reached, by the key (cost, audit), where the audit holds the edits'
letters so far. The first accepting node popped at the end has the least cost and of its audits the
ASCII-least.

That key can be handed on in pieces, so a long conversation is searched ``RUN`` rows at a time and the
work stays in proportion to it. Cost follows from the audit and the rows alone, so of two paths to one
node neither audit is a proper part of the other's beginning at the same cost, and their order
stays the same whatever follows. Between nodes of one index, audits without trailing ``I`` are equal or
differ within both: their order is kept as a rank, the trailing ``I`` as text. A node that costs over
``BEHIND`` more than another of its index is on no cheapest path: from that other one every
completion is open for at most ``BEHIND`` more (two inserts, or one and a deleted system row).

Defined cases: null roles and texts are one space (that row is blank); ties of a turn are ordered by
role and text, null turns come first; a row with a null conversation id is a conversation of its own
(nothing says which rows belong together); a conversation without rows has an empty audit and no
turns; an empty table gives no conversations; further columns are dropped. A conversation is one
row of the result, so one task holds it, with its texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 256
BEHIND = 5
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Grammar: what each letter leads to. 0: nothing yet, 1: system, 2: user, 3: assistant (0 and 3 accept).
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: The one role that may be put in at a state, and the state after it.
PUT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ACCEPT = {0, 3}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"

FACTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
SCHEMA = f"conv_id bigint, {FACTS}, repaired array<struct<role: string, text: string>>"


def _run(rows: str, entries: dict[int, tuple[int, int, str]], last: bool) -> dict[int, tuple[int, int, str, int]]:
    """The nodes after ``rows``: state -> (cost, rank, audit since the ranks were given, entry state).
    rows: a letter each (s, u, a, other: x), then whether it must go and whether it is truncated."""
    heap = [(cost, rank, audit, 0, state, state) for state, (cost, rank, audit) in entries.items()]
    heapq.heapify(heap)
    end, seen, out = len(rows) // 3, set(), {}
    while heap:
        cost, rank, audit, i, state, entry = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == end:
            if last and state in ACCEPT:
                return {state: (cost, rank, audit, entry)}
            if out and not last and cost > min(x[0] for x in out.values()) + BEHIND:
                return out
            out[state] = (cost, rank, audit, entry)
        push = lambda c, letter, at, to: (at, to) in seen or heapq.heappush(heap, (cost + c, rank, audit + letter, at, to, entry))  # noqa: B023, E731
        push(INSERT, "I", i, PUT[state][1])
        if i < end:
            letter, must_go, truncated = rows[3 * i : 3 * i + 3]
            push(DELETE, "D", i + 1, state)
            if must_go == "0":
                more = TRUNCATED * (truncated == "1")
                push(REROLE + more, "R", i + 1, PUT[state][1])
                if letter in NEXT[state]:
                    push(more, "K", i + 1, NEXT[state][letter])
    return out


def search(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits. rows: three characters each, as in ``_run``."""
    entries: dict[int, tuple[int, int, str]] = {0: (0, 0, "")}
    chain: list[dict[int, tuple[int, str]]] = []  # of each run: state -> (entry state, audit within)
    size = 3 * RUN
    for lo in range(0, max(len(rows), 1), size):
        nodes = _run(rows[lo : lo + size], entries, lo + size >= len(rows))
        chain.append({q: (entry, audit[len(entries[entry][2]) :]) for q, (_, _, audit, entry) in nodes.items()})
        roots = {q: (rank, audit.rstrip("I")) for q, (_, rank, audit, _) in nodes.items()}
        ranks = {root: k for k, root in enumerate(sorted(set(roots.values())))}
        entries = {q: (cost, ranks[roots[q]], audit[len(roots[q][1]) :]) for q, (cost, _, audit, _) in nodes.items()}
    ((state, (cost, _, _)),) = entries.items()
    parts = []
    for run in reversed(chain):
        state, audit = run[state]
        parts.append(audit)
    return cost, "".join(reversed(parts))


_search_short = lru_cache(1 << 16)(search)


def apply(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns after the edits."""
    out, state, rest = [], 0, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rest)
        if edit == "D":
            continue
        if edit in "RI":
            role, state = PUT[state]
        else:
            state = NEXT[state][role[0]]
        out.append((role, text))
    return out


def judged(turns: list[tuple[int | None, str, str]]) -> tuple[dict, list[tuple[str, str]]]:
    """(what ``FACTS`` names, the repaired turns) of one conversation's (turn, role, text), in order."""
    seen: set[tuple[str, str]] = set()
    n = {"blank": 0, "duplicate": 0, "truncated": 0}
    rows = []
    for _, role, text in turns:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        rows.append(f"{letter}{int(fault in ('blank', 'duplicate'))}{int(fault == 'truncated')}")
    numbers = {t for t, _, _ in turns if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in pairwise(turns))
    cost, audit = (_search_short if len(rows) <= 64 else search)("".join(rows))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return {"gaps": gaps, **n, "illegal": illegal, "cost": cost, "audit": audit}, apply([t[1:] for t in turns], audit)


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits and the repaired turns (``SCHEMA``).

    copies: a column that says how often a row stands there (0: its conversation is known, the row is not).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    times = F.col(copies).cast("int") if copies else F.lit(1)
    one = rows.select(F.col(conversation).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), times.alias("times")).alias("t"))
    known = one.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = one.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv_id", pa.int64()), *((c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in FACTS.split(", ")), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(lo, 256).to_pylist():
                    facts, turns = judged([(t["turn"], t["role"], t["text"]) for t in row["turns"] for _ in range(t["times"])])
                    out.append({"conv_id": row["conv_id"], **facts, "repaired": [{"role": r, "text": x} for r, x in turns]})
                yield pa.RecordBatch.from_pylist(out, kinds)

    return known.unionByName(alone).mapInArrow(repaired, SCHEMA)


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` as (conv_id, turn, role, text, copies) with the faults that crc32(``conv_id:turn``) % 20 names: 0 drops
    the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    found = rows.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), (F.crc32(F.concat(space(conversation), F.lit(":"), space(turn))) % 20).alias("fault"))
    return found.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )
