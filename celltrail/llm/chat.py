"""Chat formatting: minimum-cost role repair over an automaton of legal turns, then rendering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

ROLES = ["", "system", "user", "assistant"]  # the role of the last turn in states 1 to 3; 0 is the start
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
PUT = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after an empty insertion
MERGE, RELABEL, INSERT, NEVER = 2, 3, 4, 10**9
END = np.array([NEVER, 2 * INSERT, INSERT, 0])


def options(role: str | None) -> dict[tuple[int, int], tuple[int, bool, str]]:
    """(state, next state) -> cost, whether an empty turn is inserted first, and keep, relabel or merge."""
    out: dict[tuple[int, int], tuple[int, bool, str]] = {}

    def offer(s, t, cost, put, action):
        if cost < out.get((s, t), (NEVER,))[0]:
            out[s, t] = cost, put, action

    for s in range(4):
        for put, at in ((False, s), (True, PUT[s])):
            for t in NEXT[at]:
                wrong = ROLES[t] != role
                offer(s, t, INSERT * put + RELABEL * wrong, put, "relabel" if wrong else "keep")
        if s:
            offer(s, s, MERGE + RELABEL * (ROLES[s] != role), False, "merge")
    return out


TABLES = {r: options(r) for r in [*ROLES[1:], None]}
MATRIX = {r: np.array([[d.get((s, t), (NEVER,))[0] for t in range(4)] for s in range(4)], dtype=np.int64) for r, d in TABLES.items()}
UNIT = np.where(np.eye(4, dtype=bool), 0, NEVER)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), NEVER)


def known(role) -> str | None:
    return role if role in TABLES else None


def path(roles: list, start: int, end: np.ndarray) -> tuple[list[int], int]:
    """States after each turn on the cheapest way from `start`, with the cost `end` of each last state."""
    cost, back = np.where(np.arange(4) == start, 0, NEVER), []
    for r in roles:
        through = cost[:, None] + MATRIX[known(r)]
        back.append(through.argmin(axis=0))
        cost = np.minimum(through.min(axis=0), NEVER)
    total = cost + end
    s, states = int(total.argmin()), []
    for b in reversed(back):
        states.append(s)
        s = int(b[s])
    return states[::-1], int(total.min())


def escaped(text: str) -> str:
    """The text with one backslash more between each < and the | behind it, so that it holds no marker; unescaped() takes it off."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}"


def repair(turns: list[tuple[str | None, str]], states: list[int], start: int, last: bool) -> list[tuple[str, str, str]]:
    """role, action and rendered piece of each turn; a conversation's pieces in order are its rendered form."""
    out, s = [], start
    for i, ((role, text), t) in enumerate(zip(turns, states)):
        text = escaped(text)
        _, put, action = TABLES[known(role)][s, t]
        piece = ""
        if action == "merge":
            piece = "\n" + text
        else:
            piece = "<|end|>\n" if s else ""
            if put:
                piece += render(ROLES[PUT[s]], "") + "<|end|>\n"
            piece += render(ROLES[t], text)
        if last and i == len(turns) - 1:
            piece += "<|end|>\n"
            at = t
            while at != 3:
                at = PUT[at]
                piece += render(ROLES[at], "") + "<|end|>\n"
        out.append((ROLES[t], "insert+" * put + action, piece))
        s = t
    return out


def chat_format(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, turn, role, action, rendered: one row per turn.

    Legal: an optional system turn, then user and assistant in turn, the assistant last. Keeping a turn is
    free, merging it into the one before costs 2, relabelling 3 and inserting an empty turn 4. Turns are in
    the order of (turn, role, hash of text), nulls first; null text is empty, a null or unknown role is always relabelled,
    null conv_ids are one conversation, repeated rows are turns of their own, an empty table gives an empty
    result. Markers inside a text are escaped, so a text cannot forge a turn. Rows are dealt by ranges, so a conversation of any length is spread over tasks: each range gives
    the (min, +) product of its first and last conversation's costs, the driver (two small matrices per
    range) fixes the states at the borders, and each range finds the path between these.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "h"]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))

    def runs(batches: Iterator[pd.DataFrame], columns: list[str]):
        """(conversation, its turns in this range) in order."""
        held: list[tuple] = []
        for b in batches:
            ids = [None if pd.isna(x) else int(x) for x in b["conv_id"]]
            for key, got in groupby(zip(ids, *(b[c] for c in columns)), key=lambda r: r[0]):
                got = list(got)
                if held and held[0][0] != key:
                    yield held[0][0], held
                    held = []
                held += got
        if held:
            yield held[0][0], held

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = part = head = key = None
        m = UNIT
        for b in batches:
            for c, p, r in zip(b["conv_id"], b["part"], b["role"]):
                c = None if pd.isna(c) else int(c)
                if part is None:
                    first = key = c
                elif c != key:
                    head = m if head is None else head
                    key, m = c, UNIT
                part = int(p)
                m = times(m, MATRIX[known(r)])
        if part is not None:
            one = head is None
            yield pd.DataFrame(
                [(part, first, (m if one else head).reshape(-1).tolist(), key, m.reshape(-1).tolist(), one)],
                columns=["part", "first", "head", "last", "tail", "one"],
            ).astype({"first": "Int64", "last": "Int64"})

    ends = rows.select("conv_id", "part", "role").mapInPandas(
        fold, "part int, first long, head array<long>, last long, tail array<long>, one boolean"
    ).orderBy("part").collect()  # one row per range
    mat = lambda x: np.array(x, dtype=np.int64).reshape(4, 4)
    enter, leave = {}, {}  # range -> the state that its first conversation is in before, its last after it
    i = 0
    while i < len(ends):
        j, chain = i, [mat(ends[i].tail)]
        while j + 1 < len(ends) and ends[j + 1].first == ends[j].last:
            j += 1
            chain.append(mat(ends[j].head))
            if not ends[j].one:
                break
        if j > i:
            cost, back = np.array([0, NEVER, NEVER, NEVER]), []
            for m in chain:
                through = cost[:, None] + m
                back.append(through.argmin(axis=0))
                cost = np.minimum(through.min(axis=0), NEVER)
            s = int((cost + END).argmin())
            for n in range(len(chain) - 1, 0, -1):
                s = int(back[n][s])
                enter[ends[i + n].part] = leave[ends[i + n - 1].part] = s
        i = max(j, i + 1)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, out, waiting = 0, [], None

        def done(key, held, is_last):
            part = int(held[0][3])
            start = enter.get(part, 0) if seen == 1 else 0
            goes_on = is_last and part in leave
            end = np.where(np.arange(4) == leave[part], 0, NEVER) if goes_on else END
            states, _ = path([r[1] for r in held], start, end)
            got = repair([(r[1], r[2]) for r in held], states, start, not goes_on)
            return [(key, r[4], *g) for r, g in zip(held, got)]

        names = ["conv_id", "turn", "role", "action", "rendered"]
        for key, held in runs(batches, ["role", "text", "part", "turn"]):
            if waiting:
                seen += 1
                out += done(*waiting, False)
            waiting = key, held
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64", "turn": "Int64"})
                out = []
        if waiting:
            seen += 1
            out += done(*waiting, True)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64", "turn": "Int64"})

    return rows.mapInPandas(emit, "conv_id long, turn long, role string, action string, rendered string")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
