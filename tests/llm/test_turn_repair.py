"""Conversation repair against an exhaustive search over edits."""

import collections
import functools
import hashlib
import random
import re
import zlib

import pytest

from kinelattice.llm import queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, pos long, code string, audit string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def first_fault(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def search(initials, faults):
    """The cheapest (cost, edits) over every sequence of edits, with as many new turns as could ever pay."""
    legal = re.compile(r"(s?(ua)+)?")

    def after(out, c):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[out].get(c)

    @functools.lru_cache(None)
    def best(t, out, new):
        found = []
        if t == len(initials):
            if out in ("", "a"):
                found.append((0, ""))
        else:
            found.append((3 + (r := best(t + 1, out, 0))[0], "D" + r[1]))
            if faults[t] not in ("blank", "duplicate"):
                extra = int(faults[t] == "truncated")
                if (go := after(out, initials[t])) is not None:
                    found.append((extra + (r := best(t + 1, go, 0))[0], "K" + r[1]))
                for c in "ua":
                    if (go := after(out, c)) is not None:
                        found.append((2 + extra + (r := best(t + 1, go, 0))[0], "R" + r[1]))
        if new < 4:
            for c in "ua":
                if (go := after(out, c)) is not None:
                    found.append((2 + (r := best(t, go, new + 1))[0], "I" + r[1]))
        return min(found, default=(1 << 40, ""))

    assert legal
    return best(0, "", 0)


def repaired(rows, edits):
    out, k, state = [], 0, ""
    for e in edits:
        role = "assistant" if state == "u" else "user"
        if e == "I":
            out.append((role, ""))
        elif e == "D":
            k += 1
            continue
        else:
            out.append((rows[k][2] if e == "K" else role, rows[k][3]))
            k += 1
        state = out[-1][0][:1]
    assert re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return "\n".join(f"{r}:{t}" for r, t in out)


def brute(rows):
    by = collections.defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, turns = first_fault(own), [r[1] for r in own if r[1] is not None]
        cost, edits = search(tuple(r[2][:1] for r in own), tuple(faults))
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256(repaired(own, edits).encode()).hexdigest())
    return out


def result(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.select(*names).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def run(spark, rows, **size):
    df = spark.createDataFrame([(*r, 7, "c", "x") for r in rows], SCHEMA).repartition(3)
    return result(turn_repair.report(turn_repair.repair(turn_repair.damage(df), **size), df))


def conversations(rng, n, longest=9):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "é.", "Yes. ", "a\x00."]
    rows = []
    for c in range(n):
        size = rng.randint(1, longest)
        rows += [(c, rng.choice([k, k, k, None, 3, k + 2]), rng.choice(roles), rng.choice(texts)) for k in range(size)]
    return rows


def test_random_conversations(spark):
    rows = conversations(random.Random(3), 400)
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Well."), (None, 1, "assistant", "Well."), (None, None, None, None)]
    rows += [(900, 0, "user", "w " * 300000 + "."), (900, 1, "assistant", "Ok.")]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_long_conversations_go_on_in_the_next_chunk(spark, chunk):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = conversations(random.Random(chunk), 30, 12) + [(77, k, random.Random(k).choice(["user", "assistant", "system"]), f"text {k % 50}{'.' if k % 3 else ''}") for k in range(300)]
        assert run(spark, rows, chunk_rows=chunk) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op12_turn_repair(spark, sf)) == brute(rows)


def test_edits_give_the_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "system", "Odd."), (2, 0, "assistant", "Alone."), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for r in turn_repair.repair(df).collect():
        got[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    assert got[2] == [("I", "user", ""), ("K", "assistant", "Alone.")] and got[3] == [("D", None, None)]
    assert [e for e, _, _ in got[1]] == list(search(("u", "u", "s"), (None, None, None))[1])


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.report(turn_repair.repair(turn_repair.damage(df)), df).count() == 0
