"""Conversation repair against all lists of edits, SQL and a plain version."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import conversation_repair as repair  # noqa: E402

SF = "/root/testdata/sf0.001"
FORM = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int"


def exhaustive(rows):
    """(cost, audit, turns) of the best of all lists of edits; rows are (role, text, fault)."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        if sum(inserts) > 3:
            continue
        options = []
        for n, row in zip(inserts, rows):
            options += [[("I", "user"), ("I", "assistant")]] * n
            edits = [("D", None)] if row[2] in ("blank", "duplicate") else [("D", None), ("K", row[0]), ("R", "user"), ("R", "assistant")]
            options.append(edits)
        options += [[("I", "user"), ("I", "assistant")]] * inserts[-1]
        for edits in itertools.product(*options):
            own, cost, turns = iter(rows), 0, []
            for edit, role in edits:
                row = None if edit == "I" else next(own)
                cost += {"K": 0, "R": 1, "D": 2, "I": 5}[edit]
                if edit != "D":
                    turns.append((role, "" if edit == "I" else row[1]))
                    cost += 5 * (edit != "I" and row[2] == "truncated")
            if all(role for role, _ in turns) and FORM.fullmatch("".join(role[0] for role, _ in turns)):
                found = (cost, "".join(e for e, _ in edits), turns)
                best = found if best is None else min(best, found)
    return best


def test_all_lists_of_edits():
    letters = {"s": ("system", "a.", ""), "u": ("user", "b.", ""), "a": ("assistant", "c.", ""), "x": ("tool", "d.", ""), "U": ("user", "e", "truncated"), "A": ("assistant", "f", "truncated"), "S": ("system", "g", "truncated"), "X": ("", "h", "truncated"), "D": ("user", "", "blank")}
    rng = np.random.default_rng(5)
    signatures = ["".join(s) for n in range(4) for s in itertools.product("suaxUD", repeat=n)] + ["".join(rng.choice(list(letters), 4)) for _ in range(20)]
    trie = repair.Trie()
    for signature in sorted(signatures):
        rows = [letters[x] for x in signature]
        cost, audit = trie.answer(signature)
        want = exhaustive(rows)
        assert (cost, audit) == want[:2], signature
        assert [(r, t) for _, r, t in repair.edited(audit, ((r, t) for r, t, _ in rows))] == want[2]


def test_prefixes_are_shared_and_long_conversations_pass():
    trie = repair.Trie()
    long = "su" + "au" * 200_000
    signatures = sorted([long + "a", long + "U", long + "x", long])
    for signature in signatures:
        trie.answer(signature)
    assert trie.layers == len(long) + 3
    assert trie.answer(long + "a") == (0, "K" * (len(long) + 1))


def plain(turns, damage):
    """Facts, signature's answer and digest by a walk in Python over collected rows."""
    convs: dict = {}
    for r in turns:
        rows = convs.setdefault(r.conv_id, [])
        role, text = (" " if v is None else v for v in (r.role, r.text))
        hit = zlib.crc32(":".join(" " if v is None else str(v) for v in (r.conv_id, r.turn)).encode()) % 20 if damage else 9
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        rows += [(r.turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            words = re.findall("[^\x20\x09-\x0d]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        letters = "".join("D" if f in ("blank", "duplicate") else (x.upper() if f else x) for f, x in ((f, r[1][:1] if r[1][:1] in tuple("sua") else "x") for f, r in zip(faults, rows)))
        cost, audit = repair.Trie().answer(letters)
        text = "\n".join(f"{r}:{t}" for _, r, t in repair.edited(audit, ((r, t) for _, r, t in rows)))
        yield (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_query_as_sql_and_as_a_plain_walk(spark):
    got = {tuple(r) for r in repair.query(spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == set(con.execute(repair.SQL).fetchall())
    assert got == set(plain(spark.read.parquet(f"{SF}/conversations.parquet").collect(), True))


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, None, None), (1, None, "user", "late."), (1, 5, "user", "a."), (1, 5, "user", "a."), (1, 5, "assistant", "b"), (1, 5, "", "c."), (1, 9, "user", "a.")]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho!"), (2, 3, "user", " \t\x0b "), (3, None, "user", "x?"), (3, None, "assistant", "y? \n"), (4, 1, "System", "s."), (4, 2, "tool", "\xa0")]
    rows += [(5, i, ("user", "assistant")[i % 2], "z" * (200_000 if i == 7 else 0) + f"turn {i}.") for i in range(3_000)]
    rows += [(6, 0, "user", "same."), (6, 0, "user", "same.")] + [(100 + i, t, r, "Copy.") for i in range(300) for t, r in ((0, "user"), (1, "user"))]
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)


def test_awkward_rows(spark, awkward):
    rows = repair.rows_of(awkward)
    plan = repair.plans(rows)
    got = {tuple(r) for r in repair.mended(rows, plan, digests=True).collect()}
    assert got == set(plain(awkward.collect(), False))
    turns = repair.repaired(awkward.repartition(5)).collect()
    of_five = sorted((r.position, r.edit, r.role, r.text) for r in turns if r.conv_id == 5)
    assert len(of_five) == 3_000 and {e for _, e, _, _ in of_five} == {"K"}
    for conv in {r.conv_id for r in turns}:
        assert FORM.fullmatch("".join(r.role[0] for r in sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.position)))
    damaged = repair.rows_of(repair.damaged(awkward), "gone")
    assert {tuple(r) for r in repair.mended(damaged, repair.plans(damaged), digests=True).collect()} == set(plain(awkward.collect(), True))


def test_every_conversation_is_returned_and_empty_tables_stay_empty(spark, awkward):
    gone = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", "x", 0)], SCHEMA)
    rows = repair.rows_of(repair.damaged(df), "gone")
    assert [tuple(r) for r in repair.mended(rows, repair.plans(rows), digests=True).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(awkward.limit(0)).collect() == []
