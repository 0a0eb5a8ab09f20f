"""Conversation structure repair: the cheapest edits that give a conversation its form.

A conversation is well formed when the initials of its roles are ``(s?(ua)+)?``: perhaps a system
turn, then user and assistant in turns. Each of its rows is kept (cost 0), given the role user or
assistant (1) or deleted (2, the only choice for blank and repeated rows); a turn without text may
be inserted anywhere (5); a truncated row that isn't deleted costs 5 more. Of equally cheap lists
of edits the one whose initials (K, R, D, I) come first in ASCII is taken.

1. ``signed`` walks each conversation's rows in order and writes one letter a row: its role and
   what is wrong with it. This signature is all that the choice of edits depends on.
2. ``planned`` takes the distinct signatures, sorted. Their common prefixes form a trie, which the
   walk visits in order: the layers of the dynamic program (for each state of the form the
   cheapest edits that lead there) lie on a stack by depth, so that each is computed once for all
   signatures that share the prefix, and the answer is read off at a signature's last letter.
3. ``mended`` walks the rows again, beside their conversation's edits, and gives the repaired
   turns or a digest of each conversation.

Both walks stream: a conversation's rows are sorted by Spark, and a task holds the signature of one
conversation (a byte a row) and the digests of its distinct rows, never its texts. A digest over a
conversation needs its rows in order, so a conversation is the smallest unit of work. Frequent
signatures are joined to their edits by broadcast (at most ``HEAVY`` of at most ``SHORT`` letters),
so that copies of one conversation stay where they are.

Defined cases: null role and text count as one space; rows without a conv_id form one
conversation; rows without a turn come first; rows that share a turn follow each other by role and
then by a digest of role and text; a role that is empty or has another initial is none of the
form's; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, split_join, stored, table

#: White space of the contract, the ends of a sentence, and the lawful neighbours.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LAWFUL = {"su", "ua", "au"}
ROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Letters of signatures whose edits may be broadcast.
SHORT = 1_000

#: States of the form: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {("s", START): SYSTEM, **{("u", q): USER for q in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}
_NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Inserted turns that lead from a state to the end of a form.
_CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: A state's (cost, place of its edits in the layer's order), or None where it can't be reached.
Shape = tuple[tuple[int, int] | None, ...]
#: For each state that is reached: the state before and the edits from there.
Back = tuple[tuple[int, str] | None, ...]


def choices(letter: str) -> list[tuple[int, int, str, int]]:
    """(state before, state after, edits, cost) of a row. Two inserted turns lead back to where
    they began, but for the start and the system turn; more than two are never cheapest."""
    out = []
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    for before in range(4):
        at = before
        for n in range(3):
            edits, cost = "I" * n, INSERT * n
            out.append((before, at, edits + "D", cost + DELETE))
            if letter != "D":
                if (role, at) in _AFTER:
                    out.append((before, _AFTER[role, at], edits + "K", cost + extra))
                out.append((before, _AFTER[_NEXT[at], at], edits + "R", cost + ROLE + extra))
            at = _AFTER[_NEXT[at], at]
    return out


class Trie:
    """Edits of sorted signatures; ``layers`` says how many layers were made.

    A layer's edits all end with a row's edit and hold as many of these, so none begins another,
    and the order of two lists of edits stays when the same is added to both. Layers that differ by
    a constant cost alone have the same successors, which are remembered.
    """

    def __init__(self):
        self.letters, self.layers = "", 0
        start: Shape = ((0, 0), None, None, None)
        self.path: list[tuple[int, Shape, Back]] = [(0, start, (None,) * 4)]
        self.known: dict[tuple[Shape, str], tuple[int, Shape, Back]] = {}
        self.choices = {letter: choices(letter) for letter in "DsuaxSUAX"}

    def _after(self, shape: Shape, letter: str) -> tuple[int, Shape, Back]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for before, after, edits, cost in self.choices[letter]:
            if shape[before]:
                found = (shape[before][0] + cost, shape[before][1], edits, before)
                best[after] = min(best.get(after, found), found)
        least = min(f[0] for f in best.values())
        order = {q: k for k, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}
        return least, tuple((best[q][0] - least, order[q]) if q in best else None for q in range(4)), tuple((best[q][3], best[q][2]) if q in best else None for q in range(4))

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and edits; fast where a signature shares a prefix with the one before it."""
        shared = next((i for i, (x, y) in enumerate(zip(self.letters, signature)) if x != y), min(len(self.letters), len(signature)))
        del self.path[shared + 1 :]
        self.letters = signature
        total, shape, _ = self.path[-1]
        for letter in signature[shared:]:
            if (shape, letter) not in self.known:
                self.known[shape, letter] = self._after(shape, letter)
            more, shape, back = self.known[shape, letter]
            total += more
            self.path.append((total, shape, back))
            self.layers += 1
        cost, _, at = min((shape[q][0] + INSERT * len(_CLOSING[q]), shape[q][1], q) for q in range(4) if shape[q])
        edits = [_CLOSING[at]]
        for _, _, back in reversed(self.path[1:]):
            at, some = back[at]
            edits.append(some)
        return total + cost, "".join(reversed(edits))


def rows_of(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """The columns that the walks read; ``gone`` names a column that marks rows which only say that
    their conversation exists."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    out = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    return out.withColumn("key", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and signature of each conversation."""
    seen = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv_id", "turn", "role", "key", "gone", (seen == "").alias("blank"), (~F.substring(seen, -1, 1).isin(*ENDS)).alias("cut"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key")
    kind = dict(rows.dtypes)["conv_id"]
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal")

    def facts(batches):
        ids, found = [], {n: [] for n in (*numbers, "signature")}
        conv, begun = None, False

        def begin():
            return {"turns": 0, "first": None, "last": None, "before": None, "seen": set(), "letters": bytearray(), **dict.fromkeys(numbers[1:], 0)}

        def end(c, s):
            ids.append(c)
            found["gaps"].append(s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0)
            found["signature"].append(s["letters"].decode())
            for n in numbers[1:]:
                found[n].append(s[n])

        def handed_on():
            out = pa.RecordBatch.from_arrays([pa.array(ids, types[0]), *(pa.array(found[n], pa.int64()) for n in numbers), pa.array(found["signature"], pa.string())], ["conv_id", *numbers, "signature"])
            ids.clear()
            for x in found.values():
                x.clear()
            return out

        types, s = [pa.int64()], begin()
        for batch in batches:
            types[0] = batch.schema.field("conv_id").type
            for c, turn, role, key, gone, blank, cut in zip(*(x.to_pylist() for x in batch.columns)):
                if not begun or c != conv:
                    if begun:
                        end(conv, s)
                    conv, begun, s = c, True, begin()
                if gone:
                    continue
                initial = role[:1]
                if turn is not None and (not s["turns"] or turn != s["last"]):
                    s["first"] = turn if s["first"] is None else s["first"]
                    s["last"] = turn
                    s["turns"] += 1
                s["illegal"] += s["before"] is not None and s["before"] + initial not in LAWFUL
                s["before"] = initial
                fault = "blank" if blank else "duplicate" if key in s["seen"] else "truncated" if cut else None
                s["seen"].add(key)
                if fault:
                    s[fault] += 1
                letter = initial if initial and initial in "sua" else "x"
                s["letters"] += (letter.upper() if fault == "truncated" else "D" if fault else letter).encode()
            if len(ids) > 10_000:
                yield handed_on()
        if begun:
            end(conv, s)
            yield handed_on()

    return dealt.mapInArrow(lean(facts), ", ".join([f"conv_id {kind}", *(f"{n} long" for n in numbers), "signature string"]))


def planned(signatures: DataFrame) -> DataFrame:
    """Adds cost and audit, the initials of the edits, to distinct signatures (and keeps ``n``)."""

    def walk(batches):
        trie = Trie()
        for batch in batches:
            letters = batch.column(0).to_pylist()
            costs, audits = zip(*map(trie.answer, letters)) if letters else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "n", "cost", "audit"])

    dealt = signatures.select("signature", "n").repartitionByRange("signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(lean(walk), "signature string, n long, cost long, audit string")


def plans(rows: DataFrame) -> DataFrame:
    """The facts of each conversation with its cost and audit, stored."""
    facts, _ = stored(signed(rows), "conversation-facts")
    answers, _ = stored(planned(facts.groupBy("signature").agg(F.count("*").alias("n"))), "conversation-edits")
    short = answers.withColumn("n", F.when(F.length("signature") <= SHORT, F.col("n")).otherwise(0))
    return stored(split_join(facts, short, "signature", facts.count()).drop("n", "signature"), "conversation-plans")[0]


def edited(audit: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns; ``turns`` gives (role, text) of the rows in order."""
    state, rows = START, iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            initial = role[0]
        else:
            initial = _NEXT[state]
            role = "user" if initial == "u" else "assistant"
        state = _AFTER[initial, state]
        yield edit, role, text


def _conversations(batches, columns: list[str]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Each conversation's plan row with an iterator over its rows, which is used up in between."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns))

    for _, group in groupby(rows(), key=lambda r: r[0]):
        plan = dict(zip(columns, next(group)))
        yield plan, ((r[columns.index("role")], r[columns.index("text")]) for r in group)


def mended(rows: DataFrame, plan: DataFrame, digests: bool = False) -> DataFrame:
    """The repaired turns (conv_id, position, edit, role, text), or with ``digests`` the plan's
    columns and the SHA-256 of each repaired conversation, its ``role:text`` joined by line feeds."""
    kind = dict(rows.dtypes)["conv_id"]
    facts = plan.columns
    here = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("place"), "turn", "role", "key", "text")
    both = plan.withColumn("place", F.lit(0)).unionByName(here, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "place", "turn", "role", "key").select(*facts, "role", "text")
    columns = dealt.columns

    def turns(batches):
        held = []
        for plan_row, own in _conversations(batches, columns):
            for at, (edit, role, text) in enumerate(edited(plan_row["audit"], own)):
                held.append((plan_row["conv_id"], at, edit, role, text))
                if len(held) >= 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], ["conv_id", "position", "edit", "role", "text"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], ["conv_id", "position", "edit", "role", "text"])

    def hashes(batches):
        held = []
        for plan_row, own in _conversations(batches, columns):
            digest, mark = hashlib.sha256(), b""
            for _, role, text in edited(plan_row["audit"], own):
                digest.update(mark + f"{role}:{text}".encode())
                mark = b"\n"
            held.append((*(plan_row[c] for c in facts), digest.hexdigest()))
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), fact_kinds)], [*facts, "repaired_sha256"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), fact_kinds)], [*facts, "repaired_sha256"])

    id_kind = pa.string() if kind == "string" else pa.int64()
    kinds = [id_kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    fact_kinds = [id_kind if c == "conv_id" else pa.string() if c == "audit" else pa.int64() for c in [*facts, "audit"]]
    if digests:
        return dealt.mapInArrow(lean(hashes), ", ".join([*(f"{c} {k}" for c, k in plan.dtypes), "repaired_sha256 string"]))
    return dealt.mapInArrow(lean(turns), f"conv_id {kind}, position long, edit string, role string, text string")


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id (long or string), position, edit (K, R or I), role and text."""
    rows = rows_of(turns)
    return mended(rows, plans(rows))


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by the CRC-32 of ``conv_id:turn``: one row in twenty each is dropped
    (marked ``gone``), emptied, stripped of sentence ends, repeated, or given the role user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(hit == 0))).alias("gone"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = rows_of(damaged(table(spark, sf_dir, "conversations")), "gone")
    found = mended(rows, plans(rows), digests=True)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _step(state: int) -> str:
    """SQL: the cheapest edits that lead to ``state`` by the next letter, as nine digits and initials."""
    found = []
    for letter in "DsuaxSUAX":
        some = [f"lpad((left(s{before}, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr(s{before}, 10) || '{edits}'" for before, after, edits, cost in choices(letter) if after == state]
        if some:
            found.append(f"WHEN '{letter}' THEN least({', '.join([*some, 'NULL'])})")
    return f"CASE signature[i + 1] {' '.join(found)} END AS s{state}"


SQL = rf"""
WITH RECURSIVE polynomial AS (SELECT list(list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS hit FROM conversations, polynomial),
damaged AS (SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
ordered AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM damaged),
judged AS (SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS neighbours FROM ordered),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (k > 1 AND coalesce(neighbours, '') NOT IN ('su', 'ua', 'au')) AS illegal, string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN 'D' WHEN initial NOT IN ('s', 'u', 'a') THEN CASE fault WHEN '' THEN 'x' ELSE 'X' END
    WHEN fault = '' THEN initial ELSE upper(initial) END, '' ORDER BY k) AS signature FROM judged GROUP BY conv_id),
walk AS (SELECT signature, 0 AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM (SELECT DISTINCT signature FROM facts)
    UNION ALL SELECT signature, i + 1, {", ".join(map(_step, range(4)))} FROM walk WHERE i < length(signature)),
answers AS (SELECT signature, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM (SELECT signature, least(s0, s3, lpad((left(s2, 9)::INTEGER + 5)::VARCHAR, 9, '0') || substr(s2, 10) || 'I', lpad((left(s1, 9)::INTEGER + 10)::VARCHAR, 9, '0') || substr(s1, 10) || 'II') AS best
    FROM walk WHERE i = length(signature))),
planned AS (SELECT * FROM facts JOIN answers USING (signature)),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS pos FROM planned WHERE audit <> ''),
placed AS (SELECT *, sum(CASE edit WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM edits),
turns AS (SELECT p.conv_id, pos, edit, CASE edit WHEN 'I' THEN '' ELSE j.text END AS text, j.role, sum(CASE WHEN edit = 'K' AND j.initial = 's' THEN 0 ELSE 1 END) OVER (PARTITION BY p.conv_id ORDER BY pos) AS place
    FROM placed p LEFT JOIN judged j ON p.conv_id IS NOT DISTINCT FROM j.conv_id AND p.k = j.k WHERE edit <> 'D'),
texts AS (SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN role ELSE CASE place % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || text, chr(10) ORDER BY pos)) AS repaired_sha256 FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
    coalesce(repaired_sha256, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN planned p ON c.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN texts t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
