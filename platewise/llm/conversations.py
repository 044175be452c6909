"""Repair of conversation structure by weighted error-correcting parsing.

A conversation should read `(s?(ua)+)?` in role initials: an optional system turn, then user and assistant in turns, or
nothing. The grammar is right-linear, S -> s U | U | nothing, U -> u A, A -> a U | a, with weighted productions for
errors: a row is kept (0), rerolled to user or assistant (2) or deleted (3, the only choice for blank rows and repeated
ones), and an empty user or assistant turn is inserted anywhere (2); a truncated row that stays costs 1.

The chart is Earley's: a column after each row, whose items are the dotted rules. Items that differ only in where they
began have the same future in a right-linear grammar, so a column keeps the cheapest of them: four items, each with the
least (cost, audit), the audit being the edits' initials. Audits are compared without being built: two audits of a
column have as many rows behind them and both end in a row's own letter, so neither is a proper prefix of the other, and
their order in the last column decides every later comparison. An item thus holds a cost, a rank and a back pointer.

Plan: rows are reduced to digests and flags, repeats are marked by a window over equal rows, and one streamed pass over
each conversation's flags in order of turn writes the edits; a second pass merges the edits into the rows. What a task
holds of a conversation is a few bytes for each row, never its texts; a busy conversation is one stream of both passes,
as the digest of its whole repaired text is sequential.

Defined results: null roles and texts count as one space, a null turn comes first, a null conversation is one of its
own. Rows of a conversation come by turn, then role, then SHA-256 of the text; repeated rows are told apart by nothing and
all but the first are duplicates. Very long texts are digested by Spark and otherwise carried as they are. An empty
table gives an empty result. Columns other than the four named are ignored, so clashing names cannot disturb.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import WS, batch, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}

#: Items of a column by what may come next: S -> .s U | .U, after s, U -> u .A, A -> a . (complete, or a .U).
START, SYSTEM, USER, DONE = range(4)
#: Item after reading an initial; what cannot be read is missing.
READ = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
#: Rolled-in initial of a rerole or an insert at each item.
WANTS = {START: "u", SYSTEM: "u", USER: "a", DONE: "u"}
#: Items reached by inserts alone, as (item, initials). More inserts would come back to an item at a higher cost.
INSERTS = {p: [(p, "")] for p in (START, SYSTEM, USER, DONE)}
for _p, _found in INSERTS.items():
    _q, _said = _p, ""
    while (_next := READ[_q, WANTS[_q]]) not in [x for x, _ in _found]:
        _q, _said = _next, _said + WANTS[_q]
        _found.append((_q, _said))


class Chart:
    """Columns of one conversation. Rows are added one by one; `edits` reads the cheapest parse off the last column."""

    def __init__(self) -> None:
        self.items: dict[int, tuple[int, int]] = {START: (0, 0)}  # item -> (cost, rank of its audit among the column's)
        self.back: list[bytes] = []

    def add(self, initial: str, faulty: bool, truncated: bool) -> None:
        """faulty: blank or duplicate, so it has to be deleted."""
        best: dict[int, tuple] = {}
        late = TRUNCATED * truncated
        for p, (cost, rank) in self.items.items():
            for q, said in INSERTS[p]:
                base, word = cost + INSERT * len(said), "I" * len(said)
                moves = [(q, base + DELETE, "D")]
                if not faulty:
                    if (to := READ.get((q, initial))) is not None:
                        moves.append((to, base + KEEP + late, "K"))
                    moves.append((READ[q, WANTS[q]], base + REROLE + late, "R"))
                for to, total, letter in moves:
                    found = (total, rank, word + letter, p)
                    if to not in best or found < best[to]:
                        best[to] = found
        order = {key: i for i, key in enumerate(sorted({x[1:3] for x in best.values()}))}
        self.items = {to: (x[0], order[x[1:3]]) for to, x in best.items()}
        self.back.append(bytes(v for to in range(4) for v in ((best[to][3], 4 * (len(best[to][2]) - 1) + "KRD".index(best[to][2][-1])) if to in best else (255, 255))))

    def edits(self) -> tuple[int, list[str]]:
        """Cost, and for each row the letters of its edit: roles inserted before it, then K, D, U or A (rerole)."""
        ends = []
        for p, (cost, rank) in self.items.items():
            ends += [(cost + INSERT * len(said), rank, "I" * len(said), said, p) for q, said in INSERTS[p] if q in (START, DONE)]
        cost, _, _, after, item = min(ends)
        out = []
        for column in reversed(self.back):
            p, code = column[2 * item], column[2 * item + 1]
            inserts, letter = divmod(code, 4)
            said = dict((len(s), s) for _, s in INSERTS[p])[inserts]
            q = next(x for x, s in INSERTS[p] if s == said)
            out.append(said + (WANTS[q].upper() if "KRD"[letter] == "R" else "KRD"[letter]))
            item = p
        out.reverse()
        if out:
            out[-1] += after
        return cost, out


def audit(edits: Iterable[str]) -> str:
    return "".join(edits).translate(str.maketrans("uaUA", "IIRR"))


def lines_of(edit: str, role: str, text: str) -> list[tuple[str, str]]:
    """Repaired turns that one row's edit stands for."""
    out = []
    for c in edit:
        if c in ROLES:
            out.append((ROLES[c], ""))
        elif c != "D":
            out.append((role if c == "K" else ROLES[c.lower()], text))
    return out


# ---------------------------------------------------------------- Spark


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of `conv_id:turn`, modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("hit <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def _solid() -> Column:
    """The text without white space at its end; empty if blank."""
    return F.rtrim("text", F.lit(WS))


_KEY = ("conv_id", "turn", "role", "digest")
_EDITS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("seq", pa.int64()), ("edit", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
_EDITS_DDL = "conv_id long, turn long, role string, digest binary, seq long, edit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _emit(schema: pa.Schema, rows: Iterable[Sequence], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[Sequence] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield batch(schema, zip(*held))
            held = []
    if held:
        yield batch(schema, zip(*held))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of whole conversations in order -> a summary row for each and an edit for each row that is not just kept."""

    def conversations() -> Iterator[tuple]:
        chart = None
        for conv, turn, role, digest, blank, duplicate, truncated in _rows(batches):
            if chart is None or conv != own:
                if chart is not None:
                    yield from close()
                own, chart, keys, last, counts, illegal, seen = conv, Chart(), [], None, [0, 0, 0], 0, [None, None, 0, None]
            fault = 0 if blank else 1 if duplicate else 2 if truncated else 3
            if fault < 3:
                counts[fault] += 1
            if chart.back and last + role[:1] not in ("su", "ua", "au"):
                illegal += 1
            last = role[:1]
            if turn is not None:
                if turn != seen[3]:
                    seen[2] += 1
                seen = [turn if seen[0] is None else seen[0], turn, seen[2], turn]
            chart.add(last, fault < 2, fault == 2)
            keys.append((turn, role, digest))

            def close() -> Iterator[tuple]:
                cost, edits = chart.edits()
                gaps = 0 if seen[0] is None else seen[1] - seen[0] + 1 - seen[2]
                yield (own, None, None, None, None, None, gaps, *counts, illegal, cost, audit(edits))
                for i, (key, edit) in enumerate(zip(keys, edits)):
                    if edit != "K" or key in keys[max(0, i - 1) : i] + keys[i + 1 : i + 2]:  # equal rows are adjacent
                        yield (own, *key, i, edit, *[None] * 7)

        if chart is not None:
            yield from close()

    return _emit(_EDITS, conversations())


def parse(rows: DataFrame) -> DataFrame:
    """Summaries (seq null) and edits (seq not null) of conversations; written, as both are read later."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.sha2("text", 256)).alias("digest"), (F.length(_solid()) > 0).alias("solid"), F.substring(_solid(), -1, 1).alias("end"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    marked = rows.where("solid").withColumn("duplicate", again).unionByName(rows.where("not solid").withColumn("duplicate", F.lit(False)))
    flags = marked.select(*_KEY, (~F.col("solid")).alias("blank"), "duplicate", (~F.col("end").isin(".", "!", "?")).alias("truncated"))
    ordered = flags.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "blank", "duplicate")
    return materialize(ordered.mapInArrow(_parse, _EDITS_DDL))


_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, role, text) of repaired turns. Edits come before the equal rows they belong to, in order; none: all kept."""
    key, waiting = None, deque()
    for conv, turn, role, digest, kind, _, edit, text in rows:
        if (conv, turn, role, digest) != key:
            key, waiting = (conv, turn, role, digest), deque()
        if kind == 0:
            waiting.append(edit)
            continue
        for r, t in lines_of(waiting.popleft() if waiting else "K", role, text):
            yield conv, r, t


def _merged(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("edit"), "text")
    edits = parsed.where("seq is not null").select(*_KEY, F.lit(0).alias("kind"), "seq", "edit", F.lit(None).cast("string").alias("text"))
    return rows.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "kind", "seq")


def repaired_turns(rows: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, role, text): the turns of every conversation after its cheapest repair."""

    def run(batches):
        def turns():
            own, at = object(), 0
            for conv, role, text in _repaired(_rows(batches)):
                own, at = conv, at + 1 if conv == own else 0
                yield conv, at, role, text

        return _emit(_TURNS, turns())

    return _merged(rows, parse(rows) if parsed is None else parsed).mapInArrow(run, "conv_id long, position long, role string, text string")


def repaired_digests(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations that keep a turn; texts are hashed as they stream by."""

    def run(batches):
        def digests():
            sha = None
            for conv, role, text in _repaired(_rows(batches)):
                if sha is None or conv != own:
                    if sha is not None:
                        yield own, sha.hexdigest()
                    own, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if sha is not None:
                yield own, sha.hexdigest()

        return _emit(_DIGESTS, digests())

    return _merged(rows, parsed).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conversation of ids, which rows may have lost: counts of faults, cost, audit and digest."""
    parsed = parse(rows)
    found = parsed.where("seq is null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    ids = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    key = lambda df, name: df.withColumnRenamed("conv_id", name)
    out = ids.join(key(found, "c1"), F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(key(repaired_digests(rows, parsed), "c2"), F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
