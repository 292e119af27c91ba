"""Repair of conversation structure by weighted CYK parsing over spans of turns.

A repaired conversation is ``(s?(ua)+)?`` in the initials of its roles. The words of that language
are read by four states (start, after system, after user, after assistant), and the grammar in
Chomsky normal form has a symbol per pair of states, ``[p, r] -> [p, q] [q, r]``: what a span of
turns can become between state p and state r. A turn alone is kept (0), given the role of user
or assistant (3) or deleted (4, and so must blank and duplicate turns be); a truncated turn that
stays costs 3 more; an empty turn of user or assistant is inserted for 3. A cell keeps, for each
pair, the least (cost, audit), the audit being the initials of the edits in order. The insertion
closure of a turn's cell allows insertions before and after it, so cells of longer spans are
closed as soon as their parts are.

The least pair of a span is made of the least pairs of its parts: an audit fixes its cost, and of
two audits of one span and one cost none is the beginning of the other (it would lack an insertion,
hence 3), so the first difference decides, whatever follows.

Blocks of up to ``BLOCK`` turns are parsed by a chart over all spans, by length, with all splits.
Since a symbol names the states at both ends, every split of a span gives the same cell; longer
spans are therefore combined from neighbours only, bottom-up: blocks to segments within a task,
segments to the ranges of a shuffle, ranges to groups of sixteen, until a conversation is one span.

Rows are sorted by ranges of (conversation, turn, ...), so a conversation of any size is cut over
many tasks. One that lies within a range and a segment is finished there; only the others, at
most two per range and the long ones, travel as segments. The digest of a repaired conversation is
one pass over its turns by definition: long ones are streamed, segment by segment.

Cases: a null role or text is one space (hence blank, or no legal role). Null turns come first.
Rows of equal turn are ordered by role, the first 32 characters of the text and a hash of it. A
null conversation id is a conversation of its own. Repeated rows are duplicates. An empty table
has no rows; a conversation without turns has zeros, the empty audit and the digest of the empty
text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.session import materialize

from .common import Memo

#: Turns of a full chart; turns and characters of a segment.
BLOCK, SEGMENT_TURNS, SEGMENT_CHARS = 16, 256, 1 << 20
#: Ranges whose spans are combined in one step.
GROUP = 16
SPACES = " \t\n\v\f\r"

START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3

#: (cost, audit) by pair of states.
Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell) -> Cell:
    """``[p, r] -> [p, q] [q, r]``, the least of all q."""
    out: Cell = {}
    for (p, q), (c, a) in left.items():
        for (q2, r), (d, b) in right.items():
            if q == q2:
                new, old = (c + d, a + b), out.get((p, r))
                if old is None or new < old:
                    out[p, r] = new
    return out


def _insertions() -> Cell:
    """What an empty span can become."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one = cell | {(p, q): (INSERT, "I") for (p, role), q in STEP.items() if role != "s"}
    for _ in range(4):
        cell = joined(cell, one)
    return cell


NOTHING = _insertions()


def turn_cell(symbol: str) -> Cell:
    """A turn: ``x`` must go; else the initial of its role (``o``: another), in capitals where truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "x":
        extra = CUT if symbol.isupper() else 0
        for (p, role), q in STEP.items():
            ways = [(extra, "K")] if role == symbol.lower() else []
            ways += [(RETYPE + extra, "R")] if role != "s" else []
            if ways:
                cell[p, q] = min(ways)
    return joined(joined(NOTHING, cell), NOTHING)


TURN = {s: turn_cell(s) for s in "xsuaoSUAO"}


def chart(symbols: str) -> Cell:
    """CYK: the cells of all spans by length, over all their splits."""
    n = len(symbols)
    if not n:
        return NOTHING
    cells = {(i, i + 1): TURN[s] for i, s in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best: Cell = {}
            for k in range(i + 1, i + length):
                for pair, way in joined(cells[i, k], cells[k, i + length]).items():
                    if pair not in best or way < best[pair]:
                        best[pair] = way
            cells[i, i + length] = best
    return cells[0, n]


CHARTS = Memo(chart, 20_000)


def combined(cells: list[Cell]) -> Cell:
    """Neighbouring spans joined two by two until one is left."""
    while len(cells) > 1:
        cells = [joined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else NOTHING


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[START, q] for q in (START, ASSISTANT) if (START, q) in cell)


# --- spans of turns -----------------------------------------------------------

#: What is known of a span; merge() puts neighbours together. Turns are ordered, nulls first.
SPAN = "struct<blank:long,duplicate:long,truncated:long,illegal:long,first:string,last:string,low:long,high:long,turns:long,cells:array<struct<p:int,q:int,cost:long,audit:string>>>"
LEGAL = ("su", "ua", "au")


def span_of(turns: list, roles: list[str], texts: list[str], seen: Iterable[tuple[str, str]] = ()) -> dict:
    """The span of some neighbouring turns; ``seen`` are the (role, text) of earlier ones."""
    known, symbols = set(seen), []
    counts = {"x": 0, "d": 0, "t": 0}
    for role, text in zip(roles, texts):
        bare = text.rstrip(SPACES)
        if not bare:
            counts["x"] += 1
            symbols.append("x")
        elif (role, text) in known:
            counts["d"] += 1
            symbols.append("x")
        else:
            known.add((role, text))
            symbol = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if bare[-1] not in ".!?":
                counts["t"] += 1
                symbol = symbol.upper()
            symbols.append(symbol)
    told = [t for t in turns if t is not None]
    line = "".join(symbols)
    return {"blank": counts["x"], "duplicate": counts["d"], "truncated": counts["t"],
            "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:])),
            "first": roles[0][:1] if roles else None, "last": roles[-1][:1] if roles else None,
            "low": told[0] if told else None, "high": told[-1] if told else None, "turns": len(set(told)),
            "cells": combined([CHARTS[line[i:i + BLOCK]] for i in range(0, len(line), BLOCK)])}


def merge(a: dict, b: dict) -> dict:
    """Two neighbouring spans as one."""
    if a["first"] is None or b["first"] is None:
        return b if a["first"] is None else a
    same = a["high"] is not None and a["high"] == b["low"]
    return {**{k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")},
            "illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL),
            "first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"],
            "high": a["high"] if b["high"] is None else b["high"], "turns": a["turns"] + b["turns"] - same,
            "cells": joined(a["cells"], b["cells"])}


def merged(spans: list[dict]) -> dict:
    while len(spans) > 1:
        spans = [merge(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def _packed(span: dict) -> dict:
    return span | {"cells": [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in span["cells"].items()]}


def _unpacked(span: dict) -> dict:
    return span | {"cells": {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in span["cells"]}}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def verdict(span: dict) -> dict:
    cost, audit = best(span["cells"])
    gaps = 0 if span["low"] is None else span["high"] - span["low"] + 1 - span["turns"]
    return {"gaps": gaps, **{k: span[k] for k in COUNTS[1:5]}, "cost": cost, "audit": audit}


class Editor:
    """Applies an audit to turns that come in order, some at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made = audit, 0, 0
        self.shift = (len(audit) - audit.count("D")) % 2  # an odd number of turns: the first is the system's

    def _role(self) -> str:
        return "user" if (self.made - self.shift) % 2 == 0 else "assistant"

    def _insert(self) -> Iterator[tuple[str, str, str, int | None]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self._role(), "", "I", None
            self.made, self.at = self.made + 1, self.at + 1

    def feed(self, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str, int | None]]:
        """(role, text, edit, index of the turn) of each turn of the repaired conversation."""
        for i, (role, text) in enumerate(zip(roles, texts)):
            yield from self._insert()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit != "D":
                yield (role if edit == "K" else self._role()), text, edit, i
                self.made += 1

    def end(self) -> Iterator[tuple[str, str, str, int | None]]:
        yield from self._insert()


class Digest:
    """sha256 of ``role:text`` lines that come one by one."""

    def __init__(self):
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, lines: Iterable[tuple[str, str, str, int | None]]) -> None:
        for role, text, _, _ in lines:
            self.sha.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
            self.empty = False

    def hex(self) -> str:
        return self.sha.hexdigest()


def repaired(turns: list, roles: list[str], texts: list[str]) -> dict:
    """The result of a conversation at hand."""
    told = verdict(span_of(turns, roles, texts))
    editor, digest = Editor(told["audit"]), Digest()
    digest.add(editor.feed(roles, texts))
    digest.add(editor.end())
    return told | {"repaired_sha256": digest.hex()}


# --- the same over a table ---------------------------------------------------

def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turn as longs, role and text with one space for null; ``live`` rows are turns, others only name their conversation."""
    return df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), F.lit(True).alias("live"))


def damaged(turns: DataFrame) -> DataFrame:
    """The stated damage by crc32 of ``conv_id:turn``; a dropped row stays as a mere name of its conversation."""
    def cell(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(cell("conv_id"), F.lit(":"), cell("turn")).cast("binary")) % 20
    rows = turns.withColumn("_kind", kind).withColumn("_copies", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") != 0).alias("live"))


def _ordered(turns: DataFrame) -> tuple[DataFrame, list[str]]:
    """Helper columns of the order of rows; the last only parts repeated rows, so that any number of them can be cut."""
    return turns.withColumns({"_begin": F.substring("text", 1, 32), "_hash": F.xxhash64("text"), "_copy": F.monotonically_increasing_id()}), \
        ["conv_id", "turn", "role", "_begin", "_hash", "_copy"]


SEGMENT = ("conv_id long, rng int, seq int, done boolean, " + ", ".join(f"{c} long" for c in COUNTS)
           + ", audit string, repaired_sha256 string, turns array<long>, roles array<string>, texts array<string>")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _flushed(rows: Iterable[dict], schema: pa.Schema, weight=lambda r: 1, limit: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded weight."""
    held, heavy = [], 0
    for r in rows:
        held.append(r)
        heavy += weight(r)
        if heavy >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, heavy = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def segments(turns: DataFrame) -> DataFrame:
    """Finished conversations (``done``) and the segments of all others, in ranges of conversation and turn."""
    rows, order = _ordered(turns)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "live",
                                                                                    F.spark_partition_id().alias("rng"))
    schema = _arrow(SEGMENT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            conv, rng, first, seq = None, None, None, 0  # first: the conversation may have begun in an earlier range
            turn, role, text, chars = [], [], [], 0

            def segment() -> dict:
                return {"conv_id": conv, "rng": rng, "seq": seq, "done": False, "turns": turn, "roles": role, "texts": text}

            for batch in batches:
                for c, t, r, x, live, at in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if first is None:
                        conv, rng, first = c, at, True
                    elif c != conv:
                        yield segment() if first or seq else {"conv_id": conv, "done": True, **repaired(turn, role, text)}
                        conv, first, seq, turn, role, text, chars = c, False, 0, [], [], [], 0
                    if live:
                        if turn and (len(turn) >= SEGMENT_TURNS or chars + len(x) > SEGMENT_CHARS):
                            yield segment()
                            seq, turn, role, text, chars = seq + 1, [], [], [], 0
                        turn.append(t)
                        role.append(r)
                        text.append(x)
                        chars += len(x)
            if first is not None:
                yield segment()  # the conversation may go on in the next range
            CHARTS.forget()

        return _flushed(out(), schema, lambda r: 1 + sum(map(len, r["texts"])) // 1024 if not r["done"] else 1)

    return ranged.mapInArrow(cut, SEGMENT)


def _with_earlier(parts: DataFrame) -> DataFrame:
    """Segments with ``again``: digests of their (role, text) that an earlier segment of the conversation has too."""
    digests = F.array_distinct(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.sha2(
        F.concat(F.octet_length(x["roles"]).cast("string"), F.lit(":"), x["roles"], x["texts"]), 256)))
    each = parts.select("conv_id", "rng", "seq", F.explode(digests).alias("digest"))
    # a segment has a row per distinct digest, and sums come before the shuffle
    first = each.groupBy(F.col("conv_id").alias("_c"), F.col("digest").alias("_d")).agg(F.min(F.struct("rng", "seq")).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    again = (each.join(first, same & (F.col("digest") == F.col("_d"))).filter(F.col("_first") < F.struct("rng", "seq"))
             .groupBy(F.col("_c"), F.col("rng").alias("_r"), F.col("seq").alias("_s")).agg(F.collect_set("digest").alias("again")))
    return parts.join(again, same & (F.col("rng") == F.col("_r")) & (F.col("seq") == F.col("_s")), "left").select(
        "conv_id", "rng", "seq", "turns", "roles", "texts", "again")


def _digest_of(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def _spans(parts: DataFrame) -> DataFrame:
    schema = f"conv_id long, rng int, seq int, span {SPAN}"
    arrow = _arrow(schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    again = set(r["again"] or ())
                    seen = [x for x in zip(r["roles"], r["texts"]) if again and _digest_of(*x) in again]
                    yield {"conv_id": r["conv_id"], "rng": r["rng"], "seq": r["seq"], "span": _packed(span_of(r["turns"], r["roles"], r["texts"], seen))}
            CHARTS.forget()

        return _flushed(out(), arrow, limit=64)

    return parts.mapInArrow(told, schema)


def _merged_by(spans: DataFrame, key, order) -> DataFrame:
    """The spans of a conversation that share ``key`` as one, in the order of ``order``."""
    lists = spans.groupBy("conv_id", key.alias("rng")).agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), "span"))).alias("spans"))
    schema = f"conv_id long, rng int, seq int, span {SPAN}"
    arrow = _arrow(schema)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    yield {"conv_id": r["conv_id"], "rng": r["rng"], "seq": 0, "span": _packed(merged([_unpacked(x["span"]) for x in r["spans"]]))}

        return _flushed(out(), arrow, limit=64)

    return lists.mapInArrow(told, schema)


def repair(turns: DataFrame) -> DataFrame:
    """Per conversation: faults, cost and audit of the cheapest repair and the digest of what it gives.

    ``turns`` as from :func:`turns_of`.
    """
    told = materialize(segments(turns), "repair-segments")
    parts = told.filter("not done").select("conv_id", "rng", "seq", "turns", "roles", "texts")
    spans = materialize(_merged_by(_spans(_with_earlier(parts)), F.col("rng"), F.col("seq")), "repair-spans")
    most = spans.agg(F.max("rng")).first()[0] or 0
    while most:
        spans = materialize(_merged_by(spans, F.expr(f"int(rng div {GROUP})"), F.col("rng")), "repair-spans")
        most //= GROUP
    # A conversation's audit comes first, its segments follow in order, in one task that streams them.
    heads = spans.select("conv_id", F.lit(-1).alias("rng"), F.lit(0).alias("seq"), F.lit(None).cast("array<string>").alias("roles"),
                         F.lit(None).cast("array<string>").alias("texts"), "span")
    lines = heads.union(parts.select("conv_id", "rng", "seq", "roles", "texts", F.lit(None).cast(SPAN).alias("span")))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = lines.repartition(n, "conv_id").sortWithinPartitions("conv_id", "rng", "seq")
    schema = _arrow(RESULT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            head, editor, digest = None, None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    r = batch.slice(i, 1).to_pylist()[0]
                    if r["span"] is None:
                        digest.add(editor.feed(r["roles"], r["texts"]))
                        continue
                    if head is not None:
                        digest.add(editor.end())
                        yield head | {"repaired_sha256": digest.hex()}
                    head = {"conv_id": r["conv_id"], **verdict(_unpacked(r["span"]))}
                    editor, digest = Editor(head["audit"]), Digest()
            if head is not None:
                digest.add(editor.end())
                yield head | {"repaired_sha256": digest.hex()}

        return _flushed(out(), schema)

    columns = [c.split()[0] for c in RESULT.split(", ")]
    return told.filter("done").select(*columns).union(stream.mapInArrow(finish, RESULT).select(*columns))


def repaired_turns(turns: DataFrame, results: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place, turn, role, text and edit (K, R or I; an inserted one has no turn)."""
    rows, order = _ordered(turns.filter("live"))
    heads = results.select("conv_id", "audit", F.lit(0).alias("_part"))
    lines = heads.unionByName(rows.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = (lines.repartition(n, "conv_id").sortWithinPartitions("conv_id", "_part", *order[1:])
              .select("conv_id", "audit", "turn", "role", "text"))
    ddl = "conv_id long, place long, turn long, role string, text string, edit string"
    schema = _arrow(ddl)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            editor, conv, place = None, None, 0

            def some(made, turn) -> Iterator[dict]:
                nonlocal place
                for role, text, edit, i in made:
                    yield {"conv_id": conv, "place": place, "turn": None if i is None else turn, "role": role, "text": text, "edit": edit}
                    place += 1

            for batch in batches:
                for c, audit, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if audit is not None:
                        if editor is not None:
                            yield from some(editor.end(), None)
                        editor, conv, place = Editor(audit), c, 0
                    else:
                        yield from some(editor.feed([role], [text]), turn)
            if editor is not None:
                yield from some(editor.end(), None)

        return _flushed(out(), schema, lambda r: 1 + len(r["text"]) // 1024)

    return stream.mapInArrow(told, ddl)


def _sql() -> str:
    """The query in DuckDB's SQL: the least (cost, audit) of each state, turn by turn."""
    byte = "list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split({key}, '')]), lambda c, b: xor(c >> 8, {byte})))"
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
ids AS (SELECT DISTINCT conv_id FROM raw),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM dam),
flt AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
    left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
flg AS (SELECT *, NOT blank AND NOT dup AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM flt),
step(p, r, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, q, c, a) AS (SELECT p, p, 0, '' FROM range(4) t(p) UNION ALL VALUES (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')),
edit AS (SELECT f.conv_id, f.i, p, p AS q, 4 AS c, 'D' AS a FROM flg f, range(4) t(p)
    UNION ALL SELECT f.conv_id, f.i, p, q, CASE WHEN f.cut THEN 3 ELSE 0 END, 'K' FROM flg f JOIN step s ON s.r = f.r WHERE NOT blank AND NOT dup
    UNION ALL SELECT f.conv_id, f.i, p, q, CASE WHEN f.cut THEN 6 ELSE 3 END, 'R' FROM flg f JOIN step s ON s.r <> 's' WHERE NOT blank AND NOT dup),
way AS (SELECT e.conv_id, e.i, e.p, n.q, min({{'c': e.c + n.c, 'a': e.a || n.a}}) AS w FROM edit e JOIN ins n ON n.p = e.q GROUP BY ALL),
run AS (SELECT conv_id, 0 AS i, n.q, {{'c': n.c, 'a': n.a}} AS w FROM ids, ins n WHERE n.p = 0
    UNION ALL SELECT r.conv_id, r.i + 1, v.q, min({{'c': r.w.c + v.w.c, 'a': r.w.a || v.w.a}}) FROM run r
    JOIN way v ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND v.i = r.i + 1 AND v.p = r.q GROUP BY r.conv_id, r.i, v.q),
num_of AS (SELECT conv_id, max(i) AS n FROM num GROUP BY conv_id),
won AS (SELECT r.conv_id, min(r.w) AS w FROM run r LEFT JOIN num_of n ON n.conv_id IS NOT DISTINCT FROM r.conv_id
    WHERE r.i = coalesce(n.n, 0) AND r.q IN (0, 3) GROUP BY r.conv_id),
let AS (SELECT conv_id, w.a AS a, unnest(range(1, length(w.a) + 1)) AS k FROM won),
pos AS (SELECT conv_id, a, k, a[k] AS e, length(replace(a[:k], 'I', '')) AS i, length(replace(a[:k], 'D', '')) - 1 AS o,
    length(replace(a, 'D', '')) % 2 AS odd FROM let),
lin AS (SELECT p.conv_id, p.k, CASE WHEN p.e = 'K' THEN f.role WHEN (p.o - p.odd) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN p.e = 'I' THEN '' ELSE f.text END AS line
    FROM pos p LEFT JOIN num f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.e <> 'I' WHERE p.e <> 'D'),
txt AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM lin GROUP BY conv_id),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate,
    count_if(cut) AS truncated, count_if(before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM flg GROUP BY conv_id)
SELECT d.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
    CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(w.w.c AS BIGINT) AS cost, w.w.a AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM ids d LEFT JOIN cnt c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN txt t ON t.conv_id IS NOT DISTINCT FROM d.conv_id"""


ORACLE = _sql()
