"""Conversation structure repair by a run-length min-plus programme.

``damage`` is the fixed fault injection of the contract; ``mend`` finds each turn's
fault and the cheapest edits that leave role initials ``(s?(ua)+)?`` (see
:mod:`carryover.llm.turns`); ``digests`` sums a mended conversation up.

Turns are dealt out by ranges of (conversation, turn, role, text) and sorted, so that a
conversation with a third of all rows is spread over many tasks.  A conversation that
lies whole within one range and is small is mended on the spot.  The first and the last
of a range, and any that outgrows a piece, are written as pieces: their symbols (one
byte a turn) meet in one task for the cheapest edits, which go back to the pieces; the
texts stay in pieces of about a megabyte.  Only the audit and the hash of the repaired
text, which are one value a conversation, are made in one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.llm import turns as t
from carryover.llm.common import BLANKS, keep

#: Bytes of text after which a conversation is written in pieces; rows gathered before they are handed on.
PIECE_BYTES, BATCH_ROWS = 1 << 20, 500

#: Figures of a conversation, on its first piece.
FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FIGURE_NAMES = [x.split()[0] for x in FIGURES.split(", ")]
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
TURNS_SQL = "array<struct<role:string,text:string>>"
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), TURNS_SQL: TURNS, "boolean": pa.bool_()}


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of ``conversations`` (conv_id, turn, role, text) after the contract's faults.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (``copies`` 0, so that
    its conversation is still known), 1 empties the text, 2 removes ``[.!?]``, 3 repeats
    the row (``copies`` 2), 4 makes the role user.  A null id or turn counts as one
    space in that key and stays null in its column; a null role or text becomes one
    space.  Rows with one id and turn are damaged alike.  Other columns are not read.
    """
    named = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")))
    kind = F.crc32(named.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form :func:`mend` reads; null roles and texts become one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, F.lit(1).alias("copies"))


def _place(turn: str = "turn") -> Column:
    """Turns in order, absent ones first."""
    return F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))


def _said_earlier(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: role and text were seen at an earlier turn of the conversation.

    Sayings are counted by a digest of conversation, role and text; only those of more
    than one turn are joined back, one row each, so a saying that fills a conversation
    is a skewed left side against one row.
    """
    conv = F.col("conv_id").cast("string")
    whose = F.coalesce(F.concat(F.length(conv), F.lit(":"), conv), F.lit("-"))
    said = F.unhex(F.sha2(F.concat(whose, F.lit("|"), F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumn("said", said)
    spoken = rows.where((F.col("copies") > 0) & (F.length(F.btrim("text", F.lit(BLANKS))) > 0))
    first = spoken.groupBy("said").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last")
    both = rows.join(first.select("said", "first"), "said", "left")
    return both.select("conv_id", "turn", "role", "text", "copies", F.coalesce(F.col("first") < _place(), F.lit(False)).alias("again"))


class _Held:
    """What a task holds of the conversation it is reading."""

    def __init__(self, conv):
        self.conv, self.open, self.before, self.turn_seen = conv, False, None, False
        self.empty()

    def empty(self) -> None:
        self.symbols, self.turns, self.bytes = bytearray(), [], 0
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.distinct, self.last = self.distinct + 1, turn
        bare = text.strip(BLANKS)
        for copy in range(copies):
            if not bare:
                fault = t.BLANK
            elif again or copy or self.before == (turn, role, text):
                fault = t.DUPLICATE
            else:
                fault = t.TRUNCATED if bare[-1] not in ".!?" else t.FINE
            self.symbols.append(t.symbol(role, fault))
            self.turns.append((role, text if fault in (t.FINE, t.TRUNCATED) else None))
        if copies:
            self.before = (turn, role, text)
            self.bytes += len(text)


def _figures(pieces: list[tuple]) -> tuple:
    """The figures of a conversation from (symbols, first, last, distinct) of its pieces in order."""
    symbols = b"".join(p[0] for p in pieces)
    known = [p[1:] for p in pieces if p[1] is not None]
    gaps = 0
    if known:
        distinct = sum(d for _, _, d in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:]))
        gaps = known[-1][1] - known[0][0] + 1 - distinct
    faults = [sum(symbols.count(4 * c + f) for c in range(4)) for f in (t.BLANK, t.DUPLICATE, t.TRUNCATED)]
    return gaps, *faults, t.illegal(t.runs(symbols)), *t.repair(symbols)


def _repaired(edits: str, state: int, turns: list[tuple[str, str | None]]) -> tuple[list[dict], int]:
    rows, state = t.edited(edits, state, turns)
    return [{"role": role, "text": text} for role, text in rows], state


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.rsplit(" ", 1) for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, _arrow(k)) for c, (_, k) in zip(columns, named)], names=[n for n, _ in named])


def _arrow(kind: str) -> pa.DataType:
    return ARROW.get({"bigint": "long"}.get(kind, kind), pa.string())


def _id_kind(df: DataFrame) -> str:
    """Ids are whole numbers or texts."""
    kind = df.schema["conv_id"].dataType.simpleString()
    return kind if kind in ("bigint", "int", "string") else "string"


def _batched(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes))) + sum(len(x["text"] or "") for v in row if isinstance(v, list) for x in v)
        if len(held) >= BATCH_ROWS or size > PIECE_BYTES:
            yield _table(held, schema)
            held, size = [], 0
    if held:
        yield _table(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), BATCH_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, BATCH_ROWS).columns))


def mend(rows: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Mended conversations in pieces, from rows as :func:`damage` or :func:`undamaged` gives them.

    Columns: conv_id, part, piece (their order), pieces (of the conversation),
    ``repaired`` (role and text of each turn left or inserted), and on the first piece
    gaps, blank, duplicate, truncated, illegal, cost and audit.  Every conversation has
    a piece, also where no row or no turn is left.  Rows of one turn are taken in order
    of role and text, absent turns come first, and absent ids are one conversation.
    A blank turn holds nothing but blanks; a duplicate repeats role and text of any
    earlier turn; a truncated one does not end in ``.``, ``!`` or ``?``.  Repeated rows
    are turns of their own (the later ones duplicates), columns besides those five are
    not read, ids other than whole numbers are taken as text, and an empty table gives
    an empty one.  ``piece_bytes`` of text make a piece.
    """
    kind = _id_kind(rows)
    rows = rows.withColumn("conv_id", F.col("conv_id").cast(kind))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    dealt = _said_earlier(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = (
        f"conv_id {kind}, open boolean, part int, piece int, symbols binary, first long, last long, distinct_turns long, "
        f"turns {TURNS_SQL}, {FIGURES}"
    )

    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def written() -> Iterator[tuple]:
            piece = 0
            now: _Held | None = None

            def close(held: _Held, still: bool) -> tuple:
                nonlocal piece
                piece += 1
                own = (bytes(held.symbols), held.first, held.last, held.distinct)
                if still or held.open:
                    turns = [{"role": r, "text": x} for r, x in held.turns]
                    return held.conv, True, part, piece, *own, turns, *[None] * len(FIGURE_NAMES)
                figures = _figures([own])
                return held.conv, False, part, piece, None, None, None, None, _repaired(figures[-1], t.START, held.turns)[0], *figures

            for conv, turn, role, text, copies, again in _rows(batches):
                if now is None:
                    now = _Held(conv)
                    now.open = True  # may have begun in the range before
                elif conv != now.conv:
                    yield close(now, False)
                    now = _Held(conv)
                elif now.bytes > piece_bytes:
                    now.open = True
                    yield close(now, True)
                    now.empty()
                if copies:
                    now.add(turn, role, text, copies, again)
            if now is not None:
                yield close(now, True)  # may go on in the range behind

        yield from _batched(written(), schema)

    done = keep(dealt.mapInArrow(sequence, schema), "turns")
    whole = done.where("NOT open").select("conv_id", "part", "piece", F.lit(1).alias("pieces"), F.col("turns").alias("repaired"), *FIGURE_NAMES)
    return whole.unionByName(_mend_pieces(done.where("open"), kind))


def _mend_pieces(pieces: DataFrame, kind: str) -> DataFrame:
    """The conversations in several ranges or pieces: edits from all their symbols, then applied piece by piece."""
    place = ["conv_id", "part", "piece"]
    shape = pieces.select(*place, "symbols", "first", "last", "distinct_turns").repartition("conv_id").sortWithinPartitions(*place)
    solved_schema = f"part int, piece int, pieces int, edits string, state int, {FIGURES}"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved() -> Iterator[tuple]:
            for _, same in groupby(_rows(batches), lambda r: (r[0],)):
                own = [r[1:] for r in same]
                figures = _figures([r[2:] for r in own])
                cut, state = t.split(figures[-1], [len(r[2]) for r in own]), t.START
                for at, ((part, piece, symbols, *_), edits) in enumerate(zip(own, cut)):
                    yield part, piece, len(own), edits, state, *(figures if at == 0 else [None] * len(figures))
                    state = t.after(edits, state, symbols)

        yield from _batched(solved(), solved_schema)

    edits = shape.mapInArrow(solve, solved_schema)
    joined = pieces.select(*place, "turns").join(edits, ["part", "piece"])
    columns = [*place, "pieces", "edits", "state", "turns", *FIGURE_NAMES]
    out_schema = f"conv_id {kind}, part int, piece int, pieces int, repaired {TURNS_SQL}, {FIGURES}"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def applied() -> Iterator[tuple]:
            for conv, part, piece, n, edit, state, turns, *figures in _rows(batches):
                yield conv, part, piece, n, _repaired(edit, state, [(x["role"], x["text"]) for x in turns])[0], *figures

        yield from _batched(applied(), out_schema)

    return joined.select(*columns).mapInArrow(apply, out_schema)


def repaired_turns(mended: DataFrame) -> DataFrame:
    """(conv_id, part, piece, position, role, text): the turns :func:`mend` leaves, in that order."""
    return mended.select("conv_id", "part", "piece", F.posexplode("repaired").alias("position", "turn")).select(
        "conv_id", "part", "piece", "position", "turn.role", "turn.text"
    )


def digests(mended: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, its figures, and the SHA-256 of its ``role:text`` lines.

    A conversation of one piece is hashed where it lies; the pieces of the others are
    brought together in order and hashed as they pass.  Nothing left hashes as the
    empty text.
    """
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    alone = mended.where("pieces = 1").select("conv_id", *FIGURE_NAMES, F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    several = mended.where("pieces > 1").select(
        "conv_id", "part", "piece", F.size("repaired").alias("n"), lines.cast("binary").alias("lines"), *FIGURE_NAMES
    )
    several = several.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    kind = _id_kind(mended)
    schema = f"conv_id {kind}, {FIGURES}, repaired_sha256 string"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            for (conv,), same in groupby(_rows(batches), lambda r: (r[0],)):
                sha, some, figures = hashlib.sha256(), False, None
                for _, _, _, n, data, *own in same:
                    figures = figures or own
                    if n:
                        sha.update(b"\n" + data if some else data)
                        some = True
                yield conv, *figures, sha.hexdigest()

        yield from _batched(hashed(), schema)

    return alone.unionByName(several.mapInArrow(stream, schema))
