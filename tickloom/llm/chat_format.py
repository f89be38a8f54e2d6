"""Chat formatting: roles by a hidden Markov model, turns in canonical form.

A transcript is a sequence of lines.  Hidden states are the roles, each in two
styles that a transcript never changes between: in a marked transcript speakers
are named, so a paragraph without a name stays with its speaker; in an unmarked
one paragraphs alternate.  A line shows its speaker marker (or that it has none)
and features: whether a piece or a paragraph begins with it, a question mark at
its end, its length.  Viterbi finds the most likely roles; consecutive lines of
one role form a turn (a marker of that role always begins one, and is cut only
then), and turns are rendered in one form, with their blank lines.

All lines are sorted by transcript and place over range partitions, and every
partition is cut in blocks, so a transcript of any length is spread over tasks.
Viterbi is a product in the (max, +) algebra: a block gives the best score from
each state at its start to each at its end, the blocks of a partition multiply to
one such matrix, and a transcript has one matrix per partition it lies in.  The
states at the borders are then fixed from the top down: partitions, blocks,
lines.  The same array kernel, over many sequences at once, serves all three.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch, ship

#: Lines of a block, and characters of a long line.
BLOCK, LONG_LINE = 256, 240
ROLES = ("system", "user", "assistant")
#: Speaker markers by role.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "prompter", "you"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "gpt", "model"),
}
_ROLE_OF = {m: i for i, r in enumerate(ROLES) for m in MARKERS[r]}
_MARK = r"(?i)^\s*(?:[#*>\[<|({\-]{0,4}\s*)(?P<name>" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(?:[\]>|)}*]{0,4})\s*[:\]>|]+\s*"

#: Start, transition and emission model (log space): a marker names its role nearly always, an unmarked line mostly
#: stays with the speaker, a piece, or an unmarked transcript's paragraph, mostly alternates, a marked one's stays.
START = np.log([0.25, 0.65, 0.10])
STAY = np.log(np.array([[0.30, 0.65, 0.05], [0.01, 0.80, 0.19], [0.01, 0.19, 0.80]]))
SWITCH = np.log(np.array([[0.05, 0.90, 0.05], [0.01, 0.14, 0.85], [0.01, 0.85, 0.14]]))
PARAGRAPH = np.log(np.array([[0.60, 0.35, 0.05], [0.005, 0.98, 0.015], [0.005, 0.015, 0.98]]))
MARKED = np.log(np.array([0.02, 0.96]))
#: By style and by what begins with the line (nothing, a paragraph, a piece): that it has a marker.
NAMED = np.array([[0.05, 0.40, 0.80], [0.002, 0.005, 0.005]])
STATES = 2 * len(ROLES)
ASKS = np.log(np.array([[0.05, 0.95], [0.40, 0.60], [0.10, 0.90]]))
LONG = np.log(np.array([[0.5, 0.5], [0.3, 0.7], [0.6, 0.4]]))


def _matrices() -> np.ndarray:
    """Matrix of a line's code: score of each state (style, then role) at the line, from each state before it."""
    out = np.full((128, STATES, STATES), -np.inf)
    for code in range(128):
        first, fresh, mark, asks, long_ = code >> 6, min(code >> 4 & 3, 2), (code >> 2 & 3) - 1, code >> 1 & 1, code & 1
        seen = ASKS[:, 1 - asks] + LONG[:, 1 - long_]
        if mark >= 0:
            seen = seen + np.where(np.arange(len(ROLES)) == mark, MARKED[1], MARKED[0])
        for style in (0, 1):
            named = np.log(NAMED[style, fresh] if mark >= 0 else 1 - NAMED[style, fresh])
            mine = slice(style * len(ROLES), (style + 1) * len(ROLES))
            if first:
                out[code][:, mine] = np.log(0.5) + START + seen + named
            else:
                moves = SWITCH if mark >= 0 or fresh == 2 or (fresh and style) else PARAGRAPH if fresh else STAY
                out[code][mine, mine] = moves + seen + named
    return out


MATRICES = _matrices()


#: Bit of the code of a transcript's first line.
FIRST = 64


def line_codes(lines: pa.Array, fresh: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of lines (fresh: 0, 1 a paragraph or 2 a piece begins; marker, asks, long) and the lines without their markers."""
    lines = lines.cast(pa.large_string()).fill_null("")
    found = pc.struct_field(pc.extract_regex(lines, _MARK), "name")
    mark = pc.index_in(pc.utf8_lower(found), pa.array(list(_ROLE_OF), pa.large_string()))
    mark = pc.take(pa.array(list(_ROLE_OF.values()), pa.int64()), mark).fill_null(-1).to_numpy(zero_copy_only=False)
    text = pc.if_else(found.is_valid(), pc.replace_substring_regex(lines, _MARK, ""), lines)
    asks = pc.ends_with(pc.utf8_rtrim_whitespace(text), "?").to_numpy(zero_copy_only=False)
    long_ = pc.greater(pc.utf8_length(text), LONG_LINE).to_numpy(zero_copy_only=False)
    return fresh * 16 + (mark + 1) * 4 + asks * 2 + long_, text


def product(mats: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(max, +) products of runs of matrices."""
    out = np.where(np.eye(STATES) > 0, 0.0, -np.inf)[None].repeat(len(start), 0)
    for k in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > k)
        out[on] = (out[on][:, :, :, None] + mats[start[on] + k][:, None]).max(2)
    return out


def viterbi(mats: np.ndarray, start: np.ndarray, length: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The best state after every matrix of every run, given the state before it (-1: any) and at its end (-1: the best)."""
    score = np.where((enter[:, None] < 0) | (enter[:, None] == np.arange(STATES)), 0.0, -np.inf)
    back = np.zeros((len(mats), STATES), np.int64)
    for k in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > k)
        each = score[on][:, :, None] + mats[start[on] + k]
        back[start[on] + k], score[on] = each.argmax(1), each.max(1)
    state = np.where(leave < 0, score.argmax(1), leave)
    out = np.zeros(len(mats), np.int64)
    for k in range(int(length.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(length > k)
        out[start[on] + k] = state[on]
        state[on] = back[start[on] + k, state[on]]
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, start, length) of whole groups of sorted batches."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        edge = _edges(t, keys)
        if len(edge) > 1:
            yield _cut(t.slice(0, edge[-1]), edge[:-1])
        held = t.slice(edge[-1])
    if held is not None and held.num_rows:
        yield _cut(held, np.zeros(1, np.int64))


def _edges(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[0] = True
    for c in keys:
        x = t[c].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _cut(t: pa.Table, start: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    return t.combine_chunks(), start, np.diff(np.append(start, t.num_rows))


def _mats(t: pa.Table, column: str) -> np.ndarray:
    return np.array(t[column].combine_chunks().flatten()).reshape(-1, STATES, STATES)


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines of one range partition: adds code, content and the block, BLOCK lines of one transcript each."""
    conv, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        change = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        at = np.arange(len(ids)) - np.repeat(change, np.diff(np.append(change, len(ids))))
        if ids[0] == conv:
            at[ids == conv] += n
        conv, n = ids[-1], int(at[-1]) + 1
        code, text = line_codes(batch.column("line"), batch.column("fresh").to_numpy(zero_copy_only=False).astype(np.int64))
        cut = pc.subtract(pc.utf8_length(batch.column("line")), pc.utf8_length(text).cast(pa.int32()))
        cols = [*[batch.column(c) for c in ("conv_id", "seq", "part")], pa.array(at // BLOCK, pa.int64()), pa.array(at % BLOCK, pa.int32()), pa.array(code.astype(np.int32)), batch.column("line"), cut.cast(pa.int32()), batch.column("blanks")]
        yield pa.RecordBatch.from_arrays(cols, ["conv_id", "seq", "part", "block", "at", "code", "line", "cut", "blanks"])


#: A matrix t from the state before on, and f if nothing stands before.
MATRIX = "t array<double>, f array<double>"


def _matrix_rows(t: pa.Table, start: np.ndarray, mats: list[np.ndarray], keys: tuple[str, ...]) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(np.arange(0, m.size + 1, m[0].size, dtype=np.int32), pa.array(m.ravel())) for m in mats]
    return pa.RecordBatch.from_arrays([*[t[c].combine_chunks().take(pa.array(start)) for c in keys], *lists], [*keys, "t", "f"])


def transfer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes sorted by (conv_id, part, block, at) to a pair of matrices a block."""
    for t, start, length in _runs(batches, ("conv_id", "part", "block")):
        code = t["code"].to_numpy().copy()
        mats = [product(MATRICES[code], start, length)]
        code[start] |= FIRST
        yield _matrix_rows(t, start, [*mats, product(MATRICES[code], start, length)], ("conv_id", "part", "block"))


def part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices sorted by (conv_id, part, block) to a pair a partition."""
    for t, start, length in _runs(batches, ("conv_id", "part")):
        each, first = _mats(t, "t"), _mats(t, "f")
        mats = [product(each, start, length)]
        each[start] = first[start]
        yield _matrix_rows(t, start, [*mats, product(each, start, length)], ("conv_id", "part"))


def border_batches(keys: tuple[str, ...], place: str):
    """Matrices sorted by *keys* and *place*, with the states before (-1: none) and at the end of the group, to those of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start, length in _runs(batches, keys):
            mats, first = _mats(t, "t"), _mats(t, "f")
            enter, leave = (t[c].to_numpy()[start].astype(np.int64) for c in ("enter", "leave"))
            mats[start[enter < 0]] = first[start[enter < 0]]
            state = viterbi(mats, start, length, enter, leave)
            before = np.append(-1, state[:-1])
            before[start] = enter
            yield pa.RecordBatch.from_arrays([*[t[c].combine_chunks() for c in (*keys, place)], pa.array(before.astype(np.int32)), pa.array(state.astype(np.int32))], [*keys, place, "enter", "leave"])

    return run


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes sorted by (conv_id, part, block, at), with their block's borders, to roles and the turns that begin in the block so far."""
    for t, start, length in _runs(batches, ("conv_id", "part", "block")):
        code = t["code"].to_numpy().copy()
        enter, leave = (t[c].to_numpy()[start].astype(np.int64) for c in ("enter", "leave"))
        code[start[enter < 0]] |= FIRST
        state = viterbi(MATRICES[code], start, length, enter, leave)
        before = np.append(-1, state[:-1])
        before[start] = enter
        role = state % len(ROLES)
        marked = (code >> 2 & 3) - 1 == role
        begun = np.cumsum(marked | (state != before))
        begun -= np.repeat(begun[start] - (marked | (state != before))[start], length)
        cols = [*[t[c].combine_chunks() for c in ("conv_id", "part", "block", "at")], pa.array(ROLES).take(pa.array(role)), pa.array(marked), pa.array(begun, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["conv_id", "part", "block", "at", "role", "marked", "begun"])


def recover_roles(lines: DataFrame) -> DataFrame:
    """(conv_id, seq, turn, role, marked, content, blanks, part, block, at) from (conv_id, seq, line, fresh) and, if there is one, blanks.

    Lines are ordered by seq (of any type that sorts; ties by text); fresh tells
    that a piece or a paragraph begins, a paragraph where blanks, the number of
    blank lines before it in its piece, is known.  turn counts from 0 within a
    transcript; marked tells that the line had a marker of its role, which
    content goes without; part, block and at give the line's place.

    * null or empty lines are lines without a marker, null fresh is false;
    * null conv_id or seq are left out;
    * very long lines count as long ones, very long transcripts lie in many blocks;
    * repeated rows are lines of their own;
    * an empty table gives an empty result; further columns are ignored.
    """
    spark = lines.sparkSession
    ship(spark)
    blanks = (F.col("blanks") if "blanks" in lines.columns else F.lit(None)).cast("int")
    fresh = F.when(F.coalesce("fresh", F.lit(False)), F.when(blanks.isNull(), 2).otherwise(1)).otherwise(0)
    base = lines.where("conv_id is not null and seq is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "seq", F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"), fresh.alias("fresh"), F.coalesce(blanks, F.lit(0)).alias("blanks"))
    kind = base.schema["seq"].dataType.simpleString()
    keys = ["conv_id", "part", "block"]

    def sent(df: DataFrame, n: int, *order: str) -> DataFrame:
        return df.repartition(*keys[:n]).sortWithinPartitions(*keys[:n], *order)

    with Scratch(spark) as scratch:
        ranged = base.repartitionByRange("conv_id", "seq", "line").sortWithinPartitions("conv_id", "seq", "line").withColumn("part", F.spark_partition_id().cast("long"))
        table = scratch.keep(ranged.mapInArrow(block_batches, f"conv_id long, seq {kind}, part long, block long, at int, code int, line string, cut int, blanks int"), "lines")
        codes = table.select(*keys, "at", "code")
        blocks = scratch.put(sent(codes, 3, "at").mapInArrow(transfer_batches, f"conv_id long, part long, block long, {MATRIX}"), "blocks")
        parts = scratch.put(sent(blocks, 2, "block").mapInArrow(part_batches, f"conv_id long, part long, {MATRIX}"), "parts")
        # from the top down: a transcript's partitions, a partition's blocks, a block's lines
        ends = "enter int, leave int"
        top = sent(parts.withColumns({"enter": F.lit(-1), "leave": F.lit(-1)}), 1, "part").mapInArrow(border_batches(("conv_id",), "part"), f"conv_id long, part long, {ends}")
        inner = sent(blocks.join(top, keys[:2]), 2, "block").mapInArrow(border_batches(("conv_id", "part"), "block"), f"conv_id long, part long, block long, {ends}")
        roles = scratch.keep(sent(codes.join(inner, keys), 3, "at").mapInArrow(decode_batches, "conv_id long, part long, block long, at int, role string, marked boolean, begun long"), "roles")
        # turns begun before a block: in earlier partitions, and in earlier blocks of its own
        counts = roles.groupBy(*keys).agg(F.max("begun").alias("n"))
        ahead = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(keys[len(by)]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = counts.groupBy("conv_id", "part").agg(F.sum("n").alias("n")).select("conv_id", "part", ahead("conv_id").alias("before"))
        counts = scratch.keep(counts.withColumn("inside", ahead("conv_id", "part")).join(sums, keys[:2]).select(*keys, (F.col("before") + F.col("inside") - 1).alias("turn")), "counts")
    numbered = roles.join(counts, keys).withColumn("turn", F.col("turn") + F.col("begun"))
    content = F.when(F.col("marked"), F.expr("substring(line, cut + 1)")).otherwise(F.col("line"))
    return table.drop("code").join(numbered, [*keys, "at"]).select("conv_id", "seq", "turn", "role", "marked", content.alias("content"), "blanks", *keys[1:], "at")


def lines_of(transcripts: DataFrame, conv_col: str = "conv_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(conv_id, seq, line, fresh, blanks) of transcripts, blank lines counted and taken out; seq is a struct (piece, line).

    A transcript is one text, or several pieces in the order of *order_col* with
    a blank line between them; blanks is null where a piece begins.

    * null or empty text, or one of blanks only: no lines; null ids stay;
    * very long texts are split in lines like others;
    * null order counts as before all others, ties are told apart by nothing;
    * an empty table gives an empty result; further columns are ignored.
    """
    piece = F.coalesce(F.col(f"`{order_col}`").cast("long"), F.lit(-(1 << 62))) if order_col else F.lit(0).cast("long")
    text = F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"\r?\n")
    rows = transcripts.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), piece.alias("piece"), text.alias("all"))
    blank = lambda x: F.trim(x) == ""
    rows = rows.withColumn("some", F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: ~blank(F.get("all", i))))
    told = F.transform("some", lambda i, k: F.struct(i.alias("i"), F.get("all", i).alias("line"), F.when(k > 0, i - F.get("some", k - 1) - 1).alias("blanks")))
    each = rows.select("conv_id", "piece", F.explode(told).alias("l"))
    return each.select("conv_id", F.struct("piece", F.col("l.i").alias("line")).alias("seq"), "l.line", F.coalesce(F.col("l.blanks") > 0, F.lit(True)).alias("fresh"), "l.blanks")


def turns_of(roles: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_lines, content) from ``recover_roles``: a turn's lines in one text, with the blank lines between them; it has to fit in a row."""
    place = ("part", "block", "at")
    parts = roles.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct(*place, "blanks", "content"))).alias("parts"))
    spaced = F.transform("parts", lambda p, k: F.when(k > 0, F.concat(F.repeat(F.lit("\n"), p["blanks"]), p["content"])).otherwise(p["content"]))
    return parts.select("conv_id", "turn", "role", F.size("parts").alias("n_lines"), F.array_join(spaced, "\n").alias("content"))


def render(turns: DataFrame) -> DataFrame:
    """The turns with the column rendered: their canonical form.

    Null content counts as empty; other columns stay, a column rendered is replaced.
    """
    return turns.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.coalesce("content", F.lit("")), F.lit("\n<|end|>")))
