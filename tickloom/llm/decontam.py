"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: numbers, names and units turn into
typed placeholders ('3kg' into two), other words are lower-cased.  Windows of canonical tokens of
all documents are joined by hash with the windows of the benchmark's items, and
a chain of windows at one offset counts as a copy of the item only if the
placeholders' fillings correspond one to one (equal for a plain copy, changed
throughout alike for a re-parameterised question).

The windows of the documents never travel: bit maps of the benchmark's windows
and of their beginnings (bounded, whatever the benchmark's size) go with the
scan.  A window is hashed as long as its beginning is one of the benchmark's,
and only windows whose bit is set come out, with their fillings, for the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.kernels import mix64, runs, slices, span_hash
from tickloom.llm.rows import split_join
from tickloom.llm.scratch import Scratch, ship

_U64 = np.uint64
#: Most bits of a map that goes with the scan are 2^MAP_BITS, sent in pages of so many bytes.
MAP_BITS, PAGE = 27, 4096
#: Windows a joined table may hold to be sent to every task.
SMALL_WINDOWS = 200_000
#: Places whose windows grow together.
BLOCK = 1 << 14

#: Words that count as units when a number stands before them.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "kmh mph hz khz mhz ghz w kw v a k c f kb mb gb tb dollar dollars euro euros pound pounds cent cents percent usd eur gbp meter meters metre metres "
    "kilometer kilometers gram grams kilogram kilograms liter liters litre litres inch inches foot feet mile miles"
).split()

NUM, NAME, UNIT = (int(x) for x in mix64(np.array([101, 102, 103], _U64)))
_MARKS = np.array([NUM, NAME, UNIT], _U64)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_JOIN = np.zeros(256, bool)
_JOIN[[44, 46]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63, 10, 13, 34]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9]] = True


def lowered(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case (ASCII and the two-byte Latin capitals), and where capitals stood."""
    upper = (raw >= 65) & (raw <= 90)
    if len(raw) > 1:
        upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out = raw.copy()
    out[upper] += 32
    return out, upper


def _split_units(low: np.ndarray, numeric: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Starts, ends and hashes of the tokens, a number with a unit at its end ('3kg') as two."""
    other = np.append(np.flatnonzero(~numeric), len(low))
    cut = other[np.searchsorted(other, starts)] if len(starts) else starts
    glued = np.flatnonzero((cut > starts) & (cut < ends))
    cut = cut[glued]
    hashes = span_hash(low, np.concatenate([starts, starts[glued], cut]), np.concatenate([ends, cut, ends[glued]]))
    plain, heads, tails = np.split(hashes, [len(starts), len(starts) + len(glued)])
    unit = np.isin(tails, _UNIT_HASHES)
    glued, cut = glued[unit], cut[unit]
    plain[glued] = heads[unit]
    tail_ends = ends[glued]
    ends = ends.copy()
    ends[glued] = cut
    return np.insert(starts, glued + 1, cut), np.insert(ends, glued + 1, tail_ends), np.insert(plain, glued + 1, tails[unit])


def canonical(raw: np.ndarray, offsets: np.ndarray):
    """Canonical token hashes, plain hashes, starts, ends, first token of each document, tokens that may be names."""
    inside = _WORD[raw]
    if len(raw) > 2:
        inside[1:-1] |= _JOIN[raw[1:-1]] & _DIGIT[raw[:-2]] & _DIGIT[raw[2:]]
    low, upper = lowered(raw)
    numeric = _DIGIT[raw] | (_JOIN[raw] & inside)
    starts, ends, plain = _split_units(low, numeric, *runs(inside, offsets))
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return plain, plain, starts, ends, first, np.zeros(0, bool)
    digits, capitals = np.zeros(len(raw) + 1, np.int32), np.zeros(len(raw) + 1, np.int32)
    np.cumsum(numeric, out=digits[1:])
    np.cumsum(upper, out=capitals[1:])
    number = digits[ends] - digits[starts] == ends - starts
    lead = upper[starts] | ((raw[starts] == 0xC3) & upper[np.minimum(starts + 1, len(raw) - 1)])
    title = lead & (capitals[ends] - capitals[starts] == 1) & (ends - starts > 1)
    # a capital opens a sentence after a stop, a line end or the text's start
    opens = np.zeros(len(starts), bool)
    opens[first[:-1][first[:-1] < len(starts)]] = True
    stops = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(_STOP[raw], out=stops[1:])
    opens[1:] |= stops[starts[1:]] - stops[ends[:-1]] > 0
    name = title & ~opens & ~number
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & np.isin(plain[1:], _UNIT_HASHES)
    unit[first[:-1][first[:-1] < len(starts)]] = False
    canon = plain.copy()
    canon[number], canon[name], canon[unit] = _U64(NUM), _U64(NAME), _U64(UNIT)
    return canon, plain, starts, ends, first, title & opens & ~number & ~unit


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends = runs(raw != 32, np.array([0, len(raw)]))
    return np.unique(span_hash(raw, starts, ends))


_UNIT_HASHES = _unit_hashes()


def readings(canon: np.ndarray, maybe: np.ndarray, last: np.ndarray, widths: list[int], begun=None):
    """(width, places, masks, hashes) of the windows' readings: a token that may be a name as word and as name (its bit set).

    Windows grow token by token from every place; *last* is where the place's
    document ends.  A reading whose beginning *begun* (a test of hashes) does
    not know is given up, so what is followed are the beginnings some item has,
    however many tokens may be names.
    """
    longest = max(widths)
    for block in range(0, len(canon), BLOCK):
        at = np.arange(block, min(block + BLOCK, len(canon)))
        mask, state = np.zeros(len(at), np.int64), np.zeros(len(at), _U64)
        for k in range(longest):
            inside = at + k < last[at]
            at, mask, state = at[inside], mask[inside], state[inside]
            token, both = canon[at + k], np.flatnonzero(maybe[at + k])
            token = np.concatenate([token, np.full(len(both), NAME, _U64)])
            at, mask, state = np.concatenate([at, at[both]]), np.concatenate([mask, mask[both] | 1 << k]), np.concatenate([state, state[both]])
            state = mix64(state * _U64(0x9DDFEA08EB382D69) + token + _U64(k + 1))
            if k + 1 in widths:
                yield k + 1, at, mask, state + _U64(k + 1)
            if begun is not None and k + 1 < longest:
                going = begun(state)
                at, mask, state = at[going], mask[going], state[going]
            if not len(at):
                break


def _slots(canon, starts, ends, low, at, masks, width, first="?") -> list[list[str]]:
    """Fillings of the windows' placeholders as 'place:type:text'; those of the mask are flagged, place 0 by *first*."""
    kinds = {NUM: "n", NAME: "p", UNIT: "u"}
    out = []
    for i, mask in zip(at.tolist(), masks.tolist(), strict=True):
        row = []
        for k in range(width):
            read = mask >> k & 1
            kind = "p" if read else kinds.get(int(canon[i + k]))
            if kind:
                flag = "" if not read else first if i + k == 0 else "?"
                row.append(f"{k}{flag}:{kind}:{low[starts[i + k] : ends[i + k]].tobytes().decode('utf-8', 'replace')}")
        out.append(row)
    return out


def _batch(ids, keys, places, slots, extra=None) -> pa.RecordBatch:
    cols = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(slots, pa.list_(pa.string()))]
    names = ["id", "win", "place", "slots"]
    if extra is not None:
        cols.append(pa.array(extra, pa.int32()))
        names.append("n_windows")
    return pa.RecordBatch.from_arrays(cols, names)


def item_readings(batches: Iterator[pa.RecordBatch], width: int, least: int, begun=None):
    """(id, tokens as canonical returns them, lower-case bytes, flag of the first word, width, places, masks, hashes) for the windows of each item.

    An item shorter than *width* is one window of its own length.  Inside a
    document its first word may look like a name: flag 'x' if it does not here.
    """
    for batch in batches:
        ids = batch.column("id").to_pylist()
        for i, j, raw, offsets in slices(batch.column("text")):
            canon, _, starts, ends, first, maybe = canonical(raw, offsets)
            low = lowered(raw)[0]
            for x in range(j - i):
                a, b = int(first[x]), int(first[x + 1])
                if b == a or ids[i + x] is None:
                    continue
                own, may = canon[a:b], maybe[a:b].copy()
                fixed = np.isin(own, _MARKS)
                flag = "?" if may[0] else "x"
                may[0] |= not fixed[0]
                for w, at, masks, keys in readings(own, may, np.full(b - a, b - a), [min(width, b - a)], begun):
                    if b - a < least:
                        some = np.array([not all(fixed[k] or m >> k & 1 for k in range(w)) for m in masks.tolist()], bool)
                        at, masks, keys = at[some], masks[some], keys[some]
                    if len(at):
                        yield ids[i + x], (own, starts[a:b], ends[a:b]), low, flag, w, at, masks, keys


def item_batches(width: int, least: int):
    """Windows of benchmark items.  Flagged '?' are names that open a sentence and may be words, 'x' as item_readings tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tokens, low, flag, w, at, masks, keys in item_readings(batches, width, least):
            n = len(tokens[0]) - w + 1
            yield _batch([key] * len(at), keys.view(np.int64), at, _slots(*tokens, low, at, masks, w, flag), [n] * len(at))

    return run


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a map of a power of two of bits."""
    slot = hashes >> _U64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[slot >> _U64(3)] >> (slot & _U64(7)).astype(np.uint8) & 1).astype(bool)


def map_batches(width: int, least: int, sizes: tuple[int, int]):
    """Pages of two bit maps of the items, of 2^size bits: 0 the windows, 1 the windows' beginnings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.zeros(1 << (size - 3), np.uint8) for size in sizes]

        def note(which: int, hashes: np.ndarray) -> np.ndarray:
            slot = hashes >> _U64(64 - sizes[which])
            np.bitwise_or.at(maps[which], slot >> _U64(3), np.left_shift(np.uint8(1), (slot & _U64(7)).astype(np.uint8)))
            return np.ones(len(hashes), bool)

        for *_, keys in item_readings(batches, width, least, lambda state: note(1, state)):
            note(0, keys)
        for which, bits in enumerate(maps):
            pages = bits.reshape(-1, PAGE)
            some = np.flatnonzero(pages.any(1)).tolist()
            rows = [pa.array([which] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([pages[p].tobytes() for p in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, ["which", "page", "bits"])

    return run


def one_page(table: pa.Table) -> pa.Table:
    """The tasks' versions of a page in one."""
    bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
    return pa.table({"which": table.column("which")[:1], "page": table.column("page")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})


def bit_maps(items: DataFrame, width: int, least: int, n: int) -> list[np.ndarray]:
    """The maps for items of *n* windows: 16 bits a window and a beginning up to MAP_BITS, at most 2 * 16 MB."""
    sizes = tuple(min(MAP_BITS, max(18, (16 * x).bit_length())) for x in (n, n * width))
    maps = [np.zeros(1 << (size - 3), np.uint8) for size in sizes]
    pages = items.mapInArrow(map_batches(width, least, sizes), "which int, page int, bits binary").groupBy("which", "page").applyInArrow(one_page, "which int, page int, bits binary")
    for row in pages.toLocalIterator():
        maps[row["which"]][row["page"] * PAGE :][:PAGE] = np.frombuffer(row["bits"], np.uint8)
    return maps


def hit_batches(maps: list[bytes], widths: list[int], least: int):
    """Windows of documents whose bit is set in the map; of fewer than *least* tokens only whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, begins = (np.frombuffer(m, np.uint8) for m in maps)
        for batch in batches:
            ids = batch.column("id")
            for i, j, raw, offsets in slices(batch.column("text")):
                canon, _, starts, ends, first, maybe = canonical(raw, offsets)
                low = None
                names = ids.slice(i, j - i).to_numpy(zero_copy_only=False)
                last = np.repeat(first[1:], np.diff(first))
                for w, at, masks, keys in readings(canon, maybe, last, widths, lambda state: _known(begins, state)) if widths else ():
                    fits = _known(windows, keys)
                    at, masks, keys = at[fits], masks[fits], keys[fits]
                    doc = np.searchsorted(first, at, "right") - 1
                    if w < least:
                        whole = (at == first[doc]) & (at + w == first[doc + 1])
                        at, masks, keys, doc = at[whole], masks[whole], keys[whole], doc[whole]
                    if len(at):
                        low = lowered(raw)[0] if low is None else low
                        yield _batch(names[doc].tolist(), keys.view(np.int64), at - first[doc], _slots(canon, starts, ends, low, at, masks, w, "?"))

    return run


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    width: int = 8,
    least: int = 5,
    share: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, n_slots, verbatim): documents that hold an item.

    A document holds an item if, at one offset, at least ``share`` of the item's
    windows of *width* canonical tokens match and the fillings of their
    placeholders correspond one to one; verbatim tells that they are equal.

    * null or empty texts and items match nothing; items shorter than *width*
      are one window as a whole, and those of fewer than *least* tokens are held
      only by a document that is nothing else and share a word with it; with
      ``least=1`` they are looked for inside documents, too, placeholders or not;
    * a capital that opens a sentence is read both as a word and as a name;
    * numbers are of ASCII digits and names open with a Latin capital; other words, of any script, are words;
    * null ids of documents or items are left out;
    * repeated rows: ids that repeat give one result row; several items, or one
      item at several offsets, give a row per item (the best offset);
    * empty tables give an empty result; further columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    with Scratch(spark) as scratch:
        windows = scratch.put(items.mapInArrow(item_batches(width, least), "id long, win long, place int, slots array<string>, n_windows int"), "windows")
        n = windows.count()
        maps = [m.tobytes() for m in bit_maps(items, width, least, n)]
        short = [r["w"] for r in items.mapInArrow(_widths(width), "w int").distinct().collect()]
        hits = docs.mapInArrow(hit_batches(maps, sorted(short), least), "id long, win long, place int, slots array<string>")
        known = windows.select(F.col("id").alias("item_id"), "win", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), "n_windows")
        if n <= SMALL_WINDOWS:
            matched = hits.join(F.broadcast(known), "win")
        else:
            # a passage that many documents share is one hot window after another
            matched = split_join(scratch.put(hits, "hits"), known, "win", scratch, "hot")
        matched = matched.withColumn("offset", F.col("place") - F.col("item_place"))
        # what opens a sentence on both sides is a word if it is equal; a plain first word is no name by standing where sentences open
        flag = lambda c: F.regexp_extract(c, "^[0-9]+([?x]?):", 1)
        pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(F.substring_index(a, ":", -2).alias("i"), F.substring_index(b, ":", -2).alias("d"), F.concat(flag(a), flag(b)).alias("f")))
        plain = lambda c: F.transform(F.filter(c, lambda p: (p["f"] != "??") | (p["i"] != p["d"])), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))
        # an occurrence is as long as its item; its slots are no more than its tokens
        found = (
            matched.withColumn("pairs", pairs)
            .where(~F.exists("pairs", lambda p: p["f"] == "x?"))
            .withColumn("pairs", plain("pairs"))
            .groupBy("id", "item_id", "offset")
            .agg(F.countDistinct("item_place").alias("windows"), F.first("n_windows").alias("item_windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
            .withColumn("n_slots", F.size("pairs"))
            .where(F.col("windows") >= F.ceil(F.col("item_windows") * F.lit(share)))
            .where(F.size(F.array_distinct(F.col("pairs.i"))) == F.col("n_slots"))
            .where(F.size(F.array_distinct(F.col("pairs.d"))) == F.col("n_slots"))
            .withColumn("verbatim", F.forall("pairs", lambda p: p["i"] == p["d"]))
        )
        best = found.groupBy("id", "item_id").agg(F.max(F.struct("windows", "verbatim", "item_windows", "n_slots")).alias("m"))
        return scratch.keep(best.select(F.col("id").alias("doc_id"), "item_id", "m.windows", "m.item_windows", "m.n_slots", "m.verbatim"), "found")


def _widths(width: int):
    """Distinct window widths that the items need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, offsets in slices(batch.column("text")):
                first = canonical(raw, offsets)[4]
                seen |= {min(width, int(n)) for n in np.diff(first) if n}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["w"])

    return run


def without_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns, that hold no item of the benchmark; null ids stay."""
    from tickloom.llm.rows import without_ids

    return without_ids(documents, contaminated(documents, benchmark, **options).select("doc_id").distinct(), options.get("id_col", "doc_id"))
