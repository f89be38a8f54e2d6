"""Near-duplicate detection by circulant MinHash, banding and exact verification.

Two fixed permutations make all signature coordinates: one scatters the shingle
slots, the other is shifted circularly by 0, 1, 2, ... to give coordinate 0, 1,
2, ...  Coordinates are grouped in bands; documents that agree on a band share a
bucket.  Buckets only propose links: each link is confirmed by the exact Jaccard
similarity of the two whole shingle sets.

How it stays linear on hot groups
---------------------------------
* Documents with equal shingle sets are one class from the start (a grouped
  minimum over a 128-bit set fingerprint), so copies are never paired.
* Round 1 proposes one partner per class: the least member of the buckets it
  shares most often.  Verified links are contracted to components.
* Round 2 looks at buckets that still hold several components.  A bucket's
  largest component meets the members of the others, and those meet each other,
  in blocks of bounded size; pairs within a component are never formed.  A pair
  goes on to exact verification unless its sizes or its histograms rule the link
  out.  Both are bounds, not estimates: shingles are counted in 1,024 cells, and
  the sum of the lesser counts is never below the intersection.  If two
  components have many such pairs in a block, the best few go first; round 3
  takes what contraction left.
* Buckets, and documents that stand in many pairs, are hot keys of joins: they
  are split (``rows.meet``, ``rows.split_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.kernels import mix64, slices
from tickloom.llm.minhash_kernel import band_keys, shingle_hashes, signatures
from tickloom.llm.rows import meet, split_join
from tickloom.llm.scratch import Scratch, ship

#: Members that one block of a bucket holds: of its largest component, and of the others.
MAIN_BLOCK, REST_BLOCK = 4096, 512
#: Cells of a set's histogram, one byte each; a full cell bounds nothing.
CELLS, FULL = 1024, 255
#: Pairs of one pair of components that a block passes on before contraction.
FIRST_PAIRS = 16


def set_prints(unique: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit prints of a set of hashes."""
    with np.errstate(over="ignore"):
        a = mix64(unique).sum(dtype=np.uint64) + np.uint64(len(unique))
        b = mix64(unique ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def fingerprint_batches(width: int, bands: int, rows: int):
    """Batches (doc_id, text) to (doc_id, n, f1, f2, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in slices(batch.column("text")):
                hashes, begin = shingle_hashes(raw, offsets, width)
                key = band_keys(signatures(hashes, begin, bands * rows), rows).view(np.int64)
                n, f1, f2 = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for x in range(j - i):
                    unique = np.unique(hashes[begin[x] : begin[x + 1]])
                    n[x] = len(unique)
                    if len(unique):
                        f1[x], f2[x] = set_prints(unique)
                lists = pa.ListArray.from_arrays(np.arange(0, key.size + 1, bands, dtype=np.int32), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), pa.array(f1), pa.array(f2), lists], ["doc_id", "n", "f1", "f2", "bands"])

    return run


def histogram(unique: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall in each cell, FULL at most."""
    cell = (unique & np.uint64(CELLS - 1)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=CELLS), FULL).astype(np.uint8)


KEPT = "rep long, h long, n long, keys binary, cells binary, text string"


def sketch_batches(width: int, bands: int, rows: int):
    """Rows (rep, f1, f2, text) to KEPT where the text's set has the prints: its size, band keys and histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f1, f2 = batch.column("f1").to_numpy(), batch.column("f2").to_numpy()
            for i, j, raw, offsets in slices(batch.column("text")):
                hashes, begin = shingle_hashes(raw, offsets, width)
                sets = [np.unique(hashes[begin[x] : begin[x + 1]]) for x in range(j - i)]
                own = np.array([set_prints(u) == (f1[i + x], f2[i + x]) for x, u in enumerate(sets)], bool)
                keys = band_keys(signatures(hashes, begin, bands * rows), rows)
                cols = [
                    batch.column("rep").slice(i, j - i), batch.column("f1").slice(i, j - i), pa.array([len(u) for u in sets], pa.int64()), pa.array([x.tobytes() for x in keys], pa.binary()),
                    pa.array([histogram(u).tobytes() for u in sets], pa.binary()), batch.column("text").slice(i, j - i),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["rep", "h", "n", "keys", "cells", "text"]).filter(pa.array(own))

    return run


def verify_batches(width: int, numerator: int, denominator: int):
    """Rows (a, b, h, text_a, text_b) to the (a, b) whose sets pass the threshold; h tells the texts of b apart."""

    def unique(text: pa.Scalar) -> np.ndarray:
        raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
        return np.unique(shingle_hashes(raw, np.array([0, len(raw)]), width)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, its = None, None
        for batch in batches:
            out_a, out_b = [], []
            ids = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "h")), strict=True)
            for k, (a, b, h) in enumerate(ids):
                if held != (b, h):
                    held, its = (b, h), unique(batch.column("text_b")[k])
                mine = unique(batch.column("text_a")[k])
                both = len(np.intersect1d(mine, its, assume_unique=True))
                if both and denominator * both >= numerator * (len(mine) + len(its) - both):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def possible(cells: np.ndarray, size: np.ndarray, one: np.ndarray, n: int, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets (histograms *cells*, sizes *size*) may be linked to the set (*one*, *n*), and the bound on what they share."""
    most = np.minimum(cells, one).sum(1, dtype=np.int64)
    most[(cells == FULL).any(1) | (one == FULL).any()] = np.iinfo(np.int64).max >> 8
    return (denominator + numerator) * most >= numerator * (size + n), most


def close_pairs(t: dict[str, np.ndarray], key: int, across: bool, numerator: int, denominator: int, first: int | None):
    """Index pairs of different components in one block of bucket *key* that may be linked.

    *t* holds rep, comp, n (set size), rest (not of the largest component), bi
    (block), keys (all band keys) and cells.  A pair that shares several buckets
    counts in the one of its first common band only.  With *across* only pairs
    of two blocks are formed.  With *first*, at most that many of a pair of
    components, best first; the flag says whether any were left.
    """
    comp, size, side, keys, cells = t["comp"], t["n"], t["side"], t["keys"], t["cells"]
    found, more = [], False
    few = np.flatnonzero(side == 1)
    for at, i in enumerate(few.tolist()):
        # within one block every pair once; across blocks the other block's rows
        rest = np.flatnonzero(side == 0) if across else few[at + 1 :]
        rest = rest[(comp[rest] != comp[i]) & (numerator * np.maximum(size[rest], size[i]) <= denominator * np.minimum(size[rest], size[i]))]
        if len(rest):
            common = keys[rest] == keys[i]
            rest = rest[keys[i][common.argmax(1)] == key]
        if len(rest):
            ok, most = possible(cells[rest], size[rest], cells[i], int(size[i]), numerator, denominator)
            found += zip([i] * int(ok.sum()), rest[ok].tolist(), (most[ok] / (size[rest[ok]] + size[i])).tolist(), strict=True)
    if first is not None and len(found) > first:
        kept: dict[tuple[int, int], int] = {}
        chosen = []
        for i, j, s in sorted(found, key=lambda x: (-x[2], t["rep"][x[0]], t["rep"][x[1]])):
            pair = (min(comp[i], comp[j]), max(comp[i], comp[j]))
            kept[pair] = kept.get(pair, 0) + 1
            if kept[pair] <= first:
                chosen.append((i, j, s))
            else:
                more = True
        found = chosen
    return found, more


def block_batches(numerator: int, denominator: int, first: int | None):
    """Rows sorted by (key, bi, bj) to candidate pairs (a, b, more)."""

    def pairs(group: list[pa.RecordBatch]):
        t = pa.Table.from_batches(group)
        cols = {c: t[c].to_numpy() for c in ("rep", "comp", "n", "side")}
        if len(cols["comp"]) < 2 or cols["comp"].min() == cols["comp"].max():
            return
        cols["cells"] = np.frombuffer(b"".join(t["cells"].to_pylist()), np.uint8).reshape(-1, CELLS)
        cols["keys"] = np.frombuffer(b"".join(t["keys"].to_pylist()), np.int64).reshape(len(cols["comp"]), -1)
        rep = cols["rep"]
        found, more = close_pairs(cols, t["key"][0].as_py(), t["bi"][0].as_py() != t["bj"][0].as_py(), numerator, denominator, first)
        for i, j, _ in found:
            yield max(rep[i], rep[j]), min(rep[i], rep[j]), more

    def emit(rows: list) -> pa.RecordBatch:
        a, b, m = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.bool_())], ["a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "bi", "bj")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            rows, edges = [], [0, *change.tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                name = tuple(int(c[s]) for c in cols)
                if name != held:
                    if group:
                        rows += pairs(group)
                    group, held = [], name
                group.append(batch.slice(s, e - s))
            yield emit(rows)
        if group:
            yield emit(list(pairs(group)))

    return run


def blocks_of(placed: DataFrame) -> DataFrame:
    """(key, rep, comp, bi, bj, side) of the block pairs in which members (key, rep, comp) of different components meet.

    A bucket's largest component is cut in blocks 0, 1, ..., its other members
    in blocks -1, -2, ....  Each of the latter meets all of the former and each
    other: bi is the block of the side 1, bj the other one.
    """
    counts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("cnt"), F.count("*").alias("k")).where("k > 1")
    mixed = mixed.select("key", "cnt", F.col("m.comp").alias("main"), F.ceil(F.col("m.c") / MAIN_BLOCK).cast("int").alias("mains"), F.ceil((F.col("cnt") - F.col("m.c")) / REST_BLOCK).cast("int").alias("rests"))
    at = meet(placed, mixed, "key", "cnt").withColumn("is_main", F.col("comp") == F.col("main"))
    at = at.withColumn("mine", F.when(F.col("is_main"), F.pmod(F.xxhash64("rep"), F.col("mains"))).otherwise(-1 - F.pmod(F.xxhash64("rep"), F.col("rests"))).cast("int"))
    block = lambda bi, bj, side: F.struct(bi.cast("int").alias("bi"), bj.cast("int").alias("bj"), F.lit(side).alias("side"))
    mine = F.col("mine")
    main = F.transform(F.sequence(F.lit(-1), -F.col("rests")), lambda o: block(o, mine, 0))
    rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda o: block(mine, o, 1)),
        # of two blocks of others the later one is side 1
        F.transform(F.sequence(F.lit(-1), -F.col("rests")), lambda o: F.when(o < mine, block(o, mine, 0)).otherwise(block(mine, o, 1))),
    )
    return at.withColumn("b", F.explode(F.when(F.col("is_main"), main).otherwise(rest))).select("key", "rep", "comp", "b.bi", "b.bj", "b.side")


def near_duplicates(
    documents: DataFrame,
    *,
    width: int = 3,
    numerator: int = 85,
    denominator: int = 100,
    bands: int = 16,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept), one row per input row.

    Two documents are linked if ``denominator * |A & B| >= numerator * |A | B|``
    over their sets of *width*-word shingles; component_id is the least id
    reachable over links, kept marks that document.

    * null or empty text, or text without words: n_shingles 0, linked with nothing;
    * fewer words than *width*: the whole sequence is the one shingle;
    * repeated rows: one result row each, in the same component; different texts
      under one id: each row goes with the rows of its own set, and sets whose
      least id is the same are one node, linked by any of its texts;
    * null id: component_id and kept are null, the row takes no part in links;
    * an empty table gives an empty result; further columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        prints = scratch.put(docs.mapInArrow(fingerprint_batches(width, bands, rows), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "prints")
        classes = scratch.put(
            prints.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "bands")).alias("m")).select("f1", "f2", F.col("m.doc_id").alias("rep"), "m.bands"),
            "classes",
        )
        places = scratch.put(classes.select("rep", F.explode("bands").alias("key")), "places")
        shared = places.groupBy("key").agg(F.count("*").alias("cnt"), F.min("rep").alias("pivot")).where("cnt > 1")
        members = scratch.put(meet(places, shared, "key", "cnt").select("key", "rep", "pivot"), "members")
        # the texts of classes that share a bucket, equal ones once; the least id of a class may stand on other texts too
        wanted = classes.select("rep", "f1", "f2").join(members.select("rep").distinct(), "rep")
        texts = docs.join(wanted, F.col("doc_id") == F.col("rep")).groupBy("rep", "f1", "f2", F.xxhash64("text")).agg(F.first("text").alias("text"))
        texts = scratch.put(texts.select("rep", "f1", "f2", "text").mapInArrow(sketch_batches(width, bands, rows), KEPT), "texts")

        def verified(pairs: DataFrame, name: str) -> DataFrame:
            pairs = scratch.put(pairs.select("a", "b"), f"{name}-pairs")
            for c in ("a", "b"):
                side = texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"), *([F.col("h")] if c == "b" else []))
                pairs = split_join(pairs, side, c, scratch, f"{name}-{c}")
            joined = pairs.select("a", "b", "h", "text_a", "text_b")
            return scratch.put(joined.mapInArrow(verify_batches(width, numerator, denominator), "a long, b long"), name)

        votes = members.where("pivot < rep").groupBy("rep", "pivot").agg(F.count("*").alias("votes"))
        best = votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("p"))).alias("m")).select(F.col("rep").alias("a"), (-F.col("m.p")).alias("b"))
        links = verified(best, "links1")
        for step, first in ((2, FIRST_PAIRS), (3, None)):
            comp = scratch.put(components(links, scratch, f"cc{step}"), f"comp{step}")
            placed = members.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
            tasks = blocks_of(scratch.put(placed, f"placed{step}"))
            tasks = tasks.join(texts.select("rep", "n", "keys", "cells"), "rep").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "rep")
            found = scratch.put(tasks.mapInArrow(block_batches(numerator, denominator, first), "a long, b long, more boolean"), f"found{step}")
            more = found.groupBy("a", "b").agg(F.max("more").alias("more"))
            any_found, any_more = found.agg(F.count("*") > 0, F.coalesce(F.max("more"), F.lit(False))).first()
            if any_found:
                links = links.unionByName(verified(more, f"links{step}"))
            if not any_more:
                break
        comp = components(links, scratch, "cc-end") if any_found else comp
        roots = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
        linked = prints.where("n > 0 and doc_id is not null").select("doc_id", "n", "f1", "f2").join(roots, ["f1", "f2"])
        alone = prints.where("n = 0 or doc_id is null").select("doc_id", "n", F.when(F.col("n") >= 0, F.col("doc_id")).alias("component_id"))
        out = linked.select("doc_id", "n", "component_id").unionByName(alone)
        return scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")), "result")
