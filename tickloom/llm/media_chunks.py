"""Media columns in a content-defined chunk store.

A document's payload (its UTF-8 bytes, padded) is stored as an 8-bit grey image
file, which a rolling gear hash cuts into chunks.  Chunk digests are deduplicated
by Spark joins; the ordered list of digests rebuilds the file, whose chunks and
payload are verified before features are computed from the samples.

What moves.  The first scan makes the catalogue: sizes, the payload's digest and
the chunk list of every row, no bytes.  Joining its chunk lists with the chunks
that several payloads have tells every payload which of its chunks are common
and which of them it owns (the owner is the payload least by digest).  The
second scan brings each payload, compressed, to these decisions, equal payloads
collapsing before the shuffle, and the store is written: per payload one pack of
the chunks only it has, and the common chunks it owns.  Every chunk is stored
once, at every size of the input.  A bit map of bounded size tells most payloads
that nothing has to be decided about them (no copy, no common chunk); these are
written where they are read.  A bit set by another payload only sends one to the
joins, as all are if the map is full.  The store is bucketed by the payload's digest,
so packs stay where they are when they are read back, which joins the common chunks to the
other payloads that use them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tickloom.llm.kernels import mix64, slices
from tickloom.llm.rows import meet
from tickloom.llm.scratch import Scratch, ship

_U32, _U64 = np.uint32, np.uint64
UNIT = 576
SIDE = 24
LEAST, MASK_BITS, MOST = 256, 10, 4096
#: Bits of the map of payloads to decide on, at most.
MOST_BITS = 26

_GEAR = (mix64(np.arange(1, 257, dtype=_U64) * _U64(0x2545F4914F6CDD1D)) >> _U64(32)).astype(_U32)


def payload_of(text: bytes) -> bytes:
    """*text* and bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def media_of(payload: bytes) -> bytes:
    """The payload as a binary grey map, 24 samples wide."""
    return b"P5\n%d %d\n255\n" % (SIDE, len(payload) // SIDE) + payload


def samples_of(media: bytes) -> bytes:
    """The samples of a grey map as written by ``media_of``."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a grey map of 8-bit samples")
    return samples


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks of one media file; every cut depends on the 32 bytes before it."""
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # sum of gear << age over 32 bytes, by doubling
        h[k:] = h[k:] + (h[:-k] << _U32(k))
    spots = (np.flatnonzero(h >> _U32(32 - MASK_BITS) == 0) + 1).tolist()
    out, start, n = [], 0, len(media)
    for spot in spots:
        while spot - start > MOST:
            start += MOST
            out.append(start)
        if spot - start >= LEAST:
            start = spot
            out.append(start)
    while n - start > MOST:
        start += MOST
        out.append(start)
    if start < n:
        out.append(n)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunks_of(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes]]:
    ids = batch.column("doc_id").to_pylist()
    for i, _, raw, offsets in slices(batch.column("text")):
        for x in range(len(offsets) - 1):
            yield ids[i + x], raw[offsets[x] : offsets[x + 1]].tobytes()


def _rows(rows, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of *rows* (tuples) of an Arrow schema."""
    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_SUM, _SUMS = pa.binary(), pa.list_(pa.binary())
CATALOGUE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", _SUM), ("digests", _SUMS)])


def catalogue_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in _texts(batch):
            payload = payload_of(text)
            rows.append((doc, len(text), hashlib.sha256(payload).digest(), [digest(c) for c in chunks_of(media_of(payload))]))
        yield _rows(rows, CATALOGUE)


class BitMap:
    """A set of digests as a bit map of bounded size: may say yes wrongly, never no."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, digests: DataFrame) -> BitMap:
        """From one column of digests; the words of the map are or-ed together before they reach the driver (8 MB at most)."""
        bits = min(MOST_BITS, max(10, (16 * max(1, digests.count()) - 1).bit_length()))
        key = F.conv(F.substring(F.hex(digests.columns[0]), 1, 16), 16, -10).cast("long")
        slot = F.shiftrightunsigned(key, 64 - bits)
        words = digests.select(slot.alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("at"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
        table = np.zeros(1 << max(0, bits - 6), np.int64)
        table[words["at"].to_numpy()] = words["bit"].to_numpy()
        return cls(bits, table.view(_U64))

    def has(self, name: bytes) -> bool:
        slot = int.from_bytes(name[:8], "big") >> (64 - self.bits)
        return bool(int(self.words[slot >> 6]) >> (slot & 63) & 1)


PACKED = pa.schema([("sha", _SUM), ("digests", _SUMS), ("lens", pa.list_(pa.int32())), ("media", pa.binary())])


STORED = pa.schema([
    ("sha", _SUM), ("digests", _SUMS), ("lens", pa.list_(pa.int32())), ("inline", pa.list_(pa.bool_())), ("pack", pa.binary()), ("owned", pa.list_(pa.struct([("digest", _SUM), ("data", pa.binary())]))),
])


def media_batches(open_: BitMap, decided: bool):
    """Second scan: media files, compressed, with their chunk lists.

    *decided*: of the payloads that are certainly not *open_*, as rows of the
    store.  Else the others as PACKED, equal payloads of a batch once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        schema = STORED if decided else PACKED
        for batch in batches:
            rows, size = {}, 0
            for _, text in _texts(batch):
                payload = payload_of(text)
                sha = hashlib.sha256(payload).digest()
                if sha in rows or open_.has(sha) == decided:
                    continue
                media = media_of(payload)
                parts = chunks_of(media)
                names, lens = [digest(c) for c in parts], [len(c) for c in parts]
                # a chunk that a payload repeats stands in its pack once
                rows[sha] = (sha, names, lens, [True] * len(names), press.compress(b"".join(dict.fromkeys(parts))), []) if decided else (sha, names, lens, press.compress(media))
                size += len(text)
                if size > 8 << 20:
                    yield _rows(rows.values(), schema)
                    rows, size = {}, 0
            if rows:
                yield _rows(rows.values(), schema)

    return run


def store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED with their common chunks (digest, own) to STORED."""
    import zstandard

    press, plain = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            common = {x["digest"]: x["own"] for x in row["common"] or []}
            media, at, pack, owned = plain.decompress(row["media"]), 0, {}, {}
            for name, length in zip(row["digests"], row["lens"], strict=True):
                chunk, at = media[at : at + length], at + length
                if name not in common:
                    pack[name] = chunk
                elif common[name]:
                    owned[name] = chunk
            rows.append((row["sha"], row["digests"], row["lens"], [d not in common for d in row["digests"]], press.compress(b"".join(pack.values())), [{"digest": d, "data": press.compress(c)} for d, c in owned.items()]))
        yield _rows(rows, STORED)


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the average hash of their mean frame."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    frame = x.reshape(-1, SIDE, SIDE).mean(0).reshape(8, 3, 8, 3).mean((1, 3))
    bits = "".join("1" if v else "0" for v in (frame > frame.mean()).ravel())
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};ahash={int(bits, 2):016x}"


READ = pa.schema([
    ("sha", _SUM), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
])


def read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuild media from packs and fetched chunks, verify them, compute features."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            pack, at, parts, seen = plain.decompress(row["pack"]), 0, [], {}
            fetched = {x["digest"]: x["data"] for x in [*row["owned"], *(row["fetched"] or [])]}
            for name, length, inline in zip(row["digests"], row["lens"], row["inline"], strict=True):
                if name in seen:
                    parts.append(seen[name])
                    continue
                if inline:
                    chunk, at = pack[at : at + length], at + length
                else:
                    chunk = plain.decompress(fetched[name])
                if digest(chunk) != name:
                    raise ValueError("a stored chunk does not match its digest")
                seen[name] = chunk
                parts.append(chunk)
            media = b"".join(parts)
            samples = samples_of(media)
            sha = hashlib.sha256(samples)
            if sha.digest() != row["sha"]:
                raise ValueError("a rebuilt payload does not match its digest")
            rows.append((row["sha"], len(samples), sha.hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
        yield _rows(rows, READ)


def written(docs: DataFrame, catalogue: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The store (STORED, a row per distinct payload) in two tables: a chunk of one payload stands in its pack, a common one with its owner.

    The first table holds payloads that share nothing, the second, bucketed by
    digest, those that were decided on by joins.
    """
    lists = catalogue.groupBy("sha").agg(F.first("digests").alias("digests")).select("sha", F.explode(F.array_distinct("digests")).alias("digest"))
    lists = scratch.put(lists, "lists")
    common = scratch.put(lists.groupBy("digest").agg(F.count("*").alias("n"), F.min("sha").alias("owner")).where("n > 1"), "common")
    # a payload has no more common chunks than chunks
    told = meet(lists, common, "digest", "n").groupBy("sha").agg(F.collect_list(F.struct("digest", (F.col("owner") == F.col("sha")).alias("own"))).alias("common"))
    told = scratch.put(told, "told")
    copies = catalogue.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha")
    open_ = BitMap.of(scratch.put(told.select("sha").unionByName(copies), "open"))
    schema = from_arrow_schema
    plain = scratch.put(docs.mapInArrow(media_batches(open_, True), schema(STORED)), "plain")
    first = docs.mapInArrow(media_batches(open_, False), schema(PACKED)).groupBy("sha").agg(F.first(F.struct("digests", "lens", "media")).alias("m")).select("sha", "m.*")
    # rows stand in partitions of sha already, so a task writes its own buckets
    return plain, scratch.bucketed(first.join(told, "sha", "left").mapInArrow(store_batches, from_arrow_schema(STORED)), "sha", "store")


def store_and_read(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row per input row.

    * null text is stored as the empty text: one frame of 255;
    * very long texts are one payload of many chunks, cut like any other;
    * equal texts get equal values and are stored once; repeated rows and null
      ids each keep their result row;
    * an empty table gives an empty result; further columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        catalogue = scratch.keep(docs.mapInArrow(catalogue_batches, from_arrow_schema(CATALOGUE)), "catalogue")
        plain, store = written(docs, catalogue, scratch)
        pieces = store.select(F.explode("owned").alias("o")).select("o.*")
        # what a payload has not and does not own is fetched
        lacks = F.array_except(F.transform(F.filter(F.arrays_zip("digests", "inline"), lambda x: ~x["inline"]), lambda x: x["digests"]), F.col("owned.digest"))
        wanted = scratch.put(store.select("sha", F.explode(lacks).alias("digest")), "wanted")
        uses = wanted.groupBy("digest").agg(F.count("*").alias("uses"))
        fetched = meet(wanted, pieces.join(uses, "digest"), "digest", "uses").groupBy("sha").agg(F.collect_list(F.struct("digest", "data")).alias("fetched"))
        whole = F.size(lacks) == 0
        kind = "array<struct<digest:binary,data:binary>>"
        alone = plain.unionByName(store.where(whole)).withColumn("fetched", F.lit(None).cast(kind))
        joined = store.where(~whole).join(fetched, "sha").withColumn("fetched", F.col("fetched").cast(kind))
        values = scratch.keep(alone.unionByName(joined).mapInArrow(read_batches, from_arrow_schema(READ)), "values")
        n = catalogue.groupBy("sha").agg(F.count("*").alias("rows"))
        read = meet(catalogue.select("doc_id", "n_bytes", "sha"), values.join(n, "sha"), "sha", "rows")
        return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
