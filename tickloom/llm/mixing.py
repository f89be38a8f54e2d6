"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

All of it is DataFrame and SQL work.  Rows of a source are dealt to blocks of
about ``block_docs`` rows by a hash of their content.  A source's target is met
by whole passes over its blocks and one partial pass that ends inside a block,
so each source has an exact quota of block draws.  A binary tree splits the
vector of quotas among the output shards: at each node the left half's share of
every source is a draw from the multivariate hypergeometric distribution (one
conditional hypergeometric draw after another, by inversion, from a hash of the
seed and the node).  A shard then takes its own, disjoint range of each source's
permuted draws, and ``local_key`` orders the rows within the shard.

Nothing is ordered over a whole source at once: prefix sums run over groups of
blocks first, then within a group, then within the one block a target ends in,
so a source with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of sources (times shards) up to which it is sent to every task.
SMALL_ROWS = 20_000


def portable_hash(*parts: Column) -> Column:
    """60 bits of the parts' md5 as a long: equal in every SQL engine; null parts are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def source_targets(stats: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, rank, weight, source_size, docs, target) from (source, source_size, docs).

    Sources are ranked by code point, null last, and weigh *weights* in turn.
    They share ``share`` times all words; a target stops at ``cap`` times its
    source's size, and what is above goes to the others by weight.  The fixed
    point is a water level: with sources by cap / weight, the first prefix of
    capped ones after which the level stays below the next source's ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = stats.withColumn("rank", F.row_number().over(order).cast("long") - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    w = w.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    line = Window.orderBy("ratio", "rank")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = (
        w.withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("pool", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("pool") - F.col("capped")) / F.col("open"))
    )
    w = w.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"])
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("final") * F.col("weight")))
    return w.select("source", "rank", "weight", "source_size", "docs", target.alias("target"))


def _draw(n_all: str, n_take: str, q: str, u: str) -> str:
    """SQL for a hypergeometric draw: of q marked among n_all, how many in n_take (u in (0, 1))."""
    return f"""
    transform(array(named_struct('all', double({n_all}), 'n', double({n_take}), 'q', double({q}), 'u', {u})), g ->
      transform(array(named_struct(
        'a', greatest(0L, bigint(g.n - (g.all - g.q)), bigint(floor(g.n * g.q / greatest(g.all, 1D) - 1 - 12 * sqrt(g.n * g.q / greatest(g.all, 1D) * (1 - g.q / greatest(g.all, 1D)) * (g.all - g.n) / greatest(g.all - 1, 1D))))),
        'b', least(bigint(g.q), bigint(g.n), bigint(ceil(g.n * g.q / greatest(g.all, 1D) + 1 + 12 * sqrt(g.n * g.q / greatest(g.all, 1D) * (1 - g.q / greatest(g.all, 1D)) * (g.all - g.n) / greatest(g.all - 1, 1D))))))), r ->
        transform(array(aggregate(sequence(r.a, r.b), named_struct('p', 1D, 't', 0D),
            (s, k) -> named_struct('p', s.p * ((g.q - k) * (g.n - k)) / ((k + 1D) * (g.all - g.q - g.n + k + 1D)), 't', s.t + s.p)).t * g.u), z ->
          aggregate(sequence(r.a, r.b), named_struct('p', 1D, 'c', 0D, 'x', r.a),
            (s, k) -> named_struct('p', s.p * ((g.q - k) * (g.n - k)) / ((k + 1D) * (g.all - g.q - g.n + k + 1D)), 'c', s.c + s.p,
                                   'x', if(s.c + s.p < z, least(k + 1L, r.b), s.x))).x)[0])[0])[0]"""


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, rank, draws) from one row per source (rank, quota); sums over shards are the quotas.

    At every node the array of quotas, in order of rank, is split in two; sizes
    of halves differ by one draw at most when shards are a power of two.
    """
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("quotas")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quotas"
    )
    total = "aggregate(quotas, 0L, (s, x) -> s + x)"
    depth = max(0, (shards - 1).bit_length())
    for level in range(depth):
        u = f"(pmod(xxhash64({seed}, {level}, lo, s.i), 9007199254740992L) + 0.5D) / 9007199254740992D"
        left = f"""aggregate(quotas, named_struct('i', 0, 'all', total, 'n', share, 'out', cast(array() as array<bigint>)),
          (s, q) -> transform(array({_draw("s.all", "s.n", "q", u)}), x -> named_struct('i', s.i + 1, 'all', s.all - q, 'n', s.n - x, 'out', concat(s.out, array(x))))[0]).out"""
        mid = "bigint((lo + hi + 1) div 2)"
        node = node.withColumn("total", F.expr(total)).withColumn("share", F.expr(f"bigint(floor(total * double({mid} - lo) / double(hi - lo)))"))
        node = node.withColumn("left", F.when(F.expr("hi - lo > 1"), F.expr(left)).otherwise(F.col("quotas")))
        node = node.selectExpr(
            f"explode(if(hi - lo > 1, array(named_struct('lo', int(lo), 'hi', int({mid}), 'quotas', left),"
            f" named_struct('lo', int({mid}), 'hi', int(hi), 'quotas', zip_with(quotas, left, (a, b) -> a - b))),"
            " array(named_struct('lo', int(lo), 'hi', int(hi), 'quotas', quotas)))) as e"
        ).select("e.lo", "e.hi", "e.quotas")
    return node.select(F.col("lo").alias("shard"), F.posexplode("quotas").alias("rank", "draws")).withColumn("rank", F.col("rank").cast("long"))


def mixture(
    documents: DataFrame,
    *,
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[int, ...] = (3, 1, 2),
    shards: int = 16,
    block_docs: int = 256,
    group_blocks: int = 4096,
    seed: int = 7,
    carry: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, draws (and *carry*).

    draws lists the document's places in the mix as (shard, local_key), at most
    ``ceil(cap)`` of them; taken is their number times size.

    * very long texts count whole; a document larger than what is left of a target's last block is not drawn there;
    * null or empty text, or text without words: size 0, its words count nothing;
    * null source: a source of its own, ranked last; null ids are kept;
    * repeated rows: each is a document, with equal draws where their blocks agree;
    * all sizes 0: targets 0 and no draws; an empty table gives an empty result;
    * further columns are ignored unless named in *carry*, under their own names.
    """
    spark = documents.sparkSession
    base = documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        portable_hash(F.col(id_col), F.col(source_col), F.col(text_col)).alias("h"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    with Scratch(spark) as scratch:
        sizes = scratch.put(base.select("doc_id", "source", "size", "h"), "sizes") if not carry else base.select("doc_id", "source", "size", "h")
        stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        targets = scratch.keep(source_targets(stats, share, cap, weights), "targets")
        n_sources = targets.count()
        part = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("docs") / F.lit(block_docs)))
        key = targets.select(F.col("source").alias("src"), "rank", "source_size", "target", part.alias("blocks"))
        # rows of a source do not meet: blocks do
        def placed(df: DataFrame) -> DataFrame:
            return df.join(_sent(key, n_sources), F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn("block", F.pmod(portable_hash(F.col("h"), F.lit(seed)), F.col("blocks")))

        blocks = scratch.put(placed(sizes).groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"), F.first("source_size").alias("source_size"), F.first("target").alias("target")), "blocks")
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
        passes = blocks.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        draws = passes.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("whole"))))
        draws = draws.withColumn("order", portable_hash(F.col("rank"), F.col("block"), F.col("turn"), F.lit(seed))).withColumn("grp", F.pmod(portable_hash(F.col("order")), F.ceil(F.col("blocks") / F.lit(group_blocks))))
        groups = draws.groupBy("rank", "turn", "grp").agg(F.sum("words").alias("gw"), F.count("*").alias("gn"))
        ahead = Window.partitionBy("rank", "turn").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.select("rank", "turn", "grp", F.coalesce(F.sum("gw").over(ahead), F.lit(0)).alias("words_ahead"), F.coalesce(F.sum("gn").over(ahead), F.lit(0)).alias("blocks_ahead"))
        inner = Window.partitionBy("rank", "turn", "grp").orderBy("order", "block")
        draws = (
            draws.join(groups, ["rank", "turn", "grp"])
            .withColumn("start", F.col("words_ahead") + F.coalesce(F.sum("words").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("place", F.col("blocks_ahead") + F.row_number().over(inner) - 1)
            # words this draw may take: all in whole passes, what is left in the last
            .withColumn("room", F.when(F.col("turn") < F.col("whole"), F.col("words").cast("double")).otherwise(F.least(F.col("words").cast("double"), F.col("rest") - F.col("start"))))
            .where("room > 0")
            .withColumn("place", F.col("turn") * F.col("blocks") + F.col("place"))
        )
        draws = scratch.put(draws.select("rank", "block", "turn", "place", "room", "words"), "draws")
        quotas = targets.select("rank").join(draws.groupBy("rank").agg(F.count("*").alias("quota")), "rank", "left").select("rank", F.coalesce("quota", F.lit(0).cast("long")).alias("quota"))
        tree = split_tree(quotas, shards, seed)
        upto = Window.partitionBy("rank").orderBy("shard")
        ranges = scratch.put(tree.withColumn("upto", F.sum("draws").over(upto)).select("rank", "shard", (F.col("upto") - F.col("draws")).alias("since"), "upto"), "ranges")
        ranges = _sent(ranges.withColumnRenamed("rank", "r"), n_sources * shards)
        dealt = (
            draws.join(ranges, (F.col("rank") == F.col("r")) & (F.col("place") >= F.col("since")) & (F.col("place") < F.col("upto")))
            .groupBy("rank", "block")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "shard", "room", "words"))).alias("turns"))
        )
        # the block in which a target ends: largest rows first, each that still fits
        last = draws.where("room < words").select(F.col("rank").alias("r"), F.col("block").alias("b"), "room")
        ending = placed(sizes).join(_sent(last, n_sources), (F.col("rank") == F.col("r")) & (F.col("block") == F.col("b"))).where("size > 0")
        fits = (
            ending.groupBy("rank", "block", "room", "h").agg(F.sum("size").alias("s"))
            .groupBy("rank", "block", "room").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "h"))).alias("list"))
            .selectExpr("rank", "block", """aggregate(list, named_struct('room', room, 'out', cast(array() as array<bigint>)),
                (a, x) -> if(-x.s <= a.room, named_struct('room', a.room + x.s, 'out', concat(a.out, array(x.h))), a)).out as fits""")
        )
        dealt = scratch.keep(dealt.join(fits, ["rank", "block"], "left"), "dealt")
        rows = placed(base).join(dealt, ["rank", "block"], "left")
        mine = F.filter(
            F.coalesce("turns", F.expr("cast(array() as array<struct<turn:int,shard:int,room:double,words:bigint>>)")),
            lambda t: (F.col("size") > 0) & ((t["room"] >= t["words"]) | F.coalesce(F.array_contains("fits", F.col("h")), F.lit(False))),
        )
        rows = rows.withColumn("draws", F.transform(mine, lambda t: F.struct(t["shard"].alias("shard"), F.xxhash64(F.col("h"), t["turn"], F.lit(seed)).alias("local_key"))))
        return rows.select("doc_id", "source", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), "draws", *[F.col(f"carried_{c}").alias(c if c not in ("doc_id", "source", "size", "source_size", "target", "taken", "draws") else f"{c}_carried") for c in carry])


#: Slices of a shard's order; one task holds whole slices.
SLICES = 64


def mixed_rows(documents: DataFrame, columns: tuple[str, ...], **options) -> DataFrame:
    """The mix itself: a row per draw with *columns* of the documents, its shard and local key, dealt and shuffled locally.

    Rows are partitioned by shard and slice of the local keys' range and sorted
    by local key (ties by the columns), so a shard is its slices one after
    another, and no shard has to fit in one task.  Nulls, empty and very long
    texts, repeated rows and empty tables are as ``mixture`` says; columns of
    any name come back under it.
    """
    plan = mixture(documents, carry=columns, **options)
    named = [F.col(c if c in plan.columns[7:] else f"{c}_carried").alias(c) for c in columns]
    rows = plan.select(*named, "size", "source_size", "target", "taken", F.explode("draws").alias("d")).select(*columns, "size", "source_size", "target", "taken", F.col("d.shard").alias("shard"), F.col("d.local_key").alias("local_key"))
    piece = F.shiftrightunsigned(F.col("local_key").bitwiseXOR(F.lit(-(1 << 63))), 64 - (SLICES - 1).bit_length())
    return rows.repartition(F.col("shard"), piece).sortWithinPartitions("shard", "local_key", *columns)
