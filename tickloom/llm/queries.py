"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.chat_format import lines_of, recover_roles, render, turns_of
from tickloom.llm.decontam import UNITS, contaminated
from tickloom.llm.drake import clustered
from tickloom.llm.graph_index import GraphIndex
from tickloom.llm.langid import LanguageModels, identify
from tickloom.llm.media_chunks import store_and_read
from tickloom.llm.minhash_dedup import near_duplicates
from tickloom.llm.mixing import mixture
from tickloom.llm.periodic import periodic_runs
from tickloom.llm.pii import pseudonymise
from tickloom.llm.quality import QualityModel
from tickloom.llm.scratch import Scratch
from tickloom.llm.token_counts import apply_edits, build_trees
from tickloom.llm.toxicity import ToxicityModel


#: The key of the registered queries; a real corpus takes its own from a store of secrets.
PII_KEY = "tickloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size, its component of near duplicates, and whether it is the one that stays."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, numerator=85, denominator=100)


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, text): raw transcripts of a table of turns; most pieces open with a speaker marker, a fifth with none."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    spelt = {"user": ("User: ", "### Human: ", "[Q] "), "assistant": ("Assistant: ", "### Bot: ", "[A] "), "system": ("System: ",) * 3}
    name = F.lit("")
    for role, marks in spelt.items():
        name = F.when(F.col("role") == role, F.element_at(F.array(*map(F.lit, marks)), (style + 1).cast("int"))).otherwise(name)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    return turns.select("conv_id", F.col("turn").alias("piece"), F.concat(F.when(bare, "").otherwise(name), F.coalesce("text", F.lit(""))).alias("text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per recovered turn of every transcript: its role, number of lines and canonical rendering."""
    raw = transcripts(table(spark, sf_dir, "conversations"))
    roles = recover_roles(lines_of(raw, order_col="piece"))
    return render(turns_of(roles)).select("conv_id", "turn", "role", "n_lines", "rendered")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced, how many there were, and the surrogates in order."""
    return pseudonymise(table(spark, sf_dir, "documents"), key=PII_KEY, report=True).select("doc_id", "text", "n_entities", "surrogates")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for toxicity by a model of the labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ToxicityModel.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return model.score(docs).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a document and a benchmark item it holds, word for word or with other numbers, names and units."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language that has the largest share of it, by models of the rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = LanguageModels.fit(docs.where(remainder(4) != 2))
    return identify(docs.select("doc_id", "text"), models).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, and after one edit of its stored tree that replaces 40 characters at a third of it."""
    trees = Scratch(spark).keep(build_trees(table(spark, sf_dir, "documents")), "trees")
    at = (F.col("n_chars") / 3).cast("int")
    edit = F.array(F.struct(at.alias("start"), (at + 40).alias("end"), F.lit(" [removed] ").alias("insert")))
    return apply_edits(trees.withColumn("edits", edit)).select(
        "doc_id", F.col("old_chars").alias("n_chars"), F.col("old_pretokens").alias("n_pretokens"), F.col("old_tokens").alias("n_tokens"), F.col("old_nodes").alias("n_nodes"),
        F.col("n_chars").alias("edited_chars"), F.col("n_tokens").alias("edited_tokens"), "reencoded_pretokens",
    )


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its payload and stored form as read back from chunks that are stored once."""
    return store_and_read(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for quality by a model of the labelled rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = QualityModel.fit(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    return model.score(docs).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


WORD = r"[^\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth text, by crc32 of its id, goes on periodically from some word on; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    words = words.withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
    a = F.pmod("g", F.nullif("n", F.lit(0)))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8))))
    words = words.withColumn("a", a).withColumn("p", period)
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p")) + 1).cast("int"))))
    return words.select("doc_id", F.when(F.coalesce(F.col("n") > 0, F.lit(False)), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its run of the greatest exponent, and digests of all runs and of the text without their repeats."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ahead = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]  # noqa: E731  above 0 if x is ahead of y
    best = F.aggregate("runs", F.element_at(F.filter("runs", lambda r: F.lit(True)), 1), lambda b, r: F.when(ahead(r, b) > 0, r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    milli = F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long")
    return told.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def op12_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by id, found by beam search of the graphs of all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return GraphIndex.build(vectors).search(vectors.where("vec_id % 20 = 0"), 20)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster and squared distance, and figures of its cluster."""
    vectors = table(spark, sf_dir, "embeddings")
    found = clustered(vectors, [F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)])
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")
    # a row for each cluster
    totals = {r["cluster"]: None if r["total"] is None else int(r["total"]) for r in found.assigned.groupBy("cluster").agg(total).collect()}
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    every = fits(None if None in totals.values() else sum(totals.values()))
    figures = [(c, fits(totals[c]), every, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(found.centroids) if c in totals]
    by = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(by), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_minhash_dedup, op2_chat_format, op3_pii, op4_toxicity, op5_decontamination, op6_language_id, op7_mixing, op8_token_counts, op9_media_chunks, op10_quality, op11_periodic_runs, op12_graph_search, op13_clusters)
    }


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(c.m, d.doc_id)) AS BIGINT) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _hash(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


OP7_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, {_hash("doc_id", "source", "text")} AS h FROM documents),
src AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source)),
wt AS (SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS most, (SELECT sum(source_size) FROM src)::DOUBLE * 1.5 AS pool FROM src),
-- sources are capped one round after another until no share is above its cap
fill(step, capped) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT step + 1, next FROM (
    SELECT step, capped, (SELECT list(rank ORDER BY rank) FROM wt x WHERE list_contains(capped, x.rank) OR x.w * (
      (x.pool - coalesce((SELECT sum(most) FROM wt y WHERE list_contains(capped, y.rank)), 0)) / (SELECT sum(w) FROM wt y WHERE NOT list_contains(capped, y.rank))) > x.most) AS next FROM fill)
  WHERE next IS NOT NULL AND len(next) > len(capped)),
last AS (SELECT capped FROM fill ORDER BY step DESC LIMIT 1),
tg AS (
  SELECT wt.*, CASE WHEN list_contains(capped, rank) THEN most ELSE least(most, (pool - coalesce((SELECT sum(most) FROM wt y WHERE list_contains(capped, y.rank)), 0)) / (SELECT sum(w) FROM wt y WHERE NOT list_contains(capped, y.rank)) * w) END AS target,
    CAST(greatest(1, ceil(docs / 256.0)) AS BIGINT) AS blocks FROM wt, last),
p AS (
  SELECT d.doc_id, d.source, size, h, rank, source_size, target, blocks, {_hash("h", "7")} % blocks AS block,
    CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source),
b AS (SELECT rank, block, sum(size) AS words, any_value(blocks) AS blocks, any_value(whole) AS whole, any_value(target) - any_value(whole) * any_value(source_size) AS rest FROM p GROUP BY rank, block),
o AS (SELECT *, {_hash("rank", "block", "turn", "7")} AS ord FROM (SELECT b.*, unnest(range(0, whole + 1)) AS turn FROM b)),
c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY rank, turn ORDER BY {_hash("ord")} % CAST(ceil(blocks / 4096.0) AS BIGINT), ord, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o),
k AS (SELECT *, CASE WHEN turn < whole THEN words ELSE least(words, rest - ahead) END AS room FROM c),
e AS (
  SELECT p.rank, p.block, room, h, sum(size) AS s, row_number() OVER (PARTITION BY p.rank, p.block ORDER BY sum(size) DESC, h) AS rn
  FROM p JOIN k ON k.rank = p.rank AND k.block = p.block AND room > 0 AND room < words WHERE size > 0 GROUP BY p.rank, p.block, room, h),
g(rank, block, rn, h, hit, room) AS (
  SELECT rank, block, rn, h, s <= room, CASE WHEN s <= room THEN room - s ELSE room END FROM e WHERE rn = 1
  UNION ALL
  SELECT e.rank, e.block, e.rn, e.h, e.s <= g.room, CASE WHEN e.s <= g.room THEN g.room - e.s ELSE g.room END FROM g JOIN e ON e.rank = g.rank AND e.block = g.block AND e.rn = g.rn + 1),
f AS (SELECT rank, block, count(*) AS n FROM k WHERE room > 0 AND room >= words GROUP BY rank, block)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(p.size * (coalesce(f.n, 0) + CASE WHEN coalesce(g.hit, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p LEFT JOIN f ON f.rank = p.rank AND f.block = p.block LEFT JOIN g ON g.rank = p.rank AND g.block = p.block AND g.h = p.h
"""


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_WORDS = "0-9A-Za-z\\x{80}-\\x{10FFFF}"
_GLUED = f"(^|[^{_WORDS}])([0-9](?:[0-9\ue000\ue001]*[0-9])?)((?i:{'|'.join(UNITS)}))($|[^{_WORDS}])"
#: Tokens are told from what stands between them; a stop or comma inside a number is private-use for a while.
OP5_SQL = f"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
m AS (
  SELECT kind, id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])\\.([0-9])', '\\1\ue000\\2', 'g'), '([0-9])\\.([0-9])', '\\1\ue000\\2', 'g'),
    '([0-9]),([0-9])', '\\1\ue001\\2', 'g'), '([0-9]),([0-9])', '\\1\ue001\\2', 'g') AS text FROM t),
-- a number with a unit at its end is two tokens
g AS (
  SELECT kind, id, regexp_extract_all(regexp_replace(regexp_replace(text, '{_GLUED}', '\\1\\2 \\3\\4', 'g'), '{_GLUED}', '\\1\\2 \\3\\4', 'g'), '[{_WORDS}]+|[^{_WORDS}]+') AS parts FROM m),
u AS (SELECT kind, id, row_number() OVER () AS r, parts FROM g),
x AS (SELECT *, lag(part) OVER (PARTITION BY r ORDER BY i) AS gap FROM (SELECT kind, id, r, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM u)),
tok AS (
  SELECT kind, id, r, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS pos, translate(part, '{_CAPITALS}', '{_CAPITALS.lower()}') AS low, part AS raw,
    row_number() OVER (PARTITION BY r ORDER BY i) = 1 AS opening, coalesce(gap, '') AS gap
  FROM x WHERE regexp_matches(part, '^[{_WORDS}]')),
f AS (
  SELECT *, regexp_matches(raw, '^[0-9\ue000\ue001]+$') AS number,
    regexp_matches(raw, '^[{_CAPITALS}]') AND len(regexp_extract_all(raw, '[{_CAPITALS}]')) = 1 AND strlen(raw) > 1 AND NOT opening AND NOT regexp_matches(gap, '[!.:?\\n\\r"]') AS name FROM tok),
un AS (SELECT unnest(string_split('{" ".join(UNITS)}', ' ')) AS w),
c AS (
  SELECT kind, id, r, pos, low, CASE WHEN number THEN '<n>' WHEN coalesce(lag(number) OVER (PARTITION BY r ORDER BY pos), false) AND low IN (SELECT w FROM un) THEN '<u>' WHEN name THEN '<p>' ELSE low END AS k,
    count(*) OVER (PARTITION BY r) AS n FROM f),
it AS (SELECT *, least(8, n) AS w, n - least(8, n) + 1 AS nw FROM c WHERE kind = 'b' AND n >= 5),
ii AS (SELECT id, r, n, w, nw, list(k ORDER BY pos) AS ks, list(low ORDER BY pos) AS ls FROM it GROUP BY ALL),
iw AS (
  SELECT id, w, nw, p, ks[p + 1 : p + w] AS ks, ls[p + 1 : p + w] AS ls FROM (SELECT *, unnest(range(0, nw)) AS p FROM ii)
  UNION ALL
  SELECT id, w, nw, 0, list_prepend('<p>', ks[2 : w]), ls[1 : w] FROM ii WHERE ks[1] NOT IN ('<n>', '<p>', '<u>')),
dd AS (SELECT id, r, list(k ORDER BY pos) AS ks, list(low ORDER BY pos) AS ls, max(n) AS n FROM c WHERE kind = 'd' GROUP BY id, r),
sp AS (
  SELECT r, pos AS p, w FROM (SELECT *, lead(k) OVER (PARTITION BY r ORDER BY pos) AS k2 FROM c WHERE kind = 'd') z JOIN (SELECT DISTINCT w, ks[1] AS a, ks[2] AS b FROM iw) y ON z.k = y.a AND z.k2 = y.b),
dw AS (SELECT dd.id, dd.r, w, p, ks[p + 1 : p + w] AS ks, ls[p + 1 : p + w] AS ls FROM sp JOIN dd ON dd.r = sp.r AND p + w <= dd.n),
hit AS (
  SELECT dw.id AS doc_id, iw.id AS item_id, dw.p - iw.p AS off, iw.p AS place, iw.nw,
    list_filter(list_transform(range(1, iw.w + 1), lambda j: CASE WHEN iw.ks[j] IN ('<n>', '<p>', '<u>') THEN {{'i': iw.ks[j] || iw.ls[j], 'd': dw.ks[j] || dw.ls[j]}} END), lambda y: y IS NOT NULL) AS pairs
  FROM dw JOIN iw ON dw.w = iw.w AND array_to_string(dw.ks, ' ') = array_to_string(iw.ks, ' ')),
oc AS (SELECT doc_id, item_id, off, count(DISTINCT place) AS windows, any_value(nw) AS nw, list_distinct(flatten(list(pairs))) AS pairs FROM hit GROUP BY doc_id, item_id, off),
ok AS (
  SELECT *, len(pairs) AS s, len(list_filter(pairs, lambda y: y.i <> y.d)) = 0 AS verbatim FROM oc
  WHERE windows >= ceil(nw * 0.5) AND len(list_distinct(list_transform(pairs, lambda y: y.i))) = len(pairs) AND len(list_distinct(list_transform(pairs, lambda y: y.d))) = len(pairs))
SELECT doc_id, item_id, CAST(windows AS BIGINT) AS windows, CAST(nw AS INTEGER) AS item_windows, CAST(s AS INTEGER) AS n_slots, verbatim
FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY windows DESC, verbatim DESC, s DESC) = 1
"""


def _rounds(n: int) -> str:
    """Assignments a0 to an and centroids c0 to cn, all distances each time."""
    out = []
    for r in range(n + 1):
        out.append(f"""d{r} AS (SELECT vec_id, c, sum((e.v - k.v) * (e.v - k.v)) AS d FROM e JOIN c{r} k USING (p) GROUP BY vec_id, c),
a{r} AS MATERIALIZED (SELECT vec_id, c, CAST(d AS BIGINT) AS d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < n:
            out.append(f"""m{r} AS (SELECT c, p, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY c, p),
c{r + 1} AS MATERIALIZED (SELECT c, p, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM c{r} LEFT JOIN m{r} USING (c, p))""")
    return ",\n".join(out)


OP13_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
e AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS p, unnest(x) AS v FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS p, unnest(x) AS v FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v QUALIFY c < 8)),
{_rounds(10)},
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c10 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a10 JOIN h USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op5_decontamination": OP5_SQL, "op7_mixing": OP7_SQL, "op13_clusters": OP13_SQL}
