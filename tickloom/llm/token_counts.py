"""Edit-aware token counts: a segment tree of pre-token runs per document, kept in a table.

A text is cut into pre-tokens by the tokenizer's own pattern; leaves are runs of
pre-tokens with their characters, pre-tokens and tokens, inner nodes hold sums.
``build_trees`` makes a table of texts with their trees, ``apply_edits`` takes
such a table and edits and gives the next one, so a later edit never counts a
whole text again.  An edit descends to the leaf it falls in by the characters'
sums, re-encodes the leaves it touches with some context before them, and what
follows until a pre-token boundary falls on an old leaf boundary again;
from there on the old leaves hold, as the pattern never looks back.  The fresh
pre-tokens are dealt to the same leaves, so only sums above them change; the
leaves are cut anew, without encoding, only if they would overflow.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tickloom.llm.scratch import ship

#: Pre-tokens of a fresh leaf (an edited one holds up to FULL of them); distinct pre-tokens whose counts a worker remembers.
LEAF, FULL = 32, 96
#: Characters before an edit that are encoded again.
CONTEXT = 16
REMEMBERED = 400_000


class _Counts(dict):
    """Tokens of a pre-token, remembered up to a bound."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n
        return n


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str | None, pattern: str | None):
    """(pre-token finder, token counter) of a byte-level BPE given by its ranks file."""
    import regex
    import tiktoken

    if vocabulary is None or pattern is None:
        import public_tokenizers

        vocabulary, pattern = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(pattern), _Counts(encoding)


Sums = tuple[int, int, int]


def _plus(a: Sums, b: Sums) -> Sums:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class Tree:
    """Sums (characters, pre-tokens, tokens) by level, leaves first, one root at the end."""

    def __init__(self, leaves: list[Sums]):
        self.levels = [leaves or [(0, 0, 0)]]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([_plus(low[i], low[i + 1]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])

    @property
    def leaves(self) -> list[Sums]:
        return self.levels[0]

    @property
    def total(self) -> Sums:
        return self.levels[-1][0]

    @classmethod
    def build(cls, text: str, find, count) -> Tree:
        pieces = find.findall(text)
        return cls([cls.leaf(pieces[i : i + LEAF], count) for i in range(0, len(pieces), LEAF)])

    @staticmethod
    def leaf(pieces: list[str], count) -> Sums:
        return sum(map(len, pieces)), len(pieces), sum(map(count.__getitem__, pieces))

    def nodes(self) -> list[Sums]:
        """All nodes in one list, level by level."""
        return [x for level in self.levels for x in level]

    @classmethod
    def of(cls, nodes: list[Sums], leaves: int) -> Tree:
        """The tree whose ``nodes()`` these are."""
        tree, at, n = cls.__new__(cls), 0, leaves
        tree.levels = []
        while True:
            tree.levels.append(list(nodes[at : at + n]))
            at += n
            if n == 1:
                return tree
            n = (n + 1) // 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character *at* (the last one with any at the end) and where it begins."""
        k, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            k *= 2
            if k + 1 < len(level) and at >= begin + level[k][0] and begin + level[k][0] < self.total[0]:
                begin += level[k][0]
                k += 1
        return k, begin

    def edit(self, text: str, start: int, end: int, insert: str, find, count) -> tuple[str, int]:
        """Replace text[start:end]; returns the new text and the pre-tokens re-encoded."""
        start, end = max(0, min(start, len(text))), max(0, min(max(start, end), len(text)))
        new = text[:start] + insert + text[end:]
        shift = len(insert) - (end - start)
        # a match before the edit may have looked over blanks and a few characters more
        back = start
        while back and text[back - 1].isspace():
            back -= 1
        first, begin = self.find(max(0, back - CONTEXT))
        # the first leaf that begins behind the edit, and where it begins in the new text
        last, edge = self.find(end)
        edge += shift
        while last < len(self.leaves) and (edge < end + shift or last <= first):
            edge += self.leaves[last][0]
            last += 1
        pieces = []
        for m in find.finditer(new, begin):
            pieces.append(m[0])
            while last < len(self.leaves) and edge < m.end():
                edge += self.leaves[last][0]
                last += 1
            if last < len(self.leaves) and edge == m.end():
                break
        else:
            last = len(self.leaves)
        self._put(first, last, pieces, count)
        return new, len(pieces)

    def _put(self, first: int, last: int, pieces: list[str], count) -> None:
        """Deal *pieces* to the leaves first .. last - 1; cut leaves anew if they would overflow."""
        n = last - first
        size = -(-len(pieces) // n) if n else FULL + 1
        if size > FULL or not n:
            fresh = [self.leaf(pieces[i : i + LEAF], count) for i in range(0, len(pieces), LEAF)]
            self.__init__(self.leaves[:first] + fresh + self.leaves[last:])
            return
        for k in range(n):
            self.levels[0][first + k] = self.leaf(pieces[k * size : (k + 1) * size], count)
        for level in range(1, len(self.levels)):
            low = self.levels[level - 1]
            first, last = first // 2, (last + 1) // 2
            for k in range(first, last):
                self.levels[level][k] = _plus(low[2 * k], low[2 * k + 1]) if 2 * k + 1 < len(low) else low[2 * k]


_SUMS = pa.struct([("chars", pa.int64()), ("pretokens", pa.int64()), ("tokens", pa.int64())])
#: A table of trees: nodes level by level, the first n_leaves of them leaves.
TREES = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.large_string()), ("n_chars", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("n_leaves", pa.int64()), ("nodes", pa.list_(_SUMS)),
    ("reencoded_pretokens", pa.int64()),
])
EDITED = pa.schema([*TREES, ("old_chars", pa.int64()), ("old_tokens", pa.int64()), ("old_pretokens", pa.int64()), ("old_nodes", pa.int64())])
_EDIT = "struct<start:int,end:int,insert:string>"


def _row(doc: int | None, text: str, tree: Tree, redone: int) -> tuple:
    return doc, text, *tree.total, len(tree.leaves), [dict(zip(("chars", "pretokens", "tokens"), x, strict=True)) for x in tree.nodes()], redone


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: Rows and characters that are handled at once.
STEP_ROWS, STEP_CHARS = 256, 1 << 22


def _steps(batches: Iterator[pa.RecordBatch]):
    """Short runs of rows, as dictionaries; a run is ended by a long text."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            run, size = [], 0
            for row in batch.slice(at, STEP_ROWS).to_pylist():
                run.append(row)
                size += len(row["text"] or "")
                if size > STEP_CHARS:
                    yield run
                    run, size = [], 0
            if run:
                yield run


def build_batches(vocabulary: str | None, pattern: str | None):
    """Rows (doc_id, text) to TREES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, count = tokenizer(vocabulary, pattern)
        for rows in _steps(batches):
            yield _batch([_row(r["doc_id"], r["text"] or "", Tree.build(r["text"] or "", find, count), 0) for r in rows], TREES)

    return run


def edit_batches(vocabulary: str | None, pattern: str | None):
    """Rows of TREES with their edits to EDITED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, count = tokenizer(vocabulary, pattern)
        for rows in _steps(batches):
            out = []
            for r in rows:
                text, tree, redone = r["text"] or "", Tree.of([(x["chars"], x["pretokens"], x["tokens"]) for x in r["nodes"]], r["n_leaves"]), 0
                for e in r["edits"] or []:
                    text, n = tree.edit(text, e["start"] or 0, e["end"] or 0, e["insert"] or "", find, count)
                    redone += n
                out.append((*_row(r["doc_id"], text, tree, redone), r["n_chars"], r["n_tokens"], r["n_pretokens"], len(r["nodes"])))
            yield _batch(out, EDITED)

    return run


def build_trees(documents: DataFrame, *, vocabulary: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, text, n_chars, n_pretokens, n_tokens, n_leaves, nodes, reencoded_pretokens (0).

    *vocabulary* is a ranks file of a byte-level BPE and *pattern* its
    pre-token pattern; without them those of the installed ``public_tokenizers``
    are taken.

    * null and empty text: one empty leaf, all counts 0; the text comes back empty;
    * very long texts have more leaves, nothing is cut off;
    * repeated rows and null ids: a tree a row;
    * an empty table gives an empty result; further columns are ignored.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(build_batches(vocabulary, pattern), from_arrow_schema(TREES))


def apply_edits(trees: DataFrame, edits: DataFrame | None = None, *, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """The table of trees after edits; the next edits take it as it is.

    Added are old_chars, old_tokens, old_pretokens and old_nodes, of before the
    edits; reencoded_pretokens tells how much was encoded for them.

    *edits* has (doc_id, seq, start, end, insert), applied in order of seq (ties
    by start), positions in characters of the text as it then is; or *trees*
    carries them in a column ``edits``, an array of structs (start, end,
    insert), which needs no join.  The edits of one document are one row.

    * positions outside the text are moved to its ends, null ones to its start;
      null insertions are empty;
    * repeated ids: every row gets the edits of its id; null ids none;
    * trees without edits come back as they are, edits without a tree are ignored;
    * an empty table gives an empty result.
    """
    ship(trees.sparkSession)
    names = [f.name for f in TREES]
    if edits is not None:
        order = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "insert"))).alias("e"))
        order = order.select("doc_id", F.transform("e", lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["insert"].alias("insert"))).alias("edits"))
        rows = trees.select(*names).join(order, "doc_id", "left")
    elif "edits" in trees.columns:
        rows = trees.select(*names, F.col("edits").cast(f"array<{_EDIT}>").alias("edits"))
    else:
        rows = trees.select(*names, F.expr(f"cast(array() as array<{_EDIT}>)").alias("edits"))
    return rows.mapInArrow(edit_batches(vocabulary, pattern), from_arrow_schema(EDITED))
