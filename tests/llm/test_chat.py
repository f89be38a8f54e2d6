import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.llm import chat_format as chat
from tickloom.llm.queries import op2_chat_format, transcripts

LINES = [("System: be brief", True), ("User: what is it?", True), ("a second line", False), ("", True), ("### Bot: it is this", True), ("[Q] and then?", True), ("No marker at all", True)]


def mats_of(lines):
    code, _ = chat.line_codes(pa.array([x for x, _ in lines]), 2 * np.array([f for _, f in lines], np.int64))
    code[0] |= chat.FIRST
    return chat.MATRICES[code]


def score_of(mats, path):
    return mats[0][0, path[0]] + sum(mats[k][path[k - 1], path[k]] for k in range(1, len(mats)))


def best_of(mats):
    return max(score_of(mats, path) for path in itertools.product(range(chat.STATES), repeat=len(mats)))


def one(x):
    return np.array([x])


def test_viterbi_is_the_best_path():
    mats = mats_of(LINES[:6])
    path = chat.viterbi(mats, one(0), one(len(mats)), one(-1), one(-1))
    assert np.isclose(score_of(mats, path), best_of(mats))


def test_blocks_give_the_best_path_too():
    mats = mats_of(LINES[1:])
    best = best_of(mats)
    for cut in range(1, len(mats)):
        start, length = np.array([0, cut]), np.array([cut, len(mats) - cut])
        ends = chat.viterbi(chat.product(mats, start, length), one(0), one(2), one(-1), one(-1))
        path = chat.viterbi(mats, start, length, np.array([-1, ends[0]]), ends)
        assert np.isclose(score_of(mats, path), best)


def test_markers_and_features():
    lines = ["User: hi?", "  ### Assistant : yes", "[Q] why?", "Userland: x", "x" * 300, None, "you> so"]
    code, text = chat.line_codes(pa.array(lines), np.zeros(7, np.int64))
    assert ((code >> 2 & 3) - 1).tolist() == [1, 2, 1, -1, -1, -1, 1]
    assert (code >> 1 & 1).tolist() == [1, 0, 1, 0, 0, 0, 0] and (code & 1).tolist() == [0, 0, 0, 0, 1, 0, 0]
    assert text.to_pylist() == ["hi?", "yes", "why?", "Userland: x", "x" * 300, "", "so"]


def turns_by(lines, path):
    """Turn numbers of one transcript, by one pass over the roles."""
    marked = (chat.line_codes(pa.array([x for x, _ in lines]), np.zeros(len(lines), np.int64))[0] >> 2 & 3) - 1 == path
    return (np.cumsum(marked | (path != np.append(-1, path[:-1]))) - 1).tolist()


def test_long_transcripts_over_partitions_and_blocks(spark):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    rng = np.random.default_rng(3)
    marks = ["User: ", "", "", "Assistant: ", "[A] ", "System: "]
    many = {c: [(marks[rng.integers(6)] + "word" * int(rng.integers(1, 90)) + "?" * int(rng.integers(2)), bool(rng.integers(2))) for _ in range(n)] for c, n in ((1, 2500), (2, 1), (3, 8), (4, 260))}
    rows = [(c, k, line, fresh) for c, lines in many.items() for k, (line, fresh) in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(a), int(b), str(x), str(f) == "True") for a, b, x, f in rows], "conv_id long, seq long, line string, fresh boolean")
    got = chat.recover_roles(df).orderBy("conv_id", "seq").collect()
    spark.conf.unset(coalesce)
    assert len({r["part"] for r in got if r["conv_id"] == 1}) > 1
    for c, lines in many.items():
        mine = [r for r in got if r["conv_id"] == c]
        mats, path = mats_of(lines), np.array([chat.ROLES.index(r["role"]) for r in mine])
        # paths may tie; the style is one for all lines
        best = chat.viterbi(mats, one(0), one(len(mats)), one(-1), one(-1))
        styled = path + best[0] // 3 * 3
        assert np.isclose(score_of(mats, styled), score_of(mats, best), rtol=1e-12) and (styled != best).sum() < 0.01 * len(path) + 1
        assert [r["turn"] for r in mine] == turns_by(lines, path)


def test_turns_come_from_roles(spark):
    text = "Be brief.\n\nUser: what is it?\nit stands there\n\nAssistant: this\n\n\nand that?\n\n[A] one\n[A] two"
    rows = chat.lines_of(spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "conv_id long, text string"))
    assert [(r["line"], r["fresh"]) for r in rows.orderBy("seq").collect()][:4] == [("Be brief.", True), ("User: what is it?", True), ("it stands there", False), ("Assistant: this", True)]
    got = chat.render(chat.turns_of(chat.recover_roles(rows))).orderBy("turn").collect()
    # speakers are named, so a paragraph without a name stays with its speaker
    assert [(r["role"], r["n_lines"]) for r in got] == [("system", 1), ("user", 2), ("assistant", 2), ("assistant", 1), ("assistant", 1)]
    assert got[2]["content"] == "this\n\n\nand that?"
    assert got[1]["rendered"] == "<|user|>\nwhat is it?\nit stands there\n<|end|>"


def test_edges(spark):
    schema = "conv_id long, seq long, line string, fresh boolean, role string, block int"
    rows = [(None, 1, "x", True, "", 0), (1, None, "x", True, "", 0), (1, 1, None, None, "", 0), (1, 1, "User: a", True, "", 0), (1, 1, "User: a", True, "", 0)]
    out = chat.recover_roles(spark.createDataFrame(rows, schema))
    assert out.count() == 3 and out.columns[:6] == ["conv_id", "seq", "turn", "role", "marked", "content"]
    assert chat.recover_roles(spark.createDataFrame([], schema)).count() == 0


def test_roles_of_the_table(spark, sf_dir):
    """The turns of the raw transcripts come back: borders and roles, marker or not."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("turn", F.row_number().over(chat.Window.partitionBy("conv_id").orderBy("turn")) - 1)
    got = op2_chat_format(spark, sf_dir)
    want = turns.select("conv_id", "turn", F.col("role").alias("given"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines"))
    both = want.join(got, ["conv_id", "turn"], "left")
    n = both.count()
    assert both.where("role = given and n_lines = lines").count() >= 0.95 * n
    assert got.where("rendered not like '<|%|>%<|end|>'").count() == 0
    lines = chat.lines_of(transcripts(turns.where("text is not null")), order_col="piece")
    assert lines.where("fresh").groupBy("conv_id").count().agg(F.sum("count")).first()[0] == turns.where("trim(text) <> ''").count()


def roles_in(spark, *texts):
    rows = chat.lines_of(spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string"))
    out = {}
    for r in chat.turns_of(chat.recover_roles(rows)).orderBy("conv_id", "turn").collect():
        out.setdefault(r["conv_id"], []).append((r["role"], r["content"]))
    return out


def test_answers_of_several_paragraphs_and_code(spark):
    code = "Use this:\n\n    def f(x):\n        return x\n\n\n    f(1)\n\nIs that clear? It should be."
    long_ = "word " * 100
    got = roles_in(
        spark,
        "User: How do I cook rice?\nAssistant: First paragraph\n\nSecond paragraph\n\nThird",
        f"### Human: Show me code\n\nand explain it, please\n\n### Bot: {code}\n\n### Human: thanks",
        f"[Q] {long_}\n\n{long_}\n\n[A] {long_}\n\nWhy so?\n\n{long_}",
        # no names: paragraphs alternate
        "How are you?\n\nFine, thanks.\n\nAnd what do you do?\n\nI write.",
    )
    assert got[0] == [("user", "How do I cook rice?"), ("assistant", "First paragraph\n\nSecond paragraph\n\nThird")]
    assert got[1] == [("user", "Show me code\n\nand explain it, please"), ("assistant", code), ("user", "thanks")]
    assert [r for r, _ in got[2]] == ["user", "assistant"] and got[2][1][1].count("\n\n") == 2
    assert [r for r, _ in got[3]] == ["user", "assistant", "user", "assistant"]
