"""Periodic runs against their definition, word by word."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import periodic
from tickloom.llm.periodic import exact_runs, periodic_runs
from tickloom.llm.queries import op11_periodic_runs, planted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, power=4):
    """Every stretch with its smallest period, straight from the definition."""
    out, n = [], len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            part = words[s:e]
            if e - s >= max(least, power * q) and all(part[:-d] != part[d:] for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words, found):
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def changed(doc_id, text):
    """The words of a document as the query's contract deals them."""
    words = WORD.findall(text or "")
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def texts():
    rng = np.random.default_rng(5)
    out = ["", None, " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a b " * 3 + "a", ("a a b " * 5).strip(), "x " + "y zé " * 9 + "q", "\x0b a\x0ca a  a\ta\na a ", "a a a a a a b b b b b b " * 5]
    for size, letters in ((40, 2), (80, 2), (200, 2), (60, 3), (300, 3), (120, 1)):
        out += [" ".join(rng.choice(list("abc")[:letters], size)) for _ in range(6)]
    for _ in range(12):
        base = [str(x) for x in rng.integers(0, 9, int(rng.integers(1, 40)))]
        tail = [str(x) for x in rng.integers(0, 9, 10)]
        out.append("  ".join(tail + base * int(rng.integers(2, 9)) + base[: int(rng.integers(0, len(base) + 1))] + tail))
    # without a run, and a trap for hashes modulo a power of two
    a = "a"
    for _ in range(11):
        a = f"{a} {a.translate(str.maketrans('ab', 'ba'))}"
    out.append(a)
    return out


def test_equals_definition(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs(df).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        words = WORD.findall(t or "")
        want = brute(words)
        assert [(r["start"], r["length"], r["period"]) for r in got[k]["runs"]] == want, k
        assert got[k]["n_words"] == len(words) and got[k]["collapsed"] == kept_words(words, want), k
    for least, power in ((2, 2), (8, 3)):
        some = {r["doc_id"]: r["runs"] for r in periodic_runs(df, least=least, power=power).collect()}
        for k, t in rows[:-1]:
            assert [(r["start"], r["length"], r["period"]) for r in some[k]] == brute(WORD.findall(t or ""), least, power), (k, least, power)


def test_hashes_that_meet_are_found_out(spark, monkeypatch):
    """With hashes that hold for everything the exact pass decides."""
    rows = [(k, t) for k, t in enumerate(texts()[:20])]
    batch = __import__("pyarrow").RecordBatch.from_pydict({"key": [k for k, _ in rows], "text": [t or "" for _, t in rows]})
    monkeypatch.setattr(periodic, "span_hash", lambda raw, starts, ends: np.ones(len(starts), np.uint64))
    for out in periodic.run_batches(6, 4)(iter([batch])):
        for r in out.to_pylist():
            want = brute(WORD.findall(rows[r["key"]][1] or ""))
            assert list(zip(r["starts"], r["lengths"], r["periods"], strict=True)) == want
    assert exact_runs([b"a"] * 7, 6, 4).tolist() == [[0, 7, 1]]


def test_very_long_text(spark):
    """A text of 10^6 words with a phrase of 1,000 words that is repeated, and one word that is."""
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 1 << 40, 1_000_000)]
    words[100_000:104_500] = (words[100_000:101_000] * 5)[:4_500]
    words[900_000:900_006] = ["same"] * 6
    r = periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(100_000, 4_500, 1_000), (900_000, 6, 1)]
    assert r["collapsed"] == kept_words(words, [tuple(x) for x in r["runs"]])


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = changed(d["doc_id"], d["text"])
        r = got[d["doc_id"]]
        want = [(s, e - s, q) for s, e, q in exact_runs([w.encode() for w in words], 6, 4).tolist()]
        assert len(words) > 600 or want == brute(words)
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if want else (None, None, None)
        some += bool(want)
        assert (r["start"], r["length"], r["period"]) == best and r["n_runs"] == len(want)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept_words(words, want).encode()).hexdigest()
    assert some > 5


def test_odd_rows(spark):
    rows = [(None, "a " * 8), (1, None), (2, ""), (3, "b " * 8), (3, "b " * 8)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, key int, runs string, n_words int")
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect())
    assert got == [("1", [], ""), ("2", [], ""), ("3", [(0, 8, 1)], "b"), ("3", [(0, 8, 1)], "b"), ("None", [(0, 8, 1)], "a")]
    assert periodic_runs(df.limit(0)).count() == 0
    zero = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    same = planted(spark.createDataFrame([(zero, None), (zero, " "), (None, "p q"), (zero, "one")], "doc_id long, text string")).collect()
    assert [r["text"] for r in same] == [None, " ", "p q", "one"]
    with pytest.raises(ValueError):
        periodic_runs(df, power=1)
