"""Prefix trie, line dedup and fill-in-the-middle against plain versions, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_operators import awkward, none

from raysheaf.llm import fill_in_middle, line_dedup, prefix_trie
from raysheaf.session import scratch_path

# ---- prefix trie


def plain_trie(seqs):
    """conv_id -> list of (role, text) to the rows of the trie."""
    members = defaultdict(list)
    for c, turns in seqs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def under(node):
        yield node
        for child in children[node]:
            yield from under(child)

    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in found if end))
        below = list(under(node))
        out.append((
            min(c for c, _ in found), len(node), min(c for c, _ in members[node[:-1]]) if node else None, len(found), len(children[node]),
            sum(not children[b] for b in below), sum((len(members[b]) - 1) * len(b[-1][1]) for b in below if b), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in df.drop("digest").collect()), key=str)


@pytest.mark.parametrize("parts, piece", [(1, 4096), (3, 4096), (8, 2)])
def test_prefix_trie(spark, monkeypatch, parts, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng = random.Random(parts)
    seqs = [(c, [(rng.choice("ua"), rng.choice(["", "x", "héllo", "🙂 y"])) for _ in range(rng.randint(1, 5))]) for c in range(60)]
    seqs += [(100 + c, [("u", "same"), ("a", "one")]) for c in range(90)]  # equal arrays that lie in several ranges
    seqs += [(300 + c, [("u", "same"), ("a", "one"), ("u", str(c))]) for c in range(12)]
    rows = [(c, i, role, text, "k") for c, turns in seqs for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest string")
    arrays = prefix_trie.turn_arrays(conv)
    assert trie_rows(prefix_trie.prefix_trie(arrays, parts)) == plain_trie(seqs)


def test_prefix_trie_rebuilt(spark):
    conv = spark.createDataFrame([(c, t, "u", f"{c % 3}{t}") for c in (0, 1, 2, 3, 50, 107, -1, 250) for t in range(c % 4 + 1)], "conv_id long, turn long, role string, text string")
    import zlib

    own = defaultdict(list)
    for r in conv.orderBy("conv_id", "turn").collect():
        own[r.conv_id].append((r.role, r.text))
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    base = lambda c: c - int(c / 100) * 0 - (abs(c) % 100) * (1 if c >= 0 else -1)
    seqs = [(c, own.get(base(c), [])[: h(c)] + turns[h(c) :]) for c, turns in own.items()]
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(conv)))) == plain_trie(seqs)


def test_prefix_trie_awkward(spark):
    long = "w " * 300_000
    rows = [(1, None, None, None), (1, 0, "a", long), (2, 0, None, ""), (2, 1, "a", long), (None, 0, "u", "lost"), (3, 5, "", None), (3, 5, "", None), (4, 1, "é", "🙂")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seqs = [(1, [("", ""), ("a", long)]), (2, [("", ""), ("a", long)]), (3, [("", ""), ("", "")]), (4, [("é", "🙂")])]
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.turn_arrays(conv))) == plain_trie(seqs)
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.turn_arrays(conv.limit(0)))) == []
    turnless = spark.createDataFrame([(7, []), (8, [])], "conv_id long, turns array<struct<digest:binary,chars:int>>")
    assert trie_rows(prefix_trie.prefix_trie(turnless)) == plain_trie([(7, []), (8, [])])
    parted = [("ab", "c"), ("a", "bc")]  # roles and texts whose concatenations are equal
    twins = spark.createDataFrame([(i, 0, r, t) for i, (r, t) in enumerate(parted)], conv.schema)
    assert trie_rows(prefix_trie.prefix_trie(prefix_trie.turn_arrays(twins))) == plain_trie([(i, [p]) for i, p in enumerate(parted)])


# ---- line dedup


def plain_lines(texts, min_docs, min_chars=1):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    found = Counter(k for t in texts for k in {key(line) for line in t.split("\n")})
    gone = {k for k, n in found.items() if n >= min_docs and len(k) >= min_chars}
    return [(len(t.split("\n")), sum(key(x) in gone for x in t.split("\n")), "\n".join(x for x in t.split("\n") if key(x) not in gone)) for t in texts]


@pytest.mark.parametrize("batches, fanout, min_docs, min_chars", [(1, 4, 3, 1), (7, 2, 3, 1), (9, 3, 10, 2), (4, 2, 1, 1)])
def test_line_dedup(spark, batches, fanout, min_docs, min_chars):
    rng = random.Random(batches)
    pool = ["", " ", "A", "a\t", "É", "é", "🙂", "x y", "X Y ", "\r", *(f"Line {i}" for i in range(60))]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.drop_shared_lines(docs, min_docs=min_docs, min_chars=min_chars, batches=batches, fanout=fanout).collect()}
    assert [got[i] for i in range(120)] == plain_lines(texts, min_docs, min_chars)


def test_line_index_levels_and_restart(spark):
    index = line_dedup.LineIndex(spark, scratch_path(spark, "index"), min_docs=4, fanout=2)
    total, rng = Counter(), random.Random(1)
    for batch in range(7):
        if batch == 4:
            index = line_dedup.LineIndex.opened(spark, index.path)
        keys = [f"{rng.randint(0, 40)}".encode() for _ in range(30)]
        total.update(keys)
        index.add(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"))
        assert all(len(level) < 2 for level in index.levels)
        assert {bytes(r.key) for r in index.shared().collect()} == {k for k, n in total.items() if n >= 4}
    assert [len(level) for level in index.levels] == [1, 1, 1]
    index.add(spark.createDataFrame([], "key binary"))
    assert {bytes(r.key) for r in index.shared().collect()} == {k for k, n in total.items() if n >= 4}
    plan = index.shared()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs meet by bucket
    # a batch that died before the manifest named its run doesn't count
    index._write(spark.createDataFrame([(bytearray(b"7"), 99)], "key binary, docs long"))
    again = line_dedup.LineIndex.opened(spark, index.path)
    assert {bytes(r.key) for r in again.shared().collect()} == {k for k, n in total.items() if n >= 4}
    index.clear()


def test_line_dedup_awkward(spark):
    docs = awkward(spark)
    out = line_dedup.drop_shared_lines(docs, min_docs=2)
    texts = [r.text or "" for r in docs.collect()]
    assert sorted((r.n_lines, r.n_dropped, r.kept) for r in out.collect()) == sorted(plain_lines(texts, 2))
    assert out.where("doc_id is null").count() == 2
    assert line_dedup.drop_shared_lines(none(spark)).count() == 0


# ---- fill in the middle


def plain_middle(doc_id, text, rate=100, spm=50, seed=7, unit=fill_in_middle.LINES):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(unit, text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (n, "plain", None, None, text)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:one], units[one:two], units[two:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return (n, "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out)


@pytest.mark.parametrize("rate, spm, unit", [(100, 50, fill_in_middle.LINES), (60, 0, fill_in_middle.LINES), (90, 100, r"\s*\S+\s*|\s+")])
def test_fill_in_middle(spark, rate, spm, unit):
    rng = random.Random(rate)
    parts = ["a\n", "\n", "<", "<S", ">", "é🙂\n", "P>", "<M", "word word\n", "\r\n", "<P>", "x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), "k") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = fill_in_middle.fill_in_middle(docs, unit=unit, rate=rate, spm=spm)
    got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r.form for r in got} >= {"plain", "spm" if spm else "psm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, rows[r.doc_id][1], rate, spm, unit=unit)
        assert r.back == rows[r.doc_id][1]


def test_fill_in_middle_awkward(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(77, "line of some words\n" * 30_000)], "doc_id long, text string"), True)
    got = fill_in_middle.fill_in_middle(docs).collect()
    want = [(r.doc_id, *plain_middle(r.doc_id, r.text or "")) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert fill_in_middle.fill_in_middle(none(spark)).count() == 0
    plan = fill_in_middle.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
