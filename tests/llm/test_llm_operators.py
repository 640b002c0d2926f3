"""Each operator against a brute-force version, and on awkward tables: nulls, empty and very long texts, ties and repeated rows,
empty tables, extra columns with clashing names."""

import base64
import gzip
import hashlib
import io
import itertools
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from conftest import SMALL, same_rows
from pyspark.sql import functions as F

from raysheaf.llm import byte_bpe, chat_format, components, decontaminate, exact_dedup, language_id, license_scan, quality, rows, simhash, simhash_similar, suffix_dedup, warc
from raysheaf.llm.queries import ORACLES, QUERIES

CLASHING = "key string, digest string, fp string, node long, component long, spans string, __gone long, places string, n_words long, kept string"
LONG = "lorem ipsum dolor " * 12_000


def awkward(spark):
    """doc_id, text and columns that operators might use themselves, all null or not."""
    texts = [None, "", " \n\t ", "a", "One two three four five six.", "One two three four five six.", LONG, "é漢字 🙂\u0000\u0001 <|turn|> & </s>", "x" * 5000]
    rows = [(i, t, *(["k"] * 3 + [1, 2] + ["s", 3, "p", 4, "z"])) for i, t in enumerate(texts)]
    rows += [rows[4], rows[6], (None, "no id", *[None] * 10), (None, None, *[None] * 10)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}")


def none(spark):
    return awkward(spark).limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLES[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_removal_decides_on_rows(spark):
    rows = [(1, "A a a a", 1), (1, "unique text", 2), (2, "A a a a", 3), (2, "A a a a", 4), (None, "A a a a", 5), (None, "solo one", 6), (3, None, 7), (3, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long")
    kept = lambda out: sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert kept(exact_dedup.drop_copies(docs)) == [(0, "solo one"), (1, "unique text"), (2, "A a a a"), (3, "")]
    for near in (simhash.keep_one, simhash_similar.keep_one):
        out = near(docs)
        assert out.columns == docs.columns and kept(out) == [(0, "solo one"), (1, "A a a a"), (1, "unique text"), (3, "")]
    bench = spark.createDataFrame([(1, "A a a a")], "item_id long, text string")
    assert kept(decontaminate.drop_contaminated(docs, bench)) == [(0, "solo one"), (1, "unique text"), (3, ""), (3, "")]


def test_full_bitmaps_remove_the_same_rows(spark, tmp_path, monkeypatch):
    spark.range(500).selectExpr("id AS doc_id", "concat('t', id % 170) AS text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for words in (rows.WORDS, 1):  # with one word nearly every row goes on to the join
        monkeypatch.setattr(rows, "WORDS", words)
        assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == list(range(330, 500))


def test_sketches_never_rule_out_what_is_similar():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 64, 65, 700, 3000):
        for part in (0.5, 0.8, 0.9, 1.0):
            one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            two = np.unique(np.concatenate([one[: int(n * part)], rng.integers(0, 1 << 63, n - int(n * part)).astype(np.uint64)]))
            differ = len(np.setxor1d(one, two))
            least = simhash_similar.apart_at_least(simhash_similar.sketch_of(one), simhash_similar.sketch_of(two))
            assert least <= differ and (least - differ) % 2 == 0
            if part == 0.5 and n >= 700:
                assert least > (len(one) + len(two)) / 9  # too far for a similarity of 0.8


def test_rows_have_one_name_each(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 7 AS id", "'x' AS __row", "'y' AS _metadata")
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    for frame in (df, spark.read.parquet(str(tmp_path / "t")), df.limit(0), df.union(df)):
        named, row = rows.named(frame, F.col("id"))
        assert named.select(row).distinct().count() == frame.count() and set(frame.columns) < set(named.columns)
        again, _ = rows.named(frame, F.col("id"))
        if frame.sparkSession.read and "Relation" in frame._jdf.queryExecution().analyzed().toString()[:9]:
            assert named.select(row).exceptAll(again.select(row)).count() == 0


# ---- 1


def test_license_scan(spark):
    model = license_scan.train([license_scan.words_of(t) for t in ("The cat sat on the mat.", "Version 3 of the report is here.", "all of them and more")])
    filler = "The driver went home and slept. " * 60
    rows = [
        (0, "Some words.\nReleased under the MIT License.\nMore words."),
        (1, filler + "This work is licensed under the GNU General Public License, version 3. " + filler),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction, including the rights to use, copy, modify"),
        (3, "SPDX-License-Identifier: Apache-2.0"),
        (4, "The driver lost his license after the third version of the report."),
        (5, filler),
        (6, "Licensed under CC BY-NC 4.0."),
    ]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    families = {i: {m.family for m in r.matches if m.confirmed} for i, r in out.items()}
    assert families == {0: {"MIT"}, 1: {"GPL"}, 2: {"MIT"}, 3: {"Apache-2.0"}, 4: set(), 5: set(), 6: {"CC-BY-NC"}}
    assert out[0].matches[0].paragraph == 1 and out[0].n_paragraphs == 3


def test_license_scan_wrapped(spark):
    import textwrap

    model = license_scan.train([license_scan.words_of(t) for t in ("The cat sat on the mat.", "Version 3 of the report is here.")])
    text = {f: max(license_scan.TEMPLATES[f], key=len) for f in ("MIT", "ISC")}
    rows = [(i, "Some title\n\n" + textwrap.fill(text[f], width, initial_indent=mark, subsequent_indent=mark) + "\n\nint main() {}")
            for i, (f, width, mark) in enumerate((f, w, m) for f in text for w in (40, 78) for m in ("", " * "))]
    rows.append((8, "\n\n".join(textwrap.wrap(text["ISC"], 30))))
    out = {r.doc_id: {m.family for m in r.matches if m.confirmed} for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert out == {**{i: {"MIT"} for i in range(4)}, **{i: {"ISC"} for i in range(4, 8)}, 8: set()}


def test_license_scan_awkward(spark):
    docs = awkward(spark)
    model = license_scan.train(license_scan.unknown_paragraphs(docs), rounds=20)
    rows = license_scan.scan(docs, model).collect()
    assert len(rows) == docs.count() and {r.doc_id: r.n_paragraphs for r in rows}[1] == 0
    assert license_scan.scan(none(spark), license_scan.train(license_scan.unknown_paragraphs(none(spark)), rounds=2)).count() == 0


def plain_scores(model, text):
    """(paragraph, family, probability, similarity) of each line of at most ``SPAN`` words, by counting its word runs one by one."""
    names = {i: w for w, i in model.words.items()}
    runs = {}
    for at, code in enumerate(model.grams.tolist()):
        parts = []
        while True:
            parts.append(code % model.n)
            code = code // model.n - 1
            if code < 0:
                break
        runs[tuple(names[p] for p in reversed(parts))] = at
    out, lines = [], [line.split() for line in re.sub(rb"[^a-z0-9\x80-\xff\n]", b" ", text.lower().encode()).split(b"\n")]
    for nth, words in enumerate(line for line in lines if line):
        logits = model.bias.copy()
        for size in (1, 2, 3):
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in runs:
                    logits = logits + model.weights[runs[tuple(words[i : i + size])]]
        p = np.exp(logits / model.temperature)
        p /= p.sum()
        best = int(p[:-1].argmax())
        pairs = set(zip(words, words[1:], strict=False))
        alike = max(len(known & pairs) / len(known) for t in model.template_words[model.families[best]] if (known := set(zip(t, t[1:], strict=False))))
        if p[best] >= model.threshold:
            out.append((nth, model.families[best], p[best], alike))
    return out


def test_license_scores_equal_a_plain_scorer(spark):
    model = license_scan.train([license_scan.words_of(t) for t in ("The cat sat on the mat.", "Version 3 of the report is here.")])
    every = [t for texts in license_scan.TEMPLATES.values() for t in texts]
    rng = random.Random(4)
    words = " ".join(every).split() + ["and", "cat", "2021", "Zoë"]
    texts = ["\n\n".join(" ".join((rng.choice(every).replace("#", "3") + " " + " ".join(rng.choices(words, k=4))).split()[:20]) for _ in range(6)) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = 0
    for r in license_scan.scan(docs, model).collect():
        got = sorted((m.paragraph, m.family, m.probability, m.similarity) for m in r.matches)
        want = sorted(plain_scores(model, texts[r.doc_id]))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2:] for g in got] == [pytest.approx(w[2:]) for w in want]
        found += len(got)
    assert found > 50


def test_license_wording_that_is_in_no_template(spark):
    """Held back from training and calibration: five of six paraphrases are confirmed as their family (the first of the GPL is taken
    for the LGPL), ordinary prose isn't confirmed as any."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = license_scan.train(license_scan.unknown_paragraphs(docs))
    said = {
        "MIT": ["You may use this library under the MIT license.", "Distributed under the terms of the MIT License, see the file."],
        "GPL": ["You can change it under the GNU General Public License as published, version 3 or later.", "This program is covered by the GNU General Public License version 2."],
        "Apache-2.0": ["Licensed under the Apache License, Version 2.0 by Acme.", "You may get a copy of the Apache License, Version 2.0, at our site."],
    }
    plain = ["The licensed driver showed a copy of the report.", "Free of charge, she granted him permission to leave.", "Version 2.0 of the menu is without sugar.", "The public general was apache and free."]
    rows = [(f, t) for f, texts in said.items() for t in texts] + [("", t) for t in plain]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: {m.family for m in r.matches if m.confirmed} for r in license_scan.scan(docs, model).collect()}
    assert not any(got[i] for i, (f, _) in enumerate(rows) if not f)
    assert sum(got[i] == {f} for i, (f, _) in enumerate(rows) if f) >= 5


def test_license_sample_is_the_same_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "SAMPLE_DOCS", 20)
    docs = spark.createDataFrame([(None if i % 3 else i, f"line {i} of prose\nanother {i}") for i in range(60)], "doc_id long, text string")
    one, two = (license_scan.unknown_paragraphs(d) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two and len(one) == 40


def test_license_terms_held_back():
    model = license_scan.train([])
    texts, classes = license_scan._renderings(model, np.random.default_rng(99))
    group = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    p = model.probabilities(model.logits(model.ids([w for t in texts for w in t]), group, len(texts)))
    assert (p.argmax(1) == np.array(classes)).mean() > 0.98


# ---- 2


def conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in range(6):
        if c % 2:
            rows.append((c, 0, "system", "Be kind. " * rng.randint(1, 9)))
        for t in range(1, rng.randint(2, 60)):
            rows.append((c, t, "user" if t % 2 else "assistant", "".join(rng.choice(["w ", "<|end|>", "&lt;", "é", "\n", "<|turn|>"]) for _ in range(rng.randint(0, 200)))))
    rows += [(77, 0, None, None), (77, 0, None, None), (77, None, "assistant", "first"), (None, 1, "user", "x"), (None, 2, "assistant", "y"), (78, 1, "assistant", LONG)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit("w"), "pos": F.lit(3), "block": F.lit(None)})


def test_chat_format(spark):
    rows, df = conversations(spark)
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.chat_windows(df, budget=90, history=20, block=4)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})


def test_chat_windows_are_budgeted(spark):
    rows, df = conversations(spark)
    windows = chat_format.chat_windows(df, budget=90, history=20, block=4).collect()
    by = {}
    for w in sorted(windows, key=lambda w: w.window):
        by.setdefault(w.conv_id, []).append(w)
    for conv, ws in by.items():
        system = next((r for r in rows if r[0] == conv and r[1] == 0 and r[2] == "system"), None)
        for i, w in enumerate(ws):
            parts = w.formatted.split(chat_format.TURN)[1:]
            assert len(parts) == w.n_repeated + w.n_turns and w.n_turns >= 1
            size = lambda p: 4 + len([x for x in re.split("[\t-\r ]+", p.split(chat_format.TEXT)[1].removesuffix(chat_format.END)) if x])
            assert w.n_tokens == sum(map(size, parts))
            alone = [p for p in parts if not p.startswith("system")]
            assert w.n_tokens <= 90 or len(alone) == 1  # one turn and the system turn may be longer
            if system and i:
                assert parts[0].startswith("system" + chat_format.TEXT)
            if i:  # repeated turns are the end of the window before, besides the system turn
                earlier = ws[i - 1].formatted.split(chat_format.TURN)[1:]
                again = [p for p in parts[: w.n_repeated] if not p.startswith("system")]
                assert again == (earlier[-len(again) :] if again else [])
            masked = "".join(w.formatted[s.begin : s.begin + s.length] for s in w.loss_spans)
            fresh = [p for p in parts[w.n_repeated :] if p.startswith("assistant")]
            assert masked == "".join(p.split(chat_format.TEXT)[1].removesuffix(chat_format.END) for p in fresh)
    with pytest.raises(ValueError):
        chat_format.chat_windows(df, budget=5, history=5)
    assert chat_format.chat_digests(chat_format.chat_windows(df.limit(0))).count() == 0
    chars = chat_format.chat_windows(df, budget=4000, tokens=lambda text: F.char_length(text)).collect()
    assert any(w.n_tokens > 2000 for w in chars) and all(w.n_tokens <= 4000 or w.n_turns <= 2 for w in chars)


def test_chat_windows_fill_the_budget(spark):
    windows = chat_format.chat_windows(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).cache()
    assert windows.where(f"n_tokens > {chat_format.BUDGET} and n_turns > 2").count() == 0
    assert windows.where("n_repeated > 1").count() > 0


def test_native_operators_have_no_python(spark):
    for frame in (QUERIES["op2_chat_format"](spark, SMALL), QUERIES["op7_exact_dedup"](spark, SMALL)):
        plan = frame._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "ExistingRDD"))


# ---- 3


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


def test_bpe_equals_tiktoken(spark, tokenizer):
    path, pattern, reference = tokenizer
    rng = random.Random(2)
    alphabet = "ab \n\t'’sSéñ漢字🙂\x1c\x85 ​0١ⅷ!$$ aaaathethe''s"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["a" * 5000, "é" * 3000, " " * 4000, "ab" * 3000, LONG, "".join(rng.choice("abcdefgh") for _ in range(20_000))]
    texts += [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    out = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, pattern), path).collect()
    for r in out:
        assert r.ids == reference.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and bytes(r.decoded) == texts[r.doc_id].encode()
    assert len(out) == len(texts)


def test_bpe_awkward(spark, tokenizer):
    path, pattern, reference = tokenizer
    docs = awkward(spark)
    out = byte_bpe.digests(byte_bpe.encode(docs, path, pattern), path).collect()
    want = sorted(hashlib.sha256(",".join(map(str, reference.encode_ordinary(r.text or ""))).encode()).hexdigest() for r in docs.collect())
    assert sorted(r.ids_sha256 for r in out) == want
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert byte_bpe.encode(none(spark), path, pattern).count() == 0


def test_replay_with_merges_that_open_earlier_ones():
    rng = random.Random(3)
    for _ in range(40):  # random vocabularies, whose merges aren't in any trained order
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 290:
            tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 4))))
        order = sorted(tokens, key=lambda t: (len(t) > 1, rng.random()))
        ranks = {t: i for i, t in enumerate(order)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(30)]
        ids, counts = byte_bpe.replay(words, byte_bpe.MergeTable(ranks))
        at = 0
        for word, n in zip(words, counts.tolist(), strict=True):
            parts = [bytes([b]) for b in word]
            while True:
                best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert ids[at : at + n].tolist() == [ranks[p] for p in parts]
            at += n


# ---- 4


def pages(spark):
    rows = [(i, f"http://www.h{i % 3}.example.com/p{i % 7}?Q={i % 2}", f"<p>{i % 5}</p>\r\n\r\nWARC/1.1\r\n") for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "http://x.com/\r\nEvil: 1", "é" * 70_000), (103, "::::", "é" * 70_000), (104, "http://[bad", "x"), (50, "http://h.example.com/", "once")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"first": F.lit(1), "bytes": F.lit("b"), "record": F.lit(None)})


def test_warc(spark, tmp_path):
    rows, df = pages(spark)
    out = warc.capture_histories(df.repartition(3), str(tmp_path / "w")).collect()
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", i)
    for r in out:
        html = next(h for i, _, h in rows if i == r.page_id) or ""
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == r.page_id else ("revisit", first[html]))
    assert len(out) == len(rows)
    order = [(r.url_key, r.ts, r.page_id) for r in out]
    assert order == sorted(order, key=lambda k: (k[0].encode(), *k[1:]))
    for r in out:  # what the index says is where the record is, alone in its member
        with open(tmp_path / "w" / r.file, "rb") as file:
            file.seek(r.offset)
            record = gzip.decompress(file.read(r.length))
        assert record.startswith(b"WARC/1.1\r\n") and f"page:{r.page_id}>".encode() in record and record.endswith(b"\r\n\r\n")


def test_warc_files_are_bounded(spark, tmp_path):
    rows, df = pages(spark)
    path = warc.write_archives(df.coalesce(1), str(tmp_path / "w"), file_bytes=3000)
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(rows)
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"a task that was lost")  # isn't in the manifest
    assert warc.read_runs(spark, path).count() == len(rows)


@pytest.mark.parametrize("pack", ["members", "one member", "plain"])
def test_warc_parse(pack):
    texts = [f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n" for n in (0, 3, 5000, 1, 0)]
    content = {"members": b"".join(map(gzip.compress, texts)), "one member": gzip.compress(b"".join(texts)), "plain": b"".join(texts)}[pack]
    for step in (1, 7, 1 << 20):
        stream = io.BytesIO(content)
        found = list(warc.parse(lambda n: stream.read(min(n, step))))
        assert [len(block) for _, block, _, _ in found] == [0, 3, 5000, 1, 0]
        for (_, _, at, n), text in zip(found, texts, strict=True):
            if pack == "one member":
                assert at is None and n is None
            else:
                assert (gzip.decompress(content[at : at + n]) if pack == "members" else content[at : at + n]) == text


def test_warc_repeated_pages_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(5, "u", "a"), (5, "u", "a"), (None, "u", "a"), (None, None, "b"), (7, "v", "b"), (5, "u", "c")], "page_id long, url string, html string")
    out = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in warc.capture_histories(df, str(tmp_path / "w")).collect())
    assert out == sorted([(5, "response", -1), (5, "response", -1), (-1, "revisit", 5), (-1, "revisit", 7), (7, "response", -1), (5, "response", -1)])


def test_warc_ids_of_any_size_and_dates(spark, tmp_path):
    from datetime import datetime

    ids = [1 << 62, (1 << 63) - 1, -(1 << 63), -5, 0, 10**12, None, 7, 250_000_000_000]
    rows = [(i, "http://a.org/x", f"page {n}") for n, i in enumerate(ids)]
    out = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a")).collect()
    assert {r.page_id for r in out} == set(ids) and {len(r.ts) for r in out} == {14}
    stamps = [r.ts for r in sorted(out, key=lambda r: r.ts)]
    assert [r.ts for r in out] == stamps and stamps == sorted(stamps, key=lambda s: datetime.strptime(s, "%Y%m%d%H%M%S"))
    dated = spark.createDataFrame([(i, "http://a.org/x", "", d) for i, d in ((1, "2031-05-06 07:08:09"), (2, "0001-01-01 00:00:00"), (3, None))], "page_id long, url string, html string, at string")
    dated = dated.withColumn("at", F.col("at").cast("timestamp"))
    got = {r.page_id: r.ts for r in warc.capture_histories(dated, str(tmp_path / "b"), date_col="at").collect()}
    assert got[1] == "20310506070809" and got[2] == "10000101000000" and len(got[3]) == 14
    with pytest.raises(ValueError, match="whole number"):
        warc.records(spark.createDataFrame([("p", "u", "h")], "page_id string, url string, html string"))


def test_warc_least_and_empty(spark, tmp_path):
    rows, df = pages(spark)
    out = {r.page_id: r.record_type for r in warc.capture_histories(df, str(tmp_path / "a"), least=1000).collect()}
    assert [i for i, kind in out.items() if kind == "revisit"] == [103]
    assert warc.capture_histories(df.limit(0), str(tmp_path / "b")).count() == 0


def test_loser_tree_and_external_merge(tmp_path):
    rng = random.Random(5)
    entry = lambda k, i: (i, k, f"{rng.randint(0, 3):04d}", "response", None, 1, "d", "f", i, 1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((entry(rng.choice("abc"), i + 100 * r) for i in range(rng.randint(0, 9))), key=warc._order) for r in range(k)]
        want = sorted(itertools.chain(*runs), key=warc._order)
        assert list(warc.LoserTree([iter(r) for r in runs])) == want
        for memory in (1, 5, 1000):
            assert list(warc.merge_runs(iter(itertools.chain(*runs)), str(tmp_path), memory)) == want


# ---- 5


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.resample(docs, labels).cache()
    assert out.count() == docs.count() and 0 < out.where("selected").count() < docs.count()
    again = quality.resample(docs, labels)
    assert out.select("doc_id", "selected").exceptAll(again.select("doc_id", "selected")).count() == 0
    for k in (0, 1, 57, 10_000):
        assert quality.resample(docs, labels, k=k).where("selected").count() == min(k, docs.count())


def test_quality_equals_a_plain_sampler(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    sampler = quality.Sampler(docs, labels, "doc_id", "text", None, quality.SEED)
    grams, texts = quality.Grams(), {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in labels.collect() if r.quality != 1 or r.toxic}  # a toxic document is a bad one
    target = {r.doc_id for r in labels.collect()} - bad
    count = lambda ids: sum((np.bincount(grams.of(texts[i]), minlength=quality.BUCKETS) for i in ids), np.zeros(quality.BUCKETS))
    raw, good = count(texts), count(i for i in target if not quality.held_back(i))
    p_raw = (raw + 1) / (raw + 1).sum()
    pseudo = quality.SMOOTHING * quality.BUCKETS
    ratios = np.log((good + pseudo * p_raw) / (good.sum() + pseudo)) - np.log(p_raw)
    assert np.allclose(ratios, sampler.ratios)
    mean = lambda i: ratios[grams.of(texts[i])].sum() / (len(grams.of(texts[i])) + quality.FEW)
    out = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    for i, r in out.items():
        assert r.log_weight == pytest.approx(sampler.slope * mean(i) + sampler.intercept, abs=1e-9)
    k = sum(r.log_weight >= -np.log(quality.LOST_COST) for r in out.values())
    top = sorted(out.values(), key=lambda r: -r.gumbel_key)[:k]
    assert {r.doc_id for r in top} == {i for i, r in out.items() if r.selected}
    assert {r.doc_id for r in top} != {r.doc_id for r in sorted(out.values(), key=lambda r: -r.log_weight)[:k]}  # the noise decides between
    other = {r.doc_id for r in quality.resample(docs, labels, seed=5).where("selected").collect()}
    assert other != {r.doc_id for r in top} and len(other) == k


def test_quality_grams(spark):
    grams = quality.Grams()
    a, b = grams.of("one two"), grams.of("two one")
    assert len(a) == 2 + 1 + 4 and len(set(a[:2]) & set(b[:2])) == 2 and a[2] != b[2]
    assert grams.of("x x")[1] == grams.of("yy yy")[1] == grams.of("z, z")[2]  # a repeated word is a mark
    assert not len(grams.of(None)) and not len(grams.of(" \n\t"))


def test_quality_log_odds():
    rng = np.random.default_rng(3)
    means = rng.normal(0, 0.2, 20_000)
    good = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 + 4 * means)))).astype(float)
    assert quality.log_odds(means, good) == pytest.approx((0.7, 4), abs=0.25)
    a, b = quality.log_odds(np.array([0.0, 0.1, 0.9, 1.0]), np.array([0.0, 0, 1, 1]))  # parted sharply, yet finite
    assert 0 < b < 1000 and a < 0


def test_quality_parts_good_from_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.resample(docs, labels).join(labels, "doc_id").where("toxic = 0").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in rows}
    assert share[1] > 0.97 and share[0] < 0.25


def test_quality_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, None), (5, None, 0), (None, 1, 0), (6, 0, 0), (8, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, labels).count() == docs.count()
    assert quality.keep_selected(docs, labels).columns == docs.columns
    assert quality.resample(docs, labels.limit(0)).where("selected").count() == docs.count()
    assert quality.resample(none(spark), labels).count() == 0
    assert quality.keep_selected(docs, labels, k=0).count() == 0


def test_kth_largest_is_exact(spark):
    rng = random.Random(6)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 300 + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 400, 700, 801):
        assert quality.kth_largest(df, "v", k, bins=8, few=5) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", len(values)) is None


# ---- 6


def brute_groups(nodes, near):
    """Smallest reachable position of each node."""
    root = list(range(len(nodes)))
    for _ in nodes:
        for i in range(len(nodes)):
            for j in range(len(nodes)):
                if near(nodes[i], nodes[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(7)
    nodes = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(8):
            fp = base
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                fp ^= 1 << bit
            nodes.append(fp)
    nodes = sorted({n - (1 << 64) if n >= 1 << 63 else n for n in nodes})
    want = {(a, b) for a, b in itertools.combinations(nodes, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    for hot in (simhash.HOT, 4):
        got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(n,) for n in nodes], "fp long"), hot=hot).collect()}
        assert got <= want
        reach = lambda pairs: brute_groups(nodes, lambda x, y: tuple(sorted((x, y))) in pairs)
        assert reach(got) == reach(want)


def test_dense_fingerprints_make_few_links(spark):
    near = [0] + [1 << i for i in range(62)] + [1 << i | 1 << j for i in range(62) for j in range(i)]  # all within 4 bits of each other
    found = simhash.links(spark.createDataFrame([(n,) for n in near], "fp long")).distinct()
    assert found.count() <= 64 * len(near) < len(near) ** 2 // 8
    assert set(r.component for r in components.components(found).collect()) == {0}


def test_forest_is_linear_and_whole():
    rng = np.random.default_rng(21)
    fp = rng.integers(0, 1 << 12, 300, dtype=np.int64).view(np.uint64)
    key = np.sort(rng.integers(0, 9, 300))
    edges = simhash.forest(key, fp, 2)
    close = lambda i, j: key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= 2
    assert all(close(i, j) for i, j in edges)
    want = brute_groups(list(range(300)), close)
    assert len(edges) == 300 - len(set(want)) and brute_groups(list(range(300)), lambda i, j: (i, j) in edges or (j, i) in edges) == want


def test_near_groups(spark):
    import xxhash

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    def plain(text):
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    ids = sorted(texts)
    fps = [plain(texts[i]) for i in ids]
    root = brute_groups(fps, lambda a, b: bin(a ^ b).count("1") <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_near_dedup"](spark, SMALL).collect()}
    assert got == {i: (f"{fp:016x}", ids[r]) for i, fp, r in zip(ids, fps, root, strict=True)}


def test_simhash_awkward(spark):
    docs = awkward(spark)
    out = simhash.near_groups(docs).collect()
    assert len(out) == docs.count() and {r.component_id for r in out if r.fp == 0} == {0}
    assert simhash.near_groups(none(spark)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 3, 4, 6, 7, 8, None}


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(60)]
    links = chain + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(500, 500), (7, 3), (3, 7)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in root.items() if n != 500 and any(n in link and link[0] != link[1] for link in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [simhash_similar.HOT, 2])
def test_similar_groups(spark, hot):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900)]
    rows, base_of = [], {}
    for base in range(8):
        words = [rng.choice(vocabulary) for _ in range(220)]
        for _ in range(12):
            copy = list(words)
            for at in rng.sample(range(220), rng.randint(0, 2)):  # similarity of 0.9 and more between any two
                copy[at] = rng.choice(vocabulary)
            base_of[len(rows)] = base
            rows.append((len(rows), " ".join(copy)))
    out = {r.doc_id: r.component_id for r in simhash_similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert out == {i: 12 * b for i, b in base_of.items()}


def test_spanning_tree_holds_each_closest_link():
    rng = np.random.default_rng(13)
    bits = rng.integers(0, 1 << 63, (40, 4), dtype=np.int64).view(np.uint64)
    bits[20:] = bits[:20] ^ (np.uint64(1) << rng.integers(0, 63, (20, 4)).astype(np.uint64))
    distance = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    edges = simhash_similar._tree(bits[:, 0], bits, None, 256)
    assert len(edges) == 39 and len(simhash_similar._tree(bits[:, 0], bits, None, 4)) == 20
    for i in range(40):
        closest = min(distance(i, j) for j in range(40) if j != i)
        assert min(distance(a, b) for a, b in edges if i in (a, b)) == closest


def test_similar_groups_are_verified(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    group = {r.doc_id: r.component_id for r in simhash_similar.similar_groups(docs).collect()}
    sets = {i: simhash_similar.shingles_of(t, 5) for i, t in texts.items()}
    members = {}
    for i, c in group.items():
        members.setdefault(c, []).append(i)
    for c, ids in members.items():
        assert c == min(ids)
        for i in ids if len(ids) > 1 else ():
            assert max(len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) if sets[i] else 1.0 for j in ids if j != i) >= 0.8


@pytest.mark.parametrize("hot", [simhash_similar.HOT, 4])
def test_similar_groups_find_passages(spark, hot):
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    alike = lambda a, b: len(a & b) / len(a | b)
    rows, seen = [], []
    for i in range(150):  # a passage appended, prepended or cut: similarities of 0.80 to 0.85
        words = some(rng.choice([60, 120, 300]))
        passage = round(len(words) * rng.uniform(0.18, 0.23))
        copy = [words + some(passage), some(passage) + words, words[: -round(passage * 0.8)]][i % 3]
        texts = " ".join(words), " ".join(copy)
        seen.append(alike(*(simhash_similar.shingles_of(t, 5) for t in texts)))
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
    out = {r.doc_id: r.component_id for r in simhash_similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert sum(0.8 <= s < 0.85 for s in seen) > 100
    assert [out[2 * i + 1] == 2 * i for i in range(150)] == [s >= 0.8 for s in seen]


@pytest.mark.parametrize("hot", [simhash_similar.HOT, 40])
def test_similar_groups_in_templates(spark, hot):
    rng = random.Random(37)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    template, rows = some(200), []  # any two documents have 0.77, those of a pair 0.83
    for i in range(100):
        shared = some(9)
        rows += [(2 * i, " ".join(template + shared + some(20))), (2 * i + 1, " ".join(template + shared + some(20)))]
    out = {r.doc_id: r.component_id for r in simhash_similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert out == {i: i // 2 * 2 for i in range(200)}


def test_similar_groups_awkward(spark):
    docs = awkward(spark)
    assert simhash_similar.similar_groups(docs).count() == docs.count()
    assert simhash_similar.similar_groups(none(spark)).count() == 0
    assert simhash_similar.keep_one(docs).columns == docs.columns


# ---- 7


def test_exact_awkward(spark):
    docs = awkward(spark)
    out = exact_dedup.exact_groups(docs, salts=3).collect()
    by = {}
    for r in docs.collect():
        by.setdefault(r.text or "", []).append(r.doc_id)
    for r in out:
        members = by[next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)]
        keep = max((m for m in members if m is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(members), r.doc_id == keep)
    assert len(out) == docs.count()
    assert exact_dedup.exact_groups(none(spark)).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == [1, 2, 3, 5, 6, 7, 8]


def test_exact_content_decides_when_digests_clash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.sha1(F.substring(F.col("text"), 1, 1)))
    rows = [(1, "ax"), (2, "ay"), (3, "ax"), (4, "b"), (5, "ay"), (6, "")]
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (3, 2), 3: (3, 2), 2: (5, 2), 5: (5, 2), 4: (4, 1), 6: (6, 1)}
    kept = exact_dedup.drop_copies(spark.createDataFrame([*rows, (7, "b"), (7, "b")], "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(3, "ax"), (5, "ay"), (6, ""), (7, "b")]


# ---- 8


def repeats():
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, base, short = text(900), text(3000), text(395)
    texts = [base, base, base[:1500] + "X" + base[1501:], text(500) + passage + text(300), text(20) + passage, passage[100:700] + text(100) + passage[300:800]]
    texts += ["a" * 1500, "a" * 402 + "b" + "a" * 300, "ab" * 700, None, "", "short", text(400), text(399), passage[:400], base[700:1099]]
    texts += [text(250) + short + text(250) for _ in range(20)] + [text(rng.randint(0, 300)) + passage[200 : 200 + rng.randint(380, 450)] + text(200) for _ in range(25)]
    return texts + [x[: rng.randint(300, 2500)] + text(5) + x[900:] for x in [base] * 12]


@pytest.mark.parametrize("group, block", [(suffix_dedup.GROUP, suffix_dedup.BLOCK), (3, 1000), (1, 5000)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, group, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = repeats()
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, run long").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.cut_repeats(df, group=group).collect()}
    for i, (n_bytes, n_removed, n_spans, digest) in enumerate(suffix_dedup.brute_force(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.spans or [])) == (n_bytes, n_removed, n_spans)
        assert (hashlib.sha256(r.kept).hexdigest() if r.kept is not None else r.text_sha256) == digest


def test_suffix_dedup_query_equals_brute_force(spark):
    where = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op8_suffix_dedup"](spark, where).collect()}
    docs = spark.read.parquet(f"{where}/documents.parquet").collect()
    for r, want in zip(docs, suffix_dedup.brute_force([r.text for r in docs]), strict=True):
        x = got[r.doc_id]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want and x.n_kept == x.n_bytes - x.n_removed


def test_suffix_dedup_of_runs_with_one_hash(spark, monkeypatch):
    find = suffix_dedup.Anchors.find
    monkeypatch.setattr(suffix_dedup.Anchors, "find", lambda *a: (find(*a)[0] % 5, *find(*a)[1:]))  # contents decide
    texts = repeats()[:30]
    with_ids = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.cut_repeats(with_ids, group=4).collect()}
    assert got == {i: w[1] for i, w in enumerate(suffix_dedup.brute_force(texts))}


def test_suffix_dedup_awkward(spark):
    docs = awkward(spark)
    got = suffix_dedup.cut_repeats(docs).collect()
    want = suffix_dedup.brute_force([r.text if r.doc_id != 6 else None for r in docs.collect()])
    assert len(got) == docs.count() and sorted(r.n_removed for r in got if r.doc_id != 6) == sorted(w[1] for w, r in zip(want, docs.collect(), strict=True) if r.doc_id != 6)
    assert all(r.n_removed == len(LONG) for r in got if r.doc_id == 6)
    assert suffix_dedup.cut_repeats(none(spark)).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(11)
    for _ in range(150):
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60)))
        strings = [b"xyz" + base[: rng.randint(0, 60)] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 30))]
        order, prefix = suffix_dedup.deep_shallow(strings, 3, rng.choice([0, 2, 12]))
        assert [strings[i] for i in order] == sorted(strings)
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            assert prefix[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


# ---- 9


def test_decontamination_equals_brute_force(spark):
    docs, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    words = [w for _, t in items for w in t.split()]
    rng = random.Random(12)
    made = [(1000 + i, " ".join(rng.choice(words) for _ in range(30)) + " " + " ".join(t.upper().split()[:20]) + "-- " + t[:100]) for i, (_, t) in enumerate(items[:20])]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    items += [(900, "only four words here"), (901, ""), (902, None), (903, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.judged(decontaminate.find_matches(docs, bench)).collect()}
    for r in docs.collect():
        n, hit, found = decontaminate.brute_force(r.text, items)
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.items, x.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n)
        assert sum(x.lengths) == hit


def test_decontamination_of_short_and_repeated_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 200)
    rng = random.Random(14)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 3, 5, 13, 14, 20]))) for i in range(12)]
    rows = [(i % 40, some(rng.randint(0, 60))) for i in range(80)] + [(None, "a a a b"), (None, "c c c b")]  # ids repeat
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (4, 13):
        got = decontaminate.find_matches(docs, bench, window).collect()
        shown = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, sum(r.lengths), r.items) for r in got)
        plain = [(i, *decontaminate.brute_force(t, items, window)) for i, t in rows]
        assert shown == sorted((-1 if i is None else i, n, hit, hit, found) for i, n, hit, found in plain)


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "alpha beta gamma delta"), (1, "alpha beta and gamma delta"), (2, "alpha and so on for long beta gamma delta"), (3, "beta gamma")], "doc_id long, text string")
    exact = {r.doc_id: len(r.items) for r in decontaminate.find_matches(docs, bench).collect()}
    near = {r.doc_id: len(r.items) for r in decontaminate.find_matches(docs, bench, slop=1).collect()}
    assert exact == {0: 1, 1: 0, 2: 0, 3: 0} and near == {0: 1, 1: 1, 2: 0, 3: 0}


def test_decontamination_awkward(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "One two three"), (2, None), (None, "lorem"), (3, "")], "item_id long, text string")
    got = decontaminate.judged(decontaminate.find_matches(docs, bench)).collect()
    assert len(got) == docs.count() and {r.doc_id: r.n_words for r in got}[0] == 0
    assert all(r.contaminated for r in got if r.doc_id in (4, 5, 6)) and not any(r.contaminated for r in got if r.doc_id in (0, 1, 2, 3, 8))
    assert decontaminate.find_matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_matches(none(spark), bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


# ---- 10


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert {r.doc_id for r in rows} <= {i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, logs = language_id.fit(docs)
    texts = {r.lang: r.text for r in docs.where("n_chars between 1500 and 3000").dropDuplicates(["lang"]).collect()}
    mixed = language_id.mixtures([texts["de"][:1000] + " " + texts["fr"][:1000], texts["en"], "", "123 !!", "a"], logs)
    shares = dict(zip(langs, mixed[0], strict=True))
    assert 0.25 < shares["de"] < 0.75 and 0.25 < shares["fr"] < 0.75 and shares["de"] + shares["fr"] > 0.9
    assert mixed[1].max() > 0.9 and not mixed[2].any() and not mixed[3].any() and mixed[4].sum() == pytest.approx(1)


def plain_mixture(text, logs, penalty):
    """EM over units of words and the choice of languages, one text at a time and without arrays of units."""
    words = re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).split()
    raw = b" " + b" ".join(words) + b"  "
    units, space = {}, -1
    for i in range(len(raw) - 3):
        space += raw[i] == 0x20
        bucket = (int.from_bytes(raw[i : i + 4], "little") * 2654435761 & 0xFFFFFFFF) >> 18
        row = units.setdefault(space // language_id.UNIT, np.zeros(logs.shape[1], dtype=np.float64))
        row += logs[bucket]
    lik = [np.exp((u - u.max()) / 4) for _, u in sorted(units.items())]

    def em(shares, allowed, rounds):
        for _ in range(rounds):
            shares = sum(x * shares / (x * shares).sum() for x in lik) / len(lik) * allowed
            shares = shares / shares.sum()
        return shares, sum(np.log((x * shares).sum()) for x in lik)

    allowed = np.ones(logs.shape[1])
    shares, fit = em(allowed / len(allowed), allowed, language_id.ROUNDS)
    while allowed.sum() > 1:
        less = allowed.copy()
        less[np.where(allowed > 0, shares, np.inf).argmin()] = 0
        start = (shares + 1e-6) * less
        tried, tried_fit = em(start / start.sum(), less, language_id.MORE)
        if 2 * (fit - tried_fit) > penalty * np.log(len(lik) + 1.0):
            break
        allowed, shares, fit = less, tried, tried_fit
    return shares


def test_language_mixtures_equal_plain_em(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    langs, logs = language_id.fit(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect() if r.text]
    texts += [texts[1][:300] + " " + texts[2][:300], "Straße ΑΣ ΣΑΣ \u3000 x\u00a0y 12 \n É"]
    for text, got in zip(texts, language_id.mixtures(texts, logs), strict=True):
        assert got == pytest.approx(plain_mixture(text, logs, language_id.PENALTY), abs=1e-4)


def test_long_texts_are_read_in_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    langs, logs = language_id.fit(docs)
    texts = [r.text or "" for r in docs.limit(60).collect()] + ["", " ", "a", "ab c", "x" * 500, "12 \t 34", "ΑΣ ΣΑΣ. \u3000 x\u00a0y É " * 9]
    whole = language_id.mixtures(texts, logs)
    for block in (1, 2, 7, 100):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert [np.concatenate([language_id.grams(r) for r in language_id._normal(t)]).tolist() for t in texts] == [
            language_id.grams(np.frombuffer(b" " + b" ".join(t.lower().encode().translate(language_id._LETTERS).split()) + b"  ", np.uint8)).tolist() for t in texts
        ]
        assert language_id.mixtures(texts, logs) == pytest.approx(whole, abs=1e-5)
    code = """
import resource, numpy as np
from raysheaf.llm import language_id as L
logs = np.log(np.random.default_rng(1).random((1 << L.BITS, 4))).astype(np.float32)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = "some words of a very long text " * 1_300_000
L.mixtures([text], logs)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    took = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(took) < 500  # MB for a text of 40 MB


def test_language_ignores_what_it_must(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = language_id.identify(docs)
    changed = docs.withColumns({"lang": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")), "source": F.lit("other")})
    assert one.drop("langs").exceptAll(language_id.identify(changed).drop("langs")).count() == 0


def test_language_awkward(spark):
    docs = awkward(spark).withColumn("lang", F.when(F.col("doc_id") > 3, "la"))
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count() and all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert {r.lang_pred for r in rows} <= {"la", "und"} and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0
