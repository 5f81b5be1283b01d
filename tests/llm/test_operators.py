"""The ten training-data operators against plain definitions, on small tables with the awkward cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").encode())


def base_text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 100_000, n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = base_text(1), base_text(2, 400)
    near = a.split()
    near[30] = "changed"
    rows = [
        (3, a), (7, a), (7, a), (5, " ".join(near)), (9, b), (11, "x y " + b + "\ttail"), (2, None), (4, ""), (6, "  \n "), (8, "one two"), (10, "One TWO"), (12, "solo"),
        (13, "é" * 300_000), (14, "\n".join(["same line here"] * 12)), (15, " ".join(f"q{i}" for i in range(30_000))), (16, base_text(1)[: len(a) // 2]), (None, a), (None, None),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars long, text_len int, n_words string, comp string, set string, cid string, bucket string, spans string, tokens string"
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "n", "c", "s", "c", "b", "p", "t") for i, t in rows], cols)


def rows_of(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_substring_dedup(docs):
    from vitalgrid.llm.dedup import without_repeats

    docs = docs.union(docs.where("doc_id in (3, 9)").withColumn("doc_id", -F.col("doc_id")))  # ids of any sign
    got = rows_of(without_repeats(docs, digest=True), "doc_id", "n_words", "n_removed", "kept_sha256")
    kept = without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert Counter((*r[:3], hashlib.sha256(b" ".join((r[3] or "").encode().split())).hexdigest()) for r in kept) == got
    table = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    first = {}
    for i, w in table:
        for j in range(len(w) - 12):
            if i is not None:
                first[tuple(w[j : j + 13])] = min(i, first.get(tuple(w[j : j + 13]), i))
    want = Counter()
    for i, w in table:
        gone = set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want and without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"short": 2, "block_sets": 3}])
def test_jaccard_components(spark, docs, options):
    from vitalgrid.llm.jaccard import jaccard_components

    rng = np.random.default_rng(5)
    base = base_text(50, 80).split()
    copies = []
    for i in range(30):
        w = list(base)
        for j in rng.integers(0, 80, rng.integers(0, 4)):
            w[j] = f"e{i}x{j}"
        copies.append((100 + i, " ".join(w)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id long, text string"))
    table = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets = []
    for _, t in table:
        w = words(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    up = {i: i for i, _ in table}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(table)):
        for b in range(a):
            i, j, n = table[a][0], table[b][0], len(sets[a] & sets[b])
            if None not in (i, j) and n and 100 * n >= 90 * len(sets[a] | sets[b]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    want = Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(table, sets))
    assert rows_of(jaccard_components(df, **options), "doc_id", "n_shingles", "component_id") == want
    assert jaccard_components(df.limit(0)).count() == 0


def test_token_counts_and_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from vitalgrid.llm.packing import pack_documents
    from vitalgrid.llm.tokens import token_counts

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    ids = [lib.encode(t, add_special_tokens=False).ids for _, t in table]
    want = Counter((i, len(t.encode()), len(x), len(x) > 2048) for (i, t), x in zip(table, ids))
    assert rows_of(token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    pieces = pack_documents(docs).collect()
    seqs, by = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append(p)
        by[p["doc_id"], p["doc_tokens"]].append(p)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
    total = sum(len(x) + 1 for x in ids)
    assert sum(p["length"] for p in pieces) == total
    assert len(seqs) * 4096 <= total + 4 * 4096  # padding: a few windows that nothing is left to fill
    for (i, _), x in zip(table, ids):
        raw = np.array([*x, 2], "<u4")
        crcs = Counter((p["start"], p["length"], p["ids_crc32"]) for p in by[i, len(raw)])
        for s, n, c in crcs:
            if i is not None and Counter(t[0] for t in table)[i] == 1:
                assert c == zlib.crc32(raw[s : s + n].tobytes())
    assert pack_documents(docs.limit(0)).count() == 0


def test_tokens_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from vitalgrid.llm.common import steps
    from vitalgrid.llm.packing import WordIds
    from vitalgrid.llm.tokens import CHUNK_CHARS, WordCounts, lanes

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, machine = Tokenizer.from_file(path), lanes(path)
    rng = np.random.default_rng(3)
    letters = list("abcABC 's't'll \n\t.,!?123éÉßñÑÖ×÷Σς İ ̈\u0085 \x1c漢字ع🙂’ẞ") + ["<|endoftext|>", "<|startoftext|>", "the", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(1500)] + ["".join(rng.choice(list("abcdefé"), rng.integers(1, 60))) for _ in range(1500)] + ["x" * 200, "", "ab " * 50]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    ids = WordIds(path)
    assert [x.tolist() for _ in range(2) for _, part in ids.of_texts(pa.array(texts)) for x in part] == 2 * want
    assert [int(x) for _, t in steps(pa.array(texts)) for x in machine.count(t)] == list(map(len, want))
    counts = WordCounts(path)
    long = " ".join(texts[:800]).replace("<|", "")
    parts = [long[i : i + 37] for i in range(0, len(long), 37)]
    maps = [counts.chunk_map(p) for p in parts]
    while len(maps) > 1:  # pairwise, as a scan would
        maps = [counts.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    assert counts.applied(maps[0]) == len(lib.encode(long, add_special_tokens=False).ids) and CHUNK_CHARS > 0


def test_fingerprints(docs):
    from vitalgrid.llm.fingerprint import Tree, document_fingerprints, edited_text, edits, likeness, merkle

    table = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = document_fingerprints(docs, rows_a_bucket=3)
    want = Counter()
    for (i, t), (_, n) in zip(table, table[1:] + table[:1]):
        e = edited_text(t, n)
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(merkle([t])[0]), str(merkle([e])[0]))] += 1
    assert rows_of(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint") == want
    assert got.where("near_edited not between 0 and 1 or near_next not between 0 and 1").count() == 0
    a, b = merkle(["p one\np two\n\np three", "p one\np 2\n\np three"])
    assert edits(a, b) == [1] and likeness(a, a) == 1 > likeness(a, b) > 0 and str(Tree.parse(str(a))) == str(a)
    assert document_fingerprints(docs.limit(0)).count() == 0


def test_fingerprints_against_plain_trees_and_counts(spark):
    """Roots and digests from the lines themselves; likeness from the pieces' marks, counted as they stand in the string."""
    from vitalgrid.llm.fingerprint import document_fingerprints

    rng = np.random.default_rng(6)
    texts = [None, "", "\n\n", "a", "é\n" * 40] + ["\n".join(base_text(int(x), int(rng.integers(1, 30))) for x in rng.integers(0, 40, int(rng.integers(1, 25)))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(document_fingerprints(rows, rows_a_bucket=7).collect())
    digest = lambda x: hashlib.blake2b(x, digest_size=16)
    marks = lambda f: Counter(m[i : i + 4] for s in f.partition(":")[2].split(";") for q in s.partition("/")[2].split(",") for m in [q.partition("=")[2]] for i in range(0, len(m), 4))

    def near(a, b):
        if a.partition(":")[0] == b.partition(":")[0]:
            return 1.0
        x, y = marks(a), marks(b)
        return min(2 * (x & y).total() / (x.total() + y.total()), 1 - 1e-9) if x or y else 1 - 1e-9

    for r, text, after in zip(got, texts, got[1:] + got[:1]):
        lines = [digest(x).digest() for x in (text or "").encode().split(b"\n")]
        sections, run = [], []
        for i, d in enumerate(lines):
            run.append(d)
            if d[0] % 4 == 0 or i == len(lines) - 1:
                sections.append(digest(b"".join(run)).digest())
                run = []
        root, _, body = r["fingerprint"].partition(":")
        assert root == digest(b"".join(sections)).hexdigest()
        assert [x.partition("/")[0] for x in body.split(";")] == [x.hex()[:8] for x in sections]
        assert [q.partition("=")[0] for x in body.split(";") for q in x.partition("/")[2].split(",")] == [x.hex()[:8] for x in lines]
        assert r["near_edited"] == near(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == near(r["fingerprint"], after["fingerprint"])


def test_empty_tables_long_texts_and_clashing_names(spark, docs):
    """Row-wise operators: as many rows as given, ids as given, nulls as empty; names of their own results in the input do no harm."""
    from vitalgrid.llm.htmltext import extract_pages
    from vitalgrid.llm.licenses import license_scan
    from vitalgrid.llm.quality import quality_rules
    from vitalgrid.llm.tokens import token_counts

    own = dict.fromkeys("low known sentence_ids n_sentences licenses n_bytes n_tokens over_limit n_words word_chars n_symbols base_failed kept score predicted held_out html_ rate posteriors".split(), F.lit("z"))
    clash = docs.drop("n_words", "tokens").withColumns(own)
    for op in (license_scan, token_counts, quality_rules):
        assert rows_of(op(clash), *(out := op(docs).columns)) == rows_of(op(docs), *out), op.__name__
        assert rows_of(op(clash), "doc_id") == rows_of(docs, "doc_id") and op(clash.limit(0)).count() == 0, op.__name__
    long = "A sentence of some words that has no link at all in it. " * 40_000
    pages = spark.createDataFrame([(1, "u", f"<nav><a href=1>Home</a></nav><p>{long}</p>", 1), (2, "u", "", 1), (3, None, None, 1)], "page_id long, url string, html string, n_chars int")
    assert rows_of(extract_pages(pages), "page_id", "url", "text", "n_chars") == Counter({(1, "u", long.strip(), len(long) - 1): 1, (2, "u", "", 0): 1, (3, None, "", 0): 1})
    assert extract_pages(pages.limit(0)).count() == 0


def test_quality_counts(docs):
    from vitalgrid.llm.quality import RULES, quality_rules

    want = Counter()
    for r in docs.collect():
        t = r["text"] or ""
        w = words(t)
        wins = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        rep = {k for j in range(len(w) - 7) if wins[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        want[(r["doc_id"], len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w))] += 1
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality_rules(docs)
    assert rows_of(got, *cols) == want
    other = quality_rules(docs, tuple(reversed(RULES)))
    assert rows_of(got, "doc_id", "kept") == rows_of(other, "doc_id", "kept")  # no order changes a verdict
    assert got.where("kept and base_failed").count() == 0 and quality_rules(docs.limit(0)).count() == 0


def test_quality_verdicts(spark):
    from vitalgrid.llm.quality import quality_rules

    def kept(t):
        w = words(t)
        chars, letters = sum(len(x.decode()) for x in w), [b for b in t.encode() if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128]
        lettered = sum(any(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in x) for x in w)
        lines = [x for x in t.split("\n") if words(x)]
        wins = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        repeated = {k for j in range(len(w) - 7) if wins[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        bad = len(w) < 20 or 100 * len(repeated) > 30 * len(w) or (len(w) >= 50 and 10 * max(Counter(w).values()) > 3 * len(w)) or 10 * lettered < 7 * len(w)
        bad = bad or 2 * sum(65 <= b <= 90 for b in letters) > len(letters) or 10 * sum(t.count(c) for c in "#*$%&|<>") > len(w) or not 2 * len(w) <= chars <= 15 * len(w)
        return not bad and 2 * (len(lines) - len(set(lines))) <= len(lines)

    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["ab", "Wörter", "12", "UP", "#x", "a", "longerword", "line\nline\nline", "the", "x" * 40], 60, p=rng.dirichlet(np.full(10, 0.6))))) for i in range(150)]
    rows += [(1000 + i, base_text(i)) for i in range(20)] + [(2000, base_text(1).upper()), (2001, " ".join(["the"] * 20 + base_text(2, 40).split()))]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: kept(t) for i, t in rows} and 0 < sum(got.values()) < len(got)


def test_toxicity(spark, sf):
    from vitalgrid.llm.toxicity import toxicity_scores

    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        w = base_text(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for j in rng.integers(0, 60, 5):
                w[j] = str(rng.choice(["idiot", "zorgword", "moron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame([*rows, (None, "x"), (9000, None), (9001, ""), (3, rows[3][1])], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (77_777, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity_scores(d, lab)
    held = got.where("held_out").join(lab, "doc_id")
    assert held.where("predicted = toxic").count() >= 0.95 * held.count()
    assert {r["doc_id"]: r["held_out"] for r in got.where("doc_id is not null").collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in [*range(600), 9000, 9001]}
    assert got.where("score not between 0 and 1 or predicted <> int(score >= 0.7)").count() == 0 and got.count() == d.count()
    assert toxicity_scores(d, lab.limit(0)).count() == d.count() and toxicity_scores(d.limit(0), lab).count() == 0


def test_toxicity_of_ids_as_strings(spark):
    from vitalgrid.llm.toxicity import toxicity_scores

    d = spark.createDataFrame([(f"d{i}", f"you idiot {base_text(i)}" if i % 4 == 0 else base_text(i), "x") for i in range(80)] + [("long", "word " * 300_000, "x")], "doc_id string, text string, score string")
    lab = spark.createDataFrame([(f"d{i}", int(i % 4 == 0)) for i in range(80)], "doc_id string, toxic int")
    assert toxicity_scores(d, lab).count() == 81


def test_html():
    from vitalgrid.llm.htmltext import main_text

    page = "<html><body><nav><a href=1>Home</a></nav><div class=ad>Buy</div><article><h1>T &amp; x</h1><p>First <b>bold</b>  text\n here<p>Second&nbsp;one<ul><li>a<li>b</ul></article><div class='comments'><p>nice post thanks a lot for it</div><footer>f</footer><script>var t='</p>'</script></body></html>"
    assert main_text(page) == "T & x\nFirst bold text here\nSecond one\na\nb"
    plain = "<div id=top><a href=1>Home</a> <a href=2>News</a></div><div><p>The first paragraph has quite some text in it.</p><p>The second one has as much text as the first.</p></div><div class=sidebar><p>Popular now: this</div>"
    assert main_text(plain) == "The first paragraph has quite some text in it.\nThe second one has as much text as the first."
    assert main_text(None) == main_text("") == main_text("<p></p>") == "" and main_text("just text") == "just text"
    assert main_text("<p>" * 5000 + "deep") == "deep"


def test_html_keeps_articles_in_marked_wrappers():
    from vitalgrid.llm.htmltext import main_text

    a, b, c = ("The %s paragraph of the story has quite some text in it, without a single link." % x for x in ("first", "second", "third"))
    side = "<nav><a href=1>Home</a></nav><div class=sidebar><a href=2>Popular</a> now</div>"
    for wrap in ("<div class='no-sidebar'>%s</div>", "<div class='page has-sidebar'>%s</div>", "<div class='right-sidebar'>%s</div>", "<form action=x><input name=v>%s</form>"):
        assert main_text(side + wrap % f"<p>{a}</p><p>{b}</p>") == f"{a}\n{b}"
    parts = "<header class='entry-header'><h1>Title</h1></header>%s<section id='discussion'><h2 id='legal'>Legal</h2><p>%s</p></section>" % (f"<p>{a}</p><p>{b}</p>", c)
    lines = f"Title\n{a}\n{b}\nLegal\n{c}"
    assert main_text(f"<body>{side}<article>{parts}<div class=comments><p>{c}</p></div></article></body>") == lines
    assert main_text(f"<article>{parts.replace('header class', 'div class').replace('</header', '</div')}</article>") == lines
    assert main_text(side + "".join(f"<article><p>{x}</p></article>" for x in (a, b, c))) == f"{a}\n{b}\n{c}"
    teasers = "".join(f"<article><h3><a href={i}>More of it</a></h3><p>Short words.</p></article>" for i in range(3))
    assert main_text(f"{side}<div><p>{a}</p><p>{b}</p><p>{c}</p></div><div>{teasers}</div>") == f"{a}\n{b}\n{c}"
    assert main_text(f"{side}<article><h1>T</h1><p>{a}</p><p>{b}</p></article>{teasers}") == f"T\n{a}\n{b}"
    assert main_text(f"<div><p>{a}</p></div><div class=comments>{f'<p>{b}</p>' * 3}</div>") == a
    assert main_text("<div class=widget>one</div><div class=widget>two</div>") == "one\ntwo"
    assert main_text(f"<p>{a}</p><div style='display:none'><p>{b}</p><p>{c}</p></div>") == a


def test_html_rows(spark):
    from vitalgrid.llm.htmltext import extract_pages

    p = spark.createDataFrame([(1, "u", "<p>a b</p>", "z"), (1, "u", "<p>a b</p>", "z"), (None, None, None, "z")], "page_id long, url string, html string, text string")
    assert rows_of(extract_pages(p), "page_id", "url", "text", "n_chars") == Counter({(1, "u", "a b", 3): 2, (None, None, "", 0): 1})


def test_licenses(spark):
    from vitalgrid.llm.licenses import SENTENCES, license_scan

    mit = ". ".join(SENTENCES[k].capitalize() for k in ("mit_grant", "mit_notice", "mit_warranty")).replace(" of this ", "\n of this ")
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, mit + "."), (3, ". ".join(reversed(mit.split(". ")))), (4, None), (5, "a license"), (1, "x\nReleased under the MIT License.\ny"), (None, "Licensed under the Apache License, Version 2.0.")]
    got = rows_of(license_scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_sentences", "licenses")
    assert got == Counter({(1, 1, "MIT"): 2, (2, 3, "MIT"): 1, (3, 3, ""): 1, (4, 0, ""): 1, (5, 0, ""): 1, (None, 1, "Apache-2.0"): 1})


NOTICES = {
    "Apache-2.0": """Copyright 2020 A. Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "BSD-2-Clause": """Copyright (c) 2020, A. Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
    "CC-BY-4.0": "Notes\nThis work is licensed under a Creative Commons\nAttribution 4.0 International License.",
    "CC-BY-NC-4.0": "Notes\nLicensed under\nCC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Notes\nLicensed under CC BY-SA\n4.0",
    "GPL-2.0-or-later": """A program
Copyright (C) 2020 A. Body

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "GPL-3.0-only": "Notes\nThis work is licensed under the GNU General\nPublic License version 3.",
    "ISC": """Copyright (c) 2020, A. Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "MIT": """MIT License
Copyright (c) 2020 A. Body
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "Notes\n\nThis is free and unencumbered software released into the public\ndomain.\n\nAnyone is free to copy",
}
NOTICES["GPL-3.0-or-later"] = NOTICES["GPL-2.0-or-later"].replace("software;", "software:").replace("Foundation;", "Foundation,").replace("version 2", "version 3")
NOTICES["BSD-3-Clause"] = NOTICES["BSD-2-Clause"] + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licenses_of_verbatim_notices(spark):
    from vitalgrid.llm.licenses import RULES, license_scan

    assert set(NOTICES) == {name for name, _ in RULES}
    forms = (lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */")
    rows = [(name, f(t)) for name, t in NOTICES.items() for f in forms]
    got = license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["licenses"]) for r in got if r["licenses"] != r["doc_id"]] == [] and len(got) == 3 * len(NOTICES)


def test_mixing_meets_targets(spark, sf):
    from vitalgrid.llm.common import table
    from vitalgrid.llm.mixing import mixing_rates, take_copies

    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows, report = mixing_rates(d.union(d.limit(1).selectExpr("null", "null", "null", "null", "null")), lab, weights={"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, total=50_000.0)
    k = len(report["domains"])
    met = rows.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col("posteriors")[i]) for i in range(k))).first()
    assert np.allclose(met, report["targets"], rtol=1e-3) and rows.where("rate < 0").count() == 0 and rows.count() == d.count() + 1
    own = rows.join(d.select("doc_id", F.col("lang").alias("l")), "doc_id").withColumn("best", F.array_position("posteriors", F.array_max("posteriors")) - 1)
    names = F.array(*map(F.lit, report["domains"]))
    assert own.where(F.element_at(names, (F.col("best") + 1).cast("int")) == F.col("l")).count() >= 0.9 * d.count()
    taken = take_copies(d, lab)
    assert taken.columns == d.columns and d.select("doc_id").exceptAll(taken.select("doc_id").distinct()).count() == 0
    assert mixing_rates(d.limit(0), lab)[0].count() == 0
    with pytest.raises(ValueError, match="xx"):
        mixing_rates(d, lab, weights={"en": 1.0, "xx": 1.0})


def test_mixing_of_many_domains(spark):
    from vitalgrid.llm.mixing import mixing_rates

    rows = [(i, " ".join(f"d{i % 70}w{j}" for j in range(20)), f"s{i % 70}", 1.0, "p") for i in range(280)] + [(300, "", "s1", 1.0, "p"), (301, None, None, 1.0, "p"), (0, "d0w1 d0w2", "s0", 1.0, "p")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, rate double, posteriors string")
    rates, report = mixing_rates(d, d.select("doc_id"), domain="source")
    assert len(report["domains"]) == 70 and rates.count() == len(rows) and rates.where("rate is null or rate < 0").count() == 0


def test_mixing_of_a_rare_blurred_domain_keeps_all(spark):
    from vitalgrid.llm.mixing import mixing_rates, take_copies

    rng = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        own = rng.random(30) < (0.5 if i < 20 else 0.1)  # the common domain uses the rare one's words too
        rows.append((i, " ".join(f"w{x}" for x in np.where(own, rng.integers(1000, 1030, 30), rng.integers(0, 200, 30))), "ga" if i < 20 else "en"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    rates, report = mixing_rates(d, d.select("doc_id"))
    assert rates.where("rate < 1").count() == 0
    met = rates.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col("posteriors")[i]) for i in range(2))).first()
    share = np.power(report["current"], 0.7) / np.power(report["current"], 0.7).sum()
    assert np.allclose(np.array(met) / sum(met), share, rtol=1e-3) and np.allclose(met, report["reached"], rtol=1e-5)
    assert take_copies(d, d.select("doc_id")).select("doc_id").distinct().count() == 2000


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from vitalgrid.llm.common import materialise

    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs2 = materialise(stage(spark, docs, sf))
        assert docs2.columns == docs.columns, name
        counts.append(docs2.count())
        docs = docs2
    assert counts[0] > counts[1] > counts[2] >= counts[3] <= counts[4]
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert packed.agg(F.sum("length")).first()[0] == packed.where("start = 0").agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_stages_on_awkward_rows(spark, docs, sf):
    """Nulls, empty and repeated rows, very long texts, clashing columns; and each stage on an empty table."""
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    table = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for name in ("toxicity", "jaccard_join", "substring_dedup", "mixing"):
        assert stages[name](spark, docs.limit(0), sf).count() == 0, name
    assert stages["packing"](spark, docs.limit(0), sf).count() == 0
    assert rows_of(stages["toxicity"](spark, docs, sf), *docs.columns) == rows_of(docs, *docs.columns)  # none is toxic
    near = stages["jaccard_join"](spark, docs, sf)
    shingles = lambda t: {tuple(w[j : j + 5]) for w in [words((t or "").lower())] for j in range(len(w) - 4)} or ({tuple(words(t.lower()))} if words(t) else set())
    sets = {i: shingles(t) for i, t in table if i is not None}
    up = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    leads = {i for i in sets if up[i] == i}
    want = Counter({(i, t): 1 for i, t in table if i is None or i in leads})
    assert rows_of(near, "doc_id", "text") == want and near.columns == docs.columns
    cut = stages["substring_dedup"](spark, docs, sf)
    assert cut.columns == docs.columns and cut.where("doc_id is null").count() == 2 and cut.where("doc_id = 7").count() == 0  # all of it stands in 3
    taken = stages["mixing"](spark, docs, sf)
    assert taken.columns == docs.columns and set(rows_of(taken, "doc_id", "text")) == set(table)
    packed = stages["packing"](spark, docs, sf)
    assert packed.where("start = 0").count() == len(table)


def test_license_query_meets_its_sql(spark, sf):
    from oracle import compare

    from vitalgrid.llm import queries

    compare(queries.QUERIES["op10_license_scan"](spark, sf), queries.ORACLES["op10_license_scan"], sf)


@pytest.mark.parametrize("page", ['<a b=" ' * 150_001, "<div>" * 100_000 + "</x>" * 60_000, "<span>" * 60_000 + "<a>" * 60_000, "<a><div>" + "<span>" * 60_000 + "<a>" * 60_000, "<a<a" * 250_000 + '"', "<a " * 300_000 + '"', "<b>" + "<div>" * 60_000 + "</b>" * 60_000, "<p>x</p>" * 60_000])
def test_hostile_pages_take_time_in_proportion(page):
    """Pages of about a megabyte that open, leave open or never close what they can."""
    import time

    from vitalgrid.llm.htmltext import main_text

    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 20


def test_pipeline_runs_whole_and_on_nothing(spark, sf, tmp_path):
    """Every piece of the packed corpus lies in one place of one sequence; an empty table gives none."""
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert pieces and {p["doc_id"] for p in pieces} <= {r["doc_id"] for r in documents.select("doc_id").collect()}
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
