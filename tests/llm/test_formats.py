"""Token files, dataset manifest and whitening against plain definitions, round trips and damaged inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part int, start string, ids string, g string, pos string, n string, block string, leaf string, root string, sides string, range string, d string, cell string, value string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, *["x"] * 13) for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {i % 7} of {i}", ("en", "de", None, "zz", "é")[i % 5 if i % 3 else 0], None if i % 11 == 0 else "s", None if i % 13 == 0 else i) for i in range(1, 90)]
    rows += [(500, None, "en", "s", 3), (501, "", "en", "s", 3), (502, "a " * 200_000, "xx", "s", 3), (503, "x" * 90_000, None, None, None), (7, "again", "en", "s", 1), (7, "again", "en", "s", 1), (None, "no id", "en", "s", 1), (None, None, None, None, None), (-4, "it's <|endoftext|> here", "en", "s", 0)]
    return table(spark, rows)


ALPHABET = [" ", "  ", "\n", "\t", "a", "b", "the", "ing", "É", "é", "×", "÷", "'", "'s", "12", "3", ".", ",", "!!", " ", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|", "你", "Д", "\r\n", "x" * 70, "\x00", "İ", "ß", "#"]


def test_byte_level_ids_are_the_library_s():
    import public_tokenizers
    from tokenizers import Tokenizer

    from vitalgrid.llm.bytebpe import ByteIds

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    library = Tokenizer.from_file(path)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    got = [x.tolist() for _, part in ByteIds(path).of_texts(pa.array(texts)) for x in part]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [1, 2, 127, 128, 5000, 65_536, 65_537, 200_001])
def test_blocks_round_trip(n):
    from vitalgrid.llm.rans import Coder, decode_block, encode_block, normalised

    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_256).astype(np.uint16)
    frequency = normalised(np.bincount(ids, minlength=50_257))
    assert frequency.sum() == 1 << 20 and ((frequency > 0) == (np.bincount(ids, minlength=50_257) > 0)).all()
    coder = Coder(frequency)
    checkpoints, payload = encode_block(coder, ids)
    crc = zlib.crc32(payload)
    assert (decode_block(coder, checkpoints, payload, n, crc) == ids).all()
    for low, high in ((0, 1), (n // 3, n // 2), (n - 1, n + 5)):
        assert (decode_block(coder, checkpoints, payload, n, crc, low, high) == ids[low:high]).all()
    if n == 200_001:
        share = np.bincount(ids) / n
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
        assert 8 * (len(payload) + len(checkpoints)) / n < 1.08 * entropy
        with pytest.raises(ValueError):
            decode_block(coder, checkpoints, payload[:40] + b"\1" + payload[41:], n, crc)


def test_token_files(spark, docs, monkeypatch, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from vitalgrid.llm import rans

    monkeypatch.setattr(rans, "BLOCK_IDS", 70_000)  # so that documents lie in several blocks
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = f"{tmp_path}/ids"
    rans.write_ids(docs, at)
    got = rans.read_digests(spark, at).collect()
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        ids.setdefault(r["doc_id"], []).append(library.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, many in ids.items() for x in many)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    total = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == total
        total += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    pieces = rans.read_ids(spark, at).where("doc_id = 502").orderBy("first").collect()
    assert len(pieces) > 1 and sum((p["got"] for p in pieces), []) == ids[502][0]
    start, part = pieces[0]["doc_start"], pieces[0]["part"]
    assert rans.read_range(spark, at, part, start + 65_000, start + 75_000).tolist() == ids[502][0][65_000:75_000]
    assert rans.token_file_digests(docs.limit(0)).collect() == []


def plain_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        """The root, and for each leaf (sibling or None, whether it stands left) of each level."""
        paths, level = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
        while len(level) > 1:
            up = []
            for k in range(0, len(level), 2):
                run = level[k : k + 2]
                for j, (_, below) in enumerate(run):
                    other = run[1 - j][0] if len(run) == 2 else None
                    for i in below:
                        paths[i].append((other, j == 1))
                up.append((h(*(d for d, _ in run)), [i for _, b in run for i in b]))
            level = up
        return level[0][0], paths

    langs, leaf_of = {}, lambda r, n: h(*map(field, (r["doc_id"], r["source"], r["lang"], n, r["text"])))
    for r in rows:
        langs.setdefault(r["lang"], []).append((r["doc_id"], leaf_of(r, r["n_chars"]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([d for _, d, _ in langs[lang]])
    root, tops = tree([trees[x][0] for x in order])
    out = Counter()
    for lang, top in zip(order, tops):
        for (i, leaf, r), path in zip(langs[lang], trees[lang][1]):
            hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r["n_chars"] is not None
            now = leaf_of(r, r["n_chars"] + 1) if hit else leaf
            for other, left in path + top:
                now = h(now) if other is None else h(other, now) if left else h(now, other)
            out[i, leaf, trees[lang][0], root, h(*(o for o, _ in path + top if o)), now, now == root] += 1
    return out


@pytest.mark.parametrize("levels", [10, 2])
def test_dataset_manifest(spark, docs, monkeypatch, levels):
    from vitalgrid.llm import manifest

    monkeypatch.setattr(manifest, "LEVELS", levels)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    if levels == 2:  # several rounds in tasks of their own are covered by whole blocks below
        rng, n = np.random.default_rng(1), 45
        leaves = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(n)]
        level, first = leaves, 0
        while len(level) > 1:
            level = [manifest.digest(*level[k : k + 2]) for k in range(0, len(level), 2)]
        tables, size = [leaves], 0
        while len(tables[-1]) > 1:
            tables.append([manifest.Block(n, size, k, tables[-1][k : k + 4]).digest for k in range(0, len(tables[-1]), 4)])
            size += 2
        assert tables[-1] == level
        down = [(b"", b"")]
        for depth in range(len(tables) - 2, -1, -1):
            down = [x for k in range(0, len(tables[depth]), 4) for x in manifest.Block(n, 2 * depth, k, tables[depth][k : k + 4]).suffixes(*down[k // 4])]
        assert all(manifest.folded(d, *x) == level[0] for d, x in zip(leaves, down))
        assert rng is not None and first == 0
        return
    got = manifest.dataset_manifest(docs)
    assert got.columns == names
    assert Counter(tuple(r) for r in got.collect()) == plain_manifest(docs.collect())
    assert manifest.dataset_manifest(docs.limit(0)).collect() == []


def test_dataset_manifest_of_one_language_and_of_blocks(spark):
    from vitalgrid.llm import manifest

    rows = [(i, f"t{i}", "en", "s", i) for i in range(2500)]
    for part in (rows, rows[:1], rows[:1024], rows[:1025]):
        df = table(spark, part)
        assert Counter(tuple(r) for r in manifest.dataset_manifest(df).collect()) == plain_manifest(df.collect())


def test_manifest_meets_its_sql(spark, sf):
    from vitalgrid.llm import queries

    compare(queries.op12_dataset_manifest(spark, sf), queries.ORACLES["op12_dataset_manifest"], sf)


def test_inertia_counts():
    from vitalgrid.llm.whitening import eigenvalues_above

    rng = np.random.default_rng(0)
    for t in range(60):
        d = int(rng.integers(1, 40))
        a = rng.standard_normal((d, int(rng.integers(1, 60))))
        v = np.round(a @ a.T) if t % 5 == 0 else a @ a.T
        e = np.linalg.eigvalsh(v)
        shift = float(rng.uniform(e[0] - 1, e[-1] + 1))
        assert eigenvalues_above(v, shift) == (e > shift).sum()
    assert eigenvalues_above(np.zeros((3, 3)), 0.0) == 0 and eigenvalues_above(np.diag([1.0, 1, 0]), 0.5) == 2


@pytest.mark.parametrize("e", [[9, 8, 7, 6, 5, 4, 3, 2, 1], [5, 5, 5, 1, 1, 0], [1e6, 3, 2.999, 1e-3], [4, 4, 4, 4], [2, 0, 0]])
def test_components(spark, e):
    from vitalgrid.llm.whitening import components

    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((len(e), len(e))))
    v = q @ np.diag(np.array(e, float)) @ q.T
    got, block = components(spark, (v + v.T) / 2, 3)
    want = [x for x in e if x > 0][:3]
    assert np.allclose(got, want, rtol=1e-12) and np.allclose(block.T @ block, np.eye(len(want)), atol=1e-13)
    assert np.abs(v @ block - block * got).max() < 1e-13 * max(e) * len(e)


def plain_whitening(rows, k):
    kept = [(i, [float(c) for c in x]) for i, x in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    y = (x - s / n).astype(float)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [i for i, _ in kept], n, [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x], y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_whitening(spark):
    from vitalgrid.llm.whitening import whitened_components

    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(300)]
    rows += [(900 + i, [1.5] * 12) for i in range(100)] + [(None, [0.25] * 12), (700, [300.0] * 12)]
    rows += [(1, None), (2, []), (3, [1.0] * 11 + [None]), (4, [1.0] * 11 + [float("nan")]), (6, [float("-inf")] + [1.0] * 11)]
    schema = "vec_id long, embedding array<double>, n string, component string, cell string, d string, value string, label string"
    df = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema).repartition(5)
    got = whitened_components(df, 8).collect()
    ids, n, deviation, whitened, explained = plain_whitening(rows, 8)
    assert Counter((r["vec_id"], r["component"], r["n"], int(r["deviation"])) for r in got) == Counter((i, c, n, d) for i, d in zip(ids, deviation) for c in range(1, 9))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {i: w for i, w in zip(ids, whitened)}
    for c in range(8):
        pairs = [(r["whitened"], by[r["vec_id"]][c]) for r in got if r["component"] == c + 1]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a - sign * b) for a, b in pairs) < 1e-6
        assert all(abs(r["explained"] / explained[c] - 1) < 1e-9 for r in got if r["component"] == c + 1)
    assert whitened_components(df.limit(0)).collect() == []
    assert whitened_components(df.where("vec_id >= 900")).collect() == []  # equal vectors: no variance
    with pytest.raises(Exception, match="several lengths"):
        whitened_components(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
