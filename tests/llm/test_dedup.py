"""Exact, near, line and substring dedup against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pageframe.llm import embedding_dedup, exact_dedup, line_dedup, simhash_dedup, substring_dedup
from pageframe.llm.components import components

DOCS = "doc_id long, text string, source string, keep_id string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, parts=5):
    full = [(i, text, "s", "clash", 1) for i, text in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def classes(nodes, linked):
    """The smallest member of the component of every node."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            for n in (a, b):
                changed |= label[n] != low
                label[n] = low
    return label


# --- components -----------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)]
    pairs += [(500, 500 + i) for i in range(1, 300)] + [(None, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    known = [p for p in pairs if p[0] is not None]
    assert got == classes({n for p in known for n in p}, known)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact ----------------------------------------------------------------------

TEXTS = ["A b", "a B", "", None, "Ä", "ä", "x" * 200_000, "X" * 200_000, "a b ", "z"]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    rng = random.Random(1)
    rows = [(i, rng.choice(TEXTS)) for i in range(300)] + [(1000 + i, "hot copy") for i in range(400)]
    rows += [(5, "twice"), (5, "twice"), (None, "no id"), (None, "no id"), (None, "z")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = exact_dedup.exact_groups(docs_of(spark, rows), keep=keep).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fold = {i: chr(i + 32) for i in range(65, 91)}
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(fold)].append(i)
    best = min if keep == "smallest" else max
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[(i, best(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(docs_of(spark, [])).count() == 0


# --- SimHash --------------------------------------------------------------------


def slow_print(text):
    words = WORD.findall((text or "").translate({i: chr(i + 32) for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(60)) for _ in range(30)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "new"
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "oNE"), (None, "one"), (3, rows[3][1]), (905, "é É \x0b x")]
    got = simhash_dedup.simhash_dedup(docs_of(spark, rows)).collect()
    prints = [slow_print(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 3]
    label = classes(range(len(rows)), linked)
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            ids[label[n]].append(i)
    want = Counter((i, f"{prints[n]:016x}", min(ids[label[n]])) for n, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash_dedup.simhash_dedup(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("radius", [2, 3, 4])
def test_all_near_fingerprints_meet(spark, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(20)]
    for v in list(values):
        for d in range(1, 6):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), d)))
    signed = [int(np.array(v, np.uint64).view(np.int64)) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "print long")
    got = {(r.a, r.b) for r in simhash_dedup.near_pairs(df, radius).collect()}
    want = {
        (min(a, b), max(a, b))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius
    }
    assert got == want


# --- substrings -----------------------------------------------------------------


def slow_removal(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    starts = defaultdict(list)
    for d, ws in enumerate(words):
        for s in range(len(ws) - window + 1):
            starts[tuple(ws[s : s + window])].append((d, s))
    gone = [[False] * len(ws) for ws in words]
    for places in starts.values():
        if len(places) > 1:
            for d, s in places:
                gone[d][s : s + window] = [True] * window
    out = Counter()
    for (i, _), ws, g in zip(rows, words, gone, strict=True):
        kept = " ".join(w for w, x in zip(ws, g, strict=True) if not x)
        out[(i, len(ws), sum(g), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("window", "group_rows"), [(35, 20_000), (35, 1), (8, 2), (5, 3)])
def test_substrings_against_brute_force(spark, window, group_rows):
    rng = random.Random(window + group_rows)
    passages = [[rng.choice("abcdefghijk") + str(rng.randrange(40)) for _ in range(rng.randrange(20, 90))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(passages)) if rng.random() < 0.6 else [f"w{rng.random()}" for _ in range(rng.randrange(30))]
            lo = rng.randrange(len(part) + 1)
            part = part[lo:] if rng.random() < 0.3 else part
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            words += part
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    rows += [(100, "x " * 90), (101, "x " * (window - 1)), (102, None), (103, ""), (104, "a b " * 50), (105, "a b " * 50)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (None, rows[8][1])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        got = substring_dedup.substring_dedup(docs_of(spark, rows), window=window, group_rows=group_rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == slow_removal(rows, window)
    cut = {r.doc_id: r for r in got if r.doc_id not in (None, 7)}
    texts = [(i, text, cut[i].cuts) for i, text in rows if i in cut]
    frame = spark.createDataFrame(texts, f"doc_id long, text string, cuts {substring_dedup.CUTS_DDL}")
    for r in frame.select("doc_id", "cuts", substring_dedup.without_cuts("text", "cuts").alias("kept")).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == cut[r.doc_id].kept_sha256
        assert sum(c.end - c.start for c in r.cuts) == cut[r.doc_id].n_removed


def test_anchors_of_a_long_text_of_few_words_take_bounded_memory(monkeypatch):
    """Every position ties: strips give what one piece gives, and their matrices do not grow with the text."""
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 3, 4000).astype(np.uint64)
    offsets = np.array([0, 1500, 1510, 4000])
    whole = substring_dedup.anchors(hashes, offsets, 35)
    monkeypatch.setattr(substring_dedup, "STRIP", 100)
    assert all((a == b).all() for a, b in zip(whole, substring_dedup.anchors(hashes, offsets, 35), strict=True))
    monkeypatch.undo()
    tracemalloc.start()
    substring_dedup.anchors(np.zeros(1_000_000, np.uint64), np.array([0, 1_000_000]), 35)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20  # 27 longs a position would be 216 MB for one matrix alone, of several


def test_distances_of_many_centroids():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit_rows(rng.normal(size=(300, 64)))
    plain = np.linalg.norm(x[:, None, :] - x[None, :, :], axis=2)
    assert (embedding_dedup.centroid_distances(x) >= plain).all() and np.allclose(embedding_dedup.centroid_distances(x), plain, atol=1e-5)
    tracemalloc.start()
    embedding_dedup.centroid_distances(embedding_dedup.unit_rows(rng.normal(size=(4000, 64))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 << 20


def test_substrings_of_nothing(spark):
    assert substring_dedup.substring_dedup(docs_of(spark, [])).count() == 0


# --- lines ----------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abc"))
        elif at < len(out):
            out[at : at + 1] = [] if kind == 1 else [rng.choice("abc")]
    return "".join(out)


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(70)))
        b = edited(rng, a, rng.randrange(5))
        for most in (1, 2, 3):
            assert line_dedup.edit_distance(a, b, most) == min(distance(a, b), most + 1)
            if a and b and abs(len(a) - len(b)) <= most:
                assert line_dedup._banded(a, b, most) == min(distance(a, b), most + 1)


@pytest.mark.parametrize("block", [256, 3])
def test_lines_against_brute_force(spark, block):
    rng = random.Random(block)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(24, 80))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(1, 4))]
        rows.append((i, "\n".join([*lines, rng.choice(["", "short", " \t"])])))
    rows += [(100, None), (101, ""), (102, "a" * 30_000), (103, "a" * 30_001), (104, "aaaa" * 10), (105, "aaaa" * 10 + "a")]
    lines = [(i, p, line) for i, text in rows for p, line in enumerate((text or "").split("\n")) if line.strip()]
    texts = sorted({line for _, _, line in lines})
    near = [
        (a, b)
        for k, a in enumerate(texts)
        for b in texts[:k]
        if min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) <= 2 and (len(a) > 200 or distance(a, b) <= 2)
    ]
    df = docs_of(spark, rows)
    links = Counter(x for pair in near for x in pair)
    similar = {r.line_md5: r.n_links for r in line_dedup.similar_lines(df, block=block).collect()}
    assert {bytes(k): v for k, v in similar.items()} == {hashlib.md5(t.encode()).digest(): n for t, n in links.items()}
    label = classes(texts, near)
    first = {}
    for i, p, line in sorted(lines, key=lambda x: x[:2]):
        first.setdefault(label[line], (i, p))
    want = {i: [] for i, _ in rows}
    for i, p, line in lines:
        if first[label[line]] != (i, p):
            want[i].append(p)
    got = line_dedup.line_dedup(df).collect()
    assert {r.doc_id: r.removed for r in got} == want
    assert {r.doc_id: r.n_lines for r in got} == {i: len((t or "").split("\n")) for i, t in rows}


def test_lines_are_removed(spark):
    df = spark.createDataFrame([("a\nb\n\nc", [0, 3])], "t string, r array<int>")
    assert df.select(line_dedup.remove_lines("t", "r")).first()[0] == "b\n"
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


# --- embeddings -----------------------------------------------------------------


@pytest.mark.parametrize(("cell_size", "block", "dim"), [(512, 2048, 64), (20, 7, 64), (20, 7, 6)])
def test_embeddings_against_brute_force(spark, cell_size, block, dim):
    rng = np.random.default_rng(dim + block)
    base = rng.normal(size=(40, dim))
    vectors = [(base[i % 40] + rng.normal(size=dim) * 0.25 * rng.random()).astype(np.float32).tolist() for i in range(300)]
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[1]]]
    odd = [None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [], [1.0, 0.0], [2.0, 0.0]]
    rows = [(i, v, 1, "x") for i, v in enumerate(vectors + odd)] + [(None, vectors[2], 1, "x"), (3, vectors[3], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string").repartition(5)
    got = embedding_dedup.embedding_dedup(df, cell_size=cell_size, block=block).collect()

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or any(x is None or not np.isfinite(x) for x in a + b):
            return -2.0
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        norms = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / norms) if norms else -2.0

    linked = [(i, j) for i in range(len(rows)) for j in range(i) if cosine(rows[i][1], rows[j][1]) >= 0.9]
    degree = Counter(x for pair in linked for x in pair)
    label = classes(range(len(rows)), linked)
    smallest = {}
    for n, row in enumerate(rows):
        if row[0] is not None:
            smallest[label[n]] = min(row[0], smallest.get(label[n], row[0]))
    want = Counter((row[0], degree[n], smallest.get(label[n])) for n, row in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_embeddings_of_a_group_of_few_directions(spark):
    """In 64 dimensions, a third of the vectors differ along four directions alone; every link counts."""
    rng = np.random.default_rng(4)
    group = rng.normal(size=64) + rng.normal(size=(500, 4)) @ rng.normal(size=(4, 64)) * 0.4
    x = np.concatenate([group, rng.normal(size=(1000, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(df, cell_size=32).collect()}
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.triu(x @ x.T >= 0.9, 1)
    label = classes(range(len(x)), np.argwhere(near).tolist())
    assert near.sum() > 1000
    assert got == {i: (near[i].sum() + near[:, i].sum(), label[i]) for i in range(len(x))}


def test_embeddings_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_dedup(df).count() == 0


def test_measured_recall_is_whole(spark):
    """Links found among the given vectors, against all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum() - len(x)
    found = embedding_dedup.embedding_dedup(df, cell_size=16).agg(F.sum("n_links")).first()[0]
    assert found >= 0.9 * near and found <= near
