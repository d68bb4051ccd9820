"""Ranked search, token counts and alignment against brute force."""

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pageframe.llm import alignment, lexical_search, perfect_hash, token_counts
from pageframe.llm.queries import QUERIES
from pageframe.llm.units import Remembered, split_units

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
ODD = [
    " ", "  ", "\n", " \n ", "\t", "word", "Über", "été", "中文字", "<|endoftext|>", "<|endoftext|", "<s>", "<unk>", "<0x41>", "'re", "it's",
    "...", "123", "4", "a" * 40, "é" * 9, "　", "\x85", "\x1c", "\x00", " the", " and", " under", "ing", "😀", "👩‍👧", "x.", "Y,",
]


def odd_text(rng, most=60):
    return "".join(rng.choice(ODD) for _ in range(rng.randrange(most)))


def by_row(rows):
    return sorted(map(tuple, rows), key=repr)


# --- ranked search ---------------------------------------------------------------


def slow_search(docs, items, k=10):
    terms = [(i, TERM.findall((text or "").translate(UPPER))) for i, text in docs]
    n_docs, all_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(term for _, t in terms for term in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in terms:
            m = 10 + 90 * len(t) * n_docs // all_terms if t else 0
            tf, score = Counter(t), 0
            for term in set(TERM.findall((text or "").translate(UPPER))):
                if tf[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:k], 1)]
    return by_row(out)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 80)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(i, docs[5][1].upper() + "!") for i in (7, 7, None)]
    docs += [(2000, None), (2001, ""), (2002, "... \n"), (2003, "Ünï w1-w2 W3"), (2004, "w59 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(25)]
    items += [(25, docs[5][1]), (26, None), (27, "none of these"), (28, "ünï W3"), (3, "w1 w2"), (None, "w4")]
    return docs, items


def test_search_against_brute_force(spark, searched):
    docs, items = searched
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert by_row(lexical_search.lexical_search(frame, asked).collect()) == slow_search(docs, items)
    few = lexical_search.lexical_search(frame, asked, k=3, item_bytes=60)  # many blocks of items
    assert by_row(few.collect()) == slow_search(docs, items, 3)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    empty = lexical_search.lexical_search(docs, items)
    assert empty.collect() == [] and dict(empty.dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert lexical_search.lexical_search(items.select(F.col("item_id").alias("doc_id"), "text"), items.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")
    assert lexical_search.lexical_search(nothing, items).collect() == []


def test_accumulators_stop_and_lose_nothing():
    rng = np.random.default_rng(3)
    n = 4000
    df = [3, 20, 400, 3000]
    docs = [np.sort(rng.choice(n, d, replace=False)) for d in df]
    tfs = [rng.integers(1, 4, d) for d in df]
    norms = rng.integers(20, 200, n)
    terms = np.repeat(np.arange(4), df)
    order = np.argsort(np.concatenate(docs), kind="stable")  # as they come, document by document
    block = lexical_search.Block(terms[order], np.concatenate(tfs)[order], np.concatenate(docs)[order], norms)
    weights = [6000, 5000, 2000, 200]
    full = np.zeros(n, np.int64)
    for t in range(4):
        full[docs[t]] += weights[t] * (1_000_000_000 * tfs[t] // (1000 * tfs[t] + 8 * norms[docs[t]]))
    found, scores = block.search(list(enumerate(weights)), 5)
    assert (full[found] == scores).all() and len(found) < 1000  # the commonest term made none
    best = np.sort(full)[-5:]
    assert (np.sort(scores)[-5:] == best).all()
    found, _ = block.search(list(enumerate(weights)), 5, 10**12)
    assert not len(found)  # others elsewhere are better than anything here can be


# --- token counts ----------------------------------------------------------------


def test_token_counts_against_the_library(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a ", "x" * 5000, " " * 3000, "ab " * 3000, "<|endoftext|>" * 50, *(odd_text(rng, 300) for _ in range(120))]
    rows = [*enumerate(texts), (None, "x" * 5000), (4, "x" * 5000), (4, None)]
    library = Tokenizer.from_file(BYTE_BPE)
    want = []
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False))
        want.append((i, len((text or "").encode()), n, n > 1024))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash")).repartition(4)
    for chunk, overlap in ((1 << 16, 1 << 10), (300, 120), (100, 80)):
        counts = token_counts.token_counts(docs, BYTE_BPE, chunk=chunk, overlap=overlap)
        assert by_row(counts.collect()) == by_row(want)
    assert token_counts.token_counts(docs.limit(0), BYTE_BPE).collect() == []


def test_splicing_widens_where_chunks_do_not_align(spark):
    text = "some words here " * 20 + "z" * 400 + " and more words" * 20
    frame = spark.createDataFrame([("k", text), ("k", text), ("plain", "one two " * 200)], "sha string, text string")
    first = {r.sha: r.n_tokens for r in token_counts.spliced(frame, BYTE_BPE, 150, 60).collect()}
    library = Tokenizer.from_file(BYTE_BPE)
    assert first["k"] is None and first["plain"] == len(library.encode("one two " * 200))
    done = {r.sha: r.n_tokens for r in token_counts.huge_counts(frame, BYTE_BPE, 150, 60).collect()}
    assert done == {"k": len(library.encode(text)), "plain": first["plain"]}


def test_op12_on_given_documents(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    counts = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in docs]
    assert by_row(QUERIES["op12_token_counts"](spark, SMALL).collect()) == by_row([(*row, row[2] > 1024) for row in counts])


# --- alignment -------------------------------------------------------------------


def slow_alignment(rows):
    a_library, b_library = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=PIECES)
    a_library.encode_special_tokens = True
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    aligned = []
    for _, text in rows:
        if not text:
            aligned.append(None)
            continue
        encoding, b = a_library.encode(" " + text, add_special_tokens=False), b_library.encode(text)
        a, a_bytes = encoding.ids, [bytes(map(letters.get, token)) for token in encoding.tokens]
        pieces = [b_library.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            aligned.append(None)
            continue
        a_spans, b_spans = spans(a_bytes), spans(b_bytes)
        token_at = [k for k, (lo, hi) in enumerate(b_spans) for _ in range(lo, hi)]
        links = [(x, b[k]) for x, (lo, hi) in zip(a, a_spans) for k in sorted(set(token_at[lo:hi]))]
        both = sorted({hi for _, hi in a_spans} & {hi for _, hi in b_spans})
        parts = [[[] for _ in both], [[] for _ in both]]
        for own, ids, places in ((parts[0], a, a_spans), (parts[1], b, b_spans)):
            for x, (_, hi) in zip(ids, places):
                own[bisect_left(both, hi)].append(str(x))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*parts)]
        aligned.append((len(a), len(b), groups, links))
    counts = Counter(pair for x in aligned if x for pair in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), x in zip(rows, aligned):
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = x[3]
        n_best = sum(counts[pair] == best[pair[0]] for pair in links)
        digest = hashlib.sha256(";".join(x[2]).encode()).hexdigest()
        out.append((i, x[0], x[1], len(x[2]), len(links), n_best, sum(counts[p] for p in links), digest))
    return by_row(out)


def test_alignment_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, " "), (3, "a "), (4, "  a"), (5, "▁"), (6, "a▁ b"), (7, "\x00 x"), *((i, odd_text(rng)) for i in range(8, 120))]
    rows += [(9, "same text here"), (9, "same text here"), (None, "same text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_links", F.lit("clash")).repartition(5)
    want = slow_alignment(rows)
    assert by_row(alignment.align_tokens(docs, BYTE_BPE, PIECES).collect()) == want
    # many slices, sums of several levels, and passes that look up some slices each
    small = alignment.align_tokens(docs, BYTE_BPE, PIECES, slice_keys=50, lookup_pairs=400, fan=2)
    assert by_row(small.collect()) == want
    assert alignment.align_tokens(docs.limit(0), BYTE_BPE, PIECES).collect() == []


def test_op13_on_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert by_row(QUERIES["op13_token_alignment"](spark, SMALL).collect()) == slow_alignment([tuple(r) for r in docs.collect()])


def test_long_texts_are_aligned_by_segments(monkeypatch):
    rng, own = random.Random(2), alignment.Encoder(BYTE_BPE, PIECES)
    for _ in range(60):
        text = odd_text(rng, 80)
        whole = [unit for units in own.segments(text) for unit in units]
        with monkeypatch.context() as patch:
            patch.setattr(alignment, "SEGMENT", 9)
            assert [unit for units in own.segments(text) for unit in units] == whole
        assert "".join(" " + unit for unit in whole) == " " + text


def test_marks_behind_a_word_are_encoded_alone():
    rng, own, asked = random.Random(12), alignment.Encoder(BYTE_BPE, PIECES), []
    library, pieces = own.a, own.b

    class Asked:
        model = library.model

        def encode(self, text, **how):
            asked.append(text)
            return library.encode(text, **how)

    def ids(unit):
        a, b = library.encode(" " + unit, add_special_tokens=False).ids, pieces.encode(unit) or [own.space]
        same = sum(len(own.bytes_b[i]) for i in b) == len(unit.encode()) + 1
        return (np.array(a, own.kind).tobytes(), np.array(b, own.kind).tobytes()) if same else None

    own.a = Asked()
    units = {"word$$$", "word!!", "word", "wörter.%%%", "cité...", "wörter...", "über&&&"}
    own.learn(units)
    assert own.units == {unit: ids(unit) for unit in units | {"wörter", "cité", "über"}}
    assert sorted(asked) == sorted({"x$$$", "x!!", "x.%%%", "x...", "x&&&"})
    units = {"".join(rng.choice("abszéßAя日İ1²'’.,!?$%-_&<>…▁\n") for _ in range(rng.randrange(10))) for _ in range(5000)}
    for some in (units, set(rng.sample(sorted(units), 500))):
        own.learn(some)
        assert all(own.units[unit] == ids(unit) for unit in some)


def test_units_cut_only_where_tokenizers_start_anew():
    assert split_units("a b  c\n d") == ["a", "b", " c\n d"]
    library, rng = Tokenizer.from_file(BYTE_BPE), random.Random(11)
    library.encode_special_tokens = True
    for _ in range(200):
        text = odd_text(rng, 40)
        first, *units = split_units(text)
        assert library.encode(text).ids == [i for part in (first, *(" " + u for u in units)) for i in library.encode(part).ids]


def test_perfect_hash():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1_600_000_000, 30_000))
    n = perfect_hash.slice_count(len(keys), 4000)
    parts = {i: perfect_hash.build(keys[keys % n == i]) for i in range(n)}
    index = perfect_hash.PerfectHash(n, parts).index(keys)
    assert (np.sort(index) == np.arange(len(keys))).all()
    some = perfect_hash.PerfectHash(n, {i: parts[i] for i in (3, 1)})
    own = np.isin(keys % n, [1, 3])
    index = some.index(keys)
    assert (index[~own] == -1).all() and (np.sort(index[own]) == np.arange(own.sum())).all()
    assert perfect_hash.PerfectHash(1, {0: perfect_hash.build(keys[:0])}).index(keys[:3]).tolist() == [-1] * 3


def test_remembered_keeps_two_generations():
    made = []
    table = Remembered(lambda key: made.append(key) or key * 2, most=2)
    assert [table[k] for k in (1, 2, 3, 1, 2, 3)] == [2, 4, 6, 2, 4, 6]
    assert made == [1, 2, 3, 2]  # of the generation before last, 2 is forgotten
