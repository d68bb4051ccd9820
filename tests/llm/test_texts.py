"""Quality, mixing, packing, licenses, chats and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pageframe.llm import chat_format, license_scan, mixing, packing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_chars long, score double"
SF = "/root/testdata/sf0.01"


def docs_of(spark, rows, parts=5):
    full = [(i, text, source, len(text or ""), 0.5) for i, text, source in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


# --- quality --------------------------------------------------------------------


def test_discriminant_is_the_difference_of_gaussians():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    covs = {1: a @ a.T + np.eye(3), 0: b @ b.T + np.eye(3)}
    means = {1: np.zeros(3), 0: np.ones(3)}
    model = quality.Discriminant(means, {k: np.linalg.cholesky(v) for k, v in covs.items()}, 0.3)
    x = rng.normal(size=(5, 3))

    def density(label, v):
        d = v - means[label]
        return -0.5 * d @ np.linalg.inv(covs[label]) @ d - 0.5 * np.log(np.linalg.det(covs[label]))

    want = [1 / (1 + np.exp(-(0.3 + density(1, v) - density(0, v)))) for v in x]
    assert np.allclose(model.score(x), want)


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(1)
    k = len(quality.FEATURES)
    x, y = rng.normal(size=(50, k)), rng.integers(0, 2, 50)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "x array<double>, label int").repartition(4)
    for label, (n, total, outer) in quality.moments(df, "x", "label").items():
        own = x[y == label]
        assert n == len(own) and np.allclose(total, own.sum(axis=0)) and np.allclose(outer, own.T @ own)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    stats = quality.with_statistics(docs).cache()
    model = quality.fit(quality.labelled(stats, labels))
    rows = quality.quality_scores(stats, model).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_quality_of_odd_rows(spark):
    texts = ["", None, "x " * 50_000, "plain words here", "plain words here", "\x0b"]
    df = docs_of(spark, [*[(i, t, "s") for i, t in enumerate(texts)], (None, "a", None), (3, "again", "s")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    stats = quality.with_statistics(df)
    for some in (labels, labels.limit(0)):
        scored = quality.quality_scores(stats, quality.fit(quality.labelled(stats, some))).collect()
        assert len(scored) == 8 and all(0 <= r.score <= 1 for r in scored)
        assert all(r.predicted == int(r.score >= 0.7) for r in scored)
    assert quality.quality_scores(stats.limit(0), quality.Discriminant()).count() == 0


# --- mixing ---------------------------------------------------------------------


def slow_targets(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        share = (total - sum(3 * sizes[s] for s in stopped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in stopped else share * weight[s] for s in order}
        stopped |= over


def mix_rows():
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 700), rng.choice(["a", "b", "ä", "Z", "tiny", None])) for i in range(200)]
    rows = [(i, t if s != "tiny" else "w", s) for i, t, s in rows]
    return [*rows, (900, None, "none"), (901, "", "none"), (5, "twice x", "a"), (5, "twice x", "a"), (None, "no id", "b")]


def test_mix_meets_its_targets(spark):
    rows = mix_rows()
    got = mixing.mix(docs_of(spark, rows)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    want = slow_targets(totals)
    taken, target = Counter(), {}
    source = {(i, size(t)): s for i, t, s in rows}
    for r in got:
        s = source[r.doc_id, r.size]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size and r.source_size == totals[s]
    assert target == pytest.approx(want) and want["tiny"] == 3 * totals["tiny"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = mixing.mix(docs_of(spark, rows, parts=2)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_shards_take_disjoint_blocks_by_quota(spark):
    rows = mixing.units(docs_of(spark, mix_rows()), "doc_id", "source", "text")
    draws = mixing.draw(rows, mixing.targets(rows), block_words=16, shards=8).collect()
    keys = [(r.id, r.digest, r.copy, r.epoch, r.block) for r in draws]
    assert len(set(keys)) == len(keys) and {r.shard for r in draws} <= set(range(8))
    per_shard = Counter(r.shard for r in draws)
    assert max(per_shard.values()) - min(per_shard.values()) <= 3


def test_quotas_add_up():
    counts = np.array([7, 0, 1000, 3, 10**10], np.int64)
    left = mixing.split_counts(counts, 1, 1)
    assert left.sum() == counts.sum() // 2 and (left >= 0).all() and (left <= counts).all()
    assert (mixing.split_counts(counts, 1, 1) == left).all()
    mean = np.mean([mixing.split_counts(np.array([30, 70]), 1, node) for node in range(300)], axis=0)
    assert abs(mean[0] - 15) < 1


def test_mixed_documents_hold_what_was_taken(spark):
    rows = [(i, f"{t} end{i}" if t else t, s) for i, t, s in mix_rows()]
    df = docs_of(spark, rows)
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id] += r.taken
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    words = Counter()
    known = {i: t for i, t, _ in rows if i != 5}
    for r in got.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        if r.doc_id in known:
            assert r.text == known[r.doc_id] or set(r.text.split()) <= set(known[r.doc_id].split())
    assert words == +taken


# --- packing --------------------------------------------------------------------


def slow_cuts(points, costs, window):
    best = {0: 0}
    for j in range(1, len(points)):
        best[j] = min(best[i] + window - (points[j] - points[i]) + costs[j] for i in range(j) if points[j] - points[i] <= window)
    return best[len(points) - 1]


def test_cuts_are_cheapest():
    rng = random.Random(6)
    for _ in range(200):
        points = [0]
        for _ in range(rng.randrange(1, 40)):
            points.append(points[-1] + rng.randrange(1, 20))
        costs = [rng.choice([0, 1, 8]) for _ in points]
        path = packing.choose_cuts(points, costs, 20)
        cost = sum(20 - (points[b] - points[a]) + costs[b] for a, b in zip(path, path[1:], strict=False))
        assert path[0] == 0 and path[-1] == len(points) - 1 and cost == slow_cuts(points, costs, 20)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_ids_equal_the_tokenizers_own(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    table = packing.WordIds(tokenizer)
    texts = [
        "Hello, World. it's 3.14!! ... a.b", "É é É é ΣΑΣ ΑΣ", "x\x0by\x0cz\x1cq\x85r s t", "<|endoftext|> <|ENDOFTEXT|>",
        "a. b.\nc.. d., e'll İi K", "日本語。 テスト", "", "   ", "﻿bom .", "don't.can't, 'S we'RE", "​.x", "2. x². ½. á. ",
    ]
    for text in texts:
        assert table.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_marks_behind_a_word_are_looked_up_alone(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = packing.WordIds(tokenizer)
    asked = []
    monkeypatch.setattr(table, "encode", lambda text, encode=table.encode: asked.append(text) or encode(text))
    text = "word$$$ word!! wörter, cité.%%% fiancé... cité... wörter$$$ word... word%%% über!!"
    assert table.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted({"$$$", "!!", ",", ".%%%", "...", "%%%"})
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("abszéßAя日İ1²½'’.,!?$%-_&…。€  ") for _ in range(rng.randrange(1, 14)))
        assert table.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check_packed(rows, pieces, ids_of, window):
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = np.array([*ids_of(text or ""), 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    total = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == total[p.sequence_id]
        total[p.sequence_id] += p.length
    assert all(0 < n <= window for n in total.values())
    padding = sum(window - n for n in total.values() if n & (n - 1))
    return padding / (padding + sum(total.values()))


def test_words_are_forgotten_behind_a_task():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    table = packing.WordIds(Tokenizer.from_file(path))
    first = table.ids("Some words, twice: some words.").tolist()
    assert len(table)
    table.forget()
    assert not table and not table.before
    assert table.ids("Some words, twice: some words.").tolist() == first


def test_packing_is_a_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(400).collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "word " * 30_000), (10_003, "x" * 50_000)]
    df = docs_of(spark, [(i, t, "s") for i, t in rows], parts=3)
    pieces = packing.pack(df, path).collect()
    assert check_packed(rows, pieces, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, 2048) < 0.005
    assert all(len(p.ids) == p.length for p in pieces)
    assert packing.pack(df.limit(0), path).count() == 0


def test_chunks_leave_no_padding(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 300)
    rng = np.random.default_rng(3)
    docs = [(i, rng.integers(0, 9, rng.integers(1, 400)).astype("<u4")) for i in range(80)]
    packer = packing.Packer(5, 64, np.array([0], "<u4"))
    pieces = [p for i, ids in docs for p in packer.add(i, ids)] + list(packer.flush(last=True))
    for i, ids in docs:
        own = sorted((p for p in pieces if p[0] == i), key=lambda p: p[1])
        assert np.array_equal(np.concatenate([p[7] for p in own]), ids)
    total = Counter()
    for p in pieces:
        total[p[5]] += p[2]
    assert max(total.values()) <= 64 and len(total) < 1.25 * sum(map(len, (ids for _, ids in docs))) / 64


def test_draws_of_any_size_are_hypergeometric(monkeypatch):
    """Small populations by inversion against exact probabilities; a large one against mean and variance."""
    rng = np.random.default_rng(4)
    good, bad, draws, n = 30, 50, 25, 20_000
    monkeypatch.setattr(mixing, "NUMPY_DRAWS", 0)
    seen = Counter(mixing._hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(26):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(seen[k] - n * p) <= 5 * (n * p * (1 - p)) ** 0.5 + 1
    assert mixing._hypergeometric(rng, 5, 0, 3) == 3 and mixing._hypergeometric(rng, 0, 9, 3) == 0
    good, bad, draws = 4 * 10**9, 6 * 10**9, 5 * 10**9
    many = np.array([mixing._hypergeometric(rng, good, bad, draws) for _ in range(60)])
    spread = (draws * 0.4 * 0.6 * 0.5) ** 0.5
    assert abs(many.mean() - 2 * 10**9) < 5 * spread / 60**0.5 and 0.6 < many.std() / spread < 1.5


# --- licenses -------------------------------------------------------------------


def slow_scan(text):
    fold = {i: chr(i + 32) for i in range(65, 91)}
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
    places, base, labels, best = [], set(), set(), 0.0
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    step = license_scan.block_step(license_scan.TEMPLATES)
    for at in range(0, len(words), step):
        block = set(words[at : at + 2 * step])
        run = f" {' '.join(words[at : at + 2 * step])} "
        for label, text in license_scan.TEMPLATES:
            share = len(block & set(text.split())) / len(set(text.split()))
            if share >= 0.8 and f" {license_scan.CORES[label]} " in run:
                labels.add(label)
                best = max(best, share)
    step = license_scan.block_step(license_scan.NOTICES)
    for at in range(0, len(words), step):
        block = set(words[at : at + 2 * step])
        for label, text in license_scan.NOTICES:
            share = len(block & set(text.split())) / len(set(text.split()))
            if share >= 0.8:
                labels.add(label)
                best = max(best, share)
    both = ",".join(sorted(base | labels))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), both, max(best, float(bool(base))))


def test_licenses_against_brute_force(spark):
    rng = random.Random(8)
    filler = ["the", "under", "License", "work", "é", "x", "MIT", "version", "2", "by", "nc", "rights", "K"]
    rows = [(i, " ".join(rng.choice(filler) for _ in range(rng.randrange(60)))) for i in range(80)]
    for i, (_, notice) in enumerate(license_scan.TEMPLATES * 8):
        words = notice.upper().split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "other"
        lead = " ".join(rng.choice(filler) for _ in range(rng.randrange(40)))
        rows.append((200 + i, f"({lead}) {', '.join(words)}; tail"))
    rows += [(500, "cc by nc cc-by-nc CC BY NC"), (501, None), (502, ""), (503, " .,"), (504, "a " * 60_000 + "Under the MIT License"), (504, "twice")]
    rows += [(600 + i, f"{label} {words.upper()} x y z") for i, (label, words) in enumerate(license_scan.NOTICES)]
    rows += [(505, "Éunder the mit license"), (506, "under\nthe mit license"), (507, "apache license, version 2.0"), (None, "all rights reserved")]
    df = docs_of(spark, [(i, t, "s") for i, t in rows])
    got = license_scan.license_scan(df).collect()
    assert Counter(map(tuple, got)) == Counter((i, *slow_scan(t)) for i, t in rows)
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_canonical_notices_are_labelled(spark):
    """Whole notices and ones with a few words changed, at any place of a text; half a notice and other prose are not."""
    rng = random.Random(9)
    rows, want = [], {}
    for label, notice in license_scan.NOTICES:
        for changed in (0, 6):
            words = notice.upper().split()
            for at in rng.sample(range(len(words)), changed):
                words[at] = "other"
            lead = " ".join(f"x{rng.randrange(99)}" for _ in range(rng.randrange(700)))
            rows.append((len(rows), f"{lead}\n// {', '.join(words)}. {lead}", "s"))
            want[len(want)] = label
        rows.append((len(rows), " ".join(notice.split()[: len(notice.split()) // 3]), "s"))
        want[len(want)] = ""
    got = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    assert {i: label for i, label in want.items() if label and label not in got[i]} == {}
    for i, label in want.items():
        others = {name for name, _ in license_scan.NOTICES if name not in (label, "apache-2")}
        assert not others & set(got[i])


def test_another_licence_is_not_taken_for_one(spark):
    texts = [
        "released under the BSD license", "released under the GPL license", "licensed under the GPL license version 2 0",
        "all rights are granted; reserved seats", "all rights are reserved", "this work is licensed under the gnu general public license version 2",
    ]
    named = ["released under the MIT license", "All rights reserved.", "licensed under the Apache license version 2", "licensed under CC BY NC 4"]
    rows = [(i, text, "s") for i, text in enumerate(texts + named)]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(len(texts))] == [("", 0.0)] * len(texts)
    assert [got[len(texts) + i][0] for i in range(4)] == ["mit", "all-rights-reserved", "apache-2", "cc-by-nc"]


def test_license_scan_runs_no_python(spark):
    plan = license_scan.license_scan(docs_of(spark, [(1, "x", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- chats ----------------------------------------------------------------------


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nSecond par here."),
        (1, 1, "assistant", "> How are you?\nFine, thanks."),
        (1, 2, "user", ">> How are you?\n> Fine,\n> thanks.\nGood to hear"),
        (1, 3, "user", "> second PAR   here.\nok"),
        (1, 4, None, None),
        (1, 5, "user", "> nobody said this\nfoo"),
        (1, 5, "user", "> nobody said this\nfoo"),
        (None, 0, "user", "> hi\nhi"),
        (2, 0, "user", "a"), (2, 1, "user", "> a\nb"), (2, 2, "user", "> b\nc"), (2, 3, "user", "> c\n d"), (2, 4, "user", "new"), (2, 5, "user", "> a\ne"),
        (3, 0, "user", "> said later\nx"), (3, 1, "user", "said later"),
        (4, 1, "user", "same"), (4, 1, "user", "> same\ny"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, message string, row int")
    got = chat_format.chat_format(df.repartition(4)).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    replies = {k: r.reply_to for k, r in by.items() if r.reply_to is not None}
    assert replies == {(1, 1): 0, (1, 2): 1, (1, 3): 0, (2, 1): 0, (2, 2): 1, (2, 3): 2, (2, 5): 0}
    assert by[1, 2].n_quotes == 2 and by[1, 2].n_linked == 2 and by[1, 5].n_linked == 0
    assert by[1, 2].message == "<|user|>\nGood to hear\n<|end|>" and by[1, 4].message == "<|unknown|>\n\n<|end|>"
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.position)]
    assert order == [0, 1, 2, 3, 5, 4] and len(got) == len(rows)
    assert chat_format.chat_format(df.limit(0)).count() == 0


def test_a_piece_that_every_turn_repeats(spark):
    rows = [(1, t, "user", "> hi\nhi") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat_format.chat_format(df).collect()
    assert {r.turn: r.reply_to for r in got} == {t: t - 1 if t else None for t in range(400)}
    assert {r.thread for r in got} == {0} and sorted(r.position for r in got) == list(range(400))


# --- pipeline -------------------------------------------------------------------


def test_pipeline_keeps_one_clean_row_of_each_group(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.first()
    extra = [(9001, first.text, "en", "src0", None), (9001, first.text, "en", "src0", None), (9002, None, None, None, None), (9003, "", "en", "src1", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("k_id", F.lit("clash"))
    now, counts = docs, [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), docs.schema)
        assert now.columns == docs.columns
        counts.append(now.count())
    quality_rows, exact_rows, near_rows, mixed_rows = counts[1:]
    assert counts[0] > quality_rows > exact_rows >= near_rows and mixed_rows > 0
    assert pipeline.STAGES[-1][1](spark, now, sf).filter("start = 0").count() == counts[-1]


def slow_quality(rows, labels):
    """Kept ids, by a discriminant fitted in one place."""
    x = {i: np.array(quality.statistics(t)) for i, t in rows}
    known = {i: q for i, q in labels.items() if i in x and zlib.crc32(str(i).encode()) % 4 != 2}
    odds = {i: np.log((sum(q == 1 for q in known.values()) + 0.5) / (sum(q == 0 for q in known.values()) + 0.5)) for i in x}
    for label, sign in ((1, 1), (0, -1)):
        own = np.array([x[i] for i, q in known.items() if q == label])
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        inverse, (_, log_det) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        for i, v in x.items():
            d = v - own.mean(axis=0)
            odds[i] += sign * (-0.5 * d @ inverse @ d - 0.5 * log_det)
    return {i for i, o in odds.items() if 1 / (1 + np.exp(-np.clip(o, -700, 700))) >= 0.7}


def test_stages_against_brute_force(spark):
    import corpus_pipeline as pipeline
    from test_dedup import classes, slow_print
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    stages = [stage for _, stage in pipeline.STAGES]

    def after(n, df):
        return spark.createDataFrame(stages[n](spark, df, sf).collect(), docs.schema)

    now = after(0, docs)
    kept = slow_quality([(i, t) for i, (t, _) in rows.items()], labels)
    assert {r.doc_id for r in now.collect()} == kept
    now = after(1, now)
    fold = {i: chr(i + 32) for i in range(65, 91)}
    largest = {}
    for i in sorted(kept):
        largest[rows[i][0].translate(fold)] = i
    assert sorted(r.doc_id for r in now.collect()) == sorted(largest.values())
    now = after(2, now)
    ids = sorted(largest.values())
    prints = {i: slow_print(rows[i][0]) for i in ids}
    near = [(a, b) for a in ids for b in ids if b < a and bin(prints[a] ^ prints[b]).count("1") <= 3]
    left = sorted(set(classes(ids, near).values()))
    assert sorted(r.doc_id for r in now.collect()) == left
    now = after(3, now)
    mixed = now.collect()
    totals, taken = Counter(), Counter()
    for i in left:
        totals[rows[i][1]] += len(WORD.findall(rows[i][0]))
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
        whole = WORD.findall(rows[r.doc_id][0])
        assert r.source == rows[r.doc_id][1] and (r.text == rows[r.doc_id][0] or not Counter(WORD.findall(r.text)) - Counter(whole))
    assert taken == {s: int(np.floor(t + 0.5)) for s, t in slow_targets(totals).items() if t >= 0.5}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    lengths = Counter((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed)
    packed = stages[4](spark, now, sf).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == lengths
    assert sum(r.length for r in packed) == sum(n * k for (_, n), k in lengths.items())


def test_run_equals_its_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    rows = pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    total = Counter()
    for r in rows:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048


def said(lines):
    """All that a run of lines can be found by: the whole, its paragraphs, its lines, without case and breaks."""
    plain = [" ".join(line.lower().split()) for line in lines]
    whole, parts, part = " ".join(" ".join(plain).split()), [], []
    for line in [*plain, ""]:
        if line:
            part.append(line)
        elif part:
            parts.append(" ".join(part))
            part = []
    return {text for text in [whole, *parts, *plain] if text}


def runs_of(text):
    """(level, lines) of each run of equally quoted lines."""
    out = []
    for line in text.split("\n"):
        level = 0
        if line.lstrip(" \t")[:1] == ">":
            line = line.lstrip(" \t")
        while line[:1] == ">":  # one blank may follow a mark
            level, line = level + 1, line[1:]
            line = line[1:] if line[:1] in (" ", "\t") else line
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line)
    return out


def slow_links(messages):
    """(conv, turn) -> (reply_to, n_quotes, n_linked), each quoted run compared with each earlier turn."""
    parsed = {(conv, turn): runs_of(text) for conv, turn, text in messages}
    own = {}
    for key, runs in parsed.items():
        mine = [line for level, lines in runs if level == 0 for line in lines]
        own[key] = said(mine).union(*[said(lines) for level, lines in runs if level == 0])
    out = {}
    for (conv, turn), runs in parsed.items():
        quoted = [(level, said(lines)) for level, lines in runs if level > 0 and said(lines)]
        best, linked = None, 0
        for level, texts in quoted:
            hits = [(-level, len(t), max(n for c, n in own if c == conv and n < turn and t in own[c, n])) for t in texts if any(c == conv and n < turn and t in own[c, n] for c, n in own)]
            linked += bool(hits)
            best = max([*hits, *([best] if best else [])], default=None)
        out[conv, turn] = (best and best[2], len(quoted), linked)
    return out


def test_quotes_against_brute_force(spark):
    """Random conversations that quote earlier turns whole, in part, nested and with their lines broken anew."""
    rng = random.Random(12)
    pool = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randrange(2, 7))) for _ in range(30)]
    messages = []
    for conv in range(25):
        texts = []
        for turn in range(rng.randrange(1, 10)):
            lines = []
            for _ in range(rng.randrange(0, 3)):
                if texts:
                    source = [line for line in rng.choice(texts).split("\n")]
                    some = source if rng.random() < 0.5 else rng.sample(source, rng.randrange(1, len(source) + 1))
                    if rng.random() < 0.4 and not any(line.startswith(">") for line in some):
                        words = " ".join(some).upper().split() or ["x"]
                        cut = rng.randrange(len(words))
                        some = [" ".join(words[:cut]), " ".join(words[cut:])]
                    lines += [rng.choice(["> ", ">", " > "]) + line for line in some]
                lines += [rng.choice([*pool, ""]) for _ in range(rng.randrange(0, 3))]
            lines += [rng.choice(pool) for _ in range(rng.randrange(1, 3))]
            texts.append("\n".join(lines))
            messages.append((conv, turn, texts[-1]))
    frame = spark.createDataFrame([(c, t, "user", text) for c, t, text in messages], "conv_id long, turn long, role string, text string")
    got = chat_format.chat_format(frame.repartition(5)).collect()
    want = slow_links(messages)
    assert sum(bool(n) for _, _, n in want.values()) > 30 and any(n < q for _, q, n in want.values())
    assert {(r.conv_id, r.turn): (r.reply_to, r.n_quotes, r.n_linked) for r in got} == want
