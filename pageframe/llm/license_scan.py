"""License scan: exact set-similarity join of text blocks and license templates, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.texts import folded, stored

# What stands between words, and the phrases that are looked for word by word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Templates of the set-similarity join: a label and the words of a notice.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("all-rights-reserved", "all rights reserved"),
]
CONTAINMENT = 0.8
#: Of a one-line template these words must stand in the block one after the other: without them it is another licence.
CORES = {
    "mit": "mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
    "gpl-3": "gnu general public license version 3",
    "all-rights-reserved": "all rights reserved",
}
#: Canonical notices, folded; they have blocks of their own length. `gnu` heads files under the GPL, LGPL or AGPL.
NOTICES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect "
        "incidental special exemplary or consequential damages including but not limited to procurement of substitute goods "
        "or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of "
        "this software even if advised of the possibility of such damage",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
        "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language "
        "governing permissions and limitations under the license",
    ),
    (
        "gnu",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version of the license or at your option any later "
        "version this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more "
        "details you should have received a copy of the gnu general public license along with this program",
    ),
]


def block_step(templates: list[tuple[str, str]]) -> int:
    """Blocks are twice as long as the longest template and start that far apart, so a notice lies whole in one."""
    return max((len(words.split()) for _, words in templates), default=1)


def _words_and_hits(text: Column, vocabulary: list[str], gate: list[str]) -> Column:
    """(n_words, hits, gated): places of words of the vocabulary as (pos, token) in order, and whether a gate word is there."""

    def of(parts: Column) -> Column:
        lead = F.when(parts[0] == "", 1).otherwise(0)
        tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
        places = F.array_compact(F.transform(parts, lambda w, i: F.when(w.isin(vocabulary), i)))
        hits = F.transform(places, lambda p: F.struct((p - lead).alias("pos"), parts[p].alias("token")))
        gated = F.exists(parts, lambda w: w.isin(gate))
        return F.struct((F.size(parts) - lead - tail).cast("long").alias("n_words"), hits.alias("hits"), gated.alias("gated"))

    return F.transform(F.array(F.split(text, BETWEEN)), of)[0]  # one element, so the text is split once


def _phrase_starts(phrase: str) -> Column:
    """Places where the words of a phrase stand one after the other."""
    words = phrase.split()
    k = len(words)

    def here(j: Column) -> Column:
        run = F.slice("hits", j + 1, k)
        return (run["token"] == F.array(*map(F.lit, words))) & (run["pos"][k - 1] - run["pos"][0] == k - 1)

    first = F.when(F.size("hits") >= k, F.sequence(F.lit(0), F.size("hits") - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(first, here), lambda j: F.col("hits.pos")[j])


def _gate(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words one of which stands in every text that holds a template: of t, `need` of them met, one of any t - need + 1."""
    some = set()
    for _, words in templates:
        tokens = sorted(set(words.split()), key=lambda token: (-len(token), token))
        some.update(tokens[: len(tokens) - math.ceil(threshold * len(tokens) - 1e-9) + 1])
    return sorted(some)


def _ordered_templates(hits: DataFrame, templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    """Tokens of each template, rarest in the whole corpus first, the overlap it needs and its prefix.

    Counted are the words of the templates alone, a number fixed by the templates.
    """
    counts = {
        row["token"]: row["count"]
        for row in hits.select(F.explode("hits.token").alias("token")).groupBy("token").count().collect()
    }
    out = []
    for number, (label, words) in enumerate(templates):
        tokens = sorted(set(words.split()), key=lambda token: (counts.get(token, 0), token))
        need = math.ceil(threshold * len(tokens) - 1e-9)
        out.append({"template": number, "label": label, "tokens": tokens, "need": need})
    return out


def similar_blocks(
    hits: DataFrame, templates: list[tuple[str, str]], threshold: float = CONTAINMENT, cores: dict[str, str] | None = None
) -> DataFrame:
    """(row, block, label, containment): every block that holds at least `threshold` of a template's words.

    `hits` has (row, n_words, hits). A block must hold one of the rarest words of a template, its prefix: with t words
    and `need` of them to be met, one of the t - need + 1 rarest. Only rows with such a word are taken apart. A
    candidate goes on only if the block is long enough (length filter) and if the template's words from the first
    one met on, and the block's, still suffice (positional filter). Then the overlap is counted. Where `cores` has a
    phrase for a label, its words must also stand one after the other in the block.
    """
    spark = hits.sparkSession
    step = block_step(templates)
    ordered = _ordered_templates(hits, templates, threshold)
    sides = spark.createDataFrame(
        [(o["template"], o["label"], o["tokens"], o["need"]) for o in ordered],
        "template int, label string, t_tokens array<string>, need int",
    )
    prefixes = sides.select(
        "template", "label", "t_tokens", "need", F.posexplode("t_tokens").alias("i", "token")
    ).filter(F.col("i") <= F.size("t_tokens") - F.col("need"))
    rare = sorted({token for o in ordered for token in o["tokens"][: len(o["tokens"]) - o["need"] + 1]})
    spots = (
        hits.filter(F.arrays_overlap(F.col("hits.token"), F.array(*map(F.lit, rare)).cast("array<string>")))
        .select("row", "n_words", F.explode("hits").alias("hit"))
        .select("row", "n_words", F.col("hit.token").alias("token"), F.floor(F.col("hit.pos") / step).alias("b"))
        .select("row", "n_words", "token", F.explode(F.filter(F.array(F.col("b") - 1, F.col("b")), lambda b: b >= 0)).alias("block"))
    )
    blocks = spots.groupBy("row", "n_words", "block").agg(F.collect_set("token").alias("b_tokens"))  # words of templates alone
    # The templates are a constant of the operator, which bounds both broadcasts.
    met = (
        blocks.withColumn("token", F.explode("b_tokens"))
        .join(F.broadcast(prefixes.select("template", "token", "i")), "token")
        .groupBy("row", "n_words", "block", "b_tokens", "template")
        .agg(F.min("i").alias("i"))
        .join(F.broadcast(sides), "template")
    )
    long_enough = F.least(F.lit(2 * step), F.col("n_words") - F.col("block") * step) >= F.col("need")
    rest = F.slice("t_tokens", F.col("i") + 1, F.size("t_tokens"))
    enough_left = F.least(F.size(rest), F.size(F.array_except("b_tokens", F.slice("t_tokens", F.lit(1), F.col("i"))))) >= F.col("need")
    overlap = F.size(F.array_intersect(rest, F.col("b_tokens")))
    found = (
        met.filter(long_enough & enough_left)
        .withColumn("overlap", overlap)
        .filter("overlap >= need")
        .select("row", "block", "label", (F.col("overlap") / F.size("t_tokens")).alias("containment"))
    )
    if not cores:
        return found
    named = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(len(core.split())).alias("k"), _phrase_starts(core).alias("starts")) for label, core in cores.items()])
    starts = hits.select("row", F.explode(named).alias("core")).filter(F.size("core.starts") > 0).select("row", "core.*")
    first = F.col("block") * step
    inside = F.exists("starts", lambda p: (p >= first) & (p + F.col("k") <= first + 2 * step))
    free = ~F.col("label").isin(list(cores))
    return found.join(starts, ["row", "label"], "left").filter(free | F.coalesce(inside, F.lit(False))).select(*found.columns)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | None = None,
    threshold: float = CONTAINMENT,
    notices: list[tuple[str, str]] | None = None,
    cores: dict[str, str] | None = None,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased. Base
    labels come from phrases whose words stand one after the other, `labels` holds those of similar blocks too, and
    the score is the largest containment that was found: 1 for a base place, 0 where nothing is. Null and empty
    texts have no words; the word columns are then null and the labels empty. Rows that repeat are scanned alike.
    `notices` are templates too, longer ones, looked for in longer blocks. `cores` name what a block must say of a
    short template for its label to be given.
    """
    cores = CORES if cores is None else cores
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    notices = NOTICES if notices is None else notices
    vocabulary = sorted({w for text in [*phrases, *cores.values(), *(words for _, words in templates)] for w in text.split()})
    notice_words = sorted({w for _, words in notices for w in words.split()})
    text = folded(F.col(text_col))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        text.alias("text"),
        _words_and_hits(text, vocabulary, _gate(notices, threshold)).alias("found"),
    )
    noticed = F.when(F.col("found.gated"), _words_and_hits(F.col("text"), notice_words, [])["hits"])
    rows = stored(rows.select("row", "id", "found.n_words", "found.hits", noticed.alias("notice_hits")), "license-hits")
    noted = rows.filter("notice_hits IS NOT NULL").select("row", "n_words", F.col("notice_hits").alias("hits"))
    similar = (
        similar_blocks(rows, templates, threshold, cores)
        .unionByName(similar_blocks(noted, notices, threshold))
        .groupBy("row")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    )
    names = [f"p{i}" for i in range(len(phrases))]
    places = F.concat(F.array().cast("array<int>"), *names)
    base = F.array_sort(
        F.array_distinct(
            F.array_compact(F.array(*[F.when(F.size(n) > 0, F.lit(label)) for n, label in zip(names, phrases.values(), strict=True)]))
        )
    ).cast("array<string>")
    found = rows.select("row", "id", "n_words", *[_phrase_starts(p).alias(n) for p, n in zip(phrases, names, strict=True)])
    return (
        found.select("row", "id", "n_words", places.alias("places"), base.alias("base"))
        .join(similar, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.size("places").cast("long").alias("n_base"),
            F.array_min("places").cast("long").alias("first_word"),
            F.array_max("places").cast("long").alias("last_word"),
            F.array_join("base", ",").alias("base_labels"),
            F.array_join(
                F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ","
            ).alias("labels"),
            F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
        )
    )
