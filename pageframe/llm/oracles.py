"""Expected results of the dealt operators as DuckDB SQL, where SQL can express them."""

from pageframe.llm.license_scan import NOTICES

_NOTICES = ", ".join(f"('{label}', '{words}')" for label, words in NOTICES)
_TEXTS = ", ".join(f"('{words}')" for _, words in NOTICES)

ORACLES = {
    "op2_substring_dedup": r"""
        with docs as (
            select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') words
            from documents
        ), starts as (
            select doc_id, unnest(range(1, len(words) - 33)) as p, words from docs where len(words) >= 35
        ), windows as (
            select doc_id, p, sha256(array_to_string(words[p:p + 34], ' ')) as h from starts
        ), repeated as (
            select doc_id, p from (select *, count(*) over (partition by h) as n from windows) where n > 1
        ), gone as (
            select doc_id, list_distinct(flatten(list(range(p, p + 35)))) as places from repeated group by doc_id
        ), kept as (
            select d.doc_id, words, len(coalesce(places, [])) as removed,
                   list_filter(range(1, len(words) + 1), lambda i: not list_contains(coalesce(places, []), i)) as places
            from docs d left join gone g on d.doc_id = g.doc_id
        )
        select doc_id, len(words)::bigint as n_words, removed::bigint as n_removed,
               sha256(array_to_string(list_transform(places, lambda i: words[i]), ' ')) as kept_sha256
        from kept
    """,
    "op4_exact_dedup": """
        with rows as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') norm
            from documents
        )
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(norm) as text_sha256
        from rows window same as (partition by norm)
    """,
    "op5_embedding_dedup": """
        with recursive vectors as (
            select vec_id, embedding::double[] as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from vectors a, vectors b
            where a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9
        ), reach as (
            select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
        )
        select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(first, vec_id)) as component_id,
               least(vec_id, coalesce(first, vec_id)) = vec_id as kept
        from embeddings
        left join (select a, count(*) as n from links group by a) on vec_id = a
        left join (select a as r, min(b) as first from reach group by a) on vec_id = r
    """,
    "op10_license_scan": r"""
        with docs as (
            select doc_id, row_number() over () as row, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words
            from documents
        ), templates as (
            select label, string_split(words, ' ') as words, string_split(core, ' ') as core from (values
                ('mit', 'released under the mit license', 'mit license'),
                ('apache-2', 'licensed under the apache license version 2 0', 'apache license version 2'),
                ('cc-by-nc', 'licensed under cc by nc 4 0', 'cc by nc'),
                ('gpl-3', 'this work is licensed under the gnu general public license version 3', 'gnu general public license version 3'),
                ('all-rights-reserved', 'all rights reserved', 'all rights reserved')) t(label, words, core)
        ), notices as (
            select label, list_distinct(string_split(words, ' ')) as words from (values
                @NOTICES@) t(label, words)
        ), phrases as (
            select label, string_split(words, ' ') as words from (values
                ('mit', 'under the mit license'), ('apache-2', 'apache license version 2'),
                ('cc-by-nc', 'cc by nc')) t(label, words)
        ), places as (
            select row, label, words, unnest(range(1, len(words) + 1)) as p, phrase
            from docs, (select label, words as phrase from phrases)
            where list_has_any(words, phrase)
        ), base as (
            select row, count(*) as n_base, min(p) - 1 as first_word, max(p) - 1 as last_word, list(distinct label) as labels
            from places where words[p:p + len(phrase) - 1] = phrase group by row
        ), tokens as (
            select distinct row, label, d.words[p] as token, unnest([(p - 1) // 12, (p - 1) // 12 - 1]) as block,
                   len(list_distinct(t.words)) as n
            from (select row, words, unnest(range(1, len(words) + 1)) as p from docs) d
            join (select label, words, unnest(words) as token from templates) t on d.words[p] = t.token
        ), alike as (
            select row, label, c from (
                select row, label, block, count(distinct token) / any_value(n) as c
                from tokens where block >= 0 group by row, label, block)
            join (select row, words from docs) using (row) join (select label, core from templates) using (label)
            where c >= 0.8 and len(list_filter(range(block * 12 + 1, block * 12 + 26 - len(core)), lambda p: words[p:p + len(core) - 1] = core)) > 0
        ), noted as (
            select row, n.label, len(list_intersect(list_distinct(d.words[lo:lo + 2 * step - 1]), n.words)) / len(n.words) as c
            from (select row, words, unnest(range(1, len(words) + 1, (select max(len(string_split(w, ' '))) from (values @TEXTS@) t(w)))) as lo,
                         (select max(len(string_split(w, ' '))) from (values @TEXTS@) t(w)) as step from docs) d, notices n
        ), best as (
            select row, label, max(c) as best from (
                select row, label, c from alike union all select row, label, c from noted where c >= 0.8) group by row, label
        ), more as (
            select row, list(label) as labels, max(best) as best from best group by row
        )
        select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
               array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') as labels,
               greatest(case when n_base > 0 then 1.0 else 0.0 end, coalesce(best, 0.0))::double as score
        from docs d left join base b on d.row = b.row left join more m on d.row = m.row
    """,
    "op11_lexical_search": r"""
        with docs as (
            select doc_id, row_number() over () as row, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') as terms
            from documents
        ), total as (
            select count(*) filter (len(terms) > 0) as docs, sum(len(terms))::bigint as terms from docs
        ), asked as (
            select distinct item, item_id, unnest(list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) as term
            from (select *, row_number() over () as item from benchmark)
        ), postings as (
            select row, doc_id, term, count(*) as tf, any_value(n) as n
            from (select row, doc_id, len(terms) as n, unnest(terms) as term from docs)
            where term in (select term from asked) group by row, doc_id, term
        ), weights as (
            select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from postings, total group by term
        ), scores as (
            select item, item_id, row, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total.terms))))::bigint as score
            from asked join weights using (term) join postings using (term), total group by item, item_id, row, doc_id
        )
        select item_id, (row_number() over best)::int as rank, doc_id, score from scores where score > 0
        window best as (partition by item order by score desc, doc_id) qualify row_number() over best <= 10
    """,
}
ORACLES["op10_license_scan"] = ORACLES["op10_license_scan"].replace("@NOTICES@", _NOTICES).replace("@TEXTS@", _TEXTS)
