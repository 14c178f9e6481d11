"""The same queries in DuckDB SQL, written on their own: no shared code beyond the stop words."""

from __future__ import annotations

from lexloom.functions.text import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
DOCS = """docs as (select doc_id as idx, regexp_extract(coalesce(text, ''), '^[^\\n]*') as title, '' as author,
  coalesce(source, '') as bib, coalesce(text, '') as abstract from documents)"""
POST = f"""{DOCS}, post as (select distinct idx as doc_id, w as term from (
  select idx, unnest(regexp_extract_all(lower(concat_ws(' ', title, author, bib, abstract)), '[\\p{{L}}\\p{{N}}_]+')) w from docs)
  where regexp_full_match(w, '\\p{{L}}+') and w not in ({_STOPS}))"""
DICT = """dict as (select distinct w as word from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) w from benchmark) where length(w) > 2)"""
ASKED = f"""{DICT}, qs as (select row_number() over (order by word) - 1 as number,
  substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) as query, word as corrected from dict where length(word) >= 6),
 asked as (select distinct query from qs), pairs as (select distinct query, corrected from qs)"""
PHRASES = f"""{ASKED}, phrases as (select number // 3 as phrase_id, string_agg(query, ' ' order by number) as phrase, string_agg(corrected, ' ' order by number) as corrected,
  count(*) as size from qs group by 1), tokens as (select number // 3 as phrase_id, number % 3 as pos, query as token, corrected as want from qs)"""
_GRAMS = "(select {c}, unnest(list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))) g from {t})"
NGRAMS = f"""qg as {_GRAMS.format(c='query', t='asked')}, wg as {_GRAMS.format(c='word', t='dict')},
 qn as (select query, count(*) n from qg group by 1), wn as (select word, count(*) n from wg group by 1),
 jac as (select query, word, met::double / (qn.n + wn.n - met) as jaccard from (select query, word, count(*) met from qg join wg using (g) group by 1, 2) join qn using (query) join wn using (word)),
 best0 as (select query, word, jaccard from (select *, max(jaccard) over (partition by query) m from jac) where jaccard = m),
 best1 as (select * from best0 union all select query, (select min(word) from dict), 0.0 from asked where query not in (select query from best0)),
 best as (select *, row_number() over (partition by query order by word) as rank from best1)"""
#: Every three words side by side in a benchmark text, misspelled; `asked` are their words.
SPOKEN = f"""{DICT}, runs as (select item_id, regexp_extract_all(lower(text), '[a-z]+ [a-z]+ [a-z]+') as runs from benchmark),
 held as (select item_id * 1048576 + i - 1 as phrase_id, corrected from (select item_id, unnest(runs) as corrected, generate_subscripts(runs, 1) as i from runs)),
 tokens as (select phrase_id, i - 1 as pos, case when length(w) >= 6 then substr(w, 1, 1) || substr(w, 3, 1) || substr(w, 2, 1) || substr(w, 4) else w end as token from (
  select phrase_id, unnest(string_split(corrected, ' ')) as w, generate_subscripts(string_split(corrected, ' '), 1) as i from held)), asked as (select distinct token as query from tokens)"""
_LESS = "select {c}, substr(v, 1, i - 1) || substr(v, i + 1) as v from (select {c}, v, unnest(range(1, length(v) + 1)) i from {t})"


def _deletions(c: str, t: str, p: str) -> str:
    """Variants of words by up to two deletions."""
    return f"""{p}0 as (select {c}, {c} as v from {t}), {p}1 as (select distinct * from ({_LESS.format(c=c, t=p + '0')})), {p}2 as (select distinct * from ({_LESS.format(c=c, t=p + '1')})),
 {p} as (select {c}, v, min(d) d from (select *, 0 d from {p}0 union all select *, 1 from {p}1 union all select *, 2 from {p}2) group by 1, 2)"""


EDITS = f"""{_deletions('query', 'asked', 'qd')}, {_deletions('word', 'dict', 'wd')},
 near as (select query, word, min(qd.d + wd.d) distance from qd join wd using (v) where qd.d + wd.d <= 2 group by 1, 2),
 edit0 as (select query, query as word, 0 as distance from asked where query in (select word from dict)
  union all select query, word, distance from near where query not in (select word from dict)),
 edit1 as (select * from edit0 union all select query, query, 0 from asked where query not in (select query from edit0)),
 edits as (select query, word, distance::bigint as distance, row_number() over (partition by query order by distance, word) as rank from edit1)"""


def _code(w: str) -> str:
    out = f"upper(replace({w}, 'ß', 'ss'))"
    tail = f"translate(regexp_replace(substr({out}, 2), '[^BFPVCGJKQSXZDTLMNR]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556')"
    for d in "123456":
        tail = f"regexp_replace({tail}, '{d}+', '{d}', 'g')"
    return f"rpad(substr(substr({out}, 1, 1) || {tail}, 1, 4), 4, '0')"


#: Ratcliff/Obershelp: the longest block that two intervals share (the first of equals), then what is left and right of it.
HYBRID = """hp as (select query, word, jaccard from jac where 0.5 * jaccard + 0.5 * 2 * least(length(query), length(word)) / (length(query) + length(word)) >= 0.5 - 1e-9),
 rr as (select query, word, 1::bigint as a0, length(query) + 1 as a1, 1::bigint as b0, length(word) + 1 as b1, 0::bigint as k from hp
  union all
  select query, word, c.a0, c.a1, c.b0, c.b1, c.k from (
   select query, word, unnest([{'a0': a0, 'a1': -best.ni, 'b0': b0, 'b1': -best.nj, 'k': best.k}, {'a0': best.k - best.ni, 'a1': a1, 'b0': best.k - best.nj, 'b1': b1, 'k': 0}]) as c from (
    select query, word, a0, a1, b0, b1, max({'k': n, 'ni': -i, 'nj': -j}) as best from (
     select *, len(list_filter(range(1, least(a1 - i, b1 - j) + 1), lambda x: substr(query, i, x) = substr(word, j, x))) as n from (
      select query, word, a0, a1, b0, b1, i, unnest(range(b0, b1)) as j from (select *, unnest(range(a0, a1)) as i from rr))
     where substr(query, i, 1) = substr(word, j, 1))
    group by 1, 2, 3, 4, 5, 6))),
 hs as (select query, word, 0.5 * jaccard + 0.5 * (2.0::double * sum(k)::double / (length(query) + length(word))) as score from rr join hp using (query, word) group by query, word, jaccard),
 hk as (select query, word, score from hs where score >= 0.5),
 hc as (select *, row_number() over (partition by query order by score desc, word) as rank from (select * from hk union all select query, query, 0.0::double from asked where query not in (select query from hk)))"""
CHOICE = "choice as (select phrase_id, pos, case when token in (select word from dict) then token else word end as token from tokens join hc on query = token and rank = 1)"
SOUND = f"""sound as (select distinct query, word from (select query, {_code('query')} code from asked) join (select word, {_code('word')} code from dict) using (code))"""
_SOUND_NGRAM = """select query, word, jaccard from (select *, max(jaccard) over (partition by query) m from (
  select query, word, coalesce(jaccard, 0.0) as jaccard from sound left join jac using (query, word))) where jaccard = m"""
QUALITY = """quality as (select query, tp, n - tp as fp, case when n > 0 then tp::double / n else 0.0 end as share from (
  select query, corrected, sum((word is not null and word = corrected)::bigint)::bigint tp, count(word) n from pairs left join sound using (query) group by 1, 2))"""
#: Fields aren't joined, so a phrase must stand within one.
FIELDS = "(contains(lower(title), p) or contains(lower(author), p) or contains(lower(bib), p) or contains(lower(abstract), p))"
ALL_TEXT = "lower(concat_ws(' ', idx::varchar, title, author, bib, abstract))"
TOPK = """opts as (select phrase_id, pos, word, distance, rank from tokens join edits on query = token where rank <= 10),
 topk as (select phrase_id, rank, words, total from (select *, row_number() over (partition by phrase_id order by total, r1, r2, r3) as rank from (
  select a.phrase_id, concat_ws(' ', a.word, b.word, c.word) as words, (a.distance + b.distance + c.distance)::bigint as total, a.rank r1, b.rank r2, c.rank r3 from opts a join opts b using (phrase_id) join opts c using (phrase_id)
  where a.pos = 0 and b.pos = 1 and c.pos = 2)) where rank <= 10)"""
#: Combinations of the candidates of phrases of up to three words, in the order of their words.
COMBINED = """cands as (select phrase_id, pos, word from tokens left join sound on query = token),
 combined as (select phrase_id, row_number() over (partition by phrase_id order by x, y, z) as rank, concat_ws(' ', x, y, z) as suggestion from (
  select a.phrase_id, a.word as x, b.word as y, c.word as z, b.phrase_id as has_b, c.phrase_id as has_c from (select * from cands where pos = 0) a left join (select * from cands where pos = 1) b using (phrase_id)
  left join (select * from cands where pos = 2) c using (phrase_id)) where x is not null and (has_b is null or y is not null) and (has_c is null or z is not null))"""
PRODUCTS = f"{COMBINED}, products as (select * from combined where rank <= 50)"
#: Combinations that a document holds: a pattern of each place's words tells which phrases to look at.
SOUNDING = f"""choices as (select phrase_id, pos, '(?:' || string_agg(word, '|') || ')' as words from tokens join sound on query = token group by 1, 2),
 patterns as (select phrase_id, string_agg(words, ' ' order by pos) as pattern from choices group by 1 having count(*) = 3),
 meant as (select phrase_id, idx, title, author, bib, abstract from patterns join docs on regexp_matches(lower(title), pattern) or regexp_matches(lower(author), pattern) or regexp_matches(lower(bib), pattern) or regexp_matches(lower(abstract), pattern)),
 told as (select m.*, a.word || ' ' || b.word || ' ' || c.word as p from meant m join tokens t0 on t0.phrase_id = m.phrase_id and t0.pos = 0 join tokens t1 on t1.phrase_id = m.phrase_id and t1.pos = 1 join tokens t2 on t2.phrase_id = m.phrase_id and t2.pos = 2
  join sound a on a.query = t0.token join sound b on b.query = t1.token join sound c on c.query = t2.token)"""
QUALITIES = """qualities as (select phrase_id, tp, n - tp as fp, case when n > 0 then tp::double / n else 0.0 end as share from (
  select phrase_id, product(c) as n, (bool_and(hit))::int::bigint as tp from (
   select phrase_id, pos, (select count(*) from sound where query = token) c, exists (select 1 from sound where query = token and word = want) hit from tokens) group by 1))"""
FOUND = f"found as (select p as phrase, idx as doc_id from ps join docs on {FIELDS})"
OCC = f"{DOCS}, occ as (select w as term, idx as doc_id from (select idx, unnest(string_split_regex(concat_ws(' ', title, abstract), '\\s+')) w from docs) where w <> '')"
_LISTS = "select term, doc_id // 65536 as segment, string_agg(doc_id::varchar, ',' order by doc_id) as docs from (select distinct term, doc_id from {t}) group by 1, 2"


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def _recursive(*parts: str) -> str:
    return "with recursive " + ", ".join(parts) + " "


def _term(t: str) -> str:
    return f"select doc_id from post where term = '{t}'"


def _accuracy(t: str) -> str:
    return f"select count(*) as total, coalesce(sum((word = corrected)::bigint), 0)::bigint as correct, coalesce(avg((word = corrected)::int), 0.0) as accuracy from pairs left join (select * from {t} where rank = 1) using (query)"


ORACLE: dict[str, str] = {
    "inverted_index": _with(POST) + "select term, sum(count(*)) over (partition by term)::bigint as df, doc_id // 65536 as segment, string_agg(doc_id::varchar, ',' order by doc_id) as docs from post group by term, segment",
    "index_lines": _with(POST) + "select term || ' -> df: ' || (sum(count(*)) over (partition by term))::bigint || ' | docs: ' || string_agg(doc_id::varchar, ', ' order by doc_id) as line from post group by term, doc_id // 65536",
    "doc_frequency": _with(POST) + "select term, count(*) as df from post group by 1",
    "universe": _with(POST) + "select distinct doc_id from post",
    "bool_term": _with(POST) + _term("en"),
    "bool_and": _with(POST) + f"{_term('en')} intersect {_term('re')}",
    "bool_or": _with(POST) + f"{_term('en')} union {_term('ha')}",
    "bool_not": _with(POST) + f"select doc_id from post except {_term('re')}",
    "bool_stored": _with(POST)
    + f"select doc_id, '( en OR re ) AND NOT ha' as query from (({_term('en')} union {_term('re')}) except {_term('ha')}) union all select doc_id, 'NOT re' from (select doc_id from post except {_term('re')})",
    "bool_nested": _with(POST) + f"({_term('en')} union {_term('re')}) except {_term('ha')}",
    "bool_right_assoc": _with(POST) + f"{_term('en')} intersect ({_term('re')} union {_term('ha')})",
    "bool_not_scope": _with(POST) + f"select doc_id from post except ({_term('en')} intersect {_term('re')})",
    "index_display": _with(POST) + f"select doc_id, '- Index ' || doc_id || ' | Title: ' || coalesce(title, 'N/A') as line from (({_term('en')} union {_term('re')}) except {_term('ha')}) left join docs on idx = doc_id",
    "char_ngrams": _with(DICT, f"wg as {_GRAMS.format(c='word', t='dict')}") + "select word, string_agg(g, ',' order by g) as ngrams from wg group by 1",
    "ngram_index": _with(DICT) + f"select g as ngram, word from {_GRAMS.format(c='word', t='dict')}",
    "ngram_jaccard": _with(ASKED, NGRAMS) + "select query, word, jaccard from jac",
    "ngram_best_match": _with(ASKED, NGRAMS) + "select query, word, jaccard, rank from best",
    "ngram_phrase": _with(PHRASES, NGRAMS) + "select phrase_id, string_agg(word, ' ' order by pos) as corrected from tokens join best on query = token and rank = 1 group by 1",
    "ngram_search": _with(ASKED, NGRAMS, DOCS, "ps as (select distinct word as p from best where rank = 1)") + f"select p as phrase, idx as doc_id from ps join docs on contains({ALL_TEXT}, p)",
    "ngram_accuracy": _with(ASKED, NGRAMS) + _accuracy("best"),
    "edit_candidates": _with(ASKED, EDITS) + "select query, word, distance, rank from edits",
    "edit_best": _with(ASKED, EDITS) + "select query, word from edits where rank = 1",
    "edit_phrase_topk": _with(PHRASES, EDITS, "opts as (select phrase_id, pos, word, distance, rank from tokens join edits on query = token)")
    + """select phrase_id, rank, words, total from (select *, row_number() over (partition by phrase_id order by total, r1, r2, r3) as rank from (
  select a.phrase_id, concat_ws(' ', a.word, b.word, c.word) as words, (a.distance + coalesce(b.distance, 0) + coalesce(c.distance, 0))::bigint as total, a.rank r1, b.rank r2, c.rank r3
  from (select * from opts where pos = 0) a left join (select * from opts where pos = 1) b using (phrase_id) left join (select * from opts where pos = 2) c using (phrase_id))) where rank <= 10""",
    "edit_phrase_topk_long": _with(ASKED, EDITS, "opts as (select number // 5 as phrase_id, number % 5 as pos, word, distance, rank from qs join edits using (query) where rank <= 10)")
    + """select phrase_id, rank, words, total from (select *, row_number() over (partition by phrase_id order by total, r0, r1, r2, r3, r4) as rank from (
  select a.phrase_id, concat_ws(' ', a.word, b.word, c.word, d.word, e.word) as words, (a.distance + coalesce(b.distance, 0) + coalesce(c.distance, 0) + coalesce(d.distance, 0) + coalesce(e.distance, 0))::bigint as total,
   a.rank r0, b.rank r1, c.rank r2, d.rank r3, e.rank r4 from (select * from opts where pos = 0) a left join (select * from opts where pos = 1) b using (phrase_id) left join (select * from opts where pos = 2) c using (phrase_id)
   left join (select * from opts where pos = 3) d using (phrase_id) left join (select * from opts where pos = 4) e using (phrase_id))) where rank <= 10""",
    "edit_phrase_search": _with(SPOKEN, EDITS, DOCS, "ps as (select distinct p from (select string_agg(word, ' ' order by pos) as p from tokens join edits on query = token and rank = 1 group by phrase_id))", FOUND)
    + "select phrase, doc_id from found",
    "edit_topk_search": _with(SPOKEN, EDITS, DOCS, TOPK, "ps as (select distinct words as p from topk)", FOUND) + "select phrase_id, rank, words, total, min(doc_id) as doc_id from topk join found on phrase = words group by all",
    "edit_topk_lines": _with(SPOKEN, EDITS, DOCS, TOPK, "ps as (select distinct words as p from topk)", FOUND)
    + """select phrase_id, '- ' || words || ' (total distance: ' || total || ')' as line from topk union all
 select phrase_id, '- Index ' || idx || ': ' || title || ' | Matched with correction: ' || words || ' (distance: ' || total || ')' from (
  select phrase_id, words, total, min(doc_id) as doc_id from topk join found on phrase = words group by all) join docs on idx = doc_id""",
    "ngram_phrase_search": _with(SPOKEN, NGRAMS, DOCS, "ps as (select distinct p from (select string_agg(word, ' ' order by pos) as p from tokens join best on query = token and rank = 1 group by phrase_id))")
    + f"select p as phrase, idx as doc_id from ps join docs on contains({ALL_TEXT}, p)",
    "hybrid_phrase_search": _recursive(SPOKEN, NGRAMS, HYBRID, CHOICE, DOCS, "ps as (select distinct p from (select string_agg(token, ' ' order by pos) as p from choice group by phrase_id))")
    + "select p as phrase, idx as doc_id from ps join docs on contains(lower(title), p) or contains(lower(abstract), p)",
    "soundex_phrases": _with(PHRASES, SOUND, PRODUCTS) + "select phrase_id, rank, suggestion from products",
    "soundex_phrase_page": _with(PHRASES, SOUND, COMBINED) + "select phrase_id, rank, suggestion from combined where rank between 101 and 150",
    "soundex_phrase_search": _with(SPOKEN, SOUND, DOCS, SOUNDING) + f"select distinct p as phrase, idx as doc_id from told where {FIELDS}",
    "soundex_report": _with(PHRASES, SOUND, PRODUCTS, QUALITIES)
    + """select phrase_id, 'for ' || phrase || ', did you mean: [' || coalesce(list, '') || ']' as line from phrases left join (
  select phrase_id, string_agg(chr(39) || suggestion || chr(39), ', ' order by rank) as list from products group by 1) using (phrase_id)
 union all select phrase_id, printf('%s\t%.0f\t%.0f\t%.6f\t%.6f', phrase, tp::double, fp::double, round(share, 6), round(share, 6)) from qualities join phrases using (phrase_id)
 union all select -1, printf('Precision = %.3f | Accuracy = %.6f | Correct Results = %.0f/%.0f | Accuracy (based on Correct Results) = %.3f',
  round(sum(tp)::double / count(*), 3), round(sum(tp)::double / sum(tp + fp), 6), sum((tp > 0)::int)::double, count(*)::double, round(sum((tp > 0)::int)::double / count(*), 3)) from qualities""",
    "sample_corrections": _with(DICT, "asked as (select unnest(['akoustic', 'abzorption', 'bureacratic', 'aproximatley']) as query)", EDITS)
    + "select query, chr(39) || query || chr(39) || ' -> ' || chr(39) || word || chr(39) as line from edits where rank = 1",
    "edit_phrase": _with(PHRASES, EDITS) + "select phrase_id, string_agg(word, ' ' order by pos) as corrected from tokens join edits on query = token and rank = 1 group by 1",
    "edit_first_doc": _with(ASKED, EDITS, DOCS, "ps as (select distinct word as p from edits)", FOUND) + "select phrase, min(doc_id) as doc_id from found group by 1",
    "phrase_search_all": _with(ASKED, EDITS, DOCS, "ps as (select distinct word as p from edits)", FOUND) + "select phrase, doc_id from found",
    "soundex_codes": f"select distinct w as word, {_code('w')} as code from (select unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) w from documents) where length(w) > 2",
    "soundex_candidates": _with(ASKED, SOUND) + "select query, word from sound",
    "soundex_word_metrics": _with(ASKED, SOUND, QUALITY) + "select query, tp, fp, share as precision, share as accuracy from quality",
    "soundex_summary": _with(ASKED, SOUND, QUALITY) + "select sum(tp)::double / count(*) as precision, sum(tp)::double / sum(tp + fp) as accuracy, sum((tp > 0)::int)::double / count(*) as hit_rate from quality",
    "soundex_metrics": _with(PHRASES, SOUND)
    + """select phrase_id, tp, n - tp as fp, case when n > 0 then tp::double / n else 0.0 end as precision, case when n > 0 then tp::double / n else 0.0 end as accuracy from (
  select phrase_id, product(c) as n, (bool_and(hit))::int::bigint as tp from (
   select phrase_id, pos, (select count(*) from sound where query = token) c, exists (select 1 from sound where query = token and word = want) hit from tokens) group by 1)""",
    "soundex_search": _with(ASKED, SOUND, DOCS, "ps as (select distinct word as p from sound)", FOUND) + "select distinct doc_id from found",
    "soundex_edit": _with(ASKED, EDITS) + f"select query, word, distance::bigint as distance from near where {_code('query')} = {_code('word')}",
    "soundex_ngram": _with(ASKED, NGRAMS, SOUND) + _SOUND_NGRAM,
    "soundex_ngram_all": _with(ASKED, NGRAMS, SOUND) + _SOUND_NGRAM,
    "hybrid_candidates": _recursive(ASKED, NGRAMS, HYBRID) + "select query, word, score, rank from hc",
    "hybrid_phrase": _recursive(PHRASES, NGRAMS, HYBRID, CHOICE) + "select phrase_id, string_agg(token, ' ' order by pos) as corrected from choice group by 1",
    "hybrid_search": _recursive(PHRASES, NGRAMS, HYBRID, CHOICE, DOCS, "ps as (select distinct token as p from choice)")
    + "select p as phrase, idx as doc_id from ps join docs on contains(lower(title), p) or contains(lower(abstract), p)",
    "hybrid_accuracy": _recursive(ASKED, NGRAMS, HYBRID) + _accuracy("hc"),
    "bsbi_index": _with(OCC) + _LISTS.format(t="occ"),
    "bsbi_merge": _with(OCC) + _LISTS.format(t="occ"),
    "bsbi_term_stats": _with(OCC) + "select term, count(distinct doc_id) as df, count(*) as cf from occ group by 1",
    "vocab_words": "select distinct w as word from (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) w from documents) where length(w) > 2",
    "word_docs": _with(DOCS) + f"select distinct w as word, idx as doc_id from (select idx, unnest(regexp_extract_all({ALL_TEXT}, '[\\p{{L}}\\p{{N}}_]+')) w from docs) where length(w) > 2",
    "correction_accuracy": _with(ASKED, EDITS) + _accuracy("edits"),
}

#: N-gram matching against dictionary and document words together: `words` takes the dictionary's place beside the n-grams.
_WORDS = f"{DOCS}, words as (select word from dict union select w from (select unnest(regexp_extract_all({ALL_TEXT}, '[\\p{{L}}\\p{{N}}_]+')) w from docs) where length(w) > 2)"
_UNION = ("char_ngrams", "ngram_index", "ngram_jaccard", "ngram_best_match", "ngram_phrase", "ngram_search", "ngram_accuracy")


def _united(sql: str) -> str:
    sql = sql.replace(f", {DOCS}", "").replace(DICT, f"{DICT}, {_WORDS}", 1)
    return sql.replace(_GRAMS.format(c="word", t="dict"), _GRAMS.format(c="word", t="words")).replace("(select min(word) from dict)", "(select min(word) from words)")


ORACLE |= {f"{name}_union": _united(ORACLE[name]) for name in _UNION}
