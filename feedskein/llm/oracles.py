"""The same results in DuckDB SQL, where SQL can express them in reasonable time."""

WORDS_2 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D ]+'), lambda w: w <> '')"
WORDS_8 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

# texts as hex digits, cut into overlapping chunks first: a place in a string is found by walking to it
SUFFIX_DEDUP = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as digits, octet_length(encode(coalesce(text, '')))::bigint as n_bytes from documents),
chunks as (
  select doc_id, begin, n_bytes, substr(digits, 2 * begin + 1, 2 * 305) as digits
  from (select doc_id, n_bytes, digits, unnest(range(0, greatest(n_bytes - 49, 0), 256)) as begin from docs)),
starts as (
  select doc_id, begin + i as place, substr(digits, 2 * i + 1, 100) as gram
  from (select doc_id, begin, digits, unnest(range(0, least(256, n_bytes - 49 - begin))) as i from chunks)),
lowest as (select gram, min(doc_id) as least_id from starts group by gram having min(doc_id) < max(doc_id)),
hits as (select doc_id, place from starts join lowest using (gram) where least_id < doc_id),
marked as (select doc_id, place, case when place <= lag(place) over w + 50 then 0 else 1 end as new from hits window w as (partition by doc_id order by place)),
numbered as (select doc_id, place, sum(new) over (partition by doc_id order by place) as span from marked),
spans as (select doc_id, min(place) as s, max(place) + 50 as e from numbered group by doc_id, span),
gaps as (
  select doc_id, coalesce(lag(e) over w, 0) as b, s as e from spans window w as (partition by doc_id order by s)
  union all
  select doc_id, coalesce(max(e), 0), any_value(n_bytes) from docs left join spans using (doc_id) group by doc_id),
kept as (
  select doc_id, string_agg(substr(digits, 2 * b + 1, 2 * (gaps.e - b)), '' order by b) as digits
  from gaps join docs using (doc_id) group by doc_id),
removed as (select doc_id, sum(e - s)::bigint as n_removed, count(*)::bigint as n_spans from spans group by doc_id)
select doc_id, n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(kept.digits)) as kept_sha256
from docs join kept using (doc_id) left join removed using (doc_id)
"""

NEAR_DEDUP = f"""
with recursive worded as (select doc_id, {WORDS_2} as ws from documents),
grams as (
  select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as grams
  from worded),
sizes as (select doc_id, len(grams)::bigint as n from grams),
posted as (select doc_id, unnest(grams) as gram from grams),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from posted a join posted b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * common >= 75 * (x.n + y.n - common)),
both_ways as (select a, b from links union all select b, a from links),
reached(start, node) as (
  select doc_id, doc_id from documents
  union
  select start, b from reached join both_ways on a = node),
least as (select start, min(node) as component_id from reached group by 1)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept
from sizes join least on start = doc_id
"""

_ESCAPED = "replace(replace(replace(replace(replace(coalesce({0}, ''), '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"

CHAT = f"""
with turns as (
  select conv_id, turn, role, text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
parts as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    length('<s>[INST] ' || {_ESCAPED.format('role')} || ' [/INST] ' || {_ESCAPED.format('text')} || '</s>') as size
  from turns),
whole as (
  select conv_id, count(*)::bigint as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as lines,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
    sum(size)::bigint as formatted_chars
  from parts group by conv_id)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from whole
"""

DECONTAMINATE = f"""
with items as (select item_id, {WORDS_8} as ws from benchmark),
item_grams as (
  select distinct item_id, least(len(ws), 10) as size,
    unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) as gram
  from items where len(ws) > 0),
docs as (select doc_id, {WORDS_8} as ws from documents),
windows as (
  select doc_id, size, unnest(range(1, len(ws) - size + 2)) as pos,
    unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) as gram
  from docs, (select distinct size from item_grams) where len(ws) >= size),
hits as (select doc_id, pos, w.size as size, item_id from windows w join item_grams g on w.size = g.size and w.gram = g.gram),
hit_words as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as place from hits) group by 1),
listed as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from hits) group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hit_words using (doc_id) left join listed using (doc_id)
"""

NEAREST = """
with vectors as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_dot_product(c.v, q.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(q.v, q.v))) as score
  from vectors q join vectors c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

HARD_NEGATIVES = """
with vectors as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.row as anchor, a.vec_id as anchor_id, a.label = r.label as same, r.row as row, r.vec_id as vec_id,
    list_dot_product(a.v, r.v)::bigint as score
  from vectors a join vectors r on a.vec_id % 50 = 0 and a.row <> r.row and len(a.v) = len(r.v)),
positives as (
  select anchor, anchor_id, row as positive, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor order by score desc, vec_id nulls last, row) <= 5),
ranked as (
  select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by anchor, positive order by score desc, vec_id nulls last, s.row)::integer as rank
  from positives p join scored s using (anchor)
  where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""

SQL = {
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op2_minhash_near_dedup": NEAR_DEDUP,
    "op7_chat_format": CHAT,
    "op8_decontaminate": DECONTAMINATE,
    "op9_ann": NEAREST,
    "op12_hard_negatives": HARD_NEGATIVES,
}
