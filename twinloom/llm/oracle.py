"""Queries of this subpackage as DuckDB SQL, where SQL can say the same."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": r"""with i0 as (select item_id, text, regexp_extract(rtrim(text, chr(32) || chr(9) || chr(10) || chr(13)), '(?s)^(.*[.!?]\s+)', 1) as q0, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as ws from benchmark where text is not null),
  i1 as (select item_id, case when q0 <> '' then q0 else array_to_string(ws[:len(ws) - len(ws) // 3], ' ') end as q, case when q0 <> '' then substr(text, length(q0) + 1) else array_to_string(ws[len(ws) - len(ws) // 3 + 1:], ' ') end as s from i0),
  i as (select item_id, regexp_extract_all(translate(q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as q, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as s, list_concat(regexp_extract_all(translate(q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from i1),
  it as (select item_id, len(w) as n, unnest(w) as t from i),
  tf as (select item_id, n, t, count(*) as tf from it group by all),
  df as (select t, count(*) as df from tf group by t),
  m as (select count(*) as items, avg(len(w)) as mean from i),
  imp as (select item_id, t, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / greatest(1, mean))) as x from tf join df using (t), m),
  sc as (select item_id, 0.6 * sum(x) * least(1.0, 48.0 / any_value(n)) as scale from imp join (select distinct item_id, n from tf) using (item_id) group by item_id),
  d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents where text is not null),
  p as (select doc_id, w, lo, least(lo + 64, len(w)) as hi from (select doc_id, w, unnest(range(0, greatest(1, len(w) - 48), 16)) as lo from d where len(w) > 0)),
  pt as (select doc_id, lo, hi, unnest(list_distinct(w[lo + 1:hi])) as t from p),
  r as (select doc_id, item_id, lo, hi, sum(x) as score from pt join imp using (t) group by all),
  e as (select r.*, lag(hi) over (partition by doc_id, item_id order by lo) as before from r join sc using (item_id) where score >= scale * (1 - 1e-8)),
  v as (select *, sum(case when lo < before then 0 else 1 end) over (partition by doc_id, item_id order by lo rows unbounded preceding) as run from e),
  f as (select doc_id, item_id, run, max(score) as bm25, min(lo) as a, max(hi) as b from v group by all),
  g as (select doc_id, item_id, run, bm25, i.q, i.s, i.w as iw, least(5, len(i.w)) as k, d.w[greatest(0, a - len(i.w)) + 1:b + len(i.w)] as near from f join d using (doc_id) join i using (item_id)),
  h as (select *, list_distinct(list_transform(range(1, len(iw) - k + 2), lambda j: array_to_string(iw[j:j + k - 1], ' '))) as want, list_transform(range(1, len(near) - k + 2), lambda j: array_to_string(near[j:j + k - 1], ' ')) as have from g where len(near) >= k),
  o as (select doc_id, item_id, run, round(bm25, 3) as bm25, len(list_filter(want, lambda v: list_contains(have, v))) / len(want) as contained,
    case when len(q) = 0 then 1.0 else len(list_filter(q, lambda v: list_contains(near, v))) / len(q) end as question_overlap, case when len(s) = 0 then 1.0 else len(list_filter(s, lambda v: list_contains(near, v))) / len(s) end as answer_overlap from h)
select doc_id, item_id, bm25, contained, question_overlap, answer_overlap from o where contained >= 0.8 and question_overlap >= 0.8 and answer_overlap >= 0.8
qualify row_number() over (partition by doc_id, item_id order by contained desc, run) = 1""",
    "op10_lines": r"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
  l as (select doc_id, i as line_no, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
  w as (select doc_id, line_no, line, list_sort(list_distinct(list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> ''))) as s from l),
  u as (select s, min((doc_id, line_no)) as f, row_number() over () as id from w where len(s) > 0 group by s),
  t as (select id, len(s) as n, unnest(s) as word from u),
  c as (select word, count(*) as df from t group by word),
  r as (select id, n, word, row_number() over (partition by id order by df, word) as place from t join c using (word)),
  p as (select id, n, word from r where place <= n - ceil(0.8 * n) + 1),
  q as (select distinct a.id as x, b.id as y from p a join p b on a.word = b.word and a.id < b.id and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
  j as (select q.x, q.y, len(list_intersect(a.s, b.s)) as k, len(a.s) as na, len(b.s) as nb, a.f as fa, b.f as fb from q join u a on a.id = q.x join u b on b.id = q.y),
  g as (select case when fa > fb then fa else fb end as f from j where k >= 0.8 * (na + nb - k)),
  v as (select w.*, len(w.s) > 0 and ((w.doc_id, w.line_no) <> u.f or (w.doc_id, w.line_no) in (select f from g)) as gone from w left join u on u.s = w.s)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_gone, length(coalesce(string_agg(line, chr(10) order by line_no) filter (where not gone), ''))::bigint as n_chars,
  sha256(coalesce(string_agg(line, chr(10) order by line_no) filter (where not gone), '')) as text_sha256 from v group by doc_id""",
}
