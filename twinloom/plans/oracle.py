"""The catalogue's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

OBS = """o as (select *, epoch_us(ts) as at_us, epoch_us(ts) // 1000 as at_ms, case when value < 20 then 'detach' else 'attach' end as action,
  'twin.sol.s1.obs.user.' || user_id || '.type.' || event_type || '.' || event_id || '.' || (case when value < 20 then 'detach' else 'attach' end) as subject,
  case when value < 20 then 0 else 86400000 end::bigint as ttl from events)"""
ASSERTED = f"""{OBS}, a as (select event_id, at_us, at_ms, 's1' as sid, 'user' as st, user_id::varchar as si, 'type' as dt, event_type as di, ttl, at_ms + ttl as exp,
  ((at_ms + ttl + 30000) // 60000) * 60000 as q from o)"""
EDGES = f"""{ASSERTED}, l as (select *, row_number() over (partition by si, di order by at_us desc, event_id desc) as rn from a),
  e as (select sid, st, si, dt, di, ttl, exp from l where rn = 1 and ttl > 0)"""
SETS = f"""{EDGES}, k as (select sid, st, si, dt, max_by(at_ms, (at_us, event_id)) as ts, max(ttl) as most from a group by all),
  s as (select k.sid, k.st, k.si, k.dt, k.ts, count(e.di) as n, coalesce(string_agg(e.di, ',' order by e.di), '') as members, coalesce(string_agg(e.exp::varchar, ',' order by e.di), '') as exps
  from k left join e using (sid, st, si, dt) where most > 0 group by all)"""
LATE = 1_706_600_000_000
PAIRS = """p as (select *, epoch_us(o_orderdate) as tm, case when o_orderpriority <> '5-LOW' then o_orderpriority end as pr from orders),
  d as (select o_orderkey, o_custkey, o_orderstatus as s, o_totalprice as t, pr, lag(o_orderstatus) over w as s0, lag(o_totalprice) over w as t0, lag(pr) over w as pr0,
  lag(o_orderkey) over w as k0 from p window w as (partition by o_custkey order by tm, o_orderkey))"""
PARTS = """j as (select l_suppkey, year(l_shipdate) as y, p_brand from lineitem join part on l_partkey = p_partkey),
  g as (select l_suppkey, y, p_brand, count(*) as n from j group by all),
  s as (select l_suppkey, y, list_sort(list(p_brand)) as b, list(p_brand || '=' || n order by p_brand) as m from g group by all),
  z as (select *, lag(b) over w as a, lag(m) over w as am from s window w as (partition by l_suppkey order by y))"""
DELTAS = f"""{OBS}, d as (select user_id, event_id, at_us, case event_type when 'view' then 0 when 'error' then 2 else 1 end as op, case when event_type not in ('view', 'error') then value end as x,
  case when event_type in ('click', 'view') then event_id end as y from o)"""
HEADERS = f"""{OBS}, h as (select event_id, user_id, at_us, event_type, case event_id % 11 when 1 then 'zero' when 2 then 'other' else user_id::varchar end as eid, case when event_id % 11 = 3 then 'z' else 'c' end as cid,
  case when event_id % 11 = 5 then -1 else event_id end as seq, case when event_id % 11 = 4 then at_us - 40 * 24 * 3600000000 else at_us end as eff, event_id % 11 = 6 as closed from o),
  p as (select *, lag(eid) over w as eid0, lag(cid) over w as cid0, lag(seq) over w as seq0, lag(eff) over w as eff0, lag(closed) over w as closed0, lag(event_type) over w as type0, lag(event_id) over w as id0
  from h window w as (partition by user_id order by at_us, event_id))"""
ARRIVALS = f"""{OBS}, n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as sequence from o),
  r as (select user_id, sequence, case when event_id % 5 = 0 then sequence + 4 else sequence end as arrival, 0 as copy, event_id from n
  union all select user_id, sequence, sequence + 2, 1, event_id from n where event_id % 7 = 0)"""


def _blob(value: str) -> str:
    return f"from_hex(lpad(printf('%x', {value}), 16, '0'))"


ORACLE_SQL: dict[str, str] = {
    "subject_tokens": f"""with {OBS} select event_id, len(string_split(subject, '.'))::bigint as n, split_part(subject, '.', 6) as t5, split_part(subject, '.', 10) as t9, null::varchar as t10, 7::bigint as n_bounded,
      array_to_string(string_split(subject, '.')[7:], '.') as rest from o""",
    "subject_match": f"""with {OBS}, f as (select event_id, regexp_full_match(subject, 'twin\\.sol\\.[^.]+\\.obs\\.user\\.[^.]+\\.type\\.click\\..+') as one, starts_with(subject, 'twin.sol.s1.') as tail,
      regexp_full_match(subject, 'twin\\.sol\\.[^.]+') as short, subject = 'twin.sol.s1.obs.user.1.type.view.1.attach' as exact from o) select * from f""",
    "pushed_match": "select c_custkey, c_name from customer where c_name = 'Customer#000000001'",
    "assertions": f"""with {ASSERTED} select event_id, sid, st, si, dt, di, ttl, exp, 'twin.sol.s1.r.kv.user.' || si || '.type.set' as kv_key, 'twin.sol.s1.r.assert.user.type' as assert_subject from a""",
    "assertions_quantised": f"with {ASSERTED} select event_id, si, di, ttl, q as exp from a",
    "assertion_errors": f"""with {OBS} select event_id, case when event_id % 3 <> 0 then user_id::varchar end as si, case when event_id % 3 <> 0 then event_type end as di,
      case when event_id % 3 = 0 then 'too few tokens for twin.sol.>' end as error from o""",
    "assertion_dedup": f"""with {ASSERTED}, r as (select *, row_number() over (partition by si, di, ttl, q order by at_us, event_id) as rn from a)
      select sha1(concat_ws(chr(31), sid, st, si, dt, di, ttl::varchar, q::varchar)) as msg_id, event_id, si, di, ttl, q as exp from r where rn = 1""",
    "relation_sets": f"with {SETS} select * from s",
    "relation_sets_incremental": f"with {SETS} select * from s",
    "relation_sets_phantom": f"""with {ASSERTED}, b as (select * replace (si || '-' || event_id % 7 as si) from a),
      r as (select *, row_number() over (partition by si, di order by at_us desc, event_id desc) as last, row_number() over (partition by si order by at_us, event_id) as first from b),
      k as (select si, max_by(at_ms, (at_us, event_id)) as ts from b group by si),
      e as (select * from r where last = 1 and (ttl > 0 or first = 1))
      select 's1' as sid, 'user' as st, k.si, 'type' as dt, ts, count(e.di) as n, coalesce(string_agg(e.di, ',' order by e.di), '') as members, coalesce(string_agg(e.exp::varchar, ',' order by e.di), '') as exps from k left join e using (si) group by all""",
    "relation_live_asof": f"with {EDGES} select si, di, exp from e where exp > {LATE}",
    "relation_expiries": f"with {EDGES} select si, di, 0::bigint as ttl, exp from e where exp <= {LATE}",
    "retractions_of_unknown": f"""with {ASSERTED}, b as (select * replace (si || '-' || event_id % 23 as si) from a)
      select event_id, si, di from b where ttl <= 0 and si not in (select si from b where ttl > 0)""",
    "relation_reverse": f"with {EDGES} select di, count(distinct si) as n, string_agg(distinct si, ',' order by si) as sources from e group by di",
    "constraint_one_to_one": """with e as (select o_custkey::varchar as si, o_orderpriority as di, max(o_orderkey) as exp from orders group by all),
      r as (select *, row_number() over (partition by si order by exp desc, si, di) as f, row_number() over (partition by di order by exp desc, si, di) as b from e)
      select si, di, exp, case when f = 1 and b = 1 then 'kept' else 'retracted' end as verdict from r""",
    "relation_set_json": f"with {SETS} select * from s",
    "route_token_only": f"with {OBS} select event_id, 'out.' || event_type || '.user-' || user_id || '.' || action as egress from o",
    "route_fanout": f"with {EDGES} select event_id, 'out.user.' || user_id || '.to.' || coalesce(di, '') as egress from o left join e on e.si = o.user_id::varchar",
    "route_live": f"with {EDGES}, v as (select * from e where exp > {LATE}) select event_id, 'out.' || user_id || '.' || coalesce(di, '') as egress from o left join v on v.si = o.user_id::varchar",
    "route_cross_product": f"""with {EDGES}, n as (select c_custkey::varchar as c, s_suppkey::varchar as s from customer join supplier on c_nationkey = s_nationkey)
      select event_id, 'x.' || coalesce(di, '') || '.y.' || coalesce(s, '') || '.z.' || user_id as egress from o left join e on e.si = o.user_id::varchar left join n on n.c = o.user_id::varchar""",
    "route_elide": f"with {EDGES}, v as (select * from e where di in ('click', 'view') and si not like '1%') select event_id, 'out.' || coalesce(di, '') || '.' || user_id as egress from o left join v on v.si = o.user_id::varchar",
    "route_blank": f"with {EDGES}, v as (select * from e where di in ('click', 'view') and si not like '1%') select event_id, 'out.' || coalesce(di, '_') || '.' || user_id as egress from o left join v on v.si = o.user_id::varchar",
    "route_out_of_range": f"with {OBS} select event_id, null::varchar as egress, 'token out of range' as route_error from o",
    "route_hierarchy": """select 'geo.' || n_nationkey || '.' || coalesce(c_custkey::varchar, '') || '.' || coalesce(o_orderkey::varchar, '') as egress from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey
      where c_custkey is not null""",
    "route_many": f"""with {EDGES} select event_id, 'a' as route_id, 'a.' || user_id || '.' || coalesce(di, '') as egress from o left join e on e.si = o.user_id::varchar where event_type = 'click'
      union all select event_id, 'b', 'b.' || user_id from o where event_type = 'view'""",
    "payload_pass_through": f"""with {EDGES} select event_id, 'p.' || user_id || '.' || coalesce(di, '') as egress, props as payload, value, at_us from o left join e on e.si = o.user_id::varchar""",
    "latest_per_key": "select o_custkey, o_orderkey, o_orderstatus, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1",
    "latest_with_deletes": f"with {OBS} select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by at_us desc, event_id desc) as rn from o) where rn = 1 and event_type <> 'error'",
    "view_containment": f"""with {EDGES} select si, di as member, r_name from e join region on (['click', 'view', 'error', 'signup', 'purchase'])[r_regionkey + 1] = di""",
    "view_superset": f"""with {EDGES}, s as (select si as k, list(di) as m from e group by si) select x.k as a_key, y.k as b_key from s x join s y on list_has_all(x.m, y.m)""",
    "synthesise_mapping": f"with {SETS} select si, 'user=' || si || ';types=' || members || ';n=' || n as payload from s",
    "entity_id_sha256_scalar": f"""select c_custkey, sha256({_blob('strlen(c_name)')} || encode(c_name)) as by_name,
      sha256({_blob('(c_custkey - 500)')}) as by_key from customer""",
    "entity_id_sha256_struct": f"""select l_orderkey, l_linenumber, l_returnflag, sha256({_blob('strlen(l_returnflag)')} || encode(l_returnflag) || from_hex(lpad(printf('%x', l_linenumber), 8, '0')) || {_blob('l_orderkey')}) as id from lineitem""",
    "diff_atomic": f"""with {PAIRS} select o_orderkey, o_custkey as key, (s is distinct from s0)::tinyint as status_op, case when s is distinct from s0 then s end as status_value, (t is distinct from t0)::tinyint as price_op,
      case when t is distinct from t0 then t end as price_value, (pr is distinct from pr0)::tinyint as priority_op, case when pr is distinct from pr0 then pr end as priority_value from d where k0 is not null""",
    "apply_roundtrip": f"with {PAIRS} select o_orderkey, o_custkey as key, s as status, t as price, pr as priority, k0 as hidden from d where k0 is not null",
    "diff_nested_struct": """with c as (select c_custkey, c_nationkey, c_mktsegment as seg, case when c_custkey % 3 = 0 then '' else c_mktsegment end as hs, case when c_custkey % 3 = 0 then 0 else c_nationkey end as hn from customer),
      d as (select *, lag(seg) over w as seg0, lag(hs) over w as hs0, lag(hn) over w as hn0, lag(c_custkey) over w as k0 from c window w as (partition by c_nationkey order by c_custkey)),
      e as (select *, case when hs = hs0 and hn = hn0 then 0 when hs = '' and hn = 0 then 2 else 1 end as op from d where k0 is not null)
      select c_custkey, (seg <> seg0)::tinyint as segment_op, case when seg <> seg0 then seg end as segment, 0::tinyint as nation_op, op::tinyint as home_op, case when op = 1 and hs <> hs0 then hs end as home_segment, hs as result_segment from e""",
    "diff_set": f"""with {PARTS} select l_suppkey, y, array_to_string(list_filter(b, lambda x: not list_contains(a, x)), ',') as added, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') as removed,
      array_to_string(b, ',') as applied from z where a is not null""",
    "diff_map": f"""with {PARTS} select l_suppkey, y, array_to_string(list_filter(a, lambda x: not list_contains(b, x)), ',') as removed, array_to_string(list_filter(m, lambda x: not list_contains(am, x)), ',') as updated,
      array_to_string(m, ',') as applied from z where a is not null""",
    "coalesce_deltas": f"""with {DELTAS} select user_id, max_by(op, (at_us, event_id)) filter (where op <> 0)::tinyint as x_op, arg_max_null(x, (at_us, event_id)) filter (where op <> 0) as x_value,
      max_by(y, (at_us, event_id)) filter (where y is not null) as y_value, max_by(event_id, (at_us, event_id)) as last_event from d group by user_id""",
    "coalesce_partition": f"""with {DELTAS} select user_id, coalesce(max_by(op, (at_us, event_id)) filter (where op <> 0), 0)::tinyint as x_op, arg_max_null(x, (at_us, event_id)) filter (where op <> 0) as x_value,
      max_by(y, (at_us, event_id)) filter (where y is not null) as y_value from d group by user_id""",
    "coalesce_nested": f"""with {OBS}, u as (select user_id, max_by(event_id, (at_us, event_id)) as seen, max((at_us, event_id)) filter (where event_type = 'error') as err, max((at_us, event_id)) filter (where event_type = 'signup') as sig from o group by user_id),
      t as (select user_id, event_type, max((at_us, event_id)) as at, max_by(event_id, (at_us, event_id)) as id from o group by all)
      select u.user_id, coalesce(string_agg(t.event_type, ',' order by t.event_type) filter (where t.event_type not in ('error') and (t.event_type not in ('click', 'view') or err is null or t.at > err)), '') as kinds,
      coalesce(string_agg(t.event_type || '=' || t.id, ',' order by t.event_type) filter (where t.event_type <> 'view' or sig is null or t.at > sig), '') as last, u.seen from u join t using (user_id) group by u.user_id, u.seen""",
    "clearable_truth_table": """select * from (values ('0:zero-zero', 0, 0, 0, true), ('1:zero-x', 1, 1, 1, true), ('2:x-x', 0, 0, 0, true), ('3:x-y', 1, 1, 1, true), ('4:x-zero', 2, 2, 2, true)) t(c, place, tags, labels, round_trip)""",
    "header_after_apply": f"""with {HEADERS}, c as (select *, case when eid0 = 'zero' then 'snapshot entity id is zero' when eid = 'zero' then 'delta entity id is zero' when eid0 <> eid then 'entity id mismatch' when cid0 <> cid then 'chain id mismatch'
      when seq <= seq0 then 'sequence not increasing' when eff < eff0 then 'effective time before the snapshot''s' when closed0 then 'chain closed' end as error from p where id0 is not null)
      select event_id, error, case when error is null then seq end as sequence, case when error is null then eff end as effective_us, case when error is null then type0 || '>' || event_type end as lineage from c""",
    "header_for_diff": f"""with {HEADERS}, c as (select *, case when eid0 = 'zero' then 'first entity id is zero' when eid = 'zero' then 'second entity id is zero' when eid0 <> eid then 'entity id mismatch' when cid0 <> cid then 'chain id mismatch'
      when seq < seq0 then 'sequence decreasing' when eff < eff0 then 'effective time before the first''s' end as error from p where id0 is not null)
      select event_id, error, case when error is null then seq end as sequence from c""",
    "chain_validation": f"""with {OBS}, c as (select user_id as chain_id, event_id // 2 as sequence, max(case when value < 10 then 0 else at_us end) as e from o group by all),
      v as (select chain_id, case when e < lag(e) over (partition by chain_id order by sequence) then 'effective time before the predecessor''s' end as error from c) select chain_id, error, count(*) as n from v group by all""",
    "chain_gaps": f"""with {OBS}, g as (select user_id as chain_id, event_id as s, lead(event_id) over (partition by user_id order by event_id) as n from o) select chain_id, s + 1 as gap_start, n - 1 as gap_end from g where n > s + 1""",
    "chain_quality": f"""with {OBS}, g as (select user_id as chain_id, event_id as s, lead(event_id) over (partition by user_id order by event_id) as n from o)
      select chain_id, count(*) as n, string_agg((s + 1)::varchar || '-' || (n - 1)::varchar, ',' order by s) as gaps from g where n > s + 1 group by chain_id""",
    "taint_metrics": f"""with {OBS}, g as (select user_id, event_id, at_us, event_id - lag(event_id) over (partition by user_id order by event_id) - 1 as d from o)
      select user_id as chain_id, max(event_id) as frontier, coalesce(sum(d) filter (where d > 0), 0)::bigint as taint_size, max(at_us) - min(at_us) filter (where d > 0) as taint_age,
      round(coalesce(sum(d) filter (where d > 0), 0) / greatest(max(event_id) - min(event_id), 1), 9) as taint_density from g group by user_id""",
    "receive_protocol": f"""with {ARRIVALS}, f as (select *, coalesce(max(sequence) over (partition by user_id order by arrival, copy, sequence rows between unbounded preceding and 1 preceding), 0) as frontier from r),
      v as (select *, coalesce(max((sequence > frontier)::int) over (partition by user_id, sequence order by arrival, copy rows between unbounded preceding and 1 preceding), 0) as seen from f)
      select user_id, sequence, arrival, copy, frontier, case when sequence = frontier + 1 then 'applied' when sequence > frontier then 'gap' when seen = 1 then 'duplicate' else 'late' end as verdict from v""",
    "receive_with_anchors": f"""with {ARRIVALS}, a as (select *, event_id % 31 = 0 and copy = 0 as anchor, event_id % 37 = 0 as closes from r),
      p as (select *, sum(anchor::int) over w as part, row_number() over w as rn from a window w as (partition by user_id order by arrival, copy, sequence rows unbounded preceding)),
      q as (select *, max(sequence) over (partition by user_id, part order by rn rows unbounded preceding) as after, coalesce(max(case when anchor then sequence end) over (partition by user_id, part), 0) as floor from p),
      f as (select *, coalesce(lag(after) over (partition by user_id order by rn), 0) as fr from q),
      e as (select *, min(case when (anchor or sequence > fr) and closes then rn end) over (partition by user_id) as ended from f),
      g as (select *, max(case when rn = ended then sequence end) over (partition by user_id) as last_one, coalesce(max((anchor or sequence > fr)::int) over (partition by user_id, part, sequence order by rn rows between unbounded preceding and 1 preceding), 0) as seen from e)
      select user_id, sequence, arrival, copy, case when rn > ended then last_one else fr end as frontier, case when rn > ended then 'rejected' when anchor then 'anchor' when sequence > fr and closes then 'terminator' when sequence = fr + 1 then 'applied'
      when sequence > fr then 'gap' when seen = 1 or sequence <= floor then 'duplicate' else 'late' end as verdict from g""",
    "materialise_versions": f"""with {DELTAS} select user_id, event_id, case when last_value(case when op <> 0 then op end ignore nulls) over w = 1 then last_value(x ignore nulls) over w end as x, last_value(y ignore nulls) over w as y
      from d window w as (partition by user_id order by at_us, event_id rows between unbounded preceding and current row)""",
    "origin_carry_forward": f"with {OBS} select event_id, last_value(case when event_id % 4 = 0 then props end ignore nulls) over (partition by user_id order by at_us, event_id rows between unbounded preceding and current row) as origin from o",
    "provenance_concat": f"with {OBS} select user_id, string_agg(event_type, '>' order by at_us, event_id) as lineage from o group by user_id",
    "silence_as_close": f"""with {OBS}, n as (select *, case when at_us - lag(at_us) over (partition by user_id order by at_us, event_id) >= 10800000000 then 1 else 0 end as new from o),
      s as (select *, sum(new) over (partition by user_id order by at_us, event_id rows unbounded preceding) as session from n)
      select user_id, session::bigint as session, min(at_us) as opened, max(at_us) as last_seen, count(*) as n, max(at_us) + 10800000000 as closed_at from s group by user_id, session""",
    "cadence_snapshots": f"""with {OBS}, c as (select user_id as chain_id, event_id as sequence, at_us // 86400000000 as slot, lag(at_us // 86400000000) over w as before, row_number() over w as rn from o window w as (partition by user_id order by event_id))
      select chain_id, sequence from c where before is distinct from slot or (rn - 1) % 10 = 0""",
    "chain_succession": """with c as (select o_orderkey as chain_id, lead(o_orderkey) over w as nxt, case when o_orderkey % 4 <> 0 then lag(o_orderkey) over w end as prev from orders window w as (partition by o_custkey order by o_orderkey))
      select c.chain_id, c.nxt as next_chain_id, d.prev is not distinct from c.chain_id as mutual from c left join c d on d.chain_id = c.nxt where c.nxt is not null""",
    "chain_disposal": f"with {OBS} select user_id as chain_id, count(*) as n from o where user_id not in (select user_id from o where event_type = 'signup' and value < 4) group by user_id",
    "downsample_tumbling": f"with {OBS} select event_type, (at_us // 86400000000) * 86400000000 as slot, count(*) as n, round(sum(value), 4) as total, max(value) as most from o group by all",
    "downsample_sliding": f"""with {OBS}, x as (select *, unnest([0, 1, 2, 3]) as i from o) select event_type, (at_us // 21600000000 - i) * 21600000000 as slot, count(*) as n, min(value) as least from x group by all""",
    "downsample_squash": f"""with {OBS}, r as (select *, (at_us // 86400000000) * 86400000000 as slot, row_number() over (partition by user_id, at_us // 86400000000 order by at_us desc, event_id desc) as rn from o) select user_id, slot, event_id, value from r where rn = 1""",
    "downsample_drop": f"with {OBS} select user_id, event_id from (select *, row_number() over (partition by user_id order by at_us, event_id) as rn from o) where (rn - 1) % 5 = 0",
    "downsample_rollup": """select r_name, n_name, c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance, (3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment))::int as level
      from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name, c_mktsegment)""",
    "compare_predecessor": f"""with {OBS} select event_id, lag(event_type) over w as event_type_before, lag(event_type) over w <> event_type as event_type_changed from o window w as (partition by user_id order by at_us, event_id)""",
    "line_protocol": f"""with {OBS} select event_id, 'obs\\ events,kind=a\\=b\\,\\ ' || event_type || ',user\\ id=' || user_id || ' id=' || event_id || 'i,low=' || (value < 20)::varchar || ',props="' || replace(props, '"', '\\"') || '" ' || (at_us * 1000)::varchar as line from o""",
    "ip_base64url": f"""with {OBS}, q as (select event_id, (event_id * 7 + 10) % 256 as a, (event_id * 13 + 200) % 256 as b, (event_id * 251 + 3) % 256 as c, event_id % 256 as d from o)
      select event_id, concat_ws('.', a, b, c, d) as ip, translate(to_base64(from_hex(printf('%02x%02x%02x%02x', a, b, c, d))), '+/', '-_') as token, concat_ws('.', a, b, c, d) as back from q""",
    "zero_defaults": """select c_custkey, o_orderkey, coalesce(o_totalprice, 0) as o_totalprice, coalesce(o_orderstatus, '') as o_orderstatus, 0 as absent from customer left join orders on c_custkey = o_custkey""",
    "schema_projection": "select c_custkey, 'outer' as c_name, c_mktsegment from customer",
    "bad_values": f"""with {OBS} select event_id, case when event_id % 9 = 0 then 0 else event_id end as a, case when event_id % 10 = 0 then 0 else user_id end::int as b,
      concat_ws(',', case when event_id % 9 = 0 then 'a' end, case when event_id % 10 = 0 then 'b' end) as errors from o""",
    "simulation_epochs": "select epoch, 1704067200000 + epoch * 60000 as start_ms, 1704067200000 + (epoch + 1) * 60000 as end_ms, r_name from range(60) t(epoch) join region on epoch % 5 = r_regionkey",
    "semi_anti": """select c_custkey, 'has' as kind from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)
      union all select c_custkey, 'has not' from customer where c_acctbal < 0 and c_custkey not in (select o_custkey from orders where o_totalprice > 400000)""",
    "asof_state": f"""with {OBS} select event_id, last_value(case when event_type <> 'error' then event_id end ignore nulls) over w as state_event, last_value(case when event_type <> 'error' then event_type end ignore nulls) over w as state
      from o window w as (partition by user_id order by at_us, event_id rows between unbounded preceding and current row) qualify event_type = 'error'""",
    "interval_join": f"with {OBS} select c.event_id as click, p.event_id as purchase from o c join o p on c.user_id = p.user_id and p.at_us between c.at_us and c.at_us + 3600000000 where c.event_type = 'click' and p.event_type = 'purchase'",
    "set_operations": """with a as (select user_id from events where event_type = 'click'), b as (select user_id from events where event_type = 'error')
      select user_id, 'intersect' as op from (select * from a intersect select * from b) union all select user_id, 'except all' from (select * from a except all select * from b) union all select user_id, 'except' from (select * from a except select * from b)""",
    "full_outer": """select coalesce(c.k, s.k) as k, customers, suppliers from (select c_nationkey as k, count(*) as customers from customer group by 1) c
      full join (select s_nationkey as k, count(*) as suppliers from supplier group by 1) s on c.k = s.k""",
    "cube_counts": "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)",
    "top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "ranking": "select * from (select o_orderkey, row_number() over w as rn, dense_rank() over w as dr from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)) where rn <= 3",
    "session_windows": f"""with {OBS}, n as (select *, case when at_us - lag(at_us) over (partition by user_id order by at_us, event_id) >= 10800000000 then 1 else 0 end as new from o),
      s as (select *, sum(new) over (partition by user_id order by at_us, event_id rows unbounded preceding) as session from n) select user_id, min(at_us) as opened, count(*) as n from s group by user_id, session""",
}
