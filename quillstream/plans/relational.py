"""Scans, filters, joins, aggregates, windows, sorts and set operations, as SQL that both engines read.

The test tables stand for the model's: documents with a derived publication time, `labels` for the three-valued relevance,
customers for events, orders for the links between them, `events` for the ledger and the crawl log, conversations for chats.
"""

from quillstream.plans.registry import sql_query as q

DOCS = "(select doc_id, text, lang, source, n_chars, case when doc_id % 17 = 0 then null else @at('2024-01-01 00:00:00') + @hours(doc_id % 720) end as published, @at('2024-01-01 00:00:00') + @hours(doc_id % 500) as fetched from {documents}) d"
LEDGER = "(select event_id, ts, user_id, event_type, cast(value as decimal(18,4)) as cost from {events}) u"

# --- scans and predicates
q("P1_content_class", "select doc_id, source from {documents} where source in ('src0', 'src1')")
q("P2_relevant", "select l.doc_id from {labels} l where l.quality = 1")
q("P3_pending_relevance", "select d.doc_id from {documents} d left join {labels} l on d.doc_id = l.doc_id where l.doc_id is null and d.text <> ''")
q("P4_pending_extraction", "select d.doc_id from {documents} d where not exists (select 1 from {labels} l where l.doc_id = d.doc_id and l.toxic = 0)")
q("P5_canonical", "select doc_id from (select doc_id, min(doc_id) over (partition by text) as first_id from {documents}) x where doc_id = first_id")
q("P6_event_states", "select o_orderkey, case when o_orderstatus = 'O' then 'tracking' when o_orderstatus = 'F' then 'public' else 'awaiting_review' end as state from {orders}")
q("P7_coarse_due", "select o_orderkey from {orders} where o_orderstatus in ('O', 'F') and (o_orderdate is null or o_orderdate <= @at('1997-12-31 00:00:00'))")
LAST = "(select user_id, max(ts) as last_ts, count(*) as n from {events} group by user_id) x"
q("P8_due_rule", f"select user_id, status, days, days >= wait as due from (select user_id, case user_id % 3 when 0 then 'active' when 1 then 'dormant' else 'closed' end as status, @days(last_ts, @at('2024-02-01 00:00:00')) as days, case user_id % 3 when 0 then 1 when 1 then 7 else 90 end as wait from {LAST}) y")
q("P9_becomes_dormant", f"select user_id, @days(last_ts, @at('2024-02-20 00:00:00')) >= 30 as dormant from {LAST}")
q("P10_pollable", f"select user_id, n % 7 as failures, (case when n % 7 >= 5 then 6 else 1 end) * 60 as wait_minutes, last_ts + @hours(case when n % 7 >= 5 then 6 else 1 end) <= @at('2024-01-31 20:00:00') as due from {LAST}")
q("P11_service_window", "select event_id, case when user_id % 24 <= (user_id + 8) % 24 then hour(ts) >= user_id % 24 and hour(ts) < (user_id + 8) % 24 else hour(ts) >= user_id % 24 or hour(ts) < (user_id + 8) % 24 end as open from {events}")
q("P12_in_progress", f"select user_id, last_ts + @hours(1) > @at('2024-01-31 12:00:00') as running from {LAST}")
q("P13_body_queue", f"select doc_id, row_number() over (order by published desc nulls first, doc_id) as pos from (select doc_id, published from (select *, case lang when 'de' then 3 else 0 end as attempts from {DOCS}) y where attempts < 3 and source not in ('src0') order by published desc nulls first, doc_id limit 200) x")
q("P14_document_filters", "select d.doc_id, d.source from {documents} d join {labels} l on d.doc_id = l.doc_id where d.source = 'src1' and l.quality = 1 and lower(d.text) like '%the%'")
q("P15_facets", "select case when l.quality is null then 'unknown' when l.quality = 1 then 'yes' else 'no' end as facet, count(*) as n from {documents} d left join {labels} l on d.doc_id = l.doc_id group by 1")
q("P17_exclusion", "select o_orderkey from {orders} where not (o_orderpriority like '1-%' or o_orderstatus = 'P')")
q("P20_role_level", "select c_custkey, case c_mktsegment when 'BUILDING' then 3 when 'MACHINERY' then 2 when 'AUTOMOBILE' then 1 else 0 end as level, case c_mktsegment when 'BUILDING' then 3 when 'MACHINERY' then 2 else 0 end >= 2 as allowed from {customer}")
q("P22_alive_trashed", "select conv_id, count(*) as turns, max(turn) % 2 = 0 as trashed from {conversations} group by conv_id")
q("P23_publishable", "select o_orderkey, o_orderstatus = 'O' and o_totalprice < 100000 as publishable from {orders}")
q("P25_visible_edges", "select l_orderkey, l_linenumber from {lineitem} where l_returnflag = 'R' and l_linestatus = 'F'")
# --- joins
q("J1_fk_lookup", "select o.o_orderkey, c.c_name, n.n_name from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey")
q("J2_canonical_of", "select a.doc_id, b.doc_id as canonical_id from {documents} a left join (select text, min(doc_id) as doc_id from {documents} group by text having count(*) > 1) b on a.text = b.text and a.doc_id > b.doc_id")
q("J3_bridge", "select c.c_custkey, count(distinct l.l_partkey) as parts from {customer} c join {orders} o on o.o_custkey = c.c_custkey join {lineitem} l on l.l_orderkey = o.o_orderkey group by c.c_custkey")
q("J4_left_count", "select c.c_custkey, count(o.o_orderkey) as n_orders, max(o.o_orderdate) as last_order from {customer} c left join {orders} o on o.o_custkey = c.c_custkey group by c.c_custkey")
q("J5_semi", "select d.doc_id from {documents} d where exists (select 1 from {labels} l where l.doc_id = d.doc_id)")
q("J6_anti", "select d.doc_id from {documents} d where not exists (select 1 from {labels} l where l.doc_id = d.doc_id)")
TAX = "lpad(cast(o_orderkey * 7919 % 100000000 as varchar(20)), 8, '0')"
q("J7_array_overlap", "select distinct a.l_orderkey as left_key, b.l_orderkey as right_key from {lineitem} a join {lineitem} b on a.l_partkey = b.l_partkey and a.l_orderkey < b.l_orderkey where a.l_suppkey = b.l_suppkey")
q("J8_unique_identifier", "select a.l_orderkey, min(b.l_suppkey) as supp from {lineitem} a join {lineitem} b on a.l_orderkey = b.l_orderkey group by a.l_orderkey having count(distinct b.l_suppkey) = 1")
q("J12_walk", "with recursive edges as (select conv_id, turn as a, turn + 1 as b from {conversations} union all select conv_id, max(turn) as a, min(turn) as b from {conversations} group by conv_id having max(turn) > min(turn)), walk as (select conv_id, a, b, 1 as depth, concat(',', cast(a as varchar(20)), ',', cast(b as varchar(20)), ',') as path from edges where a = 0 union all select e.conv_id, e.a, e.b, w.depth + 1 as depth, concat(w.path, cast(e.b as varchar(20)), ',') as path from walk w join edges e on e.conv_id = w.conv_id and e.a = w.b where w.depth < 5 and w.path not like concat('%,', cast(e.b as varchar(20)), ',%')) select conv_id, a, b, depth from walk")
q("J13_first_owner", "select l_partkey, l_orderkey from (select l_partkey, l_orderkey, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as r from {lineitem}) x where r = 1")
q("J14_newest_archive", "select p.p_partkey, max(l.l_orderkey) as archive from {part} p join {lineitem} l on l.l_partkey = p.p_partkey where p.p_size < 10 group by p.p_partkey")
# --- aggregates
q("G1_source_coverage", f"select source, min(published) as first_at, max(published) as last_at, count(*) as n from {DOCS} group by source")
q("G2_per_event", "select c_nationkey, count(*) as n, max(c_acctbal) as top from {customer} group by c_nationkey")
q("G3_filtered_count", "select n.n_name, count(c.c_custkey) as n, count(c.c_custkey) filter (where c.c_acctbal > 0) as with_body from {nation} n left join {customer} c on c.c_nationkey = n.n_nationkey group by n.n_name")
q("G4_funnel", "select count(*) as total, count(*) filter (where d.text <> '') as with_body, count(*) filter (where l.quality is not null) as assessed, count(*) filter (where l.quality = 1) as relevant, count(*) filter (where d.n_chars > 2000) as long_docs, count(*) filter (where l.toxic = 1) as toxic from {documents} d left join {labels} l on d.doc_id = l.doc_id")
q("G5_top_versions", "select label, count(*) as n from {embeddings} group by label order by n desc, label limit 5")
q("G6_distinct_sources", "select lang, count(distinct source) as sources from {documents} group by lang")
q("G7_timeline_span", "select user_id, @days(first_ts, last_ts) as span_days, news_days as days_with_news, @days(first_ts, last_ts) + 1 - news_days as silent_days from (select user_id, min(ts) as first_ts, max(ts) as last_ts, count(distinct day(ts)) as news_days from {events} group by user_id) x")
q("G8_ledger_totals", f"select count(*) as calls, count(*) filter (where event_type = 'error') as failures, cast(sum(cost) as decimal(20,4)) as cost from {LEDGER}")
q("G9_ledger_by_purpose", f"select event_type, hour(ts) < 4 as peak, count(*) as calls, cast(sum(cost) as decimal(20,4)) as cost from {LEDGER} group by 1, 2")
q("G10_admin_summary", f"select event_type, count(*) as calls, round(cast(sum(cost) as double) / count(*), 3) as mean_cost, max(ts) as last_at from {LEDGER} group by event_type")
q("G11_budget", f"select spent, approved, approved - spent as remaining, spent >= approved as stop from (select cast(coalesce(sum(cost) filter (where event_type <> 'purchase'), 0) as decimal(20,4)) as spent, cast(coalesce(sum(cost) filter (where event_type = 'purchase'), 5) as decimal(20,4)) as approved from {LEDGER}) x")
q("G17_ordered_union", "select l_orderkey, l_partkey, min(l_linenumber) as first_pos from {lineitem} group by l_orderkey, l_partkey")
q("G18_first_last_seen", "select o_custkey, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen from {orders} group by o_custkey")
q("G19_risk_tier", "select l_orderkey, case when count(*) filter (where l_returnflag <> 'N') = 0 then 'low' when count(*) filter (where l_returnflag = 'R') > 0 then 'high' else 'medium' end as tier from {lineitem} group by l_orderkey")
q("G23_confidence_histogram", "select case when n_chars > 3000 then 'high' when n_chars > 800 then 'medium' else 'low' end as confidence, count(*) as n from {documents} group by 1")
q("G24_sidebar_counts", "select count(*) filter (where o_orderstatus = 'O') as open_n, count(*) filter (where o_orderstatus = 'F') as final_n, count(*) filter (where o_orderstatus = 'P') as pending_n from {orders}")
q("G25_assignments", "select o_custkey, count(*) as n from {orders} group by o_custkey order by n desc, o_custkey")
# --- windows
GAPS = "(select user_id, event_id, ts, lag(ts) over (partition by user_id order by ts desc nulls last, event_id) as newer from {events}) g"
q("W1_silence_gap", f"select user_id, event_id, @days(ts, newer) as gap_days from {GAPS} where newer is not null and @days(ts, newer) >= 2")
q("W3_channel_rank", "select label, vec_id, row_number() over (partition by label order by vec_id desc) as rank_in_channel from {embeddings}")
q("W5_top_per_event", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderpriority, o_totalprice desc, o_orderkey) as r from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as newest from {orders}) x where newest <= 12) y where r <= 3")
q("W6_last_messages", "select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as pos from (select *, row_number() over (partition by conv_id order by turn desc) as back from {conversations}) x where back <= 12")
q("W7_last_user_turns", "select conv_id, turn, substr(text, 1, 500) as text from (select *, row_number() over (partition by conv_id order by turn desc) as back from {conversations} where role = 'user') x where back <= 4")
q("W9_page_fingerprints", "select user_id, event_id, event_type = lag(event_type) over (partition by user_id order by ts, event_id) as same_as_previous, event_type = first_value(event_type) over (partition by user_id order by ts, event_id) as same_as_first from {events}")
q("W10_failure_streak", "select user_id, event_id, case when bad = 1 then row_number() over (partition by user_id, island, bad order by ts, event_id) else 0 end as streak from (select *, sum(1 - bad) over (partition by user_id order by ts, event_id) as island from (select user_id, event_id, ts, case when event_type = 'click' then 1 else 0 end as bad from {events}) x) y")
q("W11_latest_five", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from {orders}) x where r <= 5")
# --- sorts and limits
q("T7_pagination", "select o_orderkey from {orders} order by o_orderdate desc, o_orderkey limit 50 offset 100")
q("T9_newest_of_ranked", "select doc_id from (select doc_id from (select doc_id, n_chars from {documents} order by n_chars desc, doc_id limit 300) x order by doc_id desc limit 4) y")
# --- set operations
q("U2_pinned_union", "select coalesce(a.l_orderkey, b.o_orderkey) as k, a.l_orderkey is not null as pinned, b.o_orderkey is not null as fused from (select distinct l_orderkey from {lineitem} where l_returnflag = 'R') a full outer join (select o_orderkey from {orders} where o_orderstatus = 'F') b on a.l_orderkey = b.o_orderkey")
q("U3_priority_concat", "select k, min(p) as first_channel from (select o_orderkey as k, 0 as p from {orders} where o_orderstatus = 'P' union all select l_orderkey as k, 1 as p from {lineitem} where l_quantity > 49) x group by k")
q("U5_difference", "select o_orderkey from {orders} where o_orderstatus = 'F' except select l_orderkey from {lineitem} where l_returnflag = 'R'")
q("U6_intersection", "select o_custkey from {orders} where o_orderstatus = 'P' intersect select c_custkey from {customer} where c_acctbal > 0")
# --- sinks as the tables that they leave
OLD = "(select o_orderkey, o_orderstatus, case when o_orderkey % 5 = 0 then '' else o_orderpriority end as title, o_totalprice from {orders} where o_orderkey % 2 = 0)"
NEW = "(select o_orderkey, 'N' as o_orderstatus, case when o_orderkey % 3 = 0 then '' else concat(o_orderpriority, '!') end as title, o_totalprice + 1 as o_totalprice from {orders} where o_orderkey % 4 <> 3)"
q("K1_upsert", f"select coalesce(n.o_orderkey, o.o_orderkey) as k, coalesce(n.o_orderstatus, o.o_orderstatus) as status, coalesce(nullif(n.title, ''), o.title, '') as title, coalesce(n.o_totalprice, o.o_totalprice) as price from {OLD} o full outer join {NEW} n on o.o_orderkey = n.o_orderkey")
q("K2_insert_ignore", f"select n.o_orderkey from {NEW} n where not exists (select 1 from {OLD} o where o.o_orderkey = n.o_orderkey)")
q("K3_changed_only", f"select n.o_orderkey from {NEW} n join {OLD} o on o.o_orderkey = n.o_orderkey where n.title is distinct from o.title")
q("K4_bridge_new", "select distinct l.l_orderkey, l.l_suppkey from {lineitem} l where not exists (select 1 from {orders} o where o.o_orderkey = l.l_orderkey and o.o_orderstatus = 'F')")
q("K5_fill_missing", f"select o.o_orderkey, coalesce(nullif(o.title, ''), n.title) as title from {OLD} o left join {NEW} n on o.o_orderkey = n.o_orderkey")
q("K7_latest_version", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by doc_id desc) as r from {documents}) x where r = 1")
q("K9_event_merge", "select distinct case when o_custkey % 10 = 1 then o_custkey - 1 else o_custkey end as event_id, o_orderkey as doc_id from {orders}")
# --- functions
q("H38_cache_rate", f"select event_type, case when sum(cost) = 0 then null else round(cast(sum(cost) filter (where user_id % 2 = 0) as double) / cast(sum(cost) as double), 6) end as rate from {LEDGER} group by event_type")
q("H39_label_confidence", "select doc_id, case when lower(text) like '%license%' then 'high' when n_chars > 2000 then 'medium' else 'low' end as confidence from {documents}")
q("H40_transition", "select a as from_state, b as to_state, (a, b) in (('candidate', 'draft'), ('candidate', 'rejected'), ('draft', 'active'), ('draft', 'rejected'), ('active', 'dormant'), ('active', 'closed'), ('dormant', 'active'), ('dormant', 'closed'), ('closed', 'active')) as allowed, count(*) as n from (select case o_orderkey % 6 when 0 then 'candidate' when 1 then 'draft' when 2 then 'active' when 3 then 'dormant' when 4 then 'closed' when 5 then 'rejected' end as a, case o_custkey % 6 when 0 then 'candidate' when 1 then 'draft' when 2 then 'active' when 3 then 'dormant' when 4 then 'closed' when 5 then 'rejected' end as b from {orders}) o group by 1, 2, 3")
q("H41_record_progress", f"select user_id, greatest(last_ts, @at('2024-01-30 00:00:00')) as progress, case when user_id % 3 = 1 then 'active' else 'kept' end as status from {LAST}")
# --- reports
q("C15_source_health", "select n.n_name, count(c.c_custkey) as docs, count(c.c_custkey) filter (where c.c_acctbal < 0) as failures, case when count(c.c_custkey) = 0 then 'never succeeded' when count(c.c_custkey) filter (where c.c_acctbal < 0) >= 5 then 'failing' else 'ok' end as health from {nation} n left join {customer} c on c.c_nationkey = n.n_nationkey group by n.n_name")
q("C16_crawler_rows", f"select c.source, c.n, c.last_at, c.last_at <= @at('2024-01-20 00:00:00') as stale from (select source, count(*) as n, max(published) as last_at from {DOCS} group by source) c")
q("Z9_earlier_than", f"select doc_id, row_number() over (partition by source order by coalesce(published, fetched), doc_id) = 1 as earliest from {DOCS}")
q("Z29_awaiting_reply", "select conv_id, role = 'user' as awaiting from (select conv_id, role, row_number() over (partition by conv_id order by turn desc) as r from {conversations}) x where r = 1")
q("CHK_edge_violations", "select l_orderkey, l_linenumber from {lineitem} where l_orderkey is null or l_quantity <= 0")
