"""The fixture views in SQL, as WITH clauses over the driver's tables (FIXTURES.md)."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "fx_statement_rows": r"""
select (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity as bigint) as pos,
       'bank' || (l_orderkey % 3) as bank_key,
       lpad(cast(l_orderkey % 37 as varchar), 4, '0') as account_tail,
       'item ' || (l_partkey % 5) as summary,
       case when l_partkey % 4 = 0 then '' else 'Party ' || (l_partkey % 5) end as counterparty,
       case when l_suppkey % 6 = 0 then '' else 'ch' || (l_suppkey % 3) end as channel,
       case when l_linestatus = 'O' then l_orderkey || '-' || l_linenumber else '' end as transaction_reference,
       strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') as transaction_time,
       case l_returnflag when 'A' then 'inflow' when 'R' then 'outflow' else 'unknown' end as direction,
       cast(cast(floor(l_extendedprice / 10000) as bigint) as varchar) || '.50' as amount,
       cast(50 + l_suppkey % 50 as double) / 100 as confidence
from lineitem""",
    "fx_order_captures": r"""
select (((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + cast(l_quantity as bigint) as pos,
       case l_orderkey % 4 when 0 then 'taobao' when 1 then 'pdd' when 2 then 'jd' else 'meituan' end as platform,
       case when l_orderkey % 5 = 0 then '' else cast(l_orderkey as varchar) end as order_id,
       case when l_partkey % 3 = 0 then '' else strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') end as order_time,
       case when l_suppkey % 4 = 0 then '' else 'shop' || (l_orderkey % 50) end as merchant,
       case when l_suppkey % 7 = 0 then '' else 'title ' || l_linenumber end as title,
       case when l_partkey % 6 = 0 then '' else '¥' || cast(cast(floor(l_extendedprice / 10000) as bigint) as varchar) || '.00' end as paid_amount,
       l_returnflag = 'N' as is_partial,
       cast(50 + l_suppkey % 50 as double) / 100 as confidence,
       'file' || (l_orderkey % 1000) as source_file, l_linenumber as order_index
from lineitem""",
    "fx_orders": r"""
select o_orderkey as pos,
       case when o_orderkey % 10 = 0 then '' else cast(o_orderkey as varchar) end as order_id,
       case o_custkey % 4 when 0 then 'taobao' when 1 then 'pdd' when 2 then 'jd' else 'meituan' end as platform,
       case when o_orderkey % 17 = 0 then '' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as order_time,
       'shop' || lpad(cast(o_custkey % 50 as varchar), 2, '0') as merchant,
       'title ' || o_orderpriority as title,
       cast(floor(o_totalprice / 2000) as decimal(18,2)) as paid_amount,
       o_orderstatus = 'P' as is_partial,
       cast(50 + o_orderkey % 50 as double) / 100 as confidence
from orders""",
    "fx_payments": r"""
select o_orderkey as pos, 'outflow' as direction,
       cast(floor(o_totalprice / 2000) as decimal(18,2)) as amount,
       strftime(o_orderdate + to_days(cast(o_orderkey % 10 as integer)), '%Y-%m-%d %H:%M:%S') as transaction_time,
       case when o_orderkey % 3 = 0 then '' else
         case o_custkey % 4 when 0 then 'taobao' when 1 then 'pdd' when 2 then 'jd' else 'meituan' end end as platform,
       case when o_orderkey % 4 = 0 then 'shop' || lpad(cast(o_custkey % 50 as varchar), 2, '0') || ' pay' else 'card pay' end as summary
from orders where o_orderkey % 7 <> 0""",
    "fx_orders_skew": r"""
select * replace (cast(floor(paid_amount / 10) as decimal(18,2)) as paid_amount) from fx_orders""",
    "fx_payments_skew": r"""
select * replace (cast(floor(amount / 10) as decimal(18,2)) as amount) from fx_payments""",
    "fx_movements": r"""
select event_id as pos, 'bank' || (user_id % 5) as bank_key, lpad(cast(user_id as varchar), 4, '0') as account_tail,
       strftime(ts, '%Y-%m-%d %H:%M:%S') as transaction_time,
       case event_type when 'purchase' then 'outflow' when 'signup' then 'inflow' else '' end as direction,
       cast(case when event_type = 'error' then -value when event_type = 'view' then 0 else value end as decimal(18,2)) as amount,
       event_type || ' ' || case when event_id % 9 = 0 then 'refund' else 'ok' end as summary
from events""",
    "fx_merchants": r"""
select p_partkey as pos, p_name as merchant, p_type as summary, p_brand as counterparty,
       case p_size % 3 when 0 then 'inflow' when 1 then 'outflow' else 'unknown' end as direction
from part""",
    "fx_rules": r"""
select * from (values (20, 0, 'Widget', 'outflow', 'W'), (10, 1, 'lring', null, 'R'), (20, 2, 'bolt', 'outflow', 'B'),
                      (20, 3, 'red', null, 'C'), (30, 4, 'gizmo', 'inflow', 'Z'), (40, 5, 'PROMO', null, 'P'))
       as t(priority, pos, keyword, direction, category)""",
    "fx_lines": r"""
select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as text
from documents""",
    "fx_messages": r"""
select doc_id as pos, source || '@example.com' as sender, lang || ' statement' as subject, text as body from documents""",
    "fx_manifest": r"""
select page_id as pos, case when page_id % 5 = 0 then 'password_failed' else 'success' end as status,
       [url || '.' || case page_id % 4 when 0 then 'PDF' when 1 then 'xls' when 2 then 'csv' else 'txt' end, url || '.csv'] as output_files
from pages""",
    "fx_files": r"""
select page_id as mtime, '2024-01-' || lpad(cast(1 + page_id % 28 as varchar), 2, '0') || '_g' || (page_id % 7) || '.xlsx' as name
from pages""",
    "fx_model_replies": r"""
select event_id as id, case event_id % 3 when 0 then props when 1 then 'Here you are: ' || props || ' done' else 'no json' end as raw_text
from events""",
    "fx_elements": r"""
select conv_id as file_id, turn as idx, role = 'system' as bad from conversations""",
    "fx_frames": r"""
select vec_id as pos, label as session_id, embedding from embeddings""",
    "fx_overrides": r"""
select doc_id, case when quality = 1 then 'keep' else '' end as override_category, toxic from labels""",
    "fx_records": r"""
select user_id as message_uid, 'bank' || (user_id % 5) as bank_key,
       list({'raw_line': event_type || ' ' || event_id,
             'amounts': case when event_id % 8 = 0 then ['n/a'] else
               [cast(cast(value as decimal(18,2)) as varchar), cast(cast(event_id % 300 as decimal(18,2)) as varchar)] end,
             'direction': case event_type when 'purchase' then 'outflow' else 'unknown' end} order by event_id) as candidates
from events group by user_id""",
    "fx_headers": r"""
select p_partkey // 10 as table_id, p_partkey % 10 as col, case when p_size % 5 = 0 then '' else p_type end as header
from part""",
    "fx_lookup": r"""
select * from (values ('pattern', '/fr/', 2), ('bank', 'bank1', 1), ('type', 'csv', 3), ('type', 'pdf', 1), ('default', '', 1))
       as t(kind, key, candidate_count)""",
}

#: Derived relations that several queries share: facts, links and the ledger of the fixtures.
VIEWS |= {
    "f_orders": r"""
select pos, 'fin_tx_' || substr(sha256('platform_order:o' || pos), 1, 20) as fact_id, 'platform_order' as source_type, 'o' || pos as source_id, 'order_purchase' as fact_type,
       'expense' as business_type, order_time as occurrence_time, paid_amount as amount, -abs(paid_amount) as signed_amount, 'outflow' as direction, platform as source_system, platform,
       'unknown' as payment_channel, merchant, '' as counterparty, title, concat_ws(' ', merchant, title) as summary, confidence,
       case when order_time = '' then 'missing_occurrence_time' else '' end as warning
from fx_orders""",
    "f_payments": r"""
select pos, 'fin_tx_' || substr(sha256('bank_transaction:p' || pos), 1, 20) as fact_id, 'bank_transaction' as source_type, 'p' || pos as source_id, 'bank_payment' as fact_type,
       'expense' as business_type, transaction_time as occurrence_time, amount, -abs(amount) as signed_amount, direction, '' as source_system, platform, 'bank_card' as payment_channel,
       '' as merchant, '' as counterparty, '' as title, summary, 0.5::double as confidence, '' as warning
from fx_payments""",
    "fx_moves_known": r"""
select * replace (case when direction in ('inflow', 'outflow') then direction when amount < 0 then 'outflow' when amount > 0 then 'inflow' else 'unknown' end as direction) from fx_movements""",
    "f_movements": r"""
select pos, 'fin_tx_' || substr(sha256('bank_transaction:m' || pos), 1, 20) as fact_id, 'bank_transaction' as source_type, 'm' || pos as source_id,
       case when direction = 'outflow' then 'bank_payment' else 'bank_money_movement' end as fact_type,
       case when direction = 'outflow' then 'expense' when direction = 'inflow' and contains(summary, 'refund') then 'refund' when direction = 'inflow' then 'income' else 'unknown' end as business_type,
       transaction_time as occurrence_time, abs(amount) as amount, case when direction = 'outflow' then -abs(amount) else abs(amount) end as signed_amount, direction, bank_key as source_system,
       '' as platform, 'bank_card' as payment_channel, '' as merchant, '' as counterparty, '' as title, summary, 0.5::double as confidence,
       case when direction = 'unknown' then 'unknown_money_direction' else '' end as warning
from fx_moves_known""",
    "f_all": r"""
select * from f_payments union all select * from f_movements union all select * from f_orders""",
    "d_links": r"""
select 'fin_link_' || substr(sha256('{"order": "' || order_id || '", "payment": "' || payment_id || '", "relation": "pays_for"}'), 1, 20) as link_id, *,
       case when score >= 85 then 'linked' else 'candidate' end as match_strength
from (
  select *, row_number() over (partition by order_id order by score desc, payment_pos) as rank
  from (
    select *, greatest(0, least(100, 50 + case when days is null then -10 when days = 0 then 25 when days <= 1 then 20 when days <= 3 then 15 else 8 end
              + case when same then 20 when word then 12 else 0 end + case when merch then 10 else 0 end)) as score,
           concat_ws(',', 'amount_exact', case when days = 0 then 'same_day' when days <= 1 then 'within_1_day' when days <= 3 then 'within_3_days' when days <= 7 then 'within_7_days' end,
                     case when same then 'platform_match' when word then 'platform_text_match' end, case when merch then 'merchant_text_overlap' end, case when days is null then 'date_missing' end) as evidence
    from (
      select o.fact_id as order_id, p.fact_id as payment_id, o.pos as order_pos, p.pos as payment_pos, o.amount, o.platform,
             case when o.occurrence_time = '' or p.occurrence_time = '' then null
                  else abs(date_diff('day', cast(left(o.occurrence_time, 10) as date), cast(left(p.occurrence_time, 10) as date))) end as days,
             o.platform = p.platform as same, o.platform <> p.platform and contains(lower(replace(p.summary, ' ', '')), o.platform) as word,
             contains(lower(replace(p.summary, ' ', '')), left(lower(replace(o.merchant, ' ', '')), 8)) or contains(lower(replace(p.summary, ' ', '')), left(lower(replace(o.title, ' ', '')), 10)) as merch
      from f_orders o join f_payments p on o.amount = p.amount)
    where days <= 7 or (days is null and merch))
  where score >= 65)
where rank <= 5""",
    "d_enriched": r"""
select p.*, l.payment_id is not null as matched_order, coalesce(ids, '') as linked_order_ids, coalesce(records, '') as linked_order_record_ids,
       coalesce(first_text, '') as item_or_service, coalesce(texts, '') as order_detail_summary, coalesce(n, 0) as order_count
from (select * from f_payments union all select * from f_movements) p
left join (
  select payment_id, string_agg(order_id, ',' order by score desc, order_pos, rank) as ids, string_agg('o' || order_pos, ',' order by score desc, order_pos, rank) as records,
         first(t order by score desc, order_pos, rank) as first_text, array_to_string(list(t order by score desc, order_pos, rank)[1:5], ' | ') as texts, count(*) as n
  from (select l.*, o.merchant || ' - ' || o.title || ' - ' || o.summary as t from d_links l join f_orders o on l.order_id = o.fact_id where score >= 85)
  group by payment_id) l on p.fact_id = l.payment_id""",
    "d_ledger": r"""
select *, case kind when 'urgent' then '支出' when 'shop' then '支出' when 'card' then '转账' when 'in' then '收入' when 'out' then '支出' else '未知' end as transaction_type,
       case kind when 'urgent' then '交通出行' when 'shop' then '购物消费' when 'card' then '账户互转' when 'in' then '其他收入' else '未分类' end as category_lv1,
       case kind when 'urgent' then '自驾用车' when 'shop' then '日用百货' when 'card' then '银行与支付账户' when 'in' then '其他收入' else '未分类' end as category_lv2,
       case kind when 'urgent' then '停车费' when 'shop' then '其他日用品' else '' end as category_lv3,
       case kind when 'urgent' then '家庭' when 'shop' then '家庭' when 'card' then '本人' when 'in' then '本人' else '其他' end as target_person,
       case kind when 'urgent' then 0.9 when 'shop' then 0.78 when 'card' then 0.88 when 'in' then 0.55 when 'out' then 0.35 else 0.1 end as classification_confidence,
       kind not in ('urgent', 'card') as review_required, try_cast(left(occurrence_time, 10) as date) as date
from (
  select *, case when direction = 'outflow' and contains(key, 'urgent') then 'urgent' when direction = 'outflow' and (contains(key, 'shop0') or contains(key, 'shop1')) then 'shop'
                 when direction = 'outflow' and contains(key, 'cardpay') then 'card' when direction = 'inflow' then 'in' when direction = 'outflow' then 'out' else 'none' end as kind
  from (select *, lower(replace(concat_ws(' ', merchant, counterparty, case when order_detail_summary <> '' then trim(concat_ws(' ', title, item_or_service)) else title end,
                  case when order_detail_summary <> '' then trim(concat_ws(' ', summary, order_detail_summary)) else summary end, platform, payment_channel), ' ', '')) as key
        from d_enriched))""",
    "d_bank": r"""
select key, min(pos) as pos, count(*) as n_sources, min_by(bank_key, pos) as bank_key, min_by(account_tail, pos) as account_tail, min_by(amount, pos) as amount, min_by(direction, pos) as direction,
       coalesce(min_by(summary, pos) filter (summary <> ''), '') as summary, coalesce(min_by(counterparty, pos) filter (counterparty <> ''), '') as counterparty,
       coalesce(min_by(channel, pos) filter (channel <> ''), '') as channel, coalesce(min_by(transaction_reference, pos) filter (transaction_reference <> ''), '') as transaction_reference,
       coalesce(min_by(transaction_time, pos) filter (transaction_time <> ''), '') as transaction_time, max(confidence) as confidence,
       concat_ws(',', case when count(distinct nullif(channel, '')) > 1 then 'conflict_channel' end, case when count(distinct nullif(counterparty, '')) > 1 then 'conflict_counterparty' end,
                 case when count(distinct nullif(summary, '')) > 1 then 'conflict_summary' end, case when count(distinct nullif(transaction_time, '')) > 1 then 'conflict_transaction_time' end) as warnings
from (select *, case when transaction_reference <> '' then concat_ws('|', 'ref', bank_key, bank_key || ':' || account_tail, transaction_reference)
                     else concat_ws('|', 'fallback', bank_key, bank_key || ':' || account_tail, transaction_time, direction, amount,
                                    left(lower(replace(coalesce(nullif(counterparty, ''), summary), ' ', '')), 40)) end as key from fx_statement_rows)
group by key""",
}

# rows of two sources, of which the first comes first
VIEWS["d_bank_twice"] = VIEWS["d_bank"].replace("from fx_statement_rows)", "from (select * replace (pos + (select max(pos) + 1 from fx_statement_rows) as pos) from fx_statement_rows union all select * from fx_statement_rows where pos % 3 = 0))")

# captures with their keys and warnings, and the fold of each key's captures in order of pos
CAPTURE_WARNINGS = "list_filter([case when confidence < 0.8 then 'low_confidence' end, case when order_id = '' then 'missing_order_id' end, case when order_time = '' then 'missing_order_time' end, case when paid_amount = '' then 'missing_paid_amount' end, case when title = '' then 'missing_title' end, case when is_partial then 'partial_order' end], lambda x: x is not null)"
CAPTURE_FIELDS = ("source_file", "order_id", "order_time", "merchant", "title", "paid_amount")
_filled = lambda r: " + ".join(f"case when {r}.{f} <> '' then 1 else 0 end" for f in CAPTURE_FIELDS if f != "source_file")
_score = lambda r: f"row(case when {r}.is_partial then 0 else 1 end, {r}.confidence, {_filled(r)})"
_merged = lambda p, s: ", ".join([
    "pos := a.pos", *[f"{f} := case when {p}.{f} <> '' then {p}.{f} else {s}.{f} end" for f in CAPTURE_FIELDS], "is_partial := a.is_partial and b.is_partial", "confidence := greatest(a.confidence, b.confidence)",
    "warnings := list_sort(list_distinct(list_concat(a.warnings, b.warnings, list_filter([" + ", ".join(f"case when a.{f} <> '' and b.{f} <> '' and a.{f} <> b.{f} then 'conflict_{f}' end" for f in CAPTURE_FIELDS) + "], lambda x: x is not null))))",
    f"sources := list_concat({p}.sources, {s}.sources)",
])
VIEWS["d_captures"] = f"""
select *, case when order_id <> '' then 'order_id|' || platform || '|' || order_id
  when not (((merchant <> '' or title <> '') and paid_amount <> '') or ((merchant <> '' or title <> '') and order_time <> '') or (order_time <> '' and paid_amount <> '')) then 'source|' || platform || '|' || source_file || '|' || order_index
  else concat_ws('|', 'fallback', platform, order_time, lower(replace(merchant, ' ', '')), lower(replace(title, ' ', '')), '', paid_amount) end as dedupe_key
from (select * replace (replace(paid_amount, '¥', '') as paid_amount), {CAPTURE_WARNINGS} as warnings from fx_order_captures)"""
VIEWS["d_orders"] = f"""
select dedupe_key, platform, n_sources, unnest(list_reduce(captures, lambda a, b: case when {_score("b")} > {_score("a")} then struct_pack({_merged("b", "a")}) else struct_pack({_merged("a", "b")}) end))
from (select dedupe_key, platform, count(*) as n_sources,
             list(struct_pack(pos := pos, {", ".join(f"{f} := {f}" for f in CAPTURE_FIELDS)}, is_partial := is_partial, confidence := confidence, warnings := list_sort(warnings), sources := [pos]) order by pos) as captures
      from d_captures group by dedupe_key, platform)"""


def with_views(select: str, **extra: str) -> str:
    """The statement with a WITH clause of the views it names, directly or through others."""
    views = {**VIEWS, **extra}
    needed: list[str] = []

    def add(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(views[name])
                needed.append(name)

    add(select)
    if not needed:
        return select
    own = re.match(r"\s*with\s", select)
    return "with " + ", ".join(f"{n} as ({views[n]})" for n in needed) + (", " + select[own.end() :] if own else " " + select)
