"""SQL for each query, written for DuckDB over the same test tables."""

from __future__ import annotations

from cellwarden.operators.actions import ADJUST, ADJUSTMENT_ISSUED, NO_ACTIONS
from cellwarden.operators.documents import DOCUMENT_PREFIX, NO_EXTERNAL, NO_INTERNAL
from cellwarden.operators.rules import ANALYSES, NO_RULES, RULES_FOUND
from cellwarden.operators.similarity import random_directions
from cellwarden.schemas import CELL_TRACES, ERAB_ATTEMPTS, ERAB_RELEASES, ERAB_SUCCESSES, PERFORMANCE
from workload.views import INPUTS, duck_sql


def _sum(names) -> str:
    return "(" + " + ".join(names) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SUCCESS = f"cast({_sum(ERAB_SUCCESSES)} as double) * 100 / nullif({_sum(ERAB_ATTEMPTS)}, 0)"
RETAIN = f"cast({_sum(ERAB_RELEASES)} as double) / nullif(ERAB_SessionTimeUE, 0) * 3600"
REGISTRY = "[" + ", ".join(_quoted(a) for a in ANALYSES) + "]"


def _gate(column: str) -> str:
    return f"array_to_string(list_filter({REGISTRY}, lambda a: list_contains({column}, a)), ';')"


STEPS = {
    **{name: duck_sql(name) for name in INPUTS},
    "performance_kpi": f"select enodeb_id, cell_id, measurement_end, {SUCCESS} erab_success_rate, {RETAIN} retainability from performance",
    "missed": """
select enodeb_id, cell_id, measurement_end, 'erab_success_rate' kpi, erab_success_rate kpi_value
from performance_kpi where erab_success_rate < 97
union all
select enodeb_id, cell_id, measurement_end, 'retainability', retainability
from performance_kpi where retainability > 3""",
    "kpi_text": """
select 'erab_success_rate' kpi, 'ERAB success rate is below 97%' description
union all select 'retainability', 'Retainability is above 3'""",
    "detected": """
select m.enodeb_id, m.cell_id, t.description, m.kpi, avg(m.kpi_value) kpi_value,
       min(m.measurement_end) started, max(m.measurement_end) ended
from missed m join kpi_text t on m.kpi = t.kpi
group by m.enodeb_id, m.cell_id, m.kpi, t.description""",
    "candidates": """
select sha256(concat_ws('|', enodeb_id, cell_id, kpi, strftime(started, '%Y-%m-%d %H:%M:%S'))) incident_id,
       date_trunc('second', started) start_ts, date_trunc('second', ended) end_ts, 'NEW' status,
       description, kpi, round(kpi_value, 6) kpi_value, enodeb_id, cell_id,
       concat(kpi, ' (value=', cast(round(kpi_value, 6) as varchar), ')') kpi_missed
from detected""",
    "single_kpis": """
select incident_id, kpi from candidates
union all select concat(enodeb_id, '/', cell_id), kpi from candidates""",
    "matched": """
select distinct s.incident_id, r.* from single_kpis s join rules r on list_contains(r.kpi_missed, s.kpi)""",
    "collected": f"""
select i.incident_id,
       case when count(m.rule_id) > 0 then {_quoted(RULES_FOUND)} else {_quoted(NO_RULES)} end rules_status,
       coalesce(string_agg(m.processing_rule, ';' order by m.rule_id), '') processing_rules,
       coalesce(string_agg(m.severity_determination_rule, ';' order by m.rule_id), '') severity_determination_rules,
       coalesce(list_sort(list_distinct(flatten(list(m.processing_rule_tools) filter (m.rule_id is not null)))), []) tools,
       coalesce(list_sort(list_distinct(flatten(list(m.severity_determination_rule_tools) filter (m.rule_id is not null)))), []) severity_tools,
       coalesce(string_agg(m.rule_id, ',' order by m.rule_id) filter (list_contains(m.processing_rule_tools, 'get_cell_trace_statistics')), '') trace_rules,
       coalesce(string_agg(m.rule_id, ',' order by m.rule_id) filter (list_contains(m.processing_rule_tools, 'get_uplink_rssi_level')), '') rssi_rules,
       coalesce(string_agg(m.rule_id, ',' order by m.rule_id) filter (list_contains(m.processing_rule_tools, 'get_uplink_configuration')), '') config_rules
from (select distinct incident_id from single_kpis) i left join matched m on i.incident_id = m.incident_id
group by i.incident_id""",
    "inside": """
select c.incident_id, t.imsi, t.imeisv,
       coalesce(nullif(t.s1_sig_conn_setup_sig_conn_result, ''), 'OTHER') connection_outcome
from candidates c join cell_traces t
  on t.start_enodeb_id = c.enodeb_id and t.start_cell_id = c.cell_id
 and t.starttime >= c.start_ts and t.endtime <= c.end_ts""",
    "stats": "select incident_id, connection_outcome, count(*) n from inside group by all",
    "share": """
select incident_id, sum(n) traces,
       sum(case when connection_outcome like '%SECURITY%' then n else 0 end) * 100.0 / sum(n) security_failure_pct
from stats group by incident_id""",
    "trace_texts": """
select c.incident_id,
       coalesce(string_agg(concat(connection_outcome, ': ', n), ', ' order by connection_outcome), '') trace_statistics,
       case when count(n) = 0 then 'No cell traces found' else 'Success' end trace_status
from candidates c left join stats s on c.incident_id = s.incident_id group by c.incident_id""",
    "rssi": """
select c.incident_id, c.enodeb_id, c.cell_id, avg(p.UL_RSSI) uplink_rssi
from candidates c left join performance p
  on p.enodeb_id = c.enodeb_id and p.cell_id = c.cell_id
 and p.measurement_end >= c.start_ts and p.measurement_end <= c.end_ts
group by all""",
    "config": """
select c.incident_id, c.enodeb_id, c.cell_id, g.pZeroNominalPucch, g.pZeroNominalPusch,
       abs(pZeroNominalPucch + 114) / 114.0e0 pZeroNominalPucch_deviation,
       abs(pZeroNominalPusch + 100) / 100.0e0 pZeroNominalPusch_deviation
from candidates c left join cell_config g on c.enodeb_id = g.enodeb_id and c.cell_id = g.cell_id""",
    "measured": """
select c.*, k.tools, k.severity_tools, k.trace_rules, k.rssi_rules, k.config_rules, round(r.uplink_rssi, 6) rssi,
       not (r.uplink_rssi between -120 and -114) out_of_range,
       round(s.security_failure_pct, 6) security_pct,
       pZeroNominalPucch_deviation > 0.05 pucch_off, pZeroNominalPusch_deviation > 0.05 pusch_off,
       case when not (r.uplink_rssi between -120 and -114) then round(pZeroNominalPucch_deviation, 6) end pucch_dev,
       case when not (r.uplink_rssi between -120 and -114) then round(pZeroNominalPusch_deviation, 6) end pusch_dev
from candidates c join collected k on c.incident_id = k.incident_id
left join rssi r on c.incident_id = r.incident_id
left join share s on c.incident_id = s.incident_id
left join config g on c.incident_id = g.incident_id""",
    "findings": """
select *, list_filter([
  case when kpi = 'erab_success_rate' and list_contains(tools, 'get_cell_trace_statistics') and security_pct >= 20
       then {'cause': 'failed security setup', 'metric': 'security_failure_pct', 'value': security_pct, 'rules': trace_rules} end,
  case when kpi = 'retainability' and list_contains(tools, 'get_uplink_rssi_level') and (rssi < -120 or rssi > -114)
       then {'cause': 'uplink RSSI outside the normal range', 'metric': 'uplink_rssi', 'value': rssi, 'rules': rssi_rules} end,
  case when kpi = 'retainability' and list_contains(tools, 'get_uplink_configuration') and pucch_dev > 0.05
       then {'cause': 'pZeroNominalPucch differs from the optimum', 'metric': 'pZeroNominalPucch_deviation', 'value': pucch_dev, 'rules': config_rules} end,
  case when kpi = 'retainability' and list_contains(tools, 'get_uplink_configuration') and pusch_dev > 0.05
       then {'cause': 'pZeroNominalPusch differs from the optimum', 'metric': 'pZeroNominalPusch_deviation', 'value': pusch_dev, 'rules': config_rules} end
], lambda f: f is not null) found from measured""",
    "analyzed": """
select *, array_to_string(list_transform(found, lambda f: f.cause), ';') causes,
       array_to_string(list_transform(found, lambda f: f.rules), ';') asking_rules,
       case when len(found) = 0 then 'No root cause was found.' else
         array_to_string(list_transform(found, lambda f:
           concat(f.cause, ' (', f.metric, ' = ', cast(f.value as varchar), ')')), chr(10)) end analysis
from findings""",
    "graded": """
select *,
  case when kpi = 'erab_success_rate' then case when kpi_value < 50 then 1 end
       when kpi_value > 40 then 2 when rssi < -116 then 3 when rssi > -112 then 4 end hit
from analyzed""",
    "severity": """
select *,
  case hit when 3 then 'MEDIUM' when 1 then 'HIGH' when 2 then 'HIGH' when 4 then 'HIGH' else 'LOW' end severity_level,
  case hit when 1 then concat('erab_success_rate = ', cast(kpi_value as varchar), ' is lt 50.0')
           when 2 then concat('retainability = ', cast(kpi_value as varchar), ' is gt 40.0')
           when 3 then concat('uplink_rssi = ', cast(rssi as varchar), ' is lt -116.0')
           when 4 then concat('uplink_rssi = ', cast(rssi as varchar), ' is gt -112.0')
           else concat('no severity rule holds for ', kpi) end severity_level_explanation
from graded""",
    "acting": f"""
select *, kpi_value > 35 earlier,
       coalesce(kpi = 'retainability' and list_contains(tools, '{ADJUST}') and out_of_range
                and (coalesce(pucch_off, false) or coalesce(pusch_off, false)), false) adjust
from measured""",
    "general": """
select incident_id, concat('Missed KPIs: ', kpi_missed, '. Duration: ',
       cast(epoch(end_ts) - epoch(start_ts) as bigint), '.0 seconds.') general_info from candidates""",
    "near": """
select q.vec_id query_id, b.vec_id base_id, b.label,
       list_distance(b.embedding::double[], q.embedding::double[]) distance
from embeddings q, embeddings b""",
    "topk": """
select *, cast(row_number() over (partition by query_id order by distance, base_id) as integer) rank from near
qualify rank <= 5""",
    "topk_others": """
select *, cast(row_number() over (partition by query_id order by distance, base_id) as integer) rank from near
where query_id <> base_id qualify rank <= 5""",
    "logs": """
select m.incident_id, concat('**General info**', chr(10), g.general_info,
       case when list_contains(m.tools, 'get_cell_trace_statistics') then
         concat(chr(10), chr(10), '**Cell traces statistics**', chr(10), t.trace_statistics) else '' end) events
from measured m join general g on m.incident_id = g.incident_id
join trace_texts t on m.incident_id = t.incident_id""",
    "log_counts": """
select incident_id, ('0x' || substr(md5(tok), 1, 8))::bigint % 64 dim, count(*) n
from (select incident_id, unnest(regexp_extract_all(lower(events), '[a-z0-9]+')) tok from logs) group by all""",
    "log_vectors": """
select l.incident_id, any_value(l.events) events,
       list(coalesce(n, 0) / norm order by d.dim)::double[] vec
from logs l cross join (select unnest(range(64)) dim) d
join (select incident_id, sqrt(sum(n * n)) norm from log_counts group by incident_id) s on s.incident_id = l.incident_id
left join log_counts c on c.incident_id = l.incident_id and c.dim = d.dim
group by l.incident_id""",
    "near_logs": """
select q.incident_id, b.incident_id base_id, b.events, round(list_distance(q.vec, b.vec), 9) distance
from log_vectors q join log_vectors b on q.incident_id <> b.incident_id
qualify row_number() over (partition by q.incident_id order by round(list_distance(q.vec, b.vec), 9), b.incident_id) <= 5""",
    "chunks": """
select coalesce(d.doc_id, p.page_id) case_id, d.doc_id, d.source, p.url,
       regexp_extract(p.html, '(?is)<title[^>]*>(.*?)</title>', 1) title
from documents d full join pages p on d.doc_id = p.page_id""",
}


def _buckets(dim: int = 64, tables: int = 6, width: float = 1.0, seed: int = 7) -> str:
    """Bucket of each embedding in each hash table, from the directions the operator draws, as a list."""
    directions, offsets = random_directions(dim, tables, width, seed)
    return ", ".join(
        f"cast(floor((list_dot_product(embedding::double[], {d.tolist()}::double[]) + {o!r}) / {width!r}) as bigint)"
        for d, o in zip(directions.T, offsets.tolist())
    )


def sql(select: str) -> str:
    """``select`` with the steps it needs before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split())
        for name, body in STEPS.items():
            if name in words and name not in needed and body is not text:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select.strip()
    steps = ",\n".join(f"{name} as (\n{STEPS[name].strip()}\n)" for name in needed)
    return f"with {steps}\n{select.strip()}"


RAW_TERMS = "select distinct query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) term from questions"
CORRECTED_TERMS = f"""
  select distinct r.query_id, coalesce(f.found, r.term) term
  from ({RAW_TERMS}) r left join (
    select u.term, v.term found from (
      select distinct term from ({RAW_TERMS}) where term not in (select term from vocab)) u
    join vocab v on abs(length(u.term) - length(v.term)) <= 1
    where levenshtein(u.term, v.term) = 1
    qualify row_number() over (partition by u.term order by v.df desc, v.term) = 1) f on r.term = f.term"""


def _bm25(docs: str, questions: str, k: int, terms: str = RAW_TERMS) -> str:
    """Steps ``postings`` to ``ranked`` over docs(doc_id, text) and questions(query_id, query)."""
    return f"""
docs as ({docs}),
questions as ({questions}),
doc_tokens as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') toks from docs),
corpus as (select count(*) n, avg(len(toks)) mean_length from doc_tokens),
vocab as (select term, count(distinct doc_id) df from (select doc_id, unnest(toks) term from doc_tokens) group by term),
terms as ({terms}),
postings as (
  select doc_id, length, term, count(*) tf
  from (select doc_id, len(toks) length, unnest(toks) term from doc_tokens)
  where term in (select term from terms) group by all),
weights as (select term, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) idf from postings, corpus group by term),
scored as (
  select t.query_id, p.doc_id,
         round(sum(w.idf * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.length / c.mean_length))), 6) score
  from terms t join postings p on t.term = p.term join weights w on w.term = t.term, corpus c
  group by t.query_id, p.doc_id),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) rank from scored
  qualify rank <= {k})"""


QUESTIONS = "select item_id query_id, text query from benchmark"
INCIDENT_QUESTIONS = "select distinct concat(description, ' ', kpi) query_id, concat(description, ' ', kpi) query from candidates"


def _with(steps: str, select: str) -> str:
    """Shared steps first, then the given ones."""
    before = sql(f"{steps} {select}")
    if before.startswith("with "):
        return before[: before.index(steps)].rstrip() + "," + steps + "\n" + select
    return "with " + steps + "\n" + select


# The window of 30 tokens with most distinct terms: of each hit and each term the last place before it.
PASSAGES = """,
cut as (
  select r.query_id, r.doc_id, r.rank, d.text, regexp_extract_all(lower(d.text), '[a-z0-9]+') toks,
         string_split_regex(lower(d.text), '[a-z0-9]+') gaps, a.ts
  from ranked r join docs d on r.doc_id = d.doc_id
  join (select query_id, list(term) ts from terms group by query_id) a on a.query_id = r.query_id),
hits as (select query_id, doc_id, i - 1 place, toks[i] term from cut, unnest(range(1, len(toks) + 1)) u(i) where list_contains(ts, toks[i])),
lasts as (
  select a.query_id, a.doc_id, a.place stop, b.term, max(b.place) place
  from hits a join hits b on a.query_id = b.query_id and a.doc_id = b.doc_id and b.place <= a.place and b.place > a.place - 30
  group by all),
windows as (select query_id, doc_id, stop, min(place) start, count(*) n from lasts group by all),
placed as (
  select c.*, w.start, w.stop, w.n, greatest(0, w.start - (30 - (w.stop - w.start + 1)) // 2) first
  from cut c join (select * from windows qualify row_number() over (partition by query_id, doc_id order by n desc, stop - start, start) = 1) w
    on w.query_id = c.query_id and w.doc_id = c.doc_id),
parts as (
  select *, list_transform(gaps, lambda x: length(x)) gl, list_transform(toks, lambda x: length(x)) tl, least(len(toks), first + 30) last
  from placed),
passages as (
  select query_id, doc_id, rank, start first_token, stop last_token, n distinct_terms,
         substr(text, cast(1 + coalesce(list_sum(list_slice(gl, 1, first + 1)), 0) + coalesce(list_sum(list_slice(tl, 1, first)), 0) as bigint),
           cast(coalesce(list_sum(list_slice(gl, first + 2, last)), 0) + coalesce(list_sum(list_slice(tl, first + 1, last)), 0) as bigint)) passage
  from parts)"""


def _retrieval(docs: str, reference: str, empty: str) -> str:
    steps = _bm25(docs, INCIDENT_QUESTIONS, 10) + PASSAGES + f""",
answers as (
  select r.query_id, string_agg({reference}, chr(10) order by r.rank) refs,
         string_agg(r.passage, chr(10) order by r.rank) answer
  from passages r join docs d on r.doc_id = d.doc_id group by r.query_id)"""
    return _with(steps, f"""
select c.incident_id, concat(c.description, ' ', c.kpi) queries, coalesce(a.refs, '') "references",
       coalesce(a.answer, {_quoted(empty)}) search_result
from candidates c left join answers a on a.query_id = concat(c.description, ' ', c.kpi)""")


INTERNAL_DOCS = "select doc_id, text, source title from documents"
INTERNAL_REFERENCE = f"concat('{DOCUMENT_PREFIX}', d.doc_id, ' ', d.title)"
PAGE_TEXT = r"""
select page_id doc_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) title,
       trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
         '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
         '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text
from pages where contains(url, '.example.com/')"""


def _absent(schema, given: dict[str, str]) -> str:
    duck = {"string": "varchar", "long": "bigint", "double": "double", "timestamp": "timestamp"}
    return ", ".join(
        f'{given.get(f.name, "cast(null as " + duck[f.dataType.typeName()] + ")")} "{f.name}"' for f in schema
    )


_PERFORMANCE_GIVEN = {
    c: c
    for c in ["enodeb_id", "cell_id", "measurement_end", *ERAB_ATTEMPTS, *ERAB_SUCCESSES, *ERAB_RELEASES, "ERAB_SessionTimeUE", "UL_RSSI"]
}
_TRACES_GIVEN = {
    **{c: c for c in ["start_enodeb_id", "start_cell_id", "imsi", "imeisv"]},
    "starttime": "date_trunc('second', starttime)",
    "endtime": "date_trunc('second', endtime)",
    # An empty CSV field is NULL.
    "s1_sig_conn_setup_sig_conn_result": "nullif(s1_sig_conn_setup_sig_conn_result, '')",
}
_RULE_ROWS = """
(select concat('rule-', s_suppkey) rule_id, s_name description from supplier) e"""
_NEW_ROWS = """
(select concat('rule-', c_custkey) rule_id, c_name description from customer) n"""
_OVERSHOOT = "abs(kpi_value - case kpi when 'retainability' then 3 else 97 end) / case kpi when 'retainability' then 3.0e0 else 97.0e0 end"
_SEVERITY_ONLY_KPI = "case when kpi = 'erab_success_rate' and kpi_value < 50 then 'HIGH' when kpi = 'retainability' and kpi_value > 40 then 'HIGH' else 'LOW' end"
_DISTANCE = "round(distance, 6) distance"

_BLOCK = """concat('*Incident ', base_id, '*', chr(10), '**Search distance**: ', cast(round(distance, 6) as varchar),
  ' (', case when round(distance, 6) < 1.1 then 'likely match' else 'somewhat similar' end, ')', chr(10),
  '**Events**', chr(10), 'events of ', base_id, chr(10),
  '**Final analysis**', chr(10), case when label % 3 = 0 then concat('analysis ', label) else 'Not yet determined' end, chr(10),
  '**Cause**', chr(10), 'cause ', label, chr(10),
  '**Resolution**', chr(10), 'Not yet determined', chr(10))"""

ORACLES = {
    "load_performance": sql(f"select {_absent(PERFORMANCE, _PERFORMANCE_GIVEN)} from performance"),
    "load_cell_traces": sql(f"select {_absent(CELL_TRACES, _TRACES_GIVEN)} from cell_traces"),
    "csv_to_jsonl": """
select cast(conv_id as varchar) conv_id, cast(turn as varchar) turn, coalesce(role, '') "role", coalesce(text, '') "text"
from conversations""",
    "load_rules": """
select concat('rule-', s_suppkey) rule_id, s_name description,
       case when s_acctbal > 0 then 'retainability,erab_success_rate' else 'erab_success_rate' end kpi_missed,
       concat('check "', s_name, '"') processing_rule, 'get_uplink_rssi_level' processing_rule_tools,
       cast(null as varchar) severity_determination_rule, timestamp '2025-12-26 08:30:00' creation_date,
       s_nationkey > 10 is_current
from supplier""",
    "insert_rules": f"select * from {_RULE_ROWS} union all select * from {_NEW_ROWS} where rule_id not in (select rule_id from {_RULE_ROWS})",
    "upsert_rules": f"select * from {_NEW_ROWS} union all select * from {_RULE_ROWS} where rule_id not in (select rule_id from {_NEW_ROWS})",
    "get_incident": sql("""
select incident_id, case when kpi_value > 60 then 'duplicate' else 'success' end lookup_status,
       case when kpi_value <= 60 then enodeb_id end enodeb_id, case when kpi_value <= 60 then cell_id end cell_id,
       case when kpi_value <= 60 then start_ts end start_ts, case when kpi_value <= 60 then end_ts end end_ts,
       case when kpi_value <= 60 then status end status, case when kpi_value <= 60 then description end description,
       case when kpi_value <= 60 then kpi_missed end kpi_missed
from candidates
union all
select c_name, 'not found', null, null, null, null, null, null, null from customer"""),
    "create_incidents": sql(f"""
select incident_id, start_ts, end_ts, status, description, kpi_missed, enodeb_id, cell_id,
       cast(null as varchar) severity, cast(null as varchar) preliminary_analysis,
       cast(null as varchar) final_analysis, cast(null as varchar) events, cast(null as varchar) cause,
       cast(null as varchar) resolution, 0 embedding_size
from candidates where {_OVERSHOOT} > 0.4 and kpi_value <= 60"""),
    "update_incidents": sql("""
select incident_id, case when kpi_value > 60 then 'ANALYZED' else 'NEW' end status,
       case when kpi_value > 60 then concat('report on ', description) end preliminary_analysis,
       case when kpi_value > 60 then 'HIGH' end severity, case when kpi_value > 60 then kpi_missed end events,
       case when kpi_value > 60 then 2 else 0 end embedding_size, cast(null as varchar) error
from candidates
union all
select incident_id, 'error', null, null, null, null, 'Failed to generate embeddings for the event.'
from candidates where kpi_value <= 60"""),
    "layout_partitioned": sql("""
select *, cast(starttime as date) date from cell_traces
where cast(starttime as date) between date '2024-01-05' and date '2024-01-25'"""),
    "refresh_kpi_view": sql("""
select enodeb_id, cell_id, measurement_end, round(erab_success_rate, 6) erab_success_rate,
       round(retainability, 6) retainability from performance_kpi"""),
    "erab_success_rate": sql("select enodeb_id, cell_id, measurement_end, round(erab_success_rate, 6) erab_success_rate from performance_kpi"),
    "retainability": sql("select enodeb_id, cell_id, measurement_end, round(retainability, 6) retainability from performance_kpi"),
    "performance_kpi": sql("""
select enodeb_id, cell_id, measurement_end, round(erab_success_rate, 6) erab_success_rate,
       round(retainability, 6) retainability from performance_kpi"""),
    "missed_kpis": sql("select enodeb_id, cell_id, measurement_end, kpi, round(kpi_value, 6) kpi_value from missed"),
    "detect_incidents": sql("select enodeb_id, cell_id, description, kpi, round(kpi_value, 6) kpi_value, started, ended from detected"),
    "incident_candidates": sql("""
select incident_id, start_ts, end_ts, status, description, enodeb_id, cell_id, kpi, kpi_value from candidates"""),
    "prioritize_incidents": sql(f"""
select incident_id, severity, round(overshoot, 6) overshoot,
       row_number() over (order by case severity when 'HIGH' then 0 else 2 end, overshoot desc, incident_id) priority
from (select incident_id, {_SEVERITY_ONLY_KPI} severity, {_OVERSHOOT} overshoot from candidates)"""),
    "detect_incidents_sessions": sql("""
select s.enodeb_id, s.cell_id, t.description, s.kpi, round(avg(kpi_value), 6) kpi_value,
       min(measurement_end) started, max(measurement_end) ended, count(*) violations
from (select *, sum(opens) over (partition by enodeb_id, cell_id, kpi order by measurement_end) island
      from (select *, case when measurement_end > lag(measurement_end) over
                (partition by enodeb_id, cell_id, kpi order by measurement_end) + interval 2 days
              then 1 else 0 end opens from missed)) s
join kpi_text t on s.kpi = t.kpi
group by s.enodeb_id, s.cell_id, s.kpi, s.island, t.description"""),
    "detect_incidents_stream": sql("""
select s.enodeb_id, s.cell_id, t.description, s.kpi, round(avg(kpi_value), 6) kpi_value,
       min(measurement_end) started, max(measurement_end) ended, count(*) violations
from (select *, sum(opens) over (partition by enodeb_id, cell_id, kpi order by measurement_end) island
      from (select *, case when measurement_end > lag(measurement_end) over
                (partition by enodeb_id, cell_id, kpi order by measurement_end) + interval 2 days
              then 1 else 0 end opens from missed)) s
join kpi_text t on s.kpi = t.kpi
group by s.enodeb_id, s.cell_id, s.kpi, s.island, t.description
having max(measurement_end) + interval 2 days <= (select max(measurement_end) from performance) - interval 1 day"""),
    "match_rules": sql("select incident_id, rule_id, processing_rule from matched"),
    "collect_rule_tools": sql("""
select incident_id, rules_status, processing_rules, severity_determination_rules,
       array_to_string(tools, ';') processing_rule_tools,
       array_to_string(severity_tools, ';') severity_determination_rule_tools from collected"""),
    "gate_tools": sql(f"select incident_id, {_gate('tools')} analysis_tools, {_gate('severity_tools')} severity_tools from collected"),
    "cell_trace_stats": sql("select * from stats"),
    "cell_trace_stats_sweep": sql("select * from stats"),
    "outcome_share": sql("""
select incident_id, connection_outcome, n,
       round(n * 100.0 / sum(n) over (partition by incident_id), 6) pct,
       round(sum(case when connection_outcome like '%SECURITY%' then n else 0 end) over (partition by incident_id)
             * 100.0 / sum(n) over (partition by incident_id), 6) security_failure_pct
from stats"""),
    "security_failure_devices": sql("""
select incident_id, imsi, imeisv, count(*) failures,
       cast(row_number() over (partition by incident_id order by count(*) desc, imsi, imeisv) as integer) as "position"
from inside where connection_outcome like '%SECURITY%' group by incident_id, imsi, imeisv
qualify "position" <= 10"""),
    "uplink_rssi": sql("select incident_id, enodeb_id, cell_id, round(uplink_rssi, 6) uplink_rssi from rssi"),
    "uplink_configuration": sql("select incident_id, enodeb_id, cell_id, pZeroNominalPucch, pZeroNominalPusch from config"),
    "rssi_out_of_range": sql("""
select incident_id, enodeb_id, cell_id, round(uplink_rssi, 6) uplink_rssi,
       not (uplink_rssi between -120 and -114) out_of_range from rssi"""),
    "config_deviation": sql("""
select incident_id, enodeb_id, cell_id, pZeroNominalPucch, pZeroNominalPusch,
       round(pZeroNominalPucch_deviation, 6) pZeroNominalPucch_deviation, pZeroNominalPucch_deviation > 0.05 pZeroNominalPucch_off,
       round(pZeroNominalPusch_deviation, 6) pZeroNominalPusch_deviation, pZeroNominalPusch_deviation > 0.05 pZeroNominalPusch_off
from config"""),
    "analyze_incidents": sql("select incident_id, causes, asking_rules, analysis from analyzed"),
    "classify_severity": sql("select incident_id, severity_level, severity_level_explanation from severity"),
    "suggest_actions": sql(f"""
select incident_id, concat_ws(';', case when earlier then 'open_ticket/EXECUTED' end,
       case when adjust then concat('{ADJUST}/SUGGESTED/', enodeb_id, '/', cell_id) end) actions from acting"""),
    "split_actions": sql(f"""
select incident_id, 'other' listing, 'open_ticket' tool_name, cast(null as varchar) reason_to_perform,
       '' parameters, 'EXECUTED' status, cast(null as varchar) message from acting where earlier
union all
select incident_id, 'suggested', '{ADJUST}', 'The uplink configuration differs from the optimum by more than 5%',
       concat(enodeb_id, '/', cell_id), 'SUGGESTED', null from acting where adjust
union all
select incident_id, 'none', null, null, '', null, {_quoted(NO_ACTIONS)} from acting where not earlier and not adjust"""),
    "actions_toolset": sql(f"select incident_id, case when adjust then '{ADJUST}' else '' end action_tools from acting"),
    "issue_adjustments": sql(f"""
select sha256(concat(incident_id, '|{ADJUST}|cell_id=', cell_id, '|enodeb_id=', enodeb_id)) request_id, incident_id, '{ADJUST}' tool_name,
       enodeb_id, cell_id, {_quoted(ADJUSTMENT_ISSUED)} details from acting where adjust and kpi_value < 40"""),
    "embed_events": """
with counts as (
  select doc_id, cast(('0x' || substr(md5(tok), 1, 8))::bigint % 64 as integer) dim, count(*) n
  from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) tok from documents) group by all)
select d.doc_id, c.dim, round(c.n / sqrt(sum(c.n * c.n) over (partition by d.doc_id)), 6) weight
from documents d left join counts c on d.doc_id = c.doc_id""",
    "nonempty_embeddings": """
select d.doc_id, d.lang, cast(len(e.embedding) as integer) dim from documents d join embeddings e on d.doc_id = e.vec_id
where len(e.embedding) > 0""",
    "vector_topk": sql(f"""
select query_id, base_id, {_DISTANCE}, rank, concat('events of ', base_id) events, concat('cause ', label) cause from topk"""),
    "vector_topk_lsh": f"""
with placed as (
  select vec_id, embedding::double[] v, unnest([{_buckets()}]) bucket, unnest(range(6)) hash_table from embeddings),
near as (
  select distinct q.vec_id query_id, b.vec_id base_id, list_distance(b.v, q.v) distance
  from placed q join placed b on q.hash_table = b.hash_table and q.bucket = b.bucket and q.vec_id <> b.vec_id)
select query_id, base_id, {_DISTANCE},
       cast(row_number() over (partition by query_id order by round(distance, 9), base_id) as integer) rank
from near qualify rank <= 5""",
    "distance_cutoff": sql(f"select query_id, base_id, {_DISTANCE}, rank from topk_others where distance <= 1.2"),
    "match_label": sql(f"""
select query_id, base_id, {_DISTANCE}, rank,
       case when distance < 1.1 then 'likely match' else 'somewhat similar' end "match" from topk_others"""),
    "format_prior_incidents": sql(f"""
select e.vec_id incident_id,
       case when count(m.base_id) = 0 then 'no similar incidents found' else 'success' end prior_incidents_status,
       coalesce(string_agg(m.block, chr(10) order by m.rank), '') prior_incidents
from embeddings e left join (select *, {_BLOCK} block from topk_others where distance <= 1.2) m on e.vec_id = m.query_id
group by e.vec_id"""),
    "search_rules": _with(
        _bm25(
            "select doc_id, source, lang, n_chars, text as body, concat_ws(' ', source, text, lang, 'get_uplink_rssi_level', 'grade', lang) as text from documents",
            QUESTIONS, 10, CORRECTED_TERMS),
        """
select r.query_id, r.doc_id rule_id, r.score, r.rank, d.source description,
       concat('grade ', d.lang) severity_determination_rule, cast(length(d.body) as integer) processing_rule
from ranked r join docs d on r.doc_id = d.doc_id"""),
    "snippets": _with(
        _bm25("select doc_id, text from documents", QUESTIONS, 5),
        """
select query_id, doc_id, rank, substr(text, cast(greatest(1, place - 40) as bigint), 80) snippet
from (select r.query_id, r.doc_id, r.rank, any_value(d.text) as text,
             min(nullif(position(concat(' ', t.term, ' ') in concat(' ', regexp_replace(lower(d.text), '[^a-z0-9]', ' ', 'g'), ' ')), 0)) place
      from ranked r join docs d on r.doc_id = d.doc_id join terms t on t.query_id = r.query_id
      group by r.query_id, r.doc_id, r.rank)""",
    ),
    "passages": _with(
        _bm25("select doc_id, text from documents", QUESTIONS, 5) + PASSAGES,
        """
select query_id, doc_id, rank, passage, cast(first_token as integer) first_token, cast(last_token as integer) last_token,
       cast(distinct_terms as integer) distinct_terms from passages""",
    ),
    "spell_correct": """
with asked as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from conversations),
vocab as (select term, count(*) df from
  (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from benchmark) group by term),
pairs as (
  select a.term, v.term found, v.df, levenshtein(a.term, v.term) distance
  from asked a join vocab v on abs(length(a.term) - length(v.term)) <= 1 where levenshtein(a.term, v.term) <= 1),
best as (select *, row_number() over (partition by term order by distance, df desc, found) r from pairs qualify r = 1)
select a.term, b.found corrected, cast(b.distance as integer) distance from asked a left join best b on a.term = b.term""",
    "expand_query": """
with terms as (select distinct p_partkey query_id, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) term from part),
words as (select list_filter(string_split(p_name, ' '), lambda w: w <> '') w from part),
synonyms as (select distinct w[i] term, w[i + 1] related from words, unnest(range(1, len(w))) u(i))
select query_id, term from terms
union select t.query_id, s.related from terms t join synonyms s on t.term = s.term""",
    "internal_docs": _retrieval(INTERNAL_DOCS, INTERNAL_REFERENCE, NO_INTERNAL),
    "external_docs": _retrieval(PAGE_TEXT, "concat(d.url, ' ', d.title)", NO_EXTERNAL),
    "extract_references": sql(f"""
select case_id, 0 as "position", url, title from chunks where url is not null
union all
select case_id, case when url is null then 0 else 1 end, concat('{DOCUMENT_PREFIX}', doc_id), source
from chunks where doc_id is not null"""),
    "grounding_gate": sql(f"""
select coalesce(case_id, p_partkey) case_id,
       case when url is not null or doc_id is not null then concat('answer ', case_id) else {_quoted(NO_INTERNAL)} end answer,
       cast(case when url is not null then 1 else 0 end + case when doc_id is not null then 1 else 0 end as integer) n_references
from chunks full join part on case_id = p_partkey"""),
    "append_section": """
select conv_id, turn, concat(case when turn > 0 and text <> '' then concat(text, chr(10), chr(10)) else '' end,
       '**Role**', chr(10), role) events from conversations""",
    "general_info_section": sql("select incident_id, general_info from general"),
    "trace_section": sql("select incident_id, trace_statistics, trace_status from trace_texts"),
}

_LOG_BLOCK = """concat('*Incident ', base_id, '*', chr(10), '**Search distance**: ', cast(distance as varchar),
  ' (', case when distance < 0.4 then 'likely match' else 'somewhat similar' end, ')', chr(10),
  '**Events**', chr(10), events, chr(10), '**Final analysis**', chr(10), 'Not yet determined', chr(10),
  '**Cause**', chr(10), 'Not yet determined', chr(10), '**Resolution**', chr(10), 'Not yet determined', chr(10))"""
ORACLES["prior_incidents"] = sql(f"""
select c.incident_id,
       case when count(n.base_id) = 0 then 'no similar incidents found' else 'success' end prior_incidents_status,
       coalesce(string_agg(n.block, chr(10) order by n.distance, n.base_id), '') prior_incidents
from candidates c left join (select *, {_LOG_BLOCK} block from near_logs where distance <= 0.5) n
  on c.incident_id = n.incident_id
group by c.incident_id""")

_REPORT = _bm25(INTERNAL_DOCS, INCIDENT_QUESTIONS, 10) + PASSAGES + f""",
answers as (
  select r.query_id, string_agg(r.passage, chr(10) order by r.rank) answer,
         string_agg(concat('- [', d.title, '](', '{DOCUMENT_PREFIX}', d.doc_id, ')'), chr(10) order by r.rank) links
  from passages r join docs d on r.doc_id = d.doc_id group by r.query_id)"""
ORACLES["build_report"] = _with(_REPORT, f"""
select s.incident_id, concat_ws(chr(10) || chr(10),
  concat('## 1. Incident description', chr(10), s.description, chr(10), g.general_info),
  concat('## 2. Root cause analysis', chr(10), s.analysis),
  concat('## 3. Severity level', chr(10), s.severity_level, '. ', s.severity_level_explanation),
  concat('## 4. Similar prior incidents', chr(10), 'No relevant information.'),
  concat('## 5. Internal documentation', chr(10), coalesce(a.answer, {_quoted(NO_INTERNAL)})),
  concat('## 6. External documentation', chr(10), 'No relevant information.'),
  concat('## 7. Recommendations', chr(10), case when x.adjust then
    '{ADJUST} (SUGGESTED): The uplink configuration differs from the optimum by more than 5%' else 'No relevant information.' end),
  concat('## 8. References', chr(10), coalesce(a.links, 'No relevant information.'))) report
from severity s join general g on s.incident_id = g.incident_id
join acting x on x.incident_id = s.incident_id
left join answers a on a.query_id = concat(s.description, ' ', s.kpi)""")

# The same results by another way.
ORACLES["upsert_rules_files"] = ORACLES["upsert_rules"]
ORACLES["update_incidents_files"] = ORACLES["update_incidents"]
ORACLES["merge_kpi_view"] = ORACLES["refresh_kpi_view"]
ORACLES["detect_incidents_state"] = sql("""
select s.enodeb_id, s.cell_id, t.description, s.kpi, s.status, round(s.kpi_value, 6) kpi_value, s.started, s.ended, s.violations
from (
  select enodeb_id, cell_id, kpi,
         case when max(measurement_end) + interval 2 days <= (select max(measurement_end) from performance) - interval 1 day
              then 'closed' else 'open' end status,
         avg(kpi_value) kpi_value, min(measurement_end) started, max(measurement_end) ended, count(*) violations
  from (select *, sum(opens) over (partition by enodeb_id, cell_id, kpi order by measurement_end) island
        from (select *, case when measurement_end > lag(measurement_end) over
                  (partition by enodeb_id, cell_id, kpi order by measurement_end) + interval 2 days then 1 else 0 end opens
              from missed where measurement_end >= date '2024-01-10'))
  group by enodeb_id, cell_id, kpi, island
  union all
  select enodeb_id, cell_id, kpi, 'late', kpi_value, measurement_end, measurement_end, 1
  from missed where measurement_end < date '2024-01-10') s
join kpi_text t on s.kpi = t.kpi""")
ORACLES["insert_incidents_default"] = sql("""
select incident_id, start_ts, end_ts, status, description, enodeb_id, cell_id, 0 embedding_size, true created_now, true no_severity from candidates""")
ORACLES["case_state"] = sql("""
select incident_id, kpi_value > 60 damaged,
       case when kpi_value <= 60 then start_ts end start_ts, case when kpi_value <= 60 then end_ts end end_ts,
       case when kpi_value <= 60 then status end status, case when kpi_value <= 60 then description end description,
       case when kpi_value <= 60 then enodeb_id end enodeb_id, case when kpi_value <= 60 then cell_id end cell_id,
       case when kpi_value <= 60 then kpi_missed end kpi_missed,
       case when kpi_value > 60 then null when kpi_value > 40 then '{"shift":{"from":22,"name":"night"}}' else '{}' end as unknown
from candidates""")
ORACLES["cell_trace_levels"] = sql("""
select start_enodeb_id, start_cell_id, pZeroNominalPucch, count(*) traces, max(starttime) last_start
from cell_traces join cell_config on start_enodeb_id = enodeb_id and start_cell_id = cell_id
group by all""")
_MINED = """
toks as (select regexp_extract_all(lower(text), '[a-z0-9]+') w from documents),
pairs as (
  select least(a, b) a, greatest(a, b) b
  from (select w[i] a, w[i + d] b from toks, unnest(range(1, len(w))) u(i), unnest(range(1, 5)) v(d) where i + d <= len(w))
  where a <> b),
met as (select a, b, count(*) n from pairs group by a, b),
both_ways as (select a term, b related, n from met union all select b, a, n from met),
of_term as (select term, sum(n) c from both_ways group by term),
informed as (
  select p.term, p.related, p.n, round(ln(p.n * (select sum(c) from of_term)::double / (x.c::double * y.c)), 6) information
  from both_ways p join of_term x on x.term = p.term join of_term y on y.term = p.related where p.n >= 5),
mined as (
  select * from informed where information >= 0.5
  qualify row_number() over (partition by term order by information desc, n desc, related) <= 3)"""
ORACLES["mine_related"] = f"with {_MINED} select term, related, n, information from mined"
ORACLES["expand_query_mined"] = f"""
with {_MINED},
asked as (select distinct item_id query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term from benchmark)
select query_id, term from asked union select a.query_id, m.related from asked a join mined m on a.term = m.term"""


def _answers(docs: str, link: str) -> str:
    return f"""(with {_bm25(docs, INCIDENT_QUESTIONS, 10)} {PASSAGES}
  select r.query_id, string_agg(r.passage, chr(10) order by r.rank) answer,
         string_agg(concat('- [', d.title, '](', {link}, ')'), chr(10) order by r.rank) links
  from passages r join docs d on r.doc_id = d.doc_id group by r.query_id)"""


# Severity rules see the uplink level only where the incident's rules ask for it.
ORACLES["analyse_incidents"] = sql(f"""
select s.incident_id, case s.hit when 3 then 'MEDIUM' when 1 then 'HIGH' when 2 then 'HIGH' when 4 then 'HIGH' else 'LOW' end severity,
       l.events, 64 embedding_size, concat_ws(chr(10) || chr(10),
  concat('## 1. Incident description', chr(10), s.description, chr(10), g.general_info),
  concat('## 2. Root cause analysis', chr(10), s.analysis),
  concat('## 3. Severity level', chr(10),
    case s.hit when 3 then 'MEDIUM' when 1 then 'HIGH' when 2 then 'HIGH' when 4 then 'HIGH' else 'LOW' end, '. ',
    case s.hit when 1 then concat('erab_success_rate = ', cast(s.kpi_value as varchar), ' is lt 50.0')
               when 2 then concat('retainability = ', cast(s.kpi_value as varchar), ' is gt 40.0')
               when 3 then concat('uplink_rssi = ', cast(s.rssi as varchar), ' is lt -116.0')
               when 4 then concat('uplink_rssi = ', cast(s.rssi as varchar), ' is gt -112.0')
               else concat('no severity rule holds for ', s.kpi) end),
  concat('## 4. Similar prior incidents', chr(10), coalesce(p.prior, 'No relevant information.')),
  concat('## 5. Internal documentation', chr(10), coalesce(a.answer, {_quoted(NO_INTERNAL)})),
  concat('## 6. External documentation', chr(10), coalesce(b.answer, {_quoted(NO_EXTERNAL)})),
  concat('## 7. Recommendations', chr(10), case when x.adjust then
    '{ADJUST} (SUGGESTED): The uplink configuration differs from the optimum by more than 5%' else 'No relevant information.' end),
  concat('## 8. References', chr(10), coalesce(concat_ws(chr(10), a.links, b.links), 'No relevant information.'))) report
from (
  select z.*, case when z.kpi = 'erab_success_rate' then case when z.kpi_value < 50 then 1 end
                   when z.kpi_value > 40 then 2
                   when list_contains(k.severity_tools, 'get_uplink_rssi_level') and z.rssi < -116 then 3
                   when list_contains(k.severity_tools, 'get_uplink_rssi_level') and z.rssi > -112 then 4 end hit
  from analyzed z join collected k on k.incident_id = z.incident_id) s
join general g on s.incident_id = g.incident_id
join acting x on x.incident_id = s.incident_id
join logs l on l.incident_id = s.incident_id
left join (select incident_id, string_agg({_LOG_BLOCK}, chr(10) order by distance, base_id) prior
           from near_logs where distance <= 0.5 group by incident_id) p on p.incident_id = s.incident_id
left join {_answers(INTERNAL_DOCS, f"concat('{DOCUMENT_PREFIX}', d.doc_id)")} a on a.query_id = concat(s.description, ' ', s.kpi)
left join {_answers(PAGE_TEXT, "d.url")} b on b.query_id = concat(s.description, ' ', s.kpi)""")
