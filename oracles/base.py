"""DuckDB building blocks: common table expressions, and their assembly into one statement.

They restate each operator by brute force (every alias at every offset, every state pattern by itself),
so that they share no method with the Spark side. Distinct texts are worked on once and joined back.
"""

from __future__ import annotations

import re

from riskloom.packs import patterns as P
from riskloom.packs import scoring as S
from riskloom.packs import wording as W
from riskloom.packs.gazetteer import DEFAULT_GAZETTEERS, IMPLIED_HAZARDS
from riskloom.packs.rules import DEFAULT_RULES, SEVERITY_LABELS
from riskloom.plans.corpus import BLANKS, PLACES, STATES, TASKS, VARIED, VARIED_AT, phrases


def q(value) -> str:
    """A SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, float):
        return f"{value!r}::double"
    return str(value)


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"select * from (values {body}) as v({columns})"


def pick(key: str, table: dict, default=None) -> str:
    cases = " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items())
    return f"(case {key} {cases} else {q(default)} end)"


def part(parts: tuple[str, ...]) -> str:
    cases = " ".join(f"when {i} then {q(p)}" for i, p in enumerate(parts))
    return f"case o_orderkey % {len(parts)} {cases} end"


def re2(phrase: str) -> str:
    return r"\s+".join(re.escape(w).replace(r"\-", "-") for w in phrase.split(" "))


def say(template: str, **names: str) -> str:
    """A template as SQL concatenation (null when a value is null)."""
    pieces = re.split(r"\{(\w+)\}", template)
    out = []
    for i, piece in enumerate(pieces):
        if i % 2:
            out.append(f"({names[piece]})")
        elif piece:
            out.append(q(piece))
    return "(" + " || ".join(out) + ")"


CTE: dict[str, str] = {}


def _varied() -> str:
    """The varied texts, from the same lists of phrases and blanks."""
    known = phrases()
    j = f"(o_orderkey // {VARIED})"
    items = "[" + ", ".join(q(p) for p in known) + "]"
    text = f"'Crew noted ' || {items}[1 + {j} % {len(known)}] || ' and ' || {items}[1 + ({j} * 7 + 3) % {len(known)}] || '.'"
    blanks = "[" + ", ".join("'" + b.replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '") + "'" for b in BLANKS) + "]"
    return (f"case when {j} % 50 = 9 then {blanks}[1 + {j} % {len(BLANKS)}] when {j} % 5 = 0 then upper({text}) "
            f"when {j} % 7 = 1 then replace({text}, 'Crew ', 'Crew ' || chr(9) || ' ') else {text} end")

CTE["reports"] = f"""
select 'REP-' || o_orderkey::varchar as report_id, o_orderkey as pos,
  case when o_orderkey % {VARIED} = {VARIED_AT} then {_varied()}
    else ({part(TASKS)}) || ' ' || ({part(PLACES)}) || ' ' || ({part(STATES)}) || '.' end as report_text,
  'near_miss' as report_type, o_orderdate as created_at,
  case when o_orderkey % 5 = 0 then 'box-' || (o_orderkey % 100)::varchar || '.txt' end as source_file_name
from orders"""

CTE["reviews"] = """
select 'REP-' || o_orderkey::varchar as report_id, 'HSE-' || (o_custkey % 20)::varchar as reviewer_id,
  case o_orderkey % 3 when 0 then 'confirmed' when 1 then 'corrected' else 'rejected' end as decision,
  case when o_orderkey % 3 = 1 then case when o_orderpriority in ('1-URGENT','2-HIGH') then 'HIGH'
    when o_orderpriority = '3-MEDIUM' then 'MEDIUM' else 'LOW' end end as corrected_priority,
  case when o_orderkey % 3 = 1 and o_orderkey % 4 = 0 then 'Hot Work' end as corrected_activity,
  case when o_orderkey % 3 = 1 and o_orderkey % 5 = 0 then 'Struck-By' end as corrected_hazard,
  case when o_orderkey % 3 = 1 and o_orderkey % 7 = 0 then 'PPE' end as corrected_barrier,
  case when o_orderkey % 2 = 0 then 'checked on site' end as comments,
  o_orderdate + interval '2' day as reviewed_at
from orders where o_orderstatus = 'F'
union all
select 'REP-' || o_orderkey::varchar, 'HSE-LEAD', 'confirmed', null, null, null, null, null,
  o_orderdate + interval '5' day
from orders where o_orderstatus = 'F' and o_orderkey % 10 = 0"""

CTE["feedback"] = """
select 'FB-' || event_id::varchar as feedback_id, 'REP-' || (event_id * 2)::varchar as report_id,
  case when user_id % 2 = 0 then 'U-' || user_id::varchar end as user_id,
  case event_type when 'error' then 'false_positive' when 'purchase' then 'false_negative'
    when 'click' then 'label_correction' else 'general_feedback' end as feedback_type,
  case when event_type = 'error' then 'LOW' end as user_suggested_priority, props as notes, ts as created_at
from events"""
CTE["arrivals"] = """
select 'REP-' || (user_id * 100)::varchar as report_id, event_type || ' noted in step ' || event_id::varchar as report_text,
  'Unit ' || (event_id % 9)::varchar as location, 'near_miss' as report_type, ts as created_at, event_id as seq
from events"""
CTE["action_events"] = """
select 'ACT-REP-' || user_id::varchar as action_id, event_id as seq,
  case event_type when 'click' then 'Assigned' when 'signup' then 'In Progress' when 'purchase' then 'Verification'
    when 'error' then 'Closed' else 'Open' end as status,
  case when event_type = 'click' then 'HSE-' || (event_id % 20)::varchar end as assigned_to
from events"""
CTE["labelled"] = """
select 'DOC-' || d.doc_id::varchar as report_id, d.text as report_text, l.quality::int as sif_precursor,
  'Inspection & Audit' as activity, case when d.doc_id % 3 != 0 then 'Fire / Explosion' end as hazard, 'PPE' as barrier,
  d.lang as location, case d.doc_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'severe' end as severity,
  d.source as source
from documents d join labels l using (doc_id)"""
CTE["predicted"] = """
select doc_id, quality::int as y_true, ((doc_id * 37) % 101) / 100.0::double as y_prob,
  (((doc_id * 37) % 101) / 100.0::double >= 0.5)::int as y_pred
from labels"""

CTE["texts"] = "select distinct report_text as t, lower(report_text) as lt from reports"

_ranked = sorted(enumerate(DEFAULT_RULES), key=lambda r: (-r[1].severity, r[0]))
CTE["rule_list"] = values(
    [(place, i, r.id, r.name, r.category, r.severity, SEVERITY_LABELS[r.severity]) for place, (i, r) in enumerate(_ranked)],
    "place, rpos, rule_id, rule_name, category, severity, severity_label",
)
CTE["signal_list"] = values(
    [(r.id, i, s) for r in DEFAULT_RULES for i, s in enumerate(r.signals)], "rule_id, spos, signal"
)
CTE["hits"] = "select t, rule_id, spos, signal from texts join signal_list on contains(lt, lower(signal))"
CTE["fired"] = """
select t, r.*, string_agg(signal, '", "' order by spos) as quoted,
  string_agg(signal, '; ' order by spos) as signals, list(signal order by spos) as signal_list
from hits join rule_list r using (rule_id) group by all"""
CTE["rollup"] = """
select t.t, coalesce(max(severity), 0) as severity, coalesce(count(rule_id), 0) as n_rules,
  list(rule_name order by place) filter (rule_name is not null) as rule_names,
  list(severity_label order by place) filter (rule_name is not null) as rule_labels,
  string_agg(rule_id, '; ' order by place) as rule_ids,
  flatten(list(signal_list order by place) filter (rule_name is not null)) as signals,
  coalesce(string_agg(rule_name || ' (' || severity_label || '): triggered by "' || quoted || '"', ' | '
    order by place), case when regexp_full_match(t.t, '\\s*') then 'Empty report text. No rules evaluated.'
    else 'No SIF precursor signals detected by rule engine.' end) as evidence_summary
from texts t left join fired f using (t) group by t.t"""

CTE["alias_list"] = values(
    [
        (g.kind, g.confidence, i, t.canonical, t.category, a)
        for g in DEFAULT_GAZETTEERS
        for i, (t, a) in enumerate((t, a) for t in g.terms for a in t.aliases)
    ],
    "kind, confidence, apos, canonical, category, alias",
)
# Every alias at every offset where it stands on word boundaries.
CTE["occurrences"] = r"""
select t, kind, confidence, apos, canonical, category, i as s, i + length(alias) as e
from (select *, unnest(range(0, length(t) - length(alias) + 1)) as i
      from texts join alias_list on contains(lt, alias))
where substring(lt, i + 1, length(alias)) = alias
  and not regexp_matches(case when i = 0 then ' ' else substring(t, i, 1) end, '^\w')
  and not regexp_matches(substring(t || ' ', i + length(alias) + 1, 1), '^\w')"""
CTE["greedy"] = """
select t, kind, s, e, confidence, canonical, category from (
  select *, row_number() over (partition by t, kind order by s, e desc, apos) as rn from occurrences) where rn = 1
union all
select t, kind, s, e, confidence, canonical, category from (
  select o.*, row_number() over (partition by o.t, o.kind order by o.s, o.e desc, o.apos) as rn
  from greedy g join occurrences o on o.t = g.t and o.kind = g.kind and o.s >= g.e) where rn = 1"""
CTE["gaz"] = "select distinct *, substring(t, s + 1, e - s) as surface from greedy"

_jobs = (
    [("activity", p, v, P.ACTIVITY_CONFIDENCE) for _, p, v in P.ACTIVITY_PATTERNS]
    + [("equipment", p, None, P.EQUIPMENT_CONFIDENCE) for _, p in P.EQUIPMENT_PATTERNS]
    + [("location", p, None, P.LOCATION_CONFIDENCE) for _, p in P.LOCATION_PATTERNS]
)


def _grouped(p: str) -> bool:
    return bool(re.search(r"\((?!\?)", p))


CTE["phrase_list"] = values(
    [(i, k, "(?i)" + (p if _grouped(p) else f"({p})"), v, c) for i, (k, p, v, c) in enumerate(_jobs)],
    "ord, kind, re, value, confidence",
)


def _spans(source: str, extra: str) -> str:
    """Offsets of all matches of the regex ``re`` in ``t``."""
    return f"""
select {extra}, whole, grp,
  list_sum([length(x) for x in pieces[1:k]])::bigint
    + coalesce(list_sum([length(x) for x in wholes[1:k-1]]), 0)::bigint as s
from (select *, unnest(wholes) as whole, unnest(grps) as grp, unnest(range(1, len(wholes) + 1)) as k
  from (select *, regexp_extract_all(t, re, 0) as wholes, regexp_extract_all(t, re, 1) as grps,
          string_split_regex(t, re) as pieces
        from {source} where regexp_matches(t, re)))"""


CTE["phrases"] = f"""
select t, kind, ord::bigint as ord, value, confidence, whole, grp,
  case when kind = 'activity' then s else s + length(whole) - length(grp) end as s,
  s + length(whole) as e
from ({_spans('(select * from texts, phrase_list)', 't, kind, ord, value, confidence')})"""

_words = [(s, w) for s, g in P.STATUS_WORDS for w in g]
CTE["word_list"] = values([(i, s, re2(w)) for i, (s, w) in enumerate(_words)], "w, state, wre")
CTE["noun_list"] = values(
    [(i, b, "|".join(rf"\b{re2(n)}\b" for n in ns)) for i, (b, ns) in enumerate(P.BARRIER_NOUNS)], "b, barrier, bre"
)
_filler = "(?:" + "|".join(rf"{f}\s+" for f in P.PREFIX_FILLERS) + ")?"
_verb = "(?:" + "|".join(rf"{re2(v)}\s+" for v in P.POSTFIX_VERBS) + ")?"
CTE["state_jobs"] = f"""
select t, w, state, b, barrier, kind,
  case kind when 0 then '(?i)(\\b(?:' || wre || ')\\s+{_filler}(?:' || bre || '))'
    else '(?i)(\\b(?:' || bre || ')\\s+{_verb}(?:' || wre || ')\\b)' end as re
from texts join word_list on regexp_matches(lt, wre) join noun_list on regexp_matches(lt, bre)
  cross join (values (0), (1)) as k(kind)"""
CTE["states"] = f"""
select t, state, barrier, whole, s, s + length(whole) as e,
  1000 + (w * 11 + b) * 2 + kind as ord,
  case when kind = 1 then 0.90::double when state = 'Not Verified' then 0.94::double else 0.89::double end as confidence
from ({_spans('state_jobs', 't, w, state, b, barrier, kind')})"""

# Pattern spans in pattern order.
CTE["nlp"] = """
select *, row_number() over (partition by t order by ord, s) as n from (
  select t, kind, ord, s, e, confidence,
    trim(grp) as surface,
    case kind when 'activity' then value when 'equipment' then lower(trim(grp))
      else list_aggregate([upper(x[1]) || lower(x[2:]) for x in string_split(trim(grp), ' ')], 'string_agg', ' ')
    end as normalized_value,
    null::varchar as status from phrases
  union all
  select t, 'barrier', ord, s, e, confidence, whole, barrier, state from states)"""

CTE["reinforced"] = f"""
select g.t, g.kind, g.s, g.e, g.surface, g.canonical as normalized_value, g.category,
  round(case when near > 0 then least(0.98::double, g.confidence + 0.06::double) else g.confidence end, 2) as confidence,
  case when near > 0 then 'hybrid' else 'deterministic' end as source,
  case when g.kind = 'barrier' then state end as status
from gaz g left join (
  select g.t, g.kind, g.s, count(*) filter (abs(n.s - g.s) <= {P.REINFORCE_REACH}) as near,
    arg_min(n.status, n.n) filter (abs(n.s - g.s) <= {P.STATUS_REACH} and n.status is not null) as state
  from gaz g join nlp n on n.t = g.t and n.kind = g.kind group by all) x
  on x.t = g.t and x.kind = g.kind and x.s = g.s"""
# Pattern spans that overlap no gazetteer span, one by one in pattern order.
CTE["fresh"] = """
select *, row_number() over (partition by t order by n) as k from nlp n
where not exists (select 1 from reinforced r where r.t = n.t and r.kind = n.kind and r.e > n.s and r.s < n.e)"""
CTE["folded"] = """
select t, 0::bigint as k, []::struct(kind varchar, s bigint, e bigint, n bigint)[] as kept from texts
union all
select f.t, x.k, case when len([y for y in f.kept if y.kind = x.kind and y.e > x.s and y.s < x.e]) > 0 then f.kept
  else list_append(f.kept, {'kind': x.kind, 's': x.s, 'e': x.e, 'n': x.n}) end
from folded f join fresh x on x.t = f.t and x.k = f.k + 1"""
CTE["entities"] = """
select *, row_number() over (partition by t order by s, novel, tie, place) - 1 as span_pos from (
  select t, kind as entity_type, surface, normalized_value, category, s, e, confidence, source, status,
    0 as novel, kind as tie, 0 as place from reinforced
  union all
  select n.t, n.kind, n.surface, n.normalized_value, null, n.s, n.e, n.confidence, 'nlp_pattern', n.status, 1, '', n.n
  from nlp n join (select t, unnest(arg_max(kept, k)).n as n from folded group by t) f on f.t = n.t and f.n = n.n)"""
CTE["primaries"] = """
select t, entity_type, surface, normalized_value, category, s, e, confidence, status from (
  select *, row_number() over (partition by t, entity_type order by confidence desc, span_pos) as rn from entities)
where rn = 1"""

_window_cases = " ".join(
    "when " + " or ".join(f"contains(win, {q(w)})" for w in words) + f" then {q(label)}" for label, words in P.WINDOW_TESTS
)
_hazard_category = {t.canonical: t.category for g in DEFAULT_GAZETTEERS if g.kind == "hazard" for t in g.terms}
CTE["context"] = f"""
select t, activity, activity_confidence, coalesce(hazard0, implied) as hazard,
  case when hazard0 is not null then hcat else {pick('implied', _hazard_category)} end as hazard_category,
  case when hazard0 is not null then hconf when implied is not null then 0.7::double else 0::double end as hazard_confidence,
  barrier, case when barrier is not null then coalesce(bstatus, case {_window_cases} else 'Unknown' end) end as barrier_status,
  barrier_confidence, location, location_confidence,
  coalesce(equipment0, case when contains(lower(t), 'energized equipment') then 'energized equipment' end) as equipment,
  case when equipment0 is not null then econf when contains(lower(t), 'energized equipment') then 0.85::double
    else 0::double end as equipment_confidence
from (select *, {pick('barrier', IMPLIED_HAZARDS)} as implied,
        lower(substring(t, greatest(0, bs - 40) + 1, be + 40 - greatest(0, bs - 40))) as win
  from (select x.t,
    max(normalized_value) filter (entity_type = 'activity') as activity,
    coalesce(max(confidence) filter (entity_type = 'activity'), 0) as activity_confidence,
    max(normalized_value) filter (entity_type = 'hazard') as hazard0,
    max(category) filter (entity_type = 'hazard') as hcat,
    max(confidence) filter (entity_type = 'hazard') as hconf,
    max(normalized_value) filter (entity_type = 'barrier') as barrier,
    max(status) filter (entity_type = 'barrier') as bstatus,
    coalesce(max(confidence) filter (entity_type = 'barrier'), 0) as barrier_confidence,
    max(s) filter (entity_type = 'barrier') as bs, max(e) filter (entity_type = 'barrier') as be,
    max(normalized_value) filter (entity_type = 'location') as location,
    coalesce(max(confidence) filter (entity_type = 'location'), 0) as location_confidence,
    max(surface) filter (entity_type = 'equipment') as equipment0,
    max(confidence) filter (entity_type = 'equipment') as econf
  from texts x left join primaries p on p.t = x.t group by x.t))"""


def scored(source: str, probability: str, recurrence: str) -> str:
    """Scoring of rows that have severity, activity, hazard, barrier_status."""
    def sum_of(weights):
        names = ("model_probability", "rule_severity", "barrier_failure", "critical_hazard", "critical_activity")
        return " + ".join(f"{weights[n]!r}::double * {n}" for n in names)
    core = {k: v for k, v in S.WEIGHTS.items() if k != "recurring_pattern"}
    total = sum(core.values())
    return f"""
select *, round(least(1, greatest(0, raw)), 4) as f_model,
  case when severity >= 4 or critical then 'HIGH'
    when composite >= 0.65::double or raw >= 0.85::double then 'HIGH'
    when composite >= 0.35::double or raw >= 0.60::double then 'MEDIUM' else 'LOW' end as priority,
  round(case when severity >= 4 or critical then greatest(composite, 0.65::double + 0.05::double) else composite end, 4) as priority_score,
  (severity >= 4 or critical) as escalated,
  case when severity >= 4 then {q(W.ESCALATION_RULE)}
    when critical then {say(W.ESCALATION_BARRIER, hazard='hazard', status='barrier_status')} end as escalation_reason,
  round(raw, 4) as sif_probability
from (select *, least(1, greatest(0, case when recurrence is null then {sum_of({k: v / total for k, v in core.items()})}
      else {sum_of(core)} + 0.1::double * recurring_pattern end)) as composite,
    {pick('hazard', S.HAZARD_MULTIPLIERS, 0.0)} >= 0.95::double
      and coalesce(barrier_status in ('Not Verified', 'Failed', 'Absent'), false) as critical
  from (select *, least(1::double, greatest(0::double, raw)) as model_probability,
      severity / 4.0::double as rule_severity,
      {pick('barrier_status', S.BARRIER_PENALTIES, S.UNLISTED)} as barrier_failure,
      {pick('hazard', S.HAZARD_MULTIPLIERS, S.UNLISTED)} as critical_hazard,
      {pick('activity', S.ACTIVITY_MULTIPLIERS, S.UNLISTED)} as critical_activity,
      least(1::double, greatest(0::double, recurrence)) as recurring_pattern
    from (select *, {probability} as raw, ({recurrence})::double as recurrence from ({source}))))"""


FALLBACK = "case when regexp_full_match(t, '\\s*') then 0.0::double when severity > 0 then least(0.95::double, severity / 4.0::double * 0.8::double + 0.15::double) else 0.1::double end"
CTE["scored"] = scored(
    "select * from context join rollup using (t)", FALLBACK, "null"
)
CTE["evidenced"] = """
select s.*, evidence_list as evidence from scored s join (
  select t, list(item order by nth) as evidence_list from (
    select t, item, min(nth) as nth from (
      select t, unnest(signals) as item, unnest(range(1, len(signals) + 1)) as nth from rollup
      union all
      select t, surface, 100000 + span_pos from entities where confidence >= 0.85::double)
    group by t, item) group by t
  union all select t, []::varchar[] from texts x where not exists (select 1 from entities e where e.t = x.t and e.confidence >= 0.85::double)
    and not exists (select 1 from hits h where h.t = x.t)) using (t)"""

HAS_RULES = "n_rules > 0"


def explained(source: str = "evidenced", recurrence: str = "recurrence") -> str:
    names = dict(activity="activity", hazard="hazard", barrier="barrier", status="barrier_status", pct="pct",
                 recurrence="shown", reason="escalation_reason", priority="priority")

    def s(table, key, **more):
        return say(table[key], **(names | more))

    def barrier_line(table, **more):
        out = f"case when barrier is not null and barrier_status is not null then {s(table, 'barrier_and_status', **more)}"
        if "status_only" in table:
            out += f" when barrier_status is not null then {s(table, 'status_only', **more)}"
        return out + f" when barrier is not null then {s(table, 'barrier_only', **more)} end"

    def prob(table):
        return (f"case when raw >= 0.7::double then {s(table, 'probability_high')} when raw >= 0.4::double "
                f"then {s(table, 'probability_medium')} else {s(table, 'probability_low')} end")

    def lines(*items):
        return "list_filter([" + ", ".join(items) + "], lambda x: x is not null)"

    def rules(template):
        return f"[{say(template, rule='r')} for r in coalesce(rule_names, []::varchar[])]"

    low_status = dict(status="lower(barrier_status)")
    high = (
        f"{lines(s(W.WHY_HIGH, 'activity'), s(W.WHY_HIGH, 'hazard'), barrier_line(W.WHY_HIGH, **low_status))} || "
        f"{rules(W.WHY_HIGH['rule'])} || "
        + lines(f"case when raw >= 0.7::double then {s(W.WHY_HIGH, 'probability')} end", s(W.WHY_HIGH, "recurrence"),
                f"case when escalated then {s(W.WHY_HIGH, 'override')} end")
    )
    medium = (
        f"{lines(s(W.WHY_MEDIUM, 'activity'), s(W.WHY_MEDIUM, 'hazard'), barrier_line(W.WHY_MEDIUM))} || "
        f"(case when {HAS_RULES} then {rules(W.WHY_MEDIUM['rule'])} else [{q(W.WHY_MEDIUM['no_rule'])}] end) || "
        + lines(f"case when raw >= 0.4::double then {s(W.WHY_MEDIUM, 'probability')} end", s(W.WHY_MEDIUM, "recurrence"))
    )
    low = lines(
        s(W.WHY_LOW, "activity"), s(W.WHY_LOW, "hazard"),
        f"case when barrier is not null and lower(barrier_status) in ('verified', 'intact', 'present') "
        f"then {s(W.WHY_LOW, 'barrier_sound', **low_status)} else {q(W.WHY_LOW['controls'])} end",
        q(W.WHY_LOW["no_rule"]), s(W.WHY_LOW, "probability"),
    )
    reason = f"""case when escalated then escalation_reason
      when priority = 'HIGH' then case when {HAS_RULES} and raw >= 0.65::double then {s(W.REASONS, 'high_rules_and_probability')}
        when {HAS_RULES} then {s(W.REASONS, 'high_rules')}
        when barrier_status in ('Not Verified', 'Failed', 'Absent') then {s(W.REASONS, 'high_barrier')}
        else {s(W.REASONS, 'high_probability')} end
      when priority = 'MEDIUM' then case when {HAS_RULES} then {s(W.REASONS, 'medium_rules')}
        when raw >= 0.4::double then {s(W.REASONS, 'medium_probability')}
        when hazard is not null then {s(W.REASONS, 'medium_hazard')} else {s(W.REASONS, 'medium_other')} end
      else {s(W.REASONS, 'low')} end"""
    first_two = "array_to_string(rule_names[1:2], ', ')"
    drivers = lines(
        prob(W.DRIVERS),
        f"case when severity >= 3 then {s(W.DRIVERS, 'rules_severe', rules=first_two, label='rule_labels[1]')} "
        f"when {HAS_RULES} then {s(W.DRIVERS, 'rules_other', rules=first_two)} else {q(W.DRIVERS['no_rules'])} end",
        f"case when barrier is not null and barrier_status is not null then {s(W.DRIVERS, 'barrier')} || "
        f"coalesce({s(W.DRIVERS, 'barrier_hazard')}, '') || coalesce({s(W.DRIVERS, 'barrier_activity')}, '') "
        f"else {s(W.DRIVERS, 'hazard')} end",
        s(W.DRIVERS, "recurrence"),
        f"case when escalated then {s(W.DRIVERS, 'override')} end",
    )
    top_three = "array_to_string(evidence[1:3], ', ')"
    signals = lines(
        s(W.SIGNALS, "activity"), s(W.SIGNALS, "hazard"), barrier_line(W.SIGNALS), prob(W.SIGNALS),
        s(W.SIGNALS, "recurrence"),
        f"case when len(evidence) > 0 then {s(W.SIGNALS, 'evidence', evidence=top_three)} end",
    )
    return f"""
select *, headline || ' ' || 'Key drivers: ' ||
    array_to_string(['(' || k || ') ' || drivers[k] for k in range(1, len(drivers) + 1)], '; ') || '.' ||
    case when len(evidence) > 0 then ' Trigger evidence: ''' || array_to_string(evidence[1:4], ', ') || '''.' else '' end
    || ' ' || {q(W.CLOSING_LINE)} as explanation
from (select *, 'Priority: ' || priority || chr(10) || chr(10) || 'Why:' || chr(10) || '- ' ||
    array_to_string(why, chr(10) || '- ') as headline
  from (select *, case priority when 'HIGH' then {high} when 'MEDIUM' then {medium} else {low} end as why,
      {reason} as reason_text, {drivers} as drivers, {signals} as signal_lines,
      {barrier_line(W.BARRIER_LINES)} as barrier_line
    from (select *, printf('%.1f%%', raw * 100) as pct,
        case when {recurrence} >= 0.5 then printf('%.2f', {recurrence}) end as shown from {source})))"""


CTE["explained"] = explained()
CTE["decided"] = "select r.*, x.* exclude (t) from reports r join explained x on x.t = r.report_text"


# The list view and what hangs on it.
CTE["latest_review"] = """
select * exclude (rn) from (
  select *, row_number() over (partition by report_id order by reviewed_at desc, reviewer_id desc) as rn from reviews)
where rn = 1"""
CTE["routed"] = """
select d.*, location as extracted_location,
  case priority when 'HIGH' then 'HSE_REVIEW_REQUIRED' when 'MEDIUM' then 'ROUTINE_MONITORING' else 'CONTROLLED' end as status0,
  coalesce(location, 'Unknown') as site
from decided d"""
CTE["resolved"] = """
select r.*, v.decision, v.reviewer_id, v.reviewed_at, v.comments, v.corrected_priority, v.corrected_activity,
  v.corrected_hazard, v.corrected_barrier,
  case when v.decision is null then status0 else 'REVIEWED_' || upper(v.decision) end as workflow_status,
  case when v.decision = 'rejected' then 'LOW' when v.decision = 'corrected' then coalesce(v.corrected_priority, priority)
    else priority end as final_priority
from routed r left join latest_review v using (report_id)"""
CTE["summary"] = """
select report_id, report_text, report_type, created_at, pos, final_priority, priority_score, sif_probability,
  coalesce(corrected_activity, activity) as final_activity, coalesce(corrected_hazard, hazard) as final_hazard,
  coalesce(corrected_barrier, barrier) as final_barrier, barrier_status, site as location, n_rules,
  decision is not null as hse_reviewed, decision as review_decision, reviewer_id, priority as ai_priority,
  activity as ai_activity, hazard as ai_hazard, barrier as ai_barrier, workflow_status,
  priority = 'HIGH' and decision is null as in_review_queue, workflow_status = 'HSE_REVIEW_REQUIRED' as alert_triggered,
  explanation,
  row_number() over (order by created_at desc, priority_score desc, report_id) as seq
from resolved"""
CTE["alerts"] = f"""
select 'ALT-' || report_id as alert_id, report_id, {q(W.ALERT_TITLE)} as title, 'HIGH' as severity,
  {say(W.ALERT_MESSAGE, report='report_id', pct="printf('%.1f%%', sif_probability * 100)",
       hazard="coalesce(hazard, 'Unspecified')", barrier="coalesce(barrier, 'Unspecified')",
       status="coalesce(barrier_status, 'Unknown')")} as message,
  case when decision is null then 'HSE_REVIEW_REQUIRED' else workflow_status end as workflow_status,
  decision is not null as acknowledged, created_at
from resolved where priority = 'HIGH'"""
CTE["actions"] = f"""
select 'ACT-' || report_id as action_id, report_id,
  {say(W.ACTION_TITLE, barrier="coalesce(corrected_barrier, barrier, 'critical controls')",
       hazard="coalesce(corrected_hazard, hazard, 'identified hazard')")} as title,
  final_priority as priority, 'Open' as status, site as site_location, reviewed_at as created_at
from resolved where decision in ('confirmed', 'corrected') and final_priority = 'HIGH'"""

RECURSIVE = {"greedy", "folded"}


def sql(body: str, extra: dict[str, str] | None = None, recursive: tuple[str, ...] = ()) -> str:
    """Prefix ``body`` with the expressions it needs, in dependency order."""
    known = CTE | (extra or {})
    ordered: list[str] = []

    def need(text: str, stack: tuple[str, ...] = ()):
        for name in known:
            if name in ordered or name in stack:
                continue
            if re.search(rf"(?<![\w.']){name}(?![\w('])", text):
                need(known[name], (*stack, name))
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body
    parts = ", ".join(
        f"{n} as ({known[n]})" if n in RECURSIVE or n in recursive else f"{n} as materialized ({known[n]})" for n in ordered
    )
    return f"with recursive {parts} {body}"
