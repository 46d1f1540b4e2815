"""The synthesised review store in SQL."""

STORE = """
findings as (select id, run_id, model_name, rule_id, severity, confidence, note, disposition, created_at, reach,
  substr(sha256(concat_ws('\\x1f', 'ledger', rule_id, model_name, trim(regexp_replace(note, '\\s+', ' ', 'g')))), 1, 32) as fingerprint
  from (select event_id as id, event_id % 40 + 1 as run_id, 'm' || (user_id % 12) as model_name, list_extract(['F1001','F2001','F3001','F4002','F8002','F9007','F6001'], event_id % 7 + 1) as rule_id,
    list_extract(['critical','high','medium','low','info'], event_id % 11 % 5 + 1) as severity, list_extract(['measured','proven','likely','possible'], event_id % 4 + 1) as confidence,
    event_type || '  moved ' || (event_id % 3) as note, list_extract(['dismissed','accepted','fixed','deferred'], event_id % 9 + 1) as disposition, ts as created_at, event_id % 23 as reach from events)),
runs as (select run_id as id, 'p' || (run_id % 3) as project, case when run_id % 9 = 0 then 'failed' when run_id % 10 = 0 then 'queued' when run_id % 11 = 0 then 'running' else 'succeeded' end as status,
  run_id % 2 = 0 as executed, created_at, created_at + to_minutes(run_id) as heartbeat_at, run_id + 100 as pr_number, run_id * 3 % 17 + 1 as models_reviewed from (select run_id, max(created_at) as created_at from findings group by run_id)),
decisions as (select id * 2 as id, id as finding_id, disposition, 'u' || (id % 5) as actor, created_at + interval 1 hour as decided_at from findings where disposition is not null
  union all select id * 2 + 1, id, 'accepted', 'u9', created_at + interval 2 hour from findings where disposition is not null and id % 5 = 0),
calls as (select id + 1 as id, run_id, fingerprint, list_extract(['specialist','supervisor'], id % 2 + 1) as seat, id % 4 <> 0 as accepted from findings where id % 3 = 0),
grains as (select model_name, run_id, cast(count(*) as double) / count(distinct rule_id) as rows_per_key from findings group by model_name, run_id)
"""


def store(body: str) -> str:
    return f"with {STORE} {body}"
