"""SQL of the registered queries, written independently of them.

``VIEWS`` restates the projections of ``views.py``; a query's text names the views that it needs
and gets them, and those that they need, as common table expressions.
"""

from __future__ import annotations

import re

DAY = 86_400_000_000
HOUR = 3_600_000_000
NOW = 896_659_200_000_000
NOW_E = 1_706_659_200_000_000

VIEWS = {
    "jobs_v": """
        SELECT o_orderkey AS job_id, o_custkey AS task_id, st AS status,
               CASE WHEN act THEN o_custkey % 150 END AS owner_worker_id, o_orderkey % 3 + 1 AS fencing_token,
               CASE WHEN act THEN epoch_us(o_orderdate) END AS lease_acquired_at,
               epoch_us(o_orderdate) + (o_orderkey % 30 + 1) * {DAY} AS lease_expires_at, epoch_us(o_orderdate) AS created_at
        FROM (SELECT *, st IN ('RUNNING', 'CLAIMED', 'COMMITTING') AS act FROM (
            SELECT *, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'P' THEN 'PENDING' ELSE
              CASE o_orderpriority WHEN '1-URGENT' THEN 'RUNNING' WHEN '2-HIGH' THEN 'CLAIMED' WHEN '3-MEDIUM' THEN 'COMMITTING'
                WHEN '4-NOT SPECIFIED' THEN 'FAILED' WHEN '5-LOW' THEN 'UNCERTAIN' END END AS st FROM orders))""",
    "progress_v": """
        SELECT jobs_v.*, progress_done, progress_total, progress_updated_at FROM jobs_v LEFT JOIN (
          SELECT l_orderkey AS k, count(*) FILTER (WHERE l_linestatus = 'F') AS progress_done, count(*) AS progress_total,
                 max(epoch_us(l_shipdate)) FILTER (WHERE l_linestatus = 'F') AS progress_updated_at
          FROM lineitem GROUP BY l_orderkey) ON k = job_id""",
    "tasks_v": """
        SELECT c_custkey AS task_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'PAUSED_FOR_HUMAN' ELSE 'EXECUTING' END AS status
        FROM customer WHERE c_custkey % 97 <> 0""",
    "workers_v": """
        SELECT i AS worker_id, CASE WHEN i % 17 = 0 THEN 'DEAD' WHEN i % 19 = 0 THEN 'RETIRED' ELSE 'RUNNING' END AS status
        FROM (SELECT UNNEST(range(150)) AS i) WHERE i % 23 <> 5""",
    "ledger_v": """
        SELECT event_id + 1 AS seq, CASE event_type WHEN 'signup' THEN 'worker.proc_spawned' WHEN 'purchase' THEN 'worker.proc_reaped'
                 WHEN 'view' THEN 'job.claimed' WHEN 'click' THEN 'heartbeat' WHEN 'error' THEN 'failure' END AS event_type,
               user_id AS worker_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS proc_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, epoch_us(ts) AS ts FROM events""",
    "spawns_v": "SELECT * FROM ledger_v WHERE event_type = 'worker.proc_spawned'",
    "reaps_v": "SELECT * FROM ledger_v WHERE event_type = 'worker.proc_reaped'",
    "beats_v": "SELECT * FROM ledger_v WHERE event_type = 'heartbeat'",
    "open_v": """
        SELECT *, CASE (worker_id * 7 + proc_id) % 5 WHEN 0 THEN 'dead' WHEN 1 THEN 'reuse' WHEN 2 THEN 'unverifiable' ELSE 'live_match' END AS observation
        FROM spawns_v s WHERE NOT EXISTS (SELECT 1 FROM reaps_v r WHERE r.worker_id = s.worker_id AND r.proc_id = s.proc_id)""",
    "generation_v": """
        SELECT s.worker_id, s.proc_id, s.seq AS spawn_seq, s.ts AS spawn_ts,
               (SELECT min(seq) FROM reaps_v r WHERE r.worker_id = s.worker_id AND r.proc_id = s.proc_id) AS reap_seq
        FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY seq DESC) AS rn FROM spawns_v) s WHERE rn = 1""",
    "deaths_v": """
        SELECT w.worker_id, w.status AS worker_status,
               CASE WHEN w.status IN ('DEAD', 'RETIRED') THEN 'worker_terminal'
                    WHEN o.observation IS NOT NULL THEN CASE WHEN o.observation IN ('dead', 'reuse') THEN 'process_identity_dead' END
                    WHEN g.reap_seq IS NOT NULL THEN 'process_reaped' END AS death
        FROM workers_v w LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY seq DESC) AS rn FROM open_v) o
             ON o.worker_id = w.worker_id AND o.rn = 1 LEFT JOIN generation_v g ON g.worker_id = w.worker_id""",
    "verdicts_v": """
        SELECT j.job_id, j.owner_worker_id, j.fencing_token, j.status, p.verdict AS previous, d.death, {NOW} - b.last_beat AS heartbeat_age,
               {NOW} - base AS progress_age,
               CASE WHEN p.verdict = 'DEAD' OR d.death IS NOT NULL THEN 'DEAD' WHEN lease_expires_at <= {NOW} OR {NOW} - base > 30 * {DAY} THEN 'STALLED' ELSE 'HEALTHY' END AS verdict
        FROM (SELECT *, coalesce(progress_updated_at, greatest(lease_acquired_at, created_at)) AS base FROM progress_v WHERE owner_worker_id IS NOT NULL) j
        JOIN deaths_v d ON d.worker_id = j.owner_worker_id
        LEFT JOIN (SELECT worker_id, max(ts) AS last_beat FROM beats_v GROUP BY worker_id) b ON b.worker_id = j.owner_worker_id
        LEFT JOIN (SELECT o_orderkey AS k, o_orderkey % 3 + 1 - o_orderkey % 2 AS tok, CASE WHEN o_orderkey % 3 = 0 THEN 'DEAD' ELSE 'HEALTHY' END AS verdict
                   FROM orders WHERE o_orderkey % 7 = 0) p ON p.k = j.job_id AND p.tok = j.fencing_token""",
    "authority_v": """
        SELECT seq, ts, job_id, seq % 5 = 0 AS reclaim, CASE WHEN seq % 5 <> 0 THEN worker_id END AS worker_id, CASE WHEN seq % 5 = 0 THEN worker_id % 5 END AS prev_owner
        FROM ledger_v WHERE event_type = 'job.claimed'""",
    "revoked_v": """
        SELECT s.seq AS spawn_seq, s.worker_id, s.job_id, s.ts AS spawn_ts, r.seq AS revoked_seq, r.ts AS revoked_ts, r.why AS revoked_by
        FROM open_v s LEFT JOIN (
          SELECT *, row_number() OVER (PARTITION BY spawn_seq ORDER BY seq) AS rn FROM (
            SELECT spawn_seq, seq, ts, CASE WHEN reclaim AND prev_owner = me THEN 'reclaimed' WHEN NOT reclaim AND worker_id <> me THEN 'claimed_by_other'
                     WHEN NOT reclaim AND worker_id = me AND own = 2 THEN 'claimed_again' END AS why
            FROM (SELECT o.seq AS spawn_seq, o.worker_id AS me, a.*,
                         sum(CASE WHEN NOT a.reclaim AND a.worker_id = o.worker_id THEN 1 ELSE 0 END) OVER (PARTITION BY o.seq ORDER BY a.seq) AS own
                  FROM open_v o JOIN authority_v a ON a.job_id = o.job_id AND a.ts > o.ts)) WHERE why IS NOT NULL) r
        ON r.spawn_seq = s.seq AND r.rn = 1""",
    "dispositions_v": """
        SELECT seq, worker_id, proc_id, job_id,
               CASE WHEN observation = 'dead' THEN 'ALREADY_DEAD' WHEN observation = 'reuse' THEN 'PID_REUSE' WHEN orphan IS NOT NULL THEN 'ORPHAN'
                    WHEN why = '' THEN 'ADOPT' ELSE 'FENCE' END AS disposition,
               CASE WHEN observation IN ('dead', 'reuse') THEN '' WHEN orphan IS NOT NULL THEN orphan ELSE why END AS reasons
        FROM (SELECT o.*, CASE WHEN observation = 'unverifiable' THEN 'process_identity_unverifiable' WHEN w.status IS NULL THEN 'no_authoritative_worker_row'
                     WHEN w.status IN ('DEAD', 'RETIRED') THEN 'worker_identity_terminal' WHEN j.status IS NULL THEN 'job_row_missing' END AS orphan,
                     array_to_string(list_filter([CASE WHEN j.owner_worker_id IS DISTINCT FROM o.worker_id THEN 'owner_mismatch' END,
                       CASE WHEN v.revoked_seq IS NOT NULL THEN 'authority_revoked_after_spawn' END,
                       CASE WHEN NOT coalesce(j.lease_expires_at > {NOW}, false) THEN 'lease_not_live' END,
                       CASE WHEN j.status NOT IN ('CLAIMED', 'RUNNING', 'COMMITTING') THEN 'job_not_active' END], lambda x: x IS NOT NULL), ',') AS why
              FROM open_v o LEFT JOIN workers_v w ON w.worker_id = o.worker_id LEFT JOIN jobs_v j ON j.job_id = o.job_id LEFT JOIN revoked_v v ON v.spawn_seq = o.seq)""",
    "attempts_v": """
        SELECT l_orderkey AS incident_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                 l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS attempt_number,
               CASE l_returnflag WHEN 'R' THEN 'FAILED' WHEN 'N' THEN 'BLOCKED' ELSE 'SUCCEEDED' END AS attempt_state,
               CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS progress_delta, (l_suppkey % 5 + 1)::INT AS rung, epoch_us(l_shipdate) AS ts FROM lineitem""",
    "runs_v": """
        SELECT incident_id, max(attempt_number) - coalesce(max(attempt_number) FILTER (WHERE attempt_state = 'SUCCEEDED'), 0) AS run FROM attempts_v GROUP BY incident_id""",
    "zeros_v": """
        SELECT a.incident_id, count(*) FILTER (WHERE attempt_number > last) AS zero_progress FROM attempts_v a JOIN (
          SELECT incident_id, coalesce(max(attempt_number) FILTER (WHERE progress_delta > 0), 0) AS last FROM attempts_v GROUP BY incident_id) USING (incident_id)
        GROUP BY a.incident_id""",
    "facts_v": """
        SELECT incident_id, count(*) AS attempts, bool_or(attempt_state = 'SUCCEEDED') AS has_success, any_value(run) AS tail, any_value(zero_progress) AS zero
        FROM attempts_v JOIN runs_v USING (incident_id) JOIN zeros_v USING (incident_id) GROUP BY incident_id""",
    "incidents_v": """
        SELECT o_orderkey AS incident_id, CASE WHEN o_orderkey % 5 = 0 THEN 'recovery' ELSE 'other' END AS scope,
               CASE o_orderkey % 7 WHEN 0 THEN 'success' WHEN 1 THEN 'stopped' WHEN 2 THEN 'superseded' END AS outcome,
               CASE WHEN o_orderkey % 13 = 0 THEN 'human' END AS escalated_to, 'sig-' || (o_orderkey % 500) AS signature, epoch_us(o_orderdate) AS created_at FROM orders""",
    "recovery_v": "SELECT * FROM incidents_v WHERE outcome IS NULL AND scope = 'recovery'",
    "policies_v": """
        SELECT k AS incident_id, k % 6 AS current_rung, k % 10 AS version, 7 AS incident_budget, 7 - k % 8 AS remaining_budget,
               k % 8 + CASE WHEN k % 31 = 0 THEN 1 ELSE 0 END AS attempt_count, k % 3 AS consumed, k % 3 - CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS result_consumed,
               CASE WHEN k % 9 = 0 THEN 'RECOVERY_COMPLETE' WHEN k % 43 = 1 THEN 'FINISHED' END AS terminal_state,
               (['{"1":2,"2":2}', '{"6":1}', '{"1":-1}', '{"1":true}', '[1]', 'nope', NULL, '{"1":2.5}', '{"1":"2"}', '{}', '{"3":0}', '', '{"5":1,"0":1}'])[k % 13 + 1] AS budgets,
               (['[]', 'x', NULL, '', '{"1": 1}', '{"1": 1}', '{"1": 1}', '{"1": 1}', '{"1": 1}', '{"1": 1}', '{"1": 1}'])[k % 11 + 1] AS per_rung,
               CASE WHEN k % 37 = 0 THEN '' WHEN k % 37 <> 1 THEN 'v1' END AS policy_version FROM (SELECT o_orderkey AS k FROM orders)""",
    "broken_v": """
        SELECT incident_id, terminal_state, array_to_string(list_filter([CASE WHEN current_rung = 0 THEN 'current_rung' END, CASE WHEN version < 1 THEN 'version' END,
                 CASE WHEN attempt_count + remaining_budget <> 7 THEN 'budget_identity' END,
                 CASE WHEN result_consumed < 0 THEN 'result_consumed_attempt_number' END,
                 CASE WHEN per_rung <> '' AND coalesce(TRY(json_type(per_rung)), '') <> 'OBJECT' THEN 'per_rung_attempts' END,
                 CASE WHEN budgets <> '' AND (coalesce(TRY(json_type(budgets)), '') <> 'OBJECT' OR (SELECT count(*) FROM (SELECT unnest(TRY(json_keys(budgets))) AS r)
                   WHERE r NOT IN ('1', '2', '3', '4', '5') OR json_type(budgets, '$."' || r || '"') <> 'UBIGINT') > 0) THEN 'per_rung_budgets' END,
                 CASE WHEN coalesce(policy_version, '') = '' THEN 'policy_version' END,
                 CASE WHEN terminal_state NOT IN ('RECOVERY_COMPLETE', 'BUDGET_EXHAUSTED', 'R5_TERMINAL', 'BLOCKED_CONTRADICTORY', 'BLOCKED_STATE_UNAVAILABLE', 'SUPERSEDED')
                   THEN 'terminal_state' END], lambda x: x IS NOT NULL), ',') AS problems FROM policies_v""",
    "actual_v": """
        SELECT job_id, CASE WHEN n % 9 = 0 THEN 'QUARANTINED' WHEN flag = 'A' THEN 'PENDING' ELSE CASE n % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETE'
                 WHEN 2 THEN 'FAILED' WHEN 3 THEN 'BLOCKED' ELSE 'UNCERTAIN' END END AS status
        FROM (SELECT l_orderkey AS job_id, count(*) AS n, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey)""",
    "diff_v": """
        SELECT o_orderkey AS desired_work_id, o_orderkey AS job_id,
               CASE WHEN o_orderkey % 10 = 0 THEN 'OBSOLETE' WHEN t.task_id IS NULL THEN 'CONTRADICTORY' WHEN (m IS NULL) <> (a.job_id IS NULL) THEN 'CONTRADICTORY'
                    WHEN m IS NOT NULL AND o_orderkey % 23 = 7 THEN 'CONTRADICTORY' WHEN m IS NOT NULL AND o_orderkey % 17 = 3 THEN 'CONTRADICTORY'
                    WHEN a.job_id IS NULL THEN 'DESIRED_MISSING' WHEN a.status = 'PENDING' THEN 'DESIRED_ALREADY_PRESENT' WHEN a.status = 'RUNNING' THEN 'DESIRED_ACTIVE'
                    WHEN a.status = 'QUARANTINED' THEN 'CONTRADICTORY' ELSE 'DESIRED_' || a.status END AS verdict
        FROM orders LEFT JOIN tasks_v t ON t.task_id = o_custkey LEFT JOIN actual_v a ON a.job_id = o_orderkey
        LEFT JOIN (SELECT DISTINCT l_orderkey AS m FROM lineitem WHERE l_orderkey % 19 <> 4) ON m = o_orderkey""",
    "eligible_v": """
        SELECT j.* FROM jobs_v j JOIN tasks_v t ON t.task_id = j.task_id AND t.status <> 'PAUSED_FOR_HUMAN'
        WHERE j.status = 'PENDING' AND j.job_id NOT IN (SELECT incident_id FROM recovery_v)""",
    "breakers_v": """
        SELECT 'TASK' AS scope_type, c_custkey::VARCHAR AS scope_id, CASE WHEN n <= 1 THEN 'OPEN' WHEN n = 2 THEN 'HALF_OPEN' WHEN n = 3 THEN 'BROKEN' ELSE 'CLOSED' END AS state,
               CASE WHEN n IN (3, 4) THEN 'corrupt' WHEN n <= 1 THEN 'open' WHEN n = 2 THEN 'half_open' ELSE 'closed' END AS class, c_custkey % 2 AS used,
               {NOW} + (c_custkey % 3 - 1) * 60000000 AS cooldown_until, c_custkey % 7 = 0 AS tripped, c_custkey
        FROM (SELECT c_custkey, c_custkey % 11 AS n FROM customer) WHERE n < 6""",
    "failures_v": """
        SELECT CASE seq % 3 WHEN 0 THEN 'R7_DEAD' WHEN 1 THEN 'R8_ATTEMPT_FAILED' ELSE 'R9_ESCALATED' END AS kind, worker_id, CASE WHEN seq % 3 = 1 THEN proc_id END AS attempt_id,
               CASE WHEN worker_id % 4 <> 0 THEN worker_id % 10 END AS task_id, ts, seq % 3 <> 2 AS windowed FROM ledger_v WHERE event_type = 'failure'""",
    "fanned_v": """
        SELECT 'JOB' AS scope_type, worker_id::VARCHAR AS scope_id, * FROM failures_v UNION ALL
        SELECT 'TASK', task_id::VARCHAR, * FROM failures_v WHERE task_id IS NOT NULL UNION ALL SELECT 'GLOBAL', 'GLOBAL', * FROM failures_v""",
    "signals_all_v": """
        SELECT scope_type || ':' || scope_id || ':' || kind || ':' || worker_id || ':' || coalesce(attempt_id::VARCHAR, '-') AS signal_id, scope_type, scope_id, kind AS failure_kind,
               windowed, ts FROM fanned_v""",
    "signals20_v": """
        SELECT signal_id, scope_type, scope_id, failure_kind, min(ts) AS observed_at FROM signals_all_v WHERE NOT windowed OR ts >= {NOW_E} - 20 * {DAY} - 1000000
        GROUP BY signal_id, scope_type, scope_id, failure_kind""",
    "signals60_v": """
        SELECT scope_type, scope_id, min(ts) AS t FROM signals_all_v WHERE NOT windowed OR ts >= {NOW_E} - 60 * {DAY} - 1000000 GROUP BY signal_id, scope_type, scope_id""",
    "behaviours_v": """
        SELECT * FROM (VALUES ('success_immediate', 'claimed', false, 0, 0, 1), ('success_immediate', 'heartbeat', false, 1, 0, 1), ('success_immediate', 'progress', false, 1, 0, 2),
          ('success_immediate', 'committed', false, 1, 0, 3), ('success_delayed', 'claimed', false, 0, 0, 1), ('success_delayed', 'heartbeat', true, 1, 2, 1),
          ('success_delayed', 'progress', true, 1, 2, 2), ('success_delayed', 'committed', false, 1, 2, 1), ('controlled_failure', 'claimed', false, 0, 0, 1),
          ('controlled_failure', 'heartbeat', true, 1, 2, 1), ('controlled_failure', 'progress', true, 1, 2, 2), ('controlled_failure', 'failed', false, 1, 2, 1),
          ('heartbeat_loop', 'claimed', false, 0, 0, 1), ('heartbeat_loop', 'heartbeat', true, 1, 1, 1), ('heartbeat_loop', 'released', false, 1, 1, 1),
          ('hang', 'claimed', false, 0, 0, 1), ('hang', 'heartbeat', true, 1, 1, 1), ('wedged', 'claimed', false, 0, 0, 1), ('wedged', 'heartbeat', false, 0, 0, 2),
          ('wedged_ignore_sigterm', 'claimed', false, 0, 0, 1), ('wedged_ignore_sigterm', 'heartbeat', false, 0, 0, 2), ('wedged_ignore_sigterm', 'sigterm_ignored', false, 2, 0, 1),
          ('wedged_spawn_child', 'claimed', false, 0, 0, 1), ('wedged_spawn_child', 'heartbeat', false, 0, 0, 2), ('wedged_spawn_child', 'child_spawned', false, 0, 0, 3),
          ('crash', 'claimed', false, 0, 0, 1), ('crash', 'heartbeat', false, 0, 0, 2), ('crash', 'exited', false, 2, 0, 1), ('crash_after_stage', 'claimed', false, 0, 0, 1),
          ('crash_after_stage', 'heartbeat', false, 0, 0, 2), ('crash_after_stage', 'staged', false, 2, 0, 1), ('crash_after_stage', 'exited', false, 2, 0, 2),
          ('sigkill_self', 'claimed', false, 0, 0, 1), ('sigkill_self', 'heartbeat', false, 0, 0, 2), ('sigkill_self', 'killed', false, 2, 0, 1),
          ('expire_then_commit', 'claimed', false, 0, 0, 1), ('expire_then_commit', 'heartbeat', false, 0, 0, 2), ('expire_then_commit', 'lease_expired', false, 2, 0, 1),
          ('expire_then_commit', 'commit_rejected', false, 2, 0, 2)) AS v(kind, event, reps, lead, width, place)""",
    "docs_v": """
        SELECT sha256(coalesce(text, '')) AS artifact_id, doc_id AS job_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, source AS task_id, doc_id % 50 AS staged_at FROM documents""",
    "artifacts_v": """
        SELECT artifact_id, job_id, size, stagers, CASE job_id % 4 WHEN 0 THEN 'STAGING' WHEN 1 THEN 'RELEASED' ELSE 'VALIDATED' END AS status FROM (
          SELECT artifact_id, job_id, size, row_number() OVER (PARTITION BY artifact_id ORDER BY staged_at, job_id) AS rn,
                 count(*) OVER (PARTITION BY artifact_id) AS stagers FROM docs_v) WHERE rn = 1""",
    "receipts_v": """
        SELECT * FROM (SELECT artifact_id, doc_id % 2 AS validator_version, doc_id AS validation_id, doc_id % 50 AS validated_at,
                 row_number() OVER (PARTITION BY artifact_id, doc_id % 2 ORDER BY doc_id % 50 DESC, doc_id DESC) AS rn
          FROM labels JOIN docs_v ON doc_id = job_id WHERE quality = 1 AND toxic <> 1) WHERE rn = 1""",
    "passed_v": "SELECT DISTINCT artifact_id FROM receipts_v",
    "passed1_v": "SELECT DISTINCT artifact_id FROM receipts_v WHERE validator_version = 1",
    "bytes_v": """
        SELECT artifact_id, sha256(t) AS bytes_hash, octet_length(encode(t)) AS byte_len FROM (
          SELECT a.artifact_id, coalesce(d.text, '') || CASE WHEN a.job_id % 16 = 5 THEN '!' ELSE '' END AS t
          FROM artifacts_v a JOIN documents d ON d.doc_id = a.job_id WHERE a.job_id % 16 <> 3)""",
    "intact_v": """
        SELECT a.artifact_id FROM artifacts_v a JOIN bytes_v b ON b.artifact_id = a.artifact_id AND b.bytes_hash = a.artifact_id JOIN passed1_v p ON p.artifact_id = a.artifact_id
        WHERE a.status <> 'STAGING'""",
    "commits_v": """
        SELECT job_id, task_id, CASE WHEN job_id % 3 = 0 THEN 'COMPLETE' ELSE 'RUNNING' END AS status,
               CASE WHEN job_id % 8 = 1 THEN 'gone' || artifact_id WHEN job_id % 12 <> 0 THEN artifact_id END AS artifact_id FROM docs_v""",
    "manifests_v": """
        SELECT task_id, sha256(string_agg(d, '' ORDER BY r)) AS checkpoint_id, sum(n)::BIGINT AS entries FROM (
          SELECT task_id, substr(k, 1, 4) AS r, sha256(string_agg(h, '' ORDER BY k, h)) AS d, count(*) AS n FROM (
            SELECT DISTINCT task_id, sha256(artifact_id) AS k, sha256(artifact_id || ':' || artifact_id) AS h FROM docs_v) GROUP BY ALL) GROUP BY task_id""",
    "entries_v": """
        SELECT DISTINCT CASE WHEN job_id % 2 = 1 THEN job_id + 1000000 ELSE job_id // 16 END::VARCHAR AS task_id, artifact_id, CASE WHEN job_id % 64 = 6 THEN 'stale' ELSE artifact_id END AS content_hash
        FROM commits_v WHERE artifact_id IS NOT NULL""",
    "checks_v": """
        SELECT task_id, CASE WHEN task_id::BIGINT % 5 = 0 THEN 'x' || task_id ELSE sha256(string_agg(d, '' ORDER BY r)) END AS checkpoint_id FROM (
          SELECT task_id, substr(k, 1, 4) AS r, sha256(string_agg(h, '' ORDER BY k, h)) AS d FROM (
            SELECT task_id, sha256(artifact_id) AS k, sha256(artifact_id || ':' || content_hash) AS h FROM entries_v) GROUP BY ALL) GROUP BY task_id""",
    "pointers_v": """
        SELECT 'lkg:' || task_id AS name, CASE WHEN task_id = 'src3' THEN 'gone' ELSE checkpoint_id END AS checkpoint_id FROM manifests_v""",
    "log_v": "SELECT event_id + 1 AS seq, event_type || '|' || user_id || '|' || props AS body FROM events",
    "reljobs_v": """
        SELECT job_id AS k, task_id, CASE job_id % 41 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'VERIFYING' ELSE status END AS status,
               CASE WHEN job_id % 12 <> 0 THEN 'r' || job_id END AS result, CASE WHEN job_id % 7 <> 0 THEN sha256('c' || job_id) END AS hash FROM jobs_v""",
    "reltasks_v": "SELECT task_id, CASE WHEN task_id % 53 = 0 THEN 'MANUAL_REVIEW' ELSE status END AS status FROM tasks_v",
    "relbreakers_v": """
        SELECT scope_type, scope_id, state, class FROM breakers_v UNION ALL
        SELECT CASE WHEN k % 97 = 0 THEN 'JOB' ELSE 'DESIRED' END, k::VARCHAR, (['OPEN', 'HALF_OPEN', 'CLOSED', 'ODD'])[k % 4 + 1], (['open', 'half_open', 'closed', 'corrupt'])[k % 4 + 1]
        FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 97 = 0 OR k % 101 = 0 UNION ALL
        SELECT * FROM (VALUES ('GLOBAL', 'global', 'OPEN', 'open'), ('GLOBAL', 'other', 'OPEN', 'open'), ('TASK', 'release', 'HALF_OPEN', 'half_open'))""",
    "work_v": """
        SELECT i.item, i.want, j.k AS job, j.status AS job_status, j.task_id, j.result, coalesce(j.hash, j.result) AS expected, t.status AS task_status
        FROM (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 50 <> 1 THEN o_orderkey + CASE WHEN o_orderkey % 60 = 7 THEN 10000000 ELSE 0 END END AS want FROM orders WHERE o_orderkey % 10 <> 0) i
        LEFT JOIN reljobs_v j ON j.k = i.want LEFT JOIN reltasks_v t ON t.task_id = j.task_id""",
    "flaws_v": """
        SELECT result, array_to_string(list_filter([CASE WHEN job % 17 = 0 THEN 'staged for another job' END,
                 CASE WHEN art IS DISTINCT FROM expected THEN 'content hash differs from the job''s' END, CASE WHEN job % 23 = 0 THEN 'not verified' END,
                 CASE WHEN job % 29 = 0 THEN 'bytes missing' WHEN bytes <> expected THEN 'bytes differ' END,
                 CASE WHEN job % 37 = 0 OR passed <> expected THEN 'receipt:structural/1' END], lambda x: x IS NOT NULL), '; ') AS flaws
        FROM (SELECT *, CASE WHEN job % 19 = 0 THEN 'x' ELSE sha256('c' || job) END AS art, CASE WHEN job % 31 = 0 THEN 'y' ELSE sha256('c' || job) END AS bytes,
                     CASE WHEN job % 47 = 0 THEN 'z' ELSE sha256('c' || job) END AS passed FROM work_v
              WHERE job_status = 'COMPLETE' AND result IS NOT NULL AND job % 13 <> 0)""",
    "scopes_v": """
        SELECT 'GLOBAL' AS scope_type, 'global' AS scope_id UNION SELECT 'TASK', 'release' UNION SELECT 'DESIRED', item::VARCHAR FROM work_v UNION
        SELECT 'JOB', want::VARCHAR FROM work_v WHERE want IS NOT NULL UNION SELECT 'TASK', task_id::VARCHAR FROM work_v WHERE task_id IS NOT NULL""",
    "relchecks_v": """
        SELECT CASE WHEN named THEN sha256(m) ELSE m END AS id, * FROM (VALUES ('m1', true, 'release', 'VERIFIED', true), ('m2', true, 'release', 'VERIFIED', false),
          ('m3', true, 'release', 'VERIFIED', false), ('m4', true, 'release', 'VERIFIED', false), ('m5', true, 'release', 'CORRUPT', false), ('m6', true, 'release', 'UNVERIFIED', false),
          ('m7', true, 'elsewhere', 'UNVERIFIED', false), ('m8', false, 'release', 'UNVERIFIED', false)) AS v(m, named, task, status, attested)""",
    "openattempts_v": """
        SELECT 't' || o_orderkey AS attempt_id, o_orderkey AS incident_id, (['CREATED', 'RUNNING', 'VERIFYING', 'UNCERTAIN'])[o_orderkey % 7 + 1] AS attempt_state
        FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 < 4""",
    "blockers_v": """
        SELECT category, identity, arg_min(detail, ord) AS detail FROM (
          SELECT 0 AS ord, 'STALE_GENERATION' AS category, 'g-5' AS identity, 'declared state is at version 5' AS detail UNION ALL
          SELECT 2, 'DESIRED_WORK_UNSATISFIED', item::VARCHAR, 'unmapped' FROM work_v WHERE want IS NULL UNION ALL
          SELECT 3, 'CONTRADICTORY_STATE', item::VARCHAR, 'mapped job is missing' FROM work_v WHERE want IS NOT NULL AND job IS NULL UNION ALL
          SELECT 4, 'DESIRED_WORK_UNSATISFIED', job::VARCHAR, 'job is ' || job_status FROM work_v WHERE job_status <> 'COMPLETE' UNION ALL
          SELECT 5, 'HUMAN_GATE', job::VARCHAR, 'job waits for a human' FROM work_v WHERE job_status = 'BLOCKED' UNION ALL
          SELECT 6, 'CONTRADICTORY_STATE', job::VARCHAR, 'task is missing' FROM work_v WHERE job IS NOT NULL AND task_status IS NULL UNION ALL
          SELECT 7, 'HUMAN_GATE', task_id::VARCHAR, 'task is ' || task_status FROM work_v WHERE task_status IN ('PAUSED_FOR_HUMAN', 'MANUAL_REVIEW') UNION ALL
          SELECT 8, 'MISSING_ARTIFACT', job::VARCHAR, 'complete without an artifact' FROM work_v WHERE job_status = 'COMPLETE' AND (result IS NULL OR job % 13 = 0) UNION ALL
          SELECT 9, 'INVALID_ARTIFACT', result, flaws FROM flaws_v WHERE flaws <> '' UNION ALL
          SELECT 10, 'ACTIVE_EXECUTION', k::VARCHAR, 'job is ' || status FROM reljobs_v WHERE status IN ('CLAIMED', 'RUNNING', 'COMMITTING', 'VERIFYING') UNION ALL
          SELECT 11, 'ACTIVE_EXECUTION', 'spawn:' || worker_id || ':' || proc_id, 'process was never reaped' FROM open_v UNION ALL
          SELECT 12, 'UNCERTAIN_EXECUTION', k::VARCHAR, 'job is UNCERTAIN' FROM reljobs_v WHERE status = 'UNCERTAIN' UNION ALL
          SELECT 13, 'ACTIVE_RECOVERY', incident_id::VARCHAR, 'open incident: ' || signature FROM recovery_v UNION ALL
          SELECT 14, 'ACTIVE_RECOVERY', attempt_id, 'attempt is ' || attempt_state FROM openattempts_v WHERE attempt_state <> 'CREATED' UNION ALL
          SELECT 15, 'UNCERTAIN_EXECUTION', attempt_id, 'attempt is UNCERTAIN' FROM openattempts_v WHERE attempt_state = 'UNCERTAIN' UNION ALL
          SELECT 16, 'ACTIVE_RECOVERY', incident_id::VARCHAR, 'escalated, and its policy has not ended' FROM incidents_v JOIN policies_v USING (incident_id) WHERE escalated_to = 'human' AND terminal_state IS NULL UNION ALL
          SELECT 17, 'ACTIVE_RECOVERY', incident_id::VARCHAR, 'has an outcome, and its policy has not ended' FROM incidents_v JOIN policies_v USING (incident_id) WHERE outcome IS NOT NULL AND terminal_state IS NULL UNION ALL
          SELECT 18, 'OPEN_BREAKER', scope_type || ':' || scope_id, class FROM relbreakers_v SEMI JOIN scopes_v USING (scope_type, scope_id) WHERE class IN ('open', 'half_open') UNION ALL
          SELECT 19, 'CORRUPT_AUTHORITY', 'breaker:' || scope_type || ':' || scope_id, 'breaker cannot be read' FROM relbreakers_v SEMI JOIN scopes_v USING (scope_type, scope_id) WHERE class = 'corrupt' UNION ALL
          SELECT 20, 'CONTRADICTORY_STATE', id, 'checkpoint belongs to another task' FROM relchecks_v WHERE task <> 'release' UNION ALL
          SELECT 21, 'CONTRADICTORY_STATE', id, 'checkpoint is not named by its manifest' FROM relchecks_v WHERE NOT named UNION ALL
          SELECT 22, 'INVALID_CHECKPOINT', id, 'checkpoint is corrupt' FROM relchecks_v WHERE status = 'CORRUPT' UNION ALL
          SELECT 23, 'INVALID_CHECKPOINT', id, 'verified without attestation' FROM relchecks_v WHERE status = 'VERIFIED' AND NOT attested) GROUP BY category, identity""",
}

#: Windows that a first signal opens: hop from each window's first signal to the next window's.
_ANCHORED = """
    WITH RECURSIVE {views}
    hop(scope_type, scope_id, start) AS (
      SELECT scope_type, scope_id, min(t) FROM signals60_v WHERE {only} GROUP BY scope_type, scope_id
      UNION ALL
      SELECT h.scope_type, h.scope_id, (SELECT min(t) FROM signals60_v s WHERE s.scope_type = h.scope_type AND s.scope_id = h.scope_id AND s.t > h.start + {width})
      FROM hop h WHERE EXISTS (SELECT 1 FROM signals60_v s WHERE s.scope_type = h.scope_type AND s.scope_id = h.scope_id AND s.t > h.start + {width})
    ), counted AS (
      SELECT h.scope_type, h.scope_id, h.start, count(*) AS n FROM hop h JOIN signals60_v s ON s.scope_type = h.scope_type AND s.scope_id = h.scope_id
             AND s.t >= h.start AND s.t <= h.start + {width} GROUP BY h.scope_type, h.scope_id, h.start
    )
"""

_STATES = "SELECT * FROM (VALUES {rows}) AS g(entity, src, dst)"


def _edges() -> str:
    from tidemark.operators.graph import GRAPHS

    rows = [f"('{e}', '{a}', '{b}')" for e, graph in GRAPHS.items() for a, after in graph.items() for b in after]
    return _STATES.format(rows=", ".join(rows))


_TEXTS = {
    "expired_leases": """SELECT job_id, owner_worker_id, fencing_token, status, lease_acquired_at, lease_expires_at, {NOW}::BIGINT AS observed_at,
        'lease of job ' || job_id || ' expired at ' || lease_expires_at || ' <= {NOW}; owner=' || owner_worker_id || ' status=' || status || ' token=' || fencing_token AS reason
        FROM jobs_v WHERE owner_worker_id IS NOT NULL AND lease_expires_at <= {NOW}""",
    "owned_active_jobs": "SELECT job_id, status, owner_worker_id, fencing_token FROM jobs_v WHERE owner_worker_id IS NOT NULL",
    "jobs_in_states": "SELECT job_id, status FROM jobs_v WHERE status IN ('FAILED', 'UNCERTAIN')",
    "pending_topk": "SELECT job_id, created_at FROM jobs_v WHERE status = 'PENDING' ORDER BY created_at, job_id LIMIT 100",
    "claimed_by_scheduler": "SELECT job_id, 'sched-' || owner_worker_id AS owner_worker_id, lease_expires_at FROM jobs_v WHERE status = 'CLAIMED' AND owner_worker_id % 2 = 0 AND lease_expires_at > {NOW}",
    "active_capacity": "SELECT count(owner_worker_id) AS active, greatest(5000 - count(owner_worker_id), 0) AS free FROM jobs_v",
    "lease_rules": """SELECT job_id, lease_expires_at <= {NOW} AS expired, lease_expires_at > {NOW} AS live, lease_expires_at > {NOW} AS may_renew,
        status = 'PENDING' AS may_claim, CASE WHEN owner_worker_id IS DISTINCT FROM task_id % 75 THEN 'not_owner' WHEN fencing_token <> 2 THEN 'stale_token'
        WHEN lease_expires_at <= {NOW} THEN 'lease_expired' END AS fence_failure FROM jobs_v""",
    "illegal_transitions": """SELECT event_id, user_id, src, dst FROM (SELECT event_id, user_id, dst, lag(dst) OVER (PARTITION BY user_id ORDER BY event_id) AS src FROM (
        SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'PROVISIONING' WHEN 'view' THEN 'ASSIGNED' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'IDLE' ELSE 'SUSPECT' END AS dst FROM events))
        WHERE src IS NOT NULL AND (src, dst) NOT IN (SELECT (src, dst) FROM edges_v WHERE entity = 'worker')""",
    "gate_violations": """SELECT task_id, status AS src, 'EXECUTING' AS dst FROM tasks_v WHERE status = 'PAUSED_FOR_HUMAN'
        AND task_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
    "unreaped_spawns": "SELECT seq, worker_id, proc_id, ts FROM open_v",
    "latest_spawn_generation": "SELECT * FROM generation_v",
    "latest_heartbeat": "SELECT worker_id, seq, ts, proc_id FROM beats_v QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC, seq DESC) = 1",
    "newest_heartbeats": "SELECT worker_id, seq, ts FROM beats_v QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY ts DESC, seq DESC) <= 3",
    "accepted_heartbeats": """SELECT seq, worker_id, proc_id AS hb_seq, proc_id > coalesce(max(proc_id) OVER (PARTITION BY worker_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM beats_v""",
    "death_evidence": "SELECT * FROM deaths_v",
    "watchdog_verdict": "SELECT * FROM verdicts_v",
    "verdict_changes": """SELECT event_id, user_id, verdict, previous FROM (SELECT *, lag(verdict) OVER w AS previous,
          coalesce(max((verdict = 'DEAD')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
        FROM (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' AND value > 40 THEN 'DEAD' WHEN event_type = 'error' THEN 'STALLED' ELSE 'HEALTHY' END AS verdict FROM events)
        WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE done = 0 AND previous IS DISTINCT FROM verdict""",
    "revocation_after_spawn": "SELECT spawn_seq, worker_id, job_id, revoked_seq, revoked_by FROM revoked_v",
    "fence_timing": """SELECT spawn_seq, greatest(death_ts - revoked_ts, 0) AS consumed, death_ts - revoked_ts <= 10 * {DAY} AS within_bound FROM revoked_v
        JOIN (SELECT worker_id, max(ts) AS death_ts FROM ledger_v WHERE event_type = 'failure' GROUP BY worker_id) USING (worker_id) WHERE revoked_ts IS NOT NULL""",
    "boot_dispositions": "SELECT * FROM dispositions_v",
    "disposition_histogram": "SELECT disposition, count(*) AS n FROM dispositions_v GROUP BY disposition",
    "reclaim_outcomes": """SELECT job_id, rejected, CASE WHEN rejected IS NULL THEN CASE WHEN status = 'CLAIMED' THEN 'PENDING' ELSE 'UNCERTAIN' END END AS new_status,
        CASE WHEN rejected IS NULL THEN fencing_token + 1 END AS new_token FROM (SELECT *, CASE WHEN job_id % 10 = 0 THEN 'actor_not_allowed' WHEN owner_worker_id IS NULL THEN 'not_reclaimable'
        WHEN job_id % 4 <> 0 AND lease_expires_at > {NOW} THEN 'lease_not_expired' WHEN job_id % 4 = 0 AND job_id % 8 <> 0 THEN 'evidence_missing' END AS rejected FROM jobs_v WHERE job_id % 2 = 0)""",
    "lease_state": """SELECT job_id, seq, CASE WHEN event_type IN ('job.claimed', 'heartbeat') THEN worker_id END AS owner_worker_id,
        CASE WHEN event_type IN ('job.claimed', 'heartbeat') THEN ts + {HOUR} END AS lease_expires_at FROM ledger_v WHERE event_type <> 'worker.proc_spawned'
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1""",
    "trailing_failures": "SELECT * FROM runs_v",
    "zero_progress_run": "SELECT * FROM zeros_v",
    "attempts_per_rung": "SELECT incident_id, rung, count(*) AS n FROM attempts_v GROUP BY incident_id, rung",
    "rung_selection": """SELECT incident_id, from_rung, CASE WHEN why IN ('last_rung', 'state_unavailable', 'contradictory', 'incident_budget') THEN 5 WHEN why = 'continue' THEN from_rung ELSE from_rung + 1 END::INT AS rung,
        CASE why WHEN 'last_rung' THEN 'R5_TERMINAL' WHEN 'state_unavailable' THEN 'BLOCKED_STATE_UNAVAILABLE' WHEN 'contradictory' THEN 'BLOCKED_CONTRADICTORY' WHEN 'incident_budget' THEN 'BUDGET_EXHAUSTED'
          WHEN 'continue' THEN NULL ELSE CASE WHEN from_rung = 4 THEN 'R5_TERMINAL' END END AS terminal, why NOT IN ('last_rung', 'continue') AS advanced, why AS reason
        FROM (SELECT *, CASE WHEN from_rung = 5 THEN 'last_rung' WHEN k % 50 = 0 THEN 'state_unavailable' WHEN k % 41 = 0 THEN 'contradictory' WHEN attempts >= 12 THEN 'incident_budget'
          WHEN zero >= 2 THEN 'zero_progress' WHEN k % 4 >= CASE from_rung WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END THEN 'rung_budget' WHEN from_rung = 4 THEN 'no_executor'
          WHEN tail >= 2 AND k % 3 <> 0 THEN 'intake_blocked' ELSE 'continue' END AS why FROM (SELECT *, incident_id AS k, (incident_id % 5 + 1)::INT AS from_rung FROM facts_v))""",
    "budget_consumption": """SELECT incident_id, coalesce(n, 0) AS new_attempts, least(coalesce(n, 0), remaining_budget) AS payable, remaining_budget - least(coalesce(n, 0), remaining_budget) AS remaining_after,
        coalesce(mark, consumed) AS consumed_attempt_number FROM policies_v LEFT JOIN (SELECT a.incident_id, count(*) AS n, max(attempt_number) AS mark FROM attempts_v a JOIN policies_v p
        ON p.incident_id = a.incident_id AND attempt_number > consumed GROUP BY a.incident_id) USING (incident_id)""",
    "recovery_candidates": """SELECT j.job_id, j.fencing_token, CASE WHEN j.lease_expires_at <= {NOW} THEN 'LEASE_EXPIRED' ELSE v.verdict END AS failure_class, v.verdict
        FROM jobs_v j LEFT JOIN verdicts_v v ON v.job_id = j.job_id WHERE j.owner_worker_id IS NOT NULL AND (j.lease_expires_at <= {NOW} OR v.verdict IN ('STALLED', 'DEAD'))
        UNION ALL SELECT job_id, fencing_token, 'STALE_AUTHORITY', NULL FROM jobs_v WHERE owner_worker_id IS NULL AND status NOT IN ('COMPLETE', 'FAILED') AND job_id % 3 = 0 AND job_id IN (SELECT incident_id FROM recovery_v)""",
    "intake_decision": """SELECT j.job_id, CASE WHEN status IN ('COMPLETE', 'FAILED') THEN 'no_incident' WHEN outcome IS NOT NULL THEN 'incident_closed' WHEN coalesce(has_success, false) AND j.job_id % 3 <> 0 THEN 'close_success'
        WHEN coalesce(tail, 0) >= 2 THEN 'escalate' WHEN owner_worker_id IS NOT NULL THEN 'create_reclaim' WHEN j.job_id % 3 = 0 THEN 'create_fence' ELSE 'no_action' END AS decision
        FROM jobs_v j JOIN incidents_v i ON i.incident_id = j.job_id LEFT JOIN facts_v f ON f.incident_id = j.job_id""",
    "progress_and_verify": """SELECT job_id, action, delta, CASE WHEN delta > 0 THEN 'success' WHEN job_id % 2 = 1 THEN 'escalate' ELSE 'retry' END AS decision,
        CASE action WHEN 'reclaim' THEN job_id % 2 = 1 WHEN 'fence' THEN job_id % 4 <> 1 ELSE mine END AS effect
        FROM (SELECT *, CASE action WHEN 'reclaim' THEN (job_id % 2 = 1 AND status IN ('PENDING', 'UNCERTAIN'))::INT WHEN 'fence' THEN (job_id % 4 <> 1)::INT
          ELSE (mine AND (coalesce(progress_updated_at > created_at, false) OR job_id % 2 = 1 OR job_id % 11 = 0))::INT END AS delta
        FROM (SELECT *, CASE job_id % 3 WHEN 0 THEN 'reclaim' WHEN 1 THEN 'fence' ELSE 'restart' END AS action,
          (CASE WHEN job_id % 3 <> 0 THEN owner_worker_id END) IS NOT DISTINCT FROM task_id % 150 AS mine FROM progress_v))""",
    "next_actions": """SELECT o_orderkey AS attempt_id, state, CASE state WHEN 'CREATED' THEN CASE WHEN claimed IS NOT NULL AND {NOW} - claimed <= 30 * {DAY} THEN 'wait' ELSE 'dispatch' END
        WHEN 'RUNNING' THEN CASE WHEN claimed IS NULL OR {NOW} - claimed > 30 * {DAY} THEN 'mark_uncertain' ELSE 'wait' END
        WHEN 'VERIFYING' THEN CASE WHEN epoch_us(o_orderdate) + {DAY} > {NOW} THEN 'wait' ELSE 'verify' END WHEN 'UNCERTAIN' THEN 'reconcile' END AS action
        FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'VERIFYING' WHEN 3 THEN 'UNCERTAIN' ELSE 'SUCCEEDED' END AS state,
          CASE WHEN o_orderkey % 3 <> 0 THEN epoch_us(o_orderdate) END AS claimed FROM orders)""",
    "policy_row_validity": "SELECT incident_id, problems FROM broken_v",
    "policy_outcomes": """SELECT i.incident_id, CASE WHEN problems <> '' THEN 'CORRUPT' WHEN terminal_state IS NOT NULL THEN terminal_state WHEN outcome IN ('success', 'stopped') THEN 'RECOVERY_COMPLETE'
        WHEN outcome = 'superseded' THEN 'SUPERSEDED' WHEN escalated_to = 'human' THEN 'R5_TERMINAL' WHEN j.status IN ('COMPLETE', 'FAILED') THEN 'RECOVERY_COMPLETE'
        WHEN t.status = 'PAUSED_FOR_HUMAN' THEN 'STOOD_DOWN' END AS settled FROM incidents_v i JOIN broken_v b ON b.incident_id = i.incident_id JOIN jobs_v j ON j.job_id = i.incident_id LEFT JOIN tasks_v t ON t.task_id = j.task_id""",
    "incidents_with_open_policy": "SELECT incident_id, outcome FROM incidents_v JOIN policies_v USING (incident_id) WHERE outcome IS NOT NULL AND terminal_state IS NULL",
    "incident_lists": "SELECT incident_id, scope, escalated_to FROM incidents_v WHERE (outcome IS NULL AND scope = 'recovery') OR escalated_to = 'human'",
    "incident_per_signature": "SELECT signature, incident_id FROM incidents_v QUALIFY row_number() OVER (PARTITION BY signature ORDER BY created_at, incident_id) = 1",
    "evidence_violations": "SELECT incident_id, attempt_number FROM attempts_v WHERE attempt_number % 3 = 0 AND (progress_delta <= 0 OR rung % 2 <> 0)",
    "reconcile_diff": "SELECT * FROM diff_v",
    "reconcile_summary": """SELECT count(*) AS examined, count(*) FILTER (WHERE o = 'created') AS created, count(*) FILTER (WHERE o = 'blocked') AS blocked, count(*) FILTER (WHERE o = 'conflict') AS conflicts,
        count(*) FILTER (WHERE o = 'failed') AS failed, count(*) FILTER (WHERE o = 'skipped') AS skipped,
        CASE WHEN count(*) FILTER (WHERE o = 'failed') > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE o = 'conflict') > 0 THEN 'CONFLICT' WHEN count(*) FILTER (WHERE o = 'blocked') > 0 THEN 'BLOCKED'
          WHEN count(*) FILTER (WHERE o = 'created') > 0 THEN 'CHANGED' ELSE 'CONVERGED' END AS result
        FROM (SELECT *, coalesce(max((o = 'failed')::INT) OVER (ORDER BY desired_work_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM (
          SELECT *, CASE WHEN verdict = 'CONTRADICTORY' THEN 'conflict' WHEN verdict = 'DESIRED_MISSING' THEN CASE WHEN desired_work_id = 14000 THEN 'failed' WHEN desired_work_id % 2 = 0 THEN 'blocked' ELSE 'created' END
            ELSE 'skipped' END AS o FROM diff_v)) WHERE stopped = 0""",
    "desired_job_ids": "SELECT desired_work_id, 'dj-' || substr(sha256('desired:' || desired_work_id), 1, 32) AS new_job_id FROM diff_v WHERE verdict = 'DESIRED_MISSING'",
    "desired_snapshot": """SELECT sha256(string_agg(d, '' ORDER BY r)) AS snapshot_hash, sum(n)::BIGINT AS items FROM (
        SELECT substr(k, 1, 4) AS r, sha256(string_agg(h, '' ORDER BY k, h)) AS d, count(*) AS n FROM (SELECT sha256(o_orderkey::VARCHAR) AS k,
          sha256(o_orderkey || ':' || sha256(o_orderpriority) || ':' || (o_orderkey % 10 = 0)::INT || ':' || (o_orderkey % 3 + 1)) AS h FROM orders) GROUP BY 1)""",
    "scheduler_eligible": "SELECT job_id, task_id FROM eligible_v",
    "scheduler_admission": """SELECT row_number() OVER (ORDER BY created_at, job_id)::INT AS rank, job_id, task_id, probe_scope FROM (
        SELECT *, row_number() OVER (PARTITION BY probe_scope ORDER BY created_at, job_id) AS rn FROM (
          SELECT e.*, CASE WHEN b.class = 'half_open' THEN 'TASK:' || b.scope_id END AS probe_scope FROM eligible_v e LEFT JOIN breakers_v b ON b.scope_id = e.task_id::VARCHAR
          WHERE b.class IS NULL OR b.class = 'closed' OR (b.class = 'half_open' AND b.used < 1))) WHERE probe_scope IS NULL OR rn = 1 ORDER BY created_at, job_id LIMIT 300""",
    "orphan_dispatch": """SELECT job_id, owner_worker_id FROM jobs_v j WHERE status = 'CLAIMED' AND NOT EXISTS (SELECT 1 FROM spawns_v s WHERE s.worker_id = j.owner_worker_id AND s.job_id = j.job_id)
        AND NOT EXISTS (SELECT 1 FROM (SELECT worker_id, max(ts) AS b FROM beats_v GROUP BY worker_id) x WHERE x.worker_id = j.owner_worker_id AND {NOW_E} - b <= 6 * {HOUR})""",
    "breaker_signals": "SELECT * FROM signals20_v",
    "breaker_touched": "SELECT scope_type, scope_id, count(*) AS signals, string_agg(DISTINCT failure_kind, ',' ORDER BY failure_kind) AS kinds FROM signals20_v GROUP BY scope_type, scope_id",
    "recovery_pressure": """SELECT count(*) FILTER (WHERE ts >= {NOW} - 30 * {DAY}) AS pressure, count(*) FILTER (WHERE ts >= {NOW} - 30 * {DAY}) >= 5 AS signalled, ({NOW} // (30 * {DAY}))::BIGINT AS bucket
        FROM (SELECT ts FROM attempts_v WHERE attempt_state IN ('BLOCKED', 'FAILED') UNION ALL SELECT created_at FROM incidents_v WHERE escalated_to IS NOT NULL)""",
    "breaker_pass": """SELECT scope_id, state, probe, class, CASE WHEN state = 'CLOSED' AND tripped THEN 'OPEN' WHEN state = 'OPEN' AND cooldown_until <= {NOW} THEN 'HALF_OPEN'
        WHEN state = 'HALF_OPEN' AND probe = 'success' THEN 'CLOSED' WHEN state = 'HALF_OPEN' AND probe IN ('failure', 'corrupt') THEN 'OPEN' ELSE state END AS next_state
        FROM (SELECT *, CASE WHEN k % 4 = 1 OR k % 5 = 0 THEN 'corrupt' WHEN k % 4 = 0 OR k % 6 > 3 THEN 'success' WHEN k % 3 = 0 THEN 'failure' ELSE 'inflight' END AS probe FROM (SELECT *, c_custkey AS k FROM breakers_v))""",
    "artifact_dedupe": "SELECT artifact_id, job_id, size, stagers FROM artifacts_v",
    "artifact_stagings": "SELECT artifact_id, job_id, min(staged_at) AS staged_at FROM docs_v GROUP BY artifact_id, job_id",
    "receipts_latest_pass": "SELECT artifact_id, validator_version, validation_id, validated_at FROM receipts_v",
    "quarantine_effect": "SELECT artifact_id, validation_id FROM receipts_v WHERE validator_version <> 1",
    "verified_artifacts": "SELECT artifact_id, status FROM artifacts_v WHERE status <> 'STAGING' AND artifact_id IN (SELECT artifact_id FROM passed_v)",
    "candidate_artifacts": "SELECT job_id, artifact_id, 'staging' AS how FROM docs_v",
    "structural_check": """SELECT artifact_id, CASE WHEN bytes_hash IS NULL THEN 'bytes_missing' ELSE array_to_string(list_filter([
          CASE WHEN bytes_hash <> artifact_id THEN 'hash_mismatch' END, CASE WHEN bytes_hash <> artifact_id THEN 'identity_mismatch' END,
          CASE WHEN given <> byte_len THEN 'size_mismatch' END, CASE WHEN job_id % 13 < 4 THEN 'no_provenance' END], lambda x: x IS NOT NULL), ',') END AS problems
        FROM (SELECT a.*, b.bytes_hash, b.byte_len, CASE WHEN job_id % 6 <> 1 THEN size + (job_id % 10 = 2)::INT END AS given FROM artifacts_v a LEFT JOIN bytes_v b USING (artifact_id))""",
    "completion_inspection": """SELECT job_id, status, CASE WHEN status = 'COMPLETE' THEN CASE WHEN problems = '' THEN 'COMMITTED' ELSE 'UNCERTAIN' END WHEN n > 0 THEN 'UNCERTAIN' ELSE 'NOT_COMMITTED' END AS completion,
          problems, n::BIGINT AS adoptable
        FROM (SELECT m.job_id, m.status, CASE WHEN m.status = 'COMPLETE' THEN 0 ELSE (m.own IN (SELECT artifact_id FROM intact_v))::INT END AS n,
          CASE WHEN m.status <> 'COMPLETE' THEN '' WHEN m.artifact_id IS NULL THEN 'no_artifact' ELSE array_to_string(list_filter([
            CASE WHEN m.given IS NULL THEN 'no_content_hash' END, CASE WHEN a.artifact_id IS NULL THEN 'artifact_missing' END,
            CASE WHEN a.artifact_id IS NOT NULL AND m.given <> m.artifact_id THEN 'content_hash_differs' END,
            CASE WHEN a.artifact_id IS NOT NULL THEN CASE WHEN b.bytes_hash IS NULL THEN 'bytes_missing' WHEN b.bytes_hash <> m.artifact_id THEN 'bytes_differ' END END,
            CASE WHEN a.artifact_id IS NOT NULL AND p.artifact_id IS NULL THEN 'receipt:structural/1' END], lambda x: x IS NOT NULL), ',') END AS problems
        FROM (SELECT c.*, d.artifact_id AS own, CASE WHEN c.job_id % 9 = 6 THEN NULL WHEN c.job_id % 15 = 3 THEN 'other' ELSE c.artifact_id END AS given FROM commits_v c JOIN docs_v d ON d.job_id = c.job_id) m
        LEFT JOIN artifacts_v a ON a.artifact_id = m.artifact_id LEFT JOIN bytes_v b ON b.artifact_id = m.artifact_id LEFT JOIN passed1_v p ON p.artifact_id = m.artifact_id)""",
    "commit_adoption": "SELECT d.artifact_id, d.job_id FROM docs_v d JOIN jobs_v j ON j.job_id = d.job_id WHERE j.status = 'UNCERTAIN' AND d.job_id % 4 < j.fencing_token",
    "checkpoint_manifests": "SELECT task_id, checkpoint_id, entries FROM manifests_v",
    "checkpoint_verify": """SELECT *, substr(checkpoint_id, 1, 1) <> 'x' AS id_holds, true AS ledger_contiguous,
          CASE WHEN substr(checkpoint_id, 1, 1) <> 'x' AND missing + not_verified + hash_mismatch + bytes_missing + bytes_mismatch + size_mismatch + no_receipt = 0 THEN 'VERIFIED' ELSE 'CORRUPT' END AS verification_status
        FROM (SELECT k.checkpoint_id, e.task_id, count(*) AS entries, count(*) FILTER (WHERE a.artifact_id IS NULL) AS missing, count(*) FILTER (WHERE a.status = 'STAGING') AS not_verified,
          count(*) FILTER (WHERE e.content_hash <> a.artifact_id) AS hash_mismatch, count(*) FILTER (WHERE a.artifact_id IS NOT NULL AND b.bytes_hash IS NULL) AS bytes_missing,
          count(*) FILTER (WHERE b.bytes_hash <> e.content_hash) AS bytes_mismatch, count(*) FILTER (WHERE b.byte_len <> a.size + (a.job_id % 32 = 9)::INT) AS size_mismatch,
          count(*) FILTER (WHERE a.artifact_id IS NOT NULL AND (p.artifact_id IS NULL OR e.content_hash <> a.artifact_id)) AS no_receipt
          FROM entries_v e JOIN checks_v k USING (task_id) LEFT JOIN artifacts_v a ON a.artifact_id = e.artifact_id LEFT JOIN bytes_v b ON b.artifact_id = e.artifact_id
          LEFT JOIN passed1_v p ON p.artifact_id = e.artifact_id GROUP BY k.checkpoint_id, e.task_id)""",
    "latest_known_good": "SELECT name, p.checkpoint_id FROM pointers_v p JOIN manifests_v m ON m.checkpoint_id = p.checkpoint_id AND entries % 2 = 0",
    "checkpoint_pointers": "SELECT name, p.checkpoint_id, CASE WHEN m.entries % 2 = 0 THEN 'VERIFIED' WHEN m.entries % 2 = 1 THEN 'CORRUPT' END AS verification_status FROM pointers_v p LEFT JOIN manifests_v m ON m.checkpoint_id = p.checkpoint_id",
    "finalization_blockers": "SELECT * FROM blockers_v",
    "blocker_counts": "SELECT category, count(*) AS n FROM blockers_v GROUP BY category",
    "release_manifest": """SELECT sha256(string_agg(d, '' ORDER BY r)) AS manifest_hash, sum(n)::BIGINT AS entries FROM (
        SELECT substr(k, 1, 4) AS r, sha256(string_agg(h, '' ORDER BY k, h)) AS d, count(*) AS n FROM (
          SELECT sha256(artifact_id) AS k, sha256(artifact_id || '=' || artifact_id) AS h FROM artifacts_v) GROUP BY 1)""",
    "ledger_contiguity": "SELECT coalesce(max(seq), 0) AS tip_seq, count(*) AS rows, coalesce(max(seq), 0) = count(*) AS contiguous FROM log_v",
    "ledger_chain_verify": """SELECT seq, CASE WHEN (seq - 1) % 2500 = 11 AND seq % 64 <> 0 THEN 'prev_hash_mismatch' ELSE 'hash_mismatch' END AS problem FROM log_v
        WHERE seq % 2500 <> 11 AND (((seq - 1) % 2500 = 11 AND seq % 64 <> 0) OR seq % 1000 = 7)""",
    "ledger_segments": """SELECT (seq // 8)::BIGINT AS segment, list_reduce(list(body ORDER BY seq), lambda a, x: sha256(a || ':' || x), repeat('0', 64)) AS tip_hash, count(*) AS rows FROM log_v GROUP BY seq // 8""",
    "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "fk_violations": "SELECT o_orderkey AS job_id, o_custkey AS task_id FROM orders WHERE o_custkey NOT IN (SELECT task_id FROM tasks_v)",
    "event_histogram": "SELECT event_type, count(*) AS n, count(DISTINCT worker_id) AS workers, max(seq) AS last_seq FROM ledger_v GROUP BY event_type",
    "job_events": "SELECT seq, event_type, worker_id FROM ledger_v WHERE job_id = 42",
    "evidence_per_worker": """SELECT w.worker_id, w.status, spawn_seq, reap_seq, beat_seq, coalesce(n, 0) AS active_jobs FROM workers_v w LEFT JOIN generation_v USING (worker_id)
        LEFT JOIN (SELECT worker_id, arg_max(seq, (ts, seq)) AS beat_seq FROM beats_v GROUP BY worker_id) USING (worker_id)
        LEFT JOIN (SELECT owner_worker_id AS worker_id, count(*) AS n FROM jobs_v WHERE owner_worker_id IS NOT NULL GROUP BY 1) USING (worker_id)""",
    "keyset_batch": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100",
    "seeded_sample": """SELECT doc_id, sha256('20260924' || doc_id) AS sample_key FROM documents QUALIFY row_number() OVER (ORDER BY sha256('20260924' || doc_id), doc_id)
        <= greatest(3, round(0.05 * (SELECT count(*) FROM documents)))""",
    "scalar_functions": """SELECT o_orderkey, 'ds-v' || (k % 7) AS generation, k || '#' || o_custkey AS lease, CASE WHEN k % 4 <> 0 AND k % 6 <> 0 THEN 'j' || k END AS probe_job,
        't' || (k % 5) AS task, 'j' || k AS job, CASE WHEN k % 3 <> 0 THEN k % 3 ELSE k % 5 END AS first_set, k // 300 AS bucket FROM (SELECT *, o_orderkey AS k FROM orders)""",
    "spec_normalisation": """SELECT o_orderkey, problem, CASE WHEN problem IS NULL THEN t END AS task_id, CASE WHEN problem IS NULL AND n = 9 THEN 's' END AS stage_id,
        CASE WHEN problem IS NULL THEN 3 END::BIGINT AS max_attempts, CASE WHEN problem IS NULL THEN sha256(t || '|' || CASE WHEN n = 9 THEN 's' ELSE '-' END || '|3|{}') END AS identity
        FROM (SELECT *, CASE n WHEN 0 THEN 'max_attempts' WHEN 1 THEN 'task_id' WHEN 2 THEN 'unknown_field' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'not_an_object' WHEN 5 THEN 'task_id'
          WHEN 6 THEN 'stage_id' WHEN 7 THEN 'policy' WHEN 10 THEN 'max_attempts' END AS problem FROM (SELECT o_orderkey, o_orderkey % 12 AS n, 't' || (o_orderkey % 30) AS t FROM orders))""",
    "validator_receipts": "SELECT artifact_id FROM artifacts_v WHERE size BETWEEN 100 AND 5000",
    "progress_evidence": """SELECT job_id, coalesce(n, 0) AS verified_artifacts, k AS latest_known_good FROM docs_v d
        LEFT JOIN (SELECT x.task_id, count(*) AS n FROM artifacts_v a JOIN docs_v x ON x.job_id = a.job_id WHERE a.status <> 'STAGING' GROUP BY x.task_id) v ON v.task_id = d.task_id
        LEFT JOIN (SELECT m.task_id, m.checkpoint_id AS k FROM manifests_v m JOIN pointers_v p ON p.checkpoint_id = m.checkpoint_id WHERE entries % 2 = 0) g ON g.task_id = d.task_id""",
    "newest_verified_checkpoint": """SELECT source AS task_id, doc_id AS checkpoint_id, doc_id % 40 AS created_at FROM documents WHERE doc_id % 3 = 0
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id % 40 DESC, doc_id DESC) = 1""",
    "manifest_drift": """SELECT job_id AS key, CASE WHEN job_id % 9 = 0 THEN 'added' WHEN job_id % 10 = 0 THEN 'removed' ELSE 'changed' END AS drift FROM docs_v
        WHERE (job_id % 9 = 0 AND job_id % 10 <> 0) OR (job_id % 9 <> 0 AND job_id % 10 = 0) OR (job_id % 9 <> 0 AND job_id % 10 <> 0 AND job_id % 11 = 0)""",
    "fenced_executions": """SELECT seq, o.worker_id % 5 AS worker_id, o.job_id, CASE WHEN o.job_id % 5 <> o.worker_id % 5 THEN 'owner_changed' ELSE 'authority_revoked' END AS fenced_by
        FROM open_v o JOIN orders ON o_orderkey = o.job_id JOIN revoked_v r ON r.spawn_seq = o.seq
        WHERE o.job_id % 5 <> o.worker_id % 5 OR (seq % 2 = 0 AND seq % 3 <> o.job_id % 3) OR (seq % 2 = 1 AND revoked_seq IS NOT NULL)""",
    "relevant_breakers": "SELECT scope_id, state FROM breakers_v WHERE scope_id IN (SELECT task_id::VARCHAR FROM jobs_v WHERE status = 'FAILED')",
    "open_attempts": "SELECT attempt_id, incident_id, attempt_state FROM openattempts_v",
    "desired_items": "SELECT o_orderkey AS desired_work_id, o_custkey AS task_id FROM orders WHERE o_orderkey % 10 <> 0",
    "desired_items_all": "SELECT o_orderkey % 10 = 0 AS retired, count(*) AS n FROM orders GROUP BY 1",
    "open_runs": "SELECT o_orderkey AS run_id, epoch_us(o_orderdate) AS started_at FROM orders WHERE o_orderstatus <> 'F'",
    "escalated_policies": "SELECT incident_id, terminal_state FROM incidents_v LEFT JOIN policies_v USING (incident_id) WHERE escalated_to = 'human'",
    "job_desired_items": """SELECT j.job_id, m.k AS desired_work_id FROM jobs_v j LEFT JOIN (SELECT o_orderkey AS k, o_orderkey + (o_orderkey % 23 = 7)::INT AS job FROM orders
        WHERE o_orderkey % 19 <> 4 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)) m ON m.job = j.job_id WHERE j.status = 'PENDING'""",
    "claims_by_expiry": """SELECT row_number() OVER (ORDER BY lease_expires_at, job_id)::INT AS rank, job_id, lease_expires_at FROM jobs_v
        WHERE status = 'CLAIMED' AND lease_expires_at > {NOW} ORDER BY lease_expires_at, job_id LIMIT 50""",
    "breakers_in_order": "SELECT row_number() OVER (ORDER BY scope_type, scope_id)::INT AS rank, scope_type, scope_id, state FROM relbreakers_v ORDER BY scope_type, scope_id LIMIT 50",
    "actor_rules": """SELECT o_orderkey, coalesce(starts_with(a, 'worker:'), false) AS is_worker, coalesce(a IN ('human', 'scheduler', 'system', 'test', 'reconciler'), false) AS may_create,
        coalesce(a IN ('recovery-controller', 'reconciler', 'system', 'operator', 'test'), false) AS may_reclaim
        FROM (SELECT o_orderkey, (['human', 'scheduler', 'worker:7', 'reconciler', 'worker', 'recovery-controller', NULL])[o_orderkey % 7 + 1] AS a FROM orders)""",
    "heartbeat_ingest": """SELECT worker_id, proc_id, seq, hb_seq, CASE WHEN fenced THEN 'fenced' WHEN hb_seq <= max(hb_seq) FILTER (WHERE NOT fenced) OVER (
          PARTITION BY worker_id, proc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'late' ELSE 'accepted' END AS outcome
        FROM (SELECT b.*, b.job IS NOT NULL AND NOT coalesce(b.token = j.fencing_token AND b.worker_id = CASE WHEN j.job_id % 2 = 0 THEN j.job_id % 20 ELSE 0 END, false) AS fenced
          FROM (SELECT seq, CASE WHEN seq % 6 <> 0 AND job_id % 4 = 0 THEN job_id % 20 ELSE worker_id % 20 END AS worker_id, proc_id % 3 AS proc_id, CASE WHEN seq % 6 <> 0 THEN job_id END AS job,
                       CASE WHEN seq % 11 <> 0 THEN job_id % 3 + 1 END AS token, proc_id + seq % 50 AS hb_seq FROM beats_v) b LEFT JOIN jobs_v j ON j.job_id = b.job)""",
    "claim_beats": """SELECT worker_id, CASE WHEN kind = 'beat' THEN ts END AS last_beat, kind = 'beat' AND {NOW_E} - ts <= {DAY} AS alive FROM (
        SELECT worker_id, ts, CASE WHEN seq % 9 = 0 THEN 'withdraw' WHEN seq % 31 = 0 THEN 'clear' ELSE 'beat' END AS kind FROM beats_v QUALIFY row_number() OVER (PARTITION BY worker_id ORDER BY seq DESC) = 1)""",
    "behaviour_events": """SELECT kind, event, sum(CASE WHEN reps THEN done ELSE 1 END)::BIGINT AS n, max(CASE WHEN reps THEN lead + (done - 1) * width + place ELSE lead + done * width + place END)::INT AS last FROM (
          SELECT b.*, CASE kind WHEN 'controlled_failure' THEN (k % 4 + 1) // 2 + 1 ELSE k % 4 + 1 END AS done
          FROM (SELECT o_orderkey AS k, (['success_immediate', 'success_delayed', 'controlled_failure', 'heartbeat_loop', 'hang', 'wedged', 'wedged_ignore_sigterm', 'wedged_spawn_child', 'crash',
                  'crash_after_stage', 'sigkill_self', 'expire_then_commit'])[o_orderkey % 12 + 1] AS kind FROM orders) o JOIN behaviours_v b USING (kind)) GROUP BY kind, event""",
    "sql_query": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey >= 5 GROUP BY c_nationkey",
}


def _needed(text: str) -> list[str]:
    """The views that a text names, and those that they name, in an order in which each can be defined."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in re.findall(r"\b\w+_v\b", t):
            if name not in out:
                visit(_view(name))
                out.append(name)

    visit(text)
    return list(dict.fromkeys(out))


def _view(name: str) -> str:
    return _edges() if name == "edges_v" else VIEWS[name]


def _fill(text: str) -> str:
    for name, value in (("NOW_E", NOW_E), ("NOW", NOW), ("DAY", DAY), ("HOUR", HOUR)):
        text = text.replace("{" + name + "}", str(value))
    return text


def _with(text: str) -> str:
    views = ", ".join(f"{v} AS ({_view(v)})" for v in _needed(text))
    return _fill(f"WITH {views} {text}" if views else text)


def _anchored(body: str, only: str, width: int) -> str:
    views = "".join(f"{v} AS ({_view(v)}), " for v in _needed("signals60_v"))
    return _fill((_ANCHORED + body).replace("{views}", views).replace("{only}", only).replace("{width}", str(width)))


def _admission_probes() -> str:
    """Probing jobs are taken one by one in their order; ``taken`` lists the scopes of the probes so far."""
    views = "".join(f"{v} AS ({_view(v)}), " for v in _needed("eligible_v breakers_v"))
    return _fill(f"""WITH RECURSIVE {views}
        judged AS (
          SELECT e.job_id, e.created_at, list_filter([CASE WHEN b.class = 'half_open' THEN {{'name': 'TASK:' || b.scope_id, 'used': b.used}} END,
                   CASE WHEN e.job_id % 40 % 3 = 1 THEN {{'name': 'DESIRED:' || (e.job_id % 40), 'used': 0}} END], lambda x: x IS NOT NULL) AS held
          FROM eligible_v e LEFT JOIN breakers_v b ON b.scope_id = e.task_id::VARCHAR WHERE b.class IS NULL OR b.class NOT IN ('open', 'corrupt')),
        p AS (SELECT *, row_number() OVER (ORDER BY created_at, job_id) AS i FROM judged WHERE len(held) > 0),
        step(i, taken, job) AS (
          SELECT 0::BIGINT, []::VARCHAR[], NULL::BIGINT UNION ALL
          SELECT i, CASE WHEN ok THEN list_concat(taken, list_transform(held, lambda h: h.name)) ELSE taken END, CASE WHEN ok THEN job_id END FROM (
            SELECT p.i, p.job_id, p.held, s.taken, list_bool_and(list_transform(p.held, lambda h: h.used + len(list_filter(s.taken, lambda x: x = h.name)) < 2)) AS ok
            FROM step s JOIN p ON p.i = s.i + 1))
        SELECT row_number() OVER (ORDER BY created_at, job_id)::INT AS rank, job_id FROM judged
        WHERE len(held) = 0 OR job_id IN (SELECT job FROM step WHERE job IS NOT NULL) ORDER BY created_at, job_id LIMIT 300""")


def _closure() -> str:
    return f"""WITH RECURSIVE e AS ({_edges()}), walk AS (
        SELECT entity, src, dst, 1 AS depth, src || '>' || dst AS path FROM e UNION ALL
        SELECT w.entity, w.src, e.dst, w.depth + 1, w.path || '>' || e.dst FROM walk w JOIN e ON e.entity = w.entity AND e.src = w.dst
        WHERE w.depth < 10 AND NOT list_contains(string_split(w.path, '>'), e.dst))
        SELECT entity, src, dst, min(depth)::BIGINT AS depth, arg_min(path, (depth, path)) AS path FROM walk GROUP BY entity, src, dst"""


ORACLES = {name: _with(text) for name, text in _TEXTS.items()} | {
    "state_closure": _closure(),
    "admission_probes": _admission_probes(),
    "anchored_window_count": _anchored(
        "SELECT scope_type, scope_id, max(start) AS window_started_at, arg_max(n, start) AS failure_count, max(n) AS peak FROM counted GROUP BY scope_type, scope_id",
        "scope_type = 'JOB'", 12 * HOUR,
    ),
    "breaker_trips": _anchored(
        "SELECT scope_type, scope_id, arg_max(n, start) AS failure_count FROM counted GROUP BY scope_type, scope_id "
        f"HAVING arg_max(n, start) >= CASE WHEN scope_type = 'GLOBAL' THEN 10 ELSE 3 END AND {NOW_E} - max(start) <= {10 * DAY}",
        "true", 10 * DAY,
    ),
}
