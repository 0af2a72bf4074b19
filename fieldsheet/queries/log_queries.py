"""Datasets, agents, tasks, messages."""

from pyspark.sql import functions as F

from ..operators import log
from ..sources import files as file_ops
from .registry import query


def messages(d):
    """The log with its JSON objects; some contents are lists of parts."""
    said = d.view("said")
    calls = F.when(F.col("call_id").isNotNull(), F.array(F.struct(
        F.col("call_id").alias("id"), F.struct(F.col("call_name").alias("name"), F.concat(F.lit("code "), "call_id").alias("arguments")).alias("function"))))
    plain = F.to_json(F.struct("role", "content", "tool_call_id", calls.alias("tool_calls")))
    parts = F.to_json(F.struct("role", F.array(F.struct(F.col("content").alias("text"))).alias("content"), "tool_call_id", calls.alias("tool_calls")))
    return said.select("message_id", "agent_id", "created_at", F.when(F.col("message_id") % 10 == 0, parts).otherwise(plain).alias("openai_obj"))


@query("tool_call_history", """SELECT c.agent_id, c.message_id, c.call_id, 'code ' || c.call_id AS code, r.content AS result FROM said c
LEFT JOIN (SELECT tool_call_id, arg_min(content, message_id) AS content FROM said WHERE tool_call_id IS NOT NULL GROUP BY 1) r ON r.tool_call_id = c.call_id WHERE call_name = 'Python'""")
def _(d):
    return log.tool_call_history(messages(d))


ARRIVED = "SELECT CAST(doc_id % 50 AS BIGINT) AS dataset_id, doc_id AS file_id, concat('f', CAST(doc_id AS STRING), '.csv') AS path, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(doc_id * 13 % 900 AS INT) AS {at} FROM documents"
MADE = "SELECT CAST(user_id % 50 AS BIGINT) AS dataset_id, event_id AS table_id, ts AS {at} FROM events"


@query("new_since_last_message", f"""WITH m AS (SELECT message_id, agent_id, dataset_id, created_at, role, lag(created_at) OVER (PARTITION BY agent_id ORDER BY created_at) AS prev FROM said),
 f AS (SELECT message_id, string_agg(path, ', ' ORDER BY arrived, file_id) AS l FROM m JOIN ({ARRIVED.format(at='arrived')}) a USING (dataset_id) WHERE role = 'user' AND a.arrived <= m.created_at AND (prev IS NULL OR a.arrived > prev) GROUP BY 1),
 t AS (SELECT message_id, string_agg(CAST(table_id AS STRING), ', ' ORDER BY arrived, table_id) AS l FROM m JOIN ({MADE.format(at='arrived')}) a USING (dataset_id) WHERE role = 'user' AND a.arrived <= m.created_at AND (prev IS NULL OR a.arrived > prev) GROUP BY 1)
SELECT message_id, '[NOTE: ' || concat_ws('; ', 'User uploaded file(s): ' || f.l, 'New table ids: [' || t.l || ']') || ']' AS note FROM f FULL JOIN t USING (message_id)""")
def _(d):
    said = d.view("said").select("message_id", "agent_id", "dataset_id", "created_at", "role")
    return log.new_since_last_message(said, d.sql(ARRIVED.format(at='at')), d.sql(MADE.format(at='at')))


@query("visible_rows", "SELECT agent_id, dataset_id, task FROM agents_of WHERE dataset_id IN (SELECT dataset_id FROM datasets_of WHERE user_id = 7)")
def _(d):
    return log.visible_rows(d.view("agents_of"), d.view("datasets_of"), 7, False).select("agent_id", "dataset_id", "task")


@query("visible_messages", "SELECT message_id, agent_id FROM said WHERE agent_id IN (SELECT agent_id FROM agents_of JOIN datasets_of USING (dataset_id) WHERE user_id = 7)")
def _(d):
    """Messages know their agent only."""
    return log.visible_rows(d.view("said").select("message_id", "agent_id"), d.view("datasets_of"), 7, False, d.view("agents_of"))


@query("dataset_cards", """WITH s AS (SELECT dataset_id, CAST(sum(n_rows) AS BIGINT) AS r, max(updated_at) AS u FROM registry_log GROUP BY 1),
 w AS (SELECT dataset_id, count(completed_at) AS done, bool_or(completed_at IS NULL) AS o, arg_max(agent_id, struct_pack(a := created_at, b := agent_id)) AS agent_id FROM agents_of GROUP BY 1),
 m AS (SELECT agent_id, arg_max(content, struct_pack(a := created_at, b := message_id)) AS c FROM said GROUP BY 1)
SELECT d.dataset_id, coalesce(r, 0) AS record_count, coalesce(u, created_at) AS last_updated, CASE WHEN rejected_at IS NOT NULL THEN 'rejected' WHEN published_at IS NOT NULL THEN 'published' WHEN o THEN 'processing' ELSE 'draft' END AS status,
 coalesce(done, 0) AS done, (SELECT count(*) FROM tasks_of) AS total, coalesce(CASE WHEN length(c) > 140 THEN substr(c, 1, 140) || '…' ELSE c END, '') AS preview
FROM datasets_of d LEFT JOIN s USING (dataset_id) LEFT JOIN w USING (dataset_id) LEFT JOIN m USING (agent_id)""")
def _(d):
    return log.dataset_cards(d.view("datasets_of"), d.view("registry_log"), d.view("agents_of"), d.view("tasks_of"), messages(d))


@query("visible_steps", """SELECT agent_id, dataset_id, task FROM agents_of WHERE completed_at IS NOT NULL
UNION ALL (SELECT agent_id, dataset_id, task FROM agents_of WHERE completed_at IS NULL QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY created_at, agent_id) = 1)""")
def _(d):
    return log.visible_steps(d.view("agents_of")).select("agent_id", "dataset_id", "task")


@query("next_step", """WITH k AS (SELECT dataset_id, bool_or(regexp_matches(lower(path), '\\.(newick|nwk|nex|nexus|tre|tree)$')) AS tree, bool_or(lower(path) LIKE '%.pdf') AS pdf, bool_or(regexp_matches(lower(path), '\\.(csv|tsv|txt|xlsx|xls|xlsm|xlsb|ods)$')) AS tab FROM files_of GROUP BY 1),
 a AS (SELECT * FROM agents_of),
 w AS (SELECT dataset_id, arg_min(task, struct_pack(a := created_at, b := agent_id)) FILTER (completed_at IS NULL) AS o, arg_max(CAST(substr(task, 1, 1) AS INT), struct_pack(a := created_at, b := agent_id)) AS l FROM a GROUP BY 1),
 c AS (SELECT d.dataset_id, min(t.name) AS nxt FROM datasets_of d LEFT JOIN w USING (dataset_id) LEFT JOIN k USING (dataset_id) JOIN tasks_of t ON t.task_order > coalesce(l, 0) AND (t.name <> '2-HIGH' OR coalesce(tree, FALSE)) AND (t.name <> '4-NOT SPECIFIED' OR coalesce(pdf AND NOT tab, FALSE)) GROUP BY 1)
SELECT d.dataset_id, CASE WHEN rejected_at IS NULL THEN coalesce(o, nxt) END AS task FROM datasets_of d LEFT JOIN w USING (dataset_id) LEFT JOIN c USING (dataset_id)""")
def _(d):
    files = d.view("files_of")
    modes = file_ops.source_mode(files).join(file_ops.has_tree(files), "dataset_id")
    agents = d.view("agents_of")
    tasks = d.view("tasks_of").withColumnRenamed("task_order", "order")
    return log.next_step(d.view("datasets_of"), agents, tasks, modes, "2-HIGH", "4-NOT SPECIFIED")


@query("allowed_functions", """SELECT agent_id, function FROM agents_of CROSS JOIN (VALUES ('Python'), ('UploadArchive'), ('SetTaskToComplete')) AS f(function)
WHERE NOT (function = 'UploadArchive' AND task NOT IN ('4-NOT SPECIFIED', '5-LOW')) AND NOT (function = 'SetTaskToComplete' AND task = (SELECT arg_max(name, task_order) FROM tasks_of))""")
def _(d):
    allowed = log.allowed_functions(d.view("tasks_of").withColumnRenamed("task_order", "order"), ["Python", "UploadArchive", "SetTaskToComplete"],
                                    ["UploadArchive"], ["4-NOT SPECIFIED", "5-LOW"], "SetTaskToComplete")
    return d.view("agents_of").join(allowed, F.col("task") == F.col("name")).select("agent_id", "function")


@query("last_messages", """SELECT agent_id, rank, message_id, role, CASE WHEN call_id IS NOT NULL THEN 'tool_calls: ' || call_name WHEN tool_call_id IS NOT NULL THEN 'tool_result for ' || tool_call_id || ': ' || c ELSE c END AS preview, rank <= 2 AS will_delete
FROM (SELECT *, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS c, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, message_id DESC) AS rank FROM said) WHERE rank <= 10""")
def _(d):
    return log.last_messages(messages(d))


DUPES = "SELECT event_id, user_id, event_type FROM events"


@query("dedupe_keep_first", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def _(d):
    return log.dedupe_keep_first(d.sql(DUPES), ["user_id", "event_type"], ["event_id"])[0]


@query("dedupe_surplus", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1")
def _(d):
    return log.dedupe_keep_first(d.sql(DUPES), ["user_id", "event_type"], ["event_id"])[1]


SAME = "SELECT user_id, event_type, CAST(event_id % 3 AS INT) AS k FROM events"


@query("surplus_of_equal_rows", f"SELECT * FROM ({SAME}) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k) > 1")
def _(d):
    return log.dedupe_keep_first(d.sql(SAME), ["user_id", "event_type"], ["k"])[1]


@query("untouched_tasks", "SELECT count(*) AS n_untouched FROM customer WHERE c_nationkey > 10 AND c_name NOT IN (SELECT c_name FROM customer WHERE c_nationkey < 20)")
def _(d):
    new = d.sql("SELECT c_name AS name, c_mktsegment AS text, c_custkey AS position FROM customer WHERE c_nationkey < 20")
    return log.upsert_tasks(d.sql("SELECT c_name AS name, 'older' AS text, 7 AS `order` FROM customer WHERE c_nationkey > 10"), new)[1]


@query("upsert_tasks", """WITH n AS (SELECT c_name AS name, c_mktsegment AS text, c_custkey AS p FROM customer WHERE c_nationkey < 20), o AS (SELECT s_name AS name, 'old' AS text, CAST(s_suppkey AS BIGINT) AS p FROM supplier UNION ALL SELECT c_name, 'older', 7 FROM customer WHERE c_nationkey > 10)
SELECT coalesce(n.name, o.name) AS name, coalesce(n.text, o.text) AS text, coalesce(n.p, o.p) AS "order", CASE WHEN n.name IS NULL THEN 'untouched' WHEN o.name IS NULL THEN 'created' ELSE 'updated' END AS action FROM o FULL JOIN n ON n.name = o.name""")
def _(d):
    new = d.sql("SELECT c_name AS name, c_mktsegment AS text, c_custkey AS position FROM customer WHERE c_nationkey < 20")
    old = d.sql("SELECT s_name AS name, 'old' AS text, CAST(s_suppkey AS BIGINT) AS `order` FROM supplier UNION ALL SELECT c_name, 'older', 7 FROM customer WHERE c_nationkey > 10")
    return log.upsert_tasks(old, new)[0]


@query("message_items", """SELECT agent_id, message_id, 0 AS pos, 'function_call_output' AS type, NULL AS role, tool_call_id AS call_id, NULL AS name, content AS text FROM said WHERE role = 'tool' AND tool_call_id IS NOT NULL
UNION ALL SELECT agent_id, message_id, 0, 'message', CASE WHEN role IN ('tool', 'critic') THEN 'user' ELSE role END, NULL, NULL, content FROM said WHERE (role = 'tool' AND tool_call_id IS NULL AND content <> '') OR (role = 'assistant' AND content <> '') OR role NOT IN ('tool', 'assistant')
UNION ALL SELECT agent_id, message_id, CASE WHEN content <> '' THEN 1 ELSE 0 END, 'function_call', NULL, call_id, call_name, 'code ' || call_id FROM said WHERE role = 'assistant'""")
def _(d):
    return log.message_items(messages(d))
