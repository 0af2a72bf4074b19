"""Datasets, agents, tasks and messages: histories, cards, steps, visibility.

``messages`` is (message_id, agent_id, created_at, openai_obj) with the object as JSON text.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import clean_text, strip
from ..plans.scans import carry_last, carry_next, running_sum
from ..plans.scratch import materialize
from ..plans.topk import first_per_key, last_per_key, top_k

MESSAGE = ("role string, content variant, tool_call_id string, "
           "tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>")

# Bytes that a listed piece takes besides its text, least step of the windows of notes, steps of notes made from one copy.
ITEM, STEP, SHARED = 64, 16384, 128


def parse_messages(messages: DataFrame) -> DataFrame:
    """Messages with role, content text and tool calls as columns; bad JSON gives nulls."""
    parsed = messages.withColumn("_m", F.from_json("openai_obj", MESSAGE)).drop("openai_obj")
    return parsed.select("*", F.lower(strip(F.col("_m.role"))).alias("role"), content_text(F.col("_m.content")).alias("content"),
                         F.col("_m.tool_call_id").alias("tool_call_id"), F.col("_m.tool_calls").alias("tool_calls")).drop("_m")


def content_text(c: Column) -> Column:
    """Text of a message content: a text, a list of parts, or an object with a ``text``."""
    def part(v):
        kind = F.schema_of_variant(v)
        inner = F.try_variant_get(v, "$.text", "string")
        return (F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
                .when(kind.startswith("OBJECT") & inner.isNotNull(), inner).otherwise(F.to_json(v)))

    parts = F.transform(F.try_variant_get(c, "$", "array<variant>"), part)
    listed = F.schema_of_variant(c).startswith("ARRAY")
    return F.when(F.is_variant_null(c), F.lit("")).otherwise(
        F.coalesce(F.when(listed, F.array_join(parts, "\n")).otherwise(part(c)), F.lit("")))


def tool_call_history(messages: DataFrame, function: str = "Python") -> DataFrame:
    """(agent_id, message_id, call_id, code, result) of the calls of one tool, with the first answer."""
    parsed = parse_messages(messages)
    calls = parsed.select("agent_id", "message_id", F.explode("tool_calls").alias("c")).filter(F.col("c.function.name") == function)
    answers = parsed.filter("tool_call_id IS NOT NULL").select(F.col("tool_call_id").alias("call_id"), "message_id", "content")
    first = first_per_key(answers, ["call_id"], ["message_id"]).select("call_id", F.col("content").alias("result"))
    return calls.select("agent_id", "message_id", F.col("c.id").alias("call_id"), F.col("c.function.arguments").alias("code")).join(
        first, "call_id", "left").select("agent_id", "message_id", "call_id", "code", "result")


def new_since_last_message(messages: DataFrame, files: DataFrame, tables: DataFrame) -> DataFrame:
    """(message_id, note): files and tables that arrived since the agent's previous message.

    ``messages`` is (message_id, agent_id, dataset_id, created_at, role); ``files`` (dataset_id,
    file_id, path, at); ``tables`` (dataset_id, table_id, at). Each arrival belongs to the agent's
    first message at or after it; a scan in time order, cut into days, finds that message.

    Agents of the same datasets share their arrivals: the times of their messages cut time into
    spans, and the arrivals of a span are listed once, an hour at a time. A message takes a run of spans,
    found by how many bytes are listed up to its time and up to the message before it.
    """
    agents = messages.groupBy("agent_id").agg(F.sort_array(F.collect_set("dataset_id")).alias("group"))
    owned = agents.select("group").distinct().select("group", F.explode("group").alias("dataset_id"))
    arrived = (files.select("dataset_id", "at", F.lit("f").alias("kind"), "file_id", F.col("path").alias("text"))
               .unionByName(tables.select("dataset_id", "at", F.lit("t").alias("kind"), F.col("table_id").alias("file_id"), F.col("table_id").cast("string").alias("text")))
               .filter("at IS NOT NULL").join(owned, "dataset_id"))
    day, hour = 2 * 86400 * 1000000, 2 * 3600 * 1000000
    events = arrived.select("group", (F.unix_micros("at") * 2).alias("t"), F.struct("kind", "file_id", "text").alias("item"))
    said = (messages.select("agent_id", (F.unix_micros("created_at") * 2 + 1).alias("t"), "message_id", "role").filter("t IS NOT NULL")
            .join(agents.withColumnRenamed("agent_id", "_a"), F.col("agent_id").eqNullSafe(F.col("_a"))).drop("_a"))
    ends = said.select("group", "t").distinct()
    spans = carry_next(events.unionByName(ends, allowMissingColumns=True), ["group"], "t", "span", F.when(F.col("item").isNull(), F.col("t")), day)
    texts = F.sort_array(F.collect_list(F.struct("t", "item.file_id", "item.text")))["text"]
    pieces = (spans.filter("item IS NOT NULL AND span IS NOT NULL").groupBy("group", "span", F.floor(F.col("t") / hour).alias("hour"), F.col("item.kind").alias("kind"))
              .agg(texts.alias("texts")).select("group", "span", "hour", "kind", F.when(
                  F.exists("texts", lambda x: x.isNotNull()), F.array_join("texts", ", ")).alias("text")))
    pieces = materialize(pieces, "arrivals")  # read for the spans and for the texts
    sizes = pieces.groupBy("group", F.col("span").alias("t")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ITEM).alias("n"))
    marks = running_sum(ends.unionByName(sizes, allowMissingColumns=True).groupBy("group", "t").agg(F.sum("n").alias("n")), ["group"], "t", {"to": F.col("n")}, day)
    marks = materialize(marks, "marks")  # read for the messages and for the spans
    one = said.filter("message_id IS NOT NULL").groupBy("agent_id", "group", "t").agg(F.min(F.struct("message_id", "role")).alias("m"))
    # every message tells the next its place, and asks just before its own time
    rows = one.join(marks.hint("merge"), ["group", "t"]).withColumn("asks", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "agent_id", (F.col("t") - F.col("asks")).alias("at"), "asks", "group", "t", "to", "m")
    placed = carry_last(rows, ["agent_id"], "at", {"last": F.when(F.col("asks") == 0, F.struct("t", "to"))}, day)
    runs = placed.filter("asks = 1 AND m.role = 'user'").select(
        "m.message_id", "group", F.coalesce("last.t", F.lit(-(2**63))).alias("after"), "t", F.coalesce("last.to", F.lit(0)).alias("start"), "to").filter("to > start")
    return _notes(runs, pieces, marks.filter("n IS NOT NULL").select("group", F.col("t").alias("span"), (F.col("to") - F.col("n")).alias("start"), "to"))


def _notes(runs: DataFrame, pieces: DataFrame, spans: DataFrame) -> DataFrame:
    """(message_id, note) of runs of spans: (message_id, group, after, t, start, to), ``start`` and ``to`` in bytes of the group.

    Notes of many agents list the same arrivals, so lists go to the messages and are never shuffled
    per message: a run lies whole in a window twice as long as the least step at or above its
    length, so a window is at most eight times as long as a note made from it (or two least steps).
    Only windows that a run asks for are listed; one with many notes is repeated for every ``SHARED`` steps of them.
    """
    length, at = F.col("to") - F.col("start"), ["group", "step", "block"]
    steps = F.array(*[F.lit(STEP * 4**i).cast("long") for i in range(20)])
    runs = runs.withColumn("step", F.element_at(F.filter(steps, lambda s: s >= length), 1)).withColumn("block", F.floor(F.col("start") / F.col("step")))
    runs = materialize(runs.withColumn("runs", F.count(F.lit(1)).over(W.partitionBy("message_id"))), "runs")  # read for the windows and for the notes
    used = runs.groupBy(*at).agg((F.floor(F.sum(length) / (F.col("step") * SHARED)) + 1).alias("copies"))
    first = F.floor(F.col("start") / F.col("step"))
    held = (spans.withColumn("step", F.explode(runs.agg(F.collect_set("step")).scalar())).withColumn("block", F.explode(F.array(first, first - 1)))
            .filter("to <= (block + 2) * step").select("group", "span", "step", "block").join(used.hint("merge"), at))
    windows = pieces.join(held.hint("merge"), ["group", "span"]).groupBy(*at, "copies").agg(
        F.sort_array(F.collect_list(F.struct("kind", "span", "hour", "text"))).alias("items"))
    windows = windows.select(*at, "items", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    dealt = runs.join(used.hint("merge"), at).withColumn("copy", F.pmod(F.xxhash64("message_id", "after", "t"), F.col("copies")))
    taken = dealt.join(windows.hint("merge"), [*at, "copy"]).select("message_id", "runs", F.filter(
        "items", lambda i: (i["span"] > F.col("after")) & (i["span"] <= F.col("t"))).alias("items"))
    again = taken.filter("runs > 1").groupBy("message_id").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("items"))  # ids that repeat

    def listed(kind):
        return F.array_join(F.transform(F.filter("items", lambda i: i["kind"] == kind), lambda i: i["text"]), ", ")

    both = taken.filter("runs = 1").select("message_id", "items").unionByName(again).select("message_id", listed("f").alias("f"), listed("t").alias("t"))
    files_text = F.when(F.col("f") != "", F.concat(F.lit("User uploaded file(s): "), "f"))
    tables_text = F.when(F.col("t") != "", F.concat(F.lit("New table ids: ["), "t", F.lit("]")))
    return both.select("message_id", F.concat(F.lit("[NOTE: "), F.concat_ws("; ", files_text, tables_text), F.lit("]")).alias("note"))


def visible_rows(df: DataFrame, datasets: DataFrame, user_id, is_superuser: bool, agents: DataFrame | None = None) -> DataFrame:
    """All rows for a superuser, else the rows of datasets the user owns.

    Rows without a ``dataset_id`` are seen through their agent: with ``agents`` (agent_id, dataset_id)
    the user sees the rows of agents that work on an own dataset.
    """
    if is_superuser:
        return df
    own = datasets.filter(F.col("user_id") == F.lit(user_id)).select("dataset_id").distinct()
    if "dataset_id" in df.columns:
        return df.join(own, "dataset_id", "left_semi")
    if agents is None:
        raise ValueError("rows without dataset_id need the agents")
    return df.join(agents.join(own, "dataset_id", "left_semi").select("agent_id"), "agent_id", "left_semi")


def dataset_cards(datasets: DataFrame, tables: DataFrame, agents: DataFrame, tasks: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per dataset: records, last update, status, progress and a preview of the last message."""
    sizes = tables.groupBy("dataset_id").agg(F.sum("n_rows").alias("_records"), F.max("updated_at").alias("_updated"))
    work = agents.groupBy("dataset_id").agg(
        F.count("completed_at").alias("done"), F.bool_or(F.col("completed_at").isNull()).alias("_open"),
        F.max(F.struct("created_at", "agent_id"))["agent_id"].alias("agent_id"))
    newest = last_per_key(messages.join(work.select("agent_id"), "agent_id", "left_semi"), ["agent_id"], ["created_at", "message_id"])
    text = parse_messages(newest).select("agent_id", F.when(F.length("content") > 140, F.concat(
        F.left("content", F.lit(140)), F.lit("…"))).otherwise(F.col("content")).alias("_preview"))
    total = tasks.agg(F.count(F.lit(1))).scalar()
    status = (F.when(F.col("rejected_at").isNotNull(), "rejected").when(F.col("published_at").isNotNull(), "published")
              .when(F.col("_open"), "processing").otherwise("draft"))
    return (datasets.join(sizes, "dataset_id", "left").join(work, "dataset_id", "left").join(text, "agent_id", "left")
            .withColumn("total", total)
            .select("dataset_id", F.coalesce("_records", F.lit(0)).alias("record_count"), F.coalesce("_updated", "created_at").alias("last_updated"),
                    status.alias("status"), F.coalesce("done", F.lit(0)).alias("done"), "total", F.coalesce("_preview", F.lit("")).alias("preview")))


def visible_steps(agents: DataFrame) -> DataFrame:
    """Completed agents and the first open one of each dataset."""
    first = first_per_key(agents.filter("completed_at IS NULL"), ["dataset_id"], ["created_at", "agent_id"])
    return agents.filter("completed_at IS NOT NULL").unionByName(first.select(agents.columns))


def next_step(datasets: DataFrame, agents: DataFrame, tasks: DataFrame, modes: DataFrame, tree_task: str, manuscript_task: str) -> DataFrame:
    """(dataset_id, task): what a dataset has to do next, null if nothing.

    ``modes`` is (dataset_id, source_mode, has_tree). Which task follows which is worked out once for
    the four kinds of datasets (with a tree or not, of a manuscript alone or not); a dataset finds its
    own by its kind and last task, so the task list may be of any size. Tasks of equal order are one step, named by the least name.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(p).alias("pdf")) for t in (True, False) for p in (True, False)]))
    start = tasks.sparkSession.range(1).select(*[F.lit(None).cast(tasks.schema[c].dataType).alias(c) for c in ("name", "order")])
    steps = tasks.select("name", "order").unionByName(start).select("*", kinds.alias("kind"))
    allowed = ((F.col("name") != tree_task) | F.col("kind.tree")) & ((F.col("name") != manuscript_task) | F.col("kind.pdf"))
    steps = steps.groupBy("kind", F.struct("order").alias("_last")).agg(F.min(F.when(allowed, F.col("name"))).alias("_name"))
    behind = W.partitionBy("kind").orderBy("_last").rowsBetween(1, W.unboundedFollowing)
    steps = steps.select("kind", "_last", F.first("_name", True).over(behind).alias("_next"))
    named = agents.join(tasks.select(F.col("name").alias("task"), F.col("order").alias("_o")), "task", "left")
    work = named.groupBy("dataset_id").agg(
        F.min(F.when(F.col("completed_at").isNull(), F.struct("created_at", "agent_id", "task")))["task"].alias("_open"),
        F.max(F.struct("created_at", "agent_id", "_o"))["_o"].alias("_order"))
    tree, pdf = F.coalesce("has_tree", F.lit(False)), F.coalesce(F.col("source_mode") == "pdf_only", F.lit(False))
    joined = (datasets.join(work, "dataset_id", "left").join(modes, "dataset_id", "left")
              .withColumns({"kind": F.struct(tree.alias("tree"), pdf.alias("pdf")), "_last": F.struct(F.col("_order").alias("order"))})
              .join(steps, ["kind", "_last"], "left"))
    return joined.select("dataset_id", F.when(F.col("rejected_at").isNull(), F.coalesce("_open", "_next")).alias("task"))


def allowed_functions(tasks: DataFrame, functions, publish_functions, publish_tasks, completion: str) -> DataFrame:
    """(name, function): the tools of each task. Publishing only in some tasks, completion not in the last one."""
    pairs = tasks.withColumn("function", F.explode(F.array(*[F.lit(f) for f in functions]))).withColumn("_last", tasks.agg(F.max_by("name", "order")).scalar())
    refused = ((F.col("function").isin(list(publish_functions)) & ~F.col("name").isin(list(publish_tasks)))
               | ((F.col("function") == completion) & (F.col("name") == F.col("_last"))))
    return pairs.filter(~refused).select("name", "function")


def last_messages(messages: DataFrame, n: int = 10, delete: int = 2) -> DataFrame:
    """(agent_id, rank, message_id, role, preview, will_delete): the newest messages of each agent."""
    newest = top_k(messages, ["agent_id"], [F.desc("created_at"), F.desc("message_id")], n)
    p = parse_messages(newest)
    names = F.transform("tool_calls", lambda c: c["function"]["name"])
    text = F.when(F.length("content") > 100, F.concat(F.left("content", F.lit(100)), F.lit("..."))).otherwise(F.col("content"))
    preview = (F.when(F.size("tool_calls") > 0, F.concat(F.lit("tool_calls: "), F.array_join(names, ", ")))
               .when(F.col("tool_call_id") != "", F.concat(F.lit("tool_result for "), F.col("tool_call_id"), F.lit(": "), text)).otherwise(text))
    return p.select("agent_id", "rank", "message_id", F.coalesce("role", F.lit("unknown")).alias("role"), preview.alias("preview"),
                    (F.col("rank") <= delete).alias("will_delete"))


def dedupe_keep_first(t: DataFrame, key, order):
    """(kept, surplus): the first row of each key, and all others; of equal rows one is first, the rest are surplus.

    Equal rows are counted first, so a key with many rows is reduced before it is dealt out; ties in
    ``order`` are broken by the other columns. Null keys are keys like any other.
    """
    key = [key] if isinstance(key, str) else list(key)
    rows = t.groupBy(*t.columns).agg(F.count(F.lit(1)).alias("_n"))
    kept = first_per_key(rows, key, [*order, *[c for c in t.columns if c not in (*key, *order)]]).select(t.columns)
    first = kept.select(F.struct(*t.columns).alias("_row"), F.lit(1).alias("_kept"))
    left = F.col("_n").cast("int") - F.coalesce("_kept", F.lit(0))
    rest = rows.withColumn("_row", F.struct(*t.columns)).join(first, "_row", "left").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), left)))
    return kept, rest.select(t.columns)


def upsert_tasks(tasks: DataFrame, new: DataFrame):
    """(tasks, n_untouched): tasks updated by name; ``order`` is the position in the new list.

    Tasks missing from the list stay as they are and are counted.
    """
    named = new.filter(clean_text(F.col("name")).isNotNull())
    merged = tasks.select("name", F.col("text").alias("_t"), F.col("order").alias("_o")).join(
        named.select("name", "text", F.col("position").alias("order")), "name", "full")
    action = F.when(F.col("order").isNull(), "untouched").when(F.col("_o").isNull(), "created").otherwise("updated")
    out = merged.select("name", F.coalesce("text", "_t").alias("text"), F.coalesce("order", "_o").alias("order"), action.alias("action"))
    return out, tasks.join(named.select("name").distinct(), "name", "left_anti").agg(F.count(F.lit(1)).alias("n_untouched"))


def message_items(messages: DataFrame) -> DataFrame:
    """Flat items (agent_id, message_id, pos, type, role, call_id, name, text) of a message log.

    An answer of a tool is a call output (user text if it names no call); an assistant message is its
    text followed by its calls; any other role is system or user text.
    """
    p = parse_messages(messages)
    none = F.lit(None).cast("string")

    def item(kind, role, call, name, text):
        return F.struct(F.lit(kind).alias("type"), role.alias("role"), call.alias("call_id"), name.alias("name"), text.alias("text"))

    filled = F.col("content") != ""
    empty = F.array().cast("array<struct<type:string,role:string,call_id:string,name:string,text:string>>")
    output = item("function_call_output", none, F.col("tool_call_id"), none, F.col("content"))

    def say(role):
        return F.array(item("message", role, none, none, F.col("content")))

    tool = F.when(F.col("tool_call_id") != "", F.array(output)).when(filled, say(F.lit("user"))).otherwise(empty)
    calls = F.transform(F.filter(F.coalesce("tool_calls", F.array().cast(p.schema["tool_calls"].dataType)),
                                 lambda c: (c["id"] != "") & (c["function"]["name"] != "")),
                        lambda c: item("function_call", none, c["id"], c["function"]["name"], F.coalesce(c["function"]["arguments"], F.lit("{}"))))
    assistant = F.concat(F.when(filled, say(F.lit("assistant"))).otherwise(empty), calls)
    other = say(F.when(F.col("role").isin("system", "user"), F.col("role")).otherwise("user"))
    items = F.when(F.col("role") == "tool", tool).when(F.col("role") == "assistant", assistant).otherwise(other)
    return p.select("agent_id", "message_id", F.posexplode(items).alias("pos", "i")).select("agent_id", "message_id", "pos", "i.*")
