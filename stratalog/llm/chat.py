"""Chat formatting: tool calls and results linked, ordered, validated and written as canonical JSON.

A message whose text is a JSON object with a `tool_calls` array carries calls: id, name, arguments
(an object, or a string that holds one) and, if it waits for other calls, `after`: their ids. A
message of role `tool` whose text is a JSON object with `tool_call_id` and `content` is a result.
Everything else is plain. Results are joined to calls by (conversation, id); the join splits hot
conversations, and nothing is gathered per conversation: one row per message goes in and out.

Order: calls get a level, one above the highest call that they wait for (0 without), at any depth and
in few rounds for long chains (see :func:`call_levels`); calls in a cycle or behind one, and calls that wait for a call which is not
there, at whatever distance, get none. A sample is written in the order (turn, level, position): a message's calls stand in topological
order inside it, and a result takes the place of its call's turn and level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import WS_CLASS, discard, materialize

_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
#: Where calls without a level stand: after all others.
_LAST = 2**31 - 1

#: Names of JSON types in schemas, as the types that values are parsed to.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$"}


def _type_fits(kind, found):
    out = F.lit(False)
    for name, pattern in TYPES.items():
        out = F.when(kind == name, found.rlike(pattern)).otherwise(out)
    return out


def tool_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, position, call_id, name, arguments, after: the calls of messages (conv_id, turn, role, text)."""
    parsed = messages.where(F.trim("text").startswith("{") & F.col("text").contains("tool_calls")).select("conv_id", "turn", F.from_json("text", _CALLS).alias("p"))
    each = parsed.select("conv_id", "turn", F.posexplode("p.tool_calls").alias("position", "c"))
    return each.select("conv_id", "turn", "position", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, missing: the topological level of each distinct call.

    Calls in a cycle or behind one are absent; with a null level and ``missing`` stand those that wait,
    themselves or through others, for a call that is not there.

    An edge says: a call's level is at least max(a, level of ``begin`` + b). Each round puts the levels
    found last into the edges, which become constants (``begin`` null); calls of constants only are
    found. Calls with one open edge are functions of one other call and are composed by doubling, so
    that long chains take few rounds, also if their calls wait for others beside; edges to such calls
    are replaced by what they stand for. The rounds end when no call is found: what is left is cyclic.
    """
    key = ["conv_id", "call_id"]
    nodes = materialize(calls.where("call_id is not null").select(*key).distinct(), "nodes")
    waits = materialize(calls.where("call_id is not null").select(*key, F.explode("after").alias("begin")).distinct(), "waits")
    free = nodes.join(waits.select(*key).distinct(), key, "left_anti").select(*key, F.lit(0).alias("level"), F.lit(False).alias("missing"))
    # calls that are not there stand at level 0, and mark all that wait for them
    absent = waits.select("conv_id", F.col("begin").alias("call_id")).distinct().join(nodes, key, "left_anti")
    new = materialize(free.union(absent.select(*key, F.lit(0), F.lit(True))), "levels")
    found, edges = [new], waits.select(*key, "begin", F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(False).alias("missing"))
    if waits.isEmpty():
        discard(nodes)
        return new
    used = [waits]
    while not new.isEmpty():
        known = new.select("conv_id", F.col("call_id").alias("begin"), "level", F.col("missing").alias("lost"))
        met = F.col("level").isNotNull()
        joined = edges.join(known, ["conv_id", "begin"], "left").select(*key, F.when(~met, F.col("begin")).alias("begin"), F.when(met, F.greatest("a", F.col("level") + F.col("b"))).otherwise(F.col("a")).alias("a"), "b", (F.col("missing") | F.coalesce("lost", F.lit(False))).alias("missing"))
        merged = materialize(joined.groupBy(*key, "begin").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("missing").alias("missing")), "edges")
        calls_ = materialize(merged.groupBy(*key).agg(F.count("begin").alias("open"), F.max("begin").alias("begin"), F.max("a").alias("a"), F.max("b").alias("b"), F.max("missing").alias("missing")), "open-calls")
        new = materialize(calls_.where("open = 0").select(*key, F.col("a").alias("level"), "missing"), "levels")
        found.append(new)
        if len(found) > 8:
            whole = materialize(_union(found), "levels")
            for piece in found[:-1]:
                discard(piece)
            found = [whole]
        if calls_.where("open > 0").isEmpty():
            used = [*used, merged, calls_]
            break
        single = _composed(calls_.where("open = 1").select(*key, "begin", "a", "b", "missing"))
        several = merged.join(calls_.where("open > 1").select(*key), key, "left_semi")
        edges = materialize(single.union(_onward(several, single)), "edges")
        for done in (*used, merged, calls_, single):
            discard(done)
        used = [edges]
    levels = _union(found).join(nodes, key, "left_semi").withColumn("level", F.when(~F.col("missing"), F.col("level")))
    levels = materialize(levels, "levels")
    for done in (*used, *found, nodes):
        discard(done)
    return levels


def _union(pieces: list[DataFrame]) -> DataFrame:
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.union(piece)
    return out


def _onward(edges: DataFrame, single: DataFrame) -> DataFrame:
    """``edges`` with those that lead to a call of ``single`` led on to the call that it is a function of."""
    on = single.select("conv_id", F.col("call_id").alias("begin"), F.col("begin").alias("to"), F.col("a").alias("more_a"), F.col("b").alias("more_b"), F.col("missing").alias("lost"))
    step = F.col("to").isNotNull()
    return edges.join(on, ["conv_id", "begin"], "left").select(
        "conv_id",
        "call_id",
        F.coalesce("to", "begin").alias("begin"),
        F.when(step, F.greatest("a", F.col("more_a") + F.col("b"))).otherwise(F.col("a")).alias("a"),
        F.when(step, F.col("b") + F.col("more_b")).otherwise(F.col("b")).alias("b"),
        (F.col("missing") | F.coalesce("lost", F.lit(False))).alias("missing"),
    )


def _composed(single: DataFrame) -> DataFrame:
    """Calls that are functions of one other call, as functions of calls that are none; those that lead into a cycle are left out.

    Each round doubles the steps; a round in which no more calls get to their end leaves only cyclic ones.
    """
    now, ended = materialize(single, "singles"), -1
    while True:
        step = materialize(_onward(now, now), "singles")
        discard(now)
        now = step
        over = now.join(now.select("conv_id", F.col("call_id").alias("begin")), ["conv_id", "begin"], "left_anti")
        before, ended = ended, over.count()
        if ended == before:
            out = materialize(over.select(*now.columns), "singles")
            discard(now)
            return out


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, position, error of calls that break their tool's schema.

    ``schemas``: tool, param, type (a key of ``TYPES``), required. A tool without rows is unknown, a
    tool without parameters has one row with a null param. Errors: `unknown tool`, `not an object`,
    `missing p`, `type of p`, `unexpected p`; the first by name is reported.
    """
    key = ["conv_id", "turn", "position"]
    tools = schemas.select(F.col("tool").alias("name")).distinct()
    unknown = calls.join(tools, "name", "left_anti").select(*key, F.lit("unknown tool").alias("error"))
    known = calls.join(tools, "name", "left_semi").withColumn("v", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT<"), F.lit(False))
    bad = known.where(~is_object).select(*key, F.lit("not an object").alias("error"))
    objects = known.where(is_object)
    typed = _typed(objects, key)
    rules = schemas.where("param is not null").select(F.col("tool").alias("name"), "param", "type", F.coalesce("required", F.lit(False)).alias("required"))
    checked = typed.join(rules, ["name", "param"], "left")
    wrong = checked.where(F.col("type").isNull() | ~_type_fits(F.col("type"), F.col("found"))).select(*key, F.concat(F.when(F.col("type").isNull(), "unexpected ").otherwise("type of "), F.col("param")).alias("error"))
    asked = objects.select(*key, "name").join(rules.where("required"), "name").select(*key, "param")
    missing = asked.join(typed.select(*key, "param"), [*key, "param"], "left_anti").select(*key, F.concat(F.lit("missing "), F.col("param")).alias("error"))
    return unknown.union(bad).union(wrong).union(missing).groupBy(*key).agg(F.min("error").alias("error"))


def _typed(objects: DataFrame, key: list[str]) -> DataFrame:
    each = objects.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("at_", "param", "value_")
    return objects.lateralJoin(each).select(*key, "name", "param", F.schema_of_variant("value_").alias("found"))


def format_chats(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per message: conv_id, turn, order_turn, order_level, n_calls, n_linked, n_valid, linked_turn, error, json.

    json is canonical: sorted keys, no spaces, arguments parsed and rewritten alike. A message that
    carries calls lists them in topological order (no level: last, by position). For a result,
    linked_turn is its call's turn, and (order_turn, order_level) that call's place; error is
    `no call` without one. For calls, error is the first error of any of them: an argument error,
    `cycle`, or `after a missing call`. Without ``schemas`` arguments need only be objects. Calls of one id in one
    conversation: the first by (turn, position) is the one. Null texts are empty; null ids are never
    linked; repeated rows are returned as given, and count as one message for linking. Other columns
    are not read. Empty input: empty result.
    """
    rows = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    calls = materialize(tool_calls(rows).distinct(), "calls")
    place = ["conv_id", "turn", "position"]
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "position")).alias("at")).select("conv_id", "call_id", F.col("at.turn").alias("call_turn"), F.col("at.position").alias("call_position"))
    levels = call_levels(calls)
    first = materialize(first.join(levels, ["conv_id", "call_id"], "left"), "call-places")

    is_result = (F.col("role") == "tool") & F.trim("text").startswith("{")
    results = rows.withColumn("r", F.when(is_result, F.from_json("text", _RESULT))).withColumn("call_id", F.col("r.tool_call_id"))
    got = results.where("call_id is not null").select("conv_id", "call_id").distinct().withColumn("got", F.lit(1))

    if schemas is None:
        errors = calls.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT<"), F.lit(False))).select(*place, F.lit("not an object").alias("error")).distinct()
    else:
        errors = argument_errors(calls, schemas)
    full = calls.join(levels, ["conv_id", "call_id"], "left").join(got, ["conv_id", "call_id"], "left").join(errors, place, "left")
    full = full.withColumn("error", F.coalesce("error", F.when(F.col("missing"), F.lit("after a missing call")).when(F.col("level").isNull(), F.lit("cycle"))))
    entry = F.struct(F.coalesce("level", F.lit(_LAST)).alias("level"), "position", F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.to_json(F.struct(F.col("arguments").alias("raw"))))).alias("arguments"), F.col("call_id").alias("id"), "name")
    # the calls of one message
    by_message = full.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(_LAST)).alias("level"), "position", F.to_json(F.struct(entry["arguments"].alias("arguments"), entry["id"].alias("id"), entry["name"].alias("name"))).alias("json")))).alias("listed"),
        F.count("*").alias("n_calls"),
        F.sum(F.coalesce("got", F.lit(0))).alias("n_linked"),
        F.sum(F.col("error").isNull().cast("int")).alias("n_valid"),
        F.min("error").alias("call_error"),
    )
    out = results.join(by_message, ["conv_id", "turn"], "left").join(first, ["conv_id", "call_id"], "left")
    carries = F.col("listed").isNotNull() & F.trim("text").startswith("{")
    linked = F.col("call_id").isNotNull()
    head = lambda content: F.concat(F.lit('{"content":'), content)
    quoted = lambda c: F.regexp_replace(F.to_json(F.struct(c.alias("q"))), r'^\{"q":|\}$', "")
    tail = F.concat(F.lit(',"conv_id":'), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(',"role":'), F.when(F.col("role").isNull(), F.lit("null")).otherwise(quoted(F.col("role"))))
    turn = F.concat(F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    plain = F.concat(head(quoted(F.col("text"))), tail, turn)
    with_calls = F.concat(F.lit('{"conv_id":'), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(',"role":'), F.when(F.col("role").isNull(), F.lit("null")).otherwise(quoted(F.col("role"))), F.lit(',"tool_calls":['), F.array_join(F.transform("listed", lambda x: x["json"]), ","), F.lit("]"), turn)
    result = F.concat(head(quoted(F.coalesce("r.content", F.lit("")))), tail, F.lit(',"tool_call_id":'), quoted(F.col("call_id")), turn)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id",
        "turn",
        F.when(linked, F.coalesce("call_turn", "turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(linked, F.coalesce("level", F.lit(0)) + 1).otherwise(F.lit(0)).cast("int").alias("order_level"),
        zero(F.when(carries, F.col("n_calls"))).alias("n_calls"),
        zero(F.when(carries, F.col("n_linked"))).alias("n_linked"),
        zero(F.when(carries, F.col("n_valid"))).alias("n_valid"),
        F.when(linked, F.col("call_turn")).alias("linked_turn"),
        F.when(linked & F.col("call_turn").isNull(), F.lit("no call")).otherwise(F.when(carries, F.col("call_error"))).alias("error"),
        F.when(linked, result).when(carries, with_calls).otherwise(plain).alias("json"),
    )


#: The tools of :func:`tool_traffic`: tool, param, type, required.
TRAFFIC_TOOLS = [("search", "words", "integer", True), ("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]


def tool_traffic(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as the traffic of two tools, one message for each.

    A user's turn t carries two calls: r(t) to `reply`, with the text as its prompt, waits for s(t) and,
    from turn 2 on, for r(t - 2); s(t) to `search` has the number of words, and of lines where there
    are several, which that tool does not know. An assistant's turn t is the result of r(t - 1).
    Messages that are calls or results already, those of other roles and those without a turn stay.
    """
    text, t = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("turn")
    name = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    lines = F.size(F.split(text, "\n"))
    words = F.size(F.filter(F.split(text, f"[{WS_CLASS}]+"), lambda w: w != ""))
    known = F.to_json(F.struct(words.alias("words"), F.when(lines > 1, lines).alias("lines")))
    search = F.to_json(F.struct(name("s", t).alias("id"), F.lit("search").alias("name"), known.alias("arguments")))
    waits = F.concat(F.array(name("s", t)), F.when(t >= 2, F.array(name("r", t - 2))).otherwise(F.array().cast("array<string>")))
    reply = F.to_json(F.struct(name("r", t).alias("id"), F.lit("reply").alias("name"), F.struct(t.alias("turn"), text.alias("prompt")).alias("arguments"), waits.alias("after")))
    carried = F.concat(F.lit('{"tool_calls":['), reply, F.lit(","), search, F.lit("]}"))
    result = F.to_json(F.struct(name("r", t - 1).alias("tool_call_id"), text.alias("content")))
    stays = t.isNull() | F.col("role").isNull() | (F.trim(text).startswith("{") & text.rlike("tool_call"))
    asks, answers = ~stays & (F.col("role") == "user"), ~stays & (F.col("role") == "assistant")
    return conversations.select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), F.when(asks, carried).when(answers, result).otherwise(text).alias("text"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("tool", "param", "type", "required"), row, strict=True)]) for row in TRAFFIC_TOOLS])
    schemas = spark.range(1).select(F.inline(rows))
    return format_chats(tool_traffic(spark.read.parquet(f"{sf_dir}/conversations.parquet")), schemas)


#: Levels by recursion, links by join, errors and canonical JSON written out; texts of the tables are no JSON of calls.
OP1_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS q,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(string_split(coalesce(text, ''), chr(10))) AS lines FROM conversations),
u AS (SELECT DISTINCT conv_id, turn FROM m WHERE role = 'user'),
a AS (SELECT DISTINCT conv_id, turn FROM m WHERE role = 'assistant'),
lev AS (SELECT conv_id, turn, 1 AS level FROM u WHERE turn < 2
        UNION ALL SELECT u.conv_id, u.turn, lev.level + 1 FROM lev JOIN u ON u.conv_id = lev.conv_id AND u.turn = lev.turn + 2)
SELECT m.conv_id, m.turn, coalesce(asked.turn, m.turn) AS order_turn,
       CAST(CASE WHEN role = 'assistant' THEN coalesce(called.level, 0) + 1 ELSE 0 END AS INTEGER) AS order_level,
       CAST(CASE WHEN role = 'user' THEN 2 ELSE 0 END AS BIGINT) AS n_calls,
       CAST(CASE WHEN role = 'user' AND a.turn IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS n_linked,
       CAST(CASE WHEN role = 'user' THEN CAST(lines = 1 AS INTEGER) + CAST(own.level IS NOT NULL AS INTEGER) ELSE 0 END AS BIGINT) AS n_valid,
       asked.turn AS linked_turn,
       CASE WHEN role = 'assistant' AND asked.turn IS NULL THEN 'no call' WHEN role = 'user' AND own.level IS NULL THEN 'after a missing call'
            WHEN role = 'user' AND lines > 1 THEN 'unexpected lines' END AS error,
       CASE WHEN role = 'user' THEN '{"conv_id":' || m.conv_id || ',"role":"user","tool_calls":[{"arguments":{' || CASE WHEN lines > 1 THEN '"lines":' || lines || ',' ELSE '' END
                 || '"words":' || words || '},"id":"s' || m.turn || '","name":"search"},{"arguments":{"prompt":' || q || ',"turn":' || m.turn
                 || '},"id":"r' || m.turn || '","name":"reply"}],"turn":' || m.turn || '}'
            WHEN role = 'assistant' THEN '{"content":' || q || ',"conv_id":' || m.conv_id || ',"role":"tool","tool_call_id":"r' || (m.turn - 1) || '","turn":' || m.turn || '}'
            ELSE '{"content":' || q || ',"conv_id":' || m.conv_id || ',"role":' || CAST(to_json(role) AS VARCHAR) || ',"turn":' || m.turn || '}' END AS json
FROM m LEFT JOIN u AS asked ON role = 'assistant' AND asked.conv_id = m.conv_id AND asked.turn = m.turn - 1
LEFT JOIN lev AS called ON called.conv_id = asked.conv_id AND called.turn = asked.turn
LEFT JOIN lev AS own ON role = 'user' AND own.conv_id = m.conv_id AND own.turn = m.turn
LEFT JOIN a ON role = 'user' AND a.conv_id = m.conv_id AND a.turn = m.turn + 1
"""
