"""Chat formatting by schema fingerprints.

A record is a JSON text in one of several layouts: a prompt with its completion,
an instruction with optional input, or a list of messages under several names.
The schema of each record, its nested field paths as they are, is hashed to a
fingerprint. The fingerprints of the layouts select their declarative mapping; of a
record of any other one, with further fields or of several layouts at once, the
first layout in the order of ``LAYOUTS`` whose paths are filled is taken. The
mapping gives the canonical turns. All of it is one projection without Python or
shuffle.

Semantics
  * A path counts as filled if its value isn't JSON null; a path into a list, if
    any element fills it. Fields that no layout names don't matter.
  * A record that is null, no JSON object or fills no layout's paths has
    null layout and null turns; it is kept.
  * Content that is a list of parts becomes the texts of its parts (strings, or
    objects with a ``text``), joined by newlines; without any it is null.
  * The results are named layout and turns; where the input has such a column,
    with a leading underscore (more if taken).
  * Roles are lower-cased and renamed by ``ROLES``; a null one is "unknown".
    Turns with null content are left out; empty content stays. Turns keep the
    order of the record and its repeated ones.
  * Conversation tables: the turns of a conv_id are ordered by (turn, role, text),
    nulls first; null conv_ids are one conversation; repeated rows are repeated
    turns; rows with null text are left out, and a conversation of only such
    rows has no turns. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant", "developer": "system", "function": "tool"}
SCHEMA = (
    "messages array<struct<role string, content variant>>, conversations array<struct<`from` string, value variant>>, "
    "dialog array<array<string>>, system string, prompt string, completion string, response string, "
    "instruction string, input string, output string, question string, answer string"
)
LISTS = {"messages": ("role", "content"), "conversations": ("from", "value")}
TURN = "struct<role:string,content:string>"


@dataclass(frozen=True)
class Layout:
    """Paths that a record of the layout fills, those that it may fill, and its turns as (role, path)."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]


#: A role of "*" says that the path is a list that names its roles; two paths joined by + become one text.
LAYOUTS = (
    Layout("messages", ("messages[].content",), ("messages[].role", "system"), (("system", "system"), ("*", "messages"))),
    Layout("conversations", ("conversations[].value",), ("conversations[].from", "system"), (("system", "system"), ("*", "conversations"))),
    Layout("dialog", ("dialog[][]",), ("system",), (("system", "system"), ("*", "dialog"))),
    Layout("completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Layout("question", ("question", "answer"), ("system",), (("system", "system"), ("user", "question"), ("assistant", "answer"))),
)
PATHS = tuple(dict.fromkeys(p for x in LAYOUTS for p in (*x.needs, *x.may)))


def _filled(parsed: Column, path: str) -> Column:
    if path == "dialog[][]":
        return F.exists(parsed["dialog"], lambda x: F.exists(x, lambda y: y.isNotNull()))
    if "[]." in path:
        name, field = path.split("[].")
        value = lambda x: x.getField(field).isNotNull() & (F.schema_of_variant(x.getField(field)) != "VOID") if field in ("content", "value") else x.getField(field).isNotNull()
        return F.exists(parsed[name], lambda x: F.coalesce(value(x), F.lit(False)))
    return parsed[path].isNotNull()


def shape_of(record: Column) -> Column:
    """The schema of a JSON text: its nested field paths, with the kinds of plain values left out; null if it can't be parsed."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), r"(: |ARRAY<)(?!OBJECT<|ARRAY<|VOID)[A-Z_]+(\([0-9,]+\))?(?=[,>])", "$1*")


def shape(paths: list[str]) -> str:
    """The shape that ``shape_of`` gives of a record of these paths."""
    tree: dict = {}
    for p in paths:
        name, _, field = p.partition("[]")
        tree.setdefault(name, []).append(field)

    def kind(fields: list[str]) -> str:
        if fields == [""]:
            return "*"
        if fields == ["[]"]:
            return "ARRAY<ARRAY<*>>"
        return f"ARRAY<OBJECT<{', '.join(f'{x[1:]}: *' for x in sorted(fields))}>>"

    return f"OBJECT<{', '.join(f'{n}: {kind(tree[n])}' for n in sorted(tree))}>"


def fingerprints() -> dict[str, str]:
    """The shapes of all layouts, with and without what they may fill."""
    found: dict[str, str] = {}
    for x in LAYOUTS:
        for some in chain.from_iterable(combinations(x.may, k) for k in range(len(x.may) + 1)):
            found[shape([*x.needs, *some])] = x.name
    return found


def content_of(value: Column) -> Column:
    """The text of a content that may be a list of parts."""
    whole = F.try_variant_get(value, "$", "string")
    part = lambda e: F.coalesce(F.try_variant_get(e, "$.text", "string"), F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")))
    texts = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), part), lambda t: t.isNotNull())
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), F.when(F.size(texts) > 0, F.array_join(texts, "\n"))).otherwise(whole)


def role_of(role: Column) -> Column:
    low = F.lower(F.trim(role))
    known = F.lit(None).cast("string")
    for a, b in ROLES.items():
        known = F.when(low == a, F.lit(b)).otherwise(known)
    return F.coalesce(known, F.when(low != "", low), F.lit("unknown"))


def _turn(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def _turns(parsed: Column, layout: Layout) -> Column:
    parts = []
    for role, path in layout.turns:
        if role != "*":
            first, _, second = path.partition("+")
            text = parsed[first]
            if second:
                text = F.concat(text, F.when(F.coalesce(parsed[second], F.lit("")) != "", F.concat(F.lit("\n\n"), parsed[second])).otherwise(F.lit("")))
            parts.append(F.array(_turn(F.lit(role), text)))
        elif path == "dialog":
            # speakers alternate, the user first
            flat = F.flatten(F.transform(parsed[path], lambda x: F.coalesce(x, F.array().cast("array<string>"))))
            parts.append(F.transform(flat, lambda x, i: _turn(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")), x)))
        else:
            a, b = LISTS[path]
            parts.append(F.transform(parsed[path], lambda x: _turn(role_of(x.getField(a)), content_of(x.getField(b)))))
    whole = F.concat(*[F.coalesce(p.cast(f"array<{TURN}>"), F.array().cast(f"array<{TURN}>")) for p in parts])
    return F.filter(whole, lambda t: t["content"].isNotNull())


def canonical(records: DataFrame, column: str = "record") -> DataFrame:
    """The input's columns with layout and turns (array of role and content)."""
    parsed, key, chosen = (free(n, records.columns) for n in ("parsed", "fingerprint", "chosen"))
    out = records.withColumn(parsed, F.from_json(F.col(column), SCHEMA)).withColumn(key, F.xxhash64(shape_of(F.col(column))))
    # other fingerprints: the first layout whose paths are filled
    layout = F.coalesce(*[F.when(_all([F.coalesce(_filled(F.col(parsed), p), F.lit(False)) for p in x.needs]), F.lit(x.name)) for x in LAYOUTS])
    by: dict[str, list[str]] = {}
    for shape_, name in fingerprints().items():
        by.setdefault(name, []).append(shape_)
    for name, some in by.items():
        # literals hashed by the same function; the optimizer folds them
        layout = F.when(F.col(key).isin([F.xxhash64(F.lit(p)) for p in some]), F.lit(name)).otherwise(layout)
    out = out.withColumn(chosen, layout)
    turns = F.lit(None).cast(f"array<{TURN}>")
    for x in LAYOUTS:
        turns = F.when(F.col(chosen) == x.name, _turns(F.col(parsed), x)).otherwise(turns)
    return out.select(*[F.col(f"`{c}`") for c in records.columns], F.col(chosen).alias(free("layout", records.columns)), turns.alias(free("turns", records.columns)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def rendered(turns: Column) -> Column:
    """The turns as one text with role marks."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["content"], F.lit("<|end|>\n"))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """conv_id and record: each conversation in one of the layouts that can hold its turns.

    Which of the possible ones follows from its shape and conv_id, as a corpus
    put together from several publishers has them.
    """
    turn = F.struct("turn", "role", "text")
    held = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), turn)), _before).alias("t"))
    roles = F.transform("t", lambda x: F.coalesce(x["role"], F.lit("")))
    t = lambda i: F.get("t", i)["text"]
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    rename = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shares = F.to_json(F.struct(F.transform("t", lambda x: F.struct(rename(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
    dialog = F.to_json(F.struct(F.array(F.transform("t", lambda x: x["text"])).alias("dialog")))
    pair = lambda a, b: F.to_json(F.struct(t(0).alias(a), t(1).alias(b)))
    triple = lambda a, b: F.to_json(F.struct(t(0).alias("system"), t(1).alias(a), t(2).alias(b)))
    alternates = F.forall(F.transform(roles, lambda r, i: r == F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))), lambda x: x) & (F.size("t") > 0)
    two = roles == F.array(F.lit("user"), F.lit("assistant"))
    three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    k = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(6))
    record = (
        F.when(two & (k == 0), pair("prompt", "completion"))
        .when(two & (k == 1), pair("prompt", "response"))
        .when(two & (k == 2), pair("instruction", "output"))
        .when(two & (k == 3), pair("question", "answer"))
        .when(three & (k < 3), triple("prompt", "completion"))
        .when(three & (k == 3), triple("instruction", "output"))
        .when(alternates & (k == 4), dialog)
        .when(k < 2, shares)
        .otherwise(messages)
    )
    return held.select("conv_id", record.alias("record"))


def _before(a: Column, b: Column) -> Column:
    """Order of turns: by turn, role and text, nulls first."""

    def one(name: str, rest: Column) -> Column:
        x, y = a[name], b[name]
        return F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(rest)

    return one("turn", one("role", one("text", F.lit(0))))


def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Records of all conversations in their several layouts, back to canonical turns."""
    records = records_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    turns = canonical(records)
    return turns.select("conv_id", "layout", F.size(F.coalesce("turns", F.array().cast(f"array<{TURN}>"))).alias("n_turns"), F.coalesce(rendered(F.col("turns")), F.lit("")).alias("chat"))


ORACLE = """
with t as (
  select conv_id, coalesce(lower(role), 'unknown') as role, text,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text) as k
  from conversations where text is not null),
c as (
  select conv_id, count(*) as n, string_agg(role, ',' order by k) as roles,
    bool_and(role = case when k % 2 = 1 then 'user' else 'assistant' end) as alternates,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by k) as chat
  from t group by conv_id),
i as (select distinct conv_id, ((coalesce(conv_id, 0) % 6) + 6) % 6 as m from conversations)
select i.conv_id, case
    when n is null then null
    when roles = 'user,assistant' and m = 0 then 'completion' when roles = 'user,assistant' and m = 1 then 'response'
    when roles = 'user,assistant' and m = 2 then 'instruction' when roles = 'user,assistant' and m = 3 then 'question'
    when roles = 'system,user,assistant' and m < 3 then 'completion' when roles = 'system,user,assistant' and m = 3 then 'instruction'
    when alternates and m = 4 then 'dialog' when m < 2 then 'conversations' else 'messages' end as layout,
  cast(coalesce(n, 0) as int) as n_turns, coalesce(chat, '') as chat
from i left join c on i.conv_id is not distinct from c.conv_id
"""
