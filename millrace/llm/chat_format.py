r"""Chat formatting: records of many layouts become canonical turns, and turns one marked text.

A record is a JSON object. Its fingerprint is the hash of its nested field paths (leaf types left out,
and fields that no mapping reads, such as an id or a date), and it selects a declarative mapping: the
type to read the record as, and the expression that makes turns of it. Records of an unknown layout,
with an empty list of messages, null records and records that are no JSON have null turns. A long
record is fingerprinted by its outline, so its length does not matter.

Template: every turn is "### role: text </turn>" and a new line. In texts and roles each backslash, #
and < gets a backslash before it (in roles : as well), so no control string of the template can occur
inside a text, and taking the backslashes away gives back every text exactly.

DataFrame and SQL functions only. Turns are sorted and put together for each record, which is as large
as the record itself; nothing else is gathered.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HEAD, TAIL = "### ", " </turn>\n"
#: Leaf types in the schema of a JSON value.
_LEAF = r"\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>]|$)"

#: Longer records (in characters) are fingerprinted by their outline: a variant has a largest size, and its parser a longest string.
WHOLE = 1 << 20
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: All up to the next string that is a value, and that string.
_VALUE = rf'(?s)\G((?:[^"]++|{_STRING}\s*+:)*+){_STRING}'
#: Equal objects that follow each other in an array.
_SAME = r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++"
#: Strings of any length are read; what is no JSON within them shows in the field _mr_bad.
_READ = "map('maxStringLen', '2147483647', 'columnNameOfCorruptRecord', '_mr_bad')"


class Layout(NamedTuple):
    """paths: the nested fields with leaf types as _; ddl: the type to read; turns: SQL for array<struct<role,text>> of r."""

    paths: str
    ddl: str
    turns: str


def _messages(field: str, role: str, text: str, roles: str = "x.{role}") -> Layout:
    inner = ", ".join(f"{x}: _" for x in sorted((role, text)))
    role_of = roles.replace("{role}", role)
    return Layout(
        f"OBJECT<{field}: ARRAY<OBJECT<{inner}>>>",
        f"{field} array<struct<{role}: string, {text}: string>>",
        f"transform(r.{field}, x -> named_struct('role', {role_of}, 'text', x.{text}))",
    )


def _pairs(*fields: str) -> Layout:
    """The last field is the answer, a field named system the system turn, the others make the question."""
    asked = [f for f in fields[:-1] if f != "system"]
    question = "concat_ws('\\n\\n', " + ", ".join(f"nullif(r.`{f}`, '')" for f in asked) + ")"
    turns = ["named_struct('role', 'system', 'text', r.`system`)"] if "system" in fields else []
    turns += [f"named_struct('role', 'user', 'text', {question})", f"named_struct('role', 'assistant', 'text', r.`{fields[-1]}`)"]
    return Layout("OBJECT<" + ", ".join(f"{f}: _" for f in sorted(fields)) + ">", ", ".join(f"`{f}` string" for f in fields), f"array({', '.join(turns)})")


#: The layouts that are known.
LAYOUTS = [
    _messages("messages", "role", "text"),
    _messages("messages", "role", "content"),
    _messages("conversations", "from", "value", "CASE x.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.{role} END"),
    _pairs("prompt", "response"),
    _pairs("prompt", "completion"),
    _pairs("system", "prompt", "response"),
    _pairs("instruction", "output"),
    _pairs("instruction", "input", "output"),
    _pairs("system", "instruction", "input", "output"),
    _pairs("question", "answer"),
]


def outline(record: Column) -> Column:
    """A JSON record with its string values emptied and equal neighbours in arrays made one: the same field paths."""
    return F.regexp_replace(F.regexp_replace(record, _VALUE, '$1""'), _SAME, "$1")


#: The fields that the mappings read. Others, of up to three levels, are left out of a fingerprint.
FIELDS = sorted({field for layout in LAYOUTS for field in re.findall(r"(\w+):", layout.paths)})
_OTHER = rf"(?<=[< ])(?!(?:{'|'.join(FIELDS)}):)[\w-]+: (?:ARRAY<(?:_|OBJECT<>)>|_|OBJECT<>)(?:, |(?=>))"


def paths_of(record: Column) -> Column:
    """The nested field paths of a JSON record that mappings read; null for what is no JSON."""
    short = F.when(F.length(record) <= WHOLE, record).otherwise(outline(record))
    paths = F.regexp_replace(F.schema_of_variant(F.try_parse_json(short)), _LEAF, "_")
    for _ in range(3):
        paths = F.regexp_replace(F.regexp_replace(paths, _OTHER, ""), ", >", ">")
    return paths


def fingerprint(record: Column) -> Column:
    """The hash of a JSON record's nested field paths; null for what is no JSON."""
    paths = paths_of(record)
    return F.when(paths.isNotNull(), F.xxhash64(paths)).alias("fingerprint")


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """records with the column turns, array<struct<role: string, text: string>>: null texts and roles are empty.

    A column turns that records has already is replaced.
    """
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    mark = fingerprint(F.col(record))
    for layout in LAYOUTS:
        made = F.expr(f"transform(array(from_json(`{record}`, '{layout.ddl}, _mr_bad string', {_READ})), r -> if(r._mr_bad IS NULL, {layout.turns}, NULL))[0]")
        clean = F.transform(made, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
        turns = F.when(F.col("_mr_mark") == F.xxhash64(F.lit(layout.paths)), clean).otherwise(turns)
    return records.withColumn("_mr_mark", mark).withColumn("turns", turns).drop("_mr_mark")


def _escape(text: Column, of: str = r"([\\#<])") -> Column:
    return F.regexp_replace(text, of, r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turned: DataFrame, key: str) -> DataFrame:
    """From (key, turns) to (key, formatted, loss): one row for each key that has turns.

    loss: array<struct<start: bigint, length: bigint>>, in code points of formatted: the texts of
    assistant turns, without marks.
    """
    each = turned.select(F.col(key).alias("key"), F.posexplode("turns").alias("at", "turn"))
    text = _escape(F.col("turn.text"))
    head = F.concat(F.lit(HEAD), _escape(F.col("turn.role"), r"([\\#<:])"), F.lit(": "))
    each = each.select("key", "at", head.alias("head"), text.alias("text"), (F.col("turn.role") == "assistant").alias("learn"))
    piece = F.concat("head", "text", F.lit(TAIL))
    each = each.select("key", "at", piece.alias("piece"), F.length("head").alias("h"), F.length("text").alias("n"), "learn")
    line = W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    each = each.withColumn("before", F.sum(F.length("piece")).over(line) - F.length("piece"))
    span = F.struct((F.col("before") + F.col("h")).alias("start"), F.col("n").cast("long").alias("length"))
    grouped = each.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"), F.array_sort(F.collect_list(F.when(F.col("learn"), F.struct("at", span.alias("span"))))).alias("spans")
    )
    return grouped.select(F.col("key").alias(key), F.array_join(F.col("pieces.piece"), "").alias("formatted"), F.col("spans.span").alias("loss"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted text, exactly as they were."""
    pieces = F.filter(F.split(formatted, r" </turn>\n"), lambda x: x != "")
    # Possessive, so a role of any length needs no stack.
    role = lambda x: F.regexp_extract(x, r"(?s)^### ([^:\\]*+(?:\\.[^:\\]*+)*+): ", 1)
    return F.transform(
        pieces, lambda x: F.struct(_unescape(role(x)).alias("role"), _unescape(F.substring(x, F.length(role(x)) + F.lit(len(HEAD) + 3), F.length(x))).alias("text"))
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, without escapes."""
    return F.array_join(F.transform(loss, lambda s: _unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def records_of_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", record: str = "record") -> DataFrame:
    """(key, record): the turns of each key in order, as a JSON record of messages. Equal turns go by role, then text; null text: empty."""
    value = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(key).alias("_mr_key")).agg(F.sort_array(F.collect_list(value)).alias("_mr_turns"))
    messages = F.transform("_mr_turns", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return grouped.select(F.col("_mr_key").alias(key), F.to_json(F.struct(messages.alias("messages"))).alias(record))


def digests(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Format the conversations of turn rows, and digest what is read back from the output.

    Rows with a null key are one conversation. Repeated rows are turns of their own; turns with the same
    number go by role, then text. Other columns, whatever their names, are not read. An empty table gives
    an empty frame. A conversation without turns is an error.
    """
    turned = canonical_turns(records_of_rows(rows, key, record="_mr_record"), "_mr_record")
    none = F.raise_error(F.concat(F.lit("no turns read of conversation "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    made = format_turns(turned.withColumn("turns", F.coalesce("turns", none)), key)
    back = made.select(key, parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learned"), "formatted")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
