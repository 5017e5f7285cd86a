"""Chat formatting with mappings chosen by schema fingerprints.

A record layout is known by its fingerprint: the SHA-256 of its sorted nested field paths, of those that some
layout uses (``id``, ``source`` and the like play no part).  ``LAYOUTS`` declares for each what ``from_json`` needs to
read it and the SQL expression of its canonical turns (array of role, text), so prompt, instruction and message
layouts go through one template.  Typed tables are fingerprinted from their schema, JSON records row by row from
their own paths, at any depth.

Template: ``<s>role[INST]text</s>`` for each turn.  Roles and texts are escaped (``\\`` as ``\\\\``,
``<`` as ``\\l``, ``[`` as ``\\b``), so no control string can occur inside them, and ``unescaped`` gives
them back exactly.  The loss mask holds code-point spans over assistant texts.

Only DataFrame functions are used.  Defined cases: null role or text is empty; turns sort by (turn, role,
text), nulls first, so ties and repeated rows stay, in a fixed order; a null conversation id is a
conversation of its own; a typed table of an unknown layout raises; a JSON record of an unknown layout (or null, or
no JSON) has no turns, is listed by ``rejected`` and counted by ``reject_counts``; an empty table gives an empty result;
other columns are ignored.  One conversation becomes one row, as its digest needs all its text in order: its
size is what one task must hold.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, HEAD, CLOSE = "<s>", "[INST]", "</s>"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return field_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _pair(user: str, assistant: str) -> str:
    return f"array(struct('user' as role, {user} as text), struct('assistant' as role, {assistant} as text))"


#: Field paths of a layout, the columns of its records, and the SQL expression of the turns of a record ``r``.
LAYOUTS = {
    "turn_rows": (["role", "text", "turn"], None, None),
    "messages": (["messages[].content", "messages[].role"], "messages array<struct<role string, content string>>", "transform(r.messages, m -> struct(m.role as role, m.content as text))"),
    "message_parts": (
        ["messages[].content[].text", "messages[].content[].type", "messages[].role"],
        "messages array<struct<role string, content array<struct<type string, text string>>>>",
        "transform(r.messages, m -> struct(m.role as role, array_join(transform(m.content, c -> c.text), '') as text))",
    ),
    "no_messages": (["messages[]"], "messages array<string>", f"cast(array() as {TURNS})"),
    "from_value": (
        ["conversations[].from", "conversations[].value"],
        "conversations array<struct<`from` string, value string>>",
        "transform(r.conversations, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))",
    ),
    "prompt_completion": (["completion", "prompt"], "prompt string, completion string", _pair("r.prompt", "r.completion")),
    "question_answer": (["answer", "question"], "question string, answer string", _pair("r.question", "r.answer")),
    "instruction": (["input", "instruction", "output"], "instruction string, input string, output string", _pair("concat_ws('\\n\\n', nullif(r.instruction, ''), nullif(r.input, ''))", "r.output")),
    "instruction_only": (["instruction", "output"], "instruction string, output string", _pair("r.instruction", "r.output")),
}
#: By fingerprint: name, columns and turns.
MAPPINGS = {fingerprint(paths): (name, columns, turns) for name, (paths, columns, turns) in LAYOUTS.items()}
USED_PATHS = sorted({p for paths, _, _ in LAYOUTS.values() for p in paths})


def layout_of(df: DataFrame, *ids: str) -> tuple[str, str | None]:
    """Name and mapping of a table's layout; ``ids`` are not part of a record."""
    paths = field_paths(T.StructType([f for f in df.schema.fields if f.name not in ids]))
    found = MAPPINGS.get(fingerprint([p for p in paths if p in USED_PATHS]))
    if not found:
        raise ValueError(f"no mapping for a layout with the fields {sorted(paths)}")
    return found[0], found[2]


def json_paths(record: Column) -> Column:
    """The nested field paths of a JSON record, sorted; null for what is no JSON.

    Spark prints the record's schema (``OBJECT<a: ARRAY<OBJECT<b: STRING>>>``, odd names in backticks); one pass over its
    tokens keeps the paths of the open objects as a stack.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    tokens = F.regexp_extract_all(shape, F.lit(r"(`(?:[^`]|``)*`|[A-Za-z0-9_]+(?:\([0-9, ]+\))?|[<>:,])"), 1)
    pairs = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get(tokens, i + 1), F.lit("")).alias("then")))
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(a: Column, e: Column) -> Column:
        state = lambda open_, at, paths: F.struct(open_.alias("open"), at.alias("at"), paths.alias("paths"))
        token, top = e["t"], F.element_at(a["open"], -1)
        named = e["then"] == ":"
        plain = F.replace(F.regexp_replace(token, "^`|`$", ""), F.lit("``"), F.lit("`"))
        below = F.concat(top, F.when(top == "", "").otherwise("."), plain)
        nested, inside = e["then"] == "<", F.concat(a["at"], F.lit("[]"))
        push = lambda path: F.concat(a["open"], F.array(path))
        return (
            F.when(named, state(a["open"], below, a["paths"]))
            .when(token.isin("<", ":", ","), a)
            .when(token == ">", state(F.slice(a["open"], 1, F.size(a["open"]) - 1), a["at"], a["paths"]))
            .when(nested & (token == "OBJECT"), state(push(a["at"]), a["at"], a["paths"]))
            .when(nested, state(push(inside), inside, a["paths"]))
            .otherwise(state(a["open"], a["at"], F.concat(a["paths"], F.array(a["at"]))))
        )

    return F.when(shape.isNotNull(), F.array_sort(F.aggregate(pairs, start, step, lambda a: a["paths"])))


def json_fingerprint(paths: Column) -> Column:
    """The fingerprint of a record from its paths: those that some layout uses."""
    used = F.array(*map(F.lit, USED_PATHS))
    return F.sha2(F.array_join(F.filter(paths, lambda p: F.array_contains(used, p)), "\n"), 256)


def json_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Adds ``paths``, ``layout`` and ``turns`` of heterogeneous JSON records, each by the mapping that its fingerprint selects."""
    known = records.withColumn("paths", json_paths(F.col(column))).withColumn("__print", json_fingerprint(F.col("paths")))
    turns, layout = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for print_, (name, columns, mapping) in MAPPINGS.items():
        if columns:
            mine = F.col("__print") == print_
            turns = F.when(mine, F.expr(f"element_at(transform(array(from_json(`{column}`, '{columns}')), r -> {mapping}), 1)").cast(TURNS)).otherwise(turns)
            layout = F.when(mine, name).otherwise(layout)
    return known.withColumn("turns", turns).withColumn("layout", layout).drop("__print")


def rejected(mapped: DataFrame) -> DataFrame:
    """The records of :func:`json_turns` that no mapping fits."""
    return mapped.filter("layout IS NULL").drop("layout", "turns")


def reject_counts(mapped: DataFrame) -> DataFrame:
    """(paths, n): how many records of each unknown layout there are; null paths are no JSON."""
    return rejected(mapped).groupBy("paths").agg(F.count("*").alias("n"))


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Double backslashes pair up from the left, so the pieces between them hold only single codes."""
    piece = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), piece), "\\")


def _exploded(rows: DataFrame, id_col: str, turns: Column) -> DataFrame:
    return rows.select(id_col, F.posexplode(turns).alias("turn", "t")).select(id_col, F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def turn_rows(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows (id, turn, role, text) of a table of any known layout."""
    _, mapping = layout_of(df, id_col)
    if mapping is None:
        return df.select(id_col, F.col("turn").cast("long").alias("turn"), "role", "text")
    return _exploded(df, id_col, F.expr(f"element_at(transform(array(struct(*)), r -> {mapping}), 1)"))


def json_turn_rows(records: DataFrame, id_col: str = "conv_id", column: str = "record") -> DataFrame:
    """Rows (id, turn, role, text) of the JSON records that a mapping fits."""
    return _exploded(json_turns(records, column).filter("layout IS NOT NULL"), id_col, F.col("turns"))


def formatted(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: the formatted text and the loss mask (half-open code-point spans)."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = turns.select(F.col(id_col), "turn", role, text).groupBy(id_col).agg(rows.alias("t"))
    shown = lambda r: F.struct(r["role"].alias("role"), F.concat(F.lit(OPEN), escaped(r["role"]), F.lit(HEAD)).alias("head"), escaped(r["text"]).alias("body"))
    whole = whole.withColumn("t", F.transform("t", shown))
    end = lambda r: F.length(r["head"]) + F.length(r["body"]) + len(CLOSE)
    lengths = F.transform("t", lambda r: F.struct((r["role"] == "assistant").alias("told"), F.length(r["head"]).alias("head"), end(r).alias("all")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask"))
    span = lambda a, n: F.array(F.struct((a["at"] + n["head"]).alias("start"), (a["at"] + n["all"] - len(CLOSE)).alias("stop")))
    step = lambda a, n: F.struct((a["at"] + n["all"]).alias("at"), F.when(n["told"], F.concat(a["mask"], span(a, n))).otherwise(a["mask"]).alias("mask"))
    joined = F.array_join(F.transform("t", lambda r: F.concat(r["head"], r["body"], F.lit(CLOSE))), "")
    return whole.select(id_col, joined.alias("formatted"), F.aggregate(lengths, start, step, lambda a: a["mask"]).alias("loss_mask"))


def parsed(text: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")
    side = lambda p, n: unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), HEAD, n))
    return F.transform(pieces, lambda p: F.struct(side(p, 1).alias("role"), side(p, -1).alias("text")))


def digests(out: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted output says: turn count and digests of all turns and of all text under the loss mask."""
    under = F.transform("loss_mask", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["stop"] - s["start"])))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = out.select(id_col, "formatted", parsed(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("loss"))
    return read.select(
        id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
