"""Conversations in one chat format, whatever layout they come in.

A layout is known by its fingerprint, the hash of the nested paths of its fields, and maps
declaratively to canonical turns (conv_id, turn, role, text). Of the paths of a table, or of
a single JSON row, those that no layout names are left out; the hash of the others is looked
up in one map, which has each layout alone and with up to two paths that belong to others.

The format marks turns with control strings:

    <s>[INST] role [/INST] text</s>

In roles and texts a backslash is doubled and a control string gets one after its first sign,
so what is between markers never holds a marker, and reading back restores it exactly.
Everything is DataFrame functions.
"""

import hashlib
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, HEAD, BODY, END = "<s>", "[INST] ", " [/INST] ", "</s>"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
TURNS = ["conv_id", "turn", "role", "text"]


def nested_paths(schema, prefix=""):
    """Paths of all fields, arrays as []: messages[].role."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in nested_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return nested_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _pair(asked, answer, system=None):
    """Turns from a question and its answer; parts that are absent make no turn."""
    turns = [("system", F.col(system))] if system else []
    turns += [("user", asked), ("assistant", F.col(answer))]
    structs = [F.when(text.isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))) for role, text in turns]
    return F.filter(F.array(*structs), lambda t: t.isNotNull())


def _instruction():
    extra = F.when(F.coalesce(F.col("input"), F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("input"))).otherwise("")
    return _pair(F.concat(F.coalesce(F.col("instruction"), F.lit("")), extra), "output")


def _messages(column, role, text):
    return F.transform(F.col(column), lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))


# Layouts: their paths (conv_id apart), and how they become array<struct<role, text>>; None
# where each row is one turn, and its columns are those of a canonical one.
LAYOUTS = {
    "turns": (["turn", "role", "text"], None),
    "messages": (["messages[].role", "messages[].content"], lambda: _messages("messages", "role", "content")),
    "shares": (["conversations[].from", "conversations[].value"], lambda: _messages("conversations", "from", "value")),
    "instruction": (["instruction", "input", "output"], _instruction),
    "prompt": (["prompt", "response"], lambda: _pair(F.col("prompt"), "response")),
    "prompt_system": (["system", "prompt", "response"], lambda: _pair(F.col("prompt"), "response", "system")),
    "question": (["question", "answer"], lambda: _pair(F.col("question"), "answer")),
}
FURTHER_PATHS = 2


def _fingerprints(layouts):
    """{fingerprint: layout} for the layouts alone and with paths of others beside their own. Of
    several layouts that a set of paths holds, the one with the most paths has it."""
    known = {p for paths, _ in layouts.values() for p in paths}
    found = {}
    for name, (paths, _) in sorted(layouts.items(), key=lambda x: len(x[1][0])):
        for n in range(FURTHER_PATHS + 1):
            for more in itertools.combinations(sorted(known - set(paths)), n):
                found[fingerprint([*paths, *more])] = name
    return found


BY_FINGERPRINT = _fingerprints(LAYOUTS)
KNOWN_PATHS = sorted({p for paths, _ in LAYOUTS.values() for p in paths})
IN_ROWS = {name: layout for name, layout in LAYOUTS.items() if layout[1] is not None}

# Other names of the usual roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_of(frame: DataFrame) -> str:
    """The layout of a table, by the fingerprint of those of its paths that layouts name;
    ValueError if it is none of a layout."""
    paths = set(nested_paths(frame.schema))
    name = BY_FINGERPRINT.get(fingerprint(paths & set(KNOWN_PATHS))) if "conv_id" in paths else None
    if name is None:
        raise ValueError(f"no known layout in {sorted(paths)}")
    return name


def canonical_turns(frame: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) from a table of any known layout.

    Rows of the layout "turns" stay as they are; other names of the usual roles take the usual
    ones in the layouts with messages. A null list of messages gives no turns.
    """
    name = layout_of(frame)
    mapping = LAYOUTS[name][1]
    if mapping is None:
        return frame.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return _exploded(frame.select(F.col("conv_id").cast("long"), mapping().alias("turns")))


def _exploded(frame):
    usual = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    turns = frame.select("conv_id", F.posexplode("turns").alias("turn", "t"))
    return turns.select(
        "conv_id", F.col("turn").cast("long"), F.coalesce(F.try_element_at(usual, F.col("t.role")), F.col("t.role")).alias("role"),
        F.col("t.text").alias("text"),
    )


def json_turns(frame: DataFrame, column="json", id_column="conv_id") -> DataFrame:
    """(conv_id, turn, role, text) from JSON rows, each of its own layout. Rows of an unknown
    layout, or that are no JSON, give none; `json_layout` tells which."""
    keyed = frame.select(F.col(id_column).cast("long").alias("conv_id"), F.col(column).alias("_json"))
    fields = {
        "messages": "array<struct<role: string, content: string>>", "conversations": "array<struct<from: string, value: string>>",
    }
    names = dict.fromkeys(p.split("[]")[0] for paths, _ in IN_ROWS.values() for p in paths)
    schema = ", ".join(f"{n} {fields.get(n, 'string')}" for n in names)
    read = keyed.withColumn("_layout", json_layout(F.col("_json"))).withColumn("_row", F.from_json("_json", schema))
    read = read.select("conv_id", "_layout", "_row.*")
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for name, (_, mapping) in IN_ROWS.items():
        turns = F.when(F.col("_layout") == name, mapping()).otherwise(turns)
    return _exploded(read.select("conv_id", turns.alias("turns")))


def _has_path(path, keys, schema):
    """Whether a JSON object with these keys and this schema, as Spark names it, has a path."""
    if "[]." not in path:
        return F.array_contains(keys, path)
    outer, inner = path.split("[].")
    fields = F.regexp_extract(schema, rf"(?:^OBJECT<|[ ,]){outer}: ARRAY<OBJECT<([^<>]*)>>", 1)
    return F.concat(F.lit(" "), fields).contains(f" {inner}: ")


def json_layout(column):
    """Name of the layout of a JSON value, by the fingerprint of those of its paths that layouts
    name; null if unknown."""
    keys, schema = F.json_object_keys(column), F.schema_of_variant(F.try_parse_json(column))
    known = sorted({p for paths, _ in IN_ROWS.values() for p in paths})
    paths = F.array_compact(F.array(*[F.when(_has_path(p, keys, schema), F.lit(p)) for p in known]))
    layouts = F.create_map(*[F.lit(x) for pair in _fingerprints(IN_ROWS).items() for x in pair])
    return F.try_element_at(layouts, F.sha2(F.array_join(paths, "\n"), 256))


def escape(text):
    """text without control strings; null is empty."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text):
    for control in CONTROLS:
        text = F.replace(text, F.lit(control[0] + "\\" + control[1:]), F.lit(control))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_role="assistant") -> DataFrame:
    """(conv_id, formatted, loss) for each conversation of canonical turns: its text in the
    chat format, and the loss mask as array<struct<start, end>>, the places in it (code
    points from 0, end exclusive) of the texts of `loss_role`, in order.

    Turns are ordered by turn, then role, then text, nulls first; rows that are the same stay.
    A null role or text is empty. Rows without conv_id are one conversation. A conversation is
    one row of the result, so it must fit in one; the rows of a hot one are shuffled once.
    """
    parts = turns.select(
        "conv_id", "turn", "role", "text", F.concat(F.lit(BEGIN + HEAD), escape(F.col("role")), F.lit(BODY)).alias("_head"),
        F.concat(escape(F.col("text")), F.lit(END)).alias("_body"))
    size = F.length("_head") + F.length("_body")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_at", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)))
    # the window has dealt the rows by conversation, so they are not shuffled again
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_at", "role", "_head", "_body"))).alias("parts"))

    def span(part):
        begin = part["_at"] + F.length(part["_head"])
        return F.struct(begin.alias("start"), (begin + F.length(part["_body"]) - len(END)).alias("end"))

    text = F.array_join(F.transform("parts", lambda p: F.concat(p["_head"], p["_body"])), "")
    masked = F.transform(F.filter("parts", lambda p: p["role"] == loss_role), span)
    return rows.select("conv_id", text.alias("formatted"), masked.alias("loss"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """formatted with turns and loss_texts in place of formatted and loss, read back from them:
    turns is array<struct<role, text>>, loss_texts the unescaped texts under the loss mask, in
    order."""
    marked = F.filter(F.split("formatted", END), lambda t: t != "")

    def turn(part):
        inner = F.substring(part, len(BEGIN + HEAD) + 1, F.length(part))
        at = F.position(F.lit(BODY), inner)
        return F.struct(
            unescape(F.substring(inner, 1, at - 1)).alias("role"),
            unescape(F.substring(inner, at + len(BODY), F.length(inner))).alias("text"),
        )

    # a place in a text is found by walking there, so spans are read from pieces of the text
    # that hold as many of them as there are pieces
    many = F.ceil(F.sqrt(F.size("loss"))).cast("int")
    groups = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice("loss", i * many + 1, many))

    def piece(spans):
        begin, end = F.get(spans, F.lit(0))["start"], F.element_at(spans, -1)["end"]
        return F.struct(begin.alias("begin"), F.substring("formatted", (begin + 1).cast("int"), (end - begin).cast("int")).alias("text"), spans.alias("spans"))

    def masked(part):
        return F.transform(part["spans"], lambda s: unescape(F.substring(
            part["text"], (s["start"] - part["begin"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))

    pieces = F.transform(F.filter(groups, lambda g: F.size(g) > 0), piece)
    loss = F.when(F.size("loss") > 0, F.flatten(F.transform(pieces, masked))).otherwise(F.array().cast("array<string>"))
    rest = [c for c in formatted.columns if c not in ("formatted", "loss")]
    return formatted.select(*rest, F.transform(marked, turn).alias("turns"), loss.alias("loss_texts"))
