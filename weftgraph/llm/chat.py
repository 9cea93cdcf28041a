"""Chat formatting: schema fingerprints select declarative mappings to canonical turns. DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Escapes, undone from the last to the first: mark, control strings, and in roles the line end.
MARK = "␛"
ESCAPES = ((MARK, MARK + "0"), ("<|", f"<{MARK}1|"))
ROLE_ESCAPES = (*ESCAPES, ("\n", MARK + "2"))


class Layout(NamedTuple):
    """A mapping: the nested paths that it needs, and how it makes turns.

    ``turns`` are a role and one or more paths each, whose values are joined by a blank
    line; a turn of null values only is left out. Or ``each`` is an array path whose elements hold role
    and text. Or both are empty, where each row is one turn (conversation, turn, role and
    text columns in ``row``).
    """

    paths: frozenset[str]
    turns: tuple[tuple[str, ...], ...] = ()
    each: tuple[str, str, str] | None = None
    row: tuple[str, str, str, str] | None = None


#: Names that other layouts give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = {
    "rows": Layout(frozenset({"conv_id", "turn", "role", "text"}), row=("conv_id", "turn", "role", "text")),
    "messages": Layout(frozenset({"messages", "messages[].role", "messages[].content"}), each=("messages", "role", "content")),
    "shared": Layout(frozenset({"conversations", "conversations[].from", "conversations[].value"}), each=("conversations", "from", "value")),
    "instruction_input": Layout(frozenset({"instruction", "input", "output"}), turns=(("user", "instruction", "input"), ("assistant", "output"))),
    "instruction": Layout(frozenset({"instruction", "output"}), turns=(("user", "instruction"), ("assistant", "output"))),
    "prompt_completion": Layout(frozenset({"prompt", "completion"}), turns=(("user", "prompt"), ("assistant", "completion"))),
    "prompt_response": Layout(frozenset({"system", "prompt", "response"}), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question_answer": Layout(frozenset({"question", "answer"}), turns=(("user", "question"), ("assistant", "answer"))),
}


def nested_paths(schema: T.DataType, at: str = "") -> Iterable[str]:
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            path = f"{at}.{f.name}" if at else f.name
            yield path
            yield from nested_paths(f.dataType, path)
    elif isinstance(schema, T.ArrayType):
        yield from nested_paths(schema.elementType, f"{at}[]")


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fitting(schema: T.StructType, layouts: Mapping[str, Layout] = LAYOUTS) -> list[Layout]:
    """The layouts whose paths the schema has, those with most paths first."""
    found = set(nested_paths(schema))
    fits = sorted((x for x in layouts.values() if x.paths <= found), key=lambda x: (-len(x.paths), fingerprint(x.paths)))
    if not fits:
        raise ValueError(f"no layout for the paths {sorted(found)}")
    return fits


def _column(path: str) -> str:
    return path.split("[")[0].split(".")[0]


def layout_in_row(fits: Sequence[Layout]) -> Column:
    """Which of the layouts a row has: the first whose fingerprint is that of the row's own paths among its.

    A path is a row's own if its column isn't null there. Without such a layout, the first
    of which some said column isn't null; null, if there is none.
    """

    def own(x: Layout) -> Column:
        present = F.array(*(F.when(F.col(_column(p)).isNotNull(), F.lit(p)) for p in sorted(x.paths)))
        return F.sha2(F.array_join(present, "\n"), 256) == fingerprint(x.paths)

    def partly(x: Layout) -> Column:
        said = x.row[2:] if x.row else [x.each[0]] if x.each else [p for turn in x.turns for p in turn[1:]]
        return reduce(lambda a, b: a | b, (F.col(p).isNotNull() for p in said))

    return F.coalesce(*(F.when(test(x), k) for test in (own, partly) for k, x in enumerate(fits)))


def escaped(text: Column, escapes: Iterable[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def restored(text: Column, escapes: Iterable[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(tuple(escapes)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _said(layout: Layout) -> Column:
    """The turns of a row that is a whole conversation: an array of (role, text)."""
    if layout.each:
        array, role, text = layout.each
        roles = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))

        def turn(x: Column) -> Column:
            name = F.coalesce(x[role], F.lit(""))
            return F.struct(F.coalesce(roles[name], name).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        return F.transform(array, turn)
    every = []
    for role, *paths in layout.turns:
        values = [F.col(p).cast("string") for p in paths]
        text = values[0] if len(values) == 1 else F.when(F.coalesce(*values).isNotNull(), F.concat_ws("\n\n", *values))
        every.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.filter(F.array(*every), lambda x: x["text"].isNotNull())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums_before(lengths: Column, block: int = 256) -> Column:
    """For each element the sum of those before it; by blocks, so that long arrays stay cheap."""

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def starts(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), (F.size(x) / block).cast("int")), lambda k: total(F.slice(x, k * block + 1, block)))
        return _let(sums, lambda s: F.transform(s, lambda _, k: total(F.slice(s, 1, k))))

    return _let(lengths, lambda x: _let(starts(x), lambda first: F.transform(x, lambda _, k: F.get(first, (k / block).cast("int")) + total(F.slice(x, (k - k % block + 1).cast("int"), (k % block).cast("int"))))))


def _of_whole_rows(df: DataFrame, conv_id: str, said: Column) -> DataFrame:
    """Formats rows that are whole conversations; nothing is shuffled."""
    heads = F.transform(said, lambda x: F.struct(F.concat(F.lit(START), escaped(x["role"], ROLE_ESCAPES), F.lit("\n")).alias("head"), escaped(x["text"]).alias("body"), (x["role"] == "assistant").alias("learnt")))
    pieces = df.select(F.col(conv_id).alias("conv_id"), F.coalesce(heads, F.array()).alias("pieces"))
    ends = len(END) + 1
    firsts = _sums_before(F.transform("pieces", lambda x: (F.length(x["head"]) + F.length(x["body"]) + ends).cast("bigint")))
    spans = F.zip_with("pieces", firsts, lambda x, at: F.when(x["learnt"], F.struct((at + F.length(x["head"])).alias("first"), (at + F.length(x["head"]) + F.length(x["body"])).alias("last"))))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.filter(spans, lambda x: x.isNotNull()).alias("loss_spans"),
    )


def _of_turn_rows(said: DataFrame) -> DataFrame:
    """Formats conversations whose turns (conv_id, turn, role, text) are rows; one shuffle, by conversation."""
    role, text = escaped(F.col("role"), ROLE_ESCAPES), escaped(F.col("text"))
    said = said.withColumns({"head": F.concat(F.lit(START), role, F.lit("\n")), "body": text})
    said = said.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = said.withColumn("place", F.row_number().over(order))
    said = said.withColumn("first", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece") + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct("first", (F.col("first") + F.length("body")).alias("last")))
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return said.groupBy("conv_id").agg(
        F.array_join(F.transform(pieces, lambda x: x.piece), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def format_chats(df: DataFrame, conv_id: str = "conv_id", layouts: Mapping[str, Layout] = LAYOUTS) -> DataFrame:
    """conv_id, formatted and loss_spans of each conversation.

    Each row's layout is chosen by the fingerprint of its own nested paths (see
    ``layout_in_row``), so a table may mix layouts. ``formatted`` marks each turn; marks
    inside roles and texts are escaped so that ``parsed`` gives them back. ``loss_spans``
    are the code point spans [first, last) of the assistant texts in it.

    Rows that are turns: by turn number (null first), ties by role and text; repeated rows
    are turns of their own; a null conversation id is one conversation. Rows that are whole
    conversations give a row each, also where they repeat a conv_id; a null or empty list
    of turns, or a row without any field of a layout, is an empty conversation ("" and no
    span). Null roles and texts are empty; a null field of a one-row layout makes no turn.
    An empty table gives no rows; a table that has the columns of no layout is an error.
    """
    fits = fitting(df.schema, layouts)
    whole = [k for k, x in enumerate(fits) if not x.row]
    chosen = df if len(fits) == 1 else df.withColumn("layout", layout_in_row(fits))
    out = []
    for k, x in enumerate(fits):
        if x.row:
            conv, turn, role, text = map(F.col, x.row)
            mine = chosen if not whole else chosen.where(F.col("layout") == k)
            out.append(_of_turn_rows(mine.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))))
    if whole:
        rest = chosen if len(whole) == len(fits) else chosen.where(F.coalesce(F.col("layout").isin(whole), F.lit(True)))
        said = _said(fits[whole[0]]) if len(fits) == 1 else F.coalesce(*(F.when(F.col("layout") == k, _said(fits[k])) for k in whole))
        out.append(_of_whole_rows(rest, conv_id, said))
    return reduce(DataFrame.unionByName, out)


def parsed(formatted: Column) -> Column:
    """The turns, as an array of (role, text), read back from formatted output."""
    segments = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    return F.transform(
        segments,
        lambda x: F.struct(
            restored(F.substring_index(x, "\n", 1), ROLE_ESCAPES).alias("role"),
            restored(F.substring_index(F.substring(x, F.instr(x, "\n") + 1, F.length(x)), END, 1)).alias("text"),
        ),
    )


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, with escapes undone."""
    return F.array_join(F.transform(spans, lambda s: restored(F.substring(formatted, s["first"].cast("int") + 1, (s["last"] - s["first"]).cast("int")))), "")
