"""Chat formatting whose output parses back to exactly the turns it came from.

The template marks turns by role:

    user        [INST] text [/INST]
    assistant   <s> text </s>
    system      <<SYS>> text <</SYS>>
    any other   <<ROLE>>role<</ROLE>> text <</TURN>>

A deterministic parser recovers the turns: the mark at hand decides the rule, the
text runs to the rule's closing mark, and a backslash before \\, < or [ stands for
that character alone. Each turn is rendered with its text as it is, parsed again
and compared; while that differs, the text is escaped further: first only the
marks and the backslashes that the parser would take away, then every \\, < and [.
The last step always round-trips.

A turn's rendering depends on that turn alone, so turns are formatted where they
lie, in parallel; a conversation is its turns' renderings one after another.

Defined cases: a null text or role is the empty one. Turns are ordered by number,
nulls first, then role and rendered text; repeated turns all count. A null conversation id
is an id like others. An empty table gives an empty result. Extra columns of the
input are ignored. A very long conversation is read as a stream and never held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code, tidy

#: Opening and closing marks by role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "<<ROLE>>", "<</ROLE>>", "<</TURN>>"
CONTROL = sorted({m for pair in MARKS.values() for m in pair} | {ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE}, key=len, reverse=True)
#: What step 1 escapes: control strings, and backslashes that the parser would take away.
CONFLICT = re.compile("|".join(re.escape(c) for c in CONTROL) + r"|\\(?=[\\<\[])|\\\Z")
SPECIAL = re.compile(r"[\\<\[]")
TOKEN = re.compile(r"\\([\\<\[])|(" + "|".join(re.escape(c) for c in CONTROL) + ")")


class NotParsed(ValueError):
    pass


def escape(text: str, step: int) -> str:
    if step == 0:
        return text
    if step == 1:
        return CONFLICT.sub(lambda m: "\\" + m[0], text)
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def _until(data: str, at: int, close: str) -> tuple[str, int]:
    """The unescaped text from at to the closing mark, and where that ends."""
    out, last = [], at
    for m in TOKEN.finditer(data, at):
        out.append(data[last : m.start()])
        if m[2]:
            if m[2] != close:
                raise NotParsed(f"{m[2]!r} at {m.start()}, not {close!r}")
            return "".join(out), m.end()
        out.append(m[1])
        last = m.end()
    raise NotParsed(f"no {close!r} after {at}")


def parse_turns(data: str, at: int = 0) -> Iterator[tuple[str, str, int]]:
    """(role, text, end) of each turn, by one mark of look-ahead."""
    while at < len(data):
        for role, (begin, close) in MARKS.items():
            if data.startswith(begin, at):
                at += len(begin)
                break
        else:
            if not data.startswith(ROLE_OPEN, at):
                raise NotParsed(f"no turn at {at}")
            role, at = _until(data, at + len(ROLE_OPEN), ROLE_CLOSE)
            close = TURN_CLOSE
        body, at = _until(data, at, close)
        if len(body) < 2 or body[0] != " " or body[-1] != " ":
            raise NotParsed(f"a turn that ends at {at} isn't set off by spaces")
        yield role, body[1:-1], at


def render_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """The turn's rendering, where its escaped text lies in it, and the step of escaping."""
    for step in (0, 1, 2):
        if role in MARKS:
            begin, close = MARKS[role]
        else:
            begin, close = ROLE_OPEN + escape(role, step) + ROLE_CLOSE, TURN_CLOSE
        inner = escape(text, step)
        out = f"{begin} {inner} {close}"
        try:
            if [t[:2] for t in parse_turns(out)] == [(role, text)]:
                return out, len(begin) + 1, len(begin) + 1 + len(inner), step
        except NotParsed:
            continue
    raise AssertionError("full escaping always parses back")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\<\[])", r"\1", text)


TURNS = "turn long, role string, formatted string, mask_from int, mask_to int, escaped int"


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn: conv_id, turn, role, formatted, the loss mask as a span of it (empty
    but for assistants), and the step of escaping. The formatted texts of a
    conversation, in the order of turns, put together, are the conversation."""
    ship_code(turns.sparkSession)
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column("role").to_pylist()
            made = [render_turn(*x) for x in zip(roles, b.column("text").to_pylist(), strict=True)]
            loss = [(a, z) if r == "assistant" else (0, 0) for r, (_, a, z, _) in zip(roles, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), b.column("role"), pa.array([m[0] for m in made], pa.string()), pa.array([x[0] for x in loss], pa.int32()), pa.array([x[1] for x in loss], pa.int32()), pa.array([m[3] for m in made], pa.int32())],
                ["conv_id", "turn", "role", "formatted", "mask_from", "mask_to", "escaped"],
            )

    return rows.mapInArrow(tidy(rendered), f"conv_id {kind}, {TURNS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from formatted turns alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Turns stream past in order; of a
    conversation only the running digests are held."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "turn", "role", "formatted", "mask_from", "mask_to").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        kinds: list[pa.DataType] = []

        def put(done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def closed() -> tuple:
            return (now, state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"])

        for b in batches:
            kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done = []
            for conv, data, a, z in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_from", "mask_to")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(closed())
                    now, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, text, _ in parse_turns(data):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                masked = unescape(data[a:z])
                state["loss_n"] += len(masked)
                state["loss"].update(masked.encode())
                state["chars"] += len(data)
            if done:
                yield put(done)
        if state is not None:
            yield put([closed()])

    return rows.mapInArrow(tidy(digests), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its whole formatted text, for writing."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "formatted")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["formatted"]), "").alias("formatted"))
