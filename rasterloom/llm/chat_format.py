"""Chat formatting that a parser undoes exactly.

A turn is an opening mark, its text and a closing mark. Rendered turns are parsed again by a
deterministic parser and compared with their source; where they differ, control strings in the
text are escaped, until the round trip is identical. The escape is reversible: a backslash
after the first character of a control string, one more where there are some already.

A conversation is never held together: its turns pass one by one, in order, through a task
whose memory doesn't grow with them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's marks by role; other roles are written out.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
ROLE, TEXT = ("<<ROLE>>", "<</ROLE>>"), ("<<TEXT>>", "<</TEXT>>")
_CONTROL = sorted([m for pair in [*MARKS.values(), ROLE, TEXT] for m in pair], key=len, reverse=True)
#: A control string with any number of backslashes after its first character.
_ANY = re.compile("|".join(re.escape(m[0]) + r"\\*" + re.escape(m[1:]) for m in _CONTROL))
_MARK = re.compile("|".join(map(re.escape, _CONTROL)))


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ANY.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(role: str, text: str, escaped: bool = False) -> tuple[str, int, int]:
    """A turn, and where its text lies in it."""
    start, end = MARKS.get(role, TEXT)
    if role not in MARKS:
        start = ROLE[0] + escape(role) + ROLE[1] + start
    body = escape(text) if escaped else text
    return start + body + end, len(start), len(start) + len(body)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the text as rendered) of each turn; ValueError if it isn't in the grammar."""
    turns, at = [], 0

    def enclosed(pair: tuple[str, str], at: int) -> tuple[int, int]:
        if not rendered.startswith(pair[0], at):
            raise ValueError(f"no {pair[0]} at {at}")
        m = _MARK.search(rendered, at + len(pair[0]))
        if m is None or m[0] != pair[1]:
            raise ValueError(f"no {pair[1]} after {at}")
        return at + len(pair[0]), m.start()

    while at < len(rendered):
        for role, pair in MARKS.items():
            if rendered.startswith(pair[0], at):
                break
        else:
            a, b = enclosed(ROLE, at)
            role, pair, at = unescape(rendered[a:b]), TEXT, b + len(ROLE[1])
        a, b = enclosed(pair, at)
        turns.append((role, unescape(rendered[a:b]), a, b))
        at = b + len(pair[1])
    return turns


def round_trip(role: str, text: str) -> tuple[str, int, int]:
    """render(), escaped if parse() doesn't give the turn back without."""
    for escaped in (False, True):
        out = render(role, text, escaped)
        try:
            if [t[:2] for t in parse(out[0])] == [(role, text)]:
                return out
        except ValueError:
            continue
    raise AssertionError("the escape isn't reversible")


def format_chats(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, formatted, start, loss_start, loss_end) per turn, in order.

    A conversation's formatted turns, put together in order, are its rendered form; start is the
    place of a turn in it, loss_start and loss_end the span of an assistant's text (null for
    other roles), all in code points. Rows of a conversation are adjacent and ordered by turn (nulls
    first), then role, then text, so ties and repeated rows have a fixed place and all stay. Null
    texts and roles are empty; rows with a null conversation are one conversation. Other columns
    are dropped; an empty table gives an empty result.
    """
    kind = {c: turns.schema[c].dataType.simpleString() for c in (conversation, turn)}
    source = turns.select(turns[conversation].alias("c"), turns[turn].alias("t"), F.coalesce(turns[role], F.lit("")).alias("r"), F.coalesce(turns[text], F.lit("")).alias("x"))
    source = source.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    names = [conversation, turn, "role", "formatted", "start", "loss_start", "loss_end"]

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = object(), 0
        for batch in stream:
            out: list[list] = [[], [], [], []]
            for c, r, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if c != now:
                    now, at = c, 0
                formatted, a, b = round_trip(r, x)
                loss = r == "assistant"
                for col, v in zip(out, (formatted, at, at + a if loss else None, at + b if loss else None), strict=True):
                    col.append(v)
                at += len(formatted)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out[0], pa.string()), *(pa.array(v, pa.int64()) for v in out[1:])], names=names)

    return source.mapInArrow(run, f"`{conversation}` {kind[conversation]}, `{turn}` {kind[turn]}, role string, formatted string, start long, loss_start long, loss_end long")


def digests(formatted: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """What format_chats() wrote, parsed again: one row of counts and digests per conversation.

    formatted must come as format_chats() gives it, or be dealt and sorted like that again.
    """
    kind = formatted.schema[conversation].dataType.simpleString()
    source = formatted.select(conversation, "formatted", "start", "loss_start", "loss_end")

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[tuple] = []

        def finish() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [()] * 6
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[conversation, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        key = None
        for batch in stream:
            key = batch.schema.field(0).type
            for c, text, start, a, b in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if state is None or start == 0 or c != state[0]:
                    finish()
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                if a is not None:
                    masked = unescape(text[a - start : b - start])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(text)
            if done:
                yield batch_of(key)
        finish()
        if done:
            yield batch_of(key)

    return source.mapInArrow(run, f"`{conversation}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
