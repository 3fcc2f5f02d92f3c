"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import partitions

#: Control strings of the template, fixed values.
BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(/?s>|/?INST\]|/?<?SYS>>|</SYS>>)"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_CONTROL}", rf"([<\[])\\(\\*){_CONTROL}"
_TURN = re.compile(re.escape(BEGIN + HEAD) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)
#: Characters of examples handed on at once.
CHARS_AT_ONCE = 4_000_000

EXAMPLE = "conv_id long, example_no long, n_turns long, text string, loss_start long, loss_end long, is_last boolean"


def escape(text: Column) -> Column:
    """A backslash goes inside each control string, one more if some are there already."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _plain(text: str) -> str:
    return re.sub(_UNESCAPE, r"\1\2\3", text)


def packed(examples: Iterator[tuple], chars: int = CHARS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """Frames of examples, each handed on as soon as its texts have ``chars`` characters."""
    rows, size = [], 0

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["conv_id", "example_no", "n_turns", "text", "loss_start", "loss_end", "is_last"])
        return made.astype({"conv_id": "Int64"})

    for row in examples:
        rows.append(row)
        size += len(row[3])
        if size >= chars:
            yield frame()
            rows, size = [], 0
    if rows:
        yield frame()


def expand_turns(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One example for every turn of the ``trainable`` role, with all turns before it as context.

    ``text`` is the example in the template; code points ``loss_start`` to ``loss_end`` of it
    are the escaped reply, the only trainable part. A conversation that ends with other turns,
    or has no reply, also gets an example of all its turns with an empty loss span, so that
    every turn is in the output; ``is_last`` marks the example that holds them all.

    Turns go by ``turn`` (null first), then role and text, so ties and repeated rows have a
    fixed order and all stay. A null role or text is empty; rows with a null conv_id form one
    conversation; further columns are ignored. Rows are sorted in each partition and streamed:
    a task holds one growing prefix and hands on examples whenever they have ``CHARS_AT_ONCE`` characters. The
    examples' total size grows with the square of a conversation's length, as the method asks.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head, body = F.concat(F.lit(BEGIN + HEAD), escape(role), F.lit(BODY)), escape(text)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body"))
    rows = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "head", "body")

    def examples(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        conv, prefix, turns, number, held = None, "", 0, 0, None  # held: the latest reply's example

        def ended() -> Iterator[tuple]:
            if held is not None and held[2] == turns:
                yield (*held[:-1], True)
            elif turns:
                if held is not None:
                    yield held
                yield (conv, number, turns, prefix, len(prefix), len(prefix), True)

        for frame in frames:
            ids = [None if pd.isna(x) else int(x) for x in frame["conv_id"]]
            for key, role, head, body in zip(ids, frame["role"], frame["head"], frame["body"]):
                if key != conv:
                    yield from ended()
                    conv, prefix, turns, number, held = key, "", 0, 0, None
                start = len(prefix) + len(head)
                prefix, turns = f"{prefix}{head}{body}{END}", turns + 1
                if role == trainable:
                    if held is not None:
                        yield held
                    held = (conv, number, turns, prefix, start, start + len(body), False)
                    number += 1
        yield from ended()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return packed(examples(frames))

    return rows.mapInPandas(run, EXAMPLE)


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, per conversation.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` (characters of
    all its examples), ``n_examples``. Turns are parsed from the example that has them all;
    replies are cut out by the loss spans, one from each example. Only that example and the
    replies are shuffled, so the volume follows the input, not the expansion.
    """
    reply = unescape(F.expr("substring(text, cast(loss_start as int) + 1, cast(loss_end - loss_start as int))"))
    slim = examples.select("conv_id", "example_no", reply.alias("reply"), F.when(F.col("is_last"), F.col("text")).alias("whole"), F.length("text").cast("long").alias("chars"))
    slim = slim.repartition(partitions(examples.sparkSession), "conv_id").sortWithinPartitions("conv_id", "example_no")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def fresh(key: int | None) -> dict:
            return {"conv_id": key, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0, "n_examples": 0}

        def ready(rows: list[dict]) -> pd.DataFrame:
            got = [{**{k: v for k, v in r.items() if k not in ("turns", "loss")}, "turns_sha256": r["turns"].hexdigest(), "loss_sha256": r["loss"].hexdigest()} for r in rows]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
            return pd.DataFrame(got, columns=names).astype({"conv_id": "Int64"})

        for frame in frames:
            done = []
            for key, reply, whole, chars in zip(frame["conv_id"], frame["reply"], frame["whole"], frame["chars"]):
                key = None if pd.isna(key) else int(key)
                if state is None or key != state["conv_id"]:
                    if state is not None:
                        done.append(state)
                    state = fresh(key)
                state["loss"].update(reply.encode())
                state["loss_chars"] += len(reply)
                state["formatted_chars"] += int(chars)
                state["n_examples"] += 1
                if whole is not None:
                    for role, text in _TURN.findall(whole):
                        state["turns"].update(f"{_plain(role)}\n{_plain(text)}\n".encode())
                        state["n_turns"] += 1
            if done:
                yield ready(done)
        if state is not None:
            yield ready([state])

    return slim.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
