"""Chat formatting into windows of a token budget.

Rows (conv_id, turn, role, text) become windows of whole turns. Running sums of tokens, carried along the sorted turns, cut a
conversation: a turn opens a new window when the window's tokens, repeated ones included, would exceed the budget with it.
Each window repeats the system turn, if any, and up to `history` turns before its first new one, as far as half
the budget and what the system turn and the first new one leave of it allow; repeated turns carry no loss, so every assistant
text is a target once. A turn that does not fit beside the system turn has a window of its own with it, and only such a
window is over the budget.

A turn is written as <|im_start|>role\\ntext<|im_end|>\\n. Inside roles and texts "<|" becomes "<\\|", and a backslash run before a bar
after "<" gets one more backslash, so control strings in texts can't be read as marks and unescaping is exact. Spans of
loss are kept as code-point offsets into the window's text.

Null texts and roles are empty. Turns are ordered by turn, then role and text, null turns first; repeated rows are turns of their
own. All work is done along rows sorted inside partitions, so a conversation of any length is never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n([\s\S]*?)<\|im_end\|>\n")
WINDOWS = "conv_id long, window long, formatted string, turn_no array<long>, repeated array<boolean>, loss array<struct<start:long,stop:long>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _role(text: str) -> str:
    """A role stands on one line: line feeds and backslashes in it are written as \\n and \\\\."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(text: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, no (from 0), role, text, tokens."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    # four characters count as a token, and a turn's marks as four tokens
    rows = rows.withColumn("tokens", F.ceil(F.char_length("text") / 4) + 4)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("no", F.row_number().over(order).cast("long") - 1).select("conv_id", "no", "role", "text", "tokens")


def windows(conversations: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """conv_id, window (from 0), formatted, turn_no, repeated (per turn), loss (spans of the new assistant texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"conv": (), "out": []}

        def close() -> None:
            if not state.get("new"):
                return
            parts, numbers, repeated, loss, at = [], [], [], [], 0
            for no, role, text, _, old in [*((*t, True) for t in state["old"]), *((*t, False) for t in state["new"])]:
                head, body = f"{START}{_role(role)}\n", escape(text)
                if role == "assistant" and not old:
                    loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
                parts.append(f"{head}{body}{END}\n")
                at += len(parts[-1])
                numbers.append(no)
                repeated.append(old)
            state["out"].append((state["conv"][0], state["number"], "".join(parts), numbers, repeated, loss))
            state["number"] += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*state["out"], strict=True)) or [()] * 6
            state["out"] = []
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "window", "formatted", "turn_no", "repeated", "loss"])

        for batch in batches:
            for conv, no, role, text, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state["conv"] != (conv,):
                    close()
                    state |= {"conv": (conv,), "number": 0, "used": 0, "old": [], "new": [], "system": None, "recent": []}
                # a window of the system turn alone is not closed: the next one would have to repeat it
                elif state["used"] + tokens > budget and state["new"] != [state["system"]]:
                    close()
                    system = [state["system"]] if state["system"] else []
                    used = sum(t[3] for t in system)
                    old, left = [], min(budget // 2, budget - used - tokens)
                    for t in reversed(state["recent"]):
                        left -= t[3]
                        if left < 0:
                            break
                        old.insert(0, t)
                    state |= {"used": used + sum(t[3] for t in old), "old": [*system, *old], "new": []}
                turn = (no, role, text, tokens)
                state["new"].append(turn)
                state["used"] += tokens
                if role == "system":
                    state["system"] = state["system"] or turn
                else:
                    state["recent"] = [*state["recent"], turn][-history:] if history else []
            yield flush()
        close()
        yield flush()

    rows = turns(conversations)
    # the window functions above have sorted each partition by conversation and turn already
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "no").mapInArrow(run, WINDOWS)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window's text."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows alone.

    Turns are parsed from the text; those marked as repeated are passed over. Digests are carried along the sorted windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: dict = {}

        def close() -> None:
            if now:
                out.append((now["conv"][0], now["n"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"]))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now.get("conv") != (conv,):
                    close()
                    now.update(conv=(conv,), n=0, all=hashlib.sha256(), loss=hashlib.sha256(), chars=0, size=0)
                now["size"] += len(text)
                for (role, body), old in zip(parse(text), repeated, strict=True):
                    if not old:
                        now["n"] += 1
                        now["all"].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["stop"]])
                    now["loss"].update(target.encode())
                    now["chars"] += len(target)
            yield flush()
        close()
        yield flush()

    rows = formatted.select("conv_id", "formatted", "repeated", "loss", "window").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.select("conv_id", "formatted", "repeated", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
