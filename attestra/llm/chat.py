"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags per segment."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles bear loss, and which role may follow which ("" is the beginning)."""

    before: str = OPEN + "{role}\n"
    after: str = CLOSE + "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    ends: tuple[str, ...] = ("user", "assistant")


#: conv_id; valid and the first turn out of order; the formatted text; its segments, whose texts joined are it.
OUTPUT = "conv_id long, valid boolean, bad_turn int, formatted string, segments array<struct<text: string, loss: boolean>>"


def escape(text: str) -> str:
    """Leaves no control string: a backslash is doubled, one goes between < and |."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


class Formatter:
    """Takes the turns of one conversation in order."""

    def __init__(self, template: Template):
        self.t, self.state, self.bad, self.n, self.segments = template, "", None, 0, []

    def turn(self, role: str | None, text: str | None) -> None:
        role, text = role or "", text or ""
        if role not in self.t.follows.get(self.state, ()) and self.bad is None:
            self.bad = self.n
        self.state = role
        self.n += 1
        self.segments.append((self.t.before.format(role=escape(role).replace("\n", "\\n")), False))
        self.segments.append((escape(text), role in self.t.loss_roles))
        self.segments.append((self.t.after, False))

    def row(self, conv_id) -> tuple:
        if self.bad is None and self.state not in self.t.ends:
            self.bad = self.n
        return conv_id, self.bad is None, self.bad, "".join(s for s, _ in self.segments), [{"text": s, "loss": x} for s, x in self.segments if s or x]


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row per conversation (OUTPUT) from rows (conv_id, turn, role, text).

    Turns are ordered by turn, then role and text; repeated rows are turns of their own, null
    role or text is empty, null turn comes first, rows without conv_id form one conversation.
    A conversation with roles out of order is formatted all the same, with valid false. Rows
    are dealt by conv_id and streamed in order, so a task holds one conversation at a time.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(frames):
        import pandas as pd

        now, at, out = None, None, []
        names = [c.split()[0] for c in OUTPUT.split(", ", 4)]
        for f in frames:
            ids = f["conv_id"].astype("Int64")
            for conv, role, text in zip(ids, f["role"], f["text"], strict=True):
                conv = None if conv is pd.NA else int(conv)
                if now is None or conv != at:
                    if now is not None:
                        out.append(now.row(at))
                    now, at = Formatter(template), conv
                now.turn(role, text)
            if len(out) >= 500:
                yield _frame(pd, out, names)
                out = []
        if now is not None:
            out.append(now.row(at))
        if out:
            yield _frame(pd, out, names)

    return rows.mapInPandas(run, OUTPUT)


def _frame(pd, out: list, names: list[str]):
    f = pd.DataFrame(out, columns=names)
    return f.assign(conv_id=f["conv_id"].astype("Int64"), bad_turn=f["bad_turn"].astype("Int32"))


TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text in the default template."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from the output alone."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for conv, text, segments in zip(f["conv_id"].astype("Int64"), f["formatted"], f["segments"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape(s["text"]) for s in segments if s["loss"])
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                rows.append((conv, len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.assign(conv_id=out["conv_id"].astype("Int64"))

    return formatted.select("conv_id", "formatted", "segments").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
