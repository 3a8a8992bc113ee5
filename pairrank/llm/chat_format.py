"""Chat formatting with black-box templates, and loss masks found by comparing renderings.

A template is any function from a list of turns to a text. A conversation is rendered turn
by turn: if each output begins with the one before, what it adds is the turn's span; if
not, the template rewrites history, and the conversation is marked and has no spans. Within
a span the text's place is found by rendering the same turn with two other texts: what
both outputs share at the start and the end is the template's, the rest is the turn's.

Conversations are grouped by id in a shuffle; the longest conversation bounds a task's
memory. Rendering all prefixes costs the square of a conversation's length, which is what
a template that may look at all turns asks for.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
PROBES = ("\u0001", "\u0002\u0002")


def escape(text: str) -> str:
    """No control string is left: ``<|`` becomes ``&lt;|``, and ``&`` becomes ``&amp;`` so it can be undone."""
    return text.replace("&", "&amp;").replace("<|", "&lt;|")


def unescape(text: str) -> str:
    return text.replace("&lt;|", "<|").replace("&amp;", "&")


def render(turns: list[Turn]) -> str:
    """Marks each turn; texts cannot hold a mark. Roles are escaped too, line ends in them as ``&nl;``."""
    return "".join(f"{START}{escape(role).replace(chr(10), '&nl;')}\n{escape(text)}{END}\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of a rendered conversation."""
    turns = []
    for block in formatted.split(START)[1:]:
        role, _, rest = block.partition("\n")
        turns.append((unescape(role.replace("&nl;", "\n")), unescape(rest[:-len(END) - 1])))
    return turns


def shared_start(a: str, b: str) -> int:
    """Length of what both texts begin with."""
    return len(os.path.commonprefix((a, b)))


def shared_end(a: str, b: str, most: int) -> int:
    n = 0
    while n < most and a[len(a) - 1 - n] == b[len(b) - 1 - n]:
        n += 1
    return n


class Formatted:
    """``text``, the ``spans`` (start, end) of its turns, of their contents, and whether history was rewritten."""

    def __init__(self, turns: list[Turn], template: Callable[[list[Turn]], str]):
        self.spans: list[tuple[int, int]] = []
        self.contents: list[tuple[int, int]] = []
        self.rewrites = False
        before = template([])
        for k, (role, _) in enumerate(turns):
            out = template(turns[:k + 1])
            if not out.startswith(before):
                self.rewrites = True
            if not self.rewrites:
                one, two = (template([*turns[:k], (role, probe)]) for probe in PROBES)
                head = shared_start(one, two)
                tail = shared_end(one, two, min(len(one), len(two)) - head)
                self.rewrites = not one.startswith(before) or head < len(before) or out[:head] != one[:head] or out[len(out) - tail:] != one[len(one) - tail:]
                self.spans.append((len(before), len(out)))
                self.contents.append((head, len(out) - tail))
            before = out
        self.text = before
        if self.rewrites:
            self.spans, self.contents = [], []

    def masked(self, turns: list[Turn], role: str) -> list[str]:
        """The texts under the loss mask: the contents of the turns of ``role``."""
        return [self.text[a:b] for (a, b), turn in zip(self.contents, turns) if turn[0] == role]


def format_conversations(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: Callable[[list[Turn]], str] = render, target: str = "assistant",
) -> DataFrame:
    """(conv_id, formatted, loss_starts, loss_ends, rewrites) of each conversation.

    Turns go by number, then role and text, nulls first; null roles and texts are empty.
    Rows that repeat a turn are turns of their own. Rows with a null id are one
    conversation. The loss mask covers the texts of the ``target`` role, as code point
    offsets into ``formatted``. Other columns are ignored; no rows give no result.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def task(table: pa.Table) -> pa.Table:
        key = table.column("conv_id")[0].as_py()
        lines = list(zip(*(table.column(c).to_pylist() for c in ("turn", "role", "text"))))
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [(r, t) for _, r, t in lines]
        made = Formatted(turns, template)
        loss = [span for span, (r, _) in zip(made.contents, turns) if r == target]
        return pa.table({
            "conv_id": pa.array([key], table.schema.field("conv_id").type), "formatted": [made.text],
            "loss_starts": pa.array([[a for a, _ in loss]], pa.list_(pa.int64())), "loss_ends": pa.array([[b for _, b in loss]], pa.list_(pa.int64())),
            "rewrites": [made.rewrites],
        })

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.groupBy("conv_id").applyInArrow(
        task, f"conv_id {kind}, formatted string, loss_starts array<bigint>, loss_ends array<bigint>, rewrites boolean"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text says: turns and masked text, both unescaped."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends"))):
                turns = parse(text)
                said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
                row = (len(turns), said, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text))
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
