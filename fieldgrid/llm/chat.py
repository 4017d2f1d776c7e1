"""Chat formatting with a prefix tree: initial turns that conversations share are emitted once.

A turn is written as ``<|turn|>role<|says|>text<|over|>``. Control strings inside roles and texts are escaped by a
backslash behind their first character, one more for each that is there already, so the form is reversible.

Conversations are sorted by the hashes of their turns, dealt out by ranges of that order (which parts even the
conversations of one first turn, or equal ones, among tasks) and packed: a pack is a prefix tree of bounded size whose
turns are emitted depth-first. Tokens are code points. Each node has its tokens' place in the pack, the position id of
its first token along its path, the intervals of the pack that its tokens may attend to (its ancestors' and its own
up to the token itself) and the interval under the loss mask (texts of assistant turns). A conversation is a node.

Defined cases: turns are ordered by turn, then role, then text, nulls first; a null role or text is an empty one;
rows that repeat a turn are turns of their own; rows without conv_id are one conversation without id; a conversation is one
record and must fit in a task; an empty table gives no packs; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pack is closed when it has so many tokens or more.
PACK_TOKENS = 65_536

# The template's control strings, and others that common templates use.
TURN, SAYS, OVER = "<|turn|>", "<|says|>", "<|over|>"
CONTROLS = [TURN, SAYS, OVER, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_rests = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(?=\\*(?:{_rests}))")
_MARKED = re.compile(rf"([<\[])\\(?=\\*(?:{_rests}))")
_SHAPE = re.compile(f"{re.escape(TURN)}(.*?){re.escape(SAYS)}(.*?){re.escape(OVER)}", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text is in it."""
    head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
    return head + body + OVER, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _SHAPE.findall(formatted)]


PACKS = pa.schema([
    ("text", pa.string()), ("node_start", pa.list_(pa.int32())), ("node_end", pa.list_(pa.int32())), ("node_position", pa.list_(pa.int32())),
    ("attend_starts", pa.list_(pa.list_(pa.int32()))), ("attend_ends", pa.list_(pa.list_(pa.int32()))), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32())),
    ("conv_ids", pa.list_(pa.int64())), ("conv_node", pa.list_(pa.int32())),
])
_PACKS_SQL = (
    "text string, node_start array<int>, node_end array<int>, node_position array<int>, attend_starts array<array<int>>, attend_ends array<array<int>>, "
    "loss_start array<int>, loss_end array<int>, conv_ids array<bigint>, conv_node array<int>"
)


class Pack:
    """A prefix tree under construction; conversations come in an order in which shared beginnings are neighbours."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.row: dict[str, list] = {f.name: [] for f in PACKS if f.name != "text"}
        self.path: list[tuple[tuple[str, str], int]] = []  # turns from the root on, and their nodes

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for role, text in turns[shared:]:
            self.path.append(((role, text), self._node(role, text)))
        self.row["conv_ids"].append(conv_id)
        self.row["conv_node"].append(self.path[-1][1])

    def _node(self, role: str, text: str) -> int:
        line, a, b = format_turn(role, text)
        row, start, end = self.row, self.size, self.size + len(line)
        starts, ends, position = [start], [end], 0
        if self.path:
            above = self.path[-1][1]
            starts, ends = list(row["attend_starts"][above]), list(row["attend_ends"][above])
            position = row["node_position"][above] + row["node_end"][above] - row["node_start"][above]
            if ends[-1] == start:
                ends[-1] = end
            else:
                starts.append(start)
                ends.append(end)
        learnt = role == "assistant"
        for name, value in (("node_start", start), ("node_end", end), ("node_position", position), ("attend_starts", starts), ("attend_ends", ends), ("loss_start", start + a if learnt else -1), ("loss_end", start + b if learnt else -1)):
            row[name].append(value)
        self.parts.append(line)
        self.size = end
        return len(row["node_start"]) - 1

    def done(self) -> dict:
        return {"text": "".join(self.parts), **self.row}


def gather(conversations: DataFrame) -> DataFrame:
    """(conv_id, roles, texts, path) of each conversation of (conv_id, turn, role, text); path: hashes of its turns."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("t"))
    return turns.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"), F.transform("t", lambda x: F.xxhash64(x["role"], x["text"])).alias("path"))


def format_packs(conversations: DataFrame, *, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """Packs of all conversations. Two shuffles: turns by conversation, conversations by range of their paths."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack()
        for b in batches:
            for conv_id, roles, texts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "roles", "texts")), strict=True):
                pack.add(conv_id, list(zip(roles, texts, strict=True)))
                if pack.size >= pack_tokens:
                    yield pa.RecordBatch.from_pylist([pack.done()], schema=PACKS)
                    pack = Pack()
        if pack.row["conv_ids"]:
            yield pa.RecordBatch.from_pylist([pack.done()], schema=PACKS)

    ranged = gather(conversations).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ranged.select("conv_id", "roles", "texts").mapInArrow(build, _PACKS_SQL)


def read_conversation(pack: dict, node: int) -> tuple[str, str]:
    """The formatted text of the conversation that ends at a node, and what of it is under the loss mask, unescaped."""
    spans = list(zip(pack["attend_starts"][node], pack["attend_ends"][node], strict=True))
    text = "".join(pack["text"][a:b] for a, b in spans)
    return text, "".join(unescape(pack["text"][pack["loss_start"][i] : pack["loss_end"][i]]) for i in _nodes(pack, spans) if pack["loss_start"][i] >= 0)


def _nodes(pack: dict, spans: list[tuple[int, int]]) -> Iterator[int]:
    """Nodes whose tokens are in the spans."""
    number = pack.setdefault("_number", {a: i for i, a in enumerate(pack["node_start"])})
    for a, b in spans:
        i = number[a]
        while i < len(pack["node_start"]) and pack["node_start"][i] < b:
            yield i
            i += 1


def digests(packs: DataFrame) -> DataFrame:
    """What each conversation reads back as from its pack: turns, loss text and formatted text, as counts and digests."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                pack, rows = b.slice(at, 1).to_pylist()[0], []
                for conv_id, node in zip(pack["conv_ids"], pack["conv_node"], strict=True):
                    formatted, loss = read_conversation(pack, node)
                    turns = parse(formatted)
                    sha = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8", "replace")).hexdigest()
                    rows.append((conv_id, len(turns), sha, len(loss), hashlib.sha256(loss.encode("utf-8", "replace")).hexdigest(), len(formatted)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGESTS.types, strict=True)], schema=_DIGESTS)

    return packs.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
