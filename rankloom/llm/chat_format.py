"""Chat formatting as packed prefix trees.

Conversations that share their first turns share the nodes of a tree.  A pack holds a bounded number of
conversations of one tree (or neighbouring trees); it writes every node's characters once, depth first,
with a position for each node (where its characters stand in the conversation) and the intervals of the
pack that its ancestors take: a character attends to its node up to itself and to these intervals.

Conversations are ordered by the hashes of all their growing prefixes, range-partitioned in that order and
streamed into trees, so those that share turns are next to each other however many they are, and a pack closes by
what it writes; a very common first turn spreads over many packs and partitions, and each pack writes it once.

The template of a turn is ``<s>[INST]`` role ``[/INST]`` text ``</s>``.  In roles and texts a backslash is doubled
and every control string gets a backslash after its first character, so none is left, and ``unescape`` gives the text
back.  The loss mask covers the escaped texts of the assistant's turns, without the ``</s>``.

Defined results: a null text is empty, a null role too; turns are ordered by turn (null first), role and
text, and repeated rows are turns of their own; rows without conversation id make one conversation, with a null
id, in one row, so they must fit a task; an empty table gives no packs; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, public_id, read_docs, released, row_id, scratch, tune

#: Control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
ASSISTANT = "assistant"
#: Conversations and characters of different turns in one pack, at most (a single conversation may have more characters).
PACK_CONVERSATIONS, PACK_CHARS = 1 << 13, 1 << 20

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, what stands after."""
    return f"<s>[INST]{escape(role)}[/INST]", escape(text), "</s>"


def prefix_hashes(turns: list[tuple[str, str]]) -> list[int]:
    """For each turn a hash of all turns up to it."""
    state, out = xxhash.xxh3_64(), []
    for role, text in turns:
        state.update(f"{len(role)}:{role}{len(text)}:{text}".encode("utf-8", "surrogatepass"))
        out.append(state.intdigest() - (1 << 63))
    return out


class Tree:
    """The pack that grows: neighbouring conversations, each turn once."""

    def __init__(self) -> None:
        self.children: dict[tuple[int, str, str], int] = {}
        self.tree: list[tuple[int, str, str]] = []  # parent, role, text
        self.below: dict[int, list[int]] = {}
        self.leaves: list[tuple[int, int]] = []
        self.chars = 0

    def add(self, conv: int, turns: list[tuple[str, str]]) -> None:
        at = -1
        for role, text in turns:
            if (node := self.children.get((at, role, text))) is None:
                node = self.children[at, role, text] = len(self.tree)
                self.tree.append((at, role, text))
                self.below.setdefault(at, []).append(node)
                self.chars += len(role) + len(text)
            at = node
        self.leaves.append((conv, at))


def pack_trees(grown: Tree) -> dict:
    """One pack.

    nodes: (begin, end, position, parent, loss begin, loss end); the loss range is empty for other roles.
    conversations: (id, node of the last turn or -1).
    """
    tree, below, leaves = grown.tree, grown.below, grown.leaves
    parts: list[str] = []
    nodes: list[dict] = []
    number: dict[int, int] = {-1: -1}
    size, stack = 0, list(reversed(below.get(-1, [])))
    while stack:
        node = stack.pop()
        parent, role, text = tree[node]
        before, body, after = turn_parts(role, text)
        up = nodes[number[parent]] if parent >= 0 else None
        begin, position = size, up["position"] + up["end"] - up["begin"] if up else 0
        size += len(before) + len(body) + len(after)
        loss = begin + len(before)
        ancestors = [*up["ancestors"], {"begin": up["begin"], "end": up["end"]}] if up else []
        number[node] = len(nodes)
        nodes.append({"begin": begin, "end": size, "position": position, "parent": number[parent], "loss_begin": loss,
                      "loss_end": loss + len(body) * (role == ASSISTANT), "ancestors": ancestors})
        parts += [before, body, after]
        stack += reversed(below.get(node, []))
    return {"text": "".join(parts), "nodes": nodes, "conversations": [{"conv_id": c, "leaf": number[leaf]} for c, leaf in leaves]}


PACK = """text string, nodes array<struct<begin:int,end:int,position:int,parent:int,loss_begin:int,loss_end:int,ancestors:array<struct<begin:int,end:int>>>>,
 conversations array<struct<conv_id:long,leaf:int>>"""


def chat_format(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Packs (text, nodes, conversations) of all conversations."""
    spark = tune(conversations.sparkSession)
    rows = conversations.select(row_id(id_col).alias("_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                                                                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    @released
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [b"".join((h + (1 << 63)).to_bytes(8, "big") for h in prefix_hashes([(t["role"], t["text"]) for t in turns])) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("turns"), pa.array(keys, pa.binary())], names=["_id", "turns", "path"])

    kind = "_id long, turns array<struct<turn:long,role:string,text:string>>, path binary"
    ordered = scratch(whole.mapInArrow(order, kind), "conversations")  # the range partitioner reads it twice
    sorted_ = ordered.repartitionByRange(partitions(spark), "path", "_id").sortWithinPartitions("path", "_id")

    @released
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text", pa.string()), ("nodes", pa.list_(pa.struct([*((k, pa.int32()) for k in ("begin", "end", "position", "parent", "loss_begin", "loss_end")),
                            ("ancestors", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))]))), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])))])
        tree = Tree()
        for batch in batches:
            for conv, turns in zip(batch.column("_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                tree.add(conv, [(t["role"], t["text"]) for t in turns])
                if len(tree.leaves) >= PACK_CONVERSATIONS or tree.chars >= PACK_CHARS:
                    yield pa.RecordBatch.from_pylist([pack_trees(tree)], schema)
                    tree = Tree()
        if tree.leaves:
            yield pa.RecordBatch.from_pylist([pack_trees(tree)], schema)

    return sorted_.select("_id", "turns").mapInArrow(pack, PACK)


_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def read_back(pack: dict) -> Iterator[tuple[int, list[tuple[str, str]], list[str], int]]:
    """(conversation, turns, texts under the loss mask, formatted characters), from a pack's text and intervals alone."""
    text, nodes = pack["text"], pack["nodes"]
    for conv in pack["conversations"]:
        if conv["leaf"] < 0:
            yield conv["conv_id"], [], [], 0
            continue
        leaf = nodes[conv["leaf"]]
        path = [*leaf["ancestors"], {"begin": leaf["begin"], "end": leaf["end"]}]
        formatted = "".join(text[p["begin"] : p["end"]] for p in path)
        turns = [(unescape(role), unescape(body)) for role, body in _TURN.findall(formatted)]
        losses, at = [], conv["leaf"]
        while at >= 0:
            node = nodes[at]
            if node["loss_end"] > node["loss_begin"]:
                losses.append(unescape(text[node["loss_begin"] : node["loss_end"]]))
            at = node["parent"]
        yield conv["conv_id"], turns, losses[::-1], len(formatted)


def read_conversations(packs: DataFrame) -> DataFrame:
    """(_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation of the packs."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pack in batch.to_pylist():
                for conv, turns, losses, size in read_back(pack):
                    loss = "".join(losses)
                    out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), size))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return packs.mapInArrow(run, "_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


#: A conversation whose texts hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_docs(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, ASSISTANT, PROBE)], rows.schema)
    return read_conversations(chat_format(rows.unionByName(probe))).select(public_id().alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: The same in DuckDB; the template's controls have 20 characters a turn, and escaping adds one for each backslash and control string.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(role) + length(text) + 20 + len(regexp_extract_all(role || chr(10) || text, '<s>|</s>|\[INST\]|\[/INST\]|\\')) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
