"""Chat formatting of reply trees.

Messages name their parents. Iterative self-joins double pointers: after round r each message knows the ancestor 2^r steps
up and the summed score on the way, so a tree of depth d takes about log2(d) joins and as many rows as it has messages.
Leaves are ranked by their branch's summed score, and the paths of the chosen ones are enumerated by joining back down the
powers of two, each message of a path once. Each chosen path is formatted as one conversation.

Template: a turn is ``### role``, a line break, the text, ``</turn>``, a line break. In texts and roles a backslash is
doubled, and one is put into any ``###`` and ``</turn>``, so the control strings occur only as marks; a role's line breaks
are written as backslash and n. Reading undoes it. The loss mask holds the texts of assistant turns as character spans.

A message whose parent is null or missing is a root. Messages that no root leads to (replies in a circle) are on no path.
Equal scores go to the smaller leaf. Nulls: a null role or text is empty, a null score 0; messages with a null tree form
one tree of their own; of messages with equal tree and node, the one with the smallest (parent, role, text) counts, and a null node is no
message. An empty table gives no rows. One conversation is one row, so its length is what a task must hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.llm.scratch import Scratch, plain

ASSISTANT = "assistant"
OPEN, CLOSE = "### ", "</turn>\n"  # marks of the template
_TO_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\([\\n]?)")
_TURN = re.compile(r"### ([^\n]*)\n(.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turns(turns: list[tuple[str, str]], assistant: str = ASSISTANT) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans (first character, end) of its loss mask."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role == assistant:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def chosen_paths(messages: DataFrame, branches: int, scratch: Scratch) -> DataFrame:
    """tree, leaf, up (steps from the leaf, 0 for itself), role and text of each message on a chosen path."""
    whole = plain(messages, tree="long", node="long", parent="long", role="string", text="string", score="double")
    whole = whole.filter("node IS NOT NULL").fillna({"role": "", "text": "", "score": 0.0})
    # A tree without a number becomes its own key, so that plain equality joins work throughout.
    whole = whole.withColumn("t", F.coalesce(F.col("tree").cast("string"), F.lit("")))
    once = whole.groupBy("t", "node").agg(F.min(F.struct("parent", "role", "text", "score", "tree")).alias("m")).select("t", "node", "m.*")
    # Only the pointers are written: texts go to their messages once and from there to their conversation.
    links = scratch.put("messages", once.select("t", "node", "parent", "score"))
    ids = links.select("t", F.col("node").alias("parent"), F.lit(True).alias("known"))
    start = links.join(ids, ["t", "parent"], "left")
    own = (F.col("parent") == F.col("node")).alias("loop")
    jump = scratch.put("jump-0", start.select("t", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("gain"), own)).filter("loop IS NULL OR NOT loop").drop("loop")
    most = jump.count().bit_length() + 1
    # Only messages whose pointer has not passed the root go on to the next doubling, so a level has a row for each message
    # at least so deep, and one long thread costs short ones nothing.
    levels, done, open_ = [], [jump.filter("up IS NULL")], jump.filter("up IS NOT NULL")
    while len(levels) < most and not open_.isEmpty():
        levels.append(open_)
        high = open_
        for rows in done:
            high = high.unionByName(rows)
        high = high.select("t", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("gain").alias("gain2"))
        both = open_.join(high, ["t", "up"]).select("t", "node", F.col("up2").alias("up"), (F.col("gain") + F.col("gain2")).alias("gain"))
        both = scratch.put(f"jump-{len(levels)}", both)
        done, open_ = [*done, both.filter("up IS NULL")], both.filter("up IS NOT NULL")
    # A message that is still open after that many doublings stands on a circle or below one.
    total = done[0]
    for rows in done[1:]:
        total = total.unionByName(rows)
    total = total.select("t", "node", F.col("gain").alias("total"))
    inner = jump.filter("up IS NOT NULL").select("t", F.col("up").alias("node")).distinct()
    leaves = total.join(inner, ["t", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.col("total").desc(), "node"))
    path = leaves.withColumn("rank", rank).filter(F.col("rank") <= branches).select("t", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("steps"))
    for r in range(len(levels) - 1, -1, -1):
        above = path.join(levels[r].select("t", "node", "up"), ["t", "node"]).select("t", "leaf", "rank", F.col("up").alias("node"), (F.col("steps") + (1 << r)).alias("steps"))
        path = scratch.put(f"path-{r}", path.unionByName(above))
        scratch.drop(f"path-{r + 1}", f"jump-{r + 1}", f"jump-{r}")  # the leaves are ranked, and level r has been gone back through
    return path.join(once.select("t", "tree", "node", "role", "text"), ["t", "node"]).select("tree", "leaf", "rank", "steps", "role", "text")


def format_trees(messages: DataFrame, branches: int = 1, assistant: str = ASSISTANT) -> DataFrame:
    """One row per chosen path: tree, leaf, rank (1 for the tree's best), formatted, loss_mask (array of spans). messages:
    tree, node, parent, role, text, score."""
    path = chosen_paths(messages, branches, Scratch(messages.sparkSession, "chat-format"))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "role", "text"))).alias("turns")
    grouped = path.groupBy("tree", "leaf", "rank").agg(turns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns], assistant) for turns in batch.column(3).to_pylist()]
            masks = pa.array([[{"start": a, "stop": b} for a, b in spans] for _, spans in done], span)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f for f, _ in done], pa.string()), masks], ["tree", "leaf", "rank", "formatted", "loss_mask"])

    return grouped.mapInArrow(write, "tree long, leaf long, rank int, formatted string, loss_mask array<struct<start long, stop long>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[m["start"] : m["stop"]]) for m in mask)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "loss_mask").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply chains: each turn answers the one before it; equal turns follow each other by role and text."""
    rows = plain(conversations, conv_id="long", turn="long", role="string", text="string")
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    chain = rows.withColumn("node", node)
    return chain.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(role, '\', '\\') AS r0, replace(text, '\', '\\') AS t0 FROM c),
f AS (SELECT *, length(regexp_replace(r0, '###+', '', 'g')) AS r_out, length(regexp_replace(t0, '###+', '', 'g')) AS t_out,
        length(r0) - length(replace(r0, '</turn>', '</turn')) + length(role) - length(replace(role, chr(10), '')) AS r_more,
        length(t0) - length(replace(t0, '</turn>', '</turn')) AS t_more,
        list_sum(list_transform(regexp_extract_all(r0, '###+'), lambda x: length(x) - 2)) AS r_hash,
        list_sum(list_transform(regexp_extract_all(t0, '###+'), lambda x: length(x) - 2)) AS t_hash FROM e),
s AS (SELECT *, 4 + length(r0) + coalesce(r_hash, 0) + r_more + 1 + length(t0) + coalesce(t_hash, 0) + t_more + 8 AS chars FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
