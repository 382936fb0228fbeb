r"""Chat formatting with a grammar round trip.

The template writes a conversation as

    <s>[ROLE]name[/ROLE]text</s>  for each turn, and [EOC] behind the last

The control strings are ``<s>``, ``</s>``, ``[ROLE]``, ``[ROLE!]``, ``[/ROLE]``,
``[INST]``, ``[/INST]`` and ``[EOC]``. An escaped role or text has ``\\`` for a
backslash, ``\{`` for ``<`` and ``\(`` for ``[``, so that no control string is
left in it, not even across its edges.

Each turn is rendered, parsed again by a deterministic parser and compared; a
turn is first written as it is, and only where it does not come back alike is
its text escaped (its header then says ``[ROLE!]``), until it is identical.

A conversation is one run of rows in the order of its turns. Read back, the
rows of a conversation are one stream of text: a parser finds the turns and the
end by the grammar alone, wherever the stream was cut into rows, and the loss
mask is a list of spans of that stream. It keeps one turn at a time, so a
conversation of any length does not meet in memory.

Defined results: null role or text is the empty string; a null turn comes
before all others and turns that tie are ordered by role, then text; repeated
rows are turns of their own; rows whose conv_id is null form one conversation;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches, table

CONTROL = ("<s>", "</s>", "[ROLE]", "[ROLE!]", "[/ROLE]", "[INST]", "[/INST]", "[EOC]")
ESCAPES = {"\\": "\\\\", "<": "\\{", "[": "\\("}
_special = re.compile(r"[\\<\[]")
_escaped = re.compile(r"\\[\\{(]")
_plain = {v: k for k, v in ESCAPES.items()}
#: A turn: its header says whether role and text are escaped.
_turn = re.compile(r"<s>\[ROLE(!?)\](.*?)\[/ROLE\](.*)</s>(\[EOC\])?\Z", re.S)


def escape(text: str) -> str:
    return _special.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _plain[m[0]], text)


def parse_turn(piece: str) -> tuple[str, str]:
    """Role and text of a rendered turn; control strings inside a plain one are an error."""
    m = _turn.match(piece)
    if not m:
        raise ValueError("not a turn")
    flag, role, text, _ = m.groups()
    if flag:
        role, text = unescape(role), unescape(text)
    elif any(c in role or c in text for c in CONTROL):
        raise ValueError("a control string inside a turn")
    return role, text


class Conversation:
    """A deterministic parser of a formatted conversation that comes in pieces cut anywhere."""

    _head = re.compile(r"<s>\[ROLE(!?)\](.*?)\[/ROLE\]", re.S)

    def __init__(self):
        self.rest, self.at, self.ended, self.seen = "", 0, False, 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, str, int]]:
        """The turns that the piece completes: role, text, the text as it is written and where that begins in the stream."""
        self.rest += piece
        while self.rest and not self.ended:
            if self.rest.startswith("[EOC]"):
                self.rest, self.at, self.ended = self.rest[5:], self.at + 5, True
                break
            head = self._head.match(self.rest)
            end = self.rest.find("</s>", max(head.end(), self.seen)) if head else -1
            if end < 0:
                self.seen = max(0, len(self.rest) - 3) if head else 0
                return
            turn = self.rest[: end + 4]
            yield *parse_turn(turn), turn[head.end() : -4], self.at + head.end()
            self.rest, self.at, self.seen = self.rest[end + 4 :], self.at + end + 4, 0
        if self.ended and self.rest:
            raise ValueError("text after the end of a conversation")

    def close(self) -> None:
        if self.rest or not self.ended:
            raise ValueError("a conversation does not end")


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendering and where its text lies in it: plain if that comes back identical, escaped if not."""
    for flag, r, t in (("", role, text), ("!", escape(role), escape(text))):
        head = f"<s>[ROLE{flag}]{r}[/ROLE]"
        piece = f"{head}{t}</s>"
        try:
            if parse_turn(piece) == (role, text):
                return piece, len(head), len(head) + len(t)
        except ValueError:
            continue
    raise ValueError("a turn does not come back")  # the escaped form always does


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each turn, in order inside its conversation: conv_id, piece_no, formatted, and the loss mask's span in it (assistant texts; else empty).

    The pieces of a conversation, one after the other, are its formatted text.
    """
    small_batches(turns.sparkSession)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = (), 0
        for batch in batches:
            rows = []
            for conv, role, text, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "ends")), strict=True):
                n = n + 1 if last == (conv,) else 0
                last = (conv,)
                piece, a, b = render_turn(role, text)
                rows.append((conv, n, piece + "[EOC]" * ends, a, b if role == "assistant" else a))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, types, strict=True)], names=["conv_id", "piece_no", "formatted", "loss_from", "loss_to"])

    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    ends = F.lead(F.lit(False), 1, True).over(Window.partitionBy("conv_id").orderBy(*order[1:]))
    t = t.repartition(partitions(t.sparkSession), "conv_id").withColumn("ends", ends).sortWithinPartitions(*order)
    return t.mapInArrow(render, "conv_id long, piece_no long, formatted string, loss_from int, loss_to int")


def read_back(pieces: DataFrame) -> DataFrame:
    """A row for each conversation, from its pieces in order: what the parser recovers and what the loss mask covers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, rows = (), None, []

        def done() -> None:
            state[5].close()
            rows.append((last[0], state[2], state[0].hexdigest(), state[3], state[1].hexdigest(), state[4]))

        for batch in batches:
            for conv, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if last != (conv,):
                    if last:
                        done()
                    last, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, Conversation(), []]
                turns, loss, *_, parser, mask = state
                if b > a:
                    mask.append((state[4] + a, state[4] + b))
                state[4] += len(piece)
                for role, text, written, start in parser.feed(piece):
                    turns.update(f"{role}\n{text}\n".encode())
                    state[2] += 1
                    for x, y in mask:  # the spans that lie in this turn
                        under = written[max(0, x - start) : max(0, y - start)]
                        if written != text:
                            under = unescape(under)
                        loss.update(under.encode())
                        state[3] += len(under)
                    mask[:] = [(x, y) for x, y in mask if y > start + len(written)]
            yield out(rows)
            rows.clear()
        if last:
            done()
        yield out(rows)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)], names=names)

    ordered = pieces.repartition(partitions(pieces.sparkSession), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "piece_no")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role", "'</s>[INST] ok [/INST]' AS text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(materialize(format_conversations(turns), "chat"))


OP9_SQL = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_matches(role, '<s>|</s>|\[ROLE!?\]|\[/ROLE\]|\[/?INST\]|\[EOC\]')
              OR regexp_matches(text, '<s>|</s>|\[ROLE!?\]|\[/ROLE\]|\[/?INST\]|\[EOC\]') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(5 + sum(20 + length(role) + length(text)
    + CASE WHEN escaped THEN 1 + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
