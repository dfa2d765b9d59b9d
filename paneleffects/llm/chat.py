"""Chat formatting by incremental black-box rendering.

A template is only called, never looked into. Successive turn prefixes are rendered and
consecutive outputs compared: what the longer prefix adds is the last turn's span, and a
longer prefix that does not begin with the shorter one's output rewrites history. Where a
turn's own text lies in its span is found in the same way, from the prefix rendered with a
probe character and with an empty text in its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import importable, outlive, scratch, small, stage

#: Turns that are rendered together, and turns before them that are rendered for context.
WINDOW, LEAD = 64, 2
#: Characters a batch of formatted conversations holds, about.
BATCH_CHARS = 1 << 20
#: Stands in for a text; a private-use character, which templates do not write.
PROBE = "\ue000"

Turn = tuple[str, str]


@dataclass(frozen=True)
class ChatTemplate:
    """A chat template and what reads its output back.

    ``render`` takes (role, escaped text) turns, oldest first, and returns the whole text.
    ``parse`` takes a piece of its output, and whether that begins the conversation, and
    returns (role, text) turns. ``escape`` and ``unescape`` undo each other. Texts of
    ``loss_roles`` are under the loss mask.
    """

    render: Callable[[Sequence[Turn]], str]
    parse: Callable[[str, bool], list[Turn]] | None = None
    escape: Callable[[str], str] = str
    unescape: Callable[[str], str] = str
    loss_roles: frozenset[str] = frozenset({"assistant"})


_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE|END)\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?(?:INST|SYS|ROLE|END)\])")


def escape_control(text: str) -> str:
    """One backslash more inside every control string, so that none is left as the template writes it."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape_control(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render_bracketed(turns: Sequence[Turn]) -> str:
    """``<s>``, then every turn between its marks; an assistant's text runs to ``</s>``."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text} </s>")
        elif role == "system":
            out.append(f"[SYS] {text} [/SYS]")
        else:
            out.append(f"[ROLE] {escape_control(role)} [/ROLE] {text} [END]")
    return "".join(out)


_MARKS = (("user", "[INST] ", " [/INST]"), ("system", "[SYS] ", " [/SYS]"), ("assistant", " ", " </s>"))


def parse_bracketed(formatted: str, begins: bool = True) -> list[Turn]:
    """The turns of what ``render_bracketed`` wrote."""
    if begins and not formatted.startswith("<s>"):
        raise ValueError("the conversation does not begin with its mark")
    at, turns = 3 * begins, []
    while at < len(formatted):
        if formatted.startswith("[ROLE] ", at):
            to = formatted.index(" [/ROLE] ", at + 7)
            role, opens, close = unescape_control(formatted[at + 7:to]), to + 9, " [END]"
        else:
            role, mark, close = next(m for m in _MARKS if formatted.startswith(m[1], at))
            opens = at + len(mark)
        to = formatted.index(close, opens)
        turns.append((role, unescape_control(formatted[opens:to])))
        at = to + len(close)
    return turns


BRACKETED = ChatTemplate(render_bracketed, parse_bracketed, escape_control, unescape_control)


def _shared(x: str, y: str) -> int:
    """Length of the common beginning."""
    if y.startswith(x):
        return len(x)
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Located:
    """What turns added to the output; positions count from the end of the lead's output.

    Each span is (start, length, loss start, loss length) or has None where a later turn
    rewrote the place, or where the text cannot be found in the output. ``rewrites`` has
    (turn, characters kept of the output before it).
    """

    text: str
    spans: list[tuple[int | None, int | None, int | None, int | None]]
    rewrites: list[tuple[int, int]]


def locate_turns(template: ChatTemplate, turns: Sequence[Turn], lead: int = 0) -> Located:
    """The spans of ``turns[lead:]``, whose texts are escaped; the first ``lead`` turns are context."""
    render, turns = template.render, list(turns)
    before = render(turns[:lead]) if lead else ""
    base, spans, rewrites = len(before), [], []
    for k in range(lead, len(turns)):
        role, text = turns[k]
        out = render(turns[:k + 1])
        start = _shared(before, out)
        if start < len(before):
            rewrites.append((k - lead, start - base))
            spans = [s if s[0] is not None and s[0] + s[1] <= start - base else (None,) * 4 for s in spans]
        loss: tuple[int | None, int | None] = (None, None)
        if role in template.loss_roles:
            bare, probed = render([*turns[:k], (role, "")]), render([*turns[:k], (role, PROBE)])
            opens = _shared(bare, probed)
            rest = len(bare) - opens
            if len(out) >= len(bare) and out.startswith(bare[:opens]) and out.endswith(bare[opens:]):
                loss = (opens - base, len(out) - rest - opens)
        spans.append((start - base, len(out) - start, *loss))
        before = out
    return Located(before[base:], spans, rewrites)


def check_local(template: ChatTemplate, turns: Sequence[Turn], lead: int) -> None:
    """Refuses a template whose turn after ``lead`` turns of context depends on more than all but the first of them."""
    if lead > 1:
        whole, less = template.render(turns[:lead + 1]), template.render(turns[1:lead + 1])
        if whole[_shared(template.render(turns[:lead]), whole):] != less[_shared(template.render(turns[1:lead]), less):]:
            raise ValueError(f"the template looks back more than {lead - 1} turns: raise lead, or window beyond the longest conversation")


def _spans(rows: list[tuple], located: Located) -> list[dict]:
    return [
        {"turn": r[2], "role": r[3], "start": s[0], "length": s[1], "loss_start": s[2], "loss_length": s[3]}
        for r, s in zip(rows, located.spans, strict=True)]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _formatter(template: ChatTemplate, lead: int, kinds: list[pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (conv_id, part, turn, role, text, context) to one row per part."""
    turn = pa.struct([
        ("turn", kinds[1]), ("role", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
        ("loss_start", pa.int64()), ("loss_length", pa.int64())])
    schema = pa.schema([
        ("conv_id", kinds[0]), ("part", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(turn)), ("rewrites", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (conv, part), group in groupby(_stream(batches), key=lambda r: r[:2]):
            rows = list(group)  # at most window + lead
            own = [r for r in rows if not r[5]]
            if not own:
                continue
            context = len(rows) - len(own)
            turns = [(r[3], template.escape(r[4])) for r in rows]
            if context:
                check_local(template, turns, context)
            found = locate_turns(template, turns, context)
            if context and any(kept < 0 for _, kept in found.rewrites):
                raise ValueError("the template rewrites history beyond a window: raise window beyond the longest conversation")
            held.append({"conv_id": conv, "part": part, "formatted": found.text, "turns": _spans(own, found), "rewrites": len(found.rewrites)})
            size += len(found.text)
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _ordered(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _windows(rows: DataFrame, window: int, lead: int) -> DataFrame:
    """Rows of long conversations by window (part), those of the window before as context.

    Rows are numbered over ranges of (conv_id, turn, role, text): each task has its own run of
    a conversation, and a table of runs has where it begins, so no conversation meets in one task.
    """
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    ranged = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("id")), "turns")
    found = ranged.groupBy("conv_id", "run").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    begins = stage(found.selectExpr(
        "conv_id AS c", "run AS r",
        "coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - low AS base"),
        "runs")
    begins = small(begins)
    placed = ranged.join(begins, ranged["conv_id"].eqNullSafe(begins["c"]) & (ranged["run"] == begins["r"])).withColumn(
        "place", F.col("id") + F.col("base"))
    at, within = F.floor(F.col("place") / window), F.col("place") % window
    parts = F.when(within >= window - lead, F.array(at, at + 1)).otherwise(F.array(at))
    return placed.withColumn("part", F.explode(parts)).select(
        "conv_id", "part", "turn", "role", "text", (at < F.col("part")).alias("context"), "place")


def format_conversations(
        conversations: DataFrame, template: ChatTemplate = BRACKETED, window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """One row per conversation and part: conv_id, part, formatted, turns, rewrites, single.

    ``turns`` has turn, role, start and length of its span, and loss_start and loss_length of
    its text if its role is under the loss mask; positions count code points from the part's
    begin. A conversation of up to ``window`` turns is one part, all of its prefixes are
    rendered, and ``single`` is true. Longer ones are rendered window by window after
    ``lead`` turns of context, so that a conversation that holds much of the table is spread
    over many tasks; a template that looks farther back is refused. ``rewrites`` counts the
    turns that changed output before them; spans they touched are null.

    Turns are ordered by turn (null last), role, text; null roles and texts count as empty,
    equal rows are turns of their own, and rows without conv_id are one conversation. An
    empty table gives no rows; other columns are not read.
    """
    if not 0 <= lead < window:
        raise ValueError("lead has to be below window")
    importable(conversations.sparkSession)
    rows = _ordered(conversations)
    conv, turn = (conversations.schema[c].dataType for c in ("conv_id", "turn"))
    schema = (
        f"conv_id {conv.simpleString()}, part bigint, formatted string, turns array<struct<turn:{turn.simpleString()}, role:string,"
        " start:bigint, length:bigint, loss_start:bigint, loss_length:bigint>>, rewrites bigint")
    from pyspark.sql.pandas.types import to_arrow_type

    run = _formatter(template, lead, [to_arrow_type(conv), to_arrow_type(turn)])
    many = stage(rows.groupBy("conv_id").count().where(F.col("count") > window).select(F.col("conv_id").alias("c")), "long")
    any_long = bool(many.limit(1).count())
    is_long = rows["conv_id"].eqNullSafe(many["c"])
    short = rows.join(small(many), is_long, "left_anti") if any_long else rows
    whole = (
        short.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
        .select("conv_id", F.lit(0).cast("bigint").alias("part"), "turn", "role", "text", F.lit(False).alias("context"))
        .mapInArrow(run, schema).withColumn("single", F.lit(True)))
    if not any_long:
        return whole
    windows = _windows(rows.join(small(many), is_long, "left_semi"), window, lead)
    pieces = (
        windows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").drop("place")
        .mapInArrow(run, schema).withColumn("single", F.lit(False)))
    return whole.union(pieces)


def _reader(template: ChatTemplate, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([
        ("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for conv, group in groupby(_stream(batches), key=lambda r: r[0]):
            n = loss_chars = chars = 0
            told, loss = hashlib.sha256(), hashlib.sha256()
            for _, part, formatted, turns in group:  # one part at a time
                chars += len(formatted)
                for role, text in template.parse(formatted, part == 0):
                    n += 1
                    told.update(f"{role}\n{text}\n".encode())
                for t in turns:
                    if t["loss_start"] is not None:
                        text = template.unescape(formatted[t["loss_start"]:t["loss_start"] + t["loss_length"]])
                        loss_chars += len(text)
                        loss.update(text.encode())
            held.append({"conv_id": conv, "n_turns": n, "turns_sha256": told.hexdigest(), "loss_chars": loss_chars,
                         "loss_sha256": loss.hexdigest(), "formatted_chars": chars})
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_back(formatted: DataFrame, template: ChatTemplate = BRACKETED) -> DataFrame:
    """One row per conversation, from the output of ``format_conversations`` alone: conv_id,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Whole conversations are read where they were formatted. The digest of a conversation in
    parts runs over them in order; they pass through a task one after the other.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if template.parse is None:
        raise ValueError("the template has no parse function")
    kind = formatted.schema["conv_id"].dataType
    run = _reader(template, to_arrow_type(kind))
    schema = (
        f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint")
    rows = formatted.select("conv_id", "part", "formatted", "turns")
    whole = rows.where(formatted["single"]).mapInArrow(run, schema)
    parts = rows.where(~formatted["single"]).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.union(parts.mapInArrow(run, schema))


def chat_report(conversations: DataFrame, template: ChatTemplate = BRACKETED, window: int = WINDOW, lead: int = LEAD) -> DataFrame:
    """``read_back`` of the formatted conversations, whose intermediate tables are removed."""
    with scratch(conversations.sparkSession):
        return outlive(read_back(format_conversations(conversations, template, window, lead), template), "chat")


#: A conversation whose texts are control strings of the template.
HOSTILE = "</s>[INST] ok [/INST]"


def with_hostile(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts look like marks."""
    kinds = conversations.select("conv_id", "turn").schema
    more = conversations.sparkSession.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)],
                                                      "conv_id bigint, turn bigint, role string, text string")
    more = more.select(*(F.col(f.name).cast(f.dataType) for f in kinds), "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").union(more)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(txt, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE|END)\])', '\1\\\2\3', 'g')) AS chars,
         length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE|END)\])', '\1\\\2\3', 'g')) AS role_chars
  FROM c)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn NULLS LAST, role, txt)) AS turns_sha256,
       CAST(coalesce(sum(length(txt)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(txt, '' ORDER BY turn NULLS LAST, role, txt) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(3 + sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 6
                            ELSE role_chars + 22 END) AS BIGINT) AS formatted_chars
FROM e
GROUP BY conv_id
"""
