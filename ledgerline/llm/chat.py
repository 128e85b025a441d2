"""Chat texts rebuilt from event logs, rendered with a loss mask and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import runs

TURN, END = "<s>", "</s>"
USER, SYSTEM = ("[INST] ", " [/INST]"), ("<<SYS>>", "<</SYS>>")
_CONTROLS = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>")
_TURN = re.compile(r"<s>((?:\\.|[^\\\n])*)\n(.*?)</s>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
CHUNK = 200


def escape(text: str) -> str:
    """Text without control strings: backslashes are doubled, a control string gets one after its first character."""
    return _CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (in code points) of what assistants said."""
    out, at, spans = [], 0, []
    for role, text in turns:
        before, after = USER if role == "user" else SYSTEM if role == "system" else ("", "")
        head = f"{TURN}{escape(role)}".replace("\n", "\\\n") + "\n" + before
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{after}{END}")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that :func:`render` was given."""
    turns = []
    for role, body in _TURN.findall(formatted):
        role = unescape(role)
        before, after = USER if role == "user" else SYSTEM if role == "system" else ("", "")
        turns.append((role, unescape(body[len(before) : len(body) - len(after)])))
    return turns


def fold(events: pd.DataFrame) -> list[tuple[str, str]]:
    """Final turns of one conversation's events in sequence order.

    start opens a message with its role; delta appends; edit replaces the text so
    far; regenerate forgets it. A message is placed where it was first named.
    """
    roles: dict = {}
    parts: dict = {}
    for message, kind, role, text in zip(events["message"], events["kind"], events["role"], events["text"], strict=True):
        said = parts.setdefault(message, [])
        if kind == "start":
            roles[message] = role or ""
        elif kind == "delta":
            said.append(text or "")
        elif kind in ("edit", "regenerate"):
            said[:] = [text or ""]
        else:
            raise ValueError(f"unknown event {kind}")
    return [(roles.get(m, ""), "".join(said)) for m, said in parts.items()]


def turn_events(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The log that a chat service would have kept of (conv_id, turn, role, text).

    Each turn starts a message. An assistant's answer is streamed, thrown away,
    and streamed again in pieces of ``chunk`` characters; other turns are sent
    in upper case and then edited to what they say. Turns go by turn, role and
    text, NULL first; equal rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    rows = conversations.select(
        "conv_id", F.row_number().over(order).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    text = F.col("text")
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(chunk))
    stream = F.transform(starts, lambda i: event("delta", F.substring(text, i, F.lit(chunk))))
    start = F.array(event("start", F.lit("")))
    answered = F.concat(start, stream, F.array(event("regenerate", F.lit(""))), stream)
    written = F.concat(start, F.array(event("delta", F.upper(text)), event("edit", text)))
    log = F.when(F.col("role") == "assistant", answered).otherwise(written)
    return rows.select("conv_id", "message", "role", F.posexplode(log).alias("step", "event")).select(
        "conv_id", F.struct("message", "step").alias("seq"), "message", F.col("event.kind").alias("kind"), "role",
        F.col("event.text").alias("text"),
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss (start and end of each span).

    The log is partitioned by conversation and sorted by sequence; a task walks
    through its sorted rows and holds one conversation at a time, which its
    formatted text needs anyway. A NULL conv_id is a conversation of its own, apart from any name; a message
    without a start has an empty role; equal events each count; NULL texts are
    empty. No events give no rows; other columns are ignored.
    """

    def render_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in runs(batches, ["nameless", "key"]):
            turns = fold(one)
            formatted, spans = render(turns)
            yield pd.DataFrame({"conv_id": [one["conv"].iloc[0]], "n_turns": [len(turns)], "formatted": [formatted],
                                "loss": [[{"start": a, "end": b} for a, b in spans]]})

    kind = dict(events.dtypes)["conv_id"]
    name = F.col("conv_id").cast("string")
    log = events.select(name.isNull().alias("nameless"), F.coalesce(name, F.lit("")).alias("key"), name.alias("conv"), "seq", "message", "kind", "role", "text")
    log = log.repartition("nameless", "key").sortWithinPartitions("nameless", "key", "seq").drop("seq")
    out = log.mapInPandas(render_all, "conv_id string, n_turns long, formatted string, loss array<struct<start:long,end:long>>")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def digests(rendered: DataFrame) -> DataFrame:
    """What the formatted texts say, read back from them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, formatted, loss in zip(batch["conv_id"], batch["formatted"], batch["loss"], strict=True):
                turns = parse(formatted)
                said = "".join(unescape(formatted[x["start"] : x["end"]]) for x in loss)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(said),
                             hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(rendered.dtypes)["conv_id"]
    out = rendered.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss").mapInPandas(
        read, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


PROBE = "</s>[INST] ok [/INST]"
_LENGTH = "length({})"
for _c in ("\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
    _LENGTH += f" + (length({{}}) - length(replace({{}}, '{_c}', ''))) // {len(_c)}"
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
s AS (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS said,
             sum(8 + {_LENGTH.replace('{}', 'role')} + {_LENGTH.replace('{}', 'text')}
                 + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 ELSE 0 END) AS chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, cast(length(said) AS bigint) AS loss_chars, sha256(said) AS loss_sha256,
       cast(chars AS bigint) AS formatted_chars FROM s
"""
