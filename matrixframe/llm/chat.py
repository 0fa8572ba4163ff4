"""Chat formatting with a reversible template and a loss mask, in Spark expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Template:
    """Control strings: ``open role close`` starts a run of turns, ``then`` parts its texts, ``end`` ends it.

    Inside texts and roles a backslash goes behind the first character of whatever could read as a
    control string, also of one that already has backslashes there, and reading takes one away. So
    every text comes back as it was, and no control string can arise from one.
    """

    open: str = "[INST]"
    close: str = "[/INST]"
    then: str = "<s>"
    end: str = "</s>"

    def _like_control(self, backslashes: str) -> str:
        """A first character of a control string, backslashes, and the rest of one."""
        controls = (self.open, self.close, self.then, self.end)
        firsts = "".join(sorted({f"\\{c[0]}" for c in controls}))
        return f"([{firsts}]){backslashes}(\\\\*(?:{'|'.join(sorted({_literal(c[1:]) for c in controls}))}))"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._like_control(""), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._like_control(r"\\"), "$1$2")


TEMPLATE = Template()


def format_chats(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row a conversation: ``conv_id, formatted, loss_spans``.

    ``turns`` has ``conv_id, turn, role, text``. The turns of a conversation are collected as structs
    and sorted by turn (null first; ties by role, then text, null first). Adjacent turns of one role
    merge into one run. ``loss_spans`` are ``(start, end)`` code points in ``formatted`` of each
    assistant text, without the separators around it.

    Null text and null role count as empty. A repeated row is a turn of its own. An empty table gives
    no rows; rows with null conv_id form one conversation. Other columns are ignored. The turns of
    one conversation are one string in the end and meet in one task; conversations are dealt by id.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    collected = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns")
    )

    def runs(t: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(t) - 1),
            lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda x, k: let(
                    F.slice(t, x + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - x),
                    lambda part: F.struct(
                        part[0]["role"].alias("role"),
                        F.transform(part, lambda y: template.escape(y["text"])).alias("texts"),
                    ),
                ),
            ),
        )

    merged = collected.select("conv_id", runs(F.col("turns")).alias("runs"))
    head = lambda r: F.concat(F.lit(template.open), template.escape(r["role"]), F.lit(template.close))
    blocks = F.transform("runs", lambda r: F.concat(head(r), F.array_join(r["texts"], template.then), F.lit(template.end)))
    step = len(template.then)
    # (start, length) of every text within its run, then of every run in the whole
    lengths = F.transform("runs", lambda r: F.struct(
        r["role"].alias("role"), F.length(head(r)).cast("long").alias("head"),
        F.transform(r["texts"], lambda x: F.length(x).cast("long")).alias("texts"),
    ))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda acc, r: let(
            F.aggregate(
                r["texts"],
                F.struct((acc["at"] + r["head"]).alias("at"), none.alias("spans")),
                lambda a, n: F.struct(
                    (a["at"] + n + step).alias("at"),
                    F.when(
                        r["role"] == "assistant",
                        F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + n).alias("end")))),
                    ).otherwise(a["spans"]).alias("spans"),
                ),
            ),
            lambda inner: F.struct(
                (inner["at"] - step + len(template.end)).alias("at"),
                F.concat(acc["spans"], inner["spans"]).alias("spans"),
            ),
        ),
        lambda acc: acc["spans"],
    )
    return merged.select("conv_id", F.array_join(blocks, "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted conversation, as ``array<struct<role, text>>`` in order."""
    ended = F.split(formatted, _literal(template.end))
    blocks = F.slice(ended, F.lit(1), F.size(ended) - 1)
    return F.flatten(
        F.transform(
            blocks,
            lambda b: let(
                F.split(F.substring(b, len(template.open) + 1, 2**31 - 1), _literal(template.close), 2),
                lambda p: F.transform(
                    F.split(p[1], _literal(template.then)),
                    lambda x: F.struct(template.unescape(p[0]).alias("role"), template.unescape(x).alias("text")),
                ),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: template.unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )


def _literal(control: str) -> str:
    return "".join(f"\\{c}" if c in r"[]\^$.|?*+(){}" else c for c in control)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS n,
    length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS n_role FROM numbered)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN opens THEN 6 + n_role + 7 + 4 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
