"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

Output of format_conversations(), one row per conversation:

    conv_id, n_turns, valid_order, bad_turn, segments ARRAY<STRUCT<text, loss>>, formatted

`formatted` is the concatenation of the segments' texts. A segment with loss = true holds
exactly one text of a loss role (escaped); all else, control strings included, has loss = false.

Escaping: every character of template.special within a role or text gets template.escape
behind it. Control strings start with a special character that is not followed by the escape,
so they never occur inside an escaped text, and unescaping is one left-to-right replacement.

Defined results: null text or role = empty string; null conv_id = one conversation of its own;
equal turn numbers are ordered by role and text, and repeated rows are kept as repeated turns;
an empty table gives no rows; extra columns are ignored. A conversation is one output value,
so its rows meet in one row of one task; that is its size, not the table's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, loss roles and the machine that says which role may follow which."""

    turn_open: str = "<|turn|>"
    role_close: str = "<|text|>"
    turn_close: str = "<|done|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    special: str = "<[\\"
    escape: str = "\\"
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def __post_init__(self):
        for c in (self.turn_open, self.role_close, self.turn_close):
            if c[0] not in self.special or c[1:2] == self.escape:
                raise ValueError(f"control string {c!r} could occur inside an escaped text")


def _class(t: Template) -> str:
    return "([" + "".join("\\" + c for c in t.special) + "])"


def escape(c: Column, t: Template) -> Column:
    return F.regexp_replace(c, _class(t), "$1" + "\\" + t.escape)


def unescape(c: Column, t: Template) -> Column:
    return F.regexp_replace(c, _class(t) + "\\" + t.escape, "$1")


def _quote(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, with its segments, their loss flags and the formatted text."""
    t = template or Template()
    turns = (
        rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("x")).alias("turns"))
    )
    moves = F.create_map(*[F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}>{r}", to)])
    states = F.aggregate(
        "turns",
        F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad")),
        lambda a, x: F.struct(
            F.coalesce(F.try_element_at(moves, F.concat(a["state"], F.lit(">"), x["role"])), x["role"]).alias("state"),
            (a["n"] + 1).alias("n"),
            F.coalesce(a["bad"], F.when(F.try_element_at(moves, F.concat(a["state"], F.lit(">"), x["role"])).isNull(), a["n"])).alias("bad"),
        ),
    )

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(t.turn_open), escape(x["role"], t), F.lit(t.role_close))
        part = lambda c, loss: F.struct(c.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))
        return F.array(part(head, False), part(escape(x["text"], t), x["role"].isin(*t.loss_roles)), part(F.lit(t.turn_close), False))

    out = turns.select("conv_id", "turns", states.alias("s"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        (F.col("s.bad").isNull() & F.col("s.state").isin(*t.accept)).alias("valid_order"),
        F.col("s.bad").cast("long").alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, t: Template) -> Column:
    """ARRAY<STRUCT<role, text>> parsed back from a formatted text."""
    pieces = F.split(formatted, _quote(t.turn_close))
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    strip = lambda p: F.split(F.substring(p, len(t.turn_open) + 1, 2**31 - 1), _quote(t.role_close), 2)
    return F.transform(F.transform(whole, strip), lambda p: F.struct(unescape(p[0], t).alias("role"), unescape(p[1], t).alias("text")))


def read_loss_texts(segments: Column, t: Template) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], t))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one adversarial conversation, digested from the formatted output."""
    from corpusmill.llm.common import table

    t = Template()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(odd).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")
    ).select("conv_id", "x.turn", "x.role", "x.text")
    out = format_conversations(rows.unionByName(extra), t)
    back = out.select("*", read_turns(F.col("formatted"), t).alias("back"), F.array_join(read_loss_texts(F.col("segments"), t), "").alias("loss"))
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid_order",
    )


_N = "length(r) - length(replace(replace(replace(r, '<', ''), '[', ''), '\\', '')) + length(x) - length(replace(replace(replace(x, '<', ''), '[', ''), '\\', ''))"
ORACLE_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, row_number() OVER w AS k, lag(r, 1, 'start') OVER w AS before FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x)),
g AS (
  SELECT conv_id, count(*) AS n, string_agg(r || chr(10) || x || chr(10), '' ORDER BY k) AS s,
         coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY k), '') AS loss,
         sum(24 + length(r) + length(x) + {_N}) AS f,
         bool_and((before, r) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
           AND arg_max(r, k) = 'assistant' AS ok
  FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(s) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars, ok AS valid_order
FROM g
"""
