"""Chat formatting: a finite-state machine over roles checks the turn order, a declarative template gives text segments
with loss flags. DataFrame functions only; a turn's segments come from its own row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is written: head + role + colon, the text, and the end mark. `escapes` are (string, code) pairs: inside
    roles and texts the string is written as the escape sign and the code, the escape sign itself doubled, so that
    no control string occurs there. `order` are the machine's moves: role before -> roles that may follow, "" the start;
    `last` the roles it may stop in; `loss` the roles whose texts are learnt."""

    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    escape: str = "\\"
    escapes: tuple = (("###", "h"), ("</turn>", "e"))
    role_escapes: tuple = ((": ", "c"),)
    order: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple = ("assistant",)
    loss: tuple = ("assistant",)

    def guarded(self, text: Column, role: bool = False) -> Column:
        out = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for string, code in self.escapes + (self.role_escapes if role else ()):
            out = F.replace(out, F.lit(string), F.lit(self.escape + code))
        return out

    def plain(self, text: Column, role: bool = False) -> Column:
        """The reverse of `guarded`: doubled escape signs, taken from the left, part pieces that hold none."""

        def piece(x):
            for string, code in self.escapes + (self.role_escapes if role else ()):
                x = F.replace(x, F.lit(self.escape + code), F.lit(string))
            return x

        return F.array_join(F.transform(_cut(text, self.escape * 2), piece), self.escape)


def _cut(text: Column, mark: str) -> Column:
    """`text` cut at every occurrence of `mark`, from the left."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != "\n" else c for c in mark)
    return F.split(text, quoted, -1)


def turns(conversations: DataFrame, template: Template) -> DataFrame:
    """(conv_id, turn, role, segments, valid_turn): the segments (kind, text, loss) of every row of `conversations`.

    A null role or text is empty. Rows of one conversation are in the order of turn, role, text; nulls first.
    `valid_turn` says whether the machine may move from the role before to this one, and, in the last row, stop there.
    """
    t = template
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before, after = F.lag("role", 1).over(order), F.lead("role", 1).over(order)
    allowed = F.lit(False)
    for role, nexts in t.order.items():
        allowed = allowed | ((F.coalesce(before, F.lit("")) == role) & (before.isNull() if role == "" else before.isNotNull()) & F.col("role").isin(*nexts))
    segment = lambda kind, text, loss: F.struct(F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))
    segments = F.array(
        segment("head", F.concat(F.lit(t.head), t.guarded(F.col("role"), role=True), F.lit(t.colon)), F.lit(False)),
        segment("text", t.guarded(F.col("text")), F.col("role").isin(*t.loss)),
        segment("end", F.lit(t.end), F.lit(False)),
    )
    return rows.select("conv_id", "turn", "role", "text", segments.alias("segments"), (allowed & (after.isNotNull() | F.col("role").isin(*t.last))).alias("valid_turn"))


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, formatted, segments, valid): each conversation as one text and as its segments with loss flags.

    `valid` is the machine's verdict; conversations it refuses are formatted all the same. A conversation is one row of
    the result, as long as itself. An empty table gives no rows.
    """
    template = template or Template()
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segments", "valid_turn")))
    rows = turns(conversations, template).groupBy("conv_id").agg(ordered.alias("rows"))
    segments = F.flatten(F.col("rows.segments"))
    return rows.select("conv_id", F.array_join(segments.getField("text"), "").alias("formatted"), segments.alias("segments"), F.forall("rows", lambda r: r["valid_turn"]).alias("valid"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted, valid): turns (role, text) parsed from the text alone, and the texts under the loss flags."""
    t = template or Template()
    raw = F.filter(_cut(F.col("formatted"), t.end), lambda x: x != "")

    def turn(x):
        place = F.instr(x, t.colon)
        return F.struct(t.plain(F.substring(x, F.lit(len(t.head) + 1), place - len(t.head) - 1), role=True).alias("role"), t.plain(F.substring(x, place + len(t.colon), F.length(x))).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.plain(s["text"]))
    return formatted.select("conv_id", F.transform(raw, turn).alias("turns"), loss.alias("loss_texts"), "formatted", "valid")


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
