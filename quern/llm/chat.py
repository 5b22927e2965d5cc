"""Chat formatting with typed content parts.

A visitor turns the parts of a message (text, image, audio, document) into text with ordered placeholders, and records
what each placeholder refers to and how many tokens it expands to. Turns are marked <|start|>role, newline, content, <|end|>,
newline; a conversation is its turns one after the other. Turns, roles, texts and the masked text are read back from that string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

START, END = "<|start|>", "<|end|>\n"
#: What no text may say as it stands: this template's marks and those of other templates, "<" or "[" and what may follow.
_ANGLE, _SQUARE = r"(<)(\\*)(\||/?s>|/?SYS>>)", r"(\[)(\\*)(/?INST\])"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    r"""Puts a backslash behind the "<" or "[" of a control string, also where backslashes stand there already; null: empty.

    Nothing else changes, so any text comes back by unescape(), which takes one backslash away in the same places.
    """
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _ANGLE, r"$1$2\\$3"), _SQUARE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(<)(\\*)\\(\||/?s>|/?SYS>>)", "$1$2$3"), r"(\[)(\\*)\\(/?INST\])", "$1$2$3")


def role_line(role: Column) -> Column:
    """A role as one line, reversibly: a backslash doubled, a newline as a backslash and n, control strings escaped; null: empty."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


class PartVisitor:
    """Column expressions for one part each; subclass to change placeholders or token counts.

    Unknown and null kinds are read as text. Missing sizes count as the least the kind can have: one patch, one frame, one page.
    """

    patch, frames_a_second, tokens_a_page = 14, 25, 256

    def image(self, p: Column) -> Column:
        side = lambda n: F.greatest(F.ceil(F.coalesce(p[n], F.lit(1)) / self.patch), F.lit(1))
        return (side("width") * side("height")).cast("long")

    def audio(self, p: Column) -> Column:
        return F.greatest(F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * self.frames_a_second), F.lit(1)).cast("long")

    def document(self, p: Column) -> Column:
        return (F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * self.tokens_a_page).cast("long")

    kinds = ("image", "audio", "document")

    def visit(self, parts: Column) -> Column:
        """parts -> struct(content: text with placeholders, attachments: [kind, place, ref, tokens], tokens: sum of these).

        Placeholders read <|kind:place|>, by place among the message's attachments from 0. Null or empty parts: empty.
        """
        parts = F.coalesce(parts, F.array().cast(PARTS))
        is_att = lambda p: F.coalesce(p["type"].isin(*self.kinds), F.lit(False))
        def att(p, i):
            n = F.when(p["type"] == "image", self.image(p)).when(p["type"] == "audio", self.audio(p)).otherwise(self.document(p))
            return F.struct(p["type"].alias("kind"), i.cast("int").alias("place"), p["ref"].alias("ref"), n.alias("tokens"))
        atts = F.transform(F.filter(parts, lambda p: is_att(p)), att)
        before = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i), lambda p: is_att(p)))
        said = F.transform(parts, lambda p, i: F.when(is_att(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), before(i).cast("string"), F.lit("|>"))).otherwise(escape(p["text"])))
        return F.struct(F.array_join(said, "").alias("content"), atts.alias("attachments"), F.aggregate(atts, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"))


def turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None, visitor: PartVisitor | None = None) -> DataFrame:
    """One row a message: conv_id, turn, formatted (the turn's string), mask_start, mask_length (what of it is trained on, in code points; 0 long where nothing is), attachments, tokens.

    A message without typed parts is visited as one part, its text. Narrow: nothing is shuffled. Null role: empty; null
    text: empty; control strings in texts and roles are escaped. Only the assistant's content is under the loss mask.
    Very long texts stay whole, repeated rows are turns of their own, no rows: no rows; other columns aren't read.
    """
    if parts is None:
        one = {"type": F.lit("text"), "text": col(text)}
        content = F.array(F.struct(*[one.get(n, F.lit(None)).alias(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages")])).cast(PARTS)
    else:
        content = col(parts)
    r = F.coalesce(col(role), F.lit(""))
    out = messages.select(col(conv).alias("conv_id"), col(turn).alias("turn"), F.concat(F.lit(START), role_line(r), F.lit("\n")).alias("head"), (visitor or PartVisitor()).visit(content).alias("b"), (r == "assistant").alias("loss"))
    size = lambda c: F.length(c).cast("long")
    return out.select("conv_id", "turn", F.concat("head", "b.content", F.lit(END)).alias("formatted"), size("head").alias("mask_start"), F.when(F.col("loss"), size("b.content")).otherwise(F.lit(0).cast("long")).alias("mask_length"), F.col("b.attachments").alias("attachments"), F.col("b.tokens").alias("tokens"))


def ordered(formatted: DataFrame) -> DataFrame:
    """Turns of a conversation one after the other within a partition, by turn (nulls first), then by what they say.

    Only the sort needs memory, and it spills; a conversation of any length streams through, so a hot one fits too. Its
    text has to pass through one task, as its hash is sequential; formatting has been done before, by all.
    """
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")


def plain(content: str) -> str:
    """Text as it was before escape()."""
    return re.sub(r"(\[)(\\*)\\(/?INST\])", r"\1\2\3", re.sub(r"(<)(\\*)\\(\||/?s>|/?SYS>>)", r"\1\2\3", content))


def plain_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain(line))


#: what the visitor puts in for a part that isn't text
PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):\d+\|>")


class Reader:
    """Reads one conversation back from its string, which comes in pieces, cut anywhere; keeps one turn and running hashes."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.masked, self.attached, self.tokens = conv, 0, 0, 0, 0, 0
        self.said, self.loss, self.rest = hashlib.sha256(), hashlib.sha256(), ""

    def feed(self, piece: str, start: int, length: int, tokens: int) -> None:
        """start and length: the mask, within the piece."""
        self.chars += len(piece)
        self.tokens += tokens
        under = plain(piece[start : start + length])
        self.masked += len(under)
        self.loss.update(under.encode("utf-8", "surrogatepass"))
        *done, self.rest = (self.rest + piece).split(END)
        for t in done:
            role, mark, content = t.removeprefix(START).partition("\n")
            if not t.startswith(START) or not mark:
                raise ValueError("not a conversation of this template")
            self.turns += 1
            self.attached += len(PLACEHOLDER.findall(content))
            self.said.update(f"{plain_role(role)}\n{plain(content)}\n".encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("a turn has no end")
        return self.conv, self.turns, self.said.hexdigest(), self.masked, self.loss.hexdigest(), self.chars, self.attached, self.tokens


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attached_tokens")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation, of the pieces of its string in order."""
    now, done, kind = None, [], None

    def batch() -> pa.RecordBatch:
        c = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=COLUMNS)

    for b in batches:
        kind = b.schema.field(0).type
        for conv, *piece in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv != now.conv:
                if now:
                    done.append(now.row())
                now = Reader(conv)
            now.feed(*piece)
        if done:
            yield batch()
    if now:
        done.append(now.row())
        yield batch()


def read_back(formatted: DataFrame) -> DataFrame:
    """COLUMNS of what turns() returned, a row a conversation, read from its string and its mask alone; only attached_tokens is summed up from the rows.

    Null conv_id: a conversation of its own. No rows: no rows. Repeated rows are turns each. Columns besides those of turns() are ignored.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    o = ordered(formatted).select("conv_id", "formatted", "mask_start", "mask_length", "tokens")
    return o.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attached_tokens long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(turns(m.unionByName(extra)))


SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS line FROM m),
e AS (SELECT *, '<|start|>' || regexp_replace(regexp_replace(line, '(<)(\\*)(\||/?s>|/?SYS>>)', '\1\2\\\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\2\\\3', 'g') || chr(10)
  || regexp_replace(regexp_replace(text, '(<)(\\*)(\||/?s>|/?SYS>>)', '\1\2\\\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\2\\\3', 'g') || '<|end|>' || chr(10) AS formatted FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS attached_tokens
FROM e GROUP BY conv_id
"""
