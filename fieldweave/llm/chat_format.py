"""Chat formatting by grammar round trip, in DataFrame functions alone.

Grammar of a rendered conversation (one string per conversation):

    conversation := "<s>" turn*
    turn         := "[TAG] " content close "\\n"
    TAG          := "INST" (user) | "ASST" (assistant) | "SYS" (system) | "ROLE:" hex(utf-8 of any other role)
    close        := " </s>" (assistant) | " [/TAG]" (others)

A control string is "<s>", "</s>", "[X]" or "[/X]" with X a tag. Texts are first rendered as they are; the rendering is parsed again and compared
with the source turns. Conversations that do not come back identical have their conflicting content escaped: in every control string of a text, also one
that already carries backslashes, one backslash goes in after the bracket. The parser takes one away. The escaped form is parsed and compared again, and
a conversation that still differed would raise an error. Control strings hold a bracket only in first place, so none can arise where a text meets a tag.

Cases: null text and null role are empty; a null turn sorts first; ties in a turn sort by role, then text; repeated rows are turns of their own;
a null conv_id is a conversation of its own; an empty table gives an empty result. Other columns are not read. A conversation is one string by definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles with tags of their own.
TAGS = {"user": "INST", "assistant": "ASST", "system": "SYS"}
TAG = r"(?:INST|ASST|SYS|ROLE:[0-9A-F]*)"
RAW = rf"<(?=/?s>)|\[(?=/?{TAG}\])"
CORE = rf"(?:<(?=\\*/?s>)|\[(?=\\*/?{TAG}\]))"
ESCAPED = rf"(?:<(?=\\+/?s>)|\[(?=\\+/?{TAG}\]))"
CLOSE = r" (?:</s>|\[/(?:INST|SYS|ROLE:[0-9A-F]*)\])\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({CORE})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"({ESCAPED})\\", "$1")


def tag_of(role: Column) -> Column:
    out = F.concat(F.lit("ROLE:"), F.hex(F.encode(role, "UTF-8")))
    for name, tag in TAGS.items():
        out = F.when(role == name, F.lit(tag)).otherwise(out)
    return out


def role_of(tag: Column) -> Column:
    out = F.decode(F.unhex(F.substring(tag, 6, 1 << 30)), "UTF-8")
    for name, known in TAGS.items():
        out = F.when(tag == known, F.lit(name)).otherwise(out)
    return out


def render(turns: Column) -> Column:
    """turns: array of struct(role, text)."""

    def one(t: Column) -> Column:
        tag = tag_of(t["role"])
        close = F.when(tag == "ASST", F.lit(" </s>\n")).otherwise(F.concat(F.lit(" [/"), tag, F.lit("]\n")))
        return F.concat(F.lit("["), tag, F.lit("] "), t["text"], close)

    return F.concat(F.lit("<s>"), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column) -> Column:
    """array of struct(role, text): cut at closing tags, read the opening tag of each piece, unescape the rest. A bare control string in a content breaks the grammar; such a turn has no role."""
    pieces = F.split(F.substring(formatted, 4, 1 << 30), CLOSE, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        end = F.instr(p, "] ")
        content = F.substr(p, end + 2, F.char_length(p))
        role = F.when(~F.regexp_like(content, F.lit(RAW)), role_of(F.substr(p, F.lit(2), end - 2)))
        return F.struct(role.alias("role"), unescape(content).alias("text"))

    return F.transform(pieces, one)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns: the rows of a conversation in order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"), role.alias("role"), text.alias("text"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def chat_format(rows: DataFrame) -> DataFrame:
    """conv_id, turns (the source), formatted, escaped (whether content had to be), parsed (read back from formatted)."""
    conv = conversations(rows)
    plain = conv.select("conv_id", "turns", render(F.col("turns")).alias("plain"))
    # The parse of the plain form comes back identical unless a text holds a control string or an escaped one.
    tried = plain.withColumn("same", parse(F.col("plain")) == F.col("turns"))
    guarded = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))
    done = tried.select("conv_id", "turns", F.when(F.col("same"), F.col("plain")).otherwise(render(guarded)).alias("formatted"), (~F.col("same")).alias("escaped"))
    back = done.withColumn("parsed", parse(F.col("formatted")))
    sure = F.when(F.col("parsed") == F.col("turns"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation does not come back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return back.select("conv_id", "turns", sure.alias("formatted"), "escaped", "parsed")


def loss_text(parsed: Column) -> Column:
    return F.array_join(F.transform(F.filter(parsed, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be checked of chat_format's output, all of it from the turns that were read back."""
    joined = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = formatted.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), loss_text(F.col("parsed")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"), "escaped")
    return rows.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "escaped")


#: DuckDB: the same digests from the source turns, the rendering by RE2 (which has no lookahead, so the core is matched and put back).
SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(?:INST|ASST|SYS|ROLE:[0-9A-F]*)\])', '[\\\1', 'g') safe,
    CASE role WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'ASST' WHEN 'system' THEN 'SYS' ELSE 'ROLE:' || hex(encode(role)) END tag FROM r),
c AS (
  SELECT conv_id, count(*) n, bool_or(safe <> text) escaped,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') loss,
    3 + sum(2 + length(tag) + 1 + length(safe) + CASE WHEN tag = 'ASST' THEN 6 ELSE 5 + length(tag) END) chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n::BIGINT n_turns, sha256(turns) turns_sha256, length(loss)::BIGINT loss_chars, sha256(loss) loss_sha256, chars::BIGINT formatted_chars, escaped FROM c
"""
