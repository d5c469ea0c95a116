r"""Chat formatting with a grammar round trip.

A conversation is a header line, then its turns::

    <chat LEVEL>
    ### role: text </turn>

Level 0 writes texts as they are. A deterministic parser reads the string back; if the turns it finds are not the
turns that went in (a text holds a control string), the conversation is written at level 1, where ``\`` becomes
``\b``, ``</turn>`` becomes ``\e`` and ``###`` becomes ``\h``, and is parsed and compared again. Roles are always
escaped, ``:`` as ``\c`` and a line feed as ``\n`` besides. In an escaped string each backslash starts one of these
pairs, so replacing ``\e``, ``\h``, ``\c``, ``\n`` and last ``\b`` undoes it.

The loss mask is a run-length code: for each turn, characters outside the loss and then characters inside it, which
are the assistant's text. Only DataFrame functions run; turns meet by one shuffle on the conversation. A conversation
is one string, so one task builds it; its cost is linear in its length.

Edge cases: null texts and roles are empty; turns are ordered by turn (null first), then role and text, so ties and
repeated rows have one order and all stay; rows with a null conv_id form one conversation; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
#: Control strings inside texts, and what stands for them when escaped; the backslash first.
ESCAPES = [("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c"), ("\n", "\\n")]
LOSS_ROLE = "assistant"


def _replace(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape(x: Column, pairs=ESCAPES) -> Column:
    return _replace(x, pairs)


def unescape(x: Column, pairs=ESCAPES) -> Column:
    return _replace(x, [(b, a) for a, b in reversed(pairs)])


def _header(level: int) -> str:
    return f"<chat {level}>\n"


def render(turns: Column, level: int) -> Column:
    """The string of an array of (turn, role, text) in order."""
    text = (lambda t: escape(t["text"])) if level else (lambda t: t["text"])
    return F.concat(F.lit(_header(level)), F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(SEP), text(t), F.lit(CLOSE))), ""))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted string, without their end marks."""
    body = F.substr(formatted, F.lit(len(_header(0)) + 1))
    return F.transform(let(F.split(body, CLOSE, -1), lambda p: F.slice(p, 1, F.size(p) - 1)), lambda p: p)


def parse(formatted: Column) -> Column:
    """Array of (role, text), read from the string alone; null where a turn breaks the grammar."""
    level = F.substr(formatted, F.lit(len("<chat ") + 1), F.lit(1))

    def turn(p: Column) -> Column:
        at = F.instr(p, SEP)
        raw = F.substr(p, at + len(SEP))
        text = F.when(level == "0", raw).otherwise(unescape(raw))
        role = unescape(F.substr(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), ROLE_ESCAPES)
        good = p.startswith(OPEN) & (at > 0) & ~raw.contains("###") & ~raw.contains("</turn>")
        return F.when(good, F.struct(role.alias("role"), text.alias("text")))

    return F.transform(pieces(formatted), turn)


def loss_mask(formatted: Column) -> Column:
    """Run lengths by turn, in characters: ``skip`` outside the loss, then ``take`` inside it.

    A turn's skip starts where the one before took its last, so it counts that turn's end mark too.
    """
    role = escape(F.lit(LOSS_ROLE), ROLE_ESCAPES)

    def run(p: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(len(_header(0)))).otherwise(F.lit(len(CLOSE)))
        at = F.instr(p, SEP) + len(SEP) - 1
        own = F.substr(p, F.lit(len(OPEN) + 1), at - len(OPEN) - len(SEP)) == role
        return F.struct((before + F.when(own, at).otherwise(F.length(p))).alias("skip"), F.when(own, F.length(p) - at).otherwise(F.lit(0)).alias("take"))

    return F.transform(pieces(formatted), run)


def under_mask(formatted: Column, mask: Column) -> Column:
    """Texts under the mask, unescaped as the string's level says."""
    level = F.substr(formatted, F.lit(len("<chat ") + 1), F.lit(1))
    cut = F.zip_with(pieces(formatted), mask, lambda p, m: F.when(m["take"] > 0, F.substr(p, F.length(p) - m["take"] + 1)))
    return F.transform(F.filter(cut, lambda x: x.isNotNull()), lambda x: F.when(level == "0", x).otherwise(unescape(x)))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, level, loss_mask, turns (as parsed back) and identical (the round trip holds)."""
    none = F.lit("")
    one = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), none).alias("role"), F.coalesce(F.col(f"`{text}`"), none).alias("text"))
    grouped = rows.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("source"))
    plain = grouped.select("*", render(F.col("source"), 0).alias("plain"))
    told = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    tried = plain.select("*", F.coalesce(parse(F.col("plain")) == told, F.lit(False)).alias("clean"))
    out = tried.select("conv_id", "source", F.when(F.col("clean"), F.col("plain")).otherwise(render(F.col("source"), 1)).alias("formatted"), F.when(F.col("clean"), 0).otherwise(1).alias("level"))
    out = out.select("*", parse(F.col("formatted")).alias("turns"), loss_mask(F.col("formatted")).alias("loss_mask"))
    return out.select("conv_id", "formatted", "level", "loss_mask", "turns", F.coalesce(F.col("turns") == told, F.lit(False)).alias("identical"))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted strings finds: counts and digests of turns and of the text under the loss mask."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(under_mask(F.col("formatted"), F.col("loss_mask")), "")
    out = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("level").cast("int").alias("level"), "identical")
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "level", "identical")
