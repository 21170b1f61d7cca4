"""Chat formatting: prefix-target expansion.

Every assistant turn becomes one example: all turns before it are context, only its text is
trainable. A turn is written ``### role: text</turn>`` and a newline. Inside roles and texts
the backslash, ``#`` and ``<`` (in roles also ``:``) are replaced by two-character codes, so no
text can imitate a marker and every text can be read back exactly.

Defined results: null text or role counts as empty; turns sort by (turn, role, text), nulls
first; repeated rows are repeated turns; a conversation that does not end with an assistant
turn gets a last example with ``target_turn`` null and an empty loss span, so the output always
holds all turns; an empty table gives no rows; other columns are ignored.

Scale: one shuffle by conversation. An example holds its whole context, so rows are as long as
conversations and the output grows with the sum of squared lengths: that is the method. One
conversation is the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
_CODES = [("\\", "\\s"), ("#", "\\h"), ("<", "\\l")]
_ROLE_CODES = [*_CODES, (":", "\\c")]


def escape(text: Column, codes: list[tuple[str, str]] = _CODES) -> Column:
    """Write control characters as codes; the backslash goes first, so codes stay intact."""
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]] = _ROLE_CODES) -> Column:
    """Inverse of escape: the backslash goes last, as until then each one starts a code."""
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand_prefix_targets(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), target_turn (position from 0, or null),
    formatted, loss_start and loss_chars in code points of ``formatted``."""
    said = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("said"),
    )
    conversations = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    opened = lambda t: F.concat(F.lit("### "), escape(t["role"], _ROLE_CODES), F.lit(": "))
    written = conversations.select(
        "conv_id",
        F.transform("said", lambda t: t["role"] == target_role).alias("is_target"),
        F.transform("said", opened).alias("heads"),
        F.transform("said", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("said", lambda t: F.concat(opened(t), escape(t["text"]), F.lit(TURN_END))).alias("parts"),
    )
    last = F.size("parts") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("is_target", i))
    rest = F.when(~F.get("is_target", last), F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    examples = written.select("*", F.posexplode(F.concat(targets, rest)).alias("example", "target_turn"))
    context = F.array_join(F.slice("parts", F.lit(1), F.coalesce("target_turn", F.size("parts"))), "")
    shown = examples.select(
        "conv_id",
        "example",
        "target_turn",
        F.concat(context, F.coalesce(F.get("heads", "target_turn"), F.lit(""))).alias("before"),
        F.coalesce(F.get("bodies", "target_turn"), F.lit("")).alias("reply"),
    )
    return shown.select(
        "conv_id",
        "example",
        "target_turn",
        F.concat("before", "reply", F.when(F.col("target_turn").isNotNull(), F.lit(TURN_END)).otherwise(F.lit(""))).alias("formatted"),
        F.char_length("before").alias("loss_start"),
        F.char_length("reply").alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) written in a formatted example."""
    lines = F.split(formatted, TURN_END, -1)
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)
    role_end = lambda line: F.instr(line, F.lit(": "))
    return F.transform(
        lines,
        lambda line: F.struct(
            unescape(F.substring(line, F.lit(5), role_end(line) - 5)).alias("role"),
            unescape(F.substring(line, role_end(line) + 2, F.char_length(line))).alias("text"),
        ),
    )


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return unescape(F.substring(formatted, start + 1, chars))


def digest_examples(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns and trained text as SHA-256 digests.

    The examples of a conversation still lie together after the expansion, so this groups them
    without another shuffle.
    """
    loss = trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    by = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("text")))).alias("trained"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    said = by.select("conv_id", "formatted_chars", read_turns(F.col("whole")).alias("said"), F.array_join("trained.text", "").alias("trained"))
    told = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )
