"""Chat formatting with a checked grammar: render turns, parse them back, escape until both agree.

Grammar of the output:  conversation := turn*   turn := "### " ROLE ": " TEXT "</turn>" NEWLINE
where neither ROLE nor TEXT holds "###" or "</turn>". The parser splits at "</turn>\\n", takes what stands
between "### " and the first ": " as the role, refuses a turn with a control string inside, and always
unescapes role and text. Escapes replace a control string, so escaped content holds none: \\\\ for \\,
\\h for "###", \\e for "</turn>", \\n for a newline, \\c for ":". A turn is rendered raw first; if parsing the
render doesn't give it back it is rendered escaped; a whole conversation that still differs is rendered with
every turn escaped, which can't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.similarity import bind

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    """Escaped text: holds no control string, and unescape() gives the original back."""
    for old, new in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e")):
        c = _swap(c, old, new)
    return c


def escape_role(c: Column) -> Column:
    return _swap(_swap(escape(c), ":", "\\c"), "\n", "\\n")


def unescape(c: Column) -> Column:
    """Inverse of escape() and escape_role(): pairs of backslashes are read from the left, the parts between hold the other escapes."""

    def part(x: Column) -> Column:
        for old, new in (("\\h", "###"), ("\\e", "</turn>"), ("\\c", ":"), ("\\n", "\n")):
            x = _swap(x, old, new)
        return x

    # most texts hold no backslash, and so no escape
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")).otherwise(c)


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """Turns of a rendered conversation: array of (role, text, size), size being the code points of the text as rendered."""
    parts = F.split(rendered, "</turn>\n", -1)
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    # each step is bound, so that it is worked out once a turn however often the next one names it
    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        return bind(F.when(part.startswith(OPEN), body), whole)

    def whole(body: Column) -> Column:
        cut = F.when(~F.contains(body, F.lit("###")) & ~F.contains(body, F.lit("</turn>")), F.instr(body, MIDDLE))
        return bind(F.struct(body.alias("body"), F.when(cut > 0, cut).alias("cut")), split)

    def split(x: Column) -> Column:
        role, raw = F.substring(x.body, F.lit(1), x.cut - 1), F.substring(x.body, x.cut + len(MIDDLE), F.length(x.body))
        return bind(raw, lambda r: F.struct(unescape(role).alias("role"), unescape(r).alias("text"), F.length(r).alias("size")))

    return F.transform(parts, turn)


def format_chats(chats: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: (id_col, formatted string, turns array<struct<role, text, start, size>>, escaped int, identical boolean).

    turns are read back from formatted: start (from 1) and size give a text's code points in it, so those of
    loss_role are the loss mask. escaped counts turns rendered with escapes. Rows go by turn (nulls first),
    ties by role and text; null role or text counts as empty; a null conversation id is a conversation of its own;
    repeated rows are turns each. A conversation is one training example and is assembled in one task; its
    turns are rendered and checked as rows before that. An empty table gives no rows; other columns are ignored.
    """
    rows = chats.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    raw, safe = render(F.col("role"), F.col("text")), render(escape_role(F.col("role")), escape(F.col("text")))
    rows = rows.withColumn("raw", raw).withColumn("back", parse(F.col("raw")))
    same = (F.size("back") == 1) & F.coalesce((F.col("back")[0]["role"] == F.col("role")) & (F.col("back")[0]["text"] == F.col("text")), F.lit(False))
    role_out, role_safe = F.when(same, F.col("role")).otherwise(escape_role(F.col("role"))), escape_role(F.col("role"))
    rows = rows.select("id", "turn", "role", "text", F.when(same, F.col("raw")).otherwise(safe).alias("out"), safe.alias("safe"), (~same).cast("int").alias("esc"), F.length(role_out).alias("r_out"), F.length(role_safe).alias("r_safe"))
    # where each turn's text starts: running sums over the rows, so that a conversation costs time in proportion to its turns
    before = Window.partitionBy("id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda out, role: F.coalesce(F.sum(F.length(out)).over(before), F.lit(0)) + F.col(role) + len(OPEN) + len(MIDDLE) + 1
    rows = rows.select("id", "turn", "role", "text", "out", "safe", "esc", start("out", "r_out").alias("s_out"), start("safe", "r_safe").alias("s_safe"))
    whole = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "out", "safe", "esc", "s_out", "s_safe"))).alias("t"))
    each = lambda name: F.transform("t", lambda x: x[name])
    source = F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    plain = lambda c: F.transform(c, lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    first = whole.select("id", "t", source.alias("source"), F.array_join(each("out"), "").alias("formatted"))
    first = first.withColumn("turns", parse(F.col("formatted")))
    first = first.withColumn("good", plain(F.col("turns")) == F.col("source"))
    good = F.col("good")
    final = first.select(
        "id",
        "source",
        F.when(good, F.col("formatted")).otherwise(F.array_join(each("safe"), "")).alias("formatted"),
        F.when(good, F.col("turns")).alias("turns"),
        F.when(good, each("s_out")).otherwise(each("s_safe")).alias("starts"),
        F.when(good, F.aggregate("t", F.lit(0), lambda a, x: a + x.esc)).otherwise(F.size("t")).alias("escaped"),
    )
    final = final.withColumn("turns", F.coalesce("turns", parse(F.col("formatted"))))
    # zipped, not looked up: an array named inside the function would be worked out again for every turn
    turns = F.transform(F.arrays_zip("turns", "starts"), lambda z: F.struct(z.turns.role.alias("role"), z.turns.text.alias("text"), z.starts.cast("int").alias("start"), z.turns["size"].alias("size")))
    return final.select(F.col("id").alias(id_col), "formatted", turns.alias("turns"), "escaped", (plain(F.col("turns")) == F.col("source")).alias("identical"))


def digests(formatted: DataFrame, id_col: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """Figures read back from format_chats() output: turns, hashes and the loss mask's text.

    turns are the parse of formatted, so a marked turn's text is what its span there holds, unescaped. Cutting the spans
    out one by one would read a conversation once for every turn.
    """
    marked = F.filter("turns", lambda x: x.role == loss_role)
    loss = F.array_join(F.transform(marked, lambda x: x.text), "")
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return formatted.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


