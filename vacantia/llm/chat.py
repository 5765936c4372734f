"""Chat formatting with a grammar round trip, in DataFrame functions only.

The template renders a turn as ``<s>role\\ntext</s>\\n``.  The grammar that reads it back
is deterministic: turns end at ``</s>\\n``, a turn starts with ``<s>``, the role ends at
the first line feed, and neither mark may occur inside.  Each turn is first rendered as
it is and parsed again; where the recovered turn is not identical to the source, role
and text are escaped (a ``~`` goes in after the ``<`` of every mark, and of every mark
that already has some) and it is rendered again.  Whole conversations are then parsed
and compared once more; if one still differed, all its turns would be escaped.  Escaping
never touches a text without conflict, and unescaping takes exactly one ``~`` back.

Turns are escaped where they are read; one shuffle by conversation puts them in order.
A conversation becomes one string and so has to meet in one task: its length is bounded
by what a string can hold, not by the number of rows that other conversations have.

Defined results: null roles and texts count as empty; rows with a null conversation id
form one conversation; turns are ordered by number (nulls first), then role, then text,
so repeated rows stay, side by side; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
OPEN, CLOSE, LINE = "<s>", "</s>", "<n>"
MARK, MARKED = r"<(~*)(/s|s|n)>", r"<~(~*)(/s|s|n)>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARK, "<~$1$2>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, "<$1$2>")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def parsed(formatted: Column) -> Column:
    """Turns as structs of role and text; both null where the grammar is broken."""

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        head = F.substring_index(body, "\n", 1)
        sound = piece.startswith(OPEN) & ~body.contains(OPEN) & ~body.contains(CLOSE) & body.contains("\n")
        role = unescaped(F.replace(head, F.lit(LINE), F.lit("\n")))
        text = unescaped(F.substr(body, F.length(head) + 2))
        return F.struct(F.when(sound, role).alias("role"), F.when(sound, text).alias("text"))

    pieces = F.split(formatted, CLOSE + "\n", -1)
    closed = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    open_end = F.element_at(pieces, -1) != ""
    none = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return F.concat(F.transform(closed, turn), F.when(open_end, F.array(none)).otherwise(F.slice(F.array(none), 1, 0)))


def _spans(rows: Column) -> Column:
    """Where the texts of ``rows`` (structs of role, shown_role, shown) stand, by adding up lengths."""
    ahead = lambda size, r: size(r["shown_role"]) + len(OPEN) + 1
    whole = lambda size, r: size(rendered(r["shown_role"], r["shown"]))

    def place(done: Column, r: Column) -> Column:
        start, first = done["end"] + ahead(F.length, r), done["last"] + ahead(F.octet_length, r)
        span = F.struct(
            r["role"].alias("role"), start.cast("long").alias("start"), (start + F.length(r["shown"])).cast("long").alias("end"),
            first.cast("long").alias("first_byte"), (first + F.octet_length(r["shown"])).cast("long").alias("end_byte"),
        )
        return F.struct((done["end"] + whole(F.length, r)).alias("end"), (done["last"] + whole(F.octet_length, r)).alias("last"), F.concat(done["spans"], F.array(span)).alias("spans"))

    none = F.array().cast("array<struct<role:string,start:bigint,end:bigint,first_byte:bigint,end_byte:bigint>>")
    zero = F.lit(0).cast("long")
    return F.aggregate(rows, F.struct(zero.alias("end"), zero.alias("last"), none.alias("spans")), place)["spans"]


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns array<struct<role, text>>, loss array<struct<start, end, first_byte, end_byte>>, exact``.

    ``turns`` is what the parser recovers from ``formatted``, ``exact`` whether that is
    the source, ``loss`` the spans of the assistant's texts in ``formatted``, by code
    points and by bytes of UTF-8.
    """
    source = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    plain = parsed(rendered(F.col("role"), F.col("text")))
    clean = plain == F.array(F.struct("role", "text"))
    rows = source.withColumn("clean", clean).select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("clean"), F.col("role")).otherwise(escaped_role(F.col("role"))).alias("shown_role"),
        F.when(F.col("clean"), F.col("text")).otherwise(escaped(F.col("text"))).alias("shown"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    chars, octets = (f(rendered(F.col("shown_role"), F.col("shown"))).cast("long") for f in (F.length, F.octet_length))
    placed = rows.select(
        "*", F.row_number().over(order).alias("place"), (F.sum(chars).over(upto) - chars).alias("before"), (F.sum(octets).over(upto) - octets).alias("before_bytes"),
    )
    start = F.col("before") + len(OPEN) + F.length("shown_role") + 1
    first = F.col("before_bytes") + len(OPEN) + F.octet_length("shown_role") + 1
    grouped = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "place", "role", "text", "shown_role", "shown", start.alias("start"), (start + F.length("shown")).alias("end"),
            first.alias("first_byte"), (first + F.octet_length("shown")).alias("end_byte"),
        ))).alias("rows")
    )
    all_of = lambda role, text: F.array_join(F.transform("rows", lambda r: rendered(role(r), text(r))), "")
    once = grouped.select(
        "conv_id", "rows", all_of(lambda r: r["shown_role"], lambda r: r["shown"]).alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
    ).withColumn("turns", parsed(F.col("formatted")))
    # never needed for what the turns' own round trips have passed; kept as the grammar's last word
    again = F.col("turns") != F.col("source")
    anew = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), escaped_role(r["role"]).alias("shown_role"), escaped(r["text"]).alias("shown")))
    places = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("role", "start", "end", "first_byte", "end_byte")]))
    whole = once.withColumn("formatted", F.when(again, all_of(lambda r: escaped_role(r["role"]), lambda r: escaped(r["text"]))).otherwise(F.col("formatted")))
    spans = F.filter(F.when(again, _spans(anew)).otherwise(places), lambda r: r["role"] == "assistant")
    return whole.select(
        "conv_id", "formatted",
        F.when(again, parsed(F.col("formatted"))).otherwise(F.col("turns")).alias("turns"),
        F.transform(spans, lambda r: F.struct(*[r[c].alias(c) for c in ("start", "end", "first_byte", "end_byte")])).alias("loss"), "source",
    ).select("conv_id", "formatted", "turns", "loss", (F.col("turns") == F.col("source")).alias("exact"))


def under_mask(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; each span is cut out by its bytes."""
    octets = formatted.cast("binary")
    cut = lambda s: F.substring(octets, (s["first_byte"] + 1).cast("int"), (s["end_byte"] - s["first_byte"]).cast("int"))
    return F.array_join(F.transform(loss, lambda s: unescaped(cut(s).cast("string"))), "")
