"""Line deduplication with DataFrame expressions only.

Texts are split at line feeds and exploded; a line's key is the line without
white space at its ends, A-Z in lower case, and is known by 128 bits of
hashes.  An aggregation that combines before its shuffle finds the keys of
several documents and the smallest document that holds each.  Lines of such
keys in other documents are dropped: a join on the hash gives their
positions, which are gathered for each document, and the document's other
lines are joined again in their order.

The table of repeated keys and the table of positions are written, so both
joins have a plain shuffle on either side, and adaptive execution splits a
key that a great part of all lines share.  Texts themselves move once, to
meet their positions.

Defined results: a null or empty text is one empty line; keys shorter than
``least_chars`` code points stay; a document is known by its identifier, so
rows that share one count as one document, and each row keeps or drops lines
of its own text; a null identifier is one document, greater than all others;
of repeated lines within the smallest document all stay; an empty table gives
no rows.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm._shared import free_name, packed, passing, stage, unpacked

#: What is stripped at a line's ends: tab to carriage return, and blank.
ENDS = "\t\n\x0b\x0c\r "


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(ENDS))


def folded(key: Column) -> Column:
    """A text that two keys share if and only if they are equal after lower-casing A-Z.

    The bytes are read as Latin-1 characters, of which lower-casing moves
    A-Z and the bytes C0 to DE (not D7) by 32.  Lead bytes C2 to DF of two-byte
    sequences thereby become E2 to FF, but the continuation bytes that follow
    a lead still tell which length it had, so no two valid texts meet.
    """
    return F.lower(F.decode(key.cast("binary"), "ISO-8859-1"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, text and a name of the text: rows of one identifier and text have equal lines."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(packed(docs).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.md5(text.cast("binary")).alias("name"), text.alias("text"))


def _keys(rows: DataFrame, least_chars: int) -> DataFrame:
    """id, name, pos and hashes (h, g) of each line whose key is long enough."""
    lines = rows.select("id", "name", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("id", "name", "pos", line_key(F.col("line")).alias("key"))
    low = lines.where(F.length("key") >= least_chars).select("id", "name", "pos", folded(F.col("key")).alias("low"))
    return low.select("id", "name", "pos", F.xxhash64("low").alias("h"), F.xxhash64(F.lit(1), "low").alias("g"))


def repeated(keys: DataFrame, least_docs: int) -> DataFrame:
    """(h, g, keeper): the keys of ``least_docs`` documents or more, and the smallest document (null only if it has no identifier)."""
    if least_docs <= 2:
        # two documents at least: the smallest and the largest identifier differ, a null one being larger than all
        seen = keys.groupBy("h", "g").agg(F.min("id").alias("keeper"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("nil"))
        return seen.where((F.col("keeper") < F.col("last")) | (F.col("nil") & F.col("keeper").isNotNull()) if least_docs == 2 else F.lit(True)).select("h", "g", "keeper")
    each = keys.groupBy("h", "g", "id").agg(F.lit(1).alias("one"))
    return each.groupBy("h", "g").agg(F.min("id").alias("keeper"), F.count("one").alias("docs")).where(F.col("docs") >= least_docs).select("h", "g", "keeper")


def _kept(lines: Column, dropped: Column) -> Column:
    """The lines whose positions are not among ``dropped``, in time in proportion to both.

    The places that stay (1 to n without the dropped ones) are spelled as a
    string of 0 and 1, one for each line, and split into flags.
    """
    n = F.size(lines)
    stays = F.array_except(F.sequence(F.lit(1), n), F.transform(dropped, lambda p: p + 1))
    before = F.concat(F.array(F.lit(0)), stays)
    flags = F.zip_with(stays, before, lambda p, b: F.when(p.isNull(), F.repeat(F.lit("0"), n - b)).otherwise(F.concat(F.repeat(F.lit("0"), p - b - 1), F.lit("1"))))
    pairs = F.arrays_zip(lines.alias("line"), F.split(F.array_join(flags, ""), "").alias("stays"))
    return F.transform(F.filter(pairs, lambda x: x["stays"] == "1"), lambda x: x["line"])


def drop_repeated_lines(docs: DataFrame, least_docs: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped (long) and kept_text, the lines that stay joined by line feeds.

    A column of the caller that has one of these names gets an underscore
    behind it.  The result reads written tables, which last as long as the application.
    """
    if least_docs < 1 or least_chars < 0:
        raise ValueError("least_docs must be 1 at least, least_chars 0")
    rows = _rows(docs, id_col, text_col)
    keys = _keys(rows, least_chars)
    with passing(docs.sparkSession):
        again = stage(repeated(keys, least_docs), "repeated-lines")
        here = F.col("id").isNull() & F.col("keeper").isNull() | F.coalesce(F.col("id") == F.col("keeper"), F.lit(False))
        hits = keys.join(again, ["h", "g"]).where(~here)
        gone = stage(hits.groupBy("id", "name").agg(F.collect_set("pos").alias("gone")), "dropped-lines", lasting=True)
    same = F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.name") == F.col("g.name"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    met = rows.select("row", "id", "name").alias("d").join(gone.alias("g"), same, "left")
    met = met.select("row", F.split(text, "\n", -1).alias("lines"), F.coalesce("gone", F.expr("array()").cast("array<int>")).alias("gone"))
    own = ["n_lines", "n_dropped", "kept_text"]
    kept = F.array_join(F.when(F.size("gone") == 0, F.col("lines")).otherwise(_kept(F.col("lines"), F.col("gone"))), "\n")
    out = met.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept_text"))
    names = [free_name(c, own + [x for x in docs.columns if x != c]) if c.lower() in own else c for c in docs.columns]
    return out.select(*[c.alias(n) for c, n in zip(unpacked(docs), names, strict=True)], *own)
