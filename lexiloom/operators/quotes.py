"""Quotation marks: their role on a line, and findings that follow from roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Marks, by shape; characters that an opening mark may follow, and that part a phrase.
OPENING, CLOSING, STRAIGHT = "“‘", "”’", "\"'"
DOUBLE = "“”\""


def quote_roles(lines: DataFrame) -> DataFrame:
    """By mark of a line: doc_id, line_no, i (from 0), pos, mark, before, after, role, partner.

    Roles are open, close, apostrophe (between letters), open_orphan and close_orphan. A shaped mark says itself whether
    it opens; a straight one opens after a space, an opening bracket or nothing if something other than a space follows.
    A mark closes the innermost open one if that is of the same kind, double or single. A line's marks are folded in
    one row, with the open marks as a stack. Null and empty lines have no marks.
    """
    folded = _folded(lines)
    flat = folded.select("doc_id", "line_no", "fold", F.explode("seen").alias("x"))
    partner = F.expr("coalesce(get(filter(fold.pairs, p -> p.o = x.i), 0).c, get(filter(fold.pairs, p -> p.c = x.i), 0).o)")
    role = F.expr("case when array_contains(fold.inside, x.i) then 'apostrophe' when array_contains(fold.alone, x.i) then 'close_orphan' when exists(fold.pairs, p -> p.o = x.i) then 'open' when exists(fold.pairs, p -> p.c = x.i) then 'close' else 'open_orphan' end")
    return flat.select("doc_id", "line_no", "x.i", "x.pos", "x.mark", "x.before", "x.after", role.alias("role"), partner.alias("partner"))


def _folded(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, text, seen (the marks with their surroundings) and fold (open, pairs, alone, inside) of the lines with marks."""
    marks = f"[{OPENING}{CLOSING}\"']"
    parts = lines.select("doc_id", "line_no", "text", F.regexp_extract_all("text", F.lit(f"({marks})"), F.lit(1)).alias("marks"), F.split("text", marks, -1).alias("parts")).where("size(marks) > 0")
    each = "named_struct('i', i, 'mark', m, 'before', right(parts[i], 1), 'after', left(parts[i + 1], 1), 'pos', length(array_join(slice(parts, 1, i + 1), '')) + i)"
    seen = parts.withColumn("seen", F.expr(f"transform(marks, (m, i) -> {each})"))
    start = F.expr("named_struct('open', cast(array() as array<struct<i:int,double:boolean>>), 'pairs', cast(array() as array<struct<o:int,c:int>>), 'alone', cast(array() as array<int>), 'inside', cast(array() as array<int>))")

    def step(s, x):
        double = F.lit(DOUBLE).contains(x["mark"])
        inside = ~double & ~F.lit(OPENING).contains(x["mark"]) & x["before"].rlike(r"\p{L}") & x["after"].rlike(r"\p{L}")
        opens = F.lit(OPENING).contains(x["mark"]) | (F.lit(STRAIGHT).contains(x["mark"]) & x["before"].rlike(r"^[\s(\[{=]?$") & x["after"].rlike(r"\S"))
        top = F.get(s["open"], F.size(s["open"]) - 1)
        closes = ~inside & ~opens & F.coalesce(top["double"] == double, F.lit(False))
        shut = F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        return F.struct(
            F.when(~inside & opens, F.concat(s["open"], F.array(F.struct(x["i"].alias("i"), double.alias("double"))))).when(closes, shut).otherwise(s["open"]).alias("open"),
            F.when(closes, F.concat(s["pairs"], F.array(F.struct(top["i"].alias("o"), x["i"].alias("c"))))).otherwise(s["pairs"]).alias("pairs"),
            F.when(~inside & ~opens & ~closes, F.concat(s["alone"], F.array(x["i"]))).otherwise(s["alone"]).alias("alone"),
            F.when(inside, F.concat(s["inside"], F.array(x["i"]))).otherwise(s["inside"]).alias("inside"),
        )

    return seen.withColumn("fold", F.aggregate("seen", start, step)).select("doc_id", "line_no", "text", "seen", "fold")


def _with_text(roles: DataFrame, lines: DataFrame) -> DataFrame:
    return roles.join(lines.select("doc_id", "line_no", "text"), ["doc_id", "line_no"])


def unpaired_quotes(roles: DataFrame, lines: DataFrame) -> DataFrame:
    """Closing marks without a partner, with an opening one set before the run of words that they follow."""
    alone = _with_text(roles.where("role = 'close_orphan'"), lines).withColumn("run", F.regexp_extract(F.expr("substring(text, 1, pos)"), r"[\p{L}\p{N}]+(?: [\p{L}\p{N}]+)*$", 0)).where("run <> ''")
    opening = F.translate("mark", CLOSING, OPENING)
    return alone.select("doc_id", "line_no", "pos", F.concat("run", "mark").alias("original"), F.concat(opening, "run", "mark").alias("corrected"))


def reversed_quotes(roles: DataFrame, lines: DataFrame) -> DataFrame:
    """A lone closing-shaped mark and the lone opening-shaped one that follows it on the line: both turned round."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("i")
    alone = roles.where("role in ('close_orphan', 'open_orphan')")
    both = alone.withColumn("next_role", F.lead("role").over(w)).withColumn("next_mark", F.lead("mark").over(w)).withColumn("next_pos", F.lead("pos").over(w))
    turned = both.where((F.col("role") == "close_orphan") & (F.col("next_role") == "open_orphan") & F.concat("mark", "next_mark").isin("”“", "’‘"))
    inner = F.expr("substring(text, pos + 2, next_pos - pos - 1)")
    found = _with_text(turned, lines).withColumn("inner", inner)
    return found.select("doc_id", "line_no", "pos", F.concat("mark", "inner", "next_mark").alias("original"), F.concat("next_mark", "inner", "mark").alias("corrected"))


def quote_punct_spacing(roles: DataFrame) -> DataFrame:
    """A space is missing between a sentence mark and an opening quotation mark, or one follows an opening mark."""
    o = roles.where("role = 'open'")
    missing = o.where(F.col("before").rlike("[.,!?;:]")).select("doc_id", "line_no", "pos", F.concat("before", "mark").alias("original"), F.concat_ws(" ", "before", "mark").alias("corrected"))
    extra = o.where("after = ' '").select("doc_id", "line_no", "pos", F.concat("mark", "after").alias("original"), F.col("mark").alias("corrected"))
    return missing.unionByName(extra)


def quote_spacing(roles: DataFrame, lines: DataFrame, most: int = 40) -> DataFrame:
    """A space is missing between a word and an opening mark whose content has 1 to ``most`` characters with a letter."""
    w = Window.partitionBy("doc_id", "line_no").orderBy("i")
    ends = roles.select("doc_id", "line_no", F.col("i").alias("partner"), F.col("pos").alias("end"))
    o = _with_text(roles.where((F.col("role") == "open") & F.col("before").rlike(r"[\p{L}\p{N}]")), lines).join(ends, ["doc_id", "line_no", "partner"])
    content = F.expr("substring(text, pos + 2, end - pos - 1)")
    good = o.withColumn("content", content).where(F.length("content").between(1, most) & F.col("content").rlike(r"\p{L}"))
    return good.withColumn("n", F.row_number().over(w)).select("doc_id", "line_no", "pos", F.concat("before", "mark").alias("original"), F.concat_ws(" ", "before", "mark").alias("corrected"))


def quote_spacing_in(lines: DataFrame, most: int = 40) -> DataFrame:
    """``quote_spacing`` of ``lines``, each judged in its row.

    After a letter or digit only a shaped mark opens, so lines without one there hold no finding and are not folded.
    """
    shaped = F.contains("text", F.lit(OPENING[0])) | F.contains("text", F.lit(OPENING[1]))
    may = lines.where(shaped).where(F.col("text").rlike(rf"[\p{{L}}\p{{N}}][{OPENING}]"))
    pairs = _folded(may).select("doc_id", "line_no", "text", F.expr("explode(transform(fold.pairs, p -> struct(seen[p.o] as o, seen[p.c].pos as end)))").alias("p"))
    pairs = pairs.select("doc_id", "line_no", "p.o.pos", "p.o.before", "p.o.mark", F.expr("substring(text, p.o.pos + 2, p.end - p.o.pos - 1)").alias("content"))
    good = pairs.where(F.col("before").rlike(r"[\p{L}\p{N}]") & F.length("content").between(1, most) & F.col("content").rlike(r"\p{L}"))
    return good.select("doc_id", "line_no", "pos", F.concat("before", "mark").alias("original"), F.concat_ws(" ", "before", "mark").alias("corrected"))
