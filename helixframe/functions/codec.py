"""Text forms of nested values, and the parts of alignment strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "*"


def tokens(text: Column, separator: str) -> Column:
    """Parts that aren't empty."""
    return F.filter(F.split(text, "\\Q" + separator + "\\E"), lambda x: x != "")


def joined(values: Column, separator: str, ends: bool = False) -> Column:
    """Joined values, with the separator at both ends as well; the missing mark for none."""
    text = F.array_join(F.transform(values, lambda x: x.cast("string")), separator)
    text = F.concat(F.lit(separator), text, F.lit(separator)) if ends else text
    return F.when(F.size(values) == 0, F.lit(MISSING)).otherwise(text)


def regions_text(regions: Column) -> Column:
    """start-end, comma-separated."""
    return joined(F.transform(regions, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")


def regions(text: Column) -> Column:
    """array<struct<start,end>>; the missing mark and regions that aren't there give an empty array."""
    parts = F.filter(tokens(text, ","), lambda x: x.rlike("^\\d+-\\d+$"))
    return F.transform(parts, lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("start"), F.split(x, "-")[1].cast("int").alias("end")))


def signed_regions(text: Column) -> Column:
    """regions() of the layout that separates by semicolons; "-1--1" (nothing is free) and the missing mark give an empty array."""
    return regions(F.regexp_replace(text, ";", ","))


def coverages(text: Column) -> Column:
    """array<double>; negative ones are 0."""
    return F.transform(tokens(text, ","), lambda x: F.greatest(x.try_cast("double"), F.lit(0.0)))


def integers(text: Column) -> Column:
    """array<int>; also of the spliced flags."""
    return F.transform(tokens(text, ","), lambda x: x.try_cast("int"))


def hit_groups(text: Column) -> Column:
    """array<array<int>>: the groups of overlapping hits, groups apart by semicolons; the missing mark gives none."""
    return F.when(text == MISSING, F.array().cast("array<array<int>>")).otherwise(F.transform(tokens(text, ";"), integers))


def hit_groups_text(groups: Column) -> Column:
    return joined(F.transform(groups, lambda g: F.array_join(F.transform(g, lambda x: x.cast("string")), ",")), ";")


def adapter_text(hits: Column) -> Column:
    """places:strands:edits of array<struct<pos, strand, dist>>, each a list; the missing mark for none."""
    lists = [F.array_join(F.transform(hits, f), ",") for f in (lambda h: h["pos"].cast("string"), lambda h: strand_text(h["strand"]), lambda h: h["dist"].cast("string"))]
    return F.when(F.size(hits) == 0, F.lit(MISSING)).otherwise(F.concat_ws(":", *lists))


STRANDS = {0: "forward", 1: "reversed", 2: "complement", 3: "reverse", -1: MISSING}


def strand_text(code: Column) -> Column:
    out = F.lit(MISSING)
    for number, name in STRANDS.items():
        out = F.when(code == number, F.lit(name)).otherwise(out)
    return out


def strand_code(text: Column) -> Column:
    out = F.lit(-1)
    for number, name in STRANDS.items():
        out = F.when(text == name, F.lit(number)).otherwise(out)
    return out


def clip(cigar: Column, side: str) -> Column:
    """Clipped bases at the left or right end, -1 if there are none; a cigar of one operation has none."""
    found = F.regexp_extract(cigar, "^(\\d+)[SH]" if side == "left" else "(\\d+)[SH]$", 1)
    several = F.regexp_count(cigar, F.lit("[A-Z=]")) > 1
    return F.when(several & (found != ""), F.try_to_number(found, F.lit("9999999999")).cast("int")).otherwise(F.lit(-1))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n, op>>."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("\\d+[A-Z=]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "\\d+", 0).cast("int").alias("n"), F.regexp_extract(x, "[A-Z=]", 0).alias("op")))


def cigar_segments(cigar: Column, start: Column) -> Column:
    """Reference segments between the introns: array<struct<start,end>>, closed, from the 1-based start."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(start.cast("int").alias("from"), start.cast("int").alias("at"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        on = x["op"].isin("M", "D", "=", "X")
        gap = x["op"] == "N"
        segment = F.array(F.struct(s["from"].alias("start"), (s["at"] - 1).alias("end")))
        return F.struct(
            F.when(gap, s["at"] + x["n"]).otherwise(s["from"]).alias("from"),
            F.when(on | gap, s["at"] + x["n"]).otherwise(s["at"]).alias("at"),
            F.when(gap, F.concat(s["out"], segment)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(cigar_ops(cigar), state, step, lambda s: F.concat(s["out"], F.array(F.struct(s["from"].alias("start"), (s["at"] - 1).alias("end")))))


def query_span(cigar: Column) -> Column:
    """struct<start, end, length>: the aligned part of the read, 1-based, and the read's length with hard clips."""
    ops = cigar_ops(cigar)
    total = lambda kinds: F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0), lambda a, x: a + x["n"])
    left = F.greatest(clip(cigar, "left"), F.lit(0))
    return F.struct((left + 1).alias("start"), (left + total("MI=X")).alias("end"), total("MI=XSH").alias("length"))


def supplementary(tags: Column) -> Column:
    """struct<ref, pos, strand, cigar> of the first record of an SA tag."""
    at = lambda i: F.regexp_extract(tags, "SA:Z:([^,]+),([^,]+),([^,]+),([^,]+),", i)
    return F.when(tags.contains("SA:Z:"), F.struct(at(1).alias("ref"), F.try_to_number(at(2), F.lit("9999999999")).cast("int").alias("pos"), at(3).alias("strand"), at(4).alias("cigar")))
