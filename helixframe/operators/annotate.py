"""Hits on genes, isoforms, and the choice of a read's annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import interval as I
from helixframe.functions import sequence as S
from helixframe.operators import regions

UNUSABLE = 999999


def annotate_hits(pairs: DataFrame, tech: int = 5) -> DataFrame:
    """Adds to overlapping hit-gene pairs: orientation, the hit's and the gene's coverage, score, and primary for the gene of least end of each hit."""
    hit = (F.col("start"), F.col("end"), F.col("g_start"), F.col("g_end"))
    gene = (F.col("g_start"), F.col("g_end"), F.col("start"), F.col("end"))
    order = Window.partitionBy("hit").orderBy("g_end", "gene")
    return pairs.withColumns(
        {
            "sense": F.col("strand") == F.col("g_strand"),
            "hit_coverage": F.round(I.coverage(*hit), 6),
            "gene_coverage": F.round(I.coverage(*gene), 6),
            "score": F.floor(I.overhang(*hit, F.col("g_strand") == "+", tech) / 10).cast("int"),
            "is_primary": F.row_number().over(order) == 1,
        }
    )


def annotation_name(gene_id: Column, gene_name: Column) -> Column:
    return F.coalesce(gene_name, gene_id, F.lit("non-transcriptome"))


def annotation_score(tag: Column, score: Column, hits: Column) -> Column:
    """Score of a hit by its isoform tag (">1>2>" lists exons, -1 a novel one), the less the better; 0 for the only hit of a read.

    The tags of spliced hits and of exons that several transcripts have count: by ten for each exon, less two for each novel one."""
    parts = lambda text, mark: F.filter(F.split(text, mark), lambda x: x != "")
    exons = F.greatest(F.size(parts(tag, ">")) - 2, F.lit(0))
    exons = F.when(exons == 0, F.lit(1)).otherwise(exons)
    weight = exons - 2 * (F.size(parts(F.coalesce(F.get(parts(tag, "="), F.lit(1)), F.lit("-")), "-")) - 1)
    scaled = F.when(weight >= 5, F.lit(0)).when(weight <= -5, F.lit(UNUSABLE)).otherwise(F.least(F.floor((score + 1) / F.pow(F.lit(10.0), weight)), F.lit(UNUSABLE)))
    return F.when(hits == 1, F.lit(0)).when(tag.rlike("fsm|ambiguous|novel"), scaled).otherwise(score).cast("int")


def read_annotation(hits: Column, occupied: Column, pos: Column, strand: Column, tech: int = 5, behind: bool = False) -> Column:
    """struct<annotation, transcript, score, breakpoints> of a read by its one adapter (place, strand) and its hits.

    hits: array<struct<start, end, orient, r_start, r_end, r_strand, gene_id, gene_name, transcript, score>> in order, occupied: the regions they cover.
    Hits count whose orientation is the adapter's (3' chemistry: the other one) and, where several regions are occupied, that lie in the nearest one
    ahead of the adapter (with behind, in that of least signed distance). One gives its gene; several that hardly overlap are a fusion, with
    breakpoints at the sides that face one another; else the least score gives the gene, if no other has it."""
    wanted = strand if tech == 5 else S.REVERSE - strand
    alone = F.size(hits) == 1
    forward, at = wanted == S.FORWARD, F.when(alone, pos - 1).otherwise(pos)
    region = regions.nearest_region(at, forward, occupied, behind)
    within = lambda h, r: (F.size(occupied) == 1) | F.coalesce((h["start"] >= r["start"]) & (h["end"] <= r["end"]), F.lit(False))
    text, whole = F.lit(None).cast("string"), F.lit(None).cast("int")
    none = F.array().cast("array<int>")

    def out(annotation: Column, transcript: Column = text, score: Column = whole, breakpoints: Column = none) -> Column:
        return F.struct(annotation.alias("annotation"), transcript.alias("transcript"), score.cast("int").alias("score"), breakpoints.alias("breakpoints"))

    def of_valid(valid: Column) -> Column:
        def points(h: Column, i: Column) -> Column:
            ahead = h["r_strand"] == h["orient"]
            entry, leave = F.when(ahead, h["r_start"]).otherwise(h["r_end"]), F.when(ahead, h["r_end"]).otherwise(h["r_start"])
            return F.when(i == 0, F.array(leave)).when(i == F.size(valid) - 1, F.array(entry)).otherwise(F.array(entry, leave))

        marked = F.transform(valid, lambda h: F.struct(annotation_score(h["transcript"], h["score"], F.size(hits)).alias("score"), annotation_name(h["gene_id"], h["gene_name"]).alias("gene"), h["transcript"].alias("transcript")))

        def of_marked(m: Column) -> Column:
            winners = F.filter(m, lambda x: x["score"] == F.array_min(F.transform(m, lambda y: y["score"])))
            fusion = F.concat(F.lit("Fusion: "), F.array_join(F.transform(m, lambda x: x["gene"]), "::"))
            first = lambda w: out(F.get(w, F.lit(0))["gene"], F.get(w, F.lit(0))["transcript"], F.get(w, F.lit(0))["score"])
            best = S.let(winners, lambda w: F.when(F.size(w) == 1, first(w)).otherwise(out(F.lit("Ambiguous_mapping"), score=F.lit(UNUSABLE))))
            return F.when((F.size(valid) > 1) & is_fusion(valid), out(fusion, breakpoints=F.flatten(F.transform(valid, points)))).otherwise(best)

        return F.when(F.size(valid) == 0, out(F.lit("Non-transcriptome"), score=F.lit(UNUSABLE))).otherwise(S.let(marked, of_marked))

    def of_region(r: Column) -> Column:
        outside = alone & (F.size(occupied) > 1) & ~F.coalesce(within(F.get(hits, F.lit(0)), r), F.lit(False))
        valid = F.filter(hits, lambda h: (h["orient"] == wanted) & within(h, r))
        return F.when(outside, out(F.lit("Odds0"))).otherwise(S.let(valid, of_valid))

    return F.when((F.size(hits) == 0) | (F.size(occupied) == 0), out(F.lit("Odds_x"))).otherwise(S.let(region, of_region))


def choose_feature(start: Column, end: Column, features: Column) -> Column:
    """Of features that share an end (array<struct<start, end, id>>) the one of which the hit leaves least uncovered, the first of equal ones."""
    left = F.transform(features, lambda f, i: F.struct((1 - I.coverage(f["start"], f["end"], start, end)).alias("left"), i.alias("i"), f["id"].alias("id")))
    return F.array_min(left)["id"]


def best_hit(hits: DataFrame) -> DataFrame:
    """id, gene, best of hits (id, gene, score): the gene of least score, or the name for several of that score."""
    least = hits.groupBy(F.col("id").alias("l_id")).agg(F.min("score").alias("best"))
    rows = hits.join(least, (F.col("id") == F.col("l_id")) & (F.col("score") == F.col("best")))
    found = rows.groupBy("id", "best").agg(F.count("*").alias("n"), F.min("gene").alias("gene"))
    return found.select("id", F.when(F.col("n") == 1, F.col("gene")).otherwise("Ambiguous_mapping").alias("gene"), "best")


def latest(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and its value in the row of greatest order; of rows of equal order the least value."""
    at = rows.groupBy(key, order).agg(F.min(value).alias(value))
    return at.groupBy(key).agg(F.max_by(value, order).alias(value))


def gene_models(exons: DataFrame) -> DataFrame:
    """gene, plus, and strict and loose models of each gene of exons (gene, plus, transcript, ordinal, start, end).

    A model is struct<exons: array<struct<key, id, start, end>> in order of midpoints, transcripts: array<struct<name, exons: array<id>>>>. Strict: rows of
    equal midpoint are one exon, with the place of the first. Loose: rows that overlap are one. Ids count from 0 in the order of first rows; a
    transcript's exons stand in the order of their rows."""
    rows = exons.withColumn("key", F.floor((F.col("start") + F.col("end")) / 2))
    same = Window.partitionBy("gene", "key").orderBy("ordinal", "start", "end")
    strict = rows.withColumns({"first": F.first("ordinal").over(same), "e_start": F.first("start").over(same), "e_end": F.first("end").over(same)})
    strict = strict.withColumn("id", F.dense_rank().over(Window.partitionBy("gene").orderBy("first")) - 1)
    order = Window.partitionBy("gene").orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = rows.withColumn("new", (upto.isNull() | (F.col("start") > upto)).cast("int")).withColumn("island", F.sum("new").over(order))
    own = Window.partitionBy("gene", "island")
    loose = island.withColumns({"first": F.min("ordinal").over(own), "e_start": F.min("start").over(own), "e_end": F.max("end").over(own)})
    loose = loose.withColumn("id", F.dense_rank().over(Window.partitionBy("gene").orderBy("first")) - 1).withColumn("key", F.floor((F.col("e_start") + F.col("e_end")) / 2))

    def model(df: DataFrame, name: str) -> DataFrame:
        ids = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"])
        lists = df.where(F.col("transcript").isNotNull()).groupBy("gene", "transcript").agg(ids.alias("exons"))
        lists = lists.groupBy(F.col("gene").alias("t_gene")).agg(F.sort_array(F.collect_list(F.struct(F.col("transcript").alias("name"), "exons"))).alias("transcripts"))
        one = F.struct(F.col("key").cast("int").alias("key"), F.col("id").cast("int").alias("id"), F.col("e_start").cast("int").alias("start"), F.col("e_end").cast("int").alias("end"))
        table = df.groupBy("gene", "plus").agg(F.sort_array(F.collect_set(one)).alias("exons"))
        both = table.join(lists, F.col("gene").eqNullSafe(F.col("t_gene")), "left")
        empty = F.array().cast("array<struct<name:string,exons:array<int>>>")
        return both.select(F.col("gene").alias(f"{name}_gene"), F.col("plus").alias(f"{name}_plus"), F.struct("exons", F.coalesce(F.col("transcripts").cast("array<struct<name:string,exons:array<int>>>"), empty).alias("transcripts")).alias(name))

    both = model(strict, "strict").join(model(loose, "loose"), F.col("strict_gene").eqNullSafe(F.col("loose_gene")))
    return both.select(F.col("strict_gene").alias("gene"), F.col("strict_plus").alias("plus"), "strict", "loose")


def exon_beside(segment: Column, exons: Column, least: float) -> Column:
    """The exon that a segment is held against: the first of midpoint not below its own, or, where that covers not more than least of it, the one before;
    null if there is none before."""
    middle = F.floor((segment["start"] + segment["end"]) / 2)
    both = F.struct(F.get(F.filter(exons, lambda x: x["key"] >= middle), F.lit(0)).alias("ahead"), F.try_element_at(F.filter(exons, lambda x: x["key"] < middle), F.lit(-1)).alias("back"))
    enough = lambda e: e.isNotNull() & (I.coverage(segment["start"], segment["end"], e["start"], e["end"]) > least)
    return S.let(both, lambda b: F.when(enough(b["ahead"]), b["ahead"]).otherwise(b["back"]))


def arranged(ids: Column) -> Column:
    return F.concat(F.lit(">"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ">"), F.lit(">"))


def isoform(segments: Column, spliced: Column, model: Column, plus: Column, gene: Column, least: float) -> Column:
    """Tag of a hit by the exons and transcripts of its gene: fsm/ism, ambiguous or novel for spliced hits; mono-exon_match, mono_exonic, ambiguous, novel
    or unspliced for others. least: the share that must cover, for spliced hits both ways."""
    exons, transcripts = model["exons"], model["transcripts"]

    covers = lambda a, b: I.coverage(a["start"], a["end"], b["start"], b["end"]) > least
    own = lambda s: S.let(exon_beside(s, exons, least), lambda e: F.when(e.isNotNull() & covers(s, e) & covers(e, s), e["id"]).otherwise(F.lit(-1)))
    tagged = lambda name, tag, body: F.concat(name, F.lit(f"({tag}="), body, F.lit(")"))
    name = lambda found: F.get(found, F.lit(0))["name"]

    def of_chain(ids: Column) -> Column:
        text = arranged(ids)
        found = F.filter(transcripts, lambda t: arranged(t["exons"]).contains(text))
        told = lambda x: F.when(F.size(x) == 0, tagged(gene, "novel", text)).when(F.size(x) == 1, tagged(name(x), "fsm/ism", text)).otherwise(tagged(gene, "ambiguous", text))
        return F.when(F.array_contains(ids, F.lit(-1)), tagged(gene, "novel", text)).otherwise(S.let(found, told))

    def of_exon(e: Column) -> Column:
        holders = F.filter(transcripts, lambda t: F.array_contains(t["exons"], e["id"]))
        number = e["id"].cast("string")
        told = lambda x: F.when(F.size(x) == 0, tagged(gene, "novel", number)).when(F.size(x) == 1, tagged(name(x), "mono_exonic", number)).otherwise(tagged(gene, "ambiguous", number))
        return F.when(e.isNotNull() & covers(segment, e), S.let(holders, told)).otherwise(F.concat(gene, F.lit("(unspliced)")))

    segment = F.get(segments, F.lit(0))
    ids = F.transform(segments, own)
    chain = S.let(F.when(plus, ids).otherwise(F.reverse(ids)), of_chain)
    only = F.concat(F.coalesce(name(transcripts), gene), F.lit("(mono-exon_match)"))
    return F.when(spliced, chain).when(F.size(exons) == 1, only).otherwise(S.let(exon_beside(segment, exons, least), of_exon))


def isoforms(hits: DataFrame, models: DataFrame, strict: float = 0.9) -> DataFrame:
    """Adds tag to hits (gene, segments: array<struct<start, end>>, spliced) by gene_models(): by the strict model first; tags that name something novel, and
    those without exons that aren't unspliced, are made anew by the loose model with any overlap, and end in a star. Null without a model."""
    side = models.select(F.col("gene").alias("m_gene"), "plus", "strict", "loose")
    rows = hits.join(side, F.col("gene") == F.col("m_gene"), "left")
    gene = F.col("gene").cast("string")
    first = isoform(F.col("segments"), F.col("spliced"), F.col("strict"), F.col("plus"), gene, strict)
    rows = S.once(rows, "first_tag", first)
    again = F.col("first_tag").contains("novel") | (~F.col("first_tag").contains(">") & ~F.col("first_tag").contains("unspliced"))
    second = F.concat(isoform(F.col("segments"), F.col("spliced"), F.col("loose"), F.col("plus"), gene, 0.0), F.lit("*"))
    return rows.withColumn("tag", F.when(again, second).otherwise(F.col("first_tag"))).drop("m_gene", "plus", "strict", "loose", "first_tag")


def isoform_tags(matched: DataFrame, transcripts: DataFrame) -> DataFrame:
    """hit, gene, tag of each hit by its segments' exons.

    matched: hit, gene, plus (strand of the gene), segment (number from 1), exon or null. transcripts: gene, transcript, exons (ids in order). A hit with
    an unmatched segment is novel; else the transcripts that contain its exons one after the other count: none novel, one fsm/ism, more ambiguous."""
    in_order = F.sort_array(F.collect_list(F.struct(F.when(F.col("plus"), F.col("segment")).otherwise(-F.col("segment")).alias("o"), F.coalesce("exon", F.lit(-1)).alias("x"))))
    hits = matched.groupBy("hit", "gene", "plus").agg(F.transform(in_order, lambda s: s["x"]).alias("exons"))
    text = F.concat(F.lit(">"), F.array_join(F.transform("exons", lambda x: x.cast("string")), ">"), F.lit(">"))
    hits = hits.withColumns({"text": text, "novel": F.array_contains("exons", -1)})
    lists = transcripts.select(F.col("gene").alias("t_gene"), "transcript", F.concat(F.lit(">"), F.array_join(F.transform("exons", lambda x: x.cast("string")), ">"), F.lit(">")).alias("t_text"))
    both = hits.join(lists, (hits.gene == lists.t_gene) & ~F.col("novel") & F.col("t_text").contains(F.col("text")), "left")
    found = both.groupBy("hit", "gene", "text", "novel").agg(F.count("transcript").alias("n"), F.min("transcript").alias("one"))
    name = F.when(F.col("n") == 1, F.concat("one", F.lit("(fsm/ism="), "text", F.lit(")")))
    return found.select("hit", "gene", name.otherwise(F.concat("gene", F.when(F.col("n") > 1, "(ambiguous=").otherwise("(novel="), "text", F.lit(")"))).alias("tag"))


def is_fusion(hits: Column, most: float = 0.4) -> Column:
    """Whether no two hits of array<struct<start, end>> cover more than most of each other on the read."""
    n = F.size(hits)

    def clash(a: Column, i: Column) -> Column:
        return F.exists(F.slice(hits, i + 2, n), lambda b: (I.coverage(a["start"], a["end"], b["start"], b["end"]) > most) | (I.coverage(b["start"], b["end"], a["start"], a["end"]) > most))

    return (n > 1) & ~F.exists(F.transform(hits, lambda a, i: clash(a, i)), lambda x: x)


def choose(hits: Column) -> Column:
    """Annotation of a read by its hits of the right orientation, array<struct<start, end, gene, score>> in order on the read."""
    best = F.array_min(F.transform(hits, lambda h: h["score"]))
    winners = F.filter(hits, lambda h: h["score"] == best)
    fusion = F.concat(F.lit("Fusion: "), F.array_join(F.transform(hits, lambda h: h["gene"]), "::"))
    return F.when(F.size(hits) == 0, "Non-transcriptome").when(F.size(hits) == 1, F.get(hits, F.lit(0))["gene"]).when(is_fusion(hits), fusion).when(F.size(winners) == 1, F.get(winners, F.lit(0))["gene"]).otherwise("Ambiguous_mapping")
