"""Near duplicates by SimHash and multi-index hashing.

A document's fingerprint has a bit for each bit that is set in over half of its shingles' hashes. Equal fingerprints are one. Each different one is
split into segments, and each segment is a table: a fingerprint stands there once, under the segment's bits. Fingerprints within RADIUS bits of each
other differ in some segment by RADIUS / SEGMENTS bits at most, so each one enumerates the Hamming ball of that radius within each of its segments,
fetches what the table has there, and verifies the complete distance. Groups are the connected components of these links.

Few fingerprints share a segment's 32 bits by chance, but near copies may. A table entry with over HOT fingerprints is split by the other segments' bits:
each fingerprint stands there under the ball of radius 1 around them, and is asked for by what is left of the distance. As two of an entry's part agree
with its bits but for one, no part has more than BITS - BITS / SEGMENTS + 1 fingerprints, whatever the data, and no pair within RADIUS is lost.

Null texts count as empty; texts without words have fingerprint zero. Repeated rows are members as often as they stand there. Null ids never name a
group that has others. Extra columns pass through keep_one(). An empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import discard, free, fresh, light, materialise, slices, sorted_join, texts, tidy, utf8
from helixframe.llm.components import components

BITS, SEGMENTS, RADIUS, HOT = 64, 2, 2, 512
SEED = 42
STEP = 1 << 16


def shingle_hashes(words: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of width words, joined by blanks; of the whole sequence if it is shorter. At least one word."""
    n = len(words)
    joined = memoryview(b" ".join(words))
    length = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(length + 1) - 1
    first, last = ((ends - length)[: n - width + 1].tolist(), ends[width - 1 :].tolist()) if n >= width else ([0], [len(joined)])
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, first, last)), repeat(seed)), np.uint64, len(last))


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """Of a text in UTF-8; only A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    found = shingle_hashes(words, width, seed)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(found), STEP):
        votes += np.unpackbits(found[i : i + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(found)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text_col: str, out: str, keep: list[str], width: int = 3) -> DataFrame:
    """keep, and the fingerprint as signed long."""
    light(df.sparkSession)
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(fresh(df, "text_of_shingles")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, width) for x in utf8(b.column(b.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], [*keep, out])

    fields = df.select(*(F.col(f"`{c}`") for c in keep)).withColumn(out, F.lit(0).cast("long")).schema
    return rows.mapInArrow(tidy(run), fields)


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ball(mask: int, radius: int) -> F.Column:
    """All changes of so many bits of the mask at most, as signed longs."""
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    return F.array(*(F.lit(signed(sum(c))).cast("long") for r in range(radius + 1) for c in combinations(bits, r)))


def links(prints: DataFrame, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """src, dst: the pairs within RADIUS bits of each other, the larger first. prints: different fingerprints fp."""
    size = BITS // segments
    masks = [((1 << size) - 1) << (s * size) for s in range(segments)]
    fp = F.col("fp")

    def each(make):
        frames = [make(s, m, prints.withColumn("segment", F.lit(s).cast("byte"))) for s, m in enumerate(masks)]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    table = each(lambda s, m, p: p.select("fp", "segment", fp.bitwiseAND(F.lit(signed(m))).alias("key")))
    probes = each(lambda s, m, p: p.select("fp", "segment", F.explode(ball(m, RADIUS // segments)).alias("e")).select("fp", "segment", fp.bitwiseAND(F.lit(signed(m))).bitwiseXOR(F.col("e")).alias("key"), F.bit_count("e").alias("d")))
    full = materialise(table.groupBy("segment", "key").count().where(F.col("count") > hot).select("segment", "key"), "full-entries")
    if full.isEmpty():
        return fetched(table, probes, ["segment", "key"]).distinct()
    place = ["segment", "key"]
    found = fetched(table.join(full, place, "left_anti"), probes.join(full, place, "left_anti"), place)
    table, probes = table.join(full, place, "left_semi"), probes.join(full, place, "left_semi")
    for s, m in enumerate(masks):  # the other segments' bits: one may be changed on the table's side, what is left of the radius on the other
        others = ((1 << BITS) - 1) ^ m
        rest = fp.bitwiseAND(F.lit(signed(others)))
        own = F.col("segment") == s
        parts = table.where(own).withColumn("e", F.explode(ball(others, 1))).select("fp", "key", rest.bitwiseXOR(F.col("e")).alias("part"))
        left = F.when(F.col("d") <= RADIUS - 2, ball(others, 1)).otherwise(ball(others, 0))
        asked = probes.where(own).withColumn("e", F.explode(left)).select("fp", "key", rest.bitwiseXOR(F.col("e")).alias("part"))
        found = found.union(fetched(parts, asked, ["key", "part"]))
    return found.distinct()


def fetched(table: DataFrame, probes: DataFrame, place: list[str]) -> DataFrame:
    """src, dst: what probes (fp and place) find in the table, verified on all bits."""
    there = table.select(F.col("fp").alias("dst"), *(F.col(c).alias(f"t_{c}") for c in place))
    same = [F.col(c) == F.col(f"t_{c}") for c in place]
    near = (F.col("fp") > F.col("dst")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("dst"))) <= RADIUS)
    return probes.join(there.hint("merge"), [*same, near]).select(F.col("fp").alias("src"), "dst")


def groups(rows: DataFrame) -> DataFrame:
    """fp, label: the group of each different fingerprint of rows, named by its least fingerprint."""
    prints = materialise(rows.select("fp").distinct(), "fingerprints")
    near = materialise(links(prints), "fingerprint-links")
    free(rows.sparkSession)
    joined = components(near)
    discard(near)
    return sorted_join(prints, joined, "fp", "node", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the group) of each document."""
    rows = materialise(with_fingerprint(texts(docs), "text", "fp", ["doc_id"], width), "document-fingerprints")
    named = materialise(groups(rows), "fingerprint-groups")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumnRenamed("fp", "r_fp")
    ids = sorted_join(named, least, "fp", "r_fp").groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "i_label")
    by_print = sorted_join(named, ids, "label", "i_label").select(F.col("fp").alias("p_fp"), "component_id")
    return sorted_join(rows, by_print, "fp", "p_fp").select("doc_id", "fp", "component_id")


#: For similarity: classes in which shingles are counted for their order; members of each key that the others meet first, round by round (LEADERS); how
#: many of them count in the first round (NAMED); members that a label must have for them to be met in later rounds (MANY); members of a key in a block,
#: when all are compared.
CLASSES, LEADERS, NAMED, MANY, BLOCK = 1 << 16, (2, 40), 2, 8, 1000
#: Words of a wide fingerprint, and the bits by which two may differ that are compared in full. Sets with a similarity of 0.8 differ in 39 of 256 bits,
#: with a standard deviation of 6, and in 48 if they are very small; 96 is beyond seven deviations.
WIDE, FAR = 4, 96


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The different shingle hashes of a text in UTF-8, ascending."""
    words = text.lower().split()
    return np.unique(shingle_hashes(words, width)) if words else np.zeros(0, np.uint64)


def class_counts(df: DataFrame, text_col: str, width: int) -> np.ndarray:
    """How many shingles of all sets lie in each class of hashes."""
    light(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES, np.int64)
        for b in slices(batches, 0):
            found = np.concatenate([shingle_set(x, width) for x in utf8(b.column(0))])
            n += np.bincount((found & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["class", "n"])

    out = np.zeros(CLASSES, np.int64)
    for r in df.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(tidy(run), "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():  # CLASSES rows at most
        out[r["class"]] = r.n
    return out


def prefix(found: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The shingles of the rarest classes of a set, as many as two sets of that similarity can't both have without a common one."""
    order = np.argsort(counts[(found & np.uint64(CLASSES - 1)).astype(np.int64)], kind="stable")
    return found[order[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]]


def wide_print(found: np.ndarray) -> list[int]:
    """WIDE words of fingerprint of a set, as signed longs."""
    out = []
    for k in range(WIDE):
        votes = np.zeros(BITS, np.int64)
        for i in range(0, len(found), STEP):
            part = found[i : i + STEP]
            part = (part ^ (part >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k) if k else part
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(signed(int.from_bytes(np.packbits(2 * votes > len(found)).tobytes(), "big")))
    return out


def half(hashes: np.ndarray) -> np.ndarray:
    """Their upper 32 bits."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


SHAPE = "struct<digest:binary,n:int,keys:array<int>,print:array<long>,hashes:array<int>>"


def with_prefix(df: DataFrame, text_col: str, out: str, keep: list[str], width: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """keep, and a struct of the set's digest, its size, its prefix (rarest first), its wide fingerprint and 32 bits of each of its hashes."""
    light(df.sparkSession)
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(fresh(df, "text_of_shingles")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows_text):
            sets = [shingle_set(x, width) for x in utf8(b.column(rows_text))]
            shape = [
                pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                pa.array([len(x) for x in sets], pa.int32()),
                lists([half(prefix(x, similarity, counts)) for x in sets], np.int32),
                pa.array([wide_print(x) for x in sets], pa.list_(pa.int64())),
                lists([np.unique(half(x)) for x in sets], np.int32),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.StructArray.from_arrays(shape, ["digest", "n", "keys", "print", "hashes"])], [*keep, out])

    rows_text = len(keep)
    fields = df.select(*(F.col(f"`{c}`") for c in keep)).withColumn(out, F.lit(None).cast(SHAPE)).schema
    return rows.mapInArrow(tidy(run), fields)


def lists(values: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, kind)))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs src, dst whose wide fingerprints (id, print) are near enough for similar sets."""
    a, b = (sets.select(F.col("id").alias(f"{x}_id"), F.col("print").alias(x)) for x in "ab")
    both = pairs.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))
    bits = sum(F.bit_count(F.col("a")[k].bitwiseXOR(F.col("b")[k])) for k in range(WIDE))
    return both.where(bits <= FAR).select("src", "dst")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs src, dst whose sets (id, hashes) have that Jaccard similarity or more. Only sets that are in a pair move."""
    used = pairs.select(F.explode(F.array("src", "dst")).alias("u_id")).distinct()
    sets = sets.join(used, F.col("id") == F.col("u_id"), "left_semi")
    a, b = (sets.select(F.col("id").alias(f"{x}_id"), F.col("hashes").alias(x)) for x in "ab")
    both = pairs.join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id"))
    shared = F.size(F.array_intersect("a", "b"))
    return both.withColumn("shared", shared).where(F.col("shared") / (F.size("a") + F.size("b") - F.col("shared")) >= similarity).select("src", "dst")


def able(a: str, b: str, similarity: float) -> F.Column:
    """Whether two sets whose first common shingle has these places (at) among so many (n) can be similar enough."""
    left = lambda x: F.col(f"{x}n") - F.col(f"{x}at")
    return F.least(left(a), left(b)) >= similarity / (1 + similarity) * (F.col(f"{a}n") + F.col(f"{b}n")) - 1e-6


def pair(a: str, b: str) -> list[F.Column]:
    return [F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")]


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """key, id, n, at, label and size (the label's members) of each shared shingle of rows (id, n, shared: array<struct<at, key>>)."""
    if labels is None:
        named = rows.withColumns({"label": F.col("id"), "size": F.lit(1)})
    else:
        sizes = labels.groupBy(F.col("label").alias("s_label")).agg(F.count("*").cast("int").alias("size"))
        sized = labels.join(sizes, F.col("label") == F.col("s_label")).select("node", "label", "size")
        named = rows.join(sized, F.col("id") == F.col("node"), "left").withColumns({"label": F.coalesce("label", "id"), "size": F.coalesce("size", F.lit(1))})
    return named.select("id", "n", "label", "size", F.explode("shared").alias("s")).select("s.key", "id", "n", "s.at", "label", "size")


def divided(table: DataFrame) -> DataFrame:
    """Of the keys that have more than one label."""
    split = table.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.col("key").alias("s_key"))
    return table.join(split, F.col("key") == F.col("s_key"), "left_semi")


def leader_pairs(table: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Each member with some of each of its keys, others in each turn: in the first turn only with the NAMED that most of its keys name, later with members
    of labels that MANY have, which are the groups of near copies."""
    h = F.xxhash64("id", F.lit(turn))
    row = F.struct(h.alias("h"), "id", "n", "at", "label")
    lead = table.where(F.col("size") >= (MANY if turn else 1)).groupBy("key", F.pmod(h, F.lit(LEADERS[turn])).alias("part")).agg(F.min(row).alias("l"))
    lead = lead.select(F.col("key").alias("l_key"), *(F.col(f"l.{c}").alias(f"l_{c}") for c in ("id", "n", "at", "label")))
    met = table.join(lead, F.col("key") == F.col("l_key")).where((F.col("label") != F.col("l_label")) & able("", "l_", similarity))
    if turn == 0:
        often = met.groupBy("id", "l_id").agg(F.count("*").alias("often"))
        most = F.slice(F.sort_array(F.collect_list(F.struct("often", "l_id")), asc=False), 1, NAMED)
        met = often.groupBy("id").agg(most.alias("m")).select("id", F.explode("m.l_id").alias("l_id"))
    return met.select(*pair("id", "l_id")).distinct()


def all_pairs(table: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """All members of each key with one another where their labels differ; large keys are cut into blocks, which meet two by two."""
    sizes = table.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumnRenamed("key", "b_key")
    own = table.join(sizes, F.col("key") == F.col("b_key")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "n", "at", "label")
    other = met.select(*(F.col(c).alias(f"o_{c}") for c in met.columns))
    same = (F.col("key") == F.col("o_key")) & (F.col("low") == F.col("o_low")) & (F.col("high") == F.col("o_high"))
    once = F.when(F.col("low") == F.col("high"), F.col("id") < F.col("o_id")).otherwise(F.col("own") < F.col("o_own"))
    return met.join(other, same & once & (F.col("label") != F.col("o_label")) & able("", "o_", similarity)).select(*pair("id", "o_id")).distinct()


def similar_groups(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """node, label: the connected components of all similar pairs. rows: id, n, shared (array<struct<at, key>>); sets: id, print, hashes.

    Some rounds link members with a few of each key, so that groups of copies become one label; then all members of different labels are compared."""
    labels = None
    for turn in range(len(LEADERS) + 1):
        table = labelled(rows, labels)
        pairs = leader_pairs(table, turn, similarity) if turn < len(LEADERS) else all_pairs(divided(table), similarity)
        near = materialise(alike(pairs, sets), "similar-candidates")
        free(rows.sparkSession)
        new = materialise(similar(near, sets, similarity), "similar-links")
        discard(near)
        before, labels = labels, grown(labels, new)
        discard(before, new)
        free(rows.sparkSession)
    return labels


def grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after more links (src, dst) between members of different labels: the components of their labels, by which the labels are renamed."""
    if labels is None:
        return materialise(components(links), "similar-labels")
    edges = links
    for end in ("src", "dst"):
        known = labels.select(F.col("node").alias("k_node"), F.col("label").alias("k_label"))
        edges = edges.join(known, F.col(end) == F.col("k_node"), "left").withColumn(end, F.coalesce("k_label", end)).drop("k_node", "k_label")
    joined = components(materialise(edges.select("src", "dst"), "similar-label-links")).select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
    fresh_ones = joined.join(labels.select("node"), F.col("j_node") == F.col("node"), "left_anti").select(F.col("j_node").alias("node"), F.col("j_label").alias("label"))
    renamed = labels.join(joined, F.col("label") == F.col("j_node"), "left").select("node", F.coalesce("j_label", "label").alias("label"))
    return materialise(renamed.union(fresh_ones), "similar-labels")


def keep_one_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar ones, the one of smallest id, with all its columns.

    Documents are similar if the Jaccard similarity of their sets of shingles is so or more; groups are the connected components. Exact, but for
    equal hashes of different shingles and fingerprints that differ by seven deviations: similar sets share one of their rarest shingles (prefix filter),
    whose holders verify the complete distance of their wide fingerprints first, then their sets. Hamming balls can't find such pairs: sets with a
    similarity of 0.8 differ in 10 of 64 bits, and balls of that radius hold more fingerprints than there are documents."""
    shape, row, kept = (fresh(docs, c) for c in ("shape_of_text", "row_of_text", "kept_row"))
    counts = class_counts(docs, "text", width)
    rows = materialise(with_prefix(docs, "text", shape, docs.columns, width, similarity, counts).withColumn(row, F.monotonically_increasing_id()), "documents-with-prefixes")
    narrow = rows.select(F.col(f"`{shape}`.digest").alias("digest"), F.col(f"`{row}`").alias("row"), F.col("doc_id").cast("long").alias("doc"))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first")
    prints = materialise(narrow.groupBy("digest").agg(first).select(F.col("first.row").alias("id"), "first"), "shingle-sets")
    shapes = rows.select(F.col(f"`{row}`").alias("id"), F.col(f"`{shape}`.n").alias("n"), F.col(f"`{shape}`.keys").alias("keys"))
    table = shapes.join(prints.select("id"), "id", "left_semi").select("id", "n", F.posexplode("keys").alias("at", "key"))
    several = table.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("s_key"))
    held = table.join(several, F.col("key") == F.col("s_key"), "left_semi").groupBy("id", "n").agg(F.collect_list(F.struct("at", "key")).alias("shared"))
    held = materialise(held, "shared-shingles")
    free(docs.sparkSession)
    sets = rows.select(F.col(f"`{row}`").alias("id"), F.col(f"`{shape}`.print").alias("print"), F.col(f"`{shape}`.hashes").alias("hashes"))
    joined = similar_groups(held, sets, similarity)
    discard(held)
    named = prints.join(joined, F.col("id") == F.col("node"), "left")
    chosen = named.groupBy(F.coalesce("label", "id").alias("l")).agg(F.min("first").alias("first")).select(F.col("first.row").alias(kept))
    return rows.join(chosen, F.col(f"`{row}`") == F.col(kept), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """One document of each group, the one of smallest id, with all its columns."""
    fp, row, kept = (fresh(docs, c) for c in ("fp_of_text", "row_of_text", "kept_row"))
    rows = materialise(with_fingerprint(docs, "text", fp, docs.columns, width).withColumn(row, F.monotonically_increasing_id()), "documents-with-fingerprints")
    narrow = rows.select(F.col(f"`{fp}`").alias("fp"), F.col(f"`{row}`").alias("row"), F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    least = narrow.groupBy("fp").agg(F.min(order).alias("first")).withColumnRenamed("fp", "r_fp")
    named = groups(narrow)
    chosen = sorted_join(named, least, "fp", "r_fp").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias(kept))
    return sorted_join(rows, chosen, f"`{row}`", kept, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
