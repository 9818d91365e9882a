"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact verification, connected components.

Fingerprint: A-Z are lowered, words are runs of `[^\\x20\\x09-\\x0D]`, shingles are `width` words joined by a space,
repeats included; fewer words form one shingle. Each shingle votes with the bits of its XXH64 (seed 42); a bit is set
when more than half of the votes are.

Search: the fingerprint's 32 segments of two bits are mapped to their bit counts, a point with 32 coordinates in 0..2.
The Manhattan distance of two points is at most the Hamming distance of the fingerprints, so links within 3 have points
within 3. Of the two halves of the point (16 coordinates each), one then differs by at most 1: it is equal, or one
coordinate is one larger. The grid is therefore the half point itself; every fingerprint stands in its own cell of either
half and looks into the cells one step above. Candidates are verified on the fingerprints, in the join's condition.

Equal fingerprints are one class before the search. A dense group of different fingerprints would still have a number
of links that grows with its square, so the search runs in two rounds: links of distance 1 come from one-bit wildcard
cells, in which every member is linked to the smallest one (as many links as members); their components are formed,
and the grid join then keeps, of the links between two different components, one per pair of components and cell.

Defined results: a null, empty or wordless text has the fingerprint zero and is linked like any other. Rows without an
id keep their fingerprint and have no component unless another document shares or neighbours it. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popmeasure.llm.common import free, written
from popmeasure.llm.components import components
from popmeasure.llm.words import spaced_words, texts

MAX_DISTANCE = 3
_BLOCK = 1 << 16


def fingerprint(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a word list, as a signed integer; zero for no words."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(len(words) - width + 1, 1)
    first, last = starts[:n], (ends - 1)[min(width, len(words)) - 1 :][:n]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _BLOCK):  # a very long text is counted block by block
        pairs = zip(first[lo : lo + _BLOCK].tolist(), last[lo : lo + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def add_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every document; `fp` is the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = [fingerprint(spaced_words(t), width) for t in texts(frame)]
            yield pd.DataFrame({"id": frame["id"], "fp": np.array(fps, np.int64)})

    slim = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInPandas(run, "id long, fp long").withColumnRenamed("id", id_column)


def fingerprint_column(text: str, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def prints(values: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(spaced_words(v if isinstance(v, str) else None), width) for v in values])

    return prints(text)


def _half_points(fp: Column) -> Column:
    """The two half points as long numbers: 16 coordinates of two bits, each the bit count of its segment."""
    halves = F.array(fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32))
    odd, ones = F.lit(0x55555555).cast("bigint"), 1
    # 00, 01 or 10 in every segment, no carry between them
    return F.transform(halves, lambda h: h.bitwiseAND(odd) + F.shiftrightunsigned(h, ones).bitwiseAND(odd))


def _cells(classes: DataFrame, probe: bool) -> DataFrame:
    """(fp, comp, cell): the own cells, or the cells to look into: the own one and those one step above."""
    half = classes.select("fp", "comp", F.posexplode(_half_points(F.col("fp"))).alias("half", "point"))
    if probe:
        free_dims = F.filter(
            F.array(*[F.lit(1 << (2 * i)) for i in range(16)]).cast("array<bigint>"),
            lambda step: F.col("point").bitwiseAND(step * 2) == 0,
        )
        steps = F.concat(F.array(F.lit(0).cast("bigint")), free_dims)
        half = half.select("fp", "comp", "half", "point", F.explode(steps).alias("step"))
        half = half.withColumn("point", F.col("point") + F.col("step"))
    return half.select("fp", "comp", (F.col("point") * 2 + F.col("half")).alias("cell"))


def near_links(classes: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): one link for each pair of different components with fingerprints within `distance`.

    `classes` has distinct fingerprints `fp` and the component `comp` that each is already known to be in.

    A class looks into up to 34 cells. Spark sizes a table by its files and takes an explode for as many rows as it is
    given, so it would send the cells of a class table under the broadcast threshold through the driver: the join is
    told to sort and merge.
    """
    own = _cells(classes, probe=False).select("cell", F.col("fp").alias("f"), F.col("comp").alias("c"))
    probes = _cells(classes, probe=True).select("cell", F.col("fp").alias("g"), F.col("comp").alias("d")).hint("merge")
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= distance
    pairs = own.join(probes, (own["cell"] == probes["cell"]) & (F.col("c") != F.col("d")) & near)
    return pairs.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()


def one_bit_links(classes: DataFrame) -> DataFrame:
    """(a, b): every fingerprint with the smallest one that agrees with it in all bits but one given bit."""
    masks = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]).cast("array<bigint>")
    cells = classes.select("id", F.posexplode(masks).alias("bit", "mask"), "fp")
    cells = cells.select("id", "bit", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    both = cells.groupBy("bit", "rest").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    return both.filter(F.col("a") != F.col("b")).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, distance: int = MAX_DISTANCE
) -> DataFrame:
    """(id, fp, component_id) of every document: the smallest id that a chain of links reaches."""
    if not 1 <= distance <= 3:
        raise ValueError("the grid finds distances 1 to 3")
    prints = written(add_fingerprints(docs, id_column, text, width))
    # a class is named by its smallest id; classes of rows without any id by their fingerprint, below all real ids
    classes = written(prints.groupBy("fp").agg(F.min(id_column).alias("first"), F.count(F.lit(1)).alias("n")))
    named = classes.select("fp", F.col("fp").alias("id"))
    first_round = components(one_bit_links(named))
    known = named.join(first_round, named["id"] == first_round["node"], "left").select(
        "fp", F.coalesce("component", "id").alias("comp")
    )
    known = written(known)
    links = written(near_links(known, distance))
    merged = components(links)
    label = known.join(merged, known["comp"] == merged["node"], "left").select(
        "fp", F.coalesce("component", "comp").alias("label")
    )
    with_first = label.join(classes, "fp")
    smallest = with_first.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = written(with_first.join(smallest, "label").select("fp", "component_id", "n"))
    # a fingerprint of over a thousandth of all rows would send them to one task: at most 1,000 of these are broadcast
    hot = F.col("n") > prints.count() // 1000
    common = F.broadcast(of_class.filter(hot).drop("n"))
    rest = prints.join(common, "fp", "left_anti").join(of_class.filter(~hot).drop("n"), "fp")
    return prints.join(common, "fp").unionByName(rest).select(id_column, "fp", "component_id")


def hex_fingerprint(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component: the row with the smallest id. Rows without an id stay.

    The rows that go are found on (id, fingerprint) alone; the documents meet only their ids. Where an id stands on
    several texts of which some go, the fingerprints of its rows are made again to tell which. Where an id and its text
    are repeated, one of these rows stays.
    """
    own, component, print_ = free(docs, "own", "component", "fp")
    found = near_duplicates(docs, id_column, text, **options)
    classes = found.select(F.col(id_column).alias(own), F.col("fp").alias(print_), F.col("component_id").alias(component))
    classes = written(classes.filter(F.col(own).isNotNull()).groupBy(own, print_, component).count())
    first = F.col(own) == F.col(component)
    gone = written(classes.filter(~first).select(own, print_))
    mixed = written(gone.join(classes.filter(first).select(own), own, "left_semi"))
    rows = docs.join(gone.select(own).distinct(), docs[id_column] == F.col(own), "left_anti")
    if not mixed.isEmpty():
        ids = mixed.select(own).distinct()
        doubtful = docs.join(ids, docs[id_column] == F.col(own), "left_semi")
        doubtful = doubtful.withColumn(print_, fingerprint_column(text, options.get("width", 3)))
        same = (doubtful[id_column] == mixed[own]) & (doubtful[print_] == mixed[print_])
        rows = rows.unionByName(doubtful.join(mixed, same, "left_anti").drop(print_))
    if classes.filter("count > 1").isEmpty():
        return rows
    named = rows.filter(F.col(id_column).isNotNull()).dropDuplicates([id_column, text])
    return named.unionByName(rows.filter(F.col(id_column).isNull()))
