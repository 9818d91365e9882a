"""Benchmark decontamination: find the test items' word windows in training documents and remove what they hit.

Words are maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lowered. A window is `n` consecutive words
of an item; an item with fewer words, but not none, is one window.

Everything happens inside the row. Word hashes are combined to hashes of two and four neighbouring words; these are
looked up in a constant hash table of the windows' first words, and only where one is found the words themselves are
compared, so a result never rests on a hash. No document is shuffled.

The table is built when the windows number at most `max_windows`. Beyond that, positions and windows meet in a
shuffled join with the same exact comparison behind it.

Defined results: a null or wordless text has no words and no hits. Null or wordless items have no window. Items that
repeat an item_id count once; an item without an id hits words but is not listed. Repeated documents each keep their
row, whatever their ids; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popmeasure.llm.common import LiteralTable, ascii_lower, free, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_WINDOWS = 200_000


def _inner(parts: Column) -> Column:
    """A split text without the empty first or last element."""
    first = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
    last = F.when(F.get(parts, F.size(parts) - 1) == "", 1).otherwise(0)
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def split_words(text: Column | str, separators: str, lowered: bool) -> Column:
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.split(ascii_lower(whole) if lowered else whole, separators)


def _neighbours(hashes: Column, step: int) -> Column:
    """Hash of element i and element i + step, for every i that has both."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(
        F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)
    )


def _add_hashes(df: DataFrame, words: str, lengths: list[int], names: dict[int, str]) -> DataFrame:
    """Columns with the hashes of 1, 2 and 4 neighbouring words, up to the longest in `lengths`.

    Each step is used more than once above it, so that the optimiser keeps it as a column of its own.
    """
    df = df.withColumn(names[1], F.transform(words, lambda w: F.xxhash64(w)))
    for length in (2, 4):
        if length <= max(lengths):
            df = df.withColumn(names[length], _neighbours(F.col(names[length // 2]), length // 2))
    return df


def windows(items: DataFrame, n: int = 10, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, words, anchor, key): a window, the number of its first words that are hashed, and their hash."""
    parts = items.select(
        F.col(id_column).cast("string").alias("item"), split_words(text, SEPARATORS, True).alias("parts")
    )
    words = parts.select("item", _inner(F.col("parts")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1)))
    each = words.select("item", "w", F.explode(starts).alias("i")).select(
        "item", F.slice("w", F.col("i"), F.least(F.lit(n), F.size("w"))).alias("words")
    )
    size = F.size("words")
    each = each.distinct().withColumn("anchor", F.when(size >= 4, 4).when(size >= 2, 2).otherwise(1))
    hashes = _add_hashes(each, "words", [4], {1: "h1", 2: "h2", 4: "h4"})
    first = F.when(F.col("anchor") == 4, F.get("h4", F.lit(0))).when(F.col("anchor") == 2, F.get("h2", F.lit(0)))
    return hashes.select("item", "words", "anchor", F.coalesce(first, F.get("h1", F.lit(0))).alias("key"))


def scan(
    docs: DataFrame,
    items: DataFrame,
    n: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_windows: int = MAX_WINDOWS,
) -> tuple[DataFrame, str, str]:
    """`docs` with two more columns: the number of words, and array<struct<start, length, item>>, ordered, of hits."""
    found = windows(items, n, item_id, item_text)
    parts, words, h1, h2, h4, hits, n_words, at = free(docs, *"parts words h1 h2 h4 hits n_words at".split())
    names = {1: h1, 2: h2, 4: h4}
    prepared = docs.withColumn(parts, split_words(text, SEPARATORS, True))
    prepared = prepared.withColumn(words, _inner(F.col(parts))).drop(parts)
    tables = {}
    for anchor in (1, 2, 4):
        some = LiteralTable(found.filter(F.col("anchor") == anchor).drop("anchor"), "key", max_windows)
        if not some.fits:
            return _scan_by_join(prepared, found, words, hits, n_words, names)
        if some.n_rows:
            tables[anchor] = some
    if not tables:
        none = F.array().cast("array<struct<start:int,length:int,item:string>>")
        return prepared.withColumn(hits, none).withColumn(n_words, F.size(words)).drop(words), n_words, hits
    hashed = _add_hashes(prepared, words, list(tables), names)
    one_hash = [names[a] for a in (1, 2, 4) if names[a] in hashed.columns]

    def candidates(anchor: int) -> Column:
        column, some = F.col(names[anchor]), tables[anchor]
        where = F.sequence(F.lit(0), F.size(column) - 1)
        seen = F.filter(where, lambda i: some.bucket(F.get(column, i)).isNotNull())
        return F.when(F.size(column) > 0, seen)

    def verified(anchor: int) -> Column:
        some, column = tables[anchor], F.col(names[anchor])

        def at_position(i: Column) -> Column:
            same = F.filter(
                some.bucket(F.get(column, i)),
                lambda x: F.slice(F.col(words), i + 1, F.size(x["words"])) == x["words"],
            )
            return F.transform(
                same,
                lambda x: F.struct(
                    i.alias("start"), F.size(x["words"]).alias("length"), x["item"].alias("item")
                ),
            )

        return F.flatten(F.transform(F.col(f"{at}{anchor}"), at_position))

    for anchor in tables:
        hashed = hashed.withColumn(f"{at}{anchor}", candidates(anchor))
    empty = F.array().cast("array<struct<start:int,length:int,item:string>>")
    every = [F.when(F.size(f"{at}{a}") > 0, verified(a)).otherwise(empty) for a in tables]
    out = hashed.withColumn(hits, F.array_sort(F.concat(*every))).withColumn(n_words, F.size(words))
    return out.drop(words, *one_hash, *[f"{at}{a}" for a in tables]), n_words, hits


def _scan_by_join(
    prepared: DataFrame, found: DataFrame, words: str, hits: str, n_words: str, names: dict[int, str]
) -> tuple[DataFrame, str, str]:
    """The way beyond the bound: the rows get an id in a written table, positions meet windows in a shuffled join."""
    (row,) = free(prepared, "row")
    lengths = [r["anchor"] for r in found.select("anchor").distinct().collect()]
    stored = written(prepared.withColumn(row, F.monotonically_increasing_id()))
    hashed = _add_hashes(stored.select(row, words), words, lengths, names)
    positions = None
    for a in lengths:
        some = hashed.select(F.col(row).alias("row"), F.lit(a).alias("anchor"), F.posexplode(names[a]).alias("i", "key"))
        positions = some if positions is None else positions.unionByName(some)
    near = positions.join(found, ["anchor", "key"]).groupBy("row").agg(
        F.collect_set(F.struct("i", "words", "item")).alias("near")
    )
    joined = stored.join(near.withColumnRenamed("row", "__row").withColumnRenamed("near", "__near"),
                         F.col(row) == F.col("__row"), "left")
    same = F.filter(
        "__near", lambda x: F.slice(F.col(words), x["i"] + 1, F.size(x["words"])) == x["words"]
    )
    listed = F.transform(
        same, lambda x: F.struct(x["i"].alias("start"), F.size(x["words"]).alias("length"), x["item"].alias("item"))
    )
    empty = F.array().cast("array<struct<start:int,length:int,item:string>>")
    out = joined.withColumn(hits, F.coalesce(F.array_sort(listed), empty)).withColumn(n_words, F.size(words))
    return out.drop(row, words, "__row", "__near"), n_words, hits


def covered(hits: Column | str) -> Column:
    """Number of words inside any hit; `hits` are ordered by start."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["end"], x["start"] + x["length"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], x["start"])).alias("n"), end.alias("end"))

    # a hit that ends inside the words already counted adds end - end = 0
    def bounded(acc: Column, x: Column) -> Column:
        return F.when(x["start"] + x["length"] <= acc["end"], acc).otherwise(step(acc, x))

    return F.aggregate(hits, start, bounded, lambda acc: acc["n"])


def remove_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents without a hit, with the columns they had."""
    scanned, _, hits = scan(docs, items, **options)
    # the optimiser would push the filter below the steps above and write them into each other, so that every element
    # computed the hashes anew; a column that it must not move keeps the filter where it is
    (place,) = free(scanned, "place")
    fixed = scanned.withColumn(place, F.monotonically_increasing_id())
    return fixed.filter((F.size(hits) == 0) & (F.col(place) >= 0)).select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Every document, its text without the words that are hit and the separators that follow each of them."""
    scanned, _, hits = scan(docs, items, text=text, **options)
    words, seps, gone = free(scanned, "words", "seps", "gone")
    whole = F.coalesce(F.col(text), F.lit(""))
    some = scanned.withColumn(words, F.when(F.size(hits) > 0, _inner(F.split(whole, SEPARATORS_ANY_CASE))))
    some = some.withColumn(seps, F.when(F.size(hits) > 0, F.split(whole, WORDS_ANY_CASE)))
    places = F.flatten(
        F.transform(hits, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))
    )
    some = some.withColumn(gone, F.when(F.size(hits) > 0, F.array_distinct(places)))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda i: F.when(F.array_contains(F.col(gone), i), F.lit("")).otherwise(
            F.concat(F.get(F.col(words), i), F.get(F.col(seps), i + 1))
        ),
    )
    rebuilt = F.concat(F.get(F.col(seps), F.lit(0)), F.array_join(kept, ""))
    clean = F.when(F.size(hits) > 0, rebuilt).otherwise(F.col(text))
    return some.withColumn(text, clean).select(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per document row: n_words, n_hit, n_items, digest of the items' ids, and whether anything was hit."""
    scanned, n_words, hits = scan(docs, items, **options)
    listed = F.array_compact(F.transform(hits, lambda x: x["item"]))
    slim = scanned.select(
        F.col(id_column),
        F.col(n_words).cast("long").alias("n_words"),
        covered(hits).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(listed)).alias("items"),
    )
    return slim.select(
        id_column,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
