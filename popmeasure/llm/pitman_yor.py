"""Language-model scores of a hierarchical Pitman-Yor model.

Tokens are words (runs of `[^\\x20\\x09-\\x0D]` after A-Z are lowered) and one end per text, which is the empty word.
Each word that stands before another has a restaurant of what follows it; in front of a text stands the empty word. Their
shared parent is the restaurant of words, which has one dish per word. Its base measure spells a word character by
character, each drawn in the restaurant of the `order` characters before it (the word's start included), up to the
word's end. Restaurants of characters share parents: the context without its first character, down to one root and the
uniform measure over all characters.
A customer who opens a table is a customer of the parent: a word comes to the restaurant of words once per table behind
another word, and is spelled once per table there.

Seating is sampled by blocked Gibbs sweeps: the customers of a dish in a restaurant leave and sit down again one by one,
at a table of theirs with odds (customers - discount * tables) or at a new one with odds (strength + discount * tables of
the restaurant) * parent's probability; the rest stays. From the 64th customer on, the new tables of the next quarter of
customers are drawn at once, as a Poisson number with the odds added up. After `burn_in` sweeps each restaurant's predictive rule is averaged
over `samples` sweeps.

In the restaurants of words, `word_burn_in` sweeps go before the spelling is fitted to the tables, `word_samples` after
it; every sweep starts from the tables of the one before, totals included. A pair of words that occurs once has one table
in every sweep, so only pairs that occur more often are drawn, and no row stands for the others: how many of a word's
followers or predecessors were met once is its own count less that of its repeated pairs. A word that occurs at most once
keeps its table in every sweep too: only the other words are rows of the sweeps, and it is spelled once, by the last rules.

On Spark: documents become blocks of at most `BLOCK_BYTES` of text (or one longer document): the words once, tokens as
places in that list. Words are counted over blocks. The distinct pairs of a block go to buckets by a hash, 48 bits and a
count each, sorted and packed; a bucket adds up what the blocks sent and asks one block for the words of each repeated
pair. These pairs are the rows of the sweeps; they meet the tables of their first word and the probability of their second
one by shuffled joins. At the end the buckets answer each block with the count and the tables of its pairs, in the order
they were sent, and the block's words bring their own values. The number of buckets grows with the tokens, so a bucket
holds about `BUCKET_PAIRS` of them; the pairs of all blocks together hold one entry a block for the most frequent pair.
Words are named by their 64-bit hash, pairs by 48 bits beside their bucket: about one pair in 10^8 is counted with another.
Shuffle files go after each step and tables after their last use (`_Store`); only the scores stay.

Subtrees of context restaurants that share their last character are sampled side by side, with the root's probabilities of
the round before. Every context is kept. A subtree is one group: the distinct runs of `order` + 1 characters with one
character before the last, however often they occur. It answers with the rule of each such run of the vocabulary. Words are
dealt into buckets of about `BUCKET_WORDS`; a bucket asks for each distinct run of its words once, by a shuffled join, and
adds up the answers: no character model is sent to the driver or to all tasks.
Random numbers depend on the seed and on what is drawn for, not on partitions.

Defined results: null and empty texts have the end token only. Without training rows the model is the uniform spelling.
Rows without an id take part; repeated rows are scored each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popmeasure.llm.common import shared_dir
from popmeasure.llm.words import gathered, spaced_words, texts

BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 5_000
BUCKET_PAIRS = 1_000_000
BUCKET_WORDS = 50_000
SHORT_ROWS = 10_000  # of an Arrow batch of words and numbers
BATCH_BYTES = 4 << 20  # of an Arrow batch: blocks are large, and executors keep the buffers of their largest batches
SUBTREE_TASKS = 64
ALL_CHARACTERS = 0x110000 + 1
START, END = "\U0010fffe", "\U0010ffff"
DISCOUNT = (0.3, 0.5, 0.6, 0.7)  # of the root and the orders above it
STRENGTH = 1.0
WORD_DISCOUNT, WORD_STRENGTH = 0.75, 100.0
PAIR_DISCOUNT, PAIR_STRENGTH = 0.8, 5.0
UNITS = 10**9  # of a spelling's log10
_EXACT = 64
_NORMAL = NormalDist()


class _Store:
    """Tables of one run by name: no shuffle files stay behind, and a table goes when one of its name replaces it."""

    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    batch_bytes = "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self):
        self.paths: dict[str, str] = {}

    def __call__(self, name: str, df: DataFrame, batch_rows: int | None = None, zipped: bool = False) -> DataFrame:
        """`df` stored under a name; `batch_rows` is the size of Arrow batches where the rows are short.

        What is `zipped` already is stored as it is: a codec would only hold buffers of its size outside the heap.
        """
        spark = df.sparkSession
        path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        wanted = {self.cleanup: "true", self.batch_bytes: str(BATCH_BYTES)}
        if batch_rows:
            wanted[self.batch] = str(batch_rows)
        before = {key: spark.conf.get(key, None) for key in wanted}
        try:
            for key, value in wanted.items():
                spark.conf.set(key, value)
            df.write.parquet(path, compression="none" if zipped else None)
        finally:
            for key, value in before.items():
                if value is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, value)
        self.drop(spark, name)
        self.paths[name] = path
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, spark: SparkSession, name: str) -> None:
        """Removes a table of this run that nothing reads any more."""
        if name in self.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def seat(
    customers: np.ndarray, parent: np.ndarray, tables: np.ndarray, discount: float, strength: float, uniform
) -> np.ndarray:
    """Tables of each dish after its customers sat down again; `tables` are those of the other dishes.

    `uniform(rows, k)` gives the k-th random numbers of some rows.
    """
    own = np.minimum(customers, 1).astype(np.float64)
    live, draw = np.flatnonzero(customers > 1), 0
    for seated in range(1, _EXACT):
        live = live[customers[live] > seated]
        if not len(live):
            return own
        opened = (strength + discount * (tables[live] + own[live])) * parent[live]
        new = uniform(live, draw) * (seated - discount * own[live] + opened) < opened
        own[live] += new
        draw += 1
    live = live[customers[live] > _EXACT]
    place = np.full(len(live), float(_EXACT))
    while len(live):
        following = np.minimum(np.ceil(place * 1.25), customers[live])
        opened = (strength + discount * (tables[live] + own[live])) * parent[live]
        present = place - discount * own[live]
        expected = opened * np.log((present + opened + following - place) / (present + opened))
        own[live] += np.minimum(_poisson(expected, uniform(live, draw)), following - place)
        stay = following < customers[live]
        live, place = live[stay], following[stay]
        draw += 1
    return own


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson numbers from uniform ones, by inversion; means over 30 by the normal curve."""
    out = np.zeros(len(mean))
    large = mean > 30
    if large.any():
        z = np.array([_NORMAL.inv_cdf(min(max(x, 1e-12), 1 - 1e-12)) for x in u[large].tolist()])
        out[large] = np.maximum(np.round(mean[large] + np.sqrt(mean[large]) * z), 0)
    rows = np.flatnonzero(~large)
    term = np.exp(-mean[rows])
    reached, k = term.copy(), 0
    rest = u[rows] > reached
    while rest.any() and k < 200:
        rows, term, reached, k = rows[rest], term[rest], reached[rest], k + 1
        out[rows] = k
        term = term * mean[rows] / k
        reached = reached + term
        rest = u[rows] > reached
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair_names(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit names of pairs from the hashes of their words."""
    return _mixed(_mixed(before) * np.uint64(0x9E3779B97F4A7C15) + word)


def _hashed(names: np.ndarray, seed: int):
    """Random numbers that depend on a 64-bit name, its turn and the seed."""
    own = _mixed(names + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))

    def uniform(rows: np.ndarray, turn: int) -> np.ndarray:
        x = own[rows] + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return _mixed(x).astype(np.float64) / 2.0**64

    return uniform


def _text_of(word: bytes) -> str:
    return word.decode("utf-8", "replace").replace(START, "�").replace(END, "�")


def _grams(word: bytes, order: int) -> Iterator[str]:
    padded = START * order + _text_of(word) + END
    return (padded[i : i + order + 1] for i in range(len(padded) - order))


def _grams_of(words: list[bytes], order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams, at, starts): the distinct `_grams` of all words, which one stands at each place, each word's first place."""
    padded = [START * order + _text_of(w) + END for w in words]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
    sizes = np.array([len(x) for x in padded], np.int64)
    begin = np.ones(len(points), bool)
    for k in range(1, order + 1):
        begin[np.cumsum(sizes) - k] = False
    place = np.flatnonzero(begin)
    digit = np.cumsum(np.bincount(points) > 0) - 1
    base = int(digit[-1]) + 1
    code, bound = digit[points[place]], base
    for k in range(1, order + 1):
        if bound * base >= 1 << 62:
            kinds, code = np.unique(code, return_inverse=True)
            bound = len(kinds)
        code, bound = code * base + digit[points[place + k]], bound * base
    kinds, at = np.unique(code, return_inverse=True)
    some = np.empty(len(kinds), np.int64)
    some[at] = place
    spelled = points[some[:, None] + np.arange(order + 1)].tobytes().decode("utf-32-le")
    grams = [spelled[i : i + order + 1] for i in range(0, len(spelled), order + 1)]
    return grams, at, np.cumsum(sizes - order) - (sizes - order)


def _bucketed(words: DataFrame) -> DataFrame:
    n = max(1, -(-words.count() // BUCKET_WORDS))
    return words.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n)))


def _asked(words: DataFrame, order: int) -> DataFrame:
    """(bucket, context, character, n): characters of a bucket's words; n is how often tables of theirs spell them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grams, at, starts = _grams_of([bytes(w) for w in frame["word"]], order)
        times = np.repeat(frame["t"].to_numpy(np.float64), np.diff(starts, append=len(at)))
        return pd.DataFrame(
            {
                "bucket": frame["bucket"].iloc[0],
                "context": [g[:-1] for g in grams],
                "character": [g[-1] for g in grams],
                "n": np.bincount(at, times),
            }
        )

    grouped = _bucketed(words).select("bucket", "word", "t").groupBy("bucket")
    return grouped.applyInPandas(run, "bucket long, context string, character string, n double")


def _spelled(words: DataFrame, order: int, asked: DataFrame | None = None) -> DataFrame:
    """(context, character, n): characters of all words; n is how often the tables of the word restaurant spell them."""
    asked = _asked(words, order) if asked is None else asked
    return asked.groupBy("context", "character").agg(F.sum("n").alias("n"))


def _with_spelling(words: DataFrame, grams: DataFrame, order: int, asked: DataFrame | None = None) -> DataFrame:
    """`words` with log10 of each word's spelling as `spelled`. Whole units are added, so their order does not count.

    A bucket of words asks for each distinct run once; `asked` is `_asked` of the same words, if it is there already.
    """
    names, made = words.columns, words.schema

    def run(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return frame[names]
        found, at, starts = _grams_of([bytes(w) for w in frame["word"]], order)
        units = dict(zip(answers["gram"], answers["units"].tolist(), strict=True))
        own = np.array([units[g] for g in found], np.int64)
        return frame.assign(spelled=np.add.reduceat(own[at], starts) / UNITS)[names]

    asked = _asked(words, order) if asked is None else asked
    answers = asked.select("bucket", F.concat("context", "character").alias("gram")).join(grams, "gram")
    return _bucketed(words).groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(run, made)


def _seated(rows: DataFrame, names: list[str], discount: float, strength: float, seed: int) -> DataFrame:
    """`rows` after the `customers` of each sat down again; `rest` and `parent` (log10) are used up."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in gathered(frames):
            hashes = [frame[c].to_numpy(np.int64).view(np.uint64) for c in names]
            own = hashes[0] if len(hashes) == 1 else _pair_names(*hashes)
            parent = 10.0 ** np.maximum(frame["parent"].to_numpy(), -300)
            customers, rest = frame["customers"].to_numpy(np.float64), frame["rest"].to_numpy()
            t = seat(customers, parent, rest, discount, strength, _hashed(own, seed))
            yield frame.drop(columns=["parent", "rest"]).assign(t=t)

    return rows.mapInPandas(run, rows.drop("parent", "rest").schema)


def _interpolated(held: Column, back: Column, parent: Column) -> Column:
    """log10 of held + back * 10 ** parent; what nobody sits at has the parent's part alone, however small."""
    return F.when(held > 0, F.log10(held + back * F.pow(F.lit(10.0), parent))).otherwise(parent + F.log10(back))


def _word_rule(words: DataFrame, alone: float) -> tuple[Column, float, float]:
    """(held, back, tables) of the restaurant of words as it is seated now; `alone` customers have a table each."""
    sums = words.agg(F.sum("customers"), F.sum("t")).first()
    n, t = float(sums[0] or 0) + alone, float(sums[1] or 0) + alone
    held = (F.col("customers") - WORD_DISCOUNT * F.col("t")) / (WORD_STRENGTH + n)
    return held, (WORD_STRENGTH + WORD_DISCOUNT * t) / (WORD_STRENGTH + n), t


def _sample_subtree(rows: pd.DataFrame, root: dict[str, float], order: int, sweeps: int, burn_in: int, seed: int):
    """Gibbs sweeps over the contexts with one last character. Returns rows (kind, name, value) of the averaged rules."""
    rows = rows.sort_values(["context", "character"])
    contexts, characters = rows["context"].tolist(), rows["character"].tolist()
    level: list[dict[tuple[str, str], float]] = [{} for _ in range(order + 1)]
    for context, character, n in zip(contexts, characters, rows["n"].tolist(), strict=True):
        level[len(context)][context, character] = n
    keys: list[list[tuple[str, str]]] = [[] for _ in range(order + 1)]
    for n in range(order, 0, -1):  # every dish of a context is one of its parent
        keys[n] = sorted(set(level[n]) | {(c[1:], ch) for c, ch in (keys[n + 1] if n < order else [])})
    at = [{k: i for i, k in enumerate(ks)} for ks in keys]
    names = [sorted({c for c, _ in ks}) for ks in keys]
    place = [{c: i for i, c in enumerate(ns)} for ns in names]
    owner = [np.array([place[n][c] for c, _ in keys[n]], np.int64) for n in range(order + 1)]
    up = [
        np.array([at[n - 1][c[1:], ch] for c, ch in keys[n]], np.int64) if n > 1 else None for n in range(order + 1)
    ]
    direct = [np.array([level[n].get(k, 0.0) for k in keys[n]]) for n in range(order + 1)]
    base = np.array([root.get(ch, 1.0 / ALL_CHARACTERS) for _, ch in keys[1]])
    rng = np.random.default_rng([seed, *(ord(x) for x in names[1][0])] if names[1] else seed)

    def uniform(live: np.ndarray, _: int) -> np.ndarray:
        return rng.random(len(live))

    tables = [np.minimum(d, 1.0) for d in direct]
    customers = [d.copy() for d in direct]
    sums_held, sums_back, sent = [0.0] * (order + 1), [0.0] * (order + 1), 0.0
    for sweep in range(sweeps):
        for n in range(order, 0, -1):
            customers[n] = direct[n].copy()
            if n < order and len(keys[n + 1]):
                np.add.at(customers[n], up[n + 1], tables[n + 1])
            tables[n] = np.where(customers[n] > 0, np.clip(tables[n], 1, customers[n]), 0)
        probability, rules = base, []
        for n in range(1, order + 1):
            d = DISCOUNT[min(n, len(DISCOUNT) - 1)]
            total = np.bincount(owner[n], weights=customers[n], minlength=len(names[n]))
            spread = np.bincount(owner[n], weights=tables[n], minlength=len(names[n]))
            held = (customers[n] - d * tables[n]) / (STRENGTH + total)[owner[n]]
            back = (STRENGTH + d * spread) / (STRENGTH + total)
            parent = probability if n == 1 else probability[up[n]] if len(keys[n]) else np.empty(0)
            rules.append((parent, d, spread))
            probability = held + back[owner[n]] * parent
            if sweep >= burn_in:
                sums_held[n] = sums_held[n] + held
                sums_back[n] = sums_back[n] + back
        if sweep >= burn_in:
            sent = sent + tables[1]
        for n in range(order, 0, -1):
            if n < order and len(keys[n + 1]):
                customers[n] = direct[n].copy()
                np.add.at(customers[n], up[n + 1], tables[n + 1])
            parent, d, spread = rules[n - 1]
            rest = np.maximum(spread[owner[n]] - tables[n], 0)
            tables[n] = seat(customers[n], parent, rest, d, STRENGTH, uniform)
    kept = sweeps - burn_in
    out = []
    for n in range(1, order + 1):
        if len(keys[n]):
            out += [("held", c + ch, v) for (c, ch), v in zip(keys[n], (sums_held[n] / kept).tolist(), strict=True)]
            out += [("back", c, v) for c, v in zip(names[n], (sums_back[n] / kept).tolist(), strict=True)]
    if len(keys[1]):
        out += [("root", ch, v) for (_, ch), v in zip(keys[1], np.atleast_1d(sent / kept).tolist(), strict=True)]
    return pd.DataFrame(out, columns=["kind", "name", "value"])


def _root_rule(customers: DataFrame) -> tuple[DataFrame, float]:
    """(character, known) from (character, n), and what any other character has. At the root a character has one table."""
    left = F.greatest(F.col("n") - DISCOUNT[0], F.lit(0.0))
    sums = customers.agg(F.sum("n"), F.sum(left)).first()
    whole, held = STRENGTH + (sums[0] or 0.0), sums[1] or 0.0
    other = (1.0 - held / whole) / ALL_CHARACTERS
    return customers.select("character", (left / whole + other).alias("known")), other


def _behind(gram: str, held: dict[str, float], back: dict[str, float], order: int) -> tuple[float, float]:
    """(a, b): the last character's probability behind the others is a + b * the root's."""
    a, b = 0.0, 1.0
    for n in range(1, order + 1):
        own = gram[order - n : order]
        share = back.get(own)
        if share is None:
            break
        a, b = held.get(own + gram[-1], 0.0) + share * a, share * b
    return a, b


def _fit(stored: _Store, spelled: DataFrame, order: int, seed: int, burn_in: int, samples: int) -> DataFrame:
    """(gram, units): log10 of the last character's probability behind the others, in parts of `UNITS`."""
    rows = stored("spelled", spelled, SHORT_ROWS)
    met = rows.filter("n > 0").groupBy("character").agg(F.count("*").cast("double").alias("n"))
    first, _ = _root_rule(met)

    def sample(frame: pd.DataFrame) -> pd.DataFrame:
        trained, held, back, sent = frame[frame["n"] > 0], {}, {}, {}
        if len(trained):
            root = dict(zip(trained["character"], trained["known"].tolist(), strict=True))
            rules = _sample_subtree(
                trained[["context", "character", "n"]], root, order, burn_in + samples, burn_in, seed
            )
            for kind, values in (("held", held), ("back", back), ("root", sent)):
                own = rules[rules["kind"] == kind]
                values.update(zip(own["name"], own["value"].tolist(), strict=True))
        grams = (frame["context"] + frame["character"]).tolist()
        behind = np.array([_behind(g, held, back, order) for g in grams]).reshape(-1, 2)
        rest = [None] * len(sent)
        return pd.DataFrame(
            {
                "gram": grams + rest,
                "character": frame["character"].tolist() + list(sent),
                "held": np.concatenate([behind[:, 0], np.zeros(len(sent))]),
                "back": np.concatenate([behind[:, 1], np.zeros(len(sent))]),
                "customers": np.concatenate([np.zeros(len(grams)), np.array(list(sent.values()), np.float64)]),
            }
        )

    # a number of partitions that adaptive execution keeps: the rows are few, the work on them is not
    dealt = rows.join(first, "character", "left").withColumn("last", F.expr("right(context, 1)"))
    found = dealt.repartition(SUBTREE_TASKS, "last").groupBy("last").applyInPandas(
        sample, "gram string, character string, held double, back double, customers double"
    )
    found = stored("rules", found, SHORT_ROWS)
    sent = found.filter("gram is null").groupBy("character").agg(F.sum("customers").alias("n"))
    roots, other = _root_rule(sent)
    known = F.col("held") + F.col("back") * F.coalesce("known", F.lit(other))
    grams = found.filter("gram is not null").join(roots, "character", "left")
    return grams.select("gram", F.round(F.log10(known) * UNITS).cast("long").alias("units"))


def _zipped(data: bytes) -> bytes:
    """`data` as zstd behind its length: blocks and answers are stored and shuffled often."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unzipped(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def _blocks(rows: DataFrame) -> DataFrame:
    """Runs of documents: their ids and train flags, tokens of each, and their words. Place 0 is the empty word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 33
        place, docs, tokens, size = _Places({b"": 0}), [], [], 0

        def block() -> pd.DataFrame:
            ids, train, sizes = zip(*docs, strict=True)
            at = np.concatenate(tokens)
            made = {
                "chunk": number,
                "ids": [list(ids)],
                "train": np.array(train, np.uint8).tobytes(),
                "sizes": np.array(sizes, "<u4").tobytes(),
                # low halves, then high halves, most of which are zero
                "tokens": _zipped(at.astype("<u2").tobytes() + (at >> 16).astype("<u2").tobytes()),
                "words": _zipped(b" ".join(place)),
                "n": len(at),
            }
            return pd.DataFrame(made)

        for frame in frames:
            for name, train, text in zip(frame["id"], frame["train"], texts(frame), strict=True):
                length = len(text or "")
                if docs and (size + length > BLOCK_BYTES or len(docs) >= BLOCK_ROWS):
                    yield block()
                    number, place, docs, tokens, size = number + 1, _Places({b"": 0}), [], [], 0
                words = spaced_words(text)
                words.append(b"")
                docs.append((name, train, len(words)))
                tokens.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                size += length
        if docs:
            yield block()

    made = "chunk long, ids array<string>, train binary, sizes binary, tokens binary, words binary, n long"
    return rows.mapInPandas(run, made)


class _Block:
    """A block unpacked: words, tokens, and its distinct pairs in the order of their names."""

    def __init__(self, row):
        self.ids, self.words = list(row.ids), _unzipped(bytes(row.words)).split(b" ")
        self.train = np.frombuffer(row.train, np.uint8)
        self.sizes = np.frombuffer(row.sizes, "<u4").astype(np.int64)
        low, high = np.frombuffer(_unzipped(bytes(row.tokens)), "<u2").reshape(2, -1)
        self.tokens = low.astype(np.int64) | high.astype(np.int64) << 16
        self.starts = np.cumsum(self.sizes) - self.sizes

    def counts(self) -> np.ndarray:
        """Training tokens of each word."""
        return np.bincount(self.tokens, np.repeat(self.train, self.sizes), len(self.words))

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w, 42) for w in self.words], np.uint64)

    def pair(self) -> None:
        """names, before, word, count of the distinct pairs; `at` leads from a token to its pair."""
        before = np.concatenate([[0], self.tokens[:-1]])
        before[self.starts] = 0
        own = self.hashes()
        # pairs are told apart by places, then put into the order of their names
        codes, at = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        trained = np.repeat(self.train, self.sizes)
        count = np.bincount(at, trained, len(codes)).astype(np.int64)
        first, second = codes // len(self.words), codes % len(self.words)
        names = _pair_names(own[first], own[second])
        order = np.argsort(names)  # equal names are counted as one pair, in whatever order
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.own, self.at, self.names = own, back[at], names[order]
        self.before, self.word, self.count = first[order], second[order], count[order]


def _block_words(blocks: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                block = _Block(row)
                yield pd.DataFrame({"word": block.words, "c": block.counts().astype(np.int64)})

    return blocks.mapInPandas(run, "word binary, c long")


def _block_dictionary(blocks: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                own = _Block(row).hashes().view(np.int64)
                yield pd.DataFrame({"chunk": row.chunk, "place": np.arange(len(own)), "id": own})

    return blocks.mapInPandas(run, "chunk long, place long, id long")


def _entries(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """(chunk, entries): occurs, parent and tables of a block's words in their order, packed."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("place")[["occurs", "parent", "tables"]].to_numpy(np.float64)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "entries": [_zipped(rows.T.tobytes())]})

    found = _block_dictionary(blocks).join(values, "id").drop("id")
    return found.groupBy("chunk").applyInPandas(run, "chunk long, entries binary")


_SENT = "bucket long, chunk long, names binary, counts binary"


def _packed(names: np.ndarray, counts: np.ndarray, bits: int, chunk: int) -> pd.DataFrame:
    """Rows of `_SENT`, one a bucket: the low 48 bits of the names, which are in order, and a count each."""
    of = (names >> np.uint64(64 - bits)).astype(np.int64)
    buckets, starts = np.unique(of, return_index=True)
    low = names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    ends = [*starts[1:].tolist(), len(of)]
    spans = list(zip(starts.tolist(), ends, strict=True)) if len(of) else []
    return pd.DataFrame(
        {
            "bucket": buckets,
            "chunk": chunk,
            "names": [low[i:j].tobytes() for i, j in spans],
            "counts": [counts[i:j].astype("<u4").tobytes() for i, j in spans],
        }
    )


def _unpacked(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(names, how many each row holds)."""
    sizes = np.array([len(x) // 6 for x in column], np.int64)
    out = np.zeros((int(sizes.sum()), 8), np.uint8)
    out[:, :6] = np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel(), sizes


def _numbers(column: Iterable[bytes], kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), kind).astype(np.int64)


def _sent_pairs(blocks: DataFrame, bits: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                block = _Block(row)
                block.pair()
                yield _packed(block.names, block.count, bits, row.chunk)

    return blocks.mapInPandas(run, _SENT)


def _sent_tables(live: DataFrame, bits: int, samples: int) -> DataFrame:
    """Rows of `_SENT` with chunk -1: the tables of repeated pairs, summed over the samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in gathered(frames, 500_000):
            names = _pair_names(*(frame[c].to_numpy(np.int64).view(np.uint64) for c in ("before", "word")))
            order = np.argsort(names)
            tables = np.rint(frame["kept"].to_numpy() * samples).astype(np.int64)
            yield _packed(names[order], tables[order], bits, -1)

    return live.select("before", "word", "kept").mapInPandas(run, _SENT)


def _repeated(sent: DataFrame) -> DataFrame:
    """(chunk, bucket, asked, counts): which pairs a block is asked to name, as bits, and their training counts."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        names, sizes = _unpacked(frame["names"])
        _, first, at = np.unique(names, return_index=True, return_inverse=True)
        total = np.bincount(at, _numbers(frame["counts"])).astype("<u4")
        asked, counts = np.zeros(len(names), bool), np.zeros(len(names), "<u4")
        asked[first[total > 1]] = True
        counts[first] = total
        ends = np.cumsum(sizes).tolist()
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        return pd.DataFrame(
            {
                "chunk": frame["chunk"].to_numpy(),
                "bucket": frame["bucket"].to_numpy(),
                "asked": [np.packbits(asked[i:j]).tobytes() for i, j in spans],
                "counts": [counts[i:j][asked[i:j]].tobytes() for i, j in spans],
            }
        )

    made = "chunk long, bucket long, asked binary, counts binary"
    return sent.groupBy("bucket").applyInPandas(run, made)


def _parts(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    return blocks.unionByName(answers, allowMissingColumns=True)


def _split(frame: pd.DataFrame) -> tuple[_Block, pd.DataFrame]:
    """A group of `_parts`: its block with pairs, and the answers in the order of the block's pairs."""
    whole = frame["bucket"].isna()
    block = _Block(next(frame[whole].itertuples(index=False)))
    block.pair()
    return block, frame[~whole].sort_values("bucket")


def _live_pairs(blocks: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """(before, word, customers): hashes and training counts of the pairs that occur more than once."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block, answers = _split(frame)
        _, sizes = np.unique(block.names >> np.uint64(64 - bits), return_counts=True)
        flags = [
            np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(answers["asked"], sizes, strict=True)
        ]
        asked = np.concatenate(flags).astype(bool)
        own = block.own.view(np.int64)
        return pd.DataFrame(
            {
                "before": own[block.before[asked]],
                "word": own[block.word[asked]],
                "customers": _numbers(answers["counts"]).astype(np.float64),
            }
        )

    grouped = _parts(blocks, repeated).groupBy("chunk")
    return grouped.applyInPandas(run, "before long, word long, customers double")


def _answers(sent: DataFrame, tables: DataFrame) -> DataFrame:
    """(chunk, bucket, counts, tables): training counts and tables of the pairs that a block sent, in its order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = frame[frame["chunk"] < 0]
        frame = frame[frame["chunk"] >= 0]
        names, sizes = _unpacked(frame["names"])
        distinct, at = np.unique(names, return_inverse=True)
        total = np.bincount(at, _numbers(frame["counts"])).astype("<u4")
        opened = np.minimum(total, 1)
        opened[total > 1] = 0
        if len(held):
            known, _ = _unpacked(held["names"])
            np.add.at(opened, np.searchsorted(distinct, known), _numbers(held["counts"]).astype("<u4"))
        ends = np.cumsum(sizes).tolist()
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        return pd.DataFrame(
            {
                "chunk": frame["chunk"].to_numpy(),
                "bucket": frame["bucket"].to_numpy(),
                "counts": [_zipped(total[at[i:j]].tobytes()) for i, j in spans],
                "tables": [_zipped(opened[at[i:j]].tobytes()) for i, j in spans],
            }
        )

    made = "chunk long, bucket long, counts binary, tables binary"
    return sent.unionByName(tables).groupBy("bucket").applyInPandas(run, made)


def score(
    docs: DataFrame,
    train: Column,
    id_column: str = "doc_id",
    text: str = "text",
    order: int = 3,
    burn_in: int = 3,
    samples: int = 4,
    seed: int = 11,
    word_burn_in: int = 2,
    word_samples: int = 2,
) -> DataFrame:
    """One row per document row: id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    `train` says which rows to learn from.
    """
    stored = _Store()
    rows = docs.select(
        F.col(id_column).cast("string").alias("id"),
        F.coalesce(train, F.lit(False)).cast("int").alias("train"),
        F.col(text).alias("text"),
    )
    blocks = stored("blocks", _blocks(rows), zipped=True)
    n_all = blocks.agg(F.sum("n")).first()[0] or 0
    bits = max(1, int(n_all / BUCKET_PAIRS).bit_length())
    repeated = stored("repeated", _repeated(_sent_pairs(blocks, bits)))
    live = stored("live", _live_pairs(blocks, repeated, bits))
    stored.drop(docs.sparkSession, "repeated")
    zero = F.lit(0.0)
    counted = _block_words(blocks).groupBy("word").agg(F.sum("c").alias("c")).withColumn("id", F.xxhash64("word"))
    behind = live.groupBy(F.col("word").alias("id")).agg(F.sum("customers").alias("met"), F.count("*").alias("pairs"))
    after = live.groupBy(F.col("before").alias("id")).agg(F.sum("customers").alias("led"))
    words = counted.join(behind, "id", "left").join(after, "id", "left")
    words = words.select(
        "id",
        "word",
        "c",
        (F.col("c") - F.coalesce("met", zero)).alias("ones"),
        (F.col("c") - F.coalesce("led", zero)).alias("followed"),
        (F.col("c") - F.coalesce("met", zero) + F.coalesce("pairs", F.lit(0))).alias("customers"),
        (F.col("c") > 0).cast("double").alias("t"),
        F.lit(0.0).alias("spelled"),
        F.lit(0.0).alias("held"),
        ((F.col("c") > 1) | F.col("pairs").isNotNull()).alias("drawn"),
    )
    words = stored("words", words)
    sums = words.agg(
        F.sum("c").alias("n"), F.sum("t").alias("v"), F.sum(F.when(~F.col("drawn"), F.col("t"))).alias("alone")
    ).first()
    n_train, v_train, alone = int(sums["n"] or 0), int(sums["v"] or 0), float(sums["alone"] or 0)
    live = stored(
        "live",
        live.join(words.select(F.col("id").alias("before"), "followed"), "before").withColumns(
            {"t": F.lit(1.0), "kept": F.lit(0.0)}
        ),
    )
    once, words = words.filter(~F.col("drawn")).drop("drawn"), words.filter("drawn").drop("drawn")
    asked_once = stored("asked once", _asked(once, order), SHORT_ROWS)
    asked = stored("asked", _asked(words, order), SHORT_ROWS)
    grams = _fit(stored, _spelled(words, order, asked.union(asked_once)), order, seed, 1, 1)
    words, backs, shares = stored("drawn", _with_spelling(words, grams, order, asked), SHORT_ROWS), [1.0], F.lit(0.0)
    if n_train:
        backs = []
        held, back, tables = _word_rule(words, alone)
        for k in range(word_burn_in + word_samples):
            if k == word_burn_in:
                asked = stored("asked", _asked(words, order), SHORT_ROWS)
                grams = _fit(stored, _spelled(words, order, asked.union(asked_once)), order, seed, burn_in, samples)
                words = stored("drawn", _with_spelling(words, grams, order, asked), SHORT_ROWS)
                once = stored("once", _with_spelling(once, grams, order, asked_once), SHORT_ROWS)
                for name in ("asked", "asked once", "spelled", "rules", "words"):
                    stored.drop(docs.sparkSession, name)
            parent = words.select(
                F.col("id").alias("word"), _interpolated(held, F.lit(back), F.col("spelled")).alias("parent")
            )
            others = live.join(live.groupBy("before").agg(F.sum("t").alias("opened")), "before")
            others = others.withColumn("rest", F.col("followed") + F.col("opened") - F.col("t")).drop("opened")
            seated = _seated(
                others.join(parent, "word"), ["before", "word"], PAIR_DISCOUNT, PAIR_STRENGTH, seed + 200 + k
            )
            if k >= word_burn_in:
                seated = seated.withColumn("kept", F.col("kept") + F.col("t") / word_samples)
            live = stored("live", seated, SHORT_ROWS)
            come = live.groupBy(F.col("word").alias("id")).agg(F.sum("t").alias("come"))
            again = words.join(come, "id", "left").withColumn("customers", F.col("ones") + F.coalesce("come", zero))
            again = again.drop("come").withColumns({"rest": tables - F.col("t"), "parent": F.col("spelled")})
            words = stored("drawn", _seated(again, ["id"], WORD_DISCOUNT, WORD_STRENGTH, seed + 300 + k), SHORT_ROWS)
            held, back, tables = _word_rule(words, alone)
            if k >= word_burn_in:
                words = words.withColumn("held", F.col("held") + held / word_samples)
                shares = shares + held / word_samples
                backs.append(back)
    else:
        once = stored("once", _with_spelling(once, grams, order, asked_once), SHORT_ROWS)
    words = words.union(once.withColumn("held", shares))
    shared = _interpolated(F.col("held"), F.lit(sum(backs) / len(backs)), F.col("spelled"))
    # the customers of pairs do not change, so the mean of the rules is the rule of the mean tables
    opened = live.groupBy(F.col("before").alias("id")).agg(F.sum("kept").alias("opened"))
    values = words.join(opened, "id", "left").select(
        "id",
        F.col("c").alias("occurs"),
        shared.alias("parent"),
        (F.col("followed") + F.coalesce("opened", zero)).alias("tables"),
    )
    values = stored("values", values)
    drawn = stored("tables", _sent_tables(live, bits, word_samples), SHORT_ROWS)
    for name in ("live", "words", "drawn", "once", "asked", "asked once", "spelled", "rules"):
        stored.drop(docs.sparkSession, name)
    entries = stored("entries", _entries(blocks, values), SHORT_ROWS, zipped=True)
    stored.drop(docs.sparkSession, "values")
    answers = stored("answers", _answers(_sent_pairs(blocks, bits), drawn), zipped=True)
    stored.drop(docs.sparkSession, "tables")

    def add_up(parts: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        block, found = _split(parts)
        n, parent, opened = np.frombuffer(_unzipped(bytes(packed["entries"].iloc[0]))).reshape(3, -1)
        c, t = (_numbers([_unzipped(bytes(x)) for x in found[column]]) for column in ("counts", "tables"))
        t = t.astype(np.float64)
        t[c > 1] /= word_samples
        at, below = n[block.before], parent[block.word]
        held = (c - PAIR_DISCOUNT * t) / (PAIR_STRENGTH + at)
        back = (PAIR_STRENGTH + PAIR_DISCOUNT * opened[block.before]) / (PAIR_STRENGTH + at)
        p = below + np.log10(back)
        own = held > 0
        p[own] = np.log10(held[own] + back[own] * 10.0 ** below[own])
        base = np.log10((n + 0.5) / (n_train + 0.5 * (v_train + 1)))

        def summed(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, block.starts)

        return pd.DataFrame(
            {
                "id": block.ids,
                "train": block.train.astype(np.int64),
                "n_tokens": block.sizes,
                "n_known": summed((n > 0).astype(np.int64)[block.tokens]),
                "base_score": summed(base[block.tokens]),
                "score": summed(p[block.at]),
            }
        )

    together = _parts(blocks, answers).groupBy("chunk").cogroup(entries.groupBy("chunk"))
    found = together.applyInPandas(
        add_up, "id string, train int, n_tokens long, n_known long, base_score double, score double"
    )
    found = stored("found", found, SHORT_ROWS)
    for name in ("blocks", "entries", "answers"):
        stored.drop(docs.sparkSession, name)
    return found.select(
        F.col("id").cast(docs.schema[id_column].dataType).alias(id_column),
        (F.col("train") == 1).alias("train"),
        "n_tokens",
        "n_known",
        F.lit(n_train).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
