"""URL filter: host and path rules, then the ratio of two character language models.

Rules decide first. A rule `host/path` fits its host and all subdomains when the URL's path starts with the rule's; the
longest fitting rule wins, of equally long ones the first in order. Rules are plan constants, `MAX_RULES` at most.

What no rule decides is judged by smoothed variable-order Markov models of accepted and rejected URLs, both over the text
behind `://`, A-Z lowered, cut to an alphabet of 40 signs (any other character is one more sign). A context is the last
0 to `order` characters. Every context that the training URLs hold is kept: of 41 signs and the mark in front of a text there
are at most 72,410 of 0 to 3 characters, however long the corpus (a caller may ask for those only that have at least
`least_share` of the positions). In a context the probability of a sign
is interpolated with that of the shorter context (Witten-Bell); where a context is unknown the longest known one counts.
The score is the mean over the characters of log p(accepted) - log p(rejected). The model is sparse: a context lists the
signs seen behind it; for any other sign its factor goes on top of the shorter context's value.

The threshold is calibrated on every fifth training URL (by hash), which the counts leave out: of the middles between
neighbouring bins of a score histogram the one with the least sum of the two error shares, of equal ones the middle one.

All of it is DataFrame work; the model (at most `most_contexts(order)` rows) is one constant of the plan.

Defined results: null URLs and URLs without `://` have an empty host and path, fit no rule and score 0. A score of at
least the threshold is allowed. Without accepted or without rejected training URLs every score is 0 and the threshold
is 0: what no rule blocks is allowed. Repeated rows stay; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popmeasure.llm.common import LiteralTable, ascii_lower, free, written

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_"
SIGNS = len(ALPHABET) + 1
MAX_RULES = 1000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_REST = r"(?s)^.*?://(.*)$"
BINS = 2000


@dataclass(frozen=True)
class Rule:
    action: str
    text: str


def host_of(url: Column | str) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, action> of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the last one to fit is the outermost condition
        own, _, rest = rule.text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.action).alias("action"))).otherwise(
            found
        )
    return found


def _signs(url: Column | str) -> Column:
    """The text that the models read; characters outside the alphabet become `~`."""
    rest = ascii_lower(F.coalesce(F.regexp_extract(url, _REST, 1), F.lit("")))
    return F.regexp_replace(rest, r"[^a-z0-9./\-_]", "~")


def _positions(urls: DataFrame, order: int) -> DataFrame:
    """(label, n, context, sign): every position with each of its contexts; `^` stands in front of the text."""
    padded = urls.select("label", F.concat(F.lit("^" * order), "signs").alias("s"), F.length("signs").alias("size"))
    at = padded.filter("size > 0").select("label", "s", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i"))
    each = at.select("label", "s", "i", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("n"))
    context = F.substring(F.col("s"), F.col("i") + order - F.col("n"), F.col("n"))
    sign = F.greatest(F.instr(F.lit(ALPHABET), F.substring(F.col("s"), F.col("i") + order, F.lit(1))), F.lit(0))
    return each.select("label", "n", context.alias("context"), sign.cast("int").alias("sign"))


def most_contexts(order: int) -> int:
    """How many contexts of 0 to `order` characters there can be: marks in front, then signs."""
    return sum(SIGNS**k for n in range(order + 1) for k in range(n + 1))


def model_rows(urls: DataFrame, order: int, least_share: float = 0.0) -> DataFrame:
    """(context, back, seen): for each kept context log p(accepted) - log p(rejected) of the signs seen behind it.

    `back` is what is added to the shorter context's value for all other signs.

    `urls` has label (1 accepted, 0 rejected) and signs.
    """
    counts = _positions(urls, order).groupBy("n", "context", "sign").agg(
        F.sum(F.col("label")).alias("acc"), F.sum(1 - F.col("label")).alias("rej")
    )
    per_context = counts.groupBy("n", "context").agg(
        F.sum("acc").alias("acc_n"),
        F.sum("rej").alias("rej_n"),
        F.sum((F.col("acc") > 0).cast("int")).alias("acc_t"),
        F.sum((F.col("rej") > 0).cast("int")).alias("rej_t"),
        F.collect_list(F.struct("sign", "acc", "rej")).alias("seen"),  # at most one entry a sign
    )
    # every position has one context of each order, so the orders' totals are the same
    per_context = written(per_context)
    total = per_context.filter("n = 0").agg(F.sum(F.col("acc_n") + F.col("rej_n"))).first()[0] or 0
    kept = written(per_context.filter(F.col("acc_n") + F.col("rej_n") >= least_share * total))
    level = None
    flat = F.array_repeat(F.lit(1.0 / SIGNS), SIGNS)
    for n in range(order + 1):
        now = kept.filter(F.col("n") == n)
        if level is None:
            now = now.withColumns({"acc_p": flat, "rej_p": flat})
        else:
            shorter = level.select(
                F.col("context").alias("__shorter"), F.col("acc_q").alias("acc_p"), F.col("rej_q").alias("rej_p")
            )
            now = now.join(shorter, F.substring("context", 2, n) == F.col("__shorter")).drop("__shorter")

        def smoothed(side: str) -> Column:
            total = F.col(f"{side}_n") + F.col(f"{side}_t")
            by_sign = F.map_from_entries(F.transform("seen", lambda x: F.struct(x["sign"], x[side])))
            return F.when(total == 0, F.col(f"{side}_p")).otherwise(
                F.transform(
                    f"{side}_p",
                    lambda p, i: (F.coalesce(F.try_element_at(by_sign, i), F.lit(0)) + F.col(f"{side}_t") * p) / total,
                )
            )

        def left(side: str) -> Column:
            total = F.col(f"{side}_n") + F.col(f"{side}_t")
            return F.when(total == 0, F.lit(0.0)).otherwise(F.log(F.col(f"{side}_t") / total))

        done = now.withColumns({"acc_q": smoothed("acc"), "rej_q": smoothed("rej"), "back": left("acc") - left("rej")})
        done = done.select("context", "acc_q", "rej_q", "back", F.col("seen.sign").alias("signs"))
        level = done = written(done)
        rows = done if n == 0 else rows.unionByName(done)
    seen = F.transform(
        "signs",
        lambda k: F.struct(k.alias("sign"), (F.log(F.get("acc_q", k)) - F.log(F.get("rej_q", k))).alias("delta")),
    )
    return rows.select("context", "back", seen.alias("seen"), F.xxhash64("context").alias("key"))


def _same(model: LiteralTable, context: Column) -> Column:
    return F.filter(model.bucket(F.xxhash64(context)), lambda x: x["context"] == context)


def score_column(model: LiteralTable, signs: Column, order: int) -> Column:
    """Mean log ratio over the characters of a text; 0 for an empty one."""
    padded = F.concat(F.lit("^" * order), signs)

    def at(i: Column) -> Column:
        sign = F.greatest(F.instr(F.lit(ALPHABET), F.substring(padded, i + order, F.lit(1))), F.lit(0)).cast("int")
        contexts = [F.substring(padded, i + order - n, F.lit(n)) if n else F.lit("") for n in range(order, -1, -1)]
        # one mention of the model: each would be a copy of it in the plan
        found = F.transform(F.array(*contexts), lambda c: F.get(_same(model, c), F.lit(0)))
        parts = F.transform(
            found,
            lambda x: F.struct(
                F.get(F.filter(x["seen"], lambda y: y["sign"] == sign), F.lit(0))["delta"].alias("delta"),
                F.coalesce(x["back"], F.lit(0.0)).alias("back"),
            ),
        )
        # from the longest context on: the factors of those that lack the sign, then the value of the first that has it
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("over"))
        ended = F.aggregate(
            parts,
            start,
            lambda acc, x: F.when(acc["over"], acc).otherwise(
                F.struct(
                    (acc["sum"] + F.coalesce(x["delta"], x["back"])).alias("sum"), x["delta"].isNotNull().alias("over")
                )
            ),
        )
        return ended["sum"]

    size = F.length(signs)
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0.0), lambda acc, i: acc + at(i))
    return F.when(size > 0, total / size).otherwise(0.0)


def threshold_of(scored: DataFrame) -> float:
    """Threshold with the least sum of error shares on (label, score), over a histogram of BINS bins."""
    span = scored.agg(F.min("score"), F.max("score"), F.sum("label"), F.sum(1 - F.col("label"))).first()
    low, high, accepted, rejected = span
    if not accepted or not rejected or low == high:
        return 0.0
    width = (high - low) / BINS
    number = F.least(F.floor((F.col("score") - low) / width), F.lit(BINS - 1)).cast("int")
    bins = scored.groupBy(number.alias("bin")).agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("r"))
    best, below_a, passed_r = [], 0, rejected
    counted = {r["bin"]: (r["a"], r["r"]) for r in bins.collect()}  # BINS rows at most
    for b in range(BINS + 1):
        error = below_a / accepted + passed_r / rejected
        if not best or error < best[0]:
            best = [error, b, b]
        elif error == best[0] and best[2] == b - 1:
            best[2] = b
        a, r = counted.get(b, (0, 0))
        below_a, passed_r = below_a + a, passed_r - r
    return low + width * (best[1] + best[2]) / 2


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    order: int = 3,
    least_share: float = 0.0,
    accepted: DataFrame | None = None,
    rejected: DataFrame | None = None,
) -> DataFrame:
    """`pages` with host, path, rule, verdict and score.

    `accepted` and `rejected` (each with the column `url`) train the models; by default these are the URLs that the
    rules allow and block.
    """
    host, path, found, signs = free(pages, "host", "path", "found", "signs")
    ruled = pages.withColumns({host: host_of(url), path: path_of(url), signs: _signs(url)})
    ruled = ruled.withColumn(found, rule_column(F.col(host), F.col(path), rules))
    if accepted is None or rejected is None:
        decided = ruled.filter(F.col(found).isNotNull())
        training = decided.select((F.col(found)["action"] == "allow").cast("int").alias("label"), F.col(signs).alias("signs"))
    else:
        parts = [df.select(F.lit(k).alias("label"), _signs(url).alias("signs")) for k, df in ((1, accepted), (0, rejected))]
        training = parts[0].unionByName(parts[1])
    spared = F.pmod(F.xxhash64("signs"), F.lit(5)) == 0
    rows = model_rows(training.filter(~spared), order, least_share)
    model = LiteralTable(rows, "key", most_contexts(order))
    limit, score = 0.0, F.lit(0.0)
    if model.n_rows:
        score = score_column(model, F.col(signs), order)
        held = training.filter(spared).select("label", score_column(model, F.col("signs"), order).alias("score"))
        limit = threshold_of(written(held))
    score_name, rule_name, verdict = free(ruled, "score", "rule", "verdict")
    out = ruled.withColumn(score_name, score)
    own = F.when(F.col(score_name) >= limit, F.lit("allow")).otherwise(F.lit("block"))
    out = out.withColumns(
        {rule_name: F.col(found)["rule"], verdict: F.coalesce(F.col(found)["action"], own)}
    )
    return out.drop(found, signs)
