"""URL filter: rules first, and for the rest the ratio of two character language models, DataFrame only.

URLs that a rule decides are the training texts: one variable-order Markov model of the accepted and
one of the rejected.  Both use the same contexts: those of up to ``ORDER`` characters that make up at
least ``LEAST_SHARE`` of all positions, so each length has at most 1 / ``LEAST_SHARE`` of them however
many URLs there are.  A character's probability after a context is mixed with that after the context
without its first character by Witten and Bell's weights, down to an even share of the alphabet.

The model is one table: per context and next character the logarithm of accepted over rejected
probability less that of the next shorter context.  Summed over all contexts that end at a place this
is the log ratio after the longest of them, so a URL is scored by one join and one sum.  The mean over
its characters is held against a threshold that is calibrated on URLs kept out of the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.session import materialize

ORDER = 5
LEAST_SHARE = 1 / 2000
CALIBRATION_FOLDS = 5  # one URL in five calibrates, the others are counted
BINS_PER_UNIT = 200

# Characters the models tell apart; digits count as 0, others as *.
LETTERS = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#%:+~@,;!*"
END = "$"
START = "^"
_ALPHABET = list(LETTERS + END)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host and path prefix; it holds for the host's subdomains too."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.pattern.partition("/")
        here = (host == name) | F.endswith(host, F.lit("." + name))
        return here & F.startswith(path, F.lit(slash + rest))


# The production rules.
RULES = [
    Rule("block", "net/"),
    Rule("allow", "example.net/en/"),
    Rule("block", "example.com/de/"),
    Rule("allow", "org/fr/"),
]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(lower_ascii(found), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct of pattern and verdict; null if none fits."""
    found = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        own = F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))
        found = F.when(r.fits(host, path), own).otherwise(found)
    return found


def model_text(url: Column) -> Column:
    """What the models read: the URL after its scheme, folded to the alphabet; null is empty."""
    whole = F.coalesce(_after_scheme(url), url, F.lit(""))
    folded = F.regexp_replace(lower_ascii(whole), "[0-9]", "0")
    return F.regexp_replace(folded, r"[^a-z0/.\-_?=&#%:+~@,;!]", "*")


def grams(text: Column, order: int = ORDER) -> Column:
    """Every character with each context of up to ``order`` characters before it, end included."""
    marked = F.concat(F.lit(START), text, F.lit(END))

    def at(i: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.least(i - 1, F.lit(order))),
            lambda k: F.substring(marked, i - k, k + 1),
        )

    return F.flatten(F.transform(F.sequence(F.lit(2), F.length(marked)), at))


def _context(gram: Column) -> Column:
    return F.substring(gram, F.lit(1), F.length(gram) - 1)


def fit_ratio(train: DataFrame, order: int = ORDER, least_share: float = LEAST_SHARE) -> DataFrame:
    """(gram, gain) from ``train`` (text, accepted); repeated texts count once.

    ``gain`` is the log ratio after the gram's context less that after the context without its first
    character.  There is a row for every kept context and every character of the alphabet.
    """
    one = F.explode(grams(F.col("text"), order)).alias("gram")
    counts = (
        train.select("text", "accepted")
        .distinct()
        .select("accepted", one)
        .groupBy("gram")
        .agg(F.count_if("accepted").alias("ca"), F.count_if(~F.col("accepted")).alias("cr"))
    )
    counts = materialize(counts)
    contexts = counts.groupBy(_context(F.col("gram")).alias("context")).agg(
        F.sum("ca").alias("na"),
        F.sum("cr").alias("nr"),
        F.count_if(F.col("ca") > 0).alias("da"),
        F.count_if(F.col("cr") > 0).alias("dr"),
    )
    size = F.col("na") + F.col("nr")
    total = counts.filter(F.length("gram") == 1).agg(F.sum(F.col("ca") + F.col("cr")))
    kept = materialize(contexts.filter(size >= total.scalar() * least_share))
    letters = F.explode(F.array(*[F.lit(c) for c in _ALPHABET])).alias("letter")

    def mixed(c: str, n: str, d: str, shorter: Column) -> Column:
        seen = F.coalesce(F.col(c), F.lit(0))
        return F.when(F.col(n) > 0, (seen + F.col(d) * shorter) / (F.col(n) + F.col(d))).otherwise(shorter)

    levels = []
    for k in range(order + 1):
        here = kept.filter(F.length("context") == k).select("*", letters)
        here = here.withColumn("gram", F.concat("context", "letter")).join(counts, "gram", "left")
        if k:
            short = levels[-1].select(
                F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr")
            )
            here = here.withColumn("shorter", F.substring("gram", 2, order + 1)).join(short, "shorter")
        else:
            even = F.lit(1 / len(_ALPHABET))
            here = here.select("*", even.alias("qa"), even.alias("qr"))
        here = here.select(
            "gram",
            mixed("ca", "na", "da", F.col("qa")).alias("pa"),
            mixed("cr", "nr", "dr", F.col("qr")).alias("pr"),
            "qa",
            "qr",
        )
        levels.append(materialize(here))
    model = levels[0]
    for level in levels[1:]:
        model = model.union(level)
    gain = F.log(F.col("pa") / F.col("pr")) - F.log(F.col("qa") / F.col("qr"))
    return materialize(model.select("gram", gain.alias("gain")))


def score_texts(rows: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """``rows`` with ``score``, the mean log ratio a character of their ``text``, end included.

    The model is bounded by its parameters (see ``fit_ratio``) whatever the input, so it is broadcast.
    Sums are taken in whole billionths, so they do not depend on the order of rows.
    """
    keyed = rows.select("*", F.monotonically_increasing_id().alias("_row"))
    each = keyed.select("*", F.explode(grams(F.col("text"), order)).alias("gram"))
    fine = F.round(F.col("gain") * 1e9).cast("bigint")
    summed = (
        each.join(F.broadcast(model), "gram")
        .groupBy("_row", *rows.columns)
        .agg(F.sum(fine).alias("_sum"))
    )
    return summed.select(*rows.columns, (F.col("_sum") / 1e9 / (F.length("text") + 1)).alias("score"))


def threshold_of(scored: DataFrame) -> DataFrame:
    """One row, ``threshold``: where the mean of both classes' shares judged right is greatest.

    ``scored`` holds score and accepted.  Of several equally good places the middle one counts; with
    one class or none the threshold is 0.  Scores are counted in bins, whose number does not grow with
    the rows: a mean log ratio is bounded by the models' smallest probability.
    """
    bins = scored.groupBy(F.floor(F.col("score") * BINS_PER_UNIT).alias("bin")).agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    by_bin = Window.orderBy("bin")
    below = F.sum("r").over(by_bin.rowsBetween(Window.unboundedPreceding, -1))
    above = F.sum("a").over(by_bin.rowsBetween(0, Window.unboundedFollowing))
    a, r = bins.agg(F.sum("a")).scalar(), bins.agg(F.sum("r")).scalar()
    right = bins.select("bin", (F.coalesce(below, F.lit(0)) / F.nullif(r, F.lit(0)) + above / F.nullif(a, F.lit(0))).alias("right"))
    best = right.agg(F.max("right")).scalar()
    edge = F.col("bin") / BINS_PER_UNIT
    middle = right.filter(F.col("right") == best).agg(((F.min(edge) + F.max(edge)) / 2).alias("t"))
    return middle.select(F.coalesce("t", F.lit(0.0)).alias("threshold"))


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every row of ``pages``.

    ``rule`` is the longest fitting rule and gives the verdict; otherwise allow if the score reaches
    the threshold, else block.  A null URL has empty host, path and text; it is scored as an empty
    text.  If no URL is accepted, or none is rejected, by a rule, there is nothing to compare: scores
    and threshold are 0 and URLs without a rule are allowed.  Repeated rows give repeated results and
    count once in the models; other columns are left aside, whatever their names.
    """
    url = F.col("url")
    parts = pages.select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        model_text(url).alias("text"),
        (F.crc32(F.coalesce(url, F.lit(""))) % CALIBRATION_FOLDS == 0).alias("apart"),
    )
    found = matched_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("_rule", found).select(
        "page_id",
        "host",
        "path",
        "text",
        "apart",
        F.col("_rule.pattern").alias("rule"),
        (F.col("_rule.verdict") == "allow").alias("accepted"),
    )
    train = parts.filter("accepted IS NOT NULL AND NOT apart")
    seen = train.agg(
        F.coalesce(F.bool_or("accepted"), F.lit(False)).alias("a"),
        F.coalesce(F.bool_or(~F.col("accepted")), F.lit(False)).alias("r"),
    ).first()
    if seen["a"] and seen["r"]:
        scored = materialize(score_texts(parts, fit_ratio(train)))
        held = scored.filter("accepted IS NOT NULL AND apart").select("text", "accepted", "score")
        threshold = materialize(threshold_of(held.distinct())).scalar()
    else:
        scored, threshold = parts.withColumn("score", F.lit(0.0)), F.lit(0.0)
    accepted = F.coalesce("accepted", F.col("score") >= F.col("threshold"))
    return scored.withColumn("threshold", threshold).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(accepted, "allow").otherwise("block").alias("verdict"),
        "score",
        "threshold",
    )
