"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Statistics of each whole text are compared with cutoffs. Fixed base rules come
first (``base_failed``). Beyond these, each rule of ``RULES`` rejects documents
whose score exceeds a cutoff, chosen per stratum from labelled documents:

* For each stratum (lang by default), rule and cutoff of the rule's grid, count
  the labelled good documents n and the rejected ones k.
* Walk the grid from its mildest cutoff. A cutoff is safe if the exact binomial
  tail P(Bin(n, alpha / rules) <= k) is at most delta / (strata * rules), and
  all milder ones are safe (fixed-sequence testing, so that the grid needs no
  further correction; Bonferroni over strata and rules).
* Of the safe cutoffs take the one that rejects most labelled bad documents,
  the mildest if several do. A rule that rejects none of these is not used.

So with probability 1 - delta, in no stratum more than a share alpha of good
documents is rejected by these rules. Strata without enough labels keep the
base rules alone.

The tail is that of independent trials, so rows of one text in a stratum are one
trial, good only if all of them are (near copies still count one by one).

The texts are read once. Statistics are computed inside each row without
exploding words and written to the shared folder beside the columns to return;
labels meet statistics, not texts, so no text is shuffled. Thresholds are one
row per stratum.

Null and empty texts have no words and fail the base rules; a null stratum is a
stratum; a document with several labels counts as good only if all say so;
repeated rows are judged each by itself and get the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Kept, let, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
WINDOW = 5
#: Share of good documents that the rules of a stratum may reject, and the
#: probability that they reject more.
ALPHA = 0.05
DELTA = 0.05

#: Score of each rule and its cutoffs, mildest first; a score above is rejected.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", [2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.18, 0.15, 0.12, 0.1, 0.07, 0.05, 0.03]),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", [0.6, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "length": ("word_chars / greatest(n_words, 1)", [20.0, 16.0, 13.0, 11.0, 10.0]),
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(hashes: Column) -> Column:
    """Words inside 5-word windows whose hash occurs twice or more."""

    def among(pairs: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(pairs, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False))
        return F.filter(pairs, same)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    places = F.array_sort(F.transform(let(F.array_sort(pairs), among), lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("end"))
    return F.aggregate(places, none, lambda a, i: F.struct((a["words"] + i + WINDOW - F.greatest(i, a["end"])).alias("words"), (i + WINDOW).alias("end")))["words"]


def _repeats(words: Column) -> Column:
    """n_repeat_words of a list of words. Windows are compared by a 64-bit
    hash within one text; only a text in which some repeats is looked at twice."""
    last = F.size(words) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    covered = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(last < 1, F.lit(0)).otherwise(covered)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_capitals and base_failed of each whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    gone = lambda chars: F.char_length(F.translate(whole, chars, ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    sizes = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    n, r = F.col("_words")["n"].cast("long"), F.col("_words")["r"].cast("long")
    return docs.withColumns({"_words": sizes, "_lines": of_lines}).withColumns({
        "n_words": n,
        "word_chars": gone(" \t\n\x0b\x0c\r").cast("long"),
        "n_symbols": (F.char_length(whole) - gone(SYMBOLS)).cast("long"),
        "n_dup_lines": F.col("_lines")["d"].cast("long"),
        "n_repeat_words": r,
        "n_lines": F.col("_lines")["n"].cast("long"),
        "n_capitals": (F.char_length(whole) - gone(CAPITALS)).cast("long"),
        "base_failed": (n < 10) | (100 * r > 20 * n),
    }).drop("_words", "_lines")


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), by the ratio of successive terms in logarithms; 1
    without a closer look where k is not below its expectation."""
    first = n * F.lit(p).cast("double") * 0 + n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    tail = F.exp(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step)["sum"])
    return F.when(k >= n * p, 1.0).when(k == 0, F.exp(first)).otherwise(tail)


def thresholds(stats: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs by stratum from the statistics of labelled documents (columns
    of ``with_stats`` and ``good`` boolean): one row per stratum, a column per
    rule, null where a rule is not used."""
    every = [(rule, i, score, cut) for rule, (score, grid) in RULES.items() for i, cut in enumerate(grid)]
    sums = [F.sum(F.when(F.expr(f"{score} > {cut}D") & is_kind, 1).otherwise(0)).alias(f"{kind}_{rule}_{i}") for rule, i, score, cut in every for kind, is_kind in (("good", F.col("good")), ("bad", ~F.col("good")))]
    wide = stats.groupBy(F.col(stratum).alias("stratum")).agg(F.sum(F.col("good").cast("long")).alias("n"), *sums)
    wide = wide.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    cells = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cutoff"), F.col(f"good_{rule}_{i}").alias("k"), F.col(f"bad_{rule}_{i}").alias("bad")) for rule, i, _, cut in every))
    rows = wide.select("stratum", "n", "strata", F.explode(cells).alias("c")).select("stratum", "n", "strata", "c.*")
    tail = binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES))
    rows = rows.withColumn("failed", (tail > delta / (F.col("strata") * len(RULES))).cast("int"))
    walk = Window.partitionBy("stratum", "rule").orderBy("step")
    safe = rows.withColumn("failed", F.max("failed").over(walk)).where("failed = 0 AND bad > 0")
    best = F.max_by("cutoff", F.struct(F.col("bad"), -F.col("step")))
    return safe.groupBy("stratum").pivot("rule", list(RULES)).agg(best)


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """A row with ``good`` for each distinct text (columns _t1, _t2) of a
    stratum that has a quality label; good if all labels of it say so."""
    good = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    same = [c for c in stats.columns if c != "doc_id"]  # equal for equal texts
    return stats.join(good, "doc_id").groupBy(*same).agg(F.min("good").alias("good"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, columns: list[str] | None = None) -> DataFrame:
    """docs (or these ``columns`` of them) with the statistics, base_failed and
    kept. Columns of docs that bear the names of statistics are replaced."""
    names = [*STATS, "n_lines", "n_capitals", "base_failed"]
    wanted = [c for c in (docs.columns if columns is None else columns) if c not in (*names, "kept")]
    keys = [F.xxhash64(F.lit(k), F.coalesce(F.col("text"), F.lit(""))).alias(f"_t{k}") for k in (1, 2)]
    # of docs one value per row, so that no column of theirs meets one of these
    row = F.struct(*(F.col(f"`{c}`") for c in wanted)).alias("_row") if wanted else F.lit(None).cast("int").alias("_row")
    every = Kept(with_stats(docs.select(row, "doc_id", F.col(stratum).alias("stratum"), "text")).select("_row", "doc_id", "stratum", *keys, *names))
    known = labelled(every.df.select("doc_id", "stratum", "_t1", "_t2", *names), labels)
    cutoffs = Kept(thresholds(known, "stratum", alpha, delta))
    cut = cutoffs.df.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"_{r}") for r in RULES))
    out = every.df.join(cut, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    rejected = F.lit(False)
    for rule, (score, _) in RULES.items():
        rejected |= F.coalesce(F.expr(score) > F.col(f"_{rule}"), F.lit(False))
    kept = ~F.col("base_failed") & ~rejected
    return out.select(*(F.col("_row")[c].alias(c) for c in wanted), *STATS, "base_failed", kept.alias("kept"))
