"""Quality rules as weak supervision: rules vote or abstain, EM rates them, a posterior decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, materialize, whole_text

#: Vote names in the order of the vote vector.
RULES = ("length", "word_length", "symbols", "lines", "repeats", "letters", "stops", "capitals")


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words that lie in a width-word window found twice or more in the array, first find included.

    Windows are 64-bit hashes. Texts without a repeated window stop at array_distinct; the others
    sort (hash, place) once, so the cost is O(n log n) for any length.
    """
    n = F.size(words)

    def covered(win: Column) -> Column:
        ordered = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            hit = F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["i"]))
            return F.sort_array(F.filter(hit, lambda p: p.isNotNull()))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last"))
        step = lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(width).cast("long"), p.cast("long") - a["last"])).alias("n"), p.cast("long").alias("last")
        )
        return F.aggregate(let(ordered, places), start, step)["n"]

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda wh: F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(wh, i, F.lit(width))))
    found = let(hashed, lambda wh: let(windows(wh), lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(covered(win))))
    return F.when(n >= width, found).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the rule inputs as columns n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters, n_capitals, n_stops."""
    t = F.col("__text")
    staged = docs.withColumn("__text", whole_text(text)).withColumn("__words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    w = F.col("__words")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    out = staged.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.size(F.regexp_extract_all(t, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long"),
            "__lines": line_counts,
            "n_repeat_words": repeated_words(w),
            "n_letters": F.length(F.regexp_replace(t, "[^\\p{L}]+", "")).cast("long"),
            "n_capitals": F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")).cast("long"),
            "n_stops": F.size(F.regexp_extract_all(t, F.lit("[.!?]"), F.lit(0))).cast("long"),
        }
    )
    return out.withColumns({"n_lines": F.col("__lines.n").cast("long"), "n_dup_lines": F.col("__lines.dup").cast("long")}).drop("__text", "__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """For each rule 1 (good), -1 (bad) or 0 (abstains), from measures(); a text without words gets no good vote."""
    n, c = F.col("n_words"), F.col("word_chars")
    some = n > 0
    vote = lambda good, bad: F.when(some & bad, F.lit(-1)).when(some & good, F.lit(1)).otherwise(F.lit(0))
    return {
        "length": F.when(n < 20, F.lit(-1)).when(n >= 50, F.lit(1)).otherwise(F.lit(0)),
        "word_length": vote((c >= 3 * n) & (c <= 12 * n), (c < 2 * n) | (c > 20 * n)),
        "symbols": vote(20 * F.col("n_symbols") <= n, 2 * F.col("n_symbols") > n),
        "lines": vote(10 * F.col("n_dup_lines") <= F.col("n_lines"), 3 * F.col("n_dup_lines") > F.col("n_lines")),
        "repeats": vote(10 * F.col("n_repeat_words") <= n, 10 * F.col("n_repeat_words") > 3 * n),
        "letters": vote(20 * F.col("n_letters") >= 17 * c, 4 * F.col("n_letters") < 3 * c),
        "stops": vote((50 * F.col("n_stops") >= n) & (2 * F.col("n_stops") <= n), ((n >= 50) & (F.col("n_stops") == 0)) | (F.col("n_stops") > n)),
        "capitals": vote(5 * F.col("n_capitals") <= F.col("n_letters"), 5 * F.col("n_capitals") > 3 * F.col("n_letters")),
    }


def em_posteriors(patterns: DataFrame, rules: int, rounds: int = 30, prior: float = 0.85, low: float = 0.05, high: float = 0.999) -> DataFrame:
    """patterns (key int, v array<int>, n long), at most 3**rules rows -> (key, posterior of good).

    Each rule has two accuracies, for good texts (its vote is 1) and for bad ones (-1), as one kind of junk
    trips few rules; abstentions carry no weight. All patterns fit one row by their bound, so the rounds are one
    aggregate() expression over that row, without a driver loop. Accuracies of both classes stay in one range, the class prior in
    0.05 .. 0.99. What the classes mean is set by where the rounds begin: most texts good, rules rarely wrong on these and
    right on less than half of the bad ones.
    """
    one = patterns.agg(F.collect_list(F.struct("key", "v", F.col("n").cast("double").alias("n"))).alias("ps"))
    times = lambda v, acc, right: F.aggregate(
        F.zip_with(v, acc, lambda x, a: F.when(x == 0, 1.0).when(x == right, a).otherwise(1.0 - a)), F.lit(1.0), lambda p, x: p * x
    )

    def posterior(v: Column, s: Column) -> Column:
        good, bad = s["pi"] * times(v, s["good"], 1), (1.0 - s["pi"]) * times(v, s["bad"], -1)
        return good / (good + bad)

    clamp = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))

    def update(s: Column) -> Column:
        scored = F.transform("ps", lambda p: let(posterior(p["v"], s), lambda q: F.struct(p["v"].alias("v"), (p["n"] * q).alias("g"), (p["n"] * (1.0 - q)).alias("b"))))

        def fitted(qs: Column) -> Column:
            def rate(j: int, mass: str, right: int, lo: float, hi: float) -> Column:
                start = F.struct(F.lit(0.8).alias("hit"), F.lit(1.0).alias("all"))
                add = lambda t, p: F.struct(
                    (t["hit"] + F.when(p["v"][j] == right, p[mass]).otherwise(0.0)).alias("hit"), (t["all"] + F.when(p["v"][j] != 0, p[mass]).otherwise(0.0)).alias("all")
                )
                return F.aggregate(qs, start, add, lambda t: clamp(t["hit"] / t["all"], lo, hi))

            both = F.aggregate(qs, F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("all")), lambda t, p: F.struct((t["g"] + p["g"]).alias("g"), (t["all"] + p["g"] + p["b"]).alias("all")))
            return F.struct(
                let(both, lambda t: clamp(t["g"] / t["all"], 0.05, 0.99)).alias("pi"),
                F.array(*[rate(j, "g", 1, low, high) for j in range(rules)]).alias("good"),
                F.array(*[rate(j, "b", -1, low, high) for j in range(rules)]).alias("bad"),
            )

        return let(scored, fitted)

    start = F.struct(F.lit(prior).alias("pi"), F.array(*[F.lit(0.98)] * rules).alias("good"), F.array(*[F.lit(0.4)] * rules).alias("bad"))
    fit = one.where(F.size("ps") > 0).withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: update(s)))
    return fit.select(F.inline(F.transform("ps", lambda p: F.struct(p["key"].alias("key"), posterior(p["v"], F.col("s")).alias("posterior")))))


def vote_key() -> Column:
    v = votes()
    return sum(((v[r] + 1) * 3**j for j, r in enumerate(RULES)), F.lit(0)).cast("int")


def posteriors(keys: DataFrame) -> DataFrame:
    """(key, posterior) from rows with vote_key, at most 3**8 rows."""
    digits = F.array(*[F.pmod(F.floor(F.col("key") / 3**j), F.lit(3)).cast("int") - 1 for j in range(len(RULES))])
    patterns = keys.groupBy(F.col("vote_key").alias("key")).agg(F.count("*").alias("n")).withColumn("v", digits)
    return em_posteriors(patterns, len(RULES))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality() keeps, all columns as they are; columns named __* are the operator's own.

    Rows are written once with what the verdict needs; a plan without that table would work measures out again
    for each predicate that Catalyst moves below the join, and texts are never shuffled.
    """
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text).alias("text"))
    judged = measures(boxed).select("__row", vote_key().alias("vote_key"), base_failed().alias("failed"))
    judged = materialize(judged)
    scored = materialize(posteriors(judged.select("vote_key")))
    rows = judged.where(~F.col("failed")).join(F.broadcast(scored), F.col("vote_key") == F.col("key"))  # at most 3**8 rows
    return rows.where(F.col("posterior") >= threshold).select("__row.*")


def quality(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(id, measures, vote vector, posterior, base_failed, kept) for each row of docs.

    Null and empty texts have no words: base_failed, not kept. Repeated rows are judged alike. An
    empty table gives no rows. Only the id and the text are read, so other columns cannot clash.
    Texts are read once; the EM sees counts of at most 3**8 vote patterns.
    """
    small = measures(docs.select(F.col(id_col).alias("__id"), F.col(text).alias("text"))).drop("text")
    small = materialize(small.withColumn("vote_key", vote_key()))
    scored = posteriors(small)
    out = small.join(F.broadcast(scored), small.vote_key == scored.key)  # at most 3**8 rows
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    return out.drop("key").withColumnRenamed("__id", id_col)


def op6(docs: DataFrame) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return quality(docs).select(*cols)
