"""Benchmark decontamination by template windows, in DataFrame operations alone.

Texts and benchmark items become sequences of lower-case words in which numbers, names and units carry a
type mark. A window is WINDOW such words, slots reduced to their types, so that a question whose numbers
or names were exchanged has the windows of the original. Windows of texts meet those of items in a hash
join on their 64-bit hashes. What the slots held is then compared along each alignment: an item's value
must stand for one value of the text everywhere, or its windows do not count. Beside them windows of the
words as they are meet in the same join, since what is a name hangs on case: a window of
an item counts if it is found either way, so copies in other case or wrapped otherwise are found. Items
without template windows are searched by all their literal words: those are matched exactly only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, id_text, without, written

WINDOW = 8
#: A template window needs so many words that are no slots; items shorter than a window have their whole as one, and need fewer.
LITERALS, SHORT_LITERALS = 4, 3
#: A text holds an item if it has this share of the item's windows.
SHARE = 0.5
#: ... or so many of them in a row along one alignment (RUN + WINDOW - 1 words), however long the item is.
RUN = 25

#: Between the two halves of toks; no word.
BORDER = "\x01"
# Marks: no other token of a marked text begins with a digit.
NUMBER, NAME, UNIT = "0", "1", "2"
UNITS = (
    "mm|cm|m|km|inch|inches|ft|foot|feet|yard|yards|mile|miles|mg|g|kg|ton|tons|oz|lb|lbs|pound|pounds|ml|cl|l|liter|liters|litre|litres|"
    "s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|"
    "percent|degree|degrees|celsius|fahrenheit|dollar|dollars|cent|cents|euro|euros|usd|eur|gbp|kmh|mph|watt|watts|kw|kwh|volt|volts|hz|khz|mhz|ghz|kb|mb|gb|tb"
)


def marked(text: Column) -> Column:
    """The words of a text between single spaces: 0 before a number, 1 before a capitalised word, also at the
    beginning of a sentence (words in capitals alone are no names), 2 before a unit that follows a number; other words as they are, lower-cased. Punctuation goes."""
    # digits and letters are words of their own
    t = F.when(text.rlike(r"\p{N}"), F.regexp_replace(F.regexp_replace(text, r"(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})", " "), r"\p{N}+(?:[.,:/]\p{N}+)*", f"{NUMBER}$0")).otherwise(text)
    t = F.regexp_replace(t, r"\p{Lu}(?=\p{Ll})(?<![\p{L}\p{M}\p{N}].)", f"{NAME}$0")
    t = F.lower(F.regexp_replace(t, r"(?:[^\p{L}\p{N}\p{M}.,:/]|[.,:/](?!\p{N})|(?<!\p{N})[.,:/])+", " "))
    t = F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, rf"(\b{NUMBER}[\p{{N}}.,:/]+ )(?=(?:{UNITS})(?: |$))", f"$1{UNIT}")).otherwise(t)
    return F.trim(t)


def _sequences(d: DataFrame, *keep: str) -> DataFrame:
    """words: marked words; toks: the same with slots reduced to their marks, BORDER, and the literal words
    (marked as numbers only, so that none is a bare mark)."""
    m = d.withColumn("m", marked(F.col("text")))
    slotless = F.regexp_replace("m", r"(^| )([012])[^ ]+", "$1$2")
    literal = F.regexp_replace("m", r"(^| )[12]", "$1")
    return m.select(*keep, F.split("m", " ").alias("words"), F.split(F.concat(slotless, F.lit(f" {BORDER} "), literal), " ").alias("toks"))


def _hashed(widths: list[int]) -> Column:
    """Of the window of width tokens at at. The hash stays in compiled code: no lambda per word."""
    tok = lambda k: F.get("toks", F.col("at") + (k - 1))
    return F.xxhash64("width", "literal", *(tok(k) if k < min(widths) else F.when(F.col("width") > k, tok(k)) for k in range(max(widths))))


def _windows(d: DataFrame, widths: list[int]) -> DataFrame:
    """A row for each window of each width, typed and literal: at (from 1, in toks), pos (from 1, in words), width, literal and h.
    Windows across BORDER or the end meet nothing."""
    d = d.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("toks")))).withColumn("width", F.explode(F.array(*map(F.lit, widths))) if len(widths) > 1 else F.lit(widths[0]))
    d = d.withColumn("literal", F.col("at") > F.size("words"))
    return d.withColumn("pos", F.when(F.col("literal"), F.col("at") - F.size("words") - 1).otherwise(F.col("at"))).withColumn("h", _hashed(widths))


def benchmark_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """h, width, literal, item_id, part (not 0: a text without template windows), ipos, rank (of ipos), item_windows, i_toks,
    i_words (of typed windows): what a text can meet; and the widths."""
    d = id_text(items, item_col, text_col).where("doc_id is not null").distinct()
    seq = written(_sequences(d.withColumnRenamed("doc_id", "item_id"), "item_id"), "benchmark-sequences")
    n = F.size("words")
    seq = seq.where(F.get("words", F.lit(0)) != "").withColumn("width", F.least(n, F.lit(WINDOW)))
    widths = sorted(r[0] for r in seq.select("width").distinct().collect()) or [WINDOW]  # at most WINDOW
    starts = F.sequence(F.lit(1), n - F.col("width") + 1)
    typed = F.filter(starts, lambda p: F.size(F.filter(F.slice("toks", p, F.col("width")), lambda x: ~x.isin(NUMBER, NAME, UNIT))) >= F.when(F.col("width") < WINDOW, SHORT_LITERALS).otherwise(LITERALS))
    at = seq.withColumn("typed", typed).withColumn("part", F.when(F.size("typed") == 0, F.xxhash64("toks")).otherwise(F.lit(0)))
    whole = F.col("part") != 0
    at = at.withColumn("ipos", F.explode(F.when(whole, starts).otherwise(F.col("typed"))))
    at = at.withColumn("literal", F.explode(F.when(whole, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True))))).withColumn("at", F.when(F.col("literal"), F.col("ipos") + n + 1).otherwise(F.col("ipos")))
    i_words = F.when(F.col("literal"), F.array().cast("array<string>")).otherwise(F.slice("words", F.col("ipos"), F.col("width")))
    w = at.select(_hashed(widths).alias("h"), "width", "literal", "item_id", "part", "ipos", F.slice("toks", F.col("at"), F.col("width")).alias("i_toks"), i_words.alias("i_words")).distinct()
    w = w.withColumn("rank", F.dense_rank().over(Window.partitionBy("item_id", "part").orderBy("ipos")).cast("long"))
    return written(w.join(w.groupBy("item_id", "part").agg(F.count_distinct("ipos").alias("item_windows")), ["item_id", "part"]), "benchmark-windows"), widths


def _leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, share: float) -> DataFrame:
    windows, widths = benchmark_windows(items, item_col)
    few = windows.count() <= BROADCAST_ROWS
    d = id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    met = _windows(_sequences(d, "doc_id", "key"), widths).join(F.broadcast(windows.drop("width", "literal")) if few else windows.drop("width", "literal"), "h")
    # only slices of the few rows that met leave the compiled stage; lambdas wait until after the aggregation
    d_words, same = F.slice("words", F.col("pos"), F.size("i_words")), F.slice("toks", F.col("at"), F.col("width")) == F.col("i_toks")
    met = met.select("doc_id", "key", "item_id", "part", "item_windows", (F.col("pos") - F.col("ipos")).alias("shift"), F.struct("rank", "i_words", d_words.alias("d_words"), same.alias("same"), "literal").alias("w"))
    # of one alignment there are at most twice as many windows as the item has
    met = met.groupBy("doc_id", "key", "item_id", "part", "item_windows", "shift").agg(F.collect_set("w").alias("w"))
    # slots: the words that begin with a mark, as pairs of the item's and the text's
    slots = lambda x: F.filter(F.arrays_zip(x["i_words"].alias("i"), x["d_words"].alias("d")), lambda p: p["i"] < ":")
    met = met.withColumn("w", F.transform(F.filter("w", lambda x: x["same"]), lambda x: F.struct(x["rank"].alias("rank"), slots(x).alias("slots"), x["literal"].alias("literal"))))
    met = met.withColumn("pairs", F.array_distinct(F.flatten(F.transform("w", lambda x: x["slots"]))))
    # values of the item that stand for more than one value of the text
    torn = F.array_distinct(F.transform(F.filter("pairs", lambda p: F.size(F.filter("pairs", lambda q: q["i"] == p["i"])) > 1), lambda p: p["i"]))
    met = met.withColumn("torn", F.when(F.size("pairs") > 1, torn).otherwise(F.array().cast("array<string>")))
    good = F.filter("w", lambda x: ~F.exists(x["slots"], lambda p: F.array_contains(F.col("torn"), p["i"])))
    typed = F.transform(F.filter(good, lambda x: ~x["literal"]), lambda x: x["rank"])
    either = F.array_sort(F.array_distinct(F.transform(good, lambda x: x["rank"])))
    met = met.select("doc_id", "key", "item_id", "part", "item_windows", typed.alias("typed"), either.alias("either"), F.forall("pairs", lambda p: p["i"] == p["d"]).alias("exact"))

    starts = F.sequence(F.lit(1), F.size("either") - (RUN - 1))
    met = met.withColumn("run", F.when(F.size("either") >= RUN, F.exists(starts, lambda k: F.get("either", k + (RUN - 2)) - F.get("either", k - 1) == RUN - 1)).otherwise(False))

    def found(at: str) -> Column:
        matched = F.size(F.array_distinct(F.flatten(F.collect_set(at)))).cast("long")
        return F.struct(matched.alias("matched"), (matched / F.col("item_windows")).alias("share"), F.max(F.struct(F.size(at).alias("n"), "exact"))["exact"].alias("exact"))

    per = met.groupBy("doc_id", "key", "item_id", "part", "item_windows").agg(found("typed").alias("typed"), found("either").alias("either"), F.max(F.size("either")).alias("most"), F.bool_or("run").alias("run"))
    # literal windows speak where template windows alone do not suffice
    o = F.when(F.col("typed.share") >= share, F.col("typed")).otherwise(F.col("either"))
    enough = F.when(F.col("part") != 0, F.col("most") == F.col("item_windows")).otherwise((o["share"] >= share) | F.col("run"))
    return per.where(enough).select("doc_id", "key", "item_id", "item_windows", o.alias("o")).select("doc_id", "key", "item_id", "item_windows", "o.*")


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, whole or re-parameterised.

    Returns doc_id, item_id, item_windows, matched (windows of the item found, slots consistent; where
    these are too few, those whose words are equal count, too), share (under the least one where RUN windows in a row suffice),
    exact (the best alignment has the item's own numbers, names and units). A pair comes once, however
    often the row does; rows that share a doc_id but not the text come as their best pair. Clean documents have no row.
    Null and empty texts hold nothing; rows without doc_id are searched and come with a null one; items
    without id or words are not searched for; those without template windows (under LITERALS, or SHORT_LITERALS, words that are
    no slots in each) are found where a text has all their words, numbers included, in a row, and not
    re-parameterised: an item of one word is found wherever that word is. Extra columns are
    left out; empty tables give no rows. Items are broadcast only up to BROADCAST_ROWS windows, beyond
    that the join shuffles.
    """
    best = _leaks(docs, items, id_col, text_col, item_col, share)
    order = F.struct("matched", "exact", "item_windows", "share")
    return best.groupBy("doc_id", "item_id").agg(F.max(order).alias("o")).select("doc_id", "item_id", "o.item_windows", "o.matched", "o.share", "o.exact")


def drop_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns and all clean rows stay."""
    found = written(_leaks(docs, items, id_col, text_col, item_col, share).select("doc_id", "key").distinct(), "leaking-rows")
    return without(docs, found, id_col, text_col)
