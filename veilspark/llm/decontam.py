"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

A window is a run of benchmark words. All documents are read once to count the words
that windows have; a window with a word that no document has is out. Of the others the two rarest
words are looked up: a second reading stores their postings (document, place), which is the index. Both
lists, with places moved back by the word's offset in the window, are intersected; what is
in both is compared word by word with the text. Lists that meet within a few words,
without the whole window being there, are proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import ascii_lower, clear_of, small, with_row_key

WINDOW = 13
#: places by which two rare words may be off in a proximity match
SLOP = 3
#: one hit word in so many makes a document contaminated
SHARE = 20
# Fixed value: what lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same before upper case is gone
BETWEEN_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for NULL."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BETWEEN), "")


def folded_words(text: Column) -> Column:
    """The same words with all letters lower-cased, which is much faster and joins no fewer of them."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN_CASED, " ")), " "), "")


def windows(benchmark: DataFrame, key: str = "item_id", text: str = "text", length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, words) and (win, item): all windows of all items; an item of fewer words is one window, one without words has none.

    A NULL key is the empty string; an item's texts, if it has several, count together.
    """
    words = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - length + 1, F.lit(1)))
    cut = words.where(F.size("all") > 0).select("item", "all", F.explode(starts).alias("at"))
    pairs = checkpoint(cut.select("item", F.slice("all", F.col("at"), length).alias("words")).distinct())
    wins = checkpoint(pairs.select("words").distinct().withColumn("win", F.monotonically_increasing_id()))
    return wins, pairs.join(wins, "words").select("win", "item")


def rarest(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, win, off, which): of each window that can occur its rarest (0) and next rarest (1) word, by place if equally rare."""
    spread = wins.select("win", F.size("words").alias("n"), F.posexplode("words").alias("off", "word")).withColumn("term", F.lower("word"))
    order = Window.partitionBy("win").orderBy("count", "off")
    ranked = (spread.join(counts, "term").withColumn("which", F.row_number().over(order) - 1)
              .withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("win"))).where("known = n and which < 2"))
    both = ranked.select("term", "win", "off", "which", "n")
    # a window of one word meets itself
    return both.unionByName(both.where("n = 1").withColumn("which", F.lit(1))).drop("n")


def index(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Postings (_k1, _k2, term, pos) of the terms in all documents."""
    return (docs.select("_k1", "_k2", F.posexplode(folded_words(F.col(text))).alias("pos", "term"))
            .join(small(terms), "term").select("_k1", "_k2", "term", "pos"))


def matches(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = SLOP,
            key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact matches (_k1, _k2, win, start, n), proximity matches (_k1, _k2, win, start, apart), and windows (win, item).

    docs have the row key of ``with_row_key``. A proximity match is where the two rarest words of a window
    are ``apart`` places, 0 to ``slop``, from their distance in it, and the window as a whole isn't there.
    """
    wins, items = windows(benchmark, length=length)
    terms = checkpoint(wins.select(F.explode("words").alias("word")).select(F.lower("word").alias("term")).distinct())
    seen = docs.select(F.explode(folded_words(F.col(text))).alias("term"))
    counts = checkpoint(seen.join(small(terms), "term").groupBy("term").count())
    anchors = checkpoint(rarest(wins, counts))
    postings = checkpoint(index(docs, checkpoint(anchors.select("term").distinct()), text))
    placed = (postings.join(small(anchors), "term")
              .select("_k1", "_k2", "win", (F.col("pos") - F.col("off")).alias("start"), "which"))
    # lists meet where their starts are at most slop apart; the rarer one goes to the one or two bins that may hold such a start
    width = 2 * slop + 2
    bin_of = lambda shift: F.floor((F.col("start") + shift) / width)
    first = placed.where("which = 0").select("_k1", "_k2", "win", "start", F.explode(F.array_distinct(F.array(bin_of(-slop), bin_of(slop)))).alias("bin"))
    second = placed.where("which = 1").select("_k1", "_k2", "win", F.col("start").alias("other"), bin_of(0).alias("bin"))
    met = checkpoint(first.join(second, ["_k1", "_k2", "win", "bin"]).withColumn("apart", F.abs(F.col("start") - F.col("other")))
                     .where(F.col("apart") <= slop).groupBy("_k1", "_k2", "win", "start").agg(F.min("apart").alias("apart")))
    found = met.where("apart = 0").drop("apart")
    # word by word, in the documents that have a candidate
    where = checkpoint(found.select("_k1", "_k2").distinct())
    texts = (docs.join(small(where), ["_k1", "_k2"], "left_semi")
             .select("_k1", "_k2", words_of(F.col(text)).alias("all")).dropDuplicates(["_k1", "_k2"]))
    spelt = found.join(small(wins), "win").groupBy("_k1", "_k2").agg(
        F.collect_list(F.struct("win", "start", "words")).alias("found"))
    exact = (texts.join(spelt, ["_k1", "_k2"])
             .select("_k1", "_k2", F.explode(F.filter("found", lambda c: F.slice(
                 F.col("all"), c["start"] + 1, F.size(c["words"])) == c["words"])).alias("c"))
             .select("_k1", "_k2", "c.win", "c.start", F.size("c.words").alias("n")))
    exact = checkpoint(exact)
    return exact, met.join(exact, ["_k1", "_k2", "win", "start"], "left_anti"), items


def judge(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, slop: int = SLOP, share: int = SHARE) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, n_near and contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the items with one, n_near
    the proximity matches. A document is contaminated with n_hit > 0 and share * n_hit >= n_words.
    NULL and empty texts have no words and are clean. Rows equal in doc_id and text get the same;
    columns with the names of the results are replaced; a benchmark without words leaves all clean; empty docs give none.
    """
    names = ("n_words", "n_hit", "n_items", "items_sha256", "n_near", "contaminated", "_k1", "_k2")
    docs = clear_of(docs, *names)
    keyed = with_row_key(docs)
    exact, near, items = matches(keyed.select("_k1", "_k2", "text"), benchmark, length, slop)
    hit = exact.groupBy("_k1", "_k2").agg(F.size(F.array_distinct(F.flatten(F.collect_list(
        F.sequence("start", F.col("start") + F.col("n") - 1))))).alias("n_hit"))
    of = (exact.select("_k1", "_k2", "win").distinct().join(items, "win").select("_k1", "_k2", "item").distinct()
          .groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items")))
    close = near.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n_near"))
    found = checkpoint(hit.join(of, ["_k1", "_k2"]).join(close, ["_k1", "_k2"], "full")
                       .withColumn("items_sha256", F.sha2("items", 256)).drop("items"))
    n_words = F.size(folded_words(F.col("text"))).cast("bigint")
    nil = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return (keyed.withColumn("n_words", n_words).join(small(found), ["_k1", "_k2"], "left")
            .select(*docs.columns, "n_words", nil("n_hit"), nil("n_items"),
                    F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), nil("n_near"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))))
