"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations alone.

Each benchmark item is cut into item-sized windows: every run of ``window``
consecutive words, or the whole item where it has fewer. A window is a set of
word shingles, and it is contained in a document only if all of them are. So the
join needs one token a window, the prefix of an order by rarity:

1.  Document shingles that some item has are looked up (their postings: place
    and document length); all documents count towards a shingle's frequency.
2.  Each window's shingles are ordered by that frequency. At full containment the
    necessary prefix is its single rarest shingle.
3.  A posting of that shingle is a candidate where the window's begin and end,
    placed by the shingle's offset, lie within the document.
4.  A candidate holds if the shingles that tile the window all stand at their
    places. Shingles are compared as text, so this is exact.

The benchmark's shingles are broadcast only below Spark's own size threshold;
above it the same join sorts and shuffles. A hot passage costs rows in
proportion to its occurrences, and documents meet no other documents.

Defined results: a null or wordless text has no words and no hits; an item
without words, or with a null id, gives no window; equal windows of several
items are one window that names all of them; rows of one id and text get equal
results; null document ids are kept; an empty table on either side gives no hits;
columns beyond the named ones are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import written

WINDOW, SHINGLE = 10, 5
#: Tasks, at least, that the places of one shingle are dealt to.
SPLIT = 16
#: What separates words, after A-Z became a-z: ASCII save digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words of a text; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, GAPS), "")


def once(value: Column) -> Column:
    """A generator that yields ``value`` alone: what is read from it more than once is still made once a row."""
    return F.explode(F.array(value))


def _gram(words: str, at: Column, size: int) -> Column:
    """``size`` words from ``at`` on, joined by spaces; null past the end."""
    parts = []
    for k in range(size):
        parts += [F.get(words, at + F.lit(k)), F.lit(" ")]
    return F.concat(*parts[:-1])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(windows, members): distinct windows (wid, len, q, words), and their items (wid, item_id)."""
    rows = items.select(F.col(id_col).alias("item_id"), once(word_list(F.col(text_col))).alias("words")).where("item_id is not null and size(words) > 0")
    size = F.least(F.size("words"), F.lit(window))
    cut = rows.select("item_id", "words", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    every = cut.select("item_id", "len", F.slice("words", F.col("at"), F.col("len")).alias("words"))
    named = every.select("item_id", "len", "words", F.sha2(F.concat_ws(" ", "words"), 256).alias("wid"))
    members = written(named, "windows")
    windows = members.groupBy("wid").agg(F.first("len").alias("len"), F.first("words").alias("words")).withColumn("q", F.least("len", F.lit(shingle)))
    return windows, members.select("wid", "item_id").distinct()


def hits(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(found, members): windows found (rid, start, len, wid), start counted from 0, and the windows' items.

    ``docs`` has rid (a row's key) and text.
    """
    windows, members = item_windows(items, id_col, item_text, window, shingle)
    at = F.explode(F.sequence(F.lit(0), F.col("len") - F.col("q"))).alias("off")
    sizes = [r.q for r in windows.select("q").distinct().collect()]  # at most ``shingle`` numbers
    cut = windows.select("wid", "len", "q", "words", at)
    gram = F.concat_ws(" ", F.slice("words", F.col("off") + 1, F.col("q")))
    tokens = written(cut.select("wid", "len", "q", "off", gram.alias("gram")), "shingles")

    words = docs.select("rid", once(word_list(F.col("text"))).alias("words"))
    placed = words.select("rid", "words", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    grams = [_gram("words", F.col("pos"), q) for q in sorted(sizes)] or [F.lit(None).cast("string")]
    looked = placed.select("rid", "n", "pos", (F.explode(F.array(*grams)) if len(grams) > 1 else grams[0]).alias("gram"))
    known = written(tokens.select("gram").distinct(), "grams")
    # a hot shingle's rows are dealt to SPLIT tasks; only the items' shingles are repeated for it
    salted = known.select("gram", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("salt"))
    postings = written(looked.withColumn("salt", F.pmod(F.hash("rid", "pos"), F.lit(SPLIT))).join(salted, ["gram", "salt"]).drop("salt").distinct(), "postings")

    frequency = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # an order by rarity; a shingle that no document has rules its window out
    ranked = tokens.join(frequency, "gram", "left").groupBy("wid").agg(F.first("len").alias("len"), F.first("q").alias("q"), F.min_by(F.struct("gram", "off"), F.struct(F.coalesce("df", F.lit(0)), "gram", "off")).alias("rare"), F.min(F.coalesce("df", F.lit(0))).alias("df"))
    prefix = ranked.where("df > 0").select("wid", "len", "q", "rare.gram", "rare.off")
    start = F.col("pos") - F.col("off")
    candidates = postings.join(prefix, "gram").where((start >= 0) & (start + F.col("len") <= F.col("n"))).select("rid", start.alias("start"), "len", "q", "wid").distinct()

    # shingles at 0, q, 2q ... and at the end tile the window
    tile = tokens.where("off % q = 0 or off = len - q").select("wid", "off", "gram")
    wanted = candidates.join(tile, "wid").select("rid", "start", "len", "q", "wid", (F.col("start") + F.col("off")).alias("pos"), "gram")
    standing = wanted.join(postings.select("rid", "pos", "gram"), ["rid", "pos", "gram"])
    tiles = F.floor((F.col("len") - F.col("q")) / F.col("q")) + F.when((F.col("len") - F.col("q")) % F.col("q") == 0, 1).otherwise(2)
    found = standing.groupBy("rid", "start", "len", "q", "wid").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") == tiles)
    return found.select("rid", "start", "len", "wid"), members


def row_key(id_col: str, text_col: str) -> Column:
    """A key shared only by rows of one id and text."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), F.coalesce(F.col(text_col), F.lit("\0")))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, rid, n_words, n_hit, items) for every row: word count, words inside found windows, and the items found, sorted as text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    found, members = hits(rows.select("rid", "text"), items, item_id, item_text, window, shingle)
    found = written(found, "hits")
    stop = F.col("start") + F.col("len")
    # ranges of one document in order of their start: what each adds beyond those before it
    earlier = F.max(stop).over(Window.partitionBy("rid").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1))
    ranges = found.select("rid", "start", "len").distinct()
    covered = ranges.select("rid", F.greatest(stop - F.greatest("start", F.coalesce(earlier, F.lit(0))), F.lit(0)).alias("new")).groupBy("rid").agg(F.sum("new").alias("n_hit"))
    named = found.select("rid", "wid").distinct().join(members, "wid").groupBy("rid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    marks = covered.join(named, "rid")
    counted = rows.select("doc_id", "rid", F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(marks, "rid", "left").select("doc_id", "rid", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
