"""Benchmark decontamination by template windows.

Numbers, units and names of a text become typed placeholders, so a benchmark question is found also when its values were replaced.
Windows of the resulting template are hash-joined with those of the benchmark. On the alignment found, the slots' values are
compared: in a re-parameterised question equal benchmark values stand against equal document values throughout.
Everything is column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import whole

WINDOW, LITERALS, COVERAGE, CONSISTENCY = 8, 4, 0.3, 0.5

#: Tokens in a row that are enough, however small their share of a long item: the usual choice of published n-gram checks.
RUN = 13

#: Forms of a window that are looked up: its words and values in lower case, the template with sure names only, and with all that may be names.
FORMS = ("plain", "closed", "open")

#: Windows of a benchmark that are broadcast at most (about 24 bytes each); more are joined by a shuffle. Results are equal.
BROADCAST_WINDOWS = 2_000_000

#: Units that may follow a number.
UNITS = (
    "%", "°c", "°f", "kg", "mg", "g", "km", "cm", "mm", "m", "ml", "l", "ms", "s", "min", "h", "khz", "mhz", "ghz", "hz", "kw", "w", "kb", "mb", "gb", "tb", "usd", "eur", "gbp", "€", "$", "£",
    "percent", "dollars?", "euros?", "pounds?", "miles?", "feet", "foot", "inch(?:es)?", "hours?", "minutes?", "seconds?", "days?", "weeks?", "months?", "years?", "liters?", "litres?", "meters?", "metres?",
)
MARK = "\x01"
# Each pattern looks at the character it begins with before it looks around.
NAME = r"(?=\p{Lu})(?<=[\p{Ll}\p{Nd}],?[ \n])(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"
#: Words that are no names where a sentence begins with them.
FUNCTION_WORDS = (
    "the", "a", "an", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "my", "your", "his", "her", "its", "our", "their", "who", "whom", "whose", "what", "which", "when",
    "where", "why", "how", "if", "unless", "while", "until", "since", "because", "although", "though", "whether", "as", "than", "then", "so", "and", "or", "but", "nor", "not", "no", "yes", "in", "on", "at", "of", "for",
    "from", "to", "into", "by", "with", "without", "about", "after", "before", "between", "during", "under", "over", "through", "there", "here", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did",
    "has", "have", "had", "can", "could", "will", "would", "shall", "should", "may", "might", "must", "all", "any", "both", "each", "every", "either", "neither", "some", "many", "much", "more", "most", "other", "another", "such", "only", "also",
)
MAYBE = r"(?=\p{Lu})(?<![\p{L}\p{N}])(?!(?:" + "|".join(w.capitalize() for w in FUNCTION_WORDS) + r")(?![\p{L}\p{N}]))(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"
NUMBER = r"(?=[-+\p{Nd}])(?<![\p{L}\p{N}])([-+]?\p{Nd}+(?:[.,:]\p{Nd}+)*)(?: ?((?i:" + "|".join(u.replace("$", r"\$") for u in UNITS) + r"))(?![\p{L}\p{N}])|(?![\p{L}\p{N}]))"
TOKEN = MARK + r"d[-+]?[\p{Nd}.,:]*\p{Nd}|" + MARK + r"u[\p{L}%°€$£]*|" + MARK + r"?[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words; placeholders are a mark, their type (d number, u unit, n name, m maybe a name) and their value.

    A number is always followed by a unit, which may be empty. A name is a capitalised word inside a sentence: after a lower-case
    word or number, perhaps a comma, and one blank. Other capitalised words, as where a sentence or quote begins, may be names unless they
    are function words.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), MARK, "")
    named = F.regexp_replace(clean, NAME, MARK + "n$1")
    named = F.regexp_replace(named, MAYBE, MARK + "m$1")
    numbered = F.regexp_replace(named, NUMBER, f" {MARK}d$1 {MARK}u$2 ")
    return F.regexp_extract_all(F.lower(numbered), F.lit(TOKEN), F.lit(0))


def templates(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, plain, closed, open, sure, free, slots): hashes per token of its lower-case value, of its template form with a maybe-name as a word,
    and of that with it as a name; whether it is a literal in the one and in the other; and (index, type, value) of the slots."""
    cut = rows.select(*keys, tokens(F.col("text")).alias("_tokens"))
    slot, word, maybe = (lambda w: w.startswith(MARK)), (lambda w: F.substring(w, 3, 1 << 20)), (lambda w: w.startswith(MARK + "m"))
    kind = lambda w: F.translate(F.substring(w, 2, 1), "m", "n")
    return cut.select(
        *keys,
        F.transform("_tokens", lambda w: F.xxhash64(F.when(maybe(w) | w.startswith(MARK + "n"), word(w)).otherwise(w))).alias("plain"),
        F.transform("_tokens", lambda w: F.xxhash64(F.when(maybe(w), word(w)).when(slot(w), F.substring(w, 1, 2)).otherwise(w))).alias("closed"),
        F.transform("_tokens", lambda w: F.xxhash64(F.when(slot(w), F.concat(F.lit(MARK), kind(w))).otherwise(w))).alias("open"),
        F.transform("_tokens", lambda w: (~slot(w) | maybe(w)).cast("int")).alias("sure"),
        F.transform("_tokens", lambda w: (~slot(w)).cast("int")).alias("free"),
        F.filter(F.transform("_tokens", lambda w, i: F.when(slot(w), F.struct(i.alias("i"), kind(w).alias("type"), word(w).alias("value")))), lambda s: s.isNotNull()).alias("slots"),
    )


def hashed(form: str, length: int) -> Column:
    """Hash of the window at ``pos``; what lies beyond the end is null and adds nothing."""
    return F.xxhash64(*[F.get(form, F.col("pos") + i) for i in range(length)])


def item_windows(made: DataFrame, window: int, *keys: str) -> DataFrame:
    """(keys, size, p, rich, loose, h): hashes of each window of an item, by its values and by the two templates. A template is used where it
    has literals enough: ``rich`` tells so for the closed one, ``loose`` for the open one.

    Fewer tokens than a window give one window of them all; none give none.
    """
    rows = made.where(F.size("plain") > 0).select("*", F.size("plain").alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("plain") - window, F.lit(0)))).alias("pos"))
    enough = lambda c: F.aggregate(F.slice(c, F.col("pos") + 1, window), F.lit(0), lambda a, x: a + x) >= F.least(F.lit(LITERALS), F.col("size"))
    judged = rows.select(*keys, "size", F.col("pos").alias("p"), enough("sure").alias("rich"), enough("free").alias("loose"), *[hashed(c, window).alias(c) for c in FORMS])
    each = F.array_distinct(F.array("plain", F.when(F.col("rich"), F.col("closed")), F.when(F.col("loose"), F.col("open"))))
    return judged.select(*keys, "size", "p", "rich", "loose", F.explode(each).alias("h")).where("h is not null")


def document_windows(made: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """(keys, pos, h): hashes of the windows of each length, by values and, where they differ, by the two templates."""
    size, least = F.size("plain"), min(lengths)
    rows = made.where(size >= least).select("*", F.explode(F.sequence(F.lit(0), size - least)).alias("pos"))
    cut = rows.select(*keys, "pos", size.alias("_size"), *[hashed(c, n).alias(f"_{c}{n}") for n in lengths for c in FORMS])
    there = lambda n, c: c if n == least else F.when(F.col("pos") + n <= F.col("_size"), c)
    each = []
    for n in lengths:
        plain, closed, loose = (F.col(f"_{c}{n}") for c in FORMS)
        each += [there(n, c) for c in (plain, F.when(closed != plain, closed), F.when(loose != closed, loose))]
    return cut.select(*keys, "pos", F.explode(F.array(*each)).alias("h")).where("h is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY, run: int = RUN) -> DataFrame:
    """Pairs of a document and a benchmark item it holds, per distinct document row.

    doc_id, doc_key (hash of id and text), item_id, item_key (hash of id and text), n_windows (distinct windows of the item that the document has), item_windows, coverage
    (their share, of all windows or of those with literals enough in either template, whichever is most), start_token and end_token of the best alignment,
    n_slots (aligned slots), slot_consistency (distinct item values per distinct pair of values; 1 without slots), kind ('verbatim' where all
    slots agree, else 'reparameterised').
    Returned are pairs with at least the given coverage, or ``run`` tokens of the item in a row, and at least the given consistency. Every window is looked up by its words and slot values without case, and by its
    template with at least four literal words: once with sure names, once with all words that may be names as slots. An item under ``window`` tokens is one window of its own length, which is looked up
    at each place of a document. Null and empty texts match nothing; null ids are kept,
    and different texts of one item_id are items of their own;
    repeated rows of a document, and of an item, count once; an empty table gives an empty result; other columns are ignored.
    """
    items = templates(benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("item_key")).distinct(), "item_id", "item_key")
    known = item_windows(items, window, "item_key").cache()
    # The lengths are at most ``window`` numbers.
    seen = known.agg(F.count("*").alias("n"), F.collect_set(F.least("size", F.lit(window))).alias("lengths")).first()
    # Else a merge join is asked for: Spark sizes the exploded windows of the documents like the documents, and may broadcast those.
    side = F.broadcast(known) if seen.n <= BROADCAST_WINDOWS else known.hint("merge")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"))
    found = document_windows(templates(keyed, "doc_id", "doc_key"), sorted(seen.lengths) or [window], "doc_id", "doc_key", "slots").join(side, "h")
    # Of the slots only those beside the item go on. A pair of windows counts once, whatever form it was found by.
    near = F.filter("slots", lambda x: (x["i"] >= F.col("shift")) & (x["i"] < F.col("shift") + F.col("size")))
    pairs = found.withColumn("shift", F.col("pos") - F.col("p")).withColumn("slots", near).groupBy("doc_key", "doc_id", "item_key", "shift", "p").agg(F.first("rich").alias("rich"), F.first("loose").alias("loose"), F.first("slots").alias("slots"))
    # An item window that a document repeats is new on one shift only.
    line, again = Window.partitionBy("doc_key", "doc_id", "item_key", "shift").orderBy("p"), Window.partitionBy("doc_key", "doc_id", "item_key", "p").orderBy("shift")
    marked = pairs.withColumn("new", (F.row_number().over(again) == 1).cast("int")).withColumn("island", F.col("p") - F.row_number().over(line))
    runs = marked.groupBy("doc_key", "doc_id", "item_key", "shift", "island").agg(
        F.count("*").alias("n"), F.sum("new").alias("new"), *[F.sum(F.col("new") * F.col(c).cast("int")).alias(c) for c in ("rich", "loose")], F.min("p").alias("first"), F.max("p").alias("last"), F.first("slots").alias("slots")
    )
    lines = runs.groupBy("doc_key", "doc_id", "item_key", "shift").agg(
        F.sum("n").alias("n"), F.max("n").alias("run"), F.sum("new").alias("new"), F.sum("rich").alias("rich"), F.sum("loose").alias("loose"), F.min("first").alias("first"), F.max("last").alias("last"), F.first("slots").alias("slots")
    )
    best = lines.groupBy("doc_key", "doc_id", "item_key").agg(
        F.sum("new").alias("n_windows"), F.sum("rich").alias("n_rich"), F.sum("loose").alias("n_loose"), F.max("run").alias("run"), F.max_by(F.struct("shift", "first", "last", "slots"), F.struct("n", -F.col("shift"))).alias("at")
    ).withColumn("slots", F.col("at.slots"))
    sizes = known.groupBy("item_key").agg(F.countDistinct("p").alias("item_windows"), *[F.countDistinct(F.when(F.col(c), F.col("p"))).alias(f"{c}_windows") for c in ("rich", "loose")], F.min(F.least("size", F.lit(window))).alias("length"))
    held = items.select("item_id", "item_key", F.col("slots").alias("item_slots")).join(sizes, "item_key")
    share = F.greatest(F.col("n_windows") / F.col("item_windows"), *[F.col(f"n_{c}") / F.nullif(f"{c}_windows", F.lit(0)) for c in ("rich", "loose")])
    joined = best.join(held, "item_key").withColumn("coverage", share).where((F.col("coverage") >= coverage) | (F.col("run") + F.col("length") > run))
    there = F.map_from_arrays(F.transform("slots", lambda s: s["i"]), F.transform("slots", lambda s: F.concat(s["type"], s["value"])))
    aligned = joined.withColumn("there", there).withColumn(
        "pairs",
        F.filter(
            F.transform(
                F.filter("item_slots", lambda s: (s["i"] >= F.col("at.first")) & (s["i"] < F.col("at.last") + F.col("length"))),
                lambda s: F.struct(F.concat(s["type"], s["value"]).alias("item"), F.try_element_at(F.col("there"), s["i"] + F.col("at.shift")).alias("doc")),
            ),
            lambda x: x["doc"].isNotNull(),
        ),
    )
    of_item, of_both = F.size(F.array_distinct(F.transform("pairs", lambda x: x["item"]))), F.size(F.array_distinct("pairs"))
    checked = aligned.withColumn("slot_consistency", F.when(of_both == 0, F.lit(1.0)).otherwise(of_item / of_both)).where(F.col("slot_consistency") >= consistency)
    return checked.select(
        "doc_id", "doc_key", "item_id", "item_key", "n_windows", "item_windows", "coverage", (F.col("at.first") + F.col("at.shift")).alias("start_token"),
        (F.col("at.last") + F.col("at.shift") + F.col("length")).alias("end_token"), F.size("pairs").alias("n_slots"), "slot_consistency",
        F.when(F.exists("pairs", lambda x: x["item"] != x["doc"]), "reparameterised").otherwise("verbatim").alias("kind"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item (see :func:`contamination`)."""
    bad = contamination(docs, benchmark, **settings).select("doc_key").distinct()
    keyed = docs.select(whole(docs).alias("row"), F.xxhash64("doc_id", "text").alias("doc_key"))
    return keyed.join(bad, "doc_key", "left_anti").select("row.*")
