"""Quality rules from the divergence of a document's histograms from its language's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweek.llm.storage import staged

#: Frequent words of each language; documents of other languages use the beginnings of all lists.
COMMON_WORDS = {
    "en": "the of and to in a is that for it with be".split(),
    "de": "der die und in den von zu das mit des für ein".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y los del se las por un".split(),
}
OTHER = "other"
LISTS = COMMON_WORDS | {OTHER: [w for words in COMMON_WORDS.values() for w in words[:3]]}
WORDS = 12
LONGEST = max(len(w) for words in LISTS.values() for w in words)
#: Character classes, stripped from the text one after the other; what is left is the last class.
CLASSES = [r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", r"\s+", r"\p{Lu}+", r"\p{N}+", r"[.,;:'’\"()?\-]+", r"[#*$%&|<>]+"]
SPACE = " \t\n\x0b\f\r"
WINDOW = 8
PLACE_BITS = 20
#: A histogram is judged from these sizes on, and rejected beyond these distances.
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.10
#: What chance adds to the distance of n words: so much over the root of n.
WORD_NOISE = 2.0


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each row of ``docs`` as ``row``, with its counts and histograms.

    Repeated windows are found in the row: windows are hashed, and only a text whose hashes
    aren't all different has them sorted, so the work stays n log n for texts of any length.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.lower(F.col(lang).cast("string")) if lang in docs.columns else F.lit(OTHER)
    key = F.when(key.isin(*COMMON_WORDS), key).otherwise(F.lit(OTHER))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), value.alias("_text"), key.alias("_lang"))
    trimmed = F.btrim("_text", F.lit(SPACE))
    base = base.withColumn(
        "_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    )
    n = F.size("_words")
    windows = F.when(n >= WINDOW, _window_hashes(F.col("_words"))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    left, sizes = F.col("_text"), [F.length("_text")]
    for c in CLASSES:
        left = F.regexp_replace(left, c, "")
        sizes.append(F.length(left))
    sizes.append(F.lit(0))
    base = base.select(
        "row", "_lang",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.array(*[a - b for a, b in zip(sizes, sizes[1:])]).alias("_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"),
        # Longer words can't be common ones.
        F.lower(F.regexp_replace(
            F.concat(F.lit(" "), F.array_join("_words", "  "), F.lit(" ")), f"[^ ]{{{LONGEST + 1},}}  ?", ""
        )).alias("_joined"),
    )
    lists = F.create_map(*[F.lit(x) for k, w in LISTS.items() for x in (k, F.array(*map(F.lit, w)))])
    seen = F.transform(
        lists[F.col("_lang")],
        lambda w: (
            (F.octet_length("_joined") - F.octet_length(F.replace("_joined", F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))))
            / (F.octet_length(w) + 2)
        ).cast("int"),
    )
    repeats = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(
        _covered(F.col("_windows"))
    )
    return base.select(
        "row", "_lang", "n_words", "word_chars", F.col("_chars")[5].cast("long").alias("n_symbols"),
        "n_dup_lines", repeats.cast("long").alias("n_repeat_words"), "_chars", seen.alias("_common"),
    )


def _window_hashes(words: Column) -> Column:
    """Hash of every window of ``WINDOW`` (a power of two) words, from hashes of half windows."""
    def joined(step: int):
        """Hashes of windows twice as wide as the hashed ones, which are ``step`` words."""
        return lambda h: F.zip_with(
            F.slice(h, 1, F.size(h) - step), F.slice(h, step + 1, F.size(h) - step), lambda a, b: F.xxhash64(a, b)
        )

    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < WINDOW:
        hashes, step = let(hashes, joined(step)), 2 * step
    return hashes


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Places sort by hash. While they fit in the low bits of the hash, hash and place share one
    long, which sorts far faster than pairs; a text in which the shortened hashes of different
    windows meet, or a longer one, sorts pairs.
    """
    low = (1 << PLACE_BITS) - 1
    keys = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def near(x: Column, y: Column) -> Column:
        return F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0

    def twice(k: Column) -> Column:
        """Keys with an equal neighbour."""
        return F.filter(k, lambda x, j: F.coalesce(
            near(x, F.get(k, j + 1)) | ((j > 0) & near(x, F.get(k, j - 1))), (j > 0) & near(x, F.get(k, j - 1))))

    def full(x: Column) -> Column:
        return F.get(windows, x.bitwiseAND(F.lit(low)).cast("int"))

    def mixed(t: Column) -> Column:
        return F.exists(F.sequence(F.lit(1), F.size(t) - 1), lambda j: (
            near(F.get(t, j), F.get(t, j - 1)) & (full(F.get(t, j)) != full(F.get(t, j - 1)))))

    def same(s: Column, j: Column, x: Column) -> Column:
        return (j >= 0) & (j < F.size(s)) & (F.get(s, j)["h"] == x["h"])

    slow = let(pairs, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, j: same(s, j - 1, x) | same(s, j + 1, x)), lambda x: x["i"])))
    fast = let(let(keys, twice), lambda t: F.when(
        (F.size(t) > 1) & ~mixed(t), F.sort_array(F.transform(t, lambda x: x.bitwiseAND(F.lit(low)).cast("int")))))
    places = F.coalesce(F.when(F.size(windows) <= low, fast), slow)

    def width(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, j - 1))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return let(places, width)


def references(counted: DataFrame) -> DataFrame:
    """Summed histograms of every language over the given documents.

    At most one row for each language listed above and one for the others.
    """
    sums = [F.sum(F.col("_chars")[k]).cast("double") for k in range(len(CLASSES) + 1)]
    words = [F.sum(F.col("_common")[k]).cast("double") for k in range(WORDS)]
    return counted.groupBy("_lang").agg(
        F.array(*sums).alias("_ref_chars"), F.array(*words).alias("_ref_common"),
        F.sum("n_words").cast("double").alias("_ref_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (root of the divergence in bits) of two count arrays of one length."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def shares(a: Column) -> Column:
        return let(F.aggregate(a, F.lit(0.0), lambda s, x: s + x),
                   lambda total: F.transform(a, lambda x: F.when(total > 0, x / total).otherwise(0.0)))

    terms = F.zip_with(shares(p), shares(q), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def with_distances(counted: DataFrame, refs: DataFrame) -> DataFrame:
    """Add both distances from the references, and ``kept``."""
    # One row a listed language bounds the broadcast.
    joined = counted.join(F.broadcast(refs), "_lang", "left")
    with_rest = lambda a, n: F.concat(
        a, F.array(F.greatest(F.lit(0.0), n - F.aggregate(a, F.lit(0.0), lambda s, x: s + x)))
    )
    chars = F.transform("_chars", lambda x: x.cast("double"))
    words = F.transform("_common", lambda x: x.cast("double"))
    n_chars = F.aggregate("_chars", F.lit(0), lambda s, x: s + x)
    n = F.col("n_words").cast("double")
    guard = lambda enough, d: F.when(enough & F.col("_ref_words").isNotNull(), d).otherwise(0.0)
    joined = joined.withColumns({
        "char_distance": guard(n_chars >= MIN_CHARS, jensen_shannon(chars, F.col("_ref_chars"))),
        "word_distance": guard(F.col("n_words") >= MIN_WORDS, jensen_shannon(
            with_rest(words, n), with_rest(F.col("_ref_common"), F.col("_ref_words")))),
    })
    return joined.withColumn(
        "kept",
        ~F.col("base_failed") & (F.col("char_distance") <= MAX_CHAR_DISTANCE)
        & (F.col("word_distance") <= MAX_WORD_DISTANCE + WORD_NOISE / F.sqrt(F.greatest(n, F.lit(1.0)))),
    ).drop("_ref_chars", "_ref_common", "_ref_words")


def with_verdict(counted: DataFrame) -> DataFrame:
    """Add both distances, ``base_failed`` and ``kept``.

    The first references come from all documents that pass the base rules; the final ones
    from those of them that lie close to the first.
    """
    based = counted.withColumn("base_failed", base_failed())
    first = with_distances(based, references(based.where("not base_failed"))).where("kept")
    return with_distances(based, references(first))


VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
           "char_distance", "word_distance")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: ``row`` (the document), its counts, both distances, the verdict.

    A document is rejected by the base rules, or when its character classes or its common
    words lie too far from its language's reference; shorter documents than the guards are
    spared that test. References are summed over all documents that pass the base rules
    and lie close to a first reference.
    Null and empty texts have no words and fail the base rules. Documents of an unlisted or
    null language share one reference. Repeated rows are judged alike, an empty table gives no
    rows, and extra columns, whatever their names, stay inside ``row``.
    """
    return with_verdict(staged(counts(docs, text, lang), "counts"))


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the verdict columns of every document."""
    ids = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []))
    slim = counts(ids).withColumn("row", F.struct(F.col("row.doc_id").alias("doc_id")))
    return with_verdict(staged(slim, "counts")).select(F.col("row.doc_id").alias("doc_id"), *VERDICT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they were."""
    return judged(docs).where("kept").select("row.*")
