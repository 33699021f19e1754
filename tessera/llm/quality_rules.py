"""Quality rules by distribution divergence: DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import SPACES

#: References of version 1, fixed values: of ten thousand words of running text of a language, how many are each common
#: word; of ten thousand word characters, how many are of each class. They don't depend on the documents that are judged.
COMMON_WORDS = {
    "en": {"the": 600, "of": 310, "and": 270, "to": 240, "a": 200, "in": 180, "is": 100, "that": 100, "it": 90, "for": 90, "was": 80, "on": 70, "with": 70, "as": 65, "by": 55, "be": 55, "are": 50, "this": 45, "at": 45, "from": 45, "not": 45, "or": 40, "have": 40, "but": 40},
    "fr": {"de": 550, "la": 300, "le": 230, "et": 200, "les": 170, "des": 140, "en": 120, "un": 105, "du": 105, "une": 90, "que": 90, "pour": 75, "est": 75, "dans": 70, "qui": 70, "au": 55, "par": 55, "sur": 50, "pas": 50, "avec": 45, "il": 60, "ne": 45, "plus": 40, "ce": 40},
    "de": {"der": 380, "die": 350, "und": 270, "in": 180, "den": 130, "von": 100, "zu": 95, "das": 95, "mit": 85, "sich": 65, "des": 70, "auf": 65, "ist": 65, "im": 65, "dem": 60, "eine": 55, "nicht": 60, "ein": 60, "als": 50, "auch": 40, "es": 45, "an": 45, "er": 40, "aus": 35},
    "es": {"de": 600, "la": 370, "que": 270, "el": 260, "en": 240, "y": 230, "los": 160, "se": 120, "las": 110, "del": 115, "un": 110, "por": 90, "con": 85, "no": 80, "una": 80, "su": 70, "para": 70, "al": 60, "es": 70, "lo": 50, "como": 45, "o": 40, "pero": 35, "sus": 35},
}
CLASS_SHARES = {
    "en": {"lower": 9380, "upper": 290, "digit": 60, "symbol": 10, "wide": 10, "mark": 250},
    "fr": {"lower": 9050, "upper": 260, "digit": 60, "symbol": 10, "wide": 370, "mark": 250},
    "de": {"lower": 9000, "upper": 560, "digit": 60, "symbol": 10, "wide": 150, "mark": 220},
    "es": {"lower": 9150, "upper": 260, "digit": 60, "symbol": 10, "wide": 250, "mark": 270},
    "other": {"lower": 9640, "upper": 0, "digit": 100, "symbol": 10, "wide": 0, "mark": 250},
}
#: Character classes, fixed values: what they don't cover; `lower` is a-z, `mark` the rest of the word characters. For
#: other languages than the four, all letters and characters above ASCII count as `lower`.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "symbol": "[^#*$%&|<>]+", "wide": r"[\x00-\x7F]+"}
SLOTS = [*CLASSES, "lower", "mark"]
LISTED = 24
WORD_SLOTS = [f"word{i}" for i in range(LISTED)]


def let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` bound to `value`, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(words: str) -> Column:
    """Words in windows of five words that the array holds twice or more, the first included.

    A window's name is a hash of its words' hashes, joined in pairs: (1 2)(3 4) 5.
    """
    five = let(
        f"transform({words}, w -> xxhash64(w))",
        "h",
        let(
            "zip_with(h, slice(h, 2, size(h)), (a, b) -> xxhash64(a, b))",
            "two",
            let(
                "zip_with(two, slice(two, 3, size(h)), (a, b) -> xxhash64(a, b))",
                "four",
                "zip_with(slice(four, 1, greatest(0, size(h) - 4)), slice(h, 5, size(h)), (a, b) -> xxhash64(a, b))",
            ),
        ),
    )
    covered = let(
        "sort_array(transform(g, (x, i) -> struct(x as x, i as i)))",
        "s",
        """aggregate(
          sort_array(transform(filter(s, (e, j) -> get(s, j - 1).x <=> e.x or get(s, j + 1).x <=> e.x), e -> e.i)),
          struct(0L as upto, 0L as n),
          (a, i) -> struct(cast(i + 5 as long) as upto, a.n + i + 5 - greatest(cast(i as long), a.upto) as n),
          a -> a.n)""",
    )
    return F.expr(let(five, "g", f"case when size(array_distinct(g)) = size(g) then 0L else {covered} end")).cast("long")


def by_tongue(values: dict[str, object], other: Column) -> Column:
    """The value of the row's language, as a literal."""
    out = F
    for tongue, value in values.items():
        out = out.when(F.col("tongue") == tongue, value)
    return out.otherwise(other)


def features(docs: DataFrame) -> DataFrame:
    """Base measures and both histograms of every document, text by text, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tongue = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise("other")
    words = F.array_remove(F.split(text, SPACES), "")
    base = docs.select("doc_id", tongue.alias("tongue"), text.alias("text"), words.alias("words"), F.regexp_replace(text, r"[a-z \t-\r]+", "").alias("odd"))
    listed = sorted({w for words_ in COMMON_WORDS.values() for w in words_})
    base = base.withColumn("common", F.filter("words", lambda w: w.isin(*listed)))  # a fifth of the words, and then no regex
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    lists = by_tongue({k: F.array(*map(F.lit, v)) for k, v in COMMON_WORDS.items()}, F.array(*[F.lit("")] * LISTED))
    seen = base.select(
        "doc_id",
        "tongue",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > 5, repeated_words("words")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("odd").cast("long").alias("odd"),
        *[F.length(F.regexp_replace("odd", v, "")).cast("long").alias(k) for k, v in CLASSES.items()],
        F.transform(lists, lambda w: F.size("common") - F.size(F.array_remove("common", w))).alias("hits"),
    )
    seen = seen.withColumn("lower", F.col("word_chars") - F.col("odd")).withColumn("mark", F.col("odd") - reduce(add, map(F.col, CLASSES)))
    return seen.drop("odd")


def distance(shares: list[tuple[Column, Column]]) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms, given as pairs of shares."""
    parts = []
    for p, q in shares:
        m = (p + q) / 2
        parts += [F.when(p > 0, p * F.log2(p / m)).otherwise(0.0), F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)]
    return F.sqrt(F.greatest(F.lit(0.0), reduce(add, parts) / 2))


def class_distance() -> Column:
    """Of the document's character classes to the language's; letters of all kinds are one class where the language has no list."""
    other = F.col("tongue") == "other"
    held = {k: F.col(k) for k in SLOTS} | {k: F.when(other, 0).otherwise(F.col(k)) for k in ("upper", "wide")}
    held["lower"] = F.when(other, F.col("lower") + F.col("upper") + F.col("wide")).otherwise(F.col("lower"))
    shares = []
    for k in SLOTS:
        q = by_tongue({t: F.lit(v[k] / 10_000) for t, v in CLASS_SHARES.items() if t != "other"}, F.lit(CLASS_SHARES["other"][k] / 10_000))
        shares.append((held[k] / F.col("word_chars"), q))
    return distance(shares)


def word_distance() -> Column:
    """Of the document's common words, and of all other words as one, to the language's."""
    shares = [(F.get("hits", F.lit(i)) / F.col("n_words"), by_tongue({t: F.lit([*v.values()][i] / 10_000) for t, v in COMMON_WORDS.items()}, F.lit(0.0))) for i in range(LISTED)]
    rest = F.col("n_words") - reduce(add, [F.get("hits", F.lit(i)) for i in range(LISTED)])
    shares.append((rest / F.col("n_words"), by_tongue({t: F.lit((10_000 - sum(v.values())) / 10_000) for t, v in COMMON_WORDS.items()}, F.lit(1.0))))
    return distance(shares)


def judge(docs: DataFrame, class_most: float = 0.25, word_most: float = 0.31, least_chars: int = 300, least_words: int = 100) -> DataFrame:
    """Base rules and divergence verdict of every document: its measures, class_js, word_js, base_failed, kept.

    A language's reference is its table of CLASS_SHARES and of COMMON_WORDS: a document's verdict follows from the
    document alone. It fails if its distance to a reference is above the limit, but the character classes count only
    from `least_chars` word characters and the common words only from `least_words` words: shorter histograms are too
    coarse to tell. A language without a table, and a null one, is judged by letters, digits, symbols and marks only.

    Defined results: a null text is an empty one, with zero measures, and fails the base rules; a very long text is
    judged whole; a distance at the limit passes; repeated rows, and rows of one or a null id, are judged alike, one by
    one; an empty table gives an empty one. Other columns are not read.
    """
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    class_js = F.when(F.col("word_chars") >= least_chars, class_distance())
    word_js = F.when((F.col("n_words") >= least_words) & (F.col("tongue") != "other"), word_distance())
    seen = features(docs).withColumn("base_failed", base_failed).withColumn("class_js", class_js).withColumn("word_js", word_js)
    kept = ~F.col("base_failed") & (F.coalesce("class_js", F.lit(0.0)) <= class_most) & (F.coalesce("word_js", F.lit(0.0)) <= word_most)
    return (
        seen.withColumn("kept", kept)
        .withColumnRenamed("symbol", "n_symbols")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_js", "word_js")
    )
