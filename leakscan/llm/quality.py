"""Quality rules: distribution divergence against language references.

``features`` computes, per document and inside the JVM, the base counts and two
histograms: character classes and common words of the document's language.
``references`` sums the histograms of all documents that pass the base rules, per
language: one row per reference language, so its size is proven. A second round sums
only what the first references keep, so that junk does not shape them.
``judge`` keeps a document if the base rules hold and neither histogram is further
from its reference than the limits, by Jensen-Shannon distance (base 2). A histogram
with fewer counts than its guard is not judged, and the limit for characters is wider
for short documents: a single key or address moves their histogram.

Defined results: null and empty texts have no words and fail the base rules; null and
unknown languages share the reference "other"; repeated rows are judged alike, each on
its own; extra input columns are ignored (``features`` takes ``doc_id, text, lang``).
Everything is map-only but for the sums of the references, at most
``len(languages) + 1`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import put

#: Frequent function words; the first listed language that a document names is used.
COMMON_WORDS = {
    "en": "the of and to in a is that it for with by as was on are this from or an be at".split(),
    "de": "der die und das in zu den mit von ist des sich auf für dem ein nicht im eine als auch es".split(),
    "fr": "de la le et les des en un une du que est pour qui dans au par sur pas ou il ne".split(),
    "es": "de la que el en y a los se del las un por con no una para su al lo como más".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "punct", "symbol", "non_ascii")


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. Distances lie in 0..1."""

    min_words: int = 50
    max_repeat_percent: int = 50
    class_limit: float = 0.10
    class_slack: float = 90.0   # allowed besides, divided by the number of characters
    word_limit: float = 0.40
    min_chars: int = 200        # guard of the character histogram
    min_common: int = 100       # guard of the word histogram: words of the document
    words: dict = field(default_factory=lambda: COMMON_WORDS)


def _bucket_sql(words: dict) -> str:
    return "CASE " + " ".join(f"WHEN lang = '{k}' THEN '{k}'" for k in words) + " ELSE 'other' END"


def _lists_sql(words: dict) -> str:
    """The common-word list of the language bucket as a SQL array."""
    both = sorted({w for ws in words.values() for w in ws[:5]})

    def arr(ws):
        return "array(" + ", ".join(f"'{w}'" for w in ws) + ")"

    return "CASE " + " ".join(f"WHEN ref_lang = '{k}' THEN {arr(ws)}" for k, ws in words.items()) + f" ELSE {arr(both)} END"


def features(docs: DataFrame, rules: QualityRules = QualityRules(), carry: list[str] = []) -> DataFrame:
    """doc_id, ref_lang, base counts, ``class_hist`` and ``word_hist`` (arrays of long), and the
    columns named in ``carry``."""
    width = max([len(w) for w in rules.words.values()] + [len({w for ws in rules.words.values() for w in ws[:5]})])
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(_bucket_sql(rules.words)).alias("ref_lang"), *carry)
    d = d.selectExpr(
        "doc_id", "ref_lang", "text", *carry,
        # split of the trimmed text has no empty parts
        r"CASE WHEN text RLIKE '[^\\x20\\x09-\\x0D]' THEN split(trim(BOTH ' \t\n\u000b\u000c\r' FROM text), '[\\x20\\x09-\\x0D]+') ELSE array() END AS words",
        r"CASE WHEN instr(text, '\n') = 0 THEN array() ELSE filter(split(text, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]') END AS lines",
        "char_length(text) AS n_chars", "octet_length(text) - char_length(text) AS n_extra",
        r"char_length(translate(text, ' \t\n\u000b\u000c\r', '')) AS word_chars",
        r"regexp_count(text, '[#*$%&|<>]') AS n_symbols",
        r"regexp_count(text, '[A-Z]') AS n_upper", r"regexp_count(text, '[0-9]') AS n_digit",
        r"regexp_count(text, '[!-\\/:-@\\[-`{-~]') AS n_marks",
    )
    d = d.selectExpr(
        "*", "size(words) AS n",
        "CASE WHEN size(words) < 3 THEN array() ELSE transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, words[i + 1], words[i + 2])) END AS h",
        f"transform(filter(transform(words, w -> array_position({_lists_sql(rules.words)}, lower(w))), p -> p > 0), p -> int(p)) AS pos",
    )
    # only texts in which a window comes twice are sorted
    d = d.selectExpr("*", "CASE WHEN size(array_distinct(h)) = size(h) THEN array() ELSE sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) END AS s")
    d = d.selectExpr("*", "sort_array(transform(filter(s, (e, k) -> (k > 0 AND s[k - 1].x = e.x) OR (k + 1 < size(s) AND s[k + 1].x = e.x)), e -> e.i)) AS starts")
    counts = ", ".join(f"bigint(size(pos) - size(array_remove(pos, {k})))" for k in range(1, width + 1))
    return d.selectExpr(
        "doc_id", "ref_lang", "bigint(n) AS n_words", "bigint(word_chars) AS word_chars", "bigint(n_symbols) AS n_symbols",
        "bigint(size(lines) - size(array_distinct(lines))) AS n_dup_lines",
        "bigint(aggregate(transform(starts, (x, k) -> CASE WHEN k + 1 < size(starts) THEN least(3, starts[k + 1] - x) ELSE 3 END), 0, (a, x) -> a + x)) AS n_repeat_words",
        # bytes beyond the first of a character stand for the characters outside ASCII
        "array(bigint(greatest(0, word_chars - n_upper - n_digit - n_marks - n_extra)), bigint(n_upper), bigint(n_digit), "
        "bigint(n_chars - word_chars), bigint(n_marks - n_symbols), bigint(n_symbols), bigint(n_extra)) AS class_hist",
        f"concat(array({counts}), array(bigint(n - size(pos)))) AS word_hist", *carry,
    )


def _sum_hist(col: str, width: int) -> str:
    return "array(" + ", ".join(f"sum({col}[{i}])" for i in range(width)) + ")"


def references(feats: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per reference language (at most ``len(rules.words) + 1``): summed histograms of
    all documents that pass the base rules."""
    width = max([len(w) for w in rules.words.values()] + [len({w for ws in rules.words.values() for w in ws[:5]})]) + 1
    return (feats.where(~F.expr(_base_sql(rules))).groupBy("ref_lang")
            .agg(F.expr(_sum_hist("class_hist", len(CLASSES))).alias("ref_class"), F.expr(_sum_hist("word_hist", width)).alias("ref_word")))


def _base_sql(rules: QualityRules) -> str:
    return f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)"


def js_distance_sql(p: str, q: str) -> str:
    """Jensen-Shannon distance (base 2) of two count arrays of the same length; 0 if either is empty."""
    sp = f"aggregate({p}, 0D, (a, x) -> a + x)"
    sq = f"aggregate({q}, 0D, (a, x) -> a + x)"
    terms = (f"zip_with(transform({p}, x -> x / {sp}), transform({q}, x -> x / {sq}), (x, y) -> "
             "(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0D END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0D END) / 2)")
    return f"CASE WHEN {sp} = 0 OR {sq} = 0 THEN 0D ELSE sqrt(greatest(0D, aggregate({terms}, 0D, (a, x) -> a + x))) END"


def judge(feats: DataFrame, refs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Adds ``base_failed``, both distances and ``kept``. ``refs`` is broadcast: its size is
    bounded by the number of reference languages."""
    d = feats.join(F.broadcast(refs), "ref_lang", "left")
    d = d.withColumns({
        "base_failed": F.expr(_base_sql(rules)),
        "class_distance": F.expr(f"CASE WHEN ref_class IS NULL OR aggregate(class_hist, 0L, (a, x) -> a + x) < {rules.min_chars} THEN 0D ELSE {js_distance_sql('class_hist', 'ref_class')} END"),
        "word_distance": F.expr(f"CASE WHEN ref_word IS NULL OR n_words < {rules.min_common} THEN 0D ELSE {js_distance_sql('word_hist', 'ref_word')} END"),
    })
    return d.withColumn("kept", F.expr(f"NOT base_failed AND class_distance <= {rules.class_limit}D + {rules.class_slack}D / greatest(1, aggregate(class_hist, 0L, (a, x) -> a + x)) AND word_distance <= {rules.word_limit}D"))


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Features, references and verdict of every document. The features (a few dozen
    numbers a row) are written once and read again; the texts are read once. Junk blurs
    the first references, so the documents they keep make the final ones."""
    feats = put(features(docs, rules), "quality")
    first = judge(feats, references(feats, rules), rules).where("kept").select(*feats.columns)
    return judge(feats, references(first, rules), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", "kept")


def keep(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns. Features are made once and
    written with the rows, as texts are cheaper to write and read than to count again."""
    cols = docs.columns
    d = docs.withColumn("row__", F.struct(*[f"`{c}`" for c in cols]))
    feats = put(features(d, rules, carry=["row__"]), "quality")
    numbers = feats.drop("row__")
    first = judge(numbers, references(numbers, rules), rules).where("kept").select(*numbers.columns)
    refs = put(references(first, rules), "quality-refs")
    # a filter would be pushed below the projections and repeat their expressions; a generator is not
    return judge(feats, refs, rules).select(F.inline(F.when(F.col("kept"), F.array("row__")).otherwise(F.slice(F.array("row__"), 1, 0))))
