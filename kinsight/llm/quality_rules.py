"""Quality rules by distribution divergence, with DataFrame functions only.

Two histograms of every document, of character classes and of common words,
are held against references of its language with the Jensen-Shannon distance.
The references are sums over all documents of the language, so they follow the
corpus. Short texts are not judged by a histogram: too few characters or words
make a noisy one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, words

#: Common words of each language (fixed values); a word of several languages counts in each.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "by"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "nicht", "ein"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con"),
}
#: Character classes: upper-case A-Z is left to the letters, all that is no letter, digit or white space is one class.
OTHER = r"[^\p{L}\p{N}\x20\x09-\x0D]"
SYMBOLS = ("#", "*", "$", "%", "&", "|", "<", ">")
#: Reject beyond these distances (0 equal, 1 disjoint) ...
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.29
#: ... of texts that have at least so many characters in words, or words.
MIN_CHARS = 400
MIN_WORDS = 100
#: Window starts are packed below the window's hash while they fit in so many bits.
PACK = 20


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and the struct ``m`` of counts and histograms.

    Repeated windows are found in one sorted array of longs: the upper bits of
    a window's hash over its start. Neighbours of equal upper bits are compared
    word by word; should any differ, or the text be longer than the packing
    allows, the row is redone with whole hashes.
    """
    common = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON.values() for w in v})
    w, other, packed, pairs, redo, starts, few, mine = (f"__{k}" for k in ("w", "other", "packed", "pairs", "redo", "starts", "few", "own"))
    kept = [F.col(c) for c in (docs.columns if keep is None else keep)]
    t, n = F.coalesce(F.col(text), F.lit("")), F.size(w)
    at = lambda i, k: F.get(F.col(w), i + k)
    hashed = lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2))
    positions = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    none, low = F.array().cast("array<bigint>"), (1 << PACK) - 1
    step = docs.select(*kept, t.alias("__t"), F.col(lang).alias("__l"), words(F.col(text)).alias(w), F.regexp_extract_all(t, F.lit(OTHER), F.lit(0)).alias(other))
    step = step.withColumn(
        packed,
        F.when(n < 3, none).otherwise(F.sort_array(F.transform(positions, lambda i: hashed(i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))),
    )
    beside = lambda x, j: F.shiftright(x, PACK) == F.shiftright(F.get(F.col(packed), j - 1), PACK)
    step = step.withColumn(
        pairs,
        F.transform(
            F.filter(F.transform(packed, lambda x, j: F.when(beside(x, j), F.struct(F.get(F.col(packed), j - 1).alias("a"), x.alias("b")))), lambda x: x.isNotNull()),
            lambda x: F.struct(x["a"].bitwiseAND(low).cast("int").alias("a"), x["b"].bitwiseAND(low).cast("int").alias("b")),
        ),
    )
    equal = lambda p: (at(p["a"], 0) == at(p["b"], 0)) & (at(p["a"], 1) == at(p["b"], 1)) & (at(p["a"], 2) == at(p["b"], 2))
    whole = F.sort_array(F.transform(positions, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))
    # a column of its own, so that a text is sorted once and not for each of its windows
    step = step.withColumn(redo, F.when(~((n <= low) & F.forall(pairs, equal)), whole))
    before = lambda j: F.get(F.col(redo), j - 1)
    redone = F.flatten(F.filter(F.transform(redo, lambda e, j: F.when(e["h"] == before(j)["h"], F.array(before(j)["i"], e["i"]))), lambda x: x.isNotNull()))
    step = step.withColumn(
        starts,
        F.sort_array(
            F.array_distinct(
                F.when(F.col(redo).isNull(), F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))).otherwise(redone)
            )
        ),
    )
    step = step.withColumn(few, F.filter(w, lambda x: x.isin(every))).withColumn(mine, F.coalesce(F.element_at(common, F.col("__l")), F.array(*map(F.lit, every))))
    covered = F.aggregate(
        F.transform(starts, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(F.col(starts), k - 1)))), F.lit(0), lambda a, x: a + x
    )
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = step.select(
        *kept,
        F.size(w).cast("bigint").alias("__n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("__word_chars"),
        F.size(F.filter(other, lambda x: x.isin(*SYMBOLS))).cast("bigint").alias("__n_symbols"),
        lines.alias("__lines"),
        covered.cast("bigint").alias("__n_repeat_words"),
        F.size(other).cast("double").alias("__other"),
        F.regexp_count("__t", F.lit("[0-9]")).cast("double").alias("__digits"),
        F.transform(mine, lambda k: F.size(F.filter(few, lambda x: x == k)).cast("double")).alias("__hits"),
        F.size(few).cast("double").alias("__few"),
    )
    return m.select(
        *kept,
        F.struct(
            F.col("__n_words").alias("n_words"),
            F.col("__word_chars").alias("word_chars"),
            F.col("__n_symbols").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
            F.col("__n_repeat_words").alias("n_repeat_words"),
            F.array(F.col("__digits"), F.col("__other"), F.greatest(F.col("__word_chars") - F.col("__digits") - F.col("__other"), F.lit(0.0))).alias("classes"),
            F.concat("__hits", F.array(F.greatest(F.col("__n_words") - F.col("__few"), F.lit(0.0)))).alias("common"),
        ).alias("m"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays of one length; 0 where either sums to 0."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    sp, sq = total(p), total(q)
    part = lambda x, y: F.when(x > 0, x * F.log2(x * 2 / (x + y))).otherwise(0.0)
    pairs = F.zip_with(p, q, lambda x, y: F.struct((x / sp).alias("p"), (F.coalesce(y, F.lit(0.0)) / sq).alias("q")))
    both = F.aggregate(F.transform(pairs, lambda z: part(z["p"], z["q"]) + part(z["q"], z["p"])), F.lit(0.0), lambda a, x: a + x)
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(both / 2, F.lit(0.0)))).otherwise(0.0)


def references(measured_: DataFrame, lang: str) -> DataFrame:
    """Summed histograms of each language of COMMON, and of all other documents together (key ''): at most five rows."""
    wide = len({w for v in COMMON.values() for w in v}) + 1
    sums = lambda name, n: F.array_compact(F.array(*[F.sum(F.get(F.col(f"m.{name}"), F.lit(k))) for k in range(n)]))
    return measured_.groupBy(_key(lang).alias("__lang")).agg(sums("classes", 3).alias("__classes"), sums("common", wide).alias("__common"))


def _key(lang: str) -> Column:
    return F.when(F.col(lang).isin(*COMMON), F.col(lang)).otherwise("")


def judge_quality(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    keep: list[str] | None = None,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """The columns ``keep`` of docs (all by default), ``m`` (the counts), ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    The texts are measured once; what was measured is written to the shared
    folder, from which both the references and the verdicts are read.

    A null text has no words, and fails the base rule as every text of under
    50 words does. A null or unknown language is judged by the reference of all
    such documents. A very long text is judged whole: beyond 2 ** PACK words its windows are told apart by whole hashes. Repeated rows are judged alike; an empty table gives no
    rows. Other columns stay, whatever their names, but for those named here.
    """
    kept = docs.columns if keep is None else keep
    counts = stored(measured(docs.withColumn("__of", F.col(lang)), text, lang, keep=[*kept, "__of"]), "quality")
    refs = references(counts, "__of")
    judged = counts.withColumn("__lang", _key("__of")).join(F.broadcast(refs), "__lang", "left")  # refs: at most five rows
    judged = judged.withColumn("class_distance", js_distance(F.col("m.classes"), F.col("__classes")))
    judged = judged.withColumn("word_distance", js_distance(F.col("m.common"), F.col("__common")))
    failed = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    far = ((F.col("m.word_chars") >= min_chars) & (F.col("class_distance") > max_class_distance)) | (
        (F.col("m.n_words") >= min_words) & (F.col("word_distance") > max_word_distance)
    )
    return judged.drop("__lang", "__of", "__classes", "__common").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_quality of all of documents; it says how odd rows are taken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = judge_quality(docs, keep=["doc_id"])
    return judged.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    lists = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in COMMON.items())
    every = ", ".join(repr(w) for w in sorted({w for v in COMMON.values() for w in v}))
    distance = lambda p, q: (
        f"(SELECT CASE WHEN sum(x) > 0 AND sum(y) > 0 THEN sqrt(greatest(sum(CASE WHEN x > 0 THEN x / sx * log2(2 * (x / sx) / (x / sx + y / sy)) ELSE 0 END"
        f" + CASE WHEN y > 0 THEN y / sy * log2(2 * (y / sy) / (x / sx + y / sy)) ELSE 0 END) / 2, 0)) ELSE 0 END"
        f" FROM (SELECT unnest({p}) AS x, unnest({q}) AS y, list_sum({p}) AS sx, list_sum({q}) AS sy))"
    )
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(repr(k) for k in COMMON)}) THEN lang ELSE '' END AS l,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lists(l, ws) AS (VALUES {lists}, ('', [{every}])
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         len(regexp_extract_all(t, '[0-9]'))::DOUBLE AS digits, len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\x20\x09-\x0D]'))::DOUBLE AS other,
         list_transform(ws, lambda k: len(list_filter(w, lambda x: x = k))::DOUBLE) AS hits, len(list_filter(w, lambda x: list_contains([{every}], x)))::DOUBLE AS few
  FROM d JOIN lists USING (l)
), h AS (
  SELECT *, [digits, other, greatest(word_chars - digits - other, 0)] AS classes, list_concat(hits, [greatest(n_words - few, 0)::DOUBLE]) AS common FROM m
), rc AS (SELECT l, list(s ORDER BY i) AS rc FROM (SELECT l, i, sum(v) AS s FROM (SELECT l, unnest(classes) AS v, generate_subscripts(classes, 1) AS i FROM h) GROUP BY l, i) GROUP BY l
), rw AS (SELECT l, list(s ORDER BY i) AS rw FROM (SELECT l, i, sum(v) AS s FROM (SELECT l, unnest(common) AS v, generate_subscripts(common, 1) AS i FROM h) GROUP BY l, i) GROUP BY l
), far AS (
  SELECT h.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, {distance('classes', 'rc')} AS dc, {distance('common', 'rw')} AS dw
  FROM h JOIN rc USING (l) JOIN rw USING (l) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (word_chars >= {MIN_CHARS} AND dc > {MAX_CLASS_DISTANCE}) AND NOT (n_words >= {MIN_WORDS} AND dw > {MAX_WORD_DISTANCE}) AS kept
FROM far
"""


OP8_SQL = _sql()
