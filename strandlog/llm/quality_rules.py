"""Operator 4: quality rules by distribution divergence.

Counts of a text's character classes and of its language's common words are
compared, by Jensen-Shannon distance (base 2), with those of the language's
reference: the totals of all its documents that pass the base rules. A
language's common words are learned: the ``COMMON`` short words, in lower case,
that most of its documents hold. Limits are learned too: multiples of the median distance
of the language's documents. A text is rejected if a base rule fails, if a
distance is far above its median, or if both are well above; each comparison
needs a minimum number of words.

All of it is DataFrame expressions. One pass over the texts counts the documents
of each word, another makes a narrow row of counts for each text (beside columns
that are to be kept); references and medians are sums over that table, and the
verdict joins them by language: no text is shuffled. References are broadcast
while languages are few; else rows are dealt by language and a salt.

Defined results: a null text has no words and fails the base rule. A null
language, or one with too few words in all, has no reference and is judged by
the base rules alone. Windows of five words are compared by a 64-bit hash.
Repeated rows are judged alike; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm.common import let, materialize, table, words_of

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Words below which a distance is not judged, and words a reference needs.
MIN_CLASS_WORDS, MIN_COMMON_WORDS, MIN_REFERENCE_WORDS = 60, 100, 2000
#: Common words of a language, bytes of one at most, and common words of all languages that a plan may hold as a set.
COMMON, COMMON_BYTES, SET_WORDS = 32, 16, 2000
#: Limits as multiples of the language's median distance: of each distance alone, and of both together.
#: Chosen on labelled documents of even doc_id, checked on odd ones.
CLASS_LIMIT, WORD_LIMIT = 2.4, 2.2
JOINT_CLASS_LIMIT, JOINT_WORD_LIMIT = 1.2, 1.7
CLASSES = ("lower", "upper", "digit", "symbol", "other")
#: References that may be broadcast (a few kB each); with more languages rows are dealt by language and one of so many salts.
BROADCAST_LANGUAGES, SALTS = 500, 64


def _count(text: Column, keep: str) -> Column:
    """Code points of the text that a character class holds."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
            return F.sort_array(F.transform(found, lambda k: F.get(s, k)["i"]))

        starts = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end")))["n"]

    once = let(words, lambda w: F.when(F.size(w) > WINDOW, let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))))
    return F.coalesce(once, F.lit(0)).cast("long")


def by_language(rows: DataFrame, refs: DataFrame, lang: str) -> DataFrame:
    """Rows with the columns of their language's row in ``refs``, null without one; a hot language is no hot key."""
    n = refs.count()
    if n <= BROADCAST_LANGUAGES:
        return rows.join(F.broadcast(refs), F.col("lang") == F.col(lang), "left")
    salted = refs.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars") if "n_words" in rows.columns else F.xxhash64("doc_id", "text"), F.lit(SALTS)))
    return rows.join(salted, (F.col("lang") == F.col(lang)) & (F.col("_salt") == F.col("_of")), "left").drop("_salt", "_of")


def common_words(docs: DataFrame) -> DataFrame:
    """top_lang, top (array): the words that most documents of a language hold, ties in order of the word."""
    held = F.array_distinct(words_of(F.lower(F.col("text"))))
    per = docs.filter(F.col("lang").isNotNull()).select("lang", F.explode(held).alias("word")).filter(F.octet_length("word") <= COMMON_BYTES).groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return per.withColumn("rank", rank).filter(F.col("rank") <= COMMON).groupBy(F.col("lang").alias("top_lang")).agg(F.sort_array(F.collect_list("word")).alias("top"))


def features(docs: DataFrame, top: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: base counts, class counts, counts of common words, and the columns to keep."""
    own = [c for c in keep if c not in ("doc_id", "lang")]
    docs = by_language(docs.select("doc_id", "lang", *(c for c in own if c != "text"), "text"), top, "top_lang")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    listed = F.coalesce("top", F.array().cast("array<string>"))
    # Of few languages a set of all their words sorts most others out at once.
    some = top.select(F.explode("top").alias("word")).distinct().limit(SET_WORDS + 1).collect()
    known = (lambda x: x.isin([r.word for r in some])) if some and len(some) <= SET_WORDS else (lambda x: F.array_contains(listed, x))
    common = F.filter(words_of(F.lower(text)), known)
    histogram = let(common, lambda c: F.transform(F.array_intersect(c, listed), lambda w: F.struct(w.alias("word"), (F.size(c) - F.size(F.array_remove(c, w))).alias("n"))))
    rest = F.regexp_replace(text, r"\p{L}+", "")
    out = docs.select(
        "doc_id",
        "lang",
        *own,
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        histogram.alias("_common"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _count(text, r"\p{Lu}").cast("long").alias("_upper"),
        F.length(text).cast("long").alias("_chars"),
        # Without its letters a text is short; what else is counted is counted there.
        let(rest, lambda r: F.struct(F.length(r).alias("all"), F.length(F.regexp_replace(r, r"[\x20\x09-\x0D]+", "")).alias("words"), _count(r, "#*$%&|<>").alias("symbols"), _count(r, r"\p{N}").alias("digits"))).alias("_r"),
    )
    letters, other = F.col("_chars") - F.col("_r.all"), F.col("_r.words").cast("long")
    out = out.select("doc_id", "lang", *own, "_w.*", "_common", "n_dup_lines", F.col("_r.symbols").cast("long").alias("n_symbols"), (letters + other).alias("word_chars"), F.array(letters - F.col("_upper"), "_upper", F.col("_r.digits").cast("long"), F.col("_r.symbols").cast("long"), other - F.col("_r.digits") - F.col("_r.symbols")).alias("_classes"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def references(counts: DataFrame) -> DataFrame:
    """ref_lang, ref_classes (shares), ref_common (word to share): a row per language, of documents that pass the base rules."""
    known = counts.filter(F.col("lang").isNotNull() & ~F.col("base_failed"))
    sums = [F.sum(F.get("_classes", F.lit(k))).alias(name) for k, name in enumerate(CLASSES)]
    totals = known.groupBy("lang").agg(F.sum("n_words").alias("words"), F.sum("word_chars").alias("chars"), *sums)
    per_word = known.select("lang", F.explode("_common").alias("c")).groupBy("lang", "c.word").agg(F.sum("c.n").alias("n"))
    shares = per_word.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("ns"))  # COMMON entries at most
    ref = totals.filter(F.col("words") >= MIN_REFERENCE_WORDS).join(shares, "lang", "left")
    ns = F.coalesce("ns", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")))
    return ref.select(F.col("lang").alias("ref_lang"), F.array(*(_share(F.col(c), F.col("chars")) for c in CLASSES)).alias("ref_classes"), F.transform_values(ns, lambda _, n: n / F.col("words")).alias("ref_common"))


def medians(judged: DataFrame) -> DataFrame:
    """med_lang, class_median, word_median: of a language's documents that pass the base rules; distances count by thousandths."""
    known = judged.filter(F.col("lang").isNotNull() & ~F.col("base_failed") & (F.col("n_words") >= MIN_CLASS_WORDS))
    middle = lambda c: F.percentile(F.round(c, 3), F.lit(0.5))  # noqa: E731  at most 1001 values are held
    return known.groupBy(F.col("lang").alias("med_lang")).agg(middle("class_distance").alias("class_median"), middle("common_distance").alias("word_median"))


def _share(n: Column, total: Column) -> Column:
    """n / total; 0 of nothing."""
    return F.coalesce(F.try_divide(n, total), F.lit(0.0))


def _term(p: Column, q: Column) -> Column:
    """What one category adds to twice the Jensen-Shannon divergence, in bits."""
    half = lambda x, y: F.when(x > 0, x * F.log2(F.try_divide(2 * x, x + y))).otherwise(0.0)
    return half(p, q) + half(q, p)


def distances(joined: DataFrame) -> tuple[Column, Column]:
    """Jensen-Shannon distances of the class and of the common-word distribution; null without a reference."""
    classes = sum((_term(_share(F.get("_classes", F.lit(k)), F.col("word_chars")), F.get("ref_classes", F.lit(k))) for k in range(len(CLASSES))), F.lit(0.0))
    listed = F.aggregate(F.map_values("ref_common"), F.lit(0.0), lambda a, q: a + q)
    share = lambda w: F.coalesce(F.try_element_at("ref_common", w), F.lit(0.0))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def add(a: Column, c: Column) -> Column:
        pair = F.struct(_share(c["n"], F.col("n_words")).alias("p"), share(c["word"]).alias("q"))
        return let(pair, lambda x: F.struct((a["d"] + _term(x["p"], x["q"])).alias("d"), (a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q")))

    seen = F.aggregate("_common", zero, add)
    # Words of the reference that the text lacks add their whole share; all other words are one category.
    words = let(F.struct(seen.alias("s"), listed.alias("l")), lambda x: x["s"]["d"] + F.greatest(x["l"] - x["s"]["q"], F.lit(0.0)) + _term(F.greatest(1 - x["s"]["p"], F.lit(0.0)), F.greatest(1 - x["l"], F.lit(0.0))))
    root = lambda twice: F.sqrt(F.greatest(twice, F.lit(0.0)) / 2)
    return root(classes), root(words)


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts, both distances, base_failed and kept (and the columns to keep) for every document."""
    top = materialize(common_words(docs), "quality-words")
    counts = materialize(features(docs, top, keep), "quality-counts")
    ref = materialize(references(counts), "quality-references")
    by_class, by_word = distances(by_language(counts, ref, "ref_lang"))
    joined = by_language(counts, ref, "ref_lang").withColumns({"class_distance": by_class, "common_distance": by_word})
    limits = materialize(medians(joined.select("lang", "base_failed", "n_words", "class_distance", "common_distance")), "quality-medians")
    out = by_language(joined.drop("ref_lang", "ref_classes", "ref_common", "_classes", "_common"), limits, "med_lang")
    above = lambda d, m, times: F.col(d) > F.col(m) * times
    long = F.col("n_words") >= MIN_CLASS_WORDS
    odd = long & above("class_distance", "class_median", CLASS_LIMIT) | (F.col("n_words") >= MIN_COMMON_WORDS) & above("common_distance", "word_median", WORD_LIMIT)
    odd |= long & above("class_distance", "class_median", JOINT_CLASS_LIMIT) & above("common_distance", "word_median", JOINT_WORD_LIMIT)
    return out.withColumn("kept", ~(F.col("base_failed") | F.coalesce(odd, F.lit(False)))).drop("med_lang", "class_median", "word_median")


def reject(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The documents that the rules keep, with the columns to keep; each row is judged by its own text and language."""
    return judge(docs, keep).filter("kept").select(*keep)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(*COLUMNS)


_HALF = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
_TERM = lambda p, q: f"({_HALF.format(x=p, y=q)} + {_HALF.format(x=q, y=p)})"

_FAILED = f"n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words"
_COUNTED = ("lower_case", "upper_case", "digits", "n_symbols", "others")

#: The same verdicts, with one row per word and document instead of arrays.
OP4_SQL = rf"""
WITH b AS (SELECT row_number() OVER () AS row_id, doc_id, lang, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT row_id, doc_id, lang, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters,
        length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper_case,
        length(regexp_replace(t, '[^\p{{N}}]+', '', 'g')) AS digits FROM b),
dl AS (SELECT row_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
       FROM (SELECT row_id, unnest(string_split(t, chr(10))) AS line FROM b) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_id),
g AS (SELECT row_id, i, w[i : i + 4] AS gram FROM (SELECT row_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
gr AS (SELECT row_id, i FROM g QUALIFY count(*) OVER (PARTITION BY row_id, gram) > 1),
rw AS (SELECT row_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM gr, range(5) AS r(k) GROUP BY row_id),
c AS (SELECT n.*, letters - upper_case AS lower_case, word_chars - letters - digits - n_symbols AS others,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {_FAILED} AS base_failed
      FROM n LEFT JOIN dl USING (row_id) LEFT JOIN rw USING (row_id)),
lw AS (SELECT row_id, lang, lower(word) AS word, count(*) AS n FROM (SELECT row_id, lang, unnest(w) AS word FROM b WHERE lang IS NOT NULL)
       WHERE strlen(lower(word)) <= {COMMON_BYTES} GROUP BY row_id, lang, lower(word)),
tp AS (SELECT lang, word FROM (SELECT lang, word, count(*) AS n FROM lw GROUP BY lang, word)
       QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON}),
cw AS (SELECT row_id, lang, word, count(*) AS n FROM (SELECT row_id, lang, lower(unnest(w)) AS word FROM b) JOIN tp USING (lang, word) GROUP BY row_id, lang, word),
ref AS (SELECT lang, sum(n_words) AS words, {', '.join(f"sum({x}) / sum(word_chars) AS q{k}" for k, x in enumerate(_COUNTED, 1))}
        FROM c WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang HAVING sum(n_words) >= {MIN_REFERENCE_WORDS}),
rc AS (SELECT lang, word, sum(n) / any_value(words) AS q FROM cw JOIN ref USING (lang) WHERE row_id IN (SELECT row_id FROM c WHERE NOT base_failed) GROUP BY lang, word),
rs AS (SELECT lang, sum(q) AS listed FROM rc GROUP BY lang),
cd AS (SELECT cw.row_id, sum({_TERM('cw.n / n.n_words', 'coalesce(rc.q, 0)')}) AS d, sum(cw.n / n.n_words) AS p, sum(coalesce(rc.q, 0)) AS q
       FROM cw JOIN n USING (row_id) LEFT JOIN rc ON rc.lang = cw.lang AND rc.word = cw.word GROUP BY cw.row_id),
j AS (SELECT c.*, sqrt(greatest({' + '.join(_TERM(f'({x} / word_chars)', f'q{k}') for k, x in enumerate(_COUNTED, 1))}, 0) / 2) AS dc,
        greatest(coalesce(cd.d, 0) + greatest(coalesce(listed, 0) - coalesce(cd.q, 0), 0), 0) AS dw,
        greatest(1 - coalesce(cd.p, 0), 0) AS po, greatest(1 - coalesce(listed, 0), 0) AS qo
      FROM c LEFT JOIN cd USING (row_id) JOIN ref ON ref.lang = c.lang LEFT JOIN rs ON rs.lang = c.lang),
v AS (SELECT *, sqrt(greatest(dw + {_TERM('po', 'qo')}, 0) / 2) AS dd FROM j),
m AS (SELECT lang, median(round(dc, 3)) AS mc, median(round(dd, 3)) AS mw FROM v WHERE NOT base_failed AND n_words >= {MIN_CLASS_WORDS} GROUP BY lang),
o AS (SELECT row_id, n_words >= {MIN_CLASS_WORDS} AND (dc > mc * {CLASS_LIMIT} OR dc > mc * {JOINT_CLASS_LIMIT} AND dd > mw * {JOINT_WORD_LIMIT})
        OR n_words >= {MIN_COMMON_WORDS} AND dd > mw * {WORD_LIMIT} AS odd FROM v JOIN m USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR coalesce(odd, FALSE)) AS kept
FROM c LEFT JOIN o USING (row_id)
"""
