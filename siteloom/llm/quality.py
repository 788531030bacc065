"""Quality rules with thresholds learnt for each language and source.

Plain DataFrame expressions throughout. Each measure of a document is a whole number; a
sketch of a measure is a table of bins and counts, so sketches of parts add up to the
sketch of the whole, whatever the order, and quantiles are exact to one bin. A limit is
the median plus or minus ``SPREAD`` times the distance between the quartiles plus one
step of the measure. A language and source with fewer than ``LEAST`` documents takes the
merged sketch of its language, a language with fewer that of all documents.

Defined cases: null text counts as empty (no words, so it fails the base rules); null
language or source form groups of their own; repeated rows are judged alike; very long
texts are measured whole; an empty table gives an empty result; :func:`keep_good` keeps
columns beyond the named ones whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize

_SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Base rules: least words; largest percentage of words in repeated windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Documents that a group needs for its own limits; width of limits.
LEAST, SPREAD = 100, 6
#: Measure: (expression in whole steps, one step of slack in the same unit, has a lower limit).
SKETCHED = {
    "word_length": ("least(4000, 20 * word_chars div n_words)", 2, True),
    "symbols": ("1000 * n_symbols div word_chars", 5, False),
    "dup_lines": ("least(4000, 1000 * n_dup_lines div n_words)", 20, False),
    "repeats": ("1000 * n_repeat_words div n_words", 50, False),
}


#: Bits of a packed window that hold its place; the others hold the start of its hash.
_PLACE = 20


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _repeated() -> str:
    """How many of the words ``w`` stand in windows that occur twice or more, as one expression.

    Every step is bound to a name once; a chain of columns in its place would be written
    out again by whatever filter is pushed below it.
    """
    high = lambda x: f"shiftrightunsigned({x}, {_PLACE})"
    low = lambda x: f"cast({x} & {(1 << _PLACE) - 1} as int)"
    window = lambda i: f"concat_ws(' ', w[{i}], w[{i} + 1], w[{i} + 2])"
    covered = lambda places: f"aggregate({places}, struct(0 AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)"
    windows = f"array_sort(transform(m, (x, i) -> struct({window('i')} as w, i as i)))"
    same = _let("s", windows, "array_sort(filter(transform(s, (x, k) -> CASE WHEN x.w = get(s, k - 1).w OR x.w = get(s, k + 1).w THEN x.i END), p -> p IS NOT NULL))")
    packed = f"sort_array(transform(m, (x, i) -> (x & {-(1 << _PLACE)}L) | i))"
    like = f"filter(p, (x, k) -> {high('x')} <=> {high('get(p, k - 1)')} OR {high('x')} <=> {high('get(p, k + 1)')})"
    clash = f"exists(transform(l, (x, k) -> k > 0 AND {high('x')} <=> {high('get(l, k - 1)')} AND {window(low('x'))} <> {window(low('get(l, greatest(k - 1, 0))'))}), b -> b)"
    by_hash = _let("p", packed, _let("l", like, f"CASE WHEN {clash} THEN {covered(same)} ELSE {covered(f'array_sort(transform(l, x -> {low("x")}))')} END"))
    twice = f"CASE WHEN size(array_distinct(m)) = size(m) THEN 0 WHEN size(m) > {1 << _PLACE} THEN {covered(same)} ELSE {by_hash} END"
    marks = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    return f"CASE WHEN size(w) < 3 THEN 0 ELSE {_let('m', marks, twice)} END"


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the five whole-text measures.

    ``n_repeat_words`` first hashes every window. Only where a hash occurs twice, windows
    are sorted as numbers, hash before place, and those with a neighbour of like hash are
    the repeated ones. If two neighbours turn out to differ in words, and in texts with
    more windows than a place can tell, the windows themselves are sorted and compared, so
    the result is exact.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = rf"regexp_extract_all(coalesce(`{text_col}`, ''), r'([^\x20\x09-\x0D]+)', 1)"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    n_dup = bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = F.expr(_let("w", words, f"struct(size(w) AS n, {_repeated()} AS repeats)"))
    return df.select(
        *df.columns,
        counted["n"].cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{_SYMBOLS}]")).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"),
        counted["repeats"].cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def sketches(measured: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``(level, lang, source, measure, bin, n)``: sketches by language and source (level 0),
    merged by language (1) and over all (3), of the documents that pass the base rules."""
    bins = F.array(*[F.struct(F.lit(name).alias("measure"), F.expr(how).cast("int").alias("bin")) for name, (how, _, _) in SKETCHED.items()])
    lang, source = keys
    fine = measured.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(bins).alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n"))
    grouped = fine.groupingSets([["measure", "bin", "lang", "source"], ["measure", "bin", "lang"], ["measure", "bin"]], "measure", "bin", "lang", "source")
    return grouped.agg(F.grouping_id().alias("level"), F.sum("n").alias("n"))


def limits(sketch: DataFrame) -> DataFrame:
    """``(lang, source, <measure>_lo, <measure>_hi)`` of each language and source of a sketch."""
    group = ["level", "lang", "source", "measure"]
    seen = sketch.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    at = [F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))).alias(f"q{k}") for k in (1, 2, 3)]
    quarts = seen.groupBy(*group).agg(F.max("total").alias("total"), *at)
    cols = []
    for name, (_, step, lower) in SKETCHED.items():
        wide = SPREAD * (F.col("q3") - F.col("q1") + step)
        mine = F.col("measure") == name
        cols += [F.max(F.when(mine, F.col("q2") + wide)).alias(f"{name}_hi")]
        cols += [F.max(F.when(mine, F.col("q2") - wide)).alias(f"{name}_lo")] if lower else []
    each = quarts.groupBy("level", "lang", "source").agg(F.max("total").alias("total"), *cols)
    names = [c for c in each.columns if c.endswith(("_hi", "_lo"))]
    own, by_lang, overall = (each.where(F.col("level") == k) for k in (0, 1, 3))
    a, b, c = own.alias("a"), by_lang.alias("b"), overall.alias("c")
    # One row a language, and one in all, join to the few groups.
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").join(c, F.col("c.level") == 3, "left")
    pick = [F.when(F.col("a.total") >= LEAST, F.col(f"a.{n}")).when(F.col("b.total") >= LEAST, F.col(f"b.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in names]
    return joined.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), *pick)


def within_limits() -> Column:
    ok = F.lit(True)
    for name, (how, _, lower) in SKETCHED.items():
        ok = ok & (F.expr(how) <= F.col(f"{name}_hi"))
        if lower:
            ok = ok & (F.expr(how) >= F.col(f"{name}_lo"))
    return ok


def judge(measured: DataFrame, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``measured`` (read twice, so a stored table) with ``base_failed`` and ``kept``."""
    found = limits(sketches(measured, keys))
    found = found.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in found.columns if c.endswith(("_hi", "_lo"))])
    same = F.col(keys[0]).eqNullSafe(F.col("_lang")) & F.col(keys[1]).eqNullSafe(F.col("_source"))
    joined = measured.withColumn("base_failed", base_failed()).join(found, same, "left")
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(within_limits(), F.lit(True)))
    return joined.select(*measured.columns, "base_failed", kept.alias("kept"))


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``(id, lang, source, measures, base_failed, kept)`` of every row."""
    rows = df.select(id_col, text_col, *keys)
    return judge(materialize(measures(rows, text_col).drop(text_col), "measures"), keys)


def keep_good(df: DataFrame, text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``df`` that the rules keep, measured in one pass over the texts."""
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(text_col).alias("text"), F.col(keys[0]).alias("lang"), F.col(keys[1]).alias("source"))
    return judge(materialize(measures(rows, "text").drop("text"), "measured")).where("kept").select("row.*")
