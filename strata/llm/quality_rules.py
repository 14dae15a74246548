"""Operator 1: quality rules, a threshold table compiled into one projection.

``METRICS`` names counts of a text, each a Spark expression; ``RULES`` is the
table of limits.  ``quality_rules`` adds the counts and one verdict.  No user
function runs: everything is built-in, evaluated row by row without a shuffle,
so a hot source or copies cost nothing extra.

Defined results: a null text counts as no text (all counts 0, base_failed);
an empty or blank text likewise; repeated rows give repeated results; an
empty table gives an empty one; other columns of the input are dropped unless
named in ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import only

SPACE = r"\x20\x09-\x0D"

# Frequent function words of English, German, French, Spanish.
STOP_WORDS = tuple("""
a an and are as at be but by for from have in is it not of on or that the this to was were with
als am auf aus bei das dem den der des die ein eine für ich im ist mit nicht sich sie und von werden zu
au aux ce dans de du elle en est et il je la le les mais ne ou par pas pour que qui se sur un une
al como con del el ella es está la las lo los más no para pero por que se su sus una y
""".split())
STOP_FORMS = tuple(sorted({f for w in STOP_WORDS for f in (w, w.capitalize())}))


@dataclass(frozen=True)
class Rule:
    """``percent * unit`` bounds ``metric``: it fails when 100 * metric lies beyond."""

    name: str
    metric: str
    op: str  # "max" or "min"
    percent: int
    unit: str


RULES = (
    Rule("mean_word_min", "word_chars", "min", 150, "n_words"),
    Rule("mean_word_max", "word_chars", "max", 2000, "n_words"),
    Rule("symbols", "n_symbols", "max", 30, "n_words"),
    Rule("shouts", "n_shouts", "max", 40, "n_words"),
    Rule("capitals", "n_upper", "max", 50, "word_chars"),
    Rule("stop_words", "n_stop", "min", 3, "n_words"),
    Rule("dup_lines", "n_dup_lines", "max", 50, "n_lines"),
)


def _covered(positions: Column) -> Column:
    """How many words the 3-word windows at these sorted starts cover."""
    done = F.aggregate(positions, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("at")),
                       lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["at"])).alias("n"),
                                             x.alias("at")))
    return done["n"]


def _with_counts(df: DataFrame) -> DataFrame:
    t = F.col("text")
    blank = F.btrim(t, F.lit(" \t\n\x0b\x0c\r"))
    df = df.withColumns({
        "__w": F.when(blank == "", F.array().cast("array<string>")).otherwise(F.split(blank, f"[{SPACE}]+")),
        "__l": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_shouts": F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
    })
    w, n = F.col("__w"), F.size("__w")
    window = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_stop": F.size(F.filter(w, lambda x: x.isin(*STOP_FORMS))).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__h": F.transform(window, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
        "__high": F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(n.cast("long")))),
    })
    # a repeated window's key: its hash with the low bits replaced by its place,
    # so one sort of longs brings equal windows together, in order of place
    h, high, none = F.col("__h"), F.col("__high"), F.array().cast("array<bigint>")
    head, place = (lambda x: x.bitwiseAND(high)), (lambda x: x.bitwiseAND(F.bitwise_not(high)))
    df = df.withColumn("__k", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(
        h, lambda x, i: head(x).bitwiseOR(i.cast("long"))))).otherwise(none))
    k = F.col("__k")
    df = df.withColumn("__d", F.filter(k, lambda x, j: (head(x) == head(F.get(k, j - 1)))
                                       | (head(x) == head(F.get(k, j + 1)))))
    d = F.col("__d")

    def differ(x, y):
        i, j = place(x).cast("int"), place(y).cast("int")
        return (w[i] != w[j]) | (w[i + 1] != w[j + 1]) | (w[i + 2] != w[j + 2])

    clash = F.exists(F.transform(d, lambda x, j: F.when(head(x) == head(F.get(d, j + 1)), differ(x, F.get(d, j + 1)))),
                     lambda x: x)
    quick = _covered(F.sort_array(F.transform(d, place)))
    # two different windows of one text share a hash prefix: compare the words
    pairs = F.sort_array(F.transform(window, lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"),
                                                                 w[i + 2].alias("c"), i.cast("long").alias("i"))))
    key = lambda s: F.struct(s["a"], s["b"], s["c"])
    exact = F.element_at(F.transform(F.array(pairs), lambda p: _covered(F.sort_array(F.transform(F.filter(
        p, lambda x, j: F.when(j > 0, key(x) == key(p[F.greatest(j - 1, F.lit(0))])).otherwise(False)
        | F.when(j < F.size(p) - 1, key(x) == key(p[F.least(j + 1, F.size(p) - 1)])).otherwise(False)),
        lambda x: x["i"])))), 1)
    return df.withColumn("n_repeat_words", F.when(F.size(d) == 0, F.lit(0).cast("long"))
                         .when(F.coalesce(clash, F.lit(False)), exact).otherwise(quick))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50,
                  max_repeat_percent: int = 50, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the counts, base_failed, failed (names of the rules
    a text breaks) and kept."""
    df = _with_counts(only(docs, *keep, *([] if "text" in keep else ["text"])))
    beyond = []
    for r in rules:
        got, limit = F.col(r.metric) * 100, F.col(r.unit) * r.percent
        beyond.append(F.when(got > limit if r.op == "max" else got < limit, F.lit(r.name)))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    df = df.withColumns({"base_failed": base, "failed": F.array_compact(F.array(*beyond))})
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                     "n_shouts", "n_upper", "n_stop", "base_failed", F.array_join("failed", ",").alias("failed"),
                     (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def kept_documents(docs: DataFrame, keep: tuple[str, ...], **settings) -> DataFrame:
    """The ``keep`` columns of documents that pass.

    The counts of both are observed metrics of the query; that step also keeps
    the optimizer from moving the verdict's filter into the projections, where
    each use of a count would compute it anew."""
    df = quality_rules(docs, keep=keep, **settings)
    return df.observe("quality_rules", F.count(F.lit(1)).alias("documents"), F.count_if("kept").alias("kept")).where(
        "kept").select(*keep)


def rules_sql(rules: tuple[Rule, ...] = RULES, table: str = "documents") -> str:
    """The same counts and verdict as DuckDB SQL, from the definitions."""
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    fails = ", ".join(f"CASE WHEN 100 * {r.metric} {'>' if r.op == 'max' else '<'} {r.percent} * {r.unit} THEN '{r.name}' END"
                      for r in rules)
    return f"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {table}),
    w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
    s AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w),
    g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM s),
    r AS (SELECT rid, count(DISTINCT p) AS n FROM
            (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
    m AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
            CAST(length(list_aggregate(w.w, 'string_agg', '')) AS BIGINT) AS wc,
            CAST(length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(w.l) - len(list_distinct(w.l)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w.l) AS BIGINT) AS n_lines,
            CAST(length(regexp_replace(w.text, '[^!]+', '', 'g')) AS BIGINT) AS n_shouts,
            CAST(length(regexp_replace(w.text, '[^\\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
            CAST(len(list_filter(w.w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop
          FROM w LEFT JOIN r USING (rid)),
    v AS (SELECT * EXCLUDE (wc), coalesce(wc, 0) AS word_chars FROM m),
    f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
            concat_ws(',', {fails}) AS failed FROM v)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts, n_upper, n_stop,
           base_failed, failed, (NOT base_failed AND failed = '') AS kept FROM f"""
