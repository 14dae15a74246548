"""Operator 8: line dedup by a segment-partition edit join, DataFrame functions only.

A line of ``min_chars`` characters or more goes if an earlier line of the
corpus (by doc_id, then place in its document) equals it or is one edit away
(a character put in, left out or replaced).  Shorter lines stay.

Equal lines first become one: hashes of 128 bits, counted with partial sums,
give each line's first place and carry its keys along; a text is moved only if
its line shares a key.  Distinct lines are cut into two segments, one
more than the edits; one edit leaves one segment as it is, and where it stands
follows from the two lengths.  So each line is indexed under its segments by
(segment, length) and looked up under those that a line shorter by one would
have: four keys a line.  Keys that only one line has are dropped before the
join.  Candidates are verified exactly by a bit-parallel automaton over the
band of three diagonals.

A key with more than ``BUCKET`` rows (a common half line) is not paired.  Its
lines are keyed instead by the line without each character in turn and by the
line with a gap at each place: lines that share such a key are one edit apart,
all of them, so all but the least place go and no pair is made.

With ``words`` (the pipeline) a line also goes if an earlier one becomes equal
by one word put in, left out or replaced, if that word and its space are at
most ``WORD`` characters and at most a tenth of the rest.  Half of such a line
stays, counted in words, so lines without a half in common drop out.  The
others are keyed by their line without each word in turn, and as they are with
a gap at each place; of equal keys all but the least place go, so a common
line makes no pairs.

Defined results: a null or empty text has no lines to remove; a null doc_id
comes after all others; a document is a doc_id (or none) and a text: rows that
repeat both are one document and each gets its result, rows with one doc_id
and different texts are documents of their own, in the order of the texts'
hashes; an empty table gives an empty result; other columns are dropped
(``dedup_documents`` keeps those named).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, only

MIN_CHARS = 30
BUCKET = 32  # lines of a key that are paired
WORD = 20
BLOCK = 256
LAST = (1 << 63) - 1  # the place of a null doc_id in SQL


def _part(c: Column, start, stop) -> Column:
    """Code points start to stop (exclusive)."""
    return F.substr(c, F.lit(1) + start, F.greatest(stop - start, F.lit(0)))


def _document() -> Column:
    """A document's identity, null doc_ids last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                    F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """d, line, text of each line long enough."""
    t = only(docs, "doc_id", "text")
    return t.select(_document().alias("d"), F.posexplode(F.split("text", "\n")).alias("line", "text")
                    ).where((F.length("text") >= min_chars) & F.col("text").rlike(r"\S"))


def _segments() -> Column:
    """Hashes of the two segments: as indexed, then as looked up."""
    t, n = F.col("text"), F.length("text")

    def keys(n: Column, shift: int):
        half = F.floor(n / 2).cast("int")
        return [F.xxhash64(F.lit(i), n, part) for i, part in enumerate((_part(t, F.lit(0), half), _part(t, half + shift, n + shift)))]

    return F.array(*keys(n, 0), *keys(n - 1, 1))


def _segment_rows(lines: DataFrame) -> DataFrame:
    """key, indexed, d, line of lines with their ``segments``."""
    return lines.select("d", "line", F.posexplode("segments").alias("i", "key")).select(
        "key", (F.col("i") < 2).alias("indexed"), "d", "line")


def segment_keys(lines: DataFrame) -> DataFrame:
    """key, d, line, indexed (else looked up) of the two segments."""
    return _segment_rows(lines.select("d", "line", _segments().alias("segments")))


def _pairs(rows: DataFrame) -> DataFrame:
    """Places a, b of lines that share a key: one indexed, the other either
    indexed too (same length; each pair once) or looked up."""
    a, b = rows.where("indexed").alias("a"), rows.alias("b")
    later = (F.col("a.d") < F.col("b.d")) | ((F.col("a.d") == F.col("b.d")) & (F.col("a.line") < F.col("b.line")))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (later | ~F.col("b.indexed"))).select(
        F.col("a.d").alias("ad"), F.col("a.line").alias("al"), F.col("b.d").alias("bd"), F.col("b.line").alias("bl"))


def within_edits(a: Column, b: Column, edits: int = 1) -> Column:
    """Whether a and b are at most ``edits`` apart.

    An automaton over the band: bit x + edits of state e is set where the read
    part of b can become that of a plus x characters with e edits.  One step
    reads a character of b for all diagonals at once."""
    band, width = (1 << 2 * edits + 1) - 1, range(-edits, edits + 1)
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    start = F.struct(*[F.lit(sum(1 << x + edits for x in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)],
                     F.lit(0).alias("at"))

    def step(ca):
        def read(s, c):
            same = sum((F.when(F.get(ca, s["at"] + x) == c, F.lit(1 << x + edits)).otherwise(0) for x in width), F.lit(0))
            out = [s["r0"].bitwiseAND(same)]
            for e in range(1, edits + 1):
                less = s[f"r{e - 1}"]
                out.append(s[f"r{e}"].bitwiseAND(same).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1))
                           .bitwiseOR(F.shiftleft(out[-1], 1)).bitwiseAND(F.lit(band)))
            return F.struct(*[r.alias(f"r{e}") for e, r in enumerate(out)], (s["at"] + 1).alias("at"))
        return read

    # chars is bound once for all steps
    last = F.element_at(F.transform(F.array(chars(a)), lambda ca: F.aggregate(chars(b), start, step(ca))), 1)
    gap = F.length(a) - F.length(b)
    hit = sum((F.when(gap == x, last[f"r{edits}"].bitwiseAND(F.lit(1 << x + edits))).otherwise(0) for x in width), F.lit(0))
    return F.when(F.abs(gap) > edits, F.lit(False)).otherwise(hit != 0)


def _halves() -> Column:
    """Hashes of the two halves in words, as _segments."""
    w = F.split("text", " ")
    n = F.size(w)

    def keys(n: Column, shift: int):
        half = F.floor(n / 2).cast("int")
        return [F.xxhash64(F.lit(i), n, part) for i, part in enumerate((
            F.slice(w, F.lit(1), half), F.slice(w, half + 1 + shift, n - half)))]

    return F.array(*keys(n, 0), *keys(n - 1, 1))


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(parts: Column) -> Column:
    """Hashes of the first 0, 1, ... parts; in blocks, so that a line of very
    many words is not copied once for each."""
    scan = lambda x: F.aggregate(x, F.array(F.lit(0).cast("long")), lambda s, v: F.concat(
        s, F.array(F.xxhash64(F.element_at(s, -1), v))))

    def whole(blocks):
        return _bind(scan(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda before: F.flatten(F.transform(
            blocks, lambda b, i: F.transform(F.slice(b, 1, BLOCK), lambda x: F.xxhash64(F.get(before, i), x)))))

    return _bind(parts, lambda ps: _bind(F.transform(F.sequence(F.lit(0), F.floor(F.size(ps) / BLOCK).cast("int")), lambda i: scan(
        F.slice(ps, i * BLOCK + 1, F.lit(BLOCK)))), whole))


def word_keys(lines: DataFrame) -> DataFrame:
    """before, after (hashes), d, line: the line without each word that may
    change, and with a gap at each place."""
    w = F.split("text", " ")
    rows = lines.select("d", "line", "text", w.alias("w"), _running(w).alias("up"), _running(F.reverse(w)).alias("down"))
    n, size = F.size("w"), F.length("text")
    key = lambda i, after: F.struct(F.get("up", i).alias("before"), F.get("down", after).alias("after"))

    def short(x):
        return (F.length(x) + 1 <= WORD) & ((F.length(x) + 1) * 10 <= size - F.length(x) - 1)

    without = F.filter(F.transform("w", lambda x, i: F.when(short(x), key(i, n - 1 - i))), lambda k: k.isNotNull())
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: key(i, n - i))
    return rows.select("d", "line", F.explode(F.concat(without, gaps)).alias("k")).select("k.before", "k.after", "d", "line")


def char_keys(lines: DataFrame) -> DataFrame:
    """before, after (hashes), d, line: the line without each character, and
    with a gap at each place."""
    c = F.filter(F.split("text", ""), lambda x: x != "")
    rows = lines.select("d", "line", _running(c).alias("up"), _running(F.reverse(c)).alias("down"))
    n = F.size("up") - 1
    key = lambda i, after: F.struct(F.get("up", i).alias("before"), F.get("down", after).alias("after"))
    without = F.transform(F.sequence(F.lit(0), n - 1), lambda i: key(i, n - 1 - i))
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: key(i, n - i))
    return rows.select("d", "line", F.explode(F.concat(without, gaps)).alias("k")).select("k.before", "k.after", "d", "line")


def _after_first(keyed: DataFrame) -> DataFrame:
    """d, line of the rows that share a key with an earlier place."""
    first = keyed.groupBy("before", "after").agg(F.min(F.struct("d", "line")).alias("at"), F.count(F.lit(1)).alias("n"))
    return keyed.join(first.where("n > 1"), ["before", "after"]).where(F.struct("d", "line") > F.col("at")).select("d", "line").distinct()


def _sharing(keyed: DataFrame) -> DataFrame:
    """The rows whose key more than one row has, with that number n."""
    return keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")


def _near_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """d, line of the later place of each pair that is at most one edit apart."""
    a = texts.select(F.col("d").alias("ad"), F.col("line").alias("al"), F.col("text").alias("a_text"))
    b = texts.select(F.col("d").alias("bd"), F.col("line").alias("bl"), F.col("text").alias("b_text"))
    near = pairs.join(a, ["ad", "al"]).join(b, ["bd", "bl"]).where(within_edits(F.col("a_text"), F.col("b_text")))
    a_later = (F.col("ad") > F.col("bd")) | ((F.col("ad") == F.col("bd")) & (F.col("al") > F.col("bl")))
    return near.select(F.when(a_later, F.col("ad")).otherwise(F.col("bd")).alias("d"),
                       F.when(a_later, F.col("al")).otherwise(F.col("bl")).alias("line"))


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, words: bool = False) -> DataFrame:
    """d, line of every line that goes."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = document_lines(docs, min_chars)
    # hashes and keys of a line are made where its text is; the texts themselves move only where they are compared
    hashes = {"segments": _segments()} | ({"halves": _halves()} if words else {})
    places = scratch.keep(lines.select("d", "line", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"),
                                       *[v.alias(k) for k, v in hashes.items()]))
    first = places.groupBy("h1", "h2").agg(F.min(F.struct("d", "line", *hashes)).alias("at"))
    first = scratch.keep(first.select("h1", "h2", "at.*"))  # the distinct lines

    rows = scratch.keep(_sharing(_segment_rows(first)))
    pairs = scratch.keep(_pairs(rows.where(F.col("n") <= BUCKET)).distinct())
    of = lambda df, d, line, use: df.select(F.col(d).alias("d"), F.col(line).alias("line"), F.lit(use).alias("use"))
    read = of(pairs, "ad", "al", 0).unionByName(of(pairs, "bd", "bl", 0)).unionByName(
        of(rows.where(F.col("n") > BUCKET), "d", "line", 1))
    if words:
        read = read.unionByName(of(_sharing(first.select("d", "line", F.explode("halves").alias("key"))), "d", "line", 2))
    read = scratch.keep(read.groupBy("d", "line").agg(F.max(F.col("use") == 1).alias("chars"), F.max(F.col("use") == 2).alias("words")))
    scratch.drop(rows)
    texts = scratch.keep(lines.join(read.hint("merge"), ["d", "line"]))  # the same way at every size: read grows with the lines
    scratch.drop(read)
    near = _near_pairs(pairs, texts).unionByName(_after_first(char_keys(texts.where("chars"))))
    if words:
        keyed = scratch.keep(word_keys(texts.where("words")))
        near = near.unionByName(_after_first(keyed))
    near = scratch.keep(near.distinct().withColumn("near", F.lit(True)))
    for table in (pairs, texts, *([keyed] if words else [])):
        scratch.drop(table)

    state = scratch.keep(first.join(near, ["d", "line"], "left").select(
        "h1", "h2", F.col("d").alias("fd"), F.col("line").alias("fl"), F.coalesce("near", F.lit(False)).alias("near")))
    scratch.drop(first)
    scratch.drop(near)
    gone = places.select("d", "line", "h1", "h2").join(state, ["h1", "h2"]).where(
        F.col("near") | (F.col("d") != F.col("fd")) | (F.col("line") != F.col("fl")))
    return gone.select("d", "line").distinct()


def _by_document(docs: DataFrame, min_chars: int, words: bool = False) -> DataFrame:
    """d and the ascending numbers of the lines that go; one document's lines at most."""
    return removed_lines(docs, min_chars, words).groupBy("d").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers from 0, comma-joined)."""
    rows = only(docs, "doc_id", "text").select(
        "doc_id", _document().alias("d"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return rows.join(_by_document(docs, min_chars), "d", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"))


def dedup_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text"), min_chars: int = MIN_CHARS,
                    words: bool = False) -> DataFrame:
    """The ``keep`` columns, text without the lines that go."""
    rows = docs.select(*keep).withColumn("__d", _document())
    gone = _by_document(docs, min_chars, words).withColumnRenamed("d", "__d").withColumnRenamed("removed", "__removed")
    lines = F.split("text", "\n")
    left = F.element_at(F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(
        F.sequence(F.lit(0), F.size(x) - 1), F.col("__removed")), lambda i: x[i]), "\n")), 1)
    out = rows.join(gone, "__d", "left")
    return out.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(left)).select(*keep)


def line_report_sql(min_chars: int = MIN_CHARS, table: str = "documents") -> str:
    """line_report as DuckDB SQL: all pairs of lines of about one length."""
    return f"""
    WITH l AS (SELECT DISTINCT doc_id, i AS line, string_split(coalesce(text, ''), chr(10))[i + 1] AS t
               FROM (SELECT doc_id, text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM {table})),
    c AS (SELECT doc_id, line, t FROM l WHERE length(t) >= {min_chars} AND regexp_matches(t, '\\S')),
    f AS (SELECT t, length(t) AS n, min((coalesce(doc_id, {LAST}), line)) AS at FROM c GROUP BY t),
    e AS (SELECT DISTINCT b.t FROM f a JOIN f b ON a.n BETWEEN b.n - 1 AND b.n + 1 AND a.at < b.at
            AND (left(a.t, least(a.n, b.n) // 2) = left(b.t, least(a.n, b.n) // 2)
                 OR right(a.t, (least(a.n, b.n) + 1) // 2) = right(b.t, (least(a.n, b.n) + 1) // 2))
          WHERE levenshtein(a.t, b.t) <= 1),
    g AS (SELECT c.doc_id, c.line FROM c JOIN f USING (t) LEFT JOIN e USING (t)
          WHERE e.t IS NOT NULL OR (coalesce(c.doc_id, {LAST}), c.line) <> f.at),
    r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM g GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
           CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.removed, '') AS removed
    FROM {table} d LEFT JOIN r ON r.doc_id IS NOT DISTINCT FROM d.doc_id"""
