"""Operator 6: PII surrogates, DataFrame functions only.

E-mail addresses, phone numbers, payment cards, IP addresses and names behind
a form of address are found by one pattern.  Each is replaced by a surrogate
drawn from a keyed hash of its normal form: digits for digits in the same
layout (a card keeps its first digit and its Luhn remainder, a phone number
its first digit), letters of the same script and case in an address (its last
domain label stays), given names of the gender the form of address shows,
family names, in the script of the original.  The same entity always gets the
same surrogate, whatever its layout or case, in every document (coreference).
A given name behind a form of address of no gender takes the gender of the
same full name elsewhere in its text, where that shows just one.

Distinctness is checked over the whole corpus: of two entities of a kind that
draw one surrogate all but the first draw again, as does one that draws
another real entity; rounds end when none is left.  A layout can have fewer
surrogates than entities (two-letter addresses, short numbers, signs alone):
from the third new draw on a surrogate gets one more letter or digit each
time, and from the ninth on an IP address octets up to 999, so the rounds end.
Only entities that drew again (few) are joined back to their documents, each
row by its own id and text.  Texts are rewritten by built-in functions, row by
row.

Defined results: a null text is empty; a text without entities stays as it
is; repeated rows are rewritten alike; an empty table gives an empty result;
other columns are dropped unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, only

# Forms of address by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία")
ANY = ("Dr", "Prof", "Mx")

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
# +cc and groups (one of a digit is followed by more); with a trunk zero, French pairs, then others of 9 to 12 digits that are
# no date or IP; ddd ddd dddd; Spanish nine digits
PHONE = (r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?(?:\d(?:[ .-]\d{2,4}){2,4}|\d{2,4}(?:[ .-]?\d{2,4}){1,4})"
         r"|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])\d{3}-\d{3}-\d{4}"
         r"|(?<![\p{L}\d+])(?<!\d[.-])(?!\d(?:[ -]?\d){12,18}(?!\d))(?:0[1-9](?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4}|\d{8})(?![\d\p{L}])"
         r"|(?!\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!(?:\d{1,3}\.){3}\d{1,3}(?![\d.]))0[1-9](?:[ ./-]?\d){7,10}(?![\d\p{L}])"
         r"|\d{3}(?:\.\d{3}\.| \d{3} )\d{4}|[6-9]\d{2}(?: \d{3} \d{3}|-\d{3}-\d{3})|[6-9]\d{2}(?: \d{2}){3}|[89]\d \d{3} \d{2} \d{2}))(?!\d)")
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
NAME = r"(?<!\p{L})(?:" + "|".join(MALE + FEMALE + ANY) + r")\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?"
PATTERN = "|".join((EMAIL, PHONE, CARD, IP, NAME))

# A script's small letters, and open syllables for its names.
SCRIPTS = {
    "latin": (r"\p{IsLatin}", "abcdefghijklmnopqrstuvwxyz", "ba be di do fa ga ha ka la le li lo ma mi na ne no pa ra re ri ro sa se ta te to va ve wi za".split()),
    "cyrillic": (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя", "ба бе ва ве га да де ди ка ла ле ли ма ми на не ни но па ра ре ри ро са се си та те то".split()),
    "greek": (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω", "βα γα γε δα δι κα κε λα λε λι μα μι να νε νο πα ρα ρε ρι ρο σα σε τα τε το φα φι χα".split()),
}
ENDINGS = {"given_m": {"latin": "n", "cyrillic": "н", "greek": "ς"}, "given_f": {"latin": "a", "cyrillic": "я", "greek": "η"},
           "given_n": {"latin": "", "cyrillic": "", "greek": ""}, "family": {"latin": "r", "cyrillic": "к", "greek": "ς"}}
KINDS = ("email", "phone", "card", "ip", "name")
SAME_LENGTH = 2  # new draws before a surrogate grows
VALID_IP = 8  # new draws before an octet may pass 254


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def kind_of(x: Column) -> Column:
    n = F.length(_digits(x))
    return (F.when(F.contains(x, F.lit("@")), "email").when(x.rlike(r"^\p{L}"), "name")
            .when(x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
            .when(x.rlike(r"^[+(]") | (n < 13), "phone").otherwise("card"))


def parts_of(x: Column, among: Column) -> Column:
    """An entity's parts with surrogates of their own: (kind, norm).  ``among``: its text's entities."""
    part = lambda kind, norm: F.struct(kind.alias("kind"), norm.alias("norm"))

    def name(w):
        title = F.regexp_replace(w[0], r"\.$", "")
        full = F.lower(F.substr(x, F.length(w[0]) + 2))
        named = lambda titles: F.exists(among, lambda e: F.regexp_replace(
            F.substring_index(e, " ", 1), r"\.$", "").isin(*titles) & (F.lower(F.array_join(F.slice(F.split(e, " "), 2, 2), " ")) == full))
        male, female = named(MALE), named(FEMALE)
        given = F.when(title.isin(*MALE), "given_m").when(title.isin(*FEMALE), "given_f").when(
            male & ~female, "given_m").when(female & ~male, "given_f").otherwise("given_n")
        family = part(F.lit("family"), F.lower(F.element_at(w, -1)))
        return F.when(F.size(w) > 2, F.array(part(given, F.lower(w[1])), family)).otherwise(F.array(family))

    one = lambda k: F.array(part(k, F.when(k.isin("phone", "card"), _digits(x)).otherwise(F.lower(x))))
    return _bind(kind_of(x), lambda k: F.when(k == "name", _bind(F.split(x, " "), name)).otherwise(one(k)))


def _draw(h: Column, i, n: int) -> Column:
    return F.pmod(F.xxhash64(h, i if isinstance(i, Column) else F.lit(i)), F.lit(n)).cast("int")


def _pick(choices, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), at + 1)


def _luhn(digits: Column) -> Column:
    """Luhn sum's remainder; the last digit counts once."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form."""
    latin = SCRIPTS["latin"][1]
    more = F.greatest(attempt - SAME_LENGTH, F.lit(0))

    def made(h):
        size = F.length(norm) + more
        number = F.concat(F.substring(norm, 1, 1), F.array_join(F.transform(
            F.sequence(F.lit(2), F.greatest(size, F.lit(2))), lambda i: _draw(h, i, 10).cast("string")), ""))
        number = F.substr(number, F.lit(1), size)
        stem = F.substr(number, F.lit(1), size - 1)
        card = F.concat(stem, ((_luhn(norm) - _luhn(F.concat(stem, F.lit("0"))) + 10) % 10).cast("string"))
        ip = F.concat_ws(".", *[(F.when(attempt <= VALID_IP, _draw(h, i, 254)).otherwise(_draw(h, i, 999)) + 1).cast("string")
                                for i in range(4)])
        tail = F.length(F.substring_index(norm, ".", -1))

        def letter(c, i):
            out = F.when(c.rlike(r"\p{N}"), _draw(h, i, 10).cast("string"))
            for script, letters, _ in SCRIPTS.values():
                out = out.when(c.rlike(script), F.substr(F.lit(letters), _draw(h, i, len(letters)) + 1, F.lit(1)))
            out = out.when(c.rlike(r"\p{L}"), F.substr(F.lit(latin), _draw(h, i, len(latin)) + 1, F.lit(1)))  # other scripts
            return F.when(i < F.length(norm) - tail, out.otherwise(c)).otherwise(c)

        email = F.array_join(F.transform(F.split(norm, ""), letter), "")
        grown = F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: F.substr(
            F.lit(latin), _draw(h, -i, len(latin)) + 1, F.lit(1))), "")
        email = F.when(more > 0, F.concat(F.substring_index(email, "@", 1), grown, F.lit("@"), F.substring_index(
            email, "@", -1))).otherwise(email)

        def name(script: str):
            syllables = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + attempt), lambda i: _pick(
                SCRIPTS[script][2], _draw(h, i, len(SCRIPTS[script][2])))), "")
            end = F.lit("")
            for k, by in ENDINGS.items():
                end = F.when(kind == k, F.lit(by[script])).otherwise(end)
            return F.concat(syllables, end)

        names = F.when(norm.rlike(SCRIPTS["cyrillic"][0]), name("cyrillic")).when(
            norm.rlike(SCRIPTS["greek"][0]), name("greek")).otherwise(name("latin"))
        return F.when(kind == "email", email).when(kind == "phone", number).when(kind == "card", card).when(
            kind == "ip", ip).otherwise(names)

    return _bind(F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256), made)


def _laid_out(x: Column, digits: Column) -> Column:
    """The digits in the layout of x, what is left of them at its end."""
    rest = F.substr(digits, F.length(_digits(x)) + 1)
    return F.concat(F.array_join(F.transform(F.split(x, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(
        digits, F.length(_digits(F.substr(x, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""), rest)


def replaced(x: Column, among: Column, attempt_of, key: str) -> Column:
    """An entity's surrogate in its layout and case; attempt_of: (kind, norm) -> attempt."""
    def made(parts):
        new = F.transform(parts, lambda p: surrogate(p["kind"], p["norm"], attempt_of(p["kind"], p["norm"]), key))

        def shown(s):
            kind = parts[0]["kind"]
            cased = lambda c: F.when(x == F.upper(x), F.upper(c)).otherwise(c)
            name = F.concat_ws(" ", F.substring_index(x, " ", 1), F.array_join(F.transform(s, lambda n: F.concat(
                F.upper(F.substring(n, 1, 1)), F.substr(n, F.lit(2)))), " "))
            return F.when(kind == "email", cased(s[0])).when(kind.isin("phone", "card"), _laid_out(x, s[0])).when(
                kind == "ip", s[0]).otherwise(cased(name))

        return _bind(new, shown)

    return _bind(parts_of(x, among), made)


def entity_parts(docs: DataFrame) -> DataFrame:
    """__at (a row's id and text, hashed), kind, norm of each part of each entity."""
    found = only(docs, "doc_id", "text").select(F.xxhash64("doc_id", "text").alias("__at"), F.regexp_extract_all(
        "text", F.lit(PATTERN), F.lit(0)).alias("__e"))
    parts = F.flatten(F.transform("__e", lambda x: parts_of(x, F.col("__e"))))
    return found.where(F.size("__e") > 0).select("__at", F.explode(parts).alias("p")).select("__at", "p.kind", "p.norm")


def redraws(parts: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """kind, norm, attempt of the parts whose first surrogate is taken."""
    now = scratch.keep(parts.withColumn("attempt", F.lit(0)))
    while True:
        drawn = scratch.keep(now.withColumn("s", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)))
        taken = drawn.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("least")).where("n > 1")
        again = drawn.join(taken, ["kind", "s"]).where("norm <> least").select("kind", "norm")
        real = drawn.select("kind", F.col("norm").alias("s"))
        again = scratch.keep(again.unionByName(drawn.join(real, ["kind", "s"], "left_semi").select("kind", "norm")).distinct())
        scratch.drop(drawn)
        if again.isEmpty():
            return now.where("attempt > 0")
        then = scratch.keep(now.join(again.withColumn("more", F.lit(1)), ["kind", "norm"], "left").select(
            "kind", "norm", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
        scratch.drop(now)
        now = then


def pii_surrogates(docs: DataFrame, key: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_email, n_phone, n_card, n_ip, n_name and the new text."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(entity_parts(docs))
    odd = scratch.keep(redraws(found.select("kind", "norm").distinct(), key, scratch))
    df = docs.select(*keep, *[F.col(c).alias(f"__{c}") for c in ("doc_id", "text")])
    df = df.select(*keep, "__doc_id", F.coalesce(F.col("__text").cast("string"), F.lit("")).alias("__text"))
    df = df.withColumn("__e", F.regexp_extract_all("__text", F.lit(PATTERN), F.lit(0)))
    if odd.isEmpty():
        attempts = lambda kind, norm: F.lit(0)
    else:  # a row's redrawn parts, at most as many as its text has; equal hashes only share their parts
        mine = found.join(odd, ["kind", "norm"]).groupBy("__at").agg(F.map_from_entries(
            F.collect_set(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias("__odd"))
        df = df.withColumn("__at", F.xxhash64("__doc_id", "__text")).join(mine, "__at", "left")
        attempts = lambda kind, norm: F.coalesce(F.get(F.map_values(F.map_filter(
            "__odd", lambda k, v: k == F.concat_ws("|", kind, norm))), F.lit(0)), F.lit(0))
    gaps = F.split("__text", PATTERN)
    text = _bind(gaps, lambda g: F.concat(g[0], F.array_join(F.transform("__e", lambda x, i: F.concat(
        replaced(x, F.col("__e"), attempts, key), g[i + 1])), "")))
    kinds = F.transform("__e", kind_of)
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return df.select(*keep, *counts, F.when(F.size("__e") == 0, F.col("__text")).otherwise(text).alias("text"))
