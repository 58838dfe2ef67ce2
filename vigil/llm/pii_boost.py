"""PII: exact base matches plus boosted-tree selection among high-recall candidates.

Base spans come from four strict patterns with checks (ranges, Luhn, digit counts).
Around them, loose generators propose overlapping candidate spans: anything like an
address with an "at", any run of digits with separators, account numbers, long tokens.
Gradient-boosted trees score a candidate by its format and context, a threshold is
calibrated on candidates held out of the fit, and candidates above it that overlap no
base span are added.

No labels for personal data exist, and the base patterns' own hits would only teach the
trees the base patterns.  They learn from planted spans instead: windows of the corpus's
own texts get one synthetic item each, personal (numbers without a plus, disguised
addresses, account and insurance numbers, keys behind an assignment) or look-alike
(dates, versions, check sums, identifiers, slugs).  What else a window holds is unlabelled
and may be personal data itself: a first ensemble that sees planted items alone picks
from it what is no item, and only these reliable negatives join the fit.

All of it is column expressions: match places come from splitting the text at its
matches and a prefix sum over the lengths, context is cut from the pieces between the
matches, the trees are nested CASE expressions, and overlaps are found by prefix maxima
over the sorted spans, so the cost of a text is n log n in its matches.  No pattern can
backtrack over a long run: runs are possessive or bounded, and start where a run starts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm._common import durable, name, settled

LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds in their order.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
#: Kinds that only the trees add, in their order after the base kinds.
MORE_KINDS = ("iban", "ssn", "secret")
#: Loose generators: an address with some "at", digit runs over blanks, digit runs without, account numbers, long tokens.
LOOSE = {
    "at": r"(?<![^\x20\x09-\x0D(<\[\"'])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,4})",
    "wide": r"(?<![0-9A-Za-z])[+(]?[0-9][0-9\x20().\-/]{6,26}[0-9](?![0-9A-Za-z])",
    "tight": r"(?<![0-9A-Za-z.\-])[0-9][0-9.\-/]{5,26}[0-9](?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "token": r"(?<![A-Za-z0-9_\-+/])[A-Za-z0-9_\-+/]{16,512}+={0,2}(?![A-Za-z0-9_\-+/=])",
}
#: Words before a span that tell what it is, by what they tell.
CONTEXT = {
    "contact": r"(?i)\b(?:tel|phone|call|fax|mobile|mail|e-mail|email|contact|write|reach)\b",
    "account": r"(?i)\b(?:card|visa|iban|account|bank|ssn|social|insurance)\b",
    "secret": r"(?i)(?:key|token|secret|passw|pwd|auth|bearer|credential)",
    "other": r"(?i)\b(?:commit|sha|sha1|sha256|md5|version|build|isbn|order|id|rev|hash|no)\b",
}
#: Characters of the text before and after a candidate that its features see.
BEFORE, AFTER = 24, 2
#: Beginnings that keys of well-known services have.
KEY_START = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abprs]-|AIza|eyJ)"
#: Entries of an array that a running value passes over at once.
BLOCK = 1024
#: Windows with a planted span, and words in a window.
PLANTS, WINDOW_WORDS = 6_000, 50
FEATURES = (
    "kind", "n_chars", "n_digits", "n_letters", "n_upper", "n_vowels", "n_dots", "n_blanks", "n_hyphens", "n_slashes", "n_parens", "n_under", "n_at",
    "n_groups", "longest_group", "largest_part", "luhn", "mod97", "first_digit", "distinct_digits", "distinct_chars", "changes", "hex", "key_start",
    "contact", "account", "secret", "other", "assigned", "word_before", "word_after", "line_start",
)


def scan(df: DataFrame, column: str, join, zero: Column) -> DataFrame:
    """Replace an array column by its running ``join`` (associative, neutral ``zero``), in blocks and then over blocks.

    What a lambda looks up is settled first: an expression that moves into a lambda is
    computed again for every entry.
    """
    last = lambda x: F.coalesce(F.get(x, F.size(x) - 1), zero)
    none = F.transform(F.array().cast("array<int>"), lambda _: zero)
    running = lambda x: F.aggregate(x, none, lambda done, v: F.array_append(done, join(last(done), v)))
    a = F.col(column)
    blocks = F.transform(F.sequence(F.lit(0), F.expr(f"(size(`{column}`) - 1) div {BLOCK}").cast("int")), lambda b: running(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
    df = settled(df).withColumn("__blocks", F.when(F.size(a) > 0, blocks).otherwise(F.transform(F.array().cast("array<int>"), lambda _: none)))
    df = settled(df.withColumn("__ends", running(F.transform("__blocks", last))))
    before = lambda i: F.coalesce(F.get(F.col("__ends"), i - 1), zero)
    whole = F.flatten(F.transform("__blocks", lambda x, i: F.transform(x, lambda v: join(before(i), v))))
    return settled(df.withColumn(column, whole).drop("__blocks", "__ends"))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits (null for none)."""
    back = F.split(F.reverse(digits), "")
    value = lambda d, i: d.cast("int") * (1 + i % 2)
    parts = F.transform(F.filter(back, lambda d: d != ""), lambda d, i: value(d, i) - F.when(value(d, i) > 9, 9).otherwise(0))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return F.when(F.length(digits) > 0, luhn_sum(digits) % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """Remainder of an account number (A-Z and digits, country and check digits first) by the rule of its check digits."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(c.try_cast("int"))
    join = lambda s, c: F.when(c >= "A", s * 100 + value(c)).otherwise(s * 10 + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), join)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def passes(kind: Column, match: Column) -> Column:
    """The checks of the base kinds."""
    n = F.length(digits_of(match))
    part = lambda p: F.regexp_replace(p, "^0+", "")
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when((n >= 16) & (n <= 19), luhn(digits_of(match))).otherwise(False))
        .when(kind == "phone", (n >= 8) & (n <= 15))
        .otherwise(True)
    )


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], out: str) -> DataFrame:
    """Adds ``out``: array of (kind, start, end, match, before, after), leftmost and non-overlapping by kind, in the order of the kinds.

    Places count code points, ends are exclusive; before and after are the nearest
    characters up to the kind's previous and next match.
    """
    body, no_text = F.col(text), F.array().cast("array<string>")
    can = {"email": body.contains("@"), "at": body.contains("@") | body.contains("at)") | body.contains("at]") | (body.contains(" at ") & body.contains(" dot ")), "phone": body.contains("+")}
    can |= {"iban": body.rlike("[A-Z]{2}[0-9]{2}"), "token": body.rlike(r"[A-Za-z0-9_\-+/]{16}")}
    some = body.rlike("[0-9]")
    lists = []
    for kind, pattern in patterns.items():
        found, pieces = f"__m_{kind}", f"__p_{kind}"
        df = df.withColumn(found, F.when(can.get(kind, some), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(no_text))
        df = df.withColumn(pieces, F.when(F.size(found) > 0, F.split(body, pattern, -1)).otherwise(no_text))
        lists.append((kind, F.col(found), F.col(pieces)))
    df = settled(df)

    # One prefix sum for all kinds: each kind's first step goes back to the text's start.
    def lengths(found: Column, pieces: Column, done: Column) -> Column:
        own = lambda m, i: F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(found, i - 1)), F.lit(0))
        return F.transform(F.transform(found, own), lambda x, i: x - F.when(i == 0, done).otherwise(0))

    def tagged(kind: str, found: Column, pieces: Column) -> Column:
        near = lambda i: (F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"))
        return F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), m.alias("match"), *near(i)))

    steps, done = [], F.lit(0)
    for _, found, pieces in lists:
        steps.append(lengths(found, pieces, done))
        last = F.length(body) - F.length(F.element_at(pieces, -1)) - F.length(F.element_at(found, -1))
        done = F.when(F.size(found) > 0, last).otherwise(done)
    df = df.withColumn("__at", F.concat(*steps))
    df = df.withColumn("__all", F.concat(*[tagged(*x) for x in lists])).drop(*(f"__{x}_{k}" for k in patterns for x in "mp"))
    df = scan(df, "__at", lambda x, y: x + y, F.lit(0))
    at = F.col("__at")
    spans = F.transform(
        "__all",
        lambda m, i: F.struct(m["kind"].alias("kind"), F.get(at, i).alias("start"), (F.get(at, i) + F.length(m["match"])).alias("end"), m["match"].alias("match"), m["before"].alias("before"), m["after"].alias("after")),
    )
    return settled(df.withColumn(out, spans).drop("__at", "__all"))


def features(c: Column) -> Column:
    """Format and context of a candidate (gen, kind, start, end, match, before, after); a leading plus is left out on purpose."""
    m, digits, before = c["match"], digits_of(c["match"]), c["before"]
    count = lambda pattern: F.length(m) - F.length(F.regexp_replace(m, pattern, ""))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    at = {"n_chars": F.length(m), "n_digits": F.length(digits)}
    counted = (("letters", "[A-Za-z]"), ("upper", "[A-Z]"), ("vowels", "[AEIOUaeiou]"), ("dots", r"\."), ("blanks", " "), ("hyphens", "-"), ("slashes", "/"), ("parens", "[()]"), ("under", "_"), ("at", "@"))
    at |= {f"n_{k}": count(p) for k, p in counted}
    at |= {
        "kind": F.array_position(F.array(*map(F.lit, (*KINDS, *MORE_KINDS))), c["kind"]),
        "n_groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "largest_part": F.coalesce(F.array_max(F.transform(groups, lambda g: F.least(F.length(g) * 1000, F.substring(g, 1, 3).cast("int")) + F.when(F.length(g) > 3, 1000).otherwise(0))), F.lit(0)),
        "luhn": F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False),
        "mod97": F.when(c["kind"] == "iban", mod97(F.regexp_replace(m, " ", "")) == 1).otherwise(False),
        "first_digit": F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)),
        "distinct_digits": F.size(F.array_distinct(F.split(digits, ""))),
        "distinct_chars": F.size(F.array_distinct(F.split(m, ""))),
        "changes": F.regexp_count(m, F.lit("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])")),
        "hex": m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "key_start": m.rlike(KEY_START),
        "assigned": before.rlike(r"""[=:]\x20?["']?$"""),
        "word_before": before.rlike(r"[A-Za-z]\x20?$"),
        "word_after": c["after"].rlike(r"^\x20?[A-Za-z]"),
        "line_start": (c["start"] == 0) | before.endswith("\n"),
    }
    at |= {k: before.rlike(p) for k, p in CONTEXT.items()}
    return F.array(*[F.coalesce(at[k].cast("double"), F.lit(0.0)) for k in FEATURES])


def guessed_kind(gen: Column, match: Column) -> Column:
    n = F.length(digits_of(match))
    return (
        F.when(gen == "at", "email")
        .when(gen == "iban", "iban")
        .when(gen == "token", "secret")
        .when(match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(n >= 16, "card")
        .otherwise("phone")
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column body) plus base (kind, start, end, match) and candidates (kind, start, end, hit, f).

    hit: the candidate overlaps a base span; f: its features.
    """
    df = with_matches(docs, "body", BASE, "base")
    df = df.withColumn("base", F.filter("base", lambda b: passes(b["kind"], b["match"])))
    df = with_matches(df, "body", LOOSE, "loose")
    loose = F.filter("loose", lambda c: c["kind"].isin("at", "iban", "token") | (F.length(digits_of(c["match"])) >= 7))
    fields = ("start", "order", "end", "gen", "match", "before", "after")
    as_row = lambda c, order: F.struct(*[{"order": order, "gen": c["kind"]}.get(f, c[f] if f not in ("order", "gen") else None).alias(f) for f in fields])
    both = F.concat(F.transform("base", lambda b: as_row(b, F.lit(0))), F.transform(loose, lambda c: as_row(c, F.lit(1))))
    df = df.withColumn("__all", F.sort_array(both)).drop("loose")
    # From the front: reach of the base spans that start no later; from the back: the next start of one.
    far, base_at = F.lit(2**31 - 1), lambda c: c["order"] == 0
    ahead = F.transform("__all", lambda c: F.when(base_at(c), c["end"]).otherwise(-1))
    behind = F.reverse(F.transform("__all", lambda c: F.when(base_at(c), c["start"]).otherwise(far)))
    df = df.withColumn("__run", F.zip_with(ahead, behind, lambda x, y: F.struct(x.alias("reach"), y.alias("next"))))
    join = lambda x, y: F.struct(F.greatest(x["reach"], y["reach"]).alias("reach"), F.least(x["next"], y["next"]).alias("next"))
    df = scan(df, "__run", join, F.struct(F.lit(-1).alias("reach"), far.alias("next")))
    run, n = F.col("__run"), F.size("__all")
    hit = lambda c, i: (F.get(run, i)["reach"] > c["start"]) | (F.get(run, n - 1 - i)["next"] < c["end"])
    made = F.transform(
        "__all",
        lambda c, i: F.struct(
            guessed_kind(c["gen"], c["match"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"),
            c["before"].alias("before"), c["after"].alias("after"), c["order"].alias("order"), hit(c, i).alias("hit"),
        ),
    )
    scored = F.transform(F.filter(made, lambda c: c["order"] == 1), lambda c: F.struct(c["kind"], c["start"], c["end"], c["hit"], features(c).alias("f")))
    return settled(df.withColumn("candidates", scored).drop("__all", "__run"))


def recipes(r: Column) -> list[tuple[str | None, Column, Column]]:
    """(kind or None for a look-alike, text before, planted text) of every planted form, from a random number ``r``."""
    salted = lambda i: F.xxhash64(r, F.lit(i))
    some = lambda i, *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), F.pmod(salted(i), F.lit(len(xs))).cast("int"))
    num = lambda i, n: F.lpad(F.pmod(salted(i), F.lit(10**n)).cast("string"), n, "0")
    sha = lambda i: F.sha2(salted(i).cast("string").cast("binary"), 256)
    hexa = lambda i, n: F.substring(sha(i), 1, n)
    mixed = lambda i, n: F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(sha(i), sha(i + 50)))), "[+/=]", ""), 1, n)
    cat = lambda *xs: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    word = lambda i: some(i, "anna", "joe.smith", "info", "m_lopez", "webmaster", "k-meier", "sales", "pierre42")
    host = lambda i: some(i, "example", "mail-box", "acme", "uni-hof", "post", "corp7")
    end = lambda i: some(i, "com", "org", "net", "de", "fr", "es")
    long = lambda i: some(i, "settings", "element", "customer", "response", "handler", "document", "overview", "chapter", "products", "archive")
    contact = some(1, "", "call ", "tel: ", "phone ", "fax ", "mobile ")
    none = F.lit("")
    open_quote = some(2, "", '"', "'")
    assigned = cat(some(3, "token", "api_key", "secret", "password", "auth_token", "access key", "SECRET_KEY", "client_secret"), some(4, " = ", "=", ": ", " "), open_quote)
    head15, bban = cat(some(5, "4", "5", "3"), num(6, 14)), cat(num(7, 10), num(8, 8))
    card = cat(head15, F.pmod(-luhn_sum(cat(head15, "0")), F.lit(10)).cast("string"))
    country = some(9, "DE", "FR", "ES", "IT", "GB")
    iban = cat(country, F.lpad((98 - mod97(cat(country, "00", bban))).cast("string"), 2, "0"), bban)
    fours = lambda x: F.rtrim(F.regexp_replace(x, "(.{4})", "$1 "))
    dotted = lambda x, by: cat(F.substring(x, 1, 4), by, F.substring(x, 5, 4), by, F.substring(x, 9, 4), by, F.substring(x, 13, 4))
    return [
        ("phone", contact, some(10, cat("(", num(11, 3), ") ", num(12, 3), "-", num(13, 4)), cat(num(11, 3), "-", num(12, 3), "-", num(13, 4)), cat(num(11, 3), ".", num(12, 3), ".", num(13, 4)))),
        ("phone", some(1, "call ", "tel: ", "phone ", "fax ", "mobile "), some(10, cat("0", num(11, 2), " ", num(12, 4), " ", num(13, 4)), cat("00", num(11, 2), " ", num(12, 3), " ", num(13, 5)), cat("0", num(11, 3), "/", num(12, 6)))),
        ("email", some(1, "", "mail ", "write to ", "contact "), cat(word(10), some(11, cat(some(15, " (at) ", "(at)", " [at] ", "[at]"), host(12), some(13, ".", " dot ", "(dot)", " [dot] ")), cat(" at ", host(12), " dot ")), end(14))),
        ("ssn", some(1, "", "SSN ", "social security number "), cat(num(10, 3), "-", num(11, 2), "-", num(12, 4))),
        ("iban", some(1, "", "IBAN ", "account ", "bank account: "), some(10, iban, fours(iban))),
        ("card", some(1, "", "card ", "visa "), dotted(card, some(10, ".", "/", " - "))),
        ("secret", assigned, some(10, hexa(11, 32), hexa(11, 40), hexa(11, 64), mixed(11, 20), mixed(11, 32), mixed(11, 40))),
        ("secret", some(1, none, assigned), some(10, cat("AKIA", F.upper(mixed(11, 16))), cat("ghp_", mixed(11, 36)), cat("sk_live_", mixed(11, 24)), cat("AIza", mixed(11, 35)), cat("xoxb-", num(12, 11), "-", mixed(11, 24)))),
        (None, none, some(10, cat("20", num(11, 2), "-0", num(12, 1), "-1", num(13, 1)), cat("1", num(11, 1), "/0", num(12, 1), "/20", num(13, 2)), cat("1", num(11, 1), ".0", num(12, 1), ".20", num(13, 2)))),
        (None, some(1, "", "version ", "build ", "v"), cat(num(11, 2), ".", num(12, 2), ".", num(13, 4), some(10, "", "-12", ".7"))),
        (None, some(1, "", "order ", "No. ", "id "), some(10, num(11, 8), num(11, 10), num(11, 12), num(11, 16))),
        (None, some(1, "", "ISBN "), cat("978-", num(11, 1), "-", num(12, 2), "-", num(13, 6), "-", num(14, 1))),
        (None, some(1, "", "build "), cat(num(10, 3), "-", num(11, 2), "/", num(12, 2), " of ", num(13, 8))),
        (None, some(1, "", "sum of "), cat(num(11, 3), ".", num(12, 3), ".", num(13, 3), some(10, "", ",00"))),
        (None, some(1, "", "commit ", "sha256:", "md5 ", "hash "), some(10, hexa(11, 32), hexa(11, 40), hexa(11, 64))),
        (None, some(1, "", "id ", "uuid "), cat(hexa(10, 8), "-", hexa(11, 4), "-", hexa(12, 4), "-", hexa(13, 4), "-", hexa(14, 12))),
        (None, some(1, "", "see ", "www.example.com"), cat(some(10, "/", "/en/", "/de/2024/"), long(11), "-", long(12), "-", long(13), some(14, "", "/7", ".html"))),
        (None, none, some(10, cat("get", F.initcap(long(11)), F.initcap(long(12))), cat(long(11), "_", long(12), "_", long(13)), cat(long(11), long(12), long(13)), F.upper(cat(long(11), long(12), long(13))), F.lit("--------------------"), F.lit("____________________"))),
        (None, none, cat(F.upper(F.substring(long(11), 1, 2)), num(12, 2), " ", F.upper(F.substring(sha(13), 1, 4)), " ", num(14, 4), " ", F.upper(F.substring(sha(15), 1, 4)))),
        (None, none, some(10, cat("sold ", num(11, 2), " at ", num(12, 2), ".", num(13, 2)), cat(num(11, 1), " @ ", num(12, 1), ".", num(13, 2)), F.lit("meet at noon. Then"))),
    ]


def planted(texts: DataFrame, *, plants: int = PLANTS, seed: int = 5) -> DataFrame:
    """body, kind (null for a look-alike), start, end: about ``plants`` windows of ``texts`` (distinct body), one synthetic span in each."""
    n = texts.count()
    each = -(-plants // max(n, 1))
    r = F.col("r")
    df = texts.select("body", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("j")).select("body", F.xxhash64("body", "j", F.lit(seed)).alias("r"))
    words = F.split("body", r"(?<=[\x20\n])")
    df = df.select("r", words.alias("words")).select("r", "words", (F.pmod(F.xxhash64(r, F.lit(-1)), F.size("words")) + 1).cast("int").alias("place"))
    half = WINDOW_WORDS // 2
    first = F.greatest(F.col("place") - half, F.lit(1))
    df = df.select("r", F.array_join(F.slice("words", first, F.col("place") - first), "").alias("left"), F.array_join(F.slice("words", F.col("place"), F.lit(half)), "").alias("right"))
    made = recipes(r)
    which = F.pmod(F.xxhash64(r, F.lit(-2)), F.lit(len(made))).cast("int")
    forms = F.when(which == 0, F.struct(F.lit(made[0][0]).alias("kind"), made[0][1].alias("head"), made[0][2].alias("item")))
    for i, (kind, head, item) in enumerate(made[1:], 1):
        forms = forms.when(which == i, F.struct(F.lit(kind).cast("string").alias("kind"), head.alias("head"), item.alias("item")))
    df = settled(df.select("left", "right", forms.alias("p")))
    start = F.length("left") + F.length("p.head")
    return df.select(
        F.concat("left", "p.head", "p.item", F.lit(" "), "right").alias("body"), F.col("p.kind").alias("kind"), start.alias("start"), (start + F.length("p.item")).alias("end")
    )


class Trees:
    """A boosted ensemble as one expression, with its calibrated threshold."""

    def __init__(self, trees: list, weights: list[float], threshold: float, info: dict | None = None):
        self.trees, self.weights, self.threshold, self.info = trees, weights, threshold, info or {}

    def score(self, f: Column) -> Column:
        def value(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, limit, low, high = node
            return F.when(F.get(f, F.lit(feature)) <= limit, value(low)).otherwise(value(high))

        return reduce(lambda a, b: a + b, (value(t) * w for t, w in zip(self.trees, self.weights, strict=True)))


def parse_tree(lines: list[str]) -> float | tuple:
    """One tree of a model's printed form: a prediction, or (feature, threshold, low side, high side)."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: (\S+)", line):
        return float(m[1])
    feature, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = parse_tree(lines)
    lines.pop(0)
    return int(feature), float(limit), low, parse_tree(lines)


def training_rows(windows: DataFrame) -> DataFrame:
    """f, label, known (touches the planted span), apart (held out of the fit) of the candidates of ``planted`` windows that no base span confirms.

    A candidate is positive if it is of the planted kind and shares at least two thirds
    of its characters and of the planted ones with the planted span.
    """
    c = F.col("c")
    found = with_spans(windows).select("kind", "start", "end", F.xxhash64("body").alias("h"), F.explode("candidates").alias("c")).where(~c["hit"])
    shared = F.least("end", c["end"]) - F.greatest("start", c["start"])
    longest = F.greatest(F.col("end") - F.col("start"), c["end"] - c["start"])
    same = (c["kind"] == F.col("kind")) & (3 * shared >= 2 * longest)
    return found.select(c["f"].alias("f"), F.coalesce(same, F.lit(False)).cast("double").alias("label"), (shared > 0).alias("known"), (F.pmod("h", F.lit(4)) == 0).alias("apart"))


def boosted(rows: DataFrame, rounds: int, depth: int, seed: int) -> Trees:
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=64, seed=seed, stepSize=0.3).fit(rows)
    return Trees([parse_tree([x for x in t.toDebugString.split("\n")[1:] if x.strip()]) for t in model.trees], list(model.treeWeights), float("inf"))


def train(texts: DataFrame, *, plants: int = PLANTS, rounds: int = 10, depth: int = 5, precision: float = 0.97, least_margin: float = 0.5, seed: int = 5) -> Trees | None:
    """Boosted trees from spans planted in ``texts`` (distinct body), three quarters to fit, one to calibrate.

    Planted items are more frequent than real ones, so a score below ``least_margin`` is
    never enough.  ``info`` has the precision and recall on the held-out candidates.  None if either class has fewer than 20 candidates: no span is added then.
    """
    rows = durable(training_rows(planted(texts, plants=plants, seed=seed)).withColumn("features", array_to_vector("f")).repartition(2))  # some 10,000 rows
    counts = rows.where("known").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("pos")).first()
    if min(counts.pos, counts.n - counts.pos) < 20:
        return None
    first = boosted(rows.where("known and not apart"), rounds // 2, depth, seed)
    rows = rows.where(F.col("known") | (first.score(F.col("f")) < 0))
    trees = boosted(rows.where("not apart"), rounds, depth, seed)
    # Calibration: precision of the held-out candidates above each score step, from the top.
    steps = (
        rows.where("apart")
        .groupBy(F.round(trees.score(F.col("f")), 1).alias("step"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
        .orderBy(F.desc("step"))
        .collect()
    )
    n, pos, whole = 0, 0.0, sum(s.pos for s in steps)
    for s in steps:  # down to the last step where all above it are precise, and to the first one that is not by itself
        n, pos = n + s.n, pos + s.pos
        if s.step < least_margin or s.n >= 5 and (s.pos + 1) / (s.n + 2) < precision - 0.15:
            break
        if pos / n >= precision:
            trees.threshold = s.step - 0.05
            trees.info = {"held_out": sum(x.n for x in steps), "precision": pos / n, "recall": pos / max(whole, 1.0)}
    return trees


def find_spans(docs: DataFrame, *, text: str = "text", most_training: int = 4_000, model: Trees | None = None) -> DataFrame:
    """row (all columns of ``docs``), base and spans: arrays of (kind, start, end), by kind and then start.

    ``spans`` holds the base spans and those that the trees add (kinds ``KINDS`` and, after
    them, ``MORE_KINDS``).  Without ``model`` one is trained on spans planted in about
    ``most_training`` distinct texts at the most, chosen by a hash of the text.  Null and
    empty texts have no spans; texts of any length are searched whole; repeated rows
    each get the same spans; of added spans that overlap the one that starts first stays
    (at a tie, the shorter one); an empty table gives no rows.  Columns of ``docs`` may
    have any names, as they travel in ``row``.
    """
    rows = docs.select(F.struct(*[name(c) for c in docs.columns]).alias("row"), F.coalesce(name(text).cast("string"), F.lit("")).alias("body"))
    if model is None:
        n = rows.count()
        part = rows if n <= most_training else rows.where(F.pmod(F.xxhash64("body"), F.lit(1 << 30)) < int((1 << 30) * most_training / n))
        model = train(durable(part.select("body").where("body <> ''").distinct()))
    found = with_spans(rows)
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].cast("long").alias("start"), c["end"].cast("long").alias("end"))
    base = F.transform("base", plain)
    if model is None:
        return found.select("row", base.alias("base"), base.alias("spans"))
    new = F.filter("candidates", lambda c: ~c["hit"])
    found = found.withColumn("__new", F.filter(new, lambda c: model.score(c["f"]) > model.threshold)).drop("candidates")
    # Of added spans that overlap, the one that starts first stays; candidates are sorted by start.
    found = found.withColumn("__reach", F.transform("__new", lambda c: c["end"]))
    found = scan(found, "__reach", lambda x, y: F.greatest(x, y), F.lit(-1))
    added = F.transform(
        F.filter("__new", lambda c, i: F.coalesce(F.get(F.col("__reach"), i - 1), F.lit(-1)) <= c["start"]), plain
    )
    found = settled(found.select("row", base.alias("base"), added.alias("added")))
    of_kind = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    by_kind = [F.sort_array(F.concat(of_kind("base", k), of_kind("added", k))) for k in KINDS] + [of_kind("added", k) for k in MORE_KINDS]
    return settled(found.select("row", "base", F.concat(*by_kind).alias("spans")))


def redact(found: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``find_spans`` with each span of the text replaced by its kind in brackets; overlapping spans merge.

    All columns of the rows stay in their order; ``spans`` is added and replaces a column of that name.
    """
    df = found.select("row", "spans", F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("__s"))
    df = df.withColumn("__reach", F.transform("__s", lambda s: s["end"]))
    df = scan(df, "__reach", lambda x, y: F.greatest(x, y), F.lit(0).cast("long"))
    reach, body = F.col("__reach"), F.col("row").getField(text)
    heads = F.filter(
        F.transform("__s", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("before"), i.alias("i"))),
        lambda h: (h["i"] == 0) | (h["before"] <= h["start"]),
    )
    # The text in blocks, so that no cut walks over the whole text.
    blocks = F.transform(F.sequence(F.lit(0), (F.length(body) / BLOCK).cast("int")), lambda b: F.substring(body, b * BLOCK + 1, F.lit(BLOCK)))
    df = settled(df.withColumn("__heads", heads).withColumn("__cut", F.when(F.size("__s") > 0, blocks)).withColumn("__end", F.coalesce(F.array_max(reach), F.lit(0))))

    def cut(low: Column, high: Column) -> Column:
        a, b = F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int")
        part = lambda i, x, n: F.substring(F.coalesce(F.get(F.col("__cut"), i), F.lit("")), x.cast("int"), n.cast("int"))
        inner = F.array_join(F.slice("__cut", a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        over = F.concat(part(a, low % BLOCK + 1, F.lit(BLOCK)), inner, part(b, F.lit(1), high % BLOCK))
        return F.when(a == b, part(a, low % BLOCK + 1, high - low)).otherwise(over)

    n = F.col("__heads")
    part = lambda h: F.concat(cut(h["before"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]"))
    clean = F.when(F.size(n) > 0, F.concat(F.array_join(F.transform(n, part), ""), cut(F.col("__end"), F.length(body).cast("long")))).otherwise(body)
    columns = [c for c in found.schema["row"].dataType.names if c != "spans"]
    return df.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns], "spans")
