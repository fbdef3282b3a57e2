"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only.  The positions of an expression's matches come from
``split`` (the text between matches) and ``regexp_extract_all`` (the matches),
which walk the same leftmost, non-overlapping matches; lengths are counted in
code points.  The expressions are written so that they run in linear time on
any text: a run of characters is entered at its first character only, and
possessive quantifiers keep no positions to return to.  Running sums go
through blocks of ``BLOCK`` matches, and text is read by blocks of as many
code points, so that no array or text is copied or walked once per match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import table
from .native import BLOCK, before, let

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "ssn")
KINDS = BASE + ADDED
#: A span is kept from this score on.
THRESHOLD = 0.5
#: Code points before and after a span in which context words count.
CONTEXT = 48

@dataclass(frozen=True)
class Kind:
    """How one kind is proposed, confirmed and scored.

    probe: a cheap test that any text with a match passes.  score: that of a
    confirmed span; boost: what a context word near it adds.
    """

    name: str
    pattern: str
    probe: str
    score: float
    boost: float = 0.0
    context: str = ""


#: Length of an account number by country (ISO 13616 registry, and countries that use the format without being in it).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_IBAN += rf"|(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"  # other countries: any length

# Patterns, scores and context words of the kinds, in the order of the output.
RULES = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.95),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.9),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?:[0-9][\x20-]?){16}", 0.9),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.8),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]", 0.8, 0.2, r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)"),
    Kind("short_card", r"(?<![0-9])(?:[0-9]{13,15}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])", r"[0-9]{5}", 0.3, 0.4, r"(?i)\b(?:card|credit|visa|amex|carte|karte|tarjeta)"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", 0.2, 0.5, r"(?i)\b(?:ssn|social security|social insurance)"),
)
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        one = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(one > 4, 2 * one - 9).otherwise(2 * one)
        return total + F.when(i % 2 == 0, twice).otherwise(one)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number, read as in ISO 13616, leaves 1 modulo 97."""
    plain = F.regexp_replace(text, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _confirmed(kind: str, text: Column) -> Column:
    size = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(_OCTETS)
    if kind == "card":
        return F.when(size.between(16, 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return size.between(8, 15)
    if kind == "iban":
        return mod97(text)
    if kind == "short_card":
        return luhn(_digits(text))
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, lo: Column, hi: Column) -> Column:
    """Code points ``lo`` to ``hi``, end exclusive, of a text in blocks; what lies outside the text is left out."""
    lo = F.greatest(lo, F.lit(0))
    first = F.floor(lo / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor((hi - 1) / BLOCK).cast("int") - first + 1, F.lit(0))), "")
    return F.substr(near, lo - first * BLOCK + 1, hi - lo)


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches."""
    between, match = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(match, F.slice(between, 1, F.greatest(F.size(match), F.lit(1))), lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), m.alias("match")))

    def place(found: Column) -> Column:
        begins = before(F.transform(found, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        placed = F.zip_with(found, begins, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["match"].alias("match")))
        return F.filter(placed, lambda x: x["match"].isNotNull())

    return let(F.filter(pairs, lambda x: x["match"].isNotNull()), place)


def _scored(text: Column, rule: Kind) -> Column:
    """array<struct<start, end, score>> of the confirmed matches that reach the threshold."""
    hits = F.filter(_located(text, rule.pattern), lambda x: _confirmed(rule.name, x["match"]))

    def score(blocks: Column | None = None):
        def of(x: Column) -> Column:
            value = F.lit(rule.score)
            if rule.boost:
                near = _piece(blocks, x["start"] - CONTEXT, x["start"]).rlike(rule.context) | _piece(blocks, x["end"], x["end"] + CONTEXT).rlike(rule.context)
                value = value + F.when(near, rule.boost).otherwise(0.0)
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), value.alias("score"))

        return of

    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    scored = let(hits, lambda found: F.when(F.size(found) == 0, none).otherwise(let(_blocks(text), lambda blocks: F.transform(found, score(blocks))))) if rule.boost else F.transform(hits, score())
    kept = F.filter(scored, lambda x: x["score"] >= THRESHOLD)
    probed = F.contains(text, F.lit(rule.probe)) if rule.name == "email" else text.rlike(rule.probe)
    return F.when(probed, kept).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """``docs`` with one column for each kind: array<struct<start, end, score>>, code points, end exclusive.

    Null counts as empty.  Columns named ``prefix + kind`` are replaced.
    """
    whole = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    return docs.withColumns({prefix + rule.name: _scored(whole, rule) for rule in RULES})


def _named(kinds: tuple[str, ...], prefix: str) -> Column:
    def of(kind: str) -> Column:
        return F.transform(F.col(prefix + kind), lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    return F.array_join(F.flatten(F.array(*[of(k) for k in kinds])), ",")


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts and digests of the personal data in every document; n_found counts the spans of all kinds.

    Null and empty texts have none; repeated rows are returned each; an empty
    table gives an empty result; only the two named columns are read.
    """
    found = find_spans(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(_named(BASE, "pii_"), 256).alias("base_sha256"),
        _named(KINDS, "pii_").alias("spans"),
        sum((F.size(f"pii_{k}") for k in KINDS[1:]), F.size(f"pii_{KINDS[0]}")).cast("bigint").alias("n_found"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>``; overlapping spans become one, named by the first.

    Null texts stay null, an empty table stays empty, and other columns stay as they are.
    """
    prefix = "__pii_"
    found = find_spans(docs, text, prefix)
    source = F.col(f"`{text}`")

    def of(kind: str) -> Column:
        return F.transform(F.col(prefix + kind), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(kind.upper()).alias("kind")))

    every = F.array_sort(F.flatten(F.array(*[of(k) for k in KINDS])))

    def cut(spans: Column, until: Column) -> Column:
        """until: where the spans before each one end; a span that begins sooner is a part of theirs."""
        def text_of(blocks: Column) -> Column:
            parts = F.zip_with(spans, F.slice(until, F.lit(1), F.size(spans)), lambda x, at: F.when(x["start"] >= at, F.concat(_piece(blocks, at, x["start"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(""))
            return F.concat(F.array_join(parts, ""), _piece(blocks, F.element_at(until, -1), F.length(source)))

        return let(_blocks(source), text_of)

    clean = let(every, lambda spans: let(before(F.transform(spans, lambda x: -x["back"]), F.greatest), lambda until: cut(spans, until)))
    any_found = sum((F.size(prefix + k) for k in KINDS[1:]), F.size(prefix + KINDS[0])) > 0
    return found.withColumn(text, F.when(any_found, clean).otherwise(source)).drop(*[prefix + k for k in KINDS])


def query(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
