"""Personal data in text (native): patterns propose spans, checks confirm them, words nearby adjust the score.

Spans are counted in code points with the end exclusive and found leftmost, without overlap, for each kind by itself.
The base kinds are email, ip (each part at most 255), card (16 to 19 digits passing Luhn) and phone (8 to 15 digits);
iban (mod 97) is added. A proposal that fails its check is dropped and not tried again.

Defined cases: a null text counts as empty and has no span; an empty table gives an empty result; rows are judged each by
itself, so repeated rows and ties change nothing; only `text_col` is read. Texts are searched whole. Repeats in the
patterns are possessive, so a long run of word characters is passed over once, without deep recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let

SPAN = "array<struct<start:long,end:long,score:double>>"
#: Characters before a span that are searched for context words.
CONTEXT_CHARS = 40
BASE_SCORE, CHECK_GAIN, CONTEXT_GAIN = 0.5, 0.3, 0.2


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  #: cheap test that any text with a span passes
    context: str
    base: bool = True


# A run's later characters start a match only where the last match ended (\G): from any other place in the run the
# attempt at its start has failed for the same reason.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         r"(?i)\b(e-?mail|mailto|contact|write|address)\b"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]",
         r"(?i)\b(ip|host|server|address|login|from)\b"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){15}",
         r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment)\b"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", r"(?i)\b(phone|tel|call|mobile|fax|whatsapp)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]",
         r"(?i)\b(iban|account|bank|transfer|konto)\b", base=False),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True when the check digit of a digit string fits."""
    def doubled(c, i):
        v = c.cast("int") * (1 + i % 2)
        return v - F.when(v > 9, 9).otherwise(0)

    parts = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), doubled)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(value: Column) -> Column:
    """True when an IBAN's remainder is 1."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(acc, c):
        v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)
    return F.lit(True)


def _parts(text: Column, kind: Kind) -> Column:
    """The pieces between matches and the matches; split and extract walk the same matches."""
    return F.struct(F.split(text, kind.pattern, -1).alias("pieces"),
                    F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("hits"))


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind in text order, with scores."""
    checked = CHECK_GAIN if kind.name in ("card", "iban", "ip") else 0.0

    def located(z):
        def step(acc, pair):
            start = acc["at"] + F.length(pair["piece"])
            end = start + F.length(pair["hit"])
            near = F.right(pair["piece"], F.lit(CONTEXT_CHARS)).rlike(kind.context)
            found = F.struct(start.alias("start"), end.alias("end"), (
                F.lit(BASE_SCORE + checked) + F.when(near, CONTEXT_GAIN).otherwise(0.0)).alias("score"))
            return F.struct(end.alias("at"), F.when(
                confirmed(kind.name, pair["hit"]), F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"))

        pairs = F.zip_with(F.slice(z["pieces"], 1, F.size(z["hits"])), z["hits"],
                           lambda p, h: F.struct(p.alias("piece"), h.alias("hit")))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("found"))
        return F.aggregate(pairs, start, step, lambda acc: acc["found"])

    return F.when(_gate(text, kind), let(_parts(text, kind), located)).otherwise(F.array().cast(SPAN))


def _gate(text: Column, kind: Kind) -> Column:
    return F.contains(text, F.lit("@")) if kind.gate == "@" else text.rlike(kind.gate)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a column of spans for each kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), *[spans_of(text, k).alias(k.name) for k in KINDS])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`docs` with personal data masked; the length column, where there is one, follows. Null texts stay null."""
    masked = docs
    for kind in KINDS:
        masked = masked.withColumn(text_col, _one_kind(F.col(text_col), kind))
    if length_col in docs.columns:
        masked = masked.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return masked


def _one_kind(text: Column, kind: Kind) -> Column:
    def rebuilt(z):
        shown = F.transform(z["hits"], lambda h: F.when(confirmed(kind.name, h), F.lit(f"[{kind.name.upper()}]")).otherwise(h))
        return F.array_join(F.zip_with(z["pieces"], shown, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")

    return F.when(_gate(text, kind), let(_parts(text, kind), rebuilt)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text."""
    def shown(kind):
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    base = F.concat(*[shown(k.name) for k in KINDS if k.base])
    every = F.concat(*[shown(k.name) for k in KINDS])
    score = F.concat(*[F.transform(k.name, lambda s: s["score"]) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
        F.transform(score, lambda s: F.round(s, 2)).alias("scores"))
