"""Text expressions: normalising, fingerprints, seeded buckets, gates, repetition, numbers in texts."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of the special tokens, which no text may hold.
SPECIAL_NAMES = ["<BOS>", "<EOS>", "<USER>", "<ASSISTANT>", "<TOOL>", "<THINK>", "<FINAL>", "<PAD>"]

# What marks a secret, the form of a decimal and of a fraction (Unicode digits and letters count).
SECRETS = [r"sk-[A-Za-z0-9]{16,}", r"(?i)DEEPSEEK_API_KEY\s*="]
DECIMAL = r"(?U)(?<![\w/])[-+]?(?:(?:\d{1,3}(?:,\d{3})+)|\d+)(?:\.\d+)?(?![\w/])"
FRACTION = r"(?U)[-+]?\d+\s*/\s*[-+]?\d+"

# What stands for a typographic or mathematical sign in ASCII.
SIGNS = {
    "²": "^2", "³": "^3", "·": "*", "×": "*", "÷": "/", "Ω": "ohm", "λ": "lambda",
    "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "−": "-", "⋅": "*",
}


@F.arrow_udf(StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode NFKC, for which Spark has no function."""
    return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def squeeze(texts: pa.Array) -> pa.Array:
    """All white space (as Unicode has it) as single spaces, none at the ends."""
    return pa.array([None if t is None else " ".join(t.split()) for t in texts.to_pylist()], pa.string())


def normalise(text: Column) -> Column:
    """NFKC, new lines as \\n, no blanks at line ends or at the ends of the text."""
    lines = F.regexp_replace(nfkc(text), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?m)(?U)[^\S\n]+$", ""), r"(?U)\A\s+|\s+\z", "")


def normalise_public(text: Column) -> Column:
    """normalise, and no more than one empty line in a row."""
    return F.regexp_replace(normalise(text), r"\n{3,}", "\n\n")


def normalise_lines(text: Column) -> Column:
    """NFKC, the white space within each line as single spaces, none at its ends, no more than one empty line in a row."""
    lines = F.regexp_replace(nfkc(text), r"\r\n?", "\n")
    lines = F.regexp_replace(F.regexp_replace(lines, r"(?U)[^\S\n]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?U)\A\s+|\s+\z", ""), r"\n{3,}", "\n\n")


@F.arrow_udf(StringType())
def ascii_json(texts: pa.Array) -> pa.Array:
    """JSON texts with every character outside ASCII escaped, as stable ids want them."""
    return pa.array([None if t is None else t if t.isascii() else "".join(c if c.isascii() else json.dumps(c)[1:-1] for c in t) for t in texts.to_pylist()], pa.string())


def stable_id(prefix: str, canonical: Column, digits: int = 24) -> Column:
    """prefix-digest of a canonical JSON text."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(ascii_json(canonical), 256), 1, digits))


def request_hash(canonical: Column) -> Column:
    """The SHA-256 of a canonical JSON body as it is sent, in ASCII."""
    return F.sha2(ascii_json(canonical), 256)


def identity(*parts: Column) -> Column:
    """SHA-256 over the parts with a zero byte between: source, revision, path and document make a document's identity."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def ascii_maths(text: Column) -> Column:
    """Typographic and mathematical signs in ASCII. Texts without any are not walked."""
    out = text
    for sign, plain in SIGNS.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.when(text.rlike("[" + "".join(SIGNS) + "]"), out).otherwise(text)


def worked_answer(answer: Column) -> Column:
    """The reasoning of a worked answer: what stands before the last ####, without <<annotations>>, in one line."""
    before = F.when(F.contains(answer, F.lit("####")), F.regexp_replace(answer, r"(?s)####(?:(?!####).)*\z", ""))
    return squeeze(F.regexp_replace(before, "<<[^<>]*>>", ""))


def final_number(answer: Column) -> Column:
    """The plain decimal after the last ####; null if there is none."""
    found = F.regexp_extract(answer, r"####\s*([-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\s*\z", 1)
    return plain_decimal(F.replace(F.when(found != "", found), F.lit(","), F.lit("")))


def annotations(answer: Column) -> Column:
    """All <<annotations>> of a worked answer, in order."""
    return F.regexp_extract_all(answer, F.lit("<<([^<>]+)>>"), F.lit(1))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the canonical JSON of a base text."""
    return F.sha2(F.to_json(F.struct(F.lit("base").alias("kind"), normalise(text).alias("text"))), 256)


def turns_fingerprint(turns: Column) -> Column:
    """SHA-256 of the canonical JSON of a conversation, turns: array<struct<role, content>>."""
    rows = F.transform(turns, lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role")))
    return F.sha2(F.to_json(F.struct(F.lit("conversation").alias("kind"), rows.alias("turns"))), 256)


def seeded(seed: str, key: Column) -> Column:
    """SHA-256 of seed:key in hexadecimal, by which rows are ranked and split."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def bucket(seed: str, family: Column) -> Column:
    """0 to 9999: the first eight bytes of the seeded hash, big-endian, modulo 10000."""
    head = F.conv(F.substring(seeded(seed, family), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % 10_000).cast("int")


def split_of(bucket_: Column) -> Column:
    return F.when(bucket_ < 9_000, "train").when(bucket_ < 9_500, "validation").otherwise("test")


def has_control(text: Column) -> Column:
    """A control character other than new line and tab, or the replacement character."""
    return text.rlike(r"[\p{Cc}&&[^\n\t]]|�")


def has_secret(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in SECRETS))


def leaks_special(text: Column) -> Column:
    """Names a special token, in any case."""
    return F.exists(F.array(*map(F.lit, SPECIAL_NAMES)), lambda name: F.contains(F.upper(text), name))


def repeats_phrase(text: Column, times: int = 3, least_words: int = 9) -> Column:
    """A phrase of three words occurs so often. Equal phrases stand together once sorted, so no shuffle is needed."""
    # Inside a lambda an expression is computed for every element, so words and phrases are passed on as values.
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    pairs = lambda w: F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    phrases = lambda w: F.sort_array(F.zip_with(pairs(w), F.slice(w, 3, F.size(w)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))))
    # zip_with fills up with nulls, which equal nothing.
    again = lambda p: F.exists(F.zip_with(p, F.slice(p, times, F.size(p)), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    found = once(words, lambda w: F.when(F.size(w) >= least_words, once(phrases(w), again)))
    return F.coalesce(found, F.lit(False))


def plain_decimal(number: Column) -> Column:
    """A decimal in plain form: no plus sign, needless zeros or negative zero; null if it is none.

    Numbers of ASCII digits are exact at any length; others (exponents, other digits, blanks around) have to
    fit decimal(38,18).
    """
    text = number.cast("string")
    text = F.when(text.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?\z"), text).otherwise(number.try_cast("decimal(38,18)").cast("string"))
    text = F.regexp_replace(F.regexp_replace(text, r"^\+", ""), "^(-?)0+([0-9])", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def last_decimal(text: Column) -> Column:
    """The last decimal of a text, plain; null if there is none or the text holds any fraction."""
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(DECIMAL), F.lit(0)), F.lit(-1))
    return F.when(~text.rlike(FRACTION), plain_decimal(F.replace(found, F.lit(","), F.lit(""))))


def numbers(text: Column) -> Column:
    """The distinct decimals of a text, plain."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DECIMAL), F.lit(0)), lambda x: plain_decimal(F.replace(x, F.lit(","), F.lit(""))))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def has_unit(text: Column, unit: Column) -> Column:
    """The unit stands in the text, not inside a word; a null unit is always there."""
    # Literal text in a pattern: an end mark inside the unit itself is split off.
    quoted = F.concat(F.lit("(?i)(?<![A-Za-z0-9])\\Q"), F.replace(unit, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
    return F.coalesce(F.regexp_like(text, quoted), unit.isNull())
