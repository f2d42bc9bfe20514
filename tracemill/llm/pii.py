"""Personal data: expressions propose spans, checks confirm them, context adjusts the score.

Each kind has an expression that proposes, a validator where the kind has a
check digit or a range (Luhn for cards, modulo 97 for IBANs, octets for IPv4,
area and group numbers for US social security numbers), a base score, and
context words in the languages of the corpus.  A span that its validator
refuses is no finding, whatever stands near it; of a card or an IBAN, which
may swallow numbers and words beside it, all parts that begin and end where a
group of characters does are tried as well.  A context word within WINDOW
characters before or after raises the score by CONTEXT; FINDING is the least
score of a finding.  Where findings overlap, the one that starts first, then
the longest, then the best stays.

Every kind needs a digit, an at sign, a colon, an equals sign or the beginning
of a known form of key.  A text without any of them can hold nothing and is
passed by; digits are those of any script, and every other text is searched
whole.  Each search takes time in proportion to the text: an expression either
has a bounded length, or no two of its starts read on over the same characters.

A secret is a name with one of SECRET_WORDS at a boundary of its parts
(`password`, `DB_PASSWORD`, `clientSecret`) and what is assigned to it: up to
the closing quote, or up to white space, a comma or a bracket.

Defined cases: a null or empty text has no finding and stays as it is; null
doc_ids, and ids of any type, keep their findings; very long texts are searched whole; rows that
repeat are each reported; an empty table gives no rows; further columns stay in
`redact`, and n_chars, where present, becomes the length of the new text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tracemill.llm import textkit as tk
from tracemill.llm.cluster import prepare

WINDOW, CONTEXT, FINDING = 60, 0.3, 0.5


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    total = sum(digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return total % 10 == 0


_IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24, "TR": 26}


def mod97(text: str) -> bool:
    s = re.sub(r"[ -]", "", text).upper()
    if _IBAN_LENGTH.get(s[:2], len(s)) != len(s) or not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def octets(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(int(p) < 256 and (p == "0" or p[0] != "0") for p in parts)


def social_security(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def dialled(text: str) -> bool:
    return 8 <= sum(c.isdigit() for c in text) <= 15


_RUN, _GROUP = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,}"), re.compile(r"\d+")
#: Groups in which cards are printed.
_PRINTED = frozenset([(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 4, 5)])


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Spans of whole groups of digits that pass Luhn and don't overlap: those as cards are printed and begin first, then the longest, then the first."""
    for run in _RUN.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        if re.match(r"[\w-]", text[run.end() : run.end() + 1]):
            groups.pop()
        # Sums of the digits up to each place, plain and doubled, of even and of odd places: each span's Luhn sum is then a difference.
        plain, double, edge = [[0], [0]], [[0], [0]], [0]
        for a, b in groups:
            for d in map(int, text[a:b]):
                k = len(plain[0]) - 1 & 1
                for side in (0, 1):
                    plain[side].append(plain[side][-1] + d * (side == k))
                    double[side].append(double[side][-1] + (2 * d - 9 * (d > 4)) * (side == k))
            edge.append(len(plain[0]) - 1)
        found = []
        for i in range(len(groups)):
            for j in range(i, len(groups)):
                s, e = edge[i], edge[j + 1]
                if e - s > 19:
                    break
                k = e - 1 & 1
                if e - s >= 13 and (plain[k][e] - plain[k][s] + double[1 - k][e] - double[1 - k][s]) % 10 == 0 and luhn(text[groups[i][0] : groups[j][1]]):
                    usual = i == j or tuple(b - a for a, b in groups[i : j + 1]) in _PRINTED
                    found.append((not usual, text[groups[i][0]] not in "23456", s - e, i, j + 1))
        used = bytearray(len(groups))
        for *_, i, j in sorted(found):
            if not any(used[i:j]):
                used[i:j] = b"\1" * (j - i)
                yield groups[i][0], groups[j - 1][1]


_COUNTRY, _ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}"), re.compile(r"[ -]?[A-Z0-9]")


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the longest span that passes modulo 97, and on behind it; a start without one is passed by alone."""
    at = 0
    while m := _COUNTRY.search(text, at):
        ends, end, length = [], m.end(), _IBAN_LENGTH.get(m.group()[:2])
        for n in range(5, 35):
            if not (c := _ACCOUNT.match(text, end)):
                break
            end = c.end()
            if n == (length or max(n, 15)) and not re.match(r"\w", text[end : end + 1]):
                ends.append(end)
        at = next((e for e in reversed(ends) if mod97(text[m.start() : e])), 0)
        if at:
            yield m.start(), at
        else:
            at = m.start() + 1


#: What a secret's name ends with, or has before a further part.
SECRET_WORDS = r"(?:api|access|secret|private|account|encryption|auth)[_-]?key|(?:auth|access|refresh|session|bearer)[_-]?token|client[_-]?secret|token|secret|password|passphrase|passwd|pwd"


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Assignments to a secret's name, from where the name begins; a stop at the end of the value isn't part of it."""
    done = 0
    for m in _FIND["secret"].finditer(text):
        start, end = m.span()
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_-."):
            start -= 1
        while text[start] in "-.":
            start += 1
        while text[end - 1] in ".:?":
            end -= 1
        done = m.end()
        yield start, end


@dataclass(frozen=True)
class Kind:
    pattern: str
    score: float
    context: str
    valid: Callable[[str], bool] | None = None
    #: Finds the valid spans in place of the expression, where a valid one may lie inside one that is refused.
    search: Callable[[str], Iterator[tuple[int, int]]] | None = None


KINDS: dict[str, Kind] = {
    "email": Kind(r"(?<![\w.+%-])[\w+%-](?:[\w.+%-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![\w-])", 0.9, "e-?mail|mail|contact|kontakt|correo|courriel|write"),
    "card": Kind(r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])", 0.7, "card|visa|mastercard|amex|credit|karte|carte|tarjeta|cvv", luhn, cards),
    "iban": Kind(r"(?<!\w)[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{1,4}){3,8}(?!\w)", 0.8, "iban|konto|account|bank|compte|cuenta|bic", mod97, ibans),
    "ipv4": Kind(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)", 0.6, "ip|address|host|server|adresse|direcci.n", octets),
    "us_ssn": Kind(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", 0.5, "ssn|social|security", social_security),
    "phone": Kind(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?|\(\d{2,4}\)[ .-]?)\d{1,4}(?:[.-]?\d{2,4}| \d{2,4}(?![\d.]*\d)){1,5}(?![\w-])", 0.6, "phone|tel|call|mobile|fax|telefon|handy|tel.fono|t.l.phone|portable", dialled),
    "phone_plain": Kind(r"(?<![\w+.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])", 0.5, "phone|tel|call|mobile|fax|telefon|handy|tel.fono|t.l.phone|portable", dialled),
    "phone_spaced": Kind(r"(?<![\w+.-])\d{3} \d{3} \d{4}(?![\w-])", 0.4, "phone|tel|call|mobile|fax|telefon|handy|tel.fono|t.l.phone|portable", dialled),
    "secret": Kind(
        r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:" + SECRET_WORDS + r")[\w-]{0,24}?[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}"
        r"(?:\"(?:[^\"\\\n]|\\.){8,}+\"|'(?:[^'\\\n]|\\.){8,}+'|[\"']?[^\s\"'`,;&<>()\[\]{}|]{8,}+[\"']?)",
        0.9, "key|token|secret|auth", search=secrets),
    # Keys by their form.
    "secret_plain": Kind(
        r"(?<![\w-])(?:AKIA[0-9A-Z]{16}(?!\w)|gh[pousr]_[A-Za-z0-9]{36}(?!\w)|xox[baprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+"
        r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)|-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----(?:[^-]|-(?!----))++-----END \1PRIVATE KEY-----",
        0.9, "key|token|secret|auth"),
}
_FIND = {k: re.compile(v.pattern) for k, v in KINDS.items()}
_NEAR = {k: re.compile(rf"(?i)(?<!\w)(?:{v.context})(?!\w)") for k, v in KINDS.items()}
_HINT = np.zeros(256, np.int64)
_HINT[48:58] = 1
_HINT[[58, 61, 64]] = 1
# Digits of other scripts begin with these bytes.
_HINT[[0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xEA, 0xEF, 0xF0]] = 1
_KEY = r"AKIA[0-9A-Z]{16}|gh[pousr]_|xox[baprs]-|sk-[A-Za-z0-9_-]{20}|eyJ[A-Za-z0-9_-]{10}|-----BEGIN "


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the findings in text, in order; positions count characters."""
    found = []
    for kind, how in KINDS.items():
        spans = how.search(text) if how.search else (m.span() for m in _FIND[kind].finditer(text) if how.valid is None or how.valid(m.group()))
        for start, end in spans:
            near = text[max(0, start - WINDOW) : start] + "\n" + text[end : end + WINDOW]
            score = round(min(1.0, how.score + CONTEXT * bool(_NEAR[kind].search(near))), 2)
            if score >= FINDING:
                found.append((kind, start, end, score))
    found.sort(key=lambda x: (x[1], -x[2], -x[3], x[0]))
    kept: list[tuple[str, int, int, float]] = []
    for x in found:
        if not kept or x[1] >= kept[-1][2]:
            kept.append(x)
    return kept


def hinted(column: pa.Array) -> np.ndarray:
    """Rows with a digit, an at sign, a sign of assignment, or how a key begins."""
    out = [np.zeros(0, bool)]
    for _, _, data, off in tk.chunks(column):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_HINT[data], out=total[1:])
        out.append(total[off[1:]] > total[off[:-1]])
    return np.concatenate(out) | pc.fill_null(pc.match_substring_regex(column, _KEY), False).to_numpy(zero_copy_only=False)


_FINDINGS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@F.arrow_udf(_FINDINGS)
def _scan(text: pa.Array) -> pa.Array:
    look = hinted(text)
    return pa.array([[dict(zip(("kind", "start", "end", "score"), x)) for x in scan(text[i].as_py())] if look[i] else [] for i in range(len(text))], _ARROW)


def shown(kind: str) -> str:
    """The kind without the form in which it was found."""
    return re.sub("_(plain|spaced)$", "", kind)


def mask(text: str) -> str:
    """text with each finding replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in scan(text):
        out += [text[at:start], f"[{shown(kind).upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if at else text


@F.arrow_udf(StringType())
def _mask(text: pa.Array) -> pa.Array:
    look = np.flatnonzero(hinted(text))
    new = [(i, t, m) for i in look for t in [text[int(i)].as_py()] for m in [mask(t)] if m != t]
    if not new:
        return text
    return pc.replace_with_mask(text, pa.array(np.isin(np.arange(len(text)), [i for i, _, _ in new])), pa.array([m for _, _, m in new], text.type))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, score: a row for each finding."""
    prepare(docs.sparkSession)
    found = docs.select("doc_id", F.explode(_scan(F.col("text").cast("string"))).alias("f"))
    return found.select("doc_id", F.regexp_replace("f.kind", "_(plain|spaced)$", "").alias("kind"), "f.start", "f.end", "f.score")


def redact(docs: DataFrame) -> DataFrame:
    """docs with the findings in text replaced by their kinds; columns and rows stay."""
    prepare(docs.sparkSession)
    out = docs.withColumn("text", _mask(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
