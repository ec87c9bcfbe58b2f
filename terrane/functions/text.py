"""Text functions on columns."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType


@cache
def _folds() -> tuple[str, str]:
    """Latin letters with marks and the letters without: from Unicode's decompositions, and the strokes that have none."""
    found = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            found[chr(code)] = base[0]
    return "".join(found), "".join(found.values())


# Letters of other scripts in Latin ones, lower case. Signs without a sound are dropped.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґўђћџљњјѓќѕ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia io i yi ie g u dj tsh dz lj nj j gj kj dz".replace("-", "").split(" "), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))


def _kana() -> dict[str, str]:
    """Both syllabaries by rule: consonants by vowels in the order of Unicode, where voiced forms follow plain ones."""
    vowels, out = "aiueo", []
    out += [v for v in vowels for _ in (0, 1)]  # small and full
    out += [c + v for v in vowels for c in "kg"]
    out += [{"si": "shi"}.get(c + v, c + v) for v in vowels for c in "sz"]
    out += [x for v in vowels for x in ({"i": ["chi", "di"], "u": ["tsu", "tsu", "du"]}.get(v, ["t" + v, "d" + v]))]
    out += ["n" + v for v in vowels]
    out += [c + v for v in vowels for c in "hbp"]
    out += ["m" + v for v in vowels]
    out += ["y" + v for v in "auo" for _ in (0, 1)]
    out += ["r" + v for v in vowels]
    out += ["wa", "wa", "wi", "we", "wo", "n", "vu"]
    return {chr(start + i): x for start in (0x3041, 0x30A1) for i, x in enumerate(out)}


@cache
def _scripts() -> dict[str, str]:
    """Letter to Latin letters: Cyrillic, Greek and kana, accented letters as plain ones, capitals with a capital first."""
    found = CYRILLIC | GREEK
    for code in range(0x370, 0x460):
        base = unicodedata.normalize("NFD", chr(code))
        if chr(code) not in found and len(base) > 1 and base[0] in found:
            found[chr(code)] = found[base[0]]
    for low, latin in list(found.items()):
        if low.upper() != low and len(low.upper()) == 1:
            found.setdefault(low.upper(), latin.capitalize())
    return found | _kana() | {"ー": "-"}


def transliterate(text: Column) -> Column:
    """Letters of Cyrillic, Greek and kana in Latin ones, one by one; all else stays. Texts without such letters are passed on as they
    are, by one look."""
    table = F.str_to_map(F.lit(";".join(f"{a}={b}" for a, b in _scripts().items())), F.lit(";"), F.lit("="))  # folded to one constant
    letters = F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)
    spelled = F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(F.regexp_like(text, F.lit("[\u0370-\u045f\u0490\u0491\u3041-\u30ff]")), spelled).otherwise(text)


def fold_ascii(text: Column) -> Column:
    """Latin letters without their marks, other scripts in Latin letters; combining marks are dropped, so composed and decomposed texts
    fold alike."""
    marked, plain = _folds()
    return F.regexp_replace(transliterate(F.translate(text, marked, plain)), r"[̀-ͯ]", "")


def normalize_text(text: Column, ascii_fold: bool = True, drop_punct: bool = True) -> Column:
    """Strip, lower-case, blank out punctuation but - + / & _, fold to ASCII, one space between words."""
    out = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    if drop_punct:
        out = F.regexp_replace(out, r"(?U)[^\w\s\-+/&]", " ")
    if ascii_fold:
        out = fold_ascii(out)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def name_normalized(name: Column) -> Column:
    """Case-folded name; accents stay."""
    return F.trim(F.lower(name))


def extract_domain(url: Column) -> Column:
    """Host of a URL in lower case, without port and one leading 'www.'; null where there is none."""
    clean = F.trim(url)
    full = F.when(F.contains(clean, F.lit("://")), clean).otherwise(F.concat(F.lit("http://"), clean))
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


# Vietnamese national numbers after the leading 0, by kind: mobile prefixes and landline area codes.
VN_MOBILE = r"(?:3[2-9]|5[25689]|7[06789]|8[1-9]|9[0-9])[0-9]{7}"
VN_FIXED = r"2(?:4|8)[0-9]{8}|2(?:0[3-9]|1[0-689]|2[0-25-9]|3[2-9]|5[124-9]|6[0-39]|7[0-7]|9[0-4679])[0-9]{7}"


def phone_e164(phone: Column) -> Column:
    """E.164 form of a valid Vietnamese number (or of any number given with another country's code), else null.

    Numbers of other countries are checked for their length only: whole number plans of the world are not held here.
    """
    clean = F.regexp_replace(F.trim(F.regexp_replace(phone, "·", " ")), r"(?i)(?:ext\.?|x)\s*[0-9]+$", "")
    digits = F.regexp_replace(clean, r"[^0-9+]", "")
    shaped = F.regexp_like(clean, F.lit(r"^\+?[0-9(][0-9\s().\-/]*$"))
    national = F.regexp_extract(digits, rf"^(?:\+84|0084|84|0)0?({VN_MOBILE}|{VN_FIXED})$", 1)
    abroad = F.regexp_extract(digits, r"^\+((?!84)[1-9][0-9]{7,14})$", 1)
    return F.when(shaped & (national != ""), F.concat(F.lit("+84"), national)).when(shaped & (abroad != ""), F.concat(F.lit("+"), abroad))


@pandas_udf(StringType())
def _canonical_json(payloads: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            out = json.dumps(json.loads(text, parse_constant=_refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            out.encode()  # half a surrogate pair has no UTF-8
            return out
        except (ValueError, RecursionError):
            return None

    return payloads.map(one, na_action="ignore").astype(object).where(payloads.notna(), None)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


#: Looked for one character after another, so a payload's length never deepens the matcher's stack. What the built-in form can't
#: take: escapes, control characters, and characters beyond the basic plane, which it would sort as two.
_NOT_PLAIN_TEXT = r"[\\\x00-\x08\x0b\x0c\x0e-\x1f\x{10000}-\x{10ffff}]"
#: A string without escapes, and what may not stand outside of strings: any number but plain integers of at most 18 digits.
_PLAIN_STRING, _NOT_PLAIN_REST = r'"[^"]*+"', r"[^\[\]{}:,0-9a-z \n\r\t-]|[0-9]e|[0-9]{19}"


def content_hash(payload: Column) -> Column:
    """SHA-256 of canonical JSON: keys sorted at every depth by code point, no blanks, of a repeated key the last value, floats
    in their shortest form that reads back (1.0 stays 1.0, 1e-07 stays 1e-07). Null where the payload is null, empty
    or no JSON, and where an escape is half a surrogate pair, which has no UTF-8.

    Payloads without floats and escapes, most of them, stay in built-in expressions; Arrow batches take the others, and those that
    the built-in parser refuses (repeated keys, great depth or size).
    """
    rest = F.regexp_replace(payload, _PLAIN_STRING, "0")
    plain = ~F.regexp_like(payload, F.lit(_NOT_PLAIN_TEXT)) & ~F.regexp_like(rest, F.lit(_NOT_PLAIN_REST))
    made = F.when(plain, F.to_json(F.try_parse_json(payload)))
    # The parser stops after the first value; what follows, and anything else not carried over, shows in the length without blanks.
    whole = F.length(payload) - F.length(rest) + F.length(F.translate(rest, " \n\r\t", ""))
    built_in = F.when(F.length(made) == whole, made)
    return F.sha2(F.coalesce(built_in, _canonical_json(F.when(built_in.isNull(), payload))), 256)


def api_key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def api_key_valid(key: Column, stored: Column, prefix: str = "pl_") -> Column:
    """Whether a key has the prefix of keys and the stored hash; false where either is missing."""
    return F.coalesce(key.startswith(prefix) & (api_key_hash(key) == stored), F.lit(False))


def pair_key(a: Column, b: Column) -> Column:
    """Order-independent key of a pair of ids."""
    return F.concat_ws(":", F.least(a, b), F.greatest(a, b))


def pair_digest(a: Column, b: Column) -> Column:
    """Order-independent digest of a pair of texts, for pairs without ids: the first 16 digits of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 16)


def lenient_reply(reply: Column) -> Column:
    """same, confidence, reason (at most 500 characters) from a model's reply: the outermost JSON object in it."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "same boolean, confidence double, reason string")
    return F.struct(F.coalesce(parsed["same"], F.lit(False)).alias("same"), F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"), F.substring(F.coalesce(parsed["reason"], F.lit("")), 1, 500).alias("reason"))


def humanized_age(then: Column, now: Column) -> Column:
    """Age as seconds, minutes, hours or days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(then.isNull(), F.lit("—")).when(s < 60, part(1, "s ago")).when(s < 3600, part(60, "m ago")).when(s < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))
