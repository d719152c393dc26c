"""What one answer says: plain scalars that read a text from left to right. The frame functions are in answers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

from quillspark.functions.text import ASCII_DIGITS, BENGALI_DIGITS

VERIFIABLE = ("numeric", "fraction", "percent", "mcq_option", "bool_bn")
NUMBERS = ("numeric", "fraction", "percent")
#: The longest field that is an answer by itself.
BARE = 40

# Words for true and false, units, currency signs, markers of answers, LaTeX commands.
TRUE_WORDS = ("সঠিক", "সত্য", "হ্যাঁ", "হ্যাঁ।")
FALSE_WORDS = ("ভুল", "মিথ্যা", "না", "অসত্য")
UNITS = (
    "টাকা", "টি", "টা", "জন", "মিটার", "কিমি", "কিলোমিটার", "সেমি", "সেন্টিমিটার", "ঘন্টা", "ঘণ্টা", "মিনিট", "সেকেন্ড", "দিন", "বছর", "মাস", "কেজি", "গ্রাম",
    "লিটার", "ডিগ্রি", "বর্গমিটার", "cm", "mm", "km", "kg", "g", "ml", "hr", "min", "sec", "unit", "units", "dollar", "dollars",
)
CURRENCIES = ("$", "₹", "৳")
HASH_MARKER = "####"
ANSWER_WORDS = ("উত্তর", "ফলাফল")
COPULAS = ("হচ্ছে", "হলো", "হল", "হবে")
COLONS = (":", "ঃ")
LETTERS = "ABCDEabcde"
TEXT_COMMANDS = ("text", "textbf", "mathrm")
SYMBOLS = ("sqrt", "pi", "infty", "sum", "int", "log", "ln", "sin", "cos", "tan", "alpha", "beta", "theta")
SPACING = ("\\!", "\\,", "\\;", "\\:")
LAYOUT = ("left", "right", "displaystyle", "textstyle")

_TO_ASCII = str.maketrans(BENGALI_DIGITS, ASCII_DIGITS)
_LATIN = re.compile(r"[a-zA-Z\\]")


class Reader:
    """A text and how far it has been read."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def run(self, chars: str) -> str:
        """All that comes next of these characters."""
        start = self.at
        while self.at < len(self.text) and self.text[self.at] in chars:
            self.at += 1
        return self.text[start : self.at]

    def one(self, chars: str) -> str:
        """The next character if it is one of these, else nothing."""
        got = self.text[self.at : self.at + 1]
        if got and got in chars:
            self.at += 1
            return got
        return ""

    def word(self, *words: str) -> str:
        """The longest of these words that comes next."""
        found = max((w for w in words if self.text.startswith(w, self.at)), key=len, default="")
        self.at += len(found)
        return found

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    @property
    def ended(self) -> bool:
        return self.at == len(self.text)


def boxes(text: str) -> Iterator[str]:
    """What each balanced \\boxed{...} holds, in order; an unbalanced one ends them."""
    at = 0
    while (at := text.find("\\boxed", at)) >= 0 and (left := text.find("{", at)) >= 0:
        depth = 0
        for i in range(left, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                break
        else:
            return
        yield text[left + 1 : i]
        at = i + 1


def last_box(text: str | None) -> str | None:
    found = None
    for found in boxes(text or ""):  # noqa: B007  the last one is wanted
        pass
    return found


def _rest_of_line(text: str, at: int) -> str | None:
    """From at, the first line with something on it; None if nothing but line feeds is left, blank if only blanks are."""
    r = Reader(text, at)
    r.space()
    if r.ended:
        return "" if text[at:].strip("\n") else None
    return text[r.at :].split("\n", 1)[0].strip()


def after_hashes(text: str) -> str | None:
    at = text.find(HASH_MARKER)
    while at >= 0:
        if (found := _rest_of_line(text, at + len(HASH_MARKER))) is not None:
            return found or None
        at = text.find(HASH_MARKER, at + 1)
    return None


def after_answer_word(text: str) -> str | None:
    at = 0
    while starts := [i for w in ANSWER_WORDS if (i := text.find(w, at)) >= 0]:
        at = min(starts)
        r = Reader(text, at)
        r.word(*ANSWER_WORDS)
        r.space()
        r.word(*COPULAS)
        r.space()
        if r.word(*COLONS) and (found := _rest_of_line(text, r.at)) is not None:
            return found or None
        at += 1
    return None


def extract(*fields: str | None) -> tuple[str | None, str | None]:
    """(raw, method): boxed, then the marker of hashes, then the Bengali marker of each field in turn; then a short bare field."""
    texts = [(f or "").strip() for f in fields]
    for text in texts:
        for method, found in (("boxed", (last_box(text) or "").strip()), ("gsm_marker", after_hashes(text)), ("bn_marker", after_answer_word(text))):
            if found:
                return found, method
    bare = next((t for t in texts if t and len(t) <= BARE and "\n" not in t), None)
    return bare, bare and "bare"


def clean(answer: str) -> str:
    """Without decoration that carries no meaning."""
    a = answer.strip().strip("$").strip()
    for s in SPACING:
        a = a.replace(s, "")
    for command in LAYOUT:
        head, *rest = a.split("\\" + command)
        for part in rest:  # a longer command that begins alike stays
            head += part if not (part[:1].isalnum() or part[:1] == "_") else f"\\{command}{part}"
        a = head
    a = a.replace("\\ ", " ").strip()
    bare = a.rstrip()
    if bare.endswith(",") and bare[-2:-1] and bare[-2] in ASCII_DIGITS + BENGALI_DIGITS:
        a = bare[:-1]
    bare = a.rstrip()
    return (bare[:-1] if bare[-1:] in (".", "।") and bare else a).strip()


def plain_number(text: str) -> bool:
    """Digits with groups of three after commas, a sign and decimals if any."""
    r = Reader(text)
    r.one("+-")
    if not r.run(ASCII_DIGITS):
        return False
    while r.one(","):
        if len(r.run(ASCII_DIGITS)) != 3:
            return False
    return not (r.one(".") and not r.run(ASCII_DIGITS)) and r.ended


def percentage(text: str) -> str | None:
    """The number before a per cent sign."""
    r = Reader(text)
    number = r.one("+-") + r.run(ASCII_DIGITS + ".")
    r.space()
    r.one("\\")
    return number if number.strip("+-") and r.one("%") and r.ended else None


def quotient(text: str) -> tuple[str, str] | None:
    """Numerator and denominator of a LaTeX fraction or of two whole numbers with a slash."""
    r = Reader(text)
    if r.word("\\frac", "\\dfrac", "\\tfrac"):
        parts = []
        for _ in range(2):
            if not r.one("{"):
                return None
            parts.append(r.one("-") + r.run(ASCII_DIGITS + "."))
            if not parts[-1].strip("-") or not r.one("}"):
                return None
        return (parts[0], parts[1]) if r.ended else None
    above = r.one("-") + r.run(ASCII_DIGITS)
    r.space()
    slash = r.one("/")
    r.space()
    below = r.run(ASCII_DIGITS)
    return (above, below) if above.strip("-") and slash and below and r.ended else None


def amount(text: str) -> str:
    """The number of an amount with a currency sign before it or a unit behind, else the text as it is."""
    for unit_behind in (False, True):
        r = Reader(text)
        if not unit_behind:
            r.one("\\")
            if not r.word(*CURRENCIES):
                continue
            r.space()
        start = r.at
        r.one("+-")
        if not r.run(ASCII_DIGITS + ","):
            continue
        at = r.at
        if r.one(".") and not r.run(ASCII_DIGITS):
            r.at = at
        number = text[start : r.at]
        if unit_behind:
            r.space()
            left = text[r.at :]
            if left in UNITS or left.endswith(".") and left[:-1] in UNITS:
                return number
        elif r.ended:
            return number
    return text


def option(text: str) -> str | None:
    """The letter of an answer that is nothing but an option's letter."""
    r = Reader(text)
    if r.one("\\"):
        if not r.word(*TEXT_COMMANDS) or not r.one("{"):
            return None
        r.space()
    r.one("(")
    letter = r.one(LETTERS)
    while r.at < len(text) and (text[r.at] in ".)" or text[r.at].isspace()):
        r.at += 1
    r.one("}")
    return letter.upper() if letter and r.ended else None


def option_with_value(text: str) -> tuple[str | None, str | None]:
    """(letter, value) of an option's letter with what it stands for."""
    r = Reader(text)
    r.one("\\")
    r.word(*TEXT_COMMANDS)
    r.space()
    r.one("{")
    r.space()
    r.one("(")
    letter = r.one(LETTERS)
    if not letter:
        return None, None
    after = r.at
    r.one(")")
    r.space()
    if not r.one(":.)"):
        r.at = after  # the bracket itself is the sign
        r.space()
        if not r.one(":.)"):
            return None, None
    if r.ended:
        return None, None
    r.space()
    r.one("}")
    return letter.upper(), text[r.at :].strip().rstrip("}").strip() or None


def unwrapped(text: str) -> str:
    """What a text command holds if it is all there is."""
    r = Reader(text)
    if r.one("\\") and r.word(*TEXT_COMMANDS, "textit") and r.one("{") and text.endswith("}") and "\n" not in text:
        return text[r.at : -1].strip()
    return text.strip()


def finite(text: str) -> float | None:
    try:
        x = float(text) if "_" not in text else math.nan
    except ValueError:
        return None
    return x if math.isfinite(x) else None


def reduced(above: str, below: str) -> Fraction | None:
    try:
        return Fraction(above) / Fraction(below)
    except (ValueError, ZeroDivisionError):
        return None


@dataclass(frozen=True)
class Value:
    """An answer as a type: num, frac or text, and key; all None where it has no such value."""

    type: str
    num: float | None = None
    frac: Fraction | None = None
    text: str | None = None

    @property
    def key(self) -> str | None:
        if self.frac is not None:
            return f"{self.type}|{self.frac.numerator}/{self.frac.denominator}"
        return None if self.num is None and self.text is None else f"{self.type}|{self.text if self.num is None else self.num}"

    @property
    def number(self) -> float | None:
        """A fraction as its quotient, a percentage as a share of one."""
        try:
            return float(self.frac) if self.frac is not None else self.num / 100 if self.type == "percent" and self.num is not None else self.num
        except OverflowError:
            return None


class Form:
    """An answer as it is looked at for its type and value."""

    def __init__(self, answer: str | None):
        plain = clean(answer or "")
        self.text = plain.translate(_TO_ASCII)
        self.inner = unwrapped(self.text)
        self.compact = amount(self.text.replace(" ", ""))
        self.letter, self.stands_for = option(self.text), None
        if not self.letter:
            self.letter, self.stands_for = option_with_value(plain)
        self.kind = self._kind()

    def _kind(self) -> str:
        c = self.compact
        if not self.text:
            return "missing"
        if self.inner in TRUE_WORDS or self.inner in FALSE_WORDS:
            return "bool_bn"
        if self.letter:
            return "mcq_option"
        for kind, found in (("numeric", plain_number(c)), ("percent", percentage(c)), ("fraction", quotient(c)), ("symbolic", any("\\" + s in c for s in SYMBOLS)), ("expression", _LATIN.search(c))):
            if found:
                return kind
        return "other"

    def value(self, kind: str | None = None) -> Value:
        kind = kind or self.kind
        if kind == "numeric":
            return Value(kind, num=finite(self.compact.replace(",", "")))
        if kind == "percent":
            return Value(kind, num=finite(percentage(self.compact) or ""))
        if kind == "fraction":
            parts = quotient(self.compact)
            return Value(kind, frac=reduced(*parts) if parts else None)
        if kind == "mcq_option":
            return Value(kind, text=self.letter)
        if kind == "bool_bn":
            return Value(kind, text="true" if self.inner in TRUE_WORDS else "false" if self.inner in FALSE_WORDS else None)
        return Value(kind)


def close(a: float | None, b: float | None) -> bool:
    return a is not None and b is not None and abs(a - b) <= max(1e-9, 1e-6 * max(abs(a), abs(b)))


def judge(gold: Form, kind: str, raw: str | None) -> tuple[bool, str, Value, Value | None]:
    """(correct, reason, gold's value, prediction's value): the first step of the ladder that decides."""
    want = gold.value(kind)
    if kind not in VERIFIABLE:
        return False, f"unverifiable_type:{kind}", want, None
    if want.key is None:
        return False, "gold_uncanonicalizable", want, None
    if raw is None:
        return False, "no_answer_in_prediction", want, None
    given = Form(raw)
    have = given.value(kind)
    stands = Form(gold.stands_for).value() if kind == "mcq_option" and gold.stands_for else Value("missing")
    paid = stands.type in VERIFIABLE and stands.key is not None and stands.key == given.value(stands.type).key
    if have.key is None:
        own = given.value()
        if kind in NUMBERS and given.kind in NUMBERS and own.number is not None and want.number is not None:
            return close(want.number, own.number), "cross_type_numeric", want, have
        return (True, "mcq_payload_compare", want, have) if paid else (False, f"pred_uncanonicalizable:{given.kind}", want, have)
    if kind in ("numeric", "percent"):
        return close(want.num, have.num), "numeric_compare", want, have
    if kind == "fraction":
        return want.frac == have.frac, "fraction_compare", want, have
    if want.text != have.text and paid:
        return True, "mcq_payload_compare", want, have
    return want.key == have.key, f"{kind}_compare", want, have
