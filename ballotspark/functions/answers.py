r"""Integer answers from solution texts, as column expressions.

An answer is struct(status, key). status is INT, NOT_INT (a number was read, but no integer) or FAIL; key is the
integer in canonical decimal digits (no leading zeros, no minus zero), of any length, and null unless status is INT.
Digits are ASCII 0-9. Everything here is built-in functions, so it stays in the JVM and needs no second pass.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------------------------------------
# Words that stand for a unit and are dropped before a box is read.
UNIT_WORDS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "inch", "ft", "feet",
    "hours", "hour", "minutes", "minute", "seconds", "km", "cm", "mm", "meters", "meter",
    "units", "unit", "points", "point", "digits", "digit", "cents", "students",
    "people", "years", "year", "days", "day", "times", "degrees", "degree",
]
# Phrases that announce the answer.
CLOSERS = [
    r"final answer is", r"the answer is", r"answer\s*[:=]", r"answer is",
    r"therefore,?", r"thus,?", r"hence,?", r"so,?\s*the",
]
# A number in running text.
NUMBER = r"-?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?"
# An arithmetic step.
STEP = r"-?\d[\d,]*(?:\.\d+)?\s*[-+*/×÷]\s*-?\d[\d,]*(?:\.\d+)?"
# How far back a closing phrase counts, and how far ahead of it a number.
TAIL_CHARS, AFTER_CHARS = 400, 120
TOLERANCE, RELATIVE, LARGEST = 1e-9, 1e-12, 1e17
# Forms of a number.
_WHOLE = r"^-?\d+\z"
_DECIMAL = r"^-?\d*\.?\d+(?:[eE][-+]?\d+)?\z"
_SCIENTIFIC = r"^(-?\d+(?:\.\d+)?)\s*\*\s*10\^\{?(-?\d+)\}?\z"
_FRACTIONS = [r"^\\[dt]?frac\s*\{(-?\d+)\}\s*\{(-?\d+)\}\z", r"^\\[dt]?frac(-?\d)(-?\d)\z", r"^(-?\d+)\s*/\s*(-?\d+)\z"]
# --------------------------------------------------------------------------------------------------------------------

_CLOSING = "(?is)^.*(?:" + "|".join(CLOSERS) + ")"


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _answer(status: str, key: Column | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(None) if key is None else key).cast("string").alias("key"))


def integer_key(digits: Column) -> Column:
    """Canonical key of a string of an optional minus and digits."""
    bare = F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1")
    return F.when(bare == "-0", "0").otherwise(bare)


def sort_fields(key: Column) -> list[Column]:
    """Columns whose order is the numeric order of keys of any length."""
    minus, size = key.startswith("-"), F.length(key)
    # among negatives the longer and lexically larger is the smaller: 9 - digit for each digit turns that round
    turned = F.translate(key, "0123456789", "9876543210")
    return [F.when(minus, 0).otherwise(1), F.when(minus, -size).otherwise(size), F.when(minus, turned).otherwise(key)]


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends; SQL's trim strips spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _closed(inner: Column, open_ok: bool) -> Column:
    """What stands before the brace that closes an already opened one. If none does: all, or null.

    The text is cut behind every brace and depth is folded over the pieces, so the cost follows the number of braces
    and nesting may be of any depth.
    """
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))

    def step(acc: Column, piece: Column) -> Column:
        change = F.when(piece.endswith("{"), 1).when(piece.endswith("}"), -1).otherwise(0)
        moved = F.struct((acc["depth"] + change).alias("depth"), (acc["size"] + F.length(piece)).alias("size"))
        return F.when(acc["depth"] == 0, acc).otherwise(moved)

    whole = inner if open_ok else F.lit(None).cast("string")
    end = F.aggregate(F.split(inner, r"(?<=[{}])"), start, step)
    return _let(end, lambda e: F.when(e["depth"] == 0, F.substring(inner, F.lit(1), e["size"] - 1)).otherwise(whole))


def last_box(text: Column) -> Column:
    r"""Content of the last \boxed{..}, or else of the last \fbox{..}; to the end of the text if it isn't closed."""

    def content(token: str) -> Column:
        behind = F.when(F.instr(text, token) > 0, F.substring_index(text, token, -1))
        inner = _let(behind, lambda b: F.when(F.locate("{", b) > 0, F.substring(b, F.locate("{", b) + 1, F.length(b))))
        return _let(inner, lambda x: F.when(x.isNotNull(), _closed(x, True)))

    return F.coalesce(content("\\boxed"), content("\\fbox"))


def first_box(text: Column) -> Column:
    r"""Content of the first \boxed{..}; null without one, or if it isn't closed."""
    behind = F.split(text, r"\\boxed\s*\{", 2)
    return _let(F.get(behind, F.lit(1)), lambda inner: F.when(inner.isNotNull(), _closed(inner, False)))


def strip_latex(text: Column) -> Column:
    """Without spacing commands, text groups, signs of currency and percent, and unit words. The order of the steps
    matters: a group's content goes before units are looked for."""
    plain = [("\\!", ""), ("\\,", ""), ("\\;", ""), ("\\ ", " "), ("\\left", ""), ("\\right", "")]
    out = reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), plain, text)
    out = F.regexp_replace(out, r"\\(?:mbox|text|mathrm|textbf|mathbf)\s*\{[^}]*\}", "")
    out = F.regexp_replace(out, r"\\displaystyle|;|\$|\\%|%", "")
    out = F.regexp_replace(out, "[\u2212\u2013\u2014]", "-")
    out = F.regexp_replace(out, r"\\cdot|\\times", "*")
    out = F.regexp_replace(out, r"(?iU)\b(?:" + "|".join(UNIT_WORDS) + r")\b", "")
    return trimmed(out)


def _near_integer(value: Column, tolerance) -> Column:
    """tolerance: of the value."""

    def read(v: Column) -> Column:
        key = F.when(F.bround(v, 0) == 0, "0").otherwise(F.bround(v, 0).cast("decimal(38,0)").cast("string"))
        return F.when(F.abs(v - F.bround(v, 0)) < tolerance(v), _answer("INT", key)).otherwise(_answer("NOT_INT"))

    return _let(value, read)


def _fraction(text: Column) -> Column:
    r"""Exact value of \frac{a}{b}, \frac ab in shorthand, or a/b; null if it is none, or b is 0."""
    text = trimmed(text)
    out = None
    for pattern in _FRACTIONS:
        num, den = (F.regexp_extract(text, pattern, k).try_cast("decimal(38,0)") for k in (1, 2))
        rest = F.try_mod(num, F.when(den != 0, den))
        whole = F.when(rest == 0, _answer("INT", integer_key(F.try_divide(num, den).cast("decimal(38,0)").cast("string")))).when(rest.isNotNull(), _answer("NOT_INT"))
        found = F.when(F.regexp_like(text, F.lit(pattern)), whole)
        out = found if out is None else F.coalesce(out, found)
    return out


def to_answer(text: Column) -> Column:
    """The number that a text is, read after strip_latex: fraction, a * 10^b, integer, decimal. A trailing exponent
    (of a unit) is dropped, so 2^{10} reads as 2."""

    def scientific(t: Column) -> Column:
        mantissa, power = (F.regexp_extract(t, _SCIENTIFIC, k).try_cast("double") for k in (1, 2))
        near = lambda v: _near_integer(v, lambda x: F.greatest(F.lit(TOLERANCE), F.abs(x) * RELATIVE))
        return _let(mantissa * F.pow(F.lit(10.0), power), lambda v: F.when(F.abs(v) < 1e38, near(v)).otherwise(_answer("FAIL")))

    def read(t: Column) -> Column:
        return F.when(F.coalesce(t, F.lit("")) == "", _answer("FAIL")).otherwise(
            F.coalesce(_fraction(t), F.when(F.regexp_like(t, F.lit(_SCIENTIFIC)), scientific(t)), _let(F.regexp_replace(t, r"\^\{?\d+\}?\z", ""), _plain))
        )

    return _let(F.regexp_replace(strip_latex(text), "[, ]", ""), read)


def _plain(text: Column) -> Column:
    decimal = lambda v: F.when(F.abs(v) > LARGEST, _answer("FAIL")).otherwise(_near_integer(v, lambda _: F.lit(TOLERANCE)))
    return F.when(F.regexp_like(text, F.lit(_WHOLE)), _answer("INT", integer_key(text))).when(F.regexp_like(text, F.lit(_DECIMAL)), _let(text.try_cast("double"), decimal)).otherwise(_answer("FAIL"))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def last_number(text: Column, only_one: bool = False) -> Column:
    """Key of the last number that is an integer; with only_one null unless the text has just one number."""

    def read(tokens: Column) -> Column:
        keys = F.filter(F.transform(tokens, lambda t: _let(F.replace(t, F.lit(","), F.lit("")), _plain)["key"]), lambda k: k.isNotNull())
        last = _let(keys, lambda k: F.get(k, F.size(k) - 1))
        return F.when(F.size(tokens) == 1, last) if only_one else last

    return _let(number_tokens(text), read)


def extract_answer(text: Column, tail_chars: int = TAIL_CHARS) -> Column:
    """Key of a solution's final answer, or null. A box decides if there is one: its integer, or its only number if
    it can't be read, and nothing if it holds another number. Else the last integer soon after the last closing
    phrase near the end; else the last integer of the text."""

    def boxed(box: Column) -> Column:
        read = lambda a: F.when(a["status"] == "INT", a["key"]).when(a["status"] == "FAIL", last_number(box, only_one=True))
        return _let(to_answer(box), read)

    tail = F.right(text, F.lit(tail_chars))
    after = _let(tail, lambda t: F.when(F.regexp_like(t, F.lit(_CLOSING)), F.substring(F.regexp_replace(t, _CLOSING, ""), 1, AFTER_CHARS)))
    return _let(last_box(text), lambda box: F.when(box.isNotNull(), boxed(box)).otherwise(F.coalesce(last_number(after), last_number(text))))


def rounded_box(text: Column) -> Column:
    """Key of a box's value rounded half to even, if it is a fraction or decimal; a guess, for submissions only."""

    def quotient(box: Column) -> Column:
        out = None
        for pattern in _FRACTIONS:
            num, den = (F.regexp_extract(box, pattern, k).try_cast("double") for k in (1, 2))
            found = F.when(F.regexp_like(box, F.lit(pattern)), F.try_divide(num, den))
            out = found if out is None else F.coalesce(out, found)
        return out

    number = lambda t: F.when(F.regexp_like(t, F.lit(_DECIMAL)), t.try_cast("double"))
    value = _let(F.regexp_replace(strip_latex(last_box(text)), "[, ]", ""), lambda box: F.coalesce(quotient(box), _let(F.regexp_replace(box, r"\^\{?\d+\}?\z", ""), number)))
    return _let(value, lambda v: F.when(F.abs(v) < LARGEST, F.when(F.bround(v, 0) == 0, "0").otherwise(F.bround(v, 0).cast("decimal(38,0)").cast("string"))))


def extract_or_fallback(text: Column, fallback: str = "0") -> Column:
    """A key in any case: the answer, the rounded box, the last integer near the end, or the fallback."""
    return F.coalesce(extract_answer(text), rounded_box(text), last_number(F.right(text, F.lit(TAIL_CHARS))), F.lit(fallback))


def final_integer(text: Column) -> Column:
    """Key of an external solution's answer: its first box if that is an integer of up to 17 digits, nothing else if it
    has a box; else the only integer of its last line."""
    short = lambda v: _let(v, lambda s: F.when(F.regexp_like(s, F.lit(r"^-?\d{1,17}\z")), integer_key(s)))
    # cut at line ends: a pattern for what stands before the end is tried from every place of the lines ahead of it
    line = F.element_at(F.split(trimmed(text), r"[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), -1)
    tokens = F.regexp_extract_all(line, F.lit(r"-?\d[\d,]*"), F.lit(0))
    only = _let(tokens, lambda t: F.when(F.size(t) == 1, F.replace(F.get(t, F.lit(0)), F.lit(","), F.lit(""))))
    return _let(first_box(text), lambda box: F.when(box.isNotNull(), short(trimmed(F.regexp_replace(box, r"[,$]", "")))).otherwise(short(only)))


def with_box(text: Column, key: Column) -> Column:
    """The text, with a closing sentence that boxes the answer if it has no complete box."""
    return F.when(first_box(text).isNotNull(), text).otherwise(F.concat(F.regexp_replace(text, r"(?U)\s+\z", ""), F.lit("\n\nThe final answer is \\boxed{"), key, F.lit("}.")))


def path_hash(text: Column) -> Column:
    """The arithmetic steps of a solution, joined; its first 80 characters if it has none."""
    steps = F.transform(F.regexp_extract_all(text, F.lit(STEP), F.lit(0)), lambda s: F.regexp_replace(s, "[ ,]", ""))
    return F.coalesce(F.nullif(F.array_join(steps, "|"), F.lit("")), F.left(text, F.lit(80)))


def mentions(text: Column, key: Column) -> Column:
    """Whether the number stands in the text by itself, not as part of a longer one."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])"), key, F.lit(r"(?![\d.])")))


def early_answer(text: Column, key: Column, share: float = 0.25, digits: int = 3) -> Column:
    """Whether an answer of three digits or more stands in the first quarter of the text already."""
    head = F.substring(text, F.lit(1), F.floor(F.length(text) * share).cast("int"))
    return (F.length(F.replace(key, F.lit("-"), F.lit(""))) >= digits) & mentions(head, key)


def model_tag(path: Column) -> Column:
    """A path's last part with only safe characters; `model` if nothing is left."""
    name = F.regexp_extract(F.regexp_replace(path, r"/+\z", ""), r"([^/]*)\z", 1)
    return F.coalesce(F.nullif(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit("model"))


def has_latex(text: Column, with_roots: bool = True) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\$|\\frac|\\text" + (r"|\\sqrt" if with_roots else ""))), F.lit(False))


def wrong_cause(text: Column, truncated: Column, key: Column) -> Column:
    """The stage at which a wrong answer went wrong."""
    return F.when(truncated, "truncated").when(last_box(text).isNull(), "no_box").when(key.isNull(), "box_unparsed").otherwise("wrong_answer")


def submission_integer(value: Column) -> Column:
    """Whether a submitted value is an integer: digits but for '-' and '.', and no fraction."""
    number = value.try_cast("double")
    return F.coalesce(F.regexp_like(F.regexp_replace(value, "[-.]", ""), F.lit(r"^\d+\z")) & (number == F.floor(number)), F.lit(False))
