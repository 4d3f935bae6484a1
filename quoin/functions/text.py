"""Text functions as Spark columns, each with the same function on Python strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "•·▪◦‣–-"
ALNUM = r"[\p{IsAlphabetic}\p{N}]"
SPACED = rf"(?<=(?:^| ){ALNUM} {ALNUM}) (?={ALNUM}(?: |$))|(?<=(?:^| ){ALNUM}) (?={ALNUM} {ALNUM}(?: |$))"
NOT_HEADING = r"[∑∫≤≥≈∞±×÷√{}^_$]|www\.|\.com"


def is_bullet(s: Column) -> Column:
    return s.rlike(rf"(?U)^[{BULLETS}]\s")


def strip_bullet(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)^[{BULLETS}]*\s*", "")


def ordered_number(s: Column) -> Column:
    """The digits of an ordered list's mark, null without one."""
    return F.nullif(F.regexp_extract(s, r"^([0-9]+)[.)][ \t\n\f\r]+", 1), F.lit(""))


def is_page_number(s: Column) -> Column:
    return s.rlike(r"(?U)^\s*(?:[Pp]age )?\s*[0-9]+\s*$")


def digits_masked(s: Column) -> Column:
    return F.regexp_replace(s, "[0-9]+", "#")


def word_count(s: Column) -> Column:
    return F.size(F.filter(F.split(s, r"(?U)\s+"), lambda x: x != ""))


def collapse_letters(s: Column) -> Column:
    """Runs of three or more single letters or digits, spaced, become a word."""
    return F.regexp_replace(s, SPACED, "")


def collapse_dots(s: Column) -> Column:
    return F.regexp_replace(s, r" ?(?:\. *){4,}", " ")


def rejoin_decimals(s: Column) -> Column:
    return F.regexp_replace(s, r"([0-9]) ?\. (?=[0-9])", "$1.")


def clean(s: Column) -> Column:
    t = F.regexp_replace(s, "\t", " ")
    t = rejoin_decimals(collapse_dots(collapse_letters(t)))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def collapse_blanks(s: Column) -> Column:
    """A run of blanks is a tab if it holds one, else a space."""
    return F.regexp_replace(F.regexp_replace(s, "[ \t]*\t[ \t]*", "\t"), " +", " ")


def heading_like(s: Column) -> Column:
    tail = F.regexp_extract(s, r"([0-9 -]*)$", 1)
    digits = F.length(F.regexp_replace(tail, "[^0-9]", ""))
    plain = F.length(F.regexp_replace(s, r"(?U)[^\p{IsAlphabetic}\p{N}.,:;()'&\s-]", ""))
    return ~s.rlike(NOT_HEADING) & (digits < 6) & s.rlike(r"(?U)\S") & (plain >= F.length(s) * F.lit(0.85))


def table_norm(s: Column) -> Column:
    t = F.regexp_replace(F.lower(s), "[’‘]", "'")
    t = F.regexp_replace(t, r"(?:\s*\.){4,}\s*", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9.()%†+-]+", " "), " +", " "))


def cell_norm(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def letters_only(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def occurrences(s: Column, literal: Column) -> Column:
    return F.when(F.length(literal) > 0, ((F.length(s) - F.length(F.replace(s, literal, F.lit("")))) / F.length(literal)).cast("long")).otherwise(F.lit(0).cast("long"))


def short_key(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 24)


def clip(s: Column, most: int = 14_000) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("\n[clipped]"))).otherwise(s)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves upwards, negative ones too."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


# --- the same on Python strings ---------------------------------------------------------------


def py_is_bullet(s: str) -> bool:
    return len(s) > 1 and s[0] in BULLETS and s[1].isspace()


def py_strip_bullet(s: str) -> str:
    return s.lstrip(BULLETS).lstrip()


def py_ordered(s: str) -> tuple[str, int] | None:
    m = re.match(r"([0-9]+)[.)][ \t\n\f\r]+", s)
    return (m.group(1), m.end()) if m else None


def py_is_page_number(s: str) -> bool:
    return re.fullmatch(r"\s*(?:[Pp]age )?\s*[0-9]+\s*", s) is not None


def py_collapse_letters(s: str) -> str:
    out, run = [], []
    for p in [*s.split(" "), None]:
        if p is not None and len(p) == 1 and p.isalnum():
            run.append(p)
            continue
        out += ["".join(run)] if len(run) >= 3 else run
        run = []
        if p is not None:
            out.append(p)
    return " ".join(out)


THREE_LETTERS, DOTS, DECIMALS = re.compile(r"(?:^| )\w \w \w(?: |$)"), re.compile(r" ?(?:\. *){4,}"), re.compile(r"([0-9]) ?\. (?=[0-9])")


def py_clean(s: str) -> str:
    t = s.replace("\t", " ")
    # most texts have nothing to mend
    if THREE_LETTERS.search(t):
        t = py_collapse_letters(t)
    if t.count(".") >= 4:
        t = DOTS.sub(" ", t)
    if ". " in t:
        t = DECIMALS.sub(r"\1.", t)
    return " ".join(t.split())


def py_heading_like(s: str) -> bool:
    if re.search(NOT_HEADING, s) or not s.strip():
        return False
    tail = re.search(r"[0-9 -]*$", s).group(0)
    if sum(c.isdigit() for c in tail) >= 6:
        return False
    return sum(c.isalnum() or c.isspace() or c in ".,:;()'&-" for c in s) >= 0.85 * len(s)


def py_table_norm(s: str) -> str:
    t = re.sub(r"(?:\s*\.){4,}\s*", " ", re.sub("[’‘]", "'", s.lower()), flags=re.ASCII)
    return re.sub(" +", " ", re.sub(r"[^a-z0-9.()%†+-]+", " ", t)).strip(" ")


def py_cell_norm(s: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split())
