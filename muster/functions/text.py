"""Text functions on columns that Spark's own differ from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Letters with diacritics and what they become.
PLAIN = {
    "a": "áàâäãåā", "A": "ÁÀÂÄÃÅĀ", "e": "éèêëēėę", "E": "ÉÈÊËĒĖĘ", "i": "íìîïī", "I": "ÍÌÎÏĪ", "o": "óòôöõōø", "O": "ÓÒÔÖÕŌØ", "u": "úùûüū", "U": "ÚÙÛÜŪ",
    "n": "ñňń", "N": "ÑŇŃ", "c": "çčć", "C": "ÇČĆ", "y": "ýÿ", "Y": "Ý", "d": "ðďđ", "D": "ÐĎĐ", "t": "þť", "T": "ÞŤ", "l": "ł", "L": "Ł", "z": "žźż", "Z": "ŽŹŻ", "s": "šś", "S": "ŠŚ", "r": "ř", "R": "Ř",
}
# Letters that become two.
WIDE = {"ß": "ss", "æ": "ae", "Æ": "AE"}


def ascii_lower(c: Column) -> Column:
    """Only A-Z are lowered."""
    return F.translate(c, UPPER, LOWER)


def trim_space(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_diacritics(c: Column) -> Column:
    """Precomposed letters of PLAIN and WIDE; all other characters stay."""
    for wide, narrow in WIDE.items():
        c = F.replace(c, F.lit(wide), F.lit(narrow))
    return F.translate(c, "".join(PLAIN.values()), "".join(k * len(v) for k, v in PLAIN.items()))


def plain(s: str) -> str:
    """without_diacritics of a Python string."""
    table = {x: k for k, v in PLAIN.items() for x in v} | WIDE
    return "".join(table.get(ch, ch) for ch in s)
