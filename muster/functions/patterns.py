"""Patterns that users write: checked, and run in time that grows with the length of a value and no faster.

The dialect is that of linear-time engines: no look-around, no backreferences, ``$`` only at the very end, ``\\d \\w \\s \\b``
by Unicode and POSIX classes by ASCII.  Java differs in these, and it backtracks: ``a*b`` takes it quadratic time on a long
value, ``(?:a|b)*`` a stack as deep as the value.  So a pattern is read when a pipeline is built:

* Alternatives of single characters become classes, and for a mere search repeats at the pattern's outer ends are shortened
  to what they need at least.
* What is left runs in the JVM if it provably ends soon wherever it starts: a bounded number of steps, with repeats without
  bound over single characters only, either where a match ends or once after a ``^``.
* Any other pattern runs in tasks in RE2, in Arrow batches, in linear time.
* Patterns that need RE2 and hold what it doesn't know (``\\b``, ``\\W`` in a class, set operations) are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError

MOST_BYTES, MOST_NESTING, MOST_CAPTURES, MOST_REPLACEMENT, MOST_REPEAT = 128, 3, 1, 256, 1000
#: Steps that a pattern may take in the JVM from any start; repeats of groups may nest calls no deeper.
MOST_STEPS, MOST_DEPTH = 2000, 200
#: Fixed values of the dialect: POSIX classes, as ranges of ASCII.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~",
    "punct": r"!-/:-@\[-`{-~", "space": r"\t-\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Classes of Unicode in RE2, whose own are ASCII: white space and its complement, word characters.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NO_SPACE = r"\x{0}-\x{8}\x{E}-\x{1F}!-\x{84}\x{86}-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}"
WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
RE2_CLASSES = {r"\d": r"\p{Nd}", r"\D": r"\P{Nd}", r"\s": SPACE, r"\S": NO_SPACE, r"\w": WORD}


# --- reading


@dataclass(frozen=True)
class Node:
    """kind: char, class (text as it stands), dot, mark (of no width), flags, group (text: how it opens), seq, alt, repeat."""

    kind: str
    text: str = ""
    parts: tuple[Node, ...] = ()
    least: int = 1
    most: int | None = 1
    lazy: bool = False


class _Reader:
    def __init__(self, pattern: str) -> None:
        self.pattern, self.at, self.captures, self.depth, self.spaced = pattern, 0, 0, 0, False

    def wrong(self, what: str) -> ConfigurationError:
        return ConfigurationError(f"pattern {self.pattern!r}: {what}")

    def take(self, expression: str) -> re.Match | None:
        m = re.compile(expression, re.S).match(self.pattern, self.at)
        self.at = m.end() if m else self.at
        return m

    def alternatives(self) -> Node:
        branches = [self.sequence()]
        while self.take(r"\|"):
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else Node("alt", parts=tuple(branches))

    def sequence(self) -> Node:
        parts = []
        while True:
            if self.spaced:
                self.take(r"(?:\s|#[^\n]*)*")
            if self.at == len(self.pattern) or self.pattern[self.at] in "|)":
                break
            atom = self.atom()
            while m := self.take(r"([*+?])|\{(\d+)(,?)(\d*)\}"):
                if atom.kind in ("flags", "mark") or atom.kind == "repeat":
                    raise self.wrong(f"nothing to repeat before {m[0]}")
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[1]] if m[1] else (int(m[2]), int(m[4]) if m[4] else None if m[3] else int(m[2]))
                if max(least, most or 0) > MOST_REPEAT:
                    raise self.wrong(f"repeats of more than {MOST_REPEAT} are not supported")
                if most is not None and most < least:
                    raise self.wrong(f"{m[0]} has no length")
                atom = Node("repeat", "", (atom,), least, most, bool(self.take(r"\?")))
                if self.take(r"\+"):
                    raise self.wrong("possessive quantifiers are not supported")
            parts.append(atom)
        return parts[0] if len(parts) == 1 else Node("seq", parts=tuple(parts))

    def atom(self) -> Node:
        if m := self.take(r"\((?:\?P?<([A-Za-z_]\w*)>|\?([imsUx-]*)(:|\))|(?!\?))"):
            if m[2] and not re.fullmatch(r"[imsux]*(-[imsx]*)?", m[2]):
                raise self.wrong(f"(?{m[2]}) is not supported")
            spaced, (on, _, off) = self.spaced, (m[2] or "").partition("-")
            self.spaced = "x" in on or self.spaced and "x" not in off
            flags = re.sub("-$", "", f"{on}-{off}".replace("x", "").replace("u", ""))
            if m[3] == ")":
                return Node("flags", flags)
            self.captures += m[1] is None and m[2] is None
            self.depth += 1
            if self.depth > MOST_NESTING:
                raise self.wrong(f"groups are nested deeper than {MOST_NESTING}")
            if self.captures > MOST_CAPTURES:
                raise self.wrong(f"more than {MOST_CAPTURES} capture group")
            inner = self.alternatives()
            self.depth -= 1
            if not self.take(r"\)"):
                raise self.wrong("a group isn't closed")
            self.spaced = spaced
            return Node("group", f"?{flags}:" if m[2] is not None else f"?<{m[1]}>" if m[1] else "", (inner,))
        if self.take(r"\("):
            raise self.wrong("look-around and atomic groups are not supported")
        if self.pattern[self.at] == "[":
            return Node("class", self.class_())
        if m := self.take(r"\\[bBA]|\\z|[\^$]"):
            return Node("mark", m[0])
        if m := self.take(r"\\[dDsSwW]|\\[pP](?:\{\^?[\w=:]+\}|\w)"):
            return Node("class", m[0])
        if m := self.take(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[xu]\{[0-9A-Fa-f]{1,6}\}|[tnrfav]|[^\w\s])"):
            return Node("char", m[0])
        if m := self.take(r"\\.?"):
            raise self.wrong(f"{m[0]} is not supported")
        if m := self.take(r"[*+?]"):
            raise self.wrong(f"nothing to repeat before {m[0]}")
        return Node("dot", ".") if self.take(r"\.") else Node("char", self.take(r".")[0])

    def class_(self) -> str:
        begin, depth = self.at, 0
        while True:
            if m := self.take(r"\[:\^?(\w+):\]" if depth else r"(?!)"):
                if m[1] not in POSIX:
                    raise self.wrong(f"unknown class {m[0]}")
            elif self.take(r"\[\^?\]?"):
                depth += 1
            elif self.take(r"\]"):
                depth -= 1
                if not depth:
                    return self.pattern[begin : self.at]
            elif not self.take(r"\\.|[^\[\]]"):
                raise self.wrong("a class isn't closed")


def read(pattern: str) -> Node:
    """Raise ConfigurationError for patterns that are empty, long, deeply nested, or use what linear-time engines lack."""
    if not pattern:
        raise ConfigurationError("pattern must not be empty")
    if len(pattern.encode()) > MOST_BYTES:
        raise ConfigurationError(f"pattern is longer than {MOST_BYTES} bytes")
    reader = _Reader(pattern)
    got = reader.alternatives()
    if reader.at < len(pattern):
        raise reader.wrong("a group isn't open")
    return got


def nodes(n: Node):
    yield n
    for p in n.parts:
        yield from nodes(p)


# --- rewriting


def plain(n: Node) -> Node:
    """Alternatives of single characters as classes."""
    n = replace(n, parts=tuple(map(plain, n.parts)))
    if n.kind == "alt" and all(p.kind == "char" or p.kind == "class" and p.text[0] == "\\" for p in n.parts):
        return Node("class", "[" + "".join("\\" + p.text if re.fullmatch(r"[&~#\-\[\]^]", p.text) else p.text for p in n.parts) + "]")
    if n.kind == "group" and n.text in ("", "?:") and n.parts[0].kind in ("char", "class", "dot"):
        return n.parts[0]
    return n


def shortened(n: Node) -> Node:
    """Of a pattern that is only searched for: repeats at its outer ends, as short as they may be."""
    if n.kind == "alt":
        return replace(n, parts=tuple(map(shortened, n.parts)))
    parts = list(n.parts) if n.kind == "seq" else [n]
    begin = next((k for k, p in enumerate(parts) if p.kind != "flags"), 0)
    flags, parts = parts[:begin], parts[begin:]
    for at in (0, -1):
        while parts and parts[at].kind == "repeat" and parts[at].least != parts[at].most:
            if parts[at].least:
                parts[at] = replace(parts[at], most=parts[at].least)
            else:
                parts.pop(at)
    parts = flags + parts
    return parts[0] if len(parts) == 1 else Node("seq", parts=tuple(parts))


# --- what it takes the JVM


def single(n: Node) -> bool:
    return n.kind in ("char", "class", "dot")


def steps(n: Node, last: bool, endless: list[int]) -> tuple[float, float, float]:
    """At most: steps from one start, ways to match, calls within each other.  endless[0] repeats without bound may be taken
    that have something after them; infinite if it can't be told."""
    if n.kind == "seq":
        all_, ways, depth = 1.0, 1.0, 0.0
        for k, p in enumerate(n.parts):
            s, w, d = steps(p, last and k == len(n.parts) - 1, endless)
            all_, ways, depth = all_ + ways * s, ways * w, depth + d
        return all_, ways, depth
    if n.kind == "alt":
        each = [steps(p, last, endless) for p in n.parts]
        return sum(s for s, _, _ in each), sum(w for _, w, _ in each), max(d for *_, d in each)
    if n.kind == "group":
        s, w, d = steps(n.parts[0], last, endless)
        return s + 1, w, d + 1
    if n.kind == "repeat":
        if n.most is None:
            if not single(n.parts[0]) or not last and not endless[0]:
                return (float("inf"),) * 3
            endless[0] -= not last
            return 1.0 + n.least, 1.0, 1.0
        s, w, d = steps(n.parts[0], False, [0])
        if n.parts and single(n.parts[0]):
            return 1.0 + n.most, 1.0 + n.most - n.least, 1.0
        paths = [w**k for k in range(n.most + 1)] if w * n.most < 1e6 and w ** min(n.most, 99) < 1e6 else [float("inf")]
        return 1 + s * sum(paths), sum(paths[n.least :]), (d + 2) * n.most
    return 1.0, 1.0, 1.0


def by_line(n: Node) -> bool:
    """Whether a flag lets ^ and $ match at the ends of lines."""
    return any(x.kind == "flags" and "m" in x.text.split("-")[0] or x.kind == "group" and ":" in x.text and "m" in x.text.split("-")[0] for x in nodes(n))


def soon(n: Node) -> bool:
    """Whether the JVM takes a bounded number of steps from each start, or linear time from the only one."""
    anchored = not by_line(n) and n.kind == "seq" and bool(n.parts) and n.parts[0].kind == "mark" and n.parts[0].text in ("^", r"\A")
    s, _, depth = steps(n, True, [1 if anchored else 0])
    return s <= MOST_STEPS and depth <= MOST_DEPTH


# --- writing


def _class_parts(text: str) -> list[str]:
    """Of a class in brackets: what opens it, its members, and what closes it."""
    return re.findall(r"\[:\^?\w+:\]|\[\^?\]?|\\[pP](?:\{\^?[\w=:]+\}|\w)|\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[xu]\{[0-9A-Fa-f]+\}|.)|&&|--|~~|.", text, re.S)


def _posix(part: str) -> tuple[bool, str] | None:
    m = re.fullmatch(r"\[:(\^?)(\w+):\]", part)
    return (bool(m[1]), POSIX[m[2]]) if m else None


def _java_class(text: str) -> str:
    out = []
    for k, part in enumerate(_class_parts(text) if text[0] == "[" else [text]):
        if posix := _posix(part):
            part = f"[{'^' if posix[0] else ''}{posix[1]}]"
        elif part in ("[]", "[^]"):
            part = part[:-1] + r"\]"
        elif part in ("#", r"\v"):
            part = r"\#" if part == "#" else r"\x0B"
        elif m := re.fullmatch(r"\\([pP])\{\^(.+)\}", part):
            part = f"\\{'P' if m[1] == 'p' else 'p'}{{{m[2]}}}"
        elif m := re.fullmatch(r"\\u\{(.+)\}", part):
            part = rf"\x{{{m[1]}}}"
        out.append(part)
    return "".join(out)


def _re2_class(text: str) -> str:
    if text == r"\W":
        return f"[^{WORD}]"
    if text[0] != "[":
        return f"[{RE2_CLASSES[text]}]" if text in RE2_CLASSES else text
    parts, out = _class_parts(text), []
    for k, part in enumerate(parts):
        if part in (r"\W", "&&", "--", "~~") or k and part.startswith("[") and not _posix(part) and part != "[":
            raise ValueError(f"{part} in a class")
        if k and part == "[":
            raise ValueError("a class in a class")
        if (posix := _posix(part)) and posix[0]:
            raise ValueError(f"{part} in a class")
        if m := re.fullmatch(r"\\u\{?([0-9A-Fa-f]+)\}?", part):
            part = rf"\x{{{m[1]}}}"
        out.append(posix[1] if posix else RE2_CLASSES.get(part, part))
    return "".join(out)


def written(n: Node, java: bool, lines: bool = False) -> str:
    """The pattern in the dialect of java.util.regex or RE2."""
    if n.kind == "seq":
        return "".join(written(p, java, lines) for p in n.parts)
    if n.kind == "alt":
        return "|".join(written(p, java, lines) for p in n.parts)
    if n.kind == "group":
        return f"({n.text if java else n.text.replace('?<', '?P<')}{written(n.parts[0], java, lines)})"
    if n.kind == "repeat":
        most = "" if n.most is None else n.most
        atom = written(n.parts[0], java, lines)
        return (atom if n.parts[0].kind != "repeat" and n.parts[0].kind != "seq" else f"(?:{atom})") + f"{{{n.least},{most}}}" + "?" * n.lazy
    if n.kind == "flags":
        return f"(?{n.text})" if n.text else ""
    if n.kind == "class":
        return _java_class(n.text) if java else _re2_class(n.text)
    if n.kind == "mark":
        if not java and n.text in (r"\b", r"\B"):
            raise ValueError(n.text)
        return r"\z" if n.text == "$" and not lines else n.text
    if n.kind == "char" and (m := re.fullmatch(r"\\u\{?([0-9A-Fa-f]+)\}?", n.text)):
        return rf"\x{{{m[1]}}}"
    if n.kind == "char" and n.text == r"\v":
        return r"\x0B"
    return n.text if n.kind != "char" or len(n.text) > 1 or not java or n.text != "#" else r"\#"


@dataclass(frozen=True)
class Compiled:
    """A pattern as one engine takes it."""

    java: str | None = None
    re2: str | None = None


def compiled(pattern: str, searched: bool = False) -> Compiled:
    """The pattern, compiled once on the driver so that mistakes show up before any task runs.  searched: nobody asks what
    has matched."""
    tree = plain(read(pattern))
    lines = by_line(tree)
    if searched and tree.kind in ("seq", "alt", "repeat"):
        tree = shortened(tree)
    java, spark = "(?U)(?d)" + written(tree, True, lines), SparkSession.getActiveSession()
    if soon(tree):
        try:
            if spark is not None:
                spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
            return Compiled(java=java)
        except Exception:  # RE2 may know it
            why = "does not compile"
    else:
        why = "would take too long on long values"
    try:
        re2 = written(tree, False, lines)
        pc.match_substring_regex(pa.array([""]), pattern=re2)
    except (ValueError, pa.ArrowInvalid) as e:
        raise ConfigurationError(f"pattern {pattern!r} {why} ({e})") from e
    return Compiled(re2=re2)


def check(pattern: str) -> None:
    """Raise ConfigurationError for a pattern that can't be run."""
    compiled(pattern)


def found(c: Column, pattern: str) -> Column:
    """Whether the pattern matches anywhere; null for null."""
    how = compiled(pattern, searched=True)
    if how.java is not None:
        return c.rlike(how.java)
    re2 = how.re2

    @F.arrow_udf("boolean")
    def search(values: pa.Array) -> pa.Array:
        return pc.match_substring_regex(values, pattern=re2)

    return search(c)


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """The first match replaced by the replacement as it stands."""
    if len(replacement.encode()) > MOST_REPLACEMENT:
        raise ConfigurationError(f"replacement is longer than {MOST_REPLACEMENT} bytes")
    how = compiled(pattern)
    if how.java is not None:
        literal = replacement.replace("\\", r"\\").replace("$", r"\$")
        return F.regexp_replace(c, r"\A([\s\S]*?)(?:" + how.java + ")", "$1" + literal)
    re2, literal = rf"\A((?s:.*?))(?:{how.re2})", r"\1" + replacement.replace("\\", r"\\")

    @F.arrow_udf("string")
    def replaced(values: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(values, pattern=re2, replacement=literal)

    return replaced(c)
