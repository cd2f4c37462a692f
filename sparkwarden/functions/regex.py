"""Patterns are written in the web's dialect (ASCII \\b, Unicode \\s, no final-newline $) and made into Java patterns here."""

from __future__ import annotations

import re

WORD = "A-Za-z0-9_"
#: White space and line ends of the web's dialect, for use inside a character class.
SPACES = "\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
ENDS = "\\n\\r\\u2028\\u2029"
BOUNDARY = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
#: What Java takes for i, k or s where the case doesn't matter, beyond ASCII.
FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def java(pattern: str, flags: str = "") -> str:
    """The Java pattern with the same meaning; flags: i (any case, beyond ASCII too) and m (lines)."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c, pair = pattern[k], pattern[k : k + 2]
        if c == "\\":
            if pair == "\\s":
                out.append(SPACES if inside else f"[{SPACES}]")
            elif pair == "\\S":
                out.append(f"[^{SPACES}]" if not inside else f"&&[^{SPACES}]")
            elif pair == "\\b" and not inside:
                out.append(BOUNDARY)
            else:
                out.append(pair)
            k += 2
            continue
        if c == "[":
            # in Java an inner [ or && would nest classes
            out.append("\\[" if inside else "[")
            if not inside and pattern[k + 1 : k + 2] == "^":
                out.append("^")
                k += 1
            inside = True
        elif c == "]" and inside:
            inside = False
            out.append(c)
        elif inside and c == "&":
            out.append("\\&")
        elif c == "." and not inside:
            out.append(f"[^{ENDS}]")
        elif c == "^" and not inside and "m" in flags:
            out.append(f"(?<![^{ENDS}])")
        elif c == "$" and not inside:
            out.append(f"(?=[{ENDS}]|(?![\\s\\S]))" if "m" in flags else "(?![\\s\\S])")
        else:
            out.append(c)
        k += 1
    return ("(?iu)" if "i" in flags else "") + "".join(out)


def _heads(tokens) -> tuple[frozenset[str], bool]:
    """The letters that a part of a pattern can begin with, and whether it can be empty."""
    out: frozenset[str] = frozenset()
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            return out | {chr(arg)}, False
        if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            return out | {chr(a) for _, a in arg}, False
        if name == "BRANCH":
            parts = [_heads(b) for b in arg[1]]
            some, empty = frozenset().union(*(p for p, _ in parts)), any(e for _, e in parts)
        elif name == "SUBPATTERN":
            some, empty = _heads(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            some, empty = _heads(arg[2])
            empty = empty or arg[0] == 0
        else:
            raise ValueError(f"no first letters: {name}")
        out |= some
        if not empty:
            return out, False
    return out, True


def keyed(pattern: str) -> str:
    """java(pattern, "i") of a pattern of key words (a border of a word and ASCII letters); a look at the first letter spares most places the rest."""
    heads, empty = _heads(re._parser.parse(pattern[2:])) if pattern.startswith("\\b") else (frozenset(), True)
    if empty or not all(h.isascii() and h.isalpha() for h in heads):
        raise ValueError(f"not a pattern of key words: {pattern}")
    first = "".join(sorted(heads | {h.upper() for h in heads})) + "".join(FOLDED.get(h, "") for h in sorted(heads))
    return f"(?=[{first}])(?<![{WORD}{''.join(FOLDED.values())}])" + java(pattern[2:], "i")


def literals(pattern: str, least: int = 3) -> frozenset[str] | None:
    """Strings of which every match holds at least one; None if there are none of `least` characters.

    They let a cheap search for substrings spare most texts the pattern itself.
    """

    def of(tokens) -> frozenset[str] | None:
        best, run = None, ""

        def better(found: frozenset[str] | None) -> None:
            nonlocal best
            if found and all(len(x) >= least for x in found) and (best is None or (min(map(len, found)), -len(found)) > (min(map(len, best)), -len(best))):
                best = found

        for op, arg in tokens:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
                continue
            better(frozenset([run]))
            run = ""
            if name == "SUBPATTERN":
                better(of(arg[3]))
            elif name == "BRANCH":
                parts = [of(b) for b in arg[1]]
                better(frozenset().union(*parts) if all(parts) else None)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                better(of(arg[2]))
        better(frozenset([run]))
        return best

    return of(re._parser.parse(pattern))


#: Strings in a set of `required`, at most: a longer list of choices says little.
MOST_CHOICES = 64


def _exact(tokens) -> frozenset[str] | None:
    """All strings that a part of a pattern can match; None if they are too many or unknown."""
    runs = frozenset([""])
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            some = frozenset([chr(arg)])
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            some = frozenset(chr(a) for _, a in arg)
        elif name == "SUBPATTERN":
            some = _exact(arg[3])
        elif name == "BRANCH":
            parts = [_exact(b) for b in arg[1]]
            some = frozenset().union(*parts) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and tuple(arg[:2]) == (0, 1):
            some = _exact(arg[2])
            some = some and some | {""}
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue  # of no width
        else:
            return None
        if not some or len(runs) * len(some) > MOST_CHOICES:
            return None
        runs = frozenset(a + b for a in runs for b in some)
    return runs


def required(pattern: str, least: int = 3) -> tuple[frozenset[str], ...]:
    """Sets of strings of `least` characters or more: a match of the pattern holds one string of each set."""

    def of(tokens) -> list[frozenset[str]]:
        out, runs = [], frozenset([""])

        def cut() -> None:
            nonlocal runs
            if all(len(x) >= least for x in runs):
                out.append(runs)
            runs = frozenset([""])

        for token in tokens:
            op, arg = token
            name = str(op)
            if name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue
            some = _exact([token])
            once = _exact(arg[2]) if some is None and name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0 else None
            if some and len(runs) * len(some) > MOST_CHOICES:
                cut()
            if some or once and len(runs) * len(once) <= MOST_CHOICES:
                runs = frozenset(a + b for a in runs for b in some or once)
                if once:
                    cut()
                continue
            cut()
            if name == "SUBPATTERN":
                out += of(arg[3])
            elif name == "BRANCH":
                parts = [of(b) for b in arg[1]]
                if all(parts):
                    out.append(frozenset().union(*(max(p, key=lambda s: (min(map(len, s)), -len(s))) for p in parts)))
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                out += of(arg[2])
        cut()
        return out

    return tuple(dict.fromkeys(of(re._parser.parse(pattern))))


def any_of(strings: frozenset[str] | set[str], wide: int = 5) -> str:
    """A Java pattern of many strings that shares their beginnings and takes the longest at a place.

    Where more than `wide` characters can follow, a look at a class of them comes before they are tried one by one.
    """

    def of(rest: list[str]) -> str:
        ends, heads = "" in rest, {}
        for s in rest:
            if s:
                heads.setdefault(s[0], []).append(s[1:])
        options = [re.escape(c) + of(heads[c]) for c in sorted(heads)]
        if len(options) > wide:
            keys = sorted(heads)
            options = [f"(?=[{''.join(map(re.escape, keys[k : k + wide]))}])(?:{'|'.join(options[k : k + wide])})" for k in range(0, len(keys), wide)]
        if not options:
            return ""
        return f"(?:{'|'.join(options)}){'?' if ends else ''}" if ends or len(options) > 1 else options[0]

    return of(sorted(strings))
