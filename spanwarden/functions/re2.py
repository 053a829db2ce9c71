"""RE2 patterns for Java's matcher.

Java and RE2 disagree on case folding of k and s, on what \\b, \\s and . cover, and on $. ``re2``
rewrites a pattern so that Java matches what RE2 would.
"""

from __future__ import annotations

_SPACE = r"\t\n\f\r "
_FOLD = {"k": "kK\u212a", "K": "kK\u212a", "s": "sS\u017f", "S": "sS\u017f"}
_WORD = "0-9A-Za-z_"


def re2(pattern: str) -> str:
    out: list[str] = []
    fold = dot_all = in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("(?", i) and not in_class:
            end = i + 2
            while pattern[end] in "ismU-":
                end += 1
            flags = pattern[i + 2 : end]
            if flags and pattern[end] in "):":
                fold, dot_all = fold or "i" in flags, dot_all or "s" in flags
                out.append(pattern[i : end + 1])
                i = end + 1
                continue
        if c == "\\":
            n = pattern[i + 1]
            if n == "b" and not in_class:
                out.append(f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))")
            elif n == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif n == "S" and not in_class:
                out.append(f"[^{_SPACE}]")
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "." and not in_class and not dot_all:
            out.append(r"[^\n]")
        elif fold and c in _FOLD:
            out.append(_FOLD[c] if in_class else f"[{_FOLD[c]}]")
        else:
            out.append(c)
        i += 1
    return "".join(out)
