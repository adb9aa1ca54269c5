"""Patterns in RE2's dialect as Java patterns of the same meaning, and literals that a match must contain."""

import re

_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def to_java(pattern: str) -> str:
    """RE2's ASCII word edges and white space, its end of text and its dot, for java.util.regex."""
    out, i, in_class = ["(?d)"], 0, False
    if re.match(r"\\b(?:\(\?:)?(?:[A-Za-z0-9]|\\d|\[[A-Za-z0-9-]+\])", pattern) and _all_start_with_words(pattern[2:]):
        out.append("(?<![0-9A-Za-z_])")  # a word character follows, so the edge is one before it
        i = 2
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            out.append({r"\b": _EDGE, r"\s": r"\t\n\f\r " if in_class else r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]"}.get(two, two) if not (in_class and two in (r"\b", r"\S")) else r"&&[^\t\n\f\r ]" if two == r"\S" else two)
            i += 2
            continue
        if in_class:
            if c == "[" and two != "[:":
                out.append(r"\[")
                i += 1
                continue
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                step = 2 if two == "[]" else 3
                out.append(pattern[i : i + step - 1] + r"\]")
                i += step
                continue
        elif c == "$":
            out.append(r"\z")
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def _all_start_with_words(rest: str) -> bool:
    if not rest.startswith("(?:"):
        return True
    group = re.match(r"\(\?:([^()]*)\)", rest)
    return bool(group) and all(re.match(r"[A-Za-z0-9]", x) for x in group[1].split("|"))


def required_literal(pattern: str) -> tuple[str, bool] | None:
    """The longest literal that every match contains, if one is plain to see, and whether its case is free."""
    free = "(?i" in pattern
    bare = re.sub(r"\(\?i\)", "", pattern)
    bare = re.sub(r"\[[^\]]*\]|\\[a-zA-Z]", "\0", bare)
    while (once := re.sub(r"\([^()]*\)(?:[*?+]|\{[^}]*\})?", "\0", bare)) != bare:
        bare = once
    if "|" in bare:
        return None
    bare = re.sub(r"(\\.|.)(?:[*?]|\{0)", "\0", bare)
    bare = re.sub(r"\{[^}]*\}", "\0", bare)
    found = [re.sub(r"\\(.)", r"\1", x) for x in re.split(r"[\0.*+?^$(){}\[\]|]", re.sub(r"\\\.", "\1", bare))]
    best = max((x.replace("\1", ".") for x in found), key=len, default="")
    if not best or len(best) == 1 and (best.isalnum() or best in " -_."):
        return None
    return (best.lower() if free else best), free


def required_any(pattern: str) -> list[str] | None:
    """Literals of two characters and more of which every match contains one: the alternatives of a group that no match is
    without. Of several such groups the one whose shortest literal is the longest. Only where case counts."""
    if "(?i" in pattern or "|" in re.sub(r"\([^()]*\)|\[[^\]]*\]", "", re.sub(r"\([^()]*\)", "()", pattern)):
        return None
    best: list[str] | None = None
    for m in re.finditer(r"\((?:\?:)?([^()]*)\)(?![*?]|\{0)", pattern):
        found = [required_literal(x) for x in m[1].split("|")]
        if all(f is not None and len(f[0]) > 1 for f in found):
            literals = [f[0] for f in found]
            if best is None or min(map(len, literals)) > min(map(len, best)):
                best = literals
    return best


def required_some(pattern: str, most: int = 32) -> tuple[list[str], bool] | None:
    """Literals of which every match contains one, and whether their case is free: the longest literal of each form that the
    pattern takes when its short lists of characters and its groups of plain words are written out, `most` forms at most."""
    forms = [pattern]
    choice = re.compile(r"(?<!\\)(?:\[([A-Za-z0-9]{2,8})\]|\((?:\?:)?([A-Za-z0-9_]+(?:\|[A-Za-z0-9_]+)+)\))(?![*?+{])")
    while "(?i" not in pattern and (found := choice.search(forms[0])) and len(forms) * len(options := found[1] or found[2].split("|")) <= most:
        forms = [f[: m.start()] + x + f[m.end() :] for f in forms for m in [choice.search(f)] for x in options]
    literals = [required_literal(f) for f in forms]
    if any(f is None for f in literals):
        return None
    return sorted({f[0] for f in literals}), literals[0][1]

