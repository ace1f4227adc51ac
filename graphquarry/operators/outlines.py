"""Outlines of source texts by their structure: one writer for each language over a small scanner.

The scanner blanks comments and strings, then cuts a text into units: a declaration's head and, if it
has one, its body. Each writer turns units into lines and entries (name, kind, first line, last line).
No grammar library is at hand, so the scanner knows brackets, separators and keywords, not syntax trees.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

Entry = tuple[str, str, int, int]
_OPEN, _CLOSE = "([{", ")]}"


def blanked(text: str, line: tuple[str, ...] = ("//",), block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`", triple: bool = False, strings: bool = True) -> str:
    """The text with comments and, if asked for, the insides of strings as spaces; lines and lengths stay."""
    out, i, n = list(text), 0, len(text)

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        if any(text.startswith(c, i) for c in line):
            end = text.find("\n", i)
            end = n if end < 0 else end
            wipe(i, end)
            i = end
        elif block and text.startswith(block[0], i):
            end = text.find(block[1], i + len(block[0]))
            end = n if end < 0 else end + len(block[1])
            wipe(i, end)
            i = end
        elif triple and text.startswith('"""', i):
            end = text.find('"""', i + 3)
            end = n if end < 0 else end + 3
            wipe(i, end if strings else i)
            i = end
        elif text[i] in quotes:
            q, k = text[i], i + 1
            while k < n and text[k] != q and (q == "`" or text[k] != "\n"):
                k += 2 if text[k] == "\\" else 1
            wipe(i + 1, k if strings else 0)
            i = k + 1
        else:
            i += 1
    return "".join(out)


def matching(masked: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``, or the text's end."""
    depth = 0
    for k in range(at, len(masked)):
        if masked[k] in _OPEN:
            depth += 1
        elif masked[k] in _CLOSE:
            depth -= 1
            if not depth:
                return k
    return len(masked)


@dataclass
class Unit:
    head: str
    body: tuple[int, int] | None
    tail: str
    start: int
    end: int
    at: int = 0


class Source:
    def __init__(self, text: str, masked: str):
        self.text, self.masked = text, masked
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1 if at else 1

    def units(self, a: int = 0, b: int | None = None, newline: bool = False, comma: bool = False) -> list[Unit]:
        """The declarations between two places. newline: a line's end can end one; comma: a comma does."""
        m, out, b = self.masked, [], len(self.masked) if b is None else b
        i = a
        while i < b:
            while i < b and (m[i].isspace() or m[i] in ";," or m[i] in _CLOSE):
                i += 1
            if i >= b:
                break
            start, k, body = i, i, None
            while k < b:
                c = m[k]
                if c == "{":
                    close = min(matching(m, k), b)
                    body = (k + 1, close)
                    k = close + 1
                    break
                if c in "([":
                    k = min(matching(m, k), b) + 1
                    continue
                if c == ";" or comma and c == ",":
                    break
                if newline and c == "\n" and self._ends(start, k, b):
                    break
                k += 1
            head_end = body[0] - 1 if body else min(k, b)
            head, tail, end = m[start:head_end], "", min(k, b) - 1
            if body and not newline and re.search(r"=\s*(?:[\w()<>*&\s]*\s)?$|^typedef\b|^(?:pub\s+)?const\b|=>\s*$", head):
                stop = k
                while stop < b and m[stop] not in ";\n":
                    stop += 1
                tail = self.text[k:stop].strip()
                end = stop if stop < b and m[stop] == ";" else end
                k = stop
            out.append(Unit(" ".join(self.text[start:head_end].split()), body, tail, self.line(start), self.line(max(start, end)), start))
            i = max(k, i + 1)
        return out

    def _ends(self, start: int, at: int, stop: int) -> bool:
        before = self.masked[max(start, at - 200) : at].rstrip()
        after = self.masked[at : min(stop, at + 200)].lstrip()
        if not before or before[-1] in "=,+-*/&|.<(" or before.endswith("=>") or re.fullmatch(r"(?:@[\w.:]+(?:\([^()]*\))?\s*)+", before):
            return False
        return not re.match(r"[{.?]|->|:\s|extends\b|with\b|where\b", after)


def split_top(text: str, by: str = ",") -> list[str]:
    """``text`` cut at a separator outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] not in ("-", "="):
            depth -= 1
        elif c == by and depth <= 0:
            out.append(text[last:i].strip())
            last = i + 1
    return [x for x in [*out, text[last:].strip()] if x]


def call(head: str) -> tuple[str, str, str] | None:
    """(before, parameters, after) around the first bracket pair that isn't inside angle brackets."""
    at = head.find("(")
    if at < 0:
        return None
    end = matching(head, at)
    return head[:at].strip(), " ".join(head[at + 1 : end].split()).rstrip(", "), head[end + 1 :].strip()


class Writer:
    """Lines and entries of one source; the subclasses' ``items`` write the units of a place at a depth."""

    label = ""
    newline = False
    loose = True  # a blank line after each top item

    def __init__(self, text: str):
        self.text = text
        self.src = Source(self.mask(text, False), self.mask(text))
        self.entries: list[Entry] = []

    def mask(self, text: str, strings: bool = True) -> str:
        return blanked(text, strings=strings)

    def imports(self) -> list[str]:
        return []

    def add(self, name: str, kind: str, u: Unit) -> None:
        self.entries.append((name, kind, u.start, u.end))

    def units(self, span: tuple[int, int] | None = None, **k) -> list[Unit]:
        return self.src.units(*(span or (0, None)), newline=self.newline, **k)

    def item(self, u: Unit) -> list[str] | None:
        raise NotImplementedError

    def items(self) -> list[list[str]]:
        return [x for u in self.units() if (x := self.item(u))]

    def write(self, name: str, label: str | None = None) -> tuple[str, list[Entry]]:
        blocks = self.items()
        used = self.imports()
        head = f"# {name} [{label or self.label}]" + (f"\nimports: {', '.join(used)}" if used else "")
        lines: list[str] = []
        for b in blocks:
            lines += b + [""] * (self.loose or len(b) > 1 or b[0].startswith("\0"))
        body = "\n".join(x.lstrip("\0") for x in lines)
        return (head + "\n\n" + body).rstrip(), sorted(self.entries, key=lambda e: (e[2], -e[3]))


def _found(text: str, *patterns: str) -> list[str]:
    hits = [(m.start(), m[1].strip()) for p in patterns for m in re.finditer(p, text, re.M)]
    return [x for _, x in sorted(hits)]


def _indent(lines: list[str], by: int = 2) -> list[str]:
    return [" " * by + x if x else x for x in lines]


class C(Writer):
    label = "C"

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*#\s*include\s*[<\"]([^>\"]+)")

    def mask(self, text: str, strings: bool = True) -> str:
        m = blanked(text, quotes="\"'", strings=strings)
        return re.sub(r"^[ \t]*#.*?(?<!\\)$", lambda x: " " * len(x[0]), m, flags=re.M)

    @staticmethod
    def param(p: str) -> str:
        p = re.sub(r"\b(?:const|volatile|register|struct|enum|restrict)\s+", "", p.split("=")[0].strip())
        m = re.match(r"^(.*?[\w>\])])\s*([*&]*)\s*(\w+)((?:\[[^\]]*\])*)$", p)
        return f"{m[2]}{m[3]}{m[4]}: {m[1].strip()}" if m and m[1].strip() else p

    def params(self, text: str) -> str:
        return ", ".join(self.param(p) for p in split_top(text) if p != "void")

    def function(self, u: Unit) -> list[str] | None:
        parts = call(u.head)
        if not u.body or not parts or "=" in parts[0]:
            return None
        m = re.match(r"^(.*?)([*&\s]*)((?:[\w]+(?:<[^>]*>)?::)*(?:~?\w+|operator\s*\S+))$", parts[0])
        if not m or m[3] in ("if", "for", "while", "switch"):
            return None
        ret = re.sub(r"\b(?:static|inline|extern|virtual|explicit|constexpr|const|friend)\b\s*", "", m[1]).strip()
        if not re.search(r"\(", m[3]):
            self.found = m[3]
        return [f"function {m[2].strip()}{m[3]}({self.params(parts[1])})" + (f" -> {ret}" if ret else "")]

    def item(self, u: Unit) -> list[str] | None:
        if m := re.match(r"typedef\s+(struct|enum|union)\b\s*(\w*)", u.head):
            name = re.sub(r"[^\w].*$", "", u.tail) or m[2]
            self.add(name, "typedef", u)
            return [f"typedef {m[1]} {name}"]
        if u.body and (m := re.match(r"(struct|enum|union)\s+(\w+)$", u.head)):
            self.add(m[2], m[1], u)
            return [f"{m[1]} {m[2]}"]
        if got := self.function(u):
            self.add(self.found, "function", u)
            return got
        return None


class Cpp(C):
    label = "C++"

    def item(self, u: Unit, inside: bool = False) -> list[str] | None:
        head = re.sub(r"^(?:(?:public|private|protected)\s*:\s*)+", "", u.head)
        template = ""
        if m := re.match(r"(template\s*<.*?>)\s+(?=\w)", head):
            template, head = m[1], head[m.end() :]
            skip = re.match(r"(?s).*?template\s*<.*?>\s+(?=\w)", self.text[u.at :])
            u = Unit(head, u.body, u.tail, self.src.line(u.at + skip.end()) if skip else u.start, u.end, u.at)
        u = Unit(head, u.body, u.tail, u.start, u.end, u.at)
        if u.body and (m := re.match(r"namespace\s+([\w:]+)$", head)):
            self.add(m[1], "namespace", u)
            out = [f"namespace {m[1]}"]
            for x in self.units(u.body):
                if lines := self.item(x):
                    out += [*_indent(lines), ""]
            return out[:-1] if out[-1] == "" else out
        if u.body and (m := re.match(r"(class|struct|enum(?:\s+class)?)\s+(\w+)", head)) and not call(head):
            kind = m[1].split()[0]
            if not inside:
                self.add(m[2], kind, u)
            out = [template] * bool(template) + [f"{kind} {m[2]}"]
            if kind != "enum":
                for x in self.units(u.body):
                    if lines := self.member(x):
                        out += [*_indent(lines), ""]
            return out
        if head.startswith("typedef"):
            return super().item(u)
        if got := self.function(u):
            if not inside:
                self.add(self.found, "function", u)
            return [template] * bool(template) + got
        return None

    def member(self, u: Unit) -> list[str] | None:
        head = re.sub(r"^(?:(?:public|private|protected)\s*:\s*)+", "", u.head)
        if not u.body and (m := re.match(r"^(.*\))[^()]*=\s*(?:default|delete)$", head)):
            u = Unit(m[1], (0, 0), "", u.start, u.end)
            return self.function(u)
        head = re.sub(r"(\))\s*(?:const|noexcept|override|final|\s)*:\s*[^:].*$", r"\1", head)
        return self.item(Unit(head, u.body, u.tail, u.start, u.end), True)


class Go(Writer):
    label, newline = "Go", True

    def imports(self) -> list[str]:
        out = _found(self.text, r"^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"")
        for m in re.finditer(r"^import\s*\(([^)]*)\)", self.text, re.M):
            out += re.findall(r"\"([^\"]+)\"", m[1])
        return out

    def item(self, u: Unit) -> list[str] | None:
        if m := re.match(r"type\s+(\w+)(?:\[.*?\])?\s+(struct|interface)\b", u.head):
            self.add(m[1], m[2], u)
            return [f"{m[2]} {m[1]}"]
        if m := re.match(r"type\s+(\w+)\s+=?\s*\S", u.head):
            self.add(m[1], "type", u)
            return [f"type {m[1]}"]
        if m := re.match(r"func\s+(\([^)]*\)\s*)?(\w+)(\[[^\]]*\])?\s*(?=\()", u.head):
            _, params, ret = call(u.head[m.end() :])
            self.add(m[2], "method" if m[1] else "function", u)
            return [f"function {m[1].strip() + ' ' if m[1] else ''}{m[2]}({params})" + (f" -> {ret}" if ret else "")]
        if m := re.match(r"(const|var)\s*(.*)$", u.head, re.S):
            at = next((i for i in range(len(self.src.breaks) + 1) if i == u.start - 1), 0)
            first = self.src.breaks[at - 1] + 1 if at else 0
            raw = self.src.masked[first : self.src.breaks[u.end - 1] if u.end <= len(self.src.breaks) else None]
            inner = raw[raw.find("(") + 1 : raw.rfind(")")] if m[2].startswith("(") else re.sub(r"^[ \t]*(?:const|var)", "", raw)
            names = [x for line in inner.split("\n") if (n := re.match(r"\s*([\w, ]+?)(?=\s+[\w*\[.\]]|\s*=|\s*$)", line)) for x in split_top(n[1])]
            return [f"{m[1]} ({', '.join(names)})"] if names else None
        return None


_JAVA_MODS = r"(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|transient|volatile|sealed|non-sealed|override|virtual|async|partial|readonly|internal|extern|unsafe|new)"


class Java(Writer):
    label = "Java"

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;")

    @staticmethod
    def notes(head: str) -> tuple[list[str], str]:
        """Annotations and the rest of a head."""
        notes = []
        while m := re.match(r"@(?!interface\b)[\w.]+", head):
            end = m.end()
            if head[end:].lstrip().startswith("("):
                end = matching(head, head.index("(", end)) + 1
            notes.append(head[:end].strip())
            head = head[end:].strip()
        return notes, head

    def param(self, p: str) -> str:
        p = re.sub(r"^(?:final\s+)", "", self.notes(p)[1])
        m = re.match(r"^(.*\S)\s+(\w+(?:\[\])*)$", p)
        return f"{m[2]}: {m[1]}" if m else p

    def item(self, u: Unit) -> list[str] | None:
        notes, head = self.notes(u.head)
        m = re.match(rf"(?:{_JAVA_MODS}\s+)*(class|interface|enum|record|@interface)\s+(\w+)", head)
        if not u.body or not m:
            return None
        kind = {"record": "class", "@interface": "interface"}.get(m[1], m[1])
        self.add(m[2], kind, u)
        out = [*notes, f"{kind} {m[2]}"]
        a, b = u.body
        if kind == "enum":  # constants come first, up to a semicolon
            stop = next((i for i in range(a, b) if self.src.masked[i] == ";"), b)
            a = stop
        for x in self.units((a, b)):
            out += _indent(self.member(x, m[2]))
        return out

    def member(self, u: Unit, owner: str) -> list[str]:
        if inner := self.item(u):
            return inner
        notes, head = self.notes(u.head)
        parts = call(re.sub(r"\s+throws\s+.*$", "", head))
        if not parts or "=" in parts[0]:
            return []
        m = re.match(rf"((?:{_JAVA_MODS}\s+)*)(?:<[^>]*(?:<[^>]*>[^>]*)*>\s*)?(?:(.*\S)\s+)?(\w+)$", parts[0])
        if not m or not (m[2] or m[3] == owner):
            return []
        self.add(m[3], "method", u)
        mark = "-" if "private" in m[1].split() else "+"
        return [*notes, f"{mark} {m[3]}({', '.join(self.param(p) for p in split_top(parts[1]))})" + (f" -> {m[2]}" if m[2] else "")]


class CSharp(Java):
    label = "C#"

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;")

    @staticmethod
    def notes(head: str) -> tuple[list[str], str]:
        notes = []
        while head.startswith("["):
            end = matching(head, 0) + 1
            notes.append(head[:end])
            head = head[end:].strip()
        return notes, head

    def items(self) -> list[list[str]]:
        def below(span):
            for u in self.units(span):
                if re.match(r"namespace\b", u.head):
                    if u.body:
                        yield from below(u.body)
                elif lines := self.item(u):
                    yield lines

        return list(below(None))

    def item(self, u: Unit) -> list[str] | None:
        notes, head = self.notes(u.head)
        m = re.match(rf"(?:{_JAVA_MODS}\s+)*(class|interface|enum|struct|record)\s+(\w+)", head)
        if not u.body or not m:
            return None
        kind = "class" if m[1] == "record" else m[1]
        self.add(m[2], kind, u)
        out = [*notes, f"{kind} {m[2]}"]
        for x in self.units(u.body) if kind != "enum" else []:
            out += _indent(self.member(x, m[2]))
        return out

    def member(self, u: Unit, owner: str) -> list[str]:
        if inner := self.item(u):
            return inner
        notes, head = self.notes(u.head)
        parts = call(head.split("=>")[0])
        if not parts or "=" in parts[0]:
            body = self.src.masked[slice(*u.body)] if u.body else ""
            p = re.match(rf"((?:{_JAVA_MODS}\s+)*)(.*\S)\s+(\w+)$", head.split("=>")[0].strip())
            if p and (re.search(r"\b(?:get|set|init)\b", body) or "=>" in head and "=" not in head.split("=>")[0]):
                return [*notes, f"{'-' if 'private' in p[1].split() else '+'} {p[3]}: {p[2]}"]
            return []
        m = re.match(rf"((?:{_JAVA_MODS}\s+)*)(?:(.*\S)\s+)?(~?\w+)(?:<[^>]*>)?$", parts[0])
        if not m or not (m[2] or m[3].lstrip("~") == owner):
            return []
        self.add(m[3], "method", u)
        return [*notes, f"{'-' if 'private' in m[1].split() else '+'} {m[3]}()" + (f" -> {m[2]}" if m[2] else "")]


class Script(Writer):
    label = "TypeScript"

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*import\b[^;'\"]*?from\s*[\"']([^\"']+)", r"^[ \t]*import\s+[\"']([^\"']+)")

    @staticmethod
    def returns(after: str) -> str:
        after = re.sub(r"=>\s*$", "", after).strip()
        return f" -> {after[1:].strip()}" if after.startswith(":") else ""

    def units(self, span: tuple[int, int] | None = None, **k) -> list[Unit]:
        return self.src.units(*(span or (0, None)), newline=True, **k)

    def item(self, u: Unit) -> list[str] | None:
        head = re.sub(r"^(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:export|default|declare|abstract|async)\s+)*", "", u.head)
        if m := re.match(r"(class|interface)\s+(\w+)", head):
            self.add(m[2], m[1], u)
            out = [f"{m[1]} {m[2]}"]
            for x in self.units(u.body, comma=m[1] == "interface") if u.body else []:
                out += _indent(self.member(x) if m[1] == "class" else self.signature(x))
            return out
        if m := re.match(r"type\s+(\w+)\s*(?:<.*?>)?\s*=", head):
            self.add(m[1], "type", u)
            whole = head[m.end() :].strip()
            if u.body:
                whole = f"{whole} {' '.join(self.text[u.body[0] - 1 : u.body[1] + 1].split())} {u.tail}".strip()
            return [f"type {m[1]} = {whole}"]
        if u.body and (m := re.match(r"(?:const\s+)?enum\s+(\w+)", head)):
            self.add(m[1], "enum", u)
            names = [re.match(r"\W*(\w*)", x)[1] for x in split_top(self.src.masked[slice(*u.body)])]
            return [f"enum {m[1]}", f"  members: {', '.join(names)}"]
        if m := re.match(r"function\s*\*?\s*(\w+)\s*(?:<.*?>)?\s*(?=\()", head):
            _, params, after = call(head[m.end() :])
            self.add(m[1], "function", u)
            return [f"function {m[1]}({params})" + self.returns(after)]
        if m := re.match(r"(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:<.*?>)?\s*(?=\()", head):
            _, params, after = call(head[m.end() :])
            if "=>" in after:
                self.add(m[1], "function", u)
                return [f"function {m[1]}({params})" + self.returns(after.split("=>")[0])]
        return None

    def member(self, u: Unit) -> list[str]:
        head = re.sub(r"^(?:@[\w.]+(?:\([^)]*\))?\s*)+", "", u.head)
        m = re.match(r"((?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set)\s+)*)(\*?\s*[#\w$]+)\s*(?:<.*?>)?\s*[?!]?", head)
        if not m or m[2] in ("if", "return"):
            return []
        mark = "-" if re.search(r"\b(?:private|protected)\b", m[1]) or m[2].startswith("#") else "+"
        rest = head[m.end() :].lstrip()
        if rest.startswith("("):
            _, params, after = call(rest)
            self.add(m[2], "method", u)
            return [f"{mark} {m[2]}({params})" + self.returns(after)]
        return [f"{mark} {m[2]}()"]

    def signature(self, u: Unit) -> list[str]:
        whole = u.head + (f" {' '.join(self.text[u.body[0] - 1 : u.body[1] + 1].split())}" if u.body else "")
        m = re.match(r"((?:readonly\s+)?)([\w$]+\??)\s*(?:<.*?>)?\s*", whole)
        if not m:
            return []
        rest = whole[m.end() :]
        if rest.startswith("("):
            _, params, after = call(rest)
            return [f"+ {m[2]}({params})" + self.returns(after)]
        return [f"+ {m[2]}: {rest.lstrip(':').strip()}"]


class Kotlin(Writer):
    label, newline = "Kotlin", True
    MODS = r"(?:public|private|protected|internal|override|open|abstract|final|suspend|inline|lateinit|const|operator|infix|tailrec|external|data|sealed|enum|annotation|inner|value|companion|actual|expect)"

    def mask(self, text: str, strings: bool = True) -> str:
        return blanked(text, quotes="\"'", triple=True, strings=strings)

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*import\s+([\w.*]+)")

    def item(self, u: Unit, inside: bool = False) -> list[str] | None:
        head = re.sub(r"^(?:@[\w.:]+(?:\([^)]*\))?\s*)+", "", u.head)
        m = re.match(rf"((?:{self.MODS}\s+)*)(class|interface|object|fun|val|var|typealias)\b\s*(.*)$", head)
        if not m:
            return None
        mods, kind, rest = m[1].split(), m[2], m[3]
        if kind in ("class", "interface", "object"):
            name = (re.match(r"\w*", rest)[0] or "Companion") if kind == "object" else re.match(r"\w*", rest)[0]
            self.add(name, "interface" if kind == "interface" else "class", u)
            shown = " ".join([x for x in mods if x in ("data", "sealed", "enum", "abstract", "annotation", "companion", "value")] + [kind])
            out = [shown if "companion" in mods and name == "Companion" else f"{shown} {name}"]
            for x in self.units(u.body) if u.body else []:
                out += _indent(self.item(x, True) or [])
            return out
        if kind == "fun":
            parts = call(re.sub(r"^<.*?>\s*", "", rest))
            if not parts:
                return None
            name = parts[0].split(".")[-1]
            self.add(name, "method" if inside else "function", u)
            ret = re.match(r":\s*([^={]+)", parts[2])
            shown = f"{name}({parts[1]})" + (f" -> {ret[1].strip()}" if ret else "")
            return [f"{'-' if 'private' in mods else '+'} {shown}" if inside else f"function {shown}"]
        name = re.match(r"(?:<.*?>\s*)?([\w.]+)", rest)
        if kind == "typealias" or not name:
            return [f"typealias {name[1]}"] if name else None
        return [f"+ {name[1]}" if inside else f"{kind} {name[1]}"]


class Rust(Writer):
    label = "Rust"

    def mask(self, text: str, strings: bool = True) -> str:
        return re.sub(r"'(?:\\.|[^'\\\n])'", lambda m: "'" + " " * (len(m[0]) - 2) + "'" if strings else m[0], blanked(text, quotes='"', strings=strings))

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*(?:pub\s+)?use\s+([^;{]+?)(?:::\{[^;]*)?\s*;")

    def notes(self, u: Unit) -> tuple[list[str], str]:
        notes, head = [], u.head
        while m := re.match(r"#!?\[", head):
            end = matching(head, m.end() - 1) + 1
            notes.append(head[:end])
            head = head[end:].strip()
        return notes, head

    def function(self, head: str) -> tuple[str, str, bool] | None:
        m = re.match(r"((?:pub(?:\([^)]*\))?\s+)?)(?:(?:const|async|unsafe|default|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)\s*(?:<.*?>)?\s*(?=\()", head)
        if not m:
            return None
        _, params, after = call(head[m.end() :])
        ret = re.sub(r"\s*\bwhere\b.*$", "", after).strip()
        return m[2], f"{m[2]}({params.rstrip(', ')})" + (f" -> {ret[2:].strip()}" if ret.startswith("->") else ""), bool(m[1])

    def item(self, u: Unit) -> list[str] | None:
        notes, head = self.notes(u)
        first = u.start + (self.skipped(u) if notes else 0)
        own = Unit(head, u.body, u.tail, first, u.end)
        if got := self.function(head):
            self.add(got[0], "function", own)
            return [*notes, f"function {got[1]}"]
        if m := re.match(r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(struct|enum|trait|mod|union)\s+(\w+)", head):
            if m[1] == "mod" and not u.body:
                return None
            self.add(m[2], m[1], own)
            out = [*notes, f"{m[1]} {m[2]}"]
            for x in self.units(u.body) if u.body and m[1] in ("trait", "mod") else []:
                if m[1] == "mod":
                    out += _indent(self.item(x) or [])
                elif got := self.function(self.notes(x)[1]):
                    out.append(f"  + {got[1]}")
            return out
        if u.body and (m := re.match(r"(?:unsafe\s+)?impl(?:<.*?>)?\s+(.+?)(?:\s+where\s.*)?$", head)):
            target = m[1].split(" for ")[-1]
            self.add(re.match(r"[\w:]+", target)[0] if re.match(r"[\w:]+", target) else target, "impl", own)
            out = [*notes, f"impl {m[1]}"]
            for x in self.units(u.body):
                if got := self.function(self.notes(x)[1]):
                    self.add(got[0], "function", Unit("", None, "", x.start + self.skipped(x), x.end))
                    out.append(f"  {'+' if got[2] else '-'} {got[1]}")
            return out
        if m := re.match(r"(?:pub\s+)?type\s+(\w+)", head):
            self.add(m[1], "type", own)
            return [f"type {m[1]}"]
        return None

    def skipped(self, u: Unit) -> int:
        """Lines that attributes take before a declaration's own first line."""
        lines, n = self.text.split("\n"), 0
        while u.start - 1 + n < u.end - 1 and re.match(r"\s*(?:#!?\[.*\]\s*$|//|$)", lines[u.start - 1 + n]):
            n += 1
        return n


class Php(Writer):
    label = "PHP"
    MODS = r"(?:public|private|protected|static|final|abstract|readonly|var)"

    def mask(self, text: str, strings: bool = True) -> str:
        return blanked(re.sub(r"<\?php|\?>|<\?=", lambda m: " " * len(m[0]), text).replace("#[", "\0["), line=("//", "#"), quotes="\"'", strings=strings).replace("\0[", "#[")

    def imports(self) -> list[str]:
        return _found(self.text, r"^use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+\w+)?\s*;")

    def item(self, u: Unit) -> list[str] | None:
        head = re.sub(r"^(?:#\[.*?\]\s*)+", "", u.head.removeprefix("<?php").strip())
        if m := re.match(r"namespace\s+([\w\\]+)$", head):
            self.add(m[1], "namespace", u)
            return [f"namespace {m[1]}"]
        if u.body and (m := re.match(r"(?:(?:final|abstract|readonly)\s+)*(class|interface|trait|enum)\s+(\w+)", head)):
            self.add(m[2], "class" if m[1] == "trait" else m[1], self.own(u))
            out = [f"{m[1]} {m[2]}"]
            for x in self.units(u.body):
                out += _indent(self.member(x))
            return out
        if got := self.function(head):
            self.add(got[0], "function", u)
            return [f"function {got[1]}"]
        return None

    def own(self, u: Unit) -> Unit:
        return u

    def param(self, p: str) -> str:
        p = re.sub(r"^(?:#\[.*?\]\s*)?", "", p.split("=")[0].strip())
        m = re.match(rf"(?:{self.MODS}\s+)*(?:(\S.*?)\s+)?([&.]*\$\w+)$", p)
        return (f"{m[2]}: {m[1]}" if m[1] else m[2]) if m else p

    def function(self, head: str) -> tuple[str, str] | None:
        m = re.match(rf"(?:{self.MODS}\s+)*function\s+&?\s*(\w+)\s*(?=\()", head)
        if not m:
            return None
        _, params, after = call(head[m.end() :])
        ret = re.match(r":\s*(.+)$", after)
        return m[1], f"{m[1]}({', '.join(self.param(p) for p in split_top(params))})" + (f" -> {ret[1].strip()}" if ret else "")

    def member(self, u: Unit) -> list[str]:
        head = re.sub(r"^(?:#\[.*?\]\s*)+", "", u.head)
        mark = "-" if re.match(rf"(?:{self.MODS}\s+)*(?:private|protected)\b", head) else "+"
        if got := self.function(head):
            self.add(got[0], "method", u)
            return [f"{mark} {got[1]}"]
        if m := re.match(r"case\s+(\w+)", head):
            return [f"case {m[1]}"]
        if m := re.match(rf"(?:{self.MODS}\s+)+(?:[^$=(]*\s)?(\$\w+)", head):
            return [f"{mark} {m[1]}"]
        return []


class Scala(Writer):
    label, newline, loose = "Scala", True, False
    MODS = r"(?:private(?:\[\w+\])?|protected(?:\[\w+\])?|override|implicit|lazy|final|abstract|sealed|case|inline|given)"

    def mask(self, text: str, strings: bool = True) -> str:
        return blanked(text, quotes='"', triple=True, strings=strings)

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*import\s+([\w.{}, _=>]+)")

    def item(self, u: Unit, inside: str = "") -> list[str] | None:
        head = re.sub(r"^(?:@[\w.]+(?:\([^)]*\))?\s*)+", "", u.head)
        m = re.match(rf"((?:{self.MODS}\s+)*)(class|object|trait|def|val|var|type)\s+(\w+|`[^`]+`|[^\s\w(\[]+)\s*(.*)$", head)
        if not m:
            return None
        mods, kind, name, rest = m[1].split(), m[2], m[3], m[4]
        if kind in ("class", "object", "trait"):
            self.add(name, kind, u)
            out = [f"{'case ' if 'case' in mods else ''}{kind} {name}"]
            for x in self.units(u.body) if u.body else []:
                out += _indent(self.item(x, kind) or [])
            out[0] = "\0" + out[0]
            return out
        if kind == "def":
            rest = re.sub(r"^\[[^\]]*\]\s*", "", rest)
            parts = call(rest) if rest.startswith("(") else ("", None, rest)
            ret = re.match(r":\s*(.+?)\s*(?:=.*)?$", parts[2])
            self.add(name, "function", u)
            if inside == "trait" and not u.body and "=" not in parts[2]:
                return None
            return [f"function {name}" + (f"({parts[1]})" if parts[1] is not None else "") + (f" -> {ret[1]}" if ret else "")]
        if kind == "type":
            self.add(name, "type", u)
            return [f"type {name}{(' ' + rest) if rest else ''}"]
        self.add(name, "property", u)
        of = re.match(r":\s*(.+?)\s*(?:=.*)?$", rest)
        return [f"{kind} {name}" + (f": {of[1]}" if of else "")]


class Swift(Writer):
    label, newline, loose = "Swift", True, False
    MODS = r"(?:public|private|fileprivate|internal|open|static|class|final|override|mutating|nonmutating|lazy|weak|unowned|required|convenience|indirect|async|nonisolated|dynamic)"

    def mask(self, text: str, strings: bool = True) -> str:
        return blanked(text, quotes='"', triple=True, strings=strings)

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*import\s+(\w+)")

    def item(self, u: Unit, inside: bool = False) -> list[str] | None:
        head = u.head
        while m := re.match(r"@\w+", head):
            rest = head[m.end() :].lstrip()
            head = rest[matching(rest, 0) + 1 :].strip() if rest.startswith("(") and "(" in head[: m.end() + 1] else rest
        m = re.match(rf"((?:{self.MODS}(?:\(set\))?\s+)*)(protocol|struct|class|enum|extension|actor|func|var|let|init|typealias)\b[?!]?\s*(.*)$", head)
        if not m:
            return None
        mods, kind, rest = m[1].split(), m[2], m[3]
        mark = "-" if {"private", "fileprivate"} & set(mods) else "+"
        name = (re.match(r"`?([\w.]+|[^\s\w(]+)`?", rest) or ["", ""])[1]
        if kind in ("protocol", "struct", "class", "enum", "extension", "actor"):
            self.add(name, {"extension": "class", "actor": "class"}.get(kind, kind), u)
            out = [f"\0{kind} {name}"]
            for x in self.units(u.body) if u.body and kind != "protocol" else []:
                if not re.match(r"(?:indirect\s+)?case\b", x.head):
                    out += _indent(self.item(x, True) or [])
            return out
        if kind == "func":
            parts = call(re.sub(r"^(\w+)\s*<.*?>", r"\1", rest))
            if not parts:
                return None
            ret = re.search(r"->\s*(.+?)(?:\s+where\s.*)?$", parts[2])
            self.add(name, "method" if inside else "function", u)
            return [f"{mark} {name}()" + (f" -> {ret[1].strip()}" if ret else "")]
        if kind == "init":
            return ["+ init()"] if inside else None
        if kind == "typealias":
            self.add(name, "type", u)
            return [f"typealias {name} = {name}"]
        of = re.match(r"\w+\s*:\s*([^={]+)", rest)
        return [f"+ {name}" + (f": {of[1].strip()}" if of else "")] if inside else [f"{kind} {name}"]


class Zig(Writer):
    label = "Zig"

    def mask(self, text: str, strings: bool = True) -> str:
        return blanked(text, block=None, quotes='"', strings=strings)

    def imports(self) -> list[str]:
        return _found(self.text, r"@import\(\"([^\"]+)\"\)")

    def function(self, head: str) -> tuple[str, str, bool] | None:
        m = re.match(r"((?:pub\s+)?)(?:(?:export|inline|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)\s*(?=\()", head)
        if not m:
            return None
        _, params, ret = call(head[m.end() :])
        return m[2], f"{m[2]}({params.rstrip(', ')})" + (f" -> {ret}" if ret else ""), bool(m[1])

    def item(self, u: Unit) -> list[str] | None:
        if u.body and (got := self.function(u.head)):
            self.add(got[0], "function", u)
            return [f"{'pub ' if got[2] else ''}function {got[1]}"]
        if u.body and (m := re.match(r"test\s+\"(.*)\"$", u.head)):
            self.add(m[1], "function", u)
            return [f'test "{m[1]}"']
        m = re.match(r"((?:pub\s+)?)const\s+(\w+)\s*=\s*(?:(?:packed|extern)\s+)?(struct|enum|union|error)\b", u.head)
        if not m or not u.body:
            return None
        kind = m[3]
        self.add(m[2], "enum" if kind == "error" else kind, u)
        out, plain, methods = [f"{m[1]}{kind} {m[2]}"], [], []
        for x in self.units(u.body, comma=True):
            if got := self.function(x.head):
                self.add(got[0], "method", x)
                methods.append(f"  {'+' if got[2] else '-'} {got[1]}")
            elif re.match(r"\w+\s*(?::|=|$)", x.head):
                plain.append(x.head.split("=")[0].strip())
        if kind == "struct":
            out += [f"  {p}" for p in plain if ":" in p]
        elif plain:
            out.append(f"  {'values' if kind == 'error' else 'variants'}: {', '.join(plain)}")
        return out + methods


class Lua(Writer):
    label, loose = "Lua", False

    def mask(self, text: str, strings: bool = True) -> str:
        return blanked(text, line=("--",), block=("--[[", "]]"), quotes="\"'", strings=strings)

    def imports(self) -> list[str]:
        return _found(self.text, r"\brequire\s*\(?\s*[\"']([^\"']+)")

    def items(self) -> list[list[str]]:
        masked, out, depth = self.src.masked, [], 0
        opening = re.compile(r"\b(function|if|do|repeat)\b|\b(end|until)\b")
        held: list[tuple[int, str | None, int]] = []
        for m in opening.finditer(masked):
            if m[2]:
                if held:
                    at, name, _ = held.pop()
                    if name is not None:
                        self.entries.append((name, "function", self.src.line(at), self.src.line(m.start())))
                depth -= 1
                continue
            name, at = None, m.start()
            if m[1] == "function" and not held:
                own = re.match(r"function\s+([\w.:]+)\s*\(([^)]*)\)", masked[at:])
                first = masked.rfind("\n", 0, at) + 1
                lead = masked[first:at]
                given = re.match(r"\s*(local\s+)?([\w.]+)\s*=\s*$", lead)
                anonymous = re.match(r"function\s*\(([^)]*)\)", masked[at:])
                if own or given and anonymous:
                    name, params = (own[1], own[2]) if own else (given[2], anonymous[1])
                    local = " [local]" if "local" in lead.split() else ""
                    out.append([f"+ {name}({', '.join(p.strip() for p in params.split(',') if p.strip())}){local}"])
                    at = first + len(lead) - len(lead.lstrip())
            held.append((at, name, depth))
            depth += 1
        return out


class Ruby(Writer):
    label = "Ruby"

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*require(?:_relative)?\s*\(?\s*[\"']([^\"']+)")

    def items(self) -> list[list[str]]:
        lines = blanked(self.text, line=("#",), block=("\n=begin", "\n=end"), quotes="\"'").split("\n")
        whole = self.text.split("\n")
        top: list[list[str]] = []
        stack: list[tuple[int, str, Entry | None, list[str] | None]] = []

        def place() -> tuple[list[str] | None, int]:
            open_ = [x for x in stack if x[3] is not None]
            return (open_[-1][3], 2 * len(open_)) if open_ else (None, 0)

        def put(line: str) -> list[str] | None:
            block, pad = place()
            if any(k == "def" for _, k, _, _ in stack):
                return None
            if block is None:
                top.append([line])
                return top[-1]
            block.append(" " * pad + line)
            return block

        for i, line in enumerate(lines):
            raw, s = whole[i], line.strip()
            one = bool(re.search(r"[;\s]end\s*$", s)) and not re.match(r"end\b", s)
            if m := re.match(r"(module|class)\s+([\w:]+)\s*(<\s*[\w:]+)?", s):
                shown = f"{m[1]} {m[2]}" + (f" < {m[3]}" if m[3] else "")
                block = put(shown)
                if not one:
                    stack.append((i, m[1], (m[2], "class", i + 1, 0), block))
            elif m := re.match(r"def\s+((?:self\.)?[\w]+[?!=]?|[^\s\w(]+)\s*(?:\(([^)]*)\)|([^;=\n]*))?", s):
                params = re.match(r"\s*def\s+\S+?\s*\((.*)\)", raw)
                given = params[1] if params else (m[3] or "").strip()
                put(f"+ {m[1]}({given})")
                entry = (m[1].removeprefix("self."), "method", i + 1, 0)
                if one or re.match(r"def\s+[^\s(]+\s*(?:\([^)]*\))?\s*=\s", s):
                    self.entries.append((*entry[:3], i + 1))
                else:
                    stack.append((i, "def", entry, None))
            elif m := re.match(r"(attr_(?:reader|writer|accessor))\s+(.+)$", raw.strip()):
                names = re.findall(r":(\w+)", m[2])
                put(f"{m[1]} {', '.join(names)}")
                self.entries += [(n, "property", i + 1, i + 1) for n in names]
            elif re.match(r"end\b", s):
                if stack:
                    _, kind, entry, block = stack.pop()
                    if entry:
                        self.entries.append((*entry[:3], i + 1))
                    if kind in ("module", "class") and block is not None and any(x[3] is not None for x in stack):
                        block.append("")
            elif (re.match(r"(?:if|unless|while|until|case|begin|for)\b", s) or re.search(r"\bdo\s*(?:\|[^|]*\|)?$|=\s*(?:if|case|begin|unless)\b", s)) and not one:
                stack.append((i, "block", None, None))
        return top


class Elixir(Writer):
    label = "Elixir"

    def imports(self) -> list[str]:
        return _found(self.text, r"^[ \t]*((?:use|import|alias|require)[ \t]+[\w.]*\w)(?=\s*(?:,|$))")

    def items(self) -> list[list[str]]:
        masked = blanked(self.text, line=("#",), block=None, quotes='"', triple=True).split("\n")
        raw = self.text.split("\n")
        out: list[list[str]] = []
        stack: list[tuple[str, Entry | None]] = []
        for i, line in enumerate(masked):
            s = line.strip()
            opens = bool(re.search(r"\bdo\s*$|\bfn\b.*->\s*$", s))
            inner = not all(k in ("defmodule", "defprotocol", "defimpl") for k, _ in stack)
            entry, kind = None, "block"
            if not inner and (m := re.match(r"(defmodule|defprotocol|defimpl)\s+([\w.]+)(.*?)\s*\bdo\b", s)):
                kind = m[1]
                entry = (m[2], {"defmodule": "class", "defprotocol": "interface"}.get(kind, "impl"), i + 1, 0)
                out.append([f"{kind} {m[2]}{m[3].rstrip(', ') if kind != 'defimpl' else m[3].rstrip()}"])
            elif not inner and (m := re.match(r"defstruct\s+(.*)$", raw[i].strip())):
                names = re.findall(r":(\w+)|(\w+):", m[1])
                if out:
                    out[-1].append(f"  defstruct [{', '.join(a or b for a, b in names)}]")
            elif not inner and (m := re.match(r"(defp?|defmacrop?|defguardp?|defdelegate)\s+([\w]+[?!]?)", s)):
                rest = raw[i].strip()[m.end() :]
                params = rest[1 : matching(masked[i].strip()[m.end() :], 0)] if rest.startswith("(") else ""
                kind = "def"
                shown = f"{m[1]} {m[2]}({params})".replace("\\\\", "\\\\")
                if out:
                    out[-1].append("  " + shown)
                else:
                    out.append([shown])
                entry = (m[2], "function", i + 1, 0)
                if not opens:
                    self.entries.append((*entry[:3], i + 1))
            if opens:
                stack.append((kind, entry))
            elif re.match(r"end\b", s) and stack:
                _, done = stack.pop()
                if done:
                    self.entries.append((*done[:3], i + 1))
        return out


# The writer and the label of each extension.
WRITERS: dict[str, tuple[Callable[[str], Writer], str]] = {
    ".ts": (Script, "TypeScript"), ".tsx": (Script, "TSX"), ".js": (Script, "JavaScript"), ".jsx": (Script, "JSX"), ".go": (Go, "Go"), ".rs": (Rust, "Rust"), ".java": (Java, "Java"),
    ".kt": (Kotlin, "Kotlin"), ".kts": (Kotlin, "Kotlin"), ".c": (C, "C"), ".h": (C, "C"), ".cpp": (Cpp, "C++"), ".cc": (Cpp, "C++"), ".hpp": (Cpp, "C++"), ".cs": (CSharp, "C#"), ".swift": (Swift, "Swift"),
    ".rb": (Ruby, "Ruby"), ".php": (Php, "PHP"), ".lua": (Lua, "Lua"), ".scala": (Scala, "Scala"), ".zig": (Zig, "Zig"), ".ex": (Elixir, "Elixir"), ".exs": (Elixir, "Elixir"),
}


def outlined(name: str, text: str, ext: str) -> tuple[str, list[Entry]] | None:
    """(text, entries) of a source in a language that has a writer, else None."""
    if ext not in WRITERS:
        return None
    make, label = WRITERS[ext]
    return make(text).write(name, label)
