"""JavaScript and TypeScript: tokens, brackets, and what they declare.

A text becomes tokens (words, strings, templates, regular expressions, marks) in which comments are gone and each token knows the
bracket that it lies in. Statements and members are runs of tokens directly in one bracket; names are read off their first tokens. So braces in
strings, comments, templates and regular expressions open nothing, whatever is nested in what. Types of angle brackets are
told from comparisons by what they hold; text between tags is read as tokens too, and an apostrophe there ends with its line."""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_WORD = re.compile(r"#?[\w$]+")
_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_MARK = re.compile(r"=>|\.\.\.|\?\.|&&|\|\||\?\?|.", re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: words after which an expression begins, so that a slash opens a regular expression
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
#: words that go on with what stands before them on another line, and those that want more after them
_GOES_ON = frozenset("else catch finally extends implements from as of in instanceof satisfies".split())
_WANTS_MORE = frozenset("extends implements return new typeof in of instanceof const let var function class export default async import from as await throw void delete interface enum declare abstract".split()) - {"return"}
_VALUE_BEFORE_BRACE = frozenset("= ( , : [ ? && || ?? ... ! | & return default in of yield await import export type".split())
_MODIFIERS = frozenset("export default declare abstract async".split())
_MEMBER_MODIFIERS = frozenset("public private protected static readonly async override abstract declare accessor get set".split())


class Script:
    """Tokens of a text as lists: kind (w word, s string, t template, r regular expression, p mark), text, place, line, whether a
    line ends before it, the bracket it lies in (-1: none), and by bracket its end and what it holds."""

    def __init__(self, source: str):
        self.source = source
        self.kind: list[str] = []
        self.text: list[str] = []
        self.at: list[int] = []
        self.new: list[bool] = []
        self.up: list[int] = []
        self.close: dict[int, int] = {}
        self.holds: dict[int, str] = {}
        self._lex()
        self.line = self._lines()

    # ---- tokens --------------------------------------------------------------------------------------------------

    def _lines(self) -> list[int]:
        out, line, last = [], 1, 0
        for a in self.at:
            line += self.source.count("\n", last, a)
            last = a
            out.append(line)
        return out

    def _add(self, kind: str, text: str, at: int, new: bool, up: int) -> int:
        self.kind.append(kind)
        self.text.append(text)
        self.at.append(at)
        self.new.append(new)
        self.up.append(up)
        return len(self.at) - 1

    def _value_may_follow(self) -> bool:
        if not self.at:
            return True
        last = self.text[-1]
        return last in _BEFORE_VALUE if self.kind[-1] == "w" else self.kind[-1] == "p" and last not in (")", "]", "}", "<")

    def _lex(self) -> None:
        s, at, n = self.source, 0, len(self.source)
        if s.startswith("#!"):
            at = s.find("\n") if "\n" in s else n
        stack: list[int] = []  # brackets that are open; -2 for the hole of a template
        new = True
        while at < n:
            c = s[at]
            # patterns are tried where their first character stands
            if (c == "/" or c.isspace()) and (m := _SPACE.match(s, at)):
                new |= "\n" in m[0]
                at = m.end()
                continue
            up = stack[-1] if stack and stack[-1] >= 0 else next((x for x in reversed(stack) if x >= 0), -1)
            if c == "`" or c == "}" and stack and stack[-1] == -2:
                if c == "`":
                    self._add("t", "`", at, new, up)
                else:
                    stack.pop()
                at = _TEMPLATE.match(s, at + 1).end()
                if s.startswith("${", at):
                    stack.append(-2)
                    at += 2
                else:
                    at += 1
            elif c in "\"'" and (m := _STRING.match(s, at)):
                self._add("s", m[0], at, new, up)
                at = m.end()
            elif c == "/" and self._value_may_follow() and (m := _REGEX.match(s, at)):
                self._add("r", m[0], at, new, up)
                at = m.end()
            elif (c in "#$_" or c.isalnum()) and (m := _WORD.match(s, at)):
                self._add("w", m[0], at, new, up)
                at = m.end()
            else:
                mark = _MARK.match(s, at)[0]
                if mark in _PAIRS:
                    # a bracket that closes nothing is left out; one that closes an outer one closes those inside
                    if any(x >= 0 and self.text[x] == _PAIRS[mark] for x in stack):
                        while not ((x := stack.pop()) >= 0 and self.text[x] == _PAIRS[mark]):
                            pass
                        self.close[x] = self._add("p", mark, at, new, self.up[x])
                else:
                    i = self._add("p", mark, at, new, up)
                    if mark in "([{":
                        self.holds[i] = self._held(i) if mark == "{" else mark
                        stack.append(i)
                at += len(mark)
            new = False

    def _held(self, i: int) -> str:
        """What an opening brace holds: class members, an object (or a type), or statements."""
        for j in range(i - 1, max(-1, i - 60), -1):
            if self.up[j] != self.up[i]:
                continue
            if self.text[j] in (";", "}", "=>") or self.kind[j] == "p" and self.text[j] in ("=", ",") and self.up[j] == -1 and j < i - 1:
                break
            if self.kind[j] == "w" and self.text[j] in ("class", "interface") and not (j and self.text[j - 1] == "."):
                return "class"
        before = self.text[i - 1] if i else ";"
        return "object" if before in _VALUE_BEFORE_BRACE else "block"

    # ---- statements ----------------------------------------------------------------------------------------------

    def _directly_in(self, bracket: int) -> Iterator[int]:
        """Tokens that lie directly in a bracket, in order."""
        i = bracket + 1
        end = self.close.get(bracket, len(self.at)) if bracket >= 0 else len(self.at)
        while i < end:
            yield i
            if i in self.holds:
                j = self.close.get(i)
                if j is None or j >= end:
                    return
                yield j
                i = j
            i += 1

    def statements(self, bracket: int = -1, members: bool = False) -> list[tuple[int, int]]:
        """(first, last token) of each statement directly in a bracket; of a class, of each member."""
        out: list[list[int]] = []
        before = None
        opener = {j: i for i, j in self.close.items()}
        for i in self._directly_in(bracket):
            if before is None:
                begins = True
            else:
                last, word = self.text[before], self.kind[before] == "w"
                mark = self.kind[before] == "p"
                ended = mark and (last == ";" or members and last == ",")
                closed = mark and last == "}" and self.holds.get(opener.get(before, -1)) in ("block", "class")
                starts_word = self.kind[i] != "p" and self.text[i] not in _GOES_ON
                whole = mark and last in (")", "]", "}") or not mark and not (word and last in _WANTS_MORE)
                if members and word and last in _MEMBER_MODIFIERS:
                    whole = out[-1][0] != before or not starts_word
                opens = starts_word or self.text[i] in ("@", "[", "*") and members or self.text[i] == "@"
                begins = self.text[i] != ";" and (ended or (closed and starts_word) or (self.new[i] and whole and opens))
                if begins and last == "}" and self.text[i] == "while" and self._does(out[-1][0]):
                    begins = False
                if begins and not members and self._decorated_only(out[-1]):
                    begins = False
                if begins and members and self._decorated_only(out[-1]):
                    begins = False
            if begins:
                out.append([i, i])
            out[-1][1] = i
            before = i
        return [(a, b) for a, b in out if self.text[a] != ";"]

    def _does(self, i: int) -> bool:
        return self.text[i] == "do"

    def _decorated_only(self, span: list[int]) -> bool:
        return self.text[span[0]] == "@" and self._after_decorators(span[0], span[1]) > span[1]

    def _after_decorators(self, i: int, last: int) -> int:
        while i <= last and self.text[i] == "@":
            i += 2
            while i + 1 <= last and self.text[i] == ".":
                i += 2
            if i <= last and self.text[i] == "(":
                i = self.close.get(i, last) + 1
        return i

    def _name(self, i: int, last: int) -> str | None:
        return self.text[i] if i <= last and self.kind[i] == "w" and not self.text[i][0].isdigit() and self.text[i][0] != "#" else None

    def told(self, span: tuple[int, int]) -> tuple[str, list[str | None], set[str], int]:
        """(kind, names, modifiers, token of the keyword) of a statement; kind '' declares nothing. Variables have let, var or const as kind."""
        i, last = self._after_decorators(*span), span[1]
        said: set[str] = set()
        while i <= last and self.text[i] in _MODIFIERS and self.kind[i] == "w" and not (i < last and self.text[i + 1] in ("=", "(", ".", ":", "=>")):
            if self.text[i] == "async" and not (i < last and self.text[i + 1] == "function"):
                break
            said.add(self.text[i])
            i += 1
        if i > last or self.kind[i] != "w":
            return "", [], said, min(i, last)
        word, after = self.text[i], self.text[i + 1] if i < last else ""
        if word == "function":
            return "function", [self._name(i + 1 + (after == "*"), last)], said, i
        if word == "class":
            return "class", [None if after in ("extends", "implements") else self._name(i + 1, last)], said, i
        if word == "const" and after == "enum":
            return "enum", [self._name(i + 2, last)], said, i
        if word in ("interface", "enum") and self._name(i + 1, last) and i + 2 <= last and self.text[i + 2] in ("{", "<", "extends"):
            return word, [self._name(i + 1, last)], said, i
        if word == "type" and self._name(i + 1, last) and i + 2 <= last and self.text[i + 2] in ("=", "<"):
            return "type", [self._name(i + 1, last)], said, i
        if word in ("const", "let", "var") and (self._name(i + 1, last) or after in ("{", "[")):
            return word, self._variables(i + 1, last), said, i
        return word if word in ("import", "export") else "", [], said, i

    def _variables(self, i: int, last: int) -> list[str | None]:
        """Names of a list of variables, in order; the text of a pattern, with None before it, for one that takes a value apart."""
        up, out = self.up[i], []
        while i <= last:
            if self.text[i] in ("{", "["):
                out.append(None)
                i = self.close.get(i, last) + 1
            else:
                out.append(self._name(i, last))
                i += 1
            typed = i <= last and self.text[i] in (":", "!")
            while i <= last:
                if self.up[i] == up and self.text[i] == ",":
                    break
                if self.up[i] == up and self.text[i] == "=":
                    typed = False
                if self.text[i] == "<" and (typed or self._types(i, last)):
                    i = self._angle(i, last)
                elif i in self.holds:
                    i = self.close.get(i, last)
                i += 1
            i += 1
        return out

    def _angle(self, i: int, last: int) -> int:
        """The token that closes the angle bracket at i."""
        depth = 0
        for j in range(i, last + 1):
            depth += (self.text[j] == "<") - (self.text[j] == ">")
            if depth == 0:
                return j
        return last

    def _types(self, i: int, last: int) -> bool:
        """Whether an angle bracket in an expression opens types: it stands on a word, and a call follows it."""
        j = self._angle(i, last)
        if j >= last or self.kind[i - 1] != "w" or self.at[i] != self.at[i - 1] + len(self.text[i - 1]):
            return False
        return self.text[j + 1] in ("(", "`") and all(self.kind[x] in "ws" or self.text[x] in ("<", ">", ",", ".", "[", "]", "|", "&", "{", "}", ":", ";", "?") for x in range(i, j))

    def body(self, span: tuple[int, int]) -> int | None:
        """The brace of a class or an interface."""
        return next((i for i in range(span[0], span[1] + 1) if self.holds.get(i) == "class" and self.up[i] == self.up[span[0]]), None)

    def member(self, span: tuple[int, int]) -> tuple[str, str] | None:
        """(name, method or property) of a member; None of constructors, accessors, names that are worked out, and the rest."""
        i, last = self._after_decorators(*span), span[1]
        said = set()
        while i < last and self.kind[i] == "w" and self.text[i] in _MEMBER_MODIFIERS and (self.kind[i + 1] in "ws" or self.text[i + 1] in ("*", "[")) and not (self.new[i + 1] and self.text[i] in ("get", "set")):
            said.add(self.text[i])
            i += 1
        i += i <= last and self.text[i] == "*"
        name = self._name(i, last)
        if name is None or said & {"get", "set"}:
            return None
        i += 1
        i += i <= last and self.text[i] in ("?", "!")
        after = self.text[i] if i <= last else ";"
        if after == "<":
            i = self._angle(i, last) + 1
            after = self.text[i] if i <= last else ";"
        if after == "(":
            return None if name == "constructor" else (name, "method")
        return (name, "property") if after in (":", "=", ";", ",", "}") or i > last else None

    # ---- what a file says --------------------------------------------------------------------------------------------

    def signature(self, i: int) -> str:
        """The text from a token to the next brace, or to the end of its line."""
        brace = self.source.find("{", self.at[i])
        return self.source[self.at[i] : brace] if brace > self.at[i] else self.source[self.at[i] :].split("\n", 1)[0]

    def symbols(self) -> Iterator[tuple[str, str, int, str | None, str | None]]:
        """(name, kind, line, owner, signature) of declarations at the top and of the members of classes and interfaces."""
        for span in self.statements():
            kind, names, _, _ = self.told(span)
            if kind in ("", "import", "export"):
                continue
            at, said = self.line[span[0]], self.signature(span[0])
            for name in names:
                if name:
                    yield name, "const" if kind in ("let", "var") else kind, at, None, said
            if kind in ("class", "interface") and names[0] and (brace := self.body(span)) is not None:
                for m in self.statements(brace, members=True):
                    if got := self.member(m):
                        yield got[0], got[1], self.line[m[0]], names[0], self.signature(m[0]) if got[1] == "method" else None

    def links(self) -> Iterator[tuple[str, str]]:
        """(import or export, name): modules that are taken from, and names that are given out."""
        for span in self.statements():
            kind, names, said, i = self.told(span)
            text, last = self.text, span[1]
            if kind == "import" and i < last and text[i + 1] not in ("(", "."):
                module = next((j for j in range(i + 1, last + 1) if self.kind[j] == "s"), None)
                if module is not None:
                    yield "import", text[module][1:-1]
            elif said & {"export"}:
                if kind in ("function", "class", "interface", "type", "enum", "const", "let", "var"):
                    yield from (("export", n) for n in names if n)
                    continue
                if "default" in said or i <= last and text[i] == "=":
                    yield "export", "default"
                    continue
                start = i + (text[i] == "type")
                module = next((j for j in range(start, last + 1) if self.kind[j] == "s" and j and text[j - 1] == "from"), None)
                if module is not None:
                    yield "import", text[module][1:-1]
                if start <= last and text[start] == "{":
                    end, names_ = self.close.get(start, last), []
                    for j in range(start + 1, end):
                        if self.kind[j] == "w" and text[j + 1] in (",", "}"):
                            names_.append(text[j])
                    yield from (("export", n) for n in names_)

    def hooks(self) -> list[str]:
        call = lambda i: i + 1 < len(self.at) and (self.text[i + 1] == "(" or self.text[i + 1] == "<" and self._types(i + 1, len(self.at) - 1))
        return sorted({t for i, t in enumerate(self.text) if self.kind[i] == "w" and re.match(r"use[A-Z]", t) and call(i) and not (i and self.text[i - 1] in (".", "?.", "function"))})

    def outline(self) -> list[str]:
        """A line for each statement at the top."""
        out = []
        for span in self.statements():
            kind, names, said, i = self.told(span)
            end = self.at[span[1]] + len(self.text[span[1]])
            whole = self.source[self.at[span[0]] : end]
            head = "export " if "export" in said else ""
            if kind == "import":
                out.append(self._import(i, span[1]))
            elif kind in ("function", "class", "interface", "type", "enum"):
                out.append(f"{head}{kind} {names[0] or 'anonymous'}{'()' if kind == 'function' else ''}")
            elif kind in ("const", "let", "var"):
                out.append(f"{head}{kind} {', '.join(self._patterns(i + 1, span[1], names))}")
            elif {"export", "default"} <= said:
                out.append("export default " + self.source[self.at[i] : end].rstrip(";").rstrip())
            else:
                out.append(whole.split("\n", 1)[0])
        return out

    def _patterns(self, i: int, last: int, names: list[str | None]) -> list[str]:
        """Names as they stand, patterns too."""
        if None not in names:
            return [n for n in names if n]
        found, at = [], [j for j in range(i, last + 1) if self.up[j] == self.up[i] and self.text[j] in ("{", "[") and (j == i or self.text[j - 1] == ",")]
        for n in names:
            if n is None and at:
                j = at.pop(0)
                found.append(self.source[self.at[j] : self.at[self.close.get(j, last)] + 1])
            elif n:
                found.append(n)
        return found

    def _import(self, i: int, last: int) -> str:
        """import clause from 'module', the clause with single blanks."""
        module = next((j for j in range(i + 1, last + 1) if self.kind[j] == "s"), None)
        if module is None:
            return self.source[self.at[i] : self.at[last] + len(self.text[last])].split("\n", 1)[0]
        if module == i + 1:
            return f"import {self.text[module]}"
        parts, k = [], i + 1
        k += self.text[k] == "type" and self.text[k + 1] not in ("from", ",")
        while k < module and self.text[k] != "from":
            if self.text[k] == "{":
                end = self.close.get(k, module)
                names = " ".join(t for t in self.text[k + 1 : end] if t != "type").replace(" ,", ",").rstrip(",")
                parts.append(f"{{ {names} }}")
                k = end
            elif self.text[k] == "*":
                parts.append(f"* as {self.text[k + 2]}")
                k += 2
            elif self.text[k] != ",":
                parts.append(self.text[k])
            k += 1
        return f"import {', '.join(parts)} from {self.text[module]}"

    def lines_of(self, name: str) -> tuple[int, int] | None:
        """(first, last line) of the statement at the top that declares a name, else of the first member or property of that name."""
        end = lambda i: self.line[i] + self.text[i].count("\n") + (self._template_lines(i) if self.kind[i] == "t" else 0)
        for span in self.statements():
            kind, names, _, _ = self.told(span)
            if kind and name in names:
                return self.line[span[0]], end(span[1])
        for i, t in enumerate(self.text):
            b = self.up[i]
            if t == name and self.kind[i] == "w" and b >= 0 and self.holds.get(b) in ("class", "object"):
                for span in self._entries(b):
                    if span[0] <= i <= span[1] and self._named(span, name, i):
                        return self.line[span[0]], end(span[1])
        return None

    def _template_lines(self, i: int) -> int:
        stop = self.at[i + 1] if i + 1 < len(self.at) else len(self.source)
        return self.source[self.at[i] : stop].rstrip().count("\n")

    def _entries(self, b: int) -> list[tuple[int, int]]:
        if self.holds[b] == "class":
            return [(a, z if self.text[z] != "," else z - 1) for a, z in self.statements(b, members=True)]
        out, first, last = [], None, None
        for i in self._directly_in(b):
            if self.text[i] in (",", ";"):
                if first is not None:
                    out.append((first, last))
                first = None
            else:
                first, last = i if first is None else first, i
        return out + ([(first, last)] if first is not None else [])

    def _named(self, span: tuple[int, int], name: str, i: int) -> bool:
        """Whether the token i is the name of this member or property, not something in its value."""
        k = self._after_decorators(*span)
        while k < i and self.kind[k] == "w" and self.text[k] in _MEMBER_MODIFIERS or k < i and self.text[k] == "*":
            k += 1
        return k == i and (i == span[1] or self.text[i + 1] in (":", "(", "=", "?", "!", "<", ";"))
