"""LaTeX to light markup: a reader walks the source once, and a table says what each command turns its arguments into.

Defined cases: NULL is the empty text; a command that lacks its argument, an environment without an end and a brace
without a partner count as if they stood alone; groups nested deeper than DEEPEST are taken as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPEST = 100
# Environments left out, and environments of which only the frame is.
DROPPED = frozenset("figure table tabular tabularx tabbing tikzpicture pgfpicture minipage wrapfigure sidewaysfigure sidewaystable eqnarray align gather multline equation displaymath array matrix pmatrix bmatrix vmatrix thebibliography tcolorbox algorithm algorithmic verbatim lstlisting minted comment CCSXML".split())
KEPT = frozenset("abstract quote quotation sloppypar sloppy small footnotesize".split())
LISTS = {"itemize": False, "enumerate": True, "description": False}
# Headings, and commands by what becomes of them.
HEADINGS = {"chapter": "#", "section": "#", "subsection": "##", "subsubsection": "###", "paragraph": "####", "subparagraph": "#####"}
WITHOUT_ARGUMENT = "label index nocite hypertarget hyperlink bibliography bibliographystyle input include subfile usepackage RequirePackage DeclareMathOperator newcommand renewcommand providecommand newenvironment setlength setcounter addtolength definecolor color textcolor colorbox fcolorbox graphicspath includegraphics caption captionof captionsetup listoffigures listoftables tableofcontents appendix markboth markright pagestyle thispagestyle fancyhead fancyfoot titlespacing geometry setmainfont setsansfont setmonofont titleformat date thanks".split()
CITES = "cite citep citet citeauthor citeyear citealp citealt parencite textcite autocite fullcite".split()
REFERENCES = "ref eqref pageref autoref cref Cref nameref vref".split()
FRAMED = {"emph": "*", "textit": "*", "textsl": "*", "textbf": "**", "bfseries": "**", "strong": "**"}
LOGOS = "LaTeX TeX XeLaTeX LuaLaTeX BibTeX".split()
# Signs.
SIGNS = {
    "&": "&", "$": "$", "_": "_", "%": "%", "#": "#", "{": "{", "}": "}", "~": "~", "^": "^", "textbackslash": "\\", "ldots": "…", "dots": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱", "textellipsis": "…", "textendash": "–", "textemdash": "—",
    "textquoteleft": "‘", "textquoteright": "’", "textquotedblleft": "“", "textquotedblright": "”", "textbar": "|", "textless": "<", "textgreater": ">", "\n": "\n",
}
LIGATURES = {"---": "—", "--": "–", "``": "“", "''": "”", "~": " "}
_THIN = ",;:!/"
_BLANK = " \t\n\r\x0b\x00"
_TOKEN = re.compile(r"\\(?P<name>[A-Za-z]+)(?P<star>\*?)|\\(?P<sign>.)|(?P<brace>[{}])|(?P<ligature>---|--|``|''|~)|(?P<text>[^\\{}~`'-]+|.)", re.DOTALL)


class Reader:
    """A place in a source, from which groups and options are taken."""

    def __init__(self, source: str) -> None:
        self.source, self.at = source, 0

    def skip_blanks(self) -> None:
        while self.at < len(self.source) and self.source[self.at].isspace():
            self.at += 1

    def group(self, options: int = 0) -> str | None:
        """What stands in the braces that follow, after so many options at most; None, and nothing taken, if none follow."""
        start = self.at
        self.skip_blanks()
        while options and self.source.startswith("[", self.at) and (end := self.source.find("]", self.at)) > 0:
            self.at, options = end + 1, options - 1
            self.skip_blanks()
        if self.source.startswith("{", self.at):
            depth, k = 0, self.at
            while k < len(self.source):
                c = self.source[k]
                depth += (c == "{") - (c == "}")
                if not depth:
                    inner, self.at = self.source[self.at + 1 : k], k + 1
                    return inner
                k += 2 if c == "\\" else 1
        self.at = start
        return None

    def option(self) -> None:
        m = re.compile(r"\s*\[[^\]]*\]").match(self.source, self.at)
        self.at = m.end() if m else self.at

    def environment(self, name: str) -> str | None:
        """The body up to the end of the environment just opened, others of its name within it; None if it has no end."""
        depth, at = 1, self.at
        for m in re.compile(rf"\\(begin|end)\{{{re.escape(name)}\*?\}}").finditer(self.source, self.at):
            depth += 1 if m[1] == "begin" else -1
            if not depth:
                self.at = m.end()
                return self.source[at : m.start()]
        return None


def tidy(text: str) -> str:
    """No blanks at line ends, no more than one empty line or one blank in a row."""
    lines = [x.rstrip(" \t") for x in text.split("\n")[:-1]] + text.split("\n")[-1:]
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(lines))).strip(_BLANK)


class Renderer:
    """Turns sources into light markup; head stands in for the first \\maketitle."""

    def __init__(self, head: str = "") -> None:
        self.head, self.depth = head, 0
        self.commands: dict[str, Callable[[Reader, str], str | None]] = {
            "begin": self._begin, "maketitle": lambda r, _: self._take_head(), "footnotemark": lambda r, _: r.option() or "", "href": self._link,
            "title": self._framed("\n# ", "\n"), "author": self._framed("\n*", "*\n"), "footnote": self._framed(" (", ")"), "url": self._framed("", ""), "nolinkurl": self._framed("", ""),
        }
        self.commands |= {name: self._heading for name in HEADINGS} | {name: self._framed(mark, mark) for name, mark in FRAMED.items()} | {name: lambda r, name: name for name in LOGOS}
        self.commands |= {name: self._left_out for name in WITHOUT_ARGUMENT} | {name: self._framed("(", ")", 2) for name in CITES} | {name: self._framed("[", "]") for name in REFERENCES}

    def render(self, source: str) -> str:
        if self.depth > DEEPEST:
            return source.replace("{", "").replace("}", "")
        self.depth += 1
        reader, out = Reader(source), []
        while m := _TOKEN.match(source, reader.at):
            reader.at = m.end()
            if m["name"]:
                out.append(self._command(reader, m["name"]))
            elif m["sign"]:
                out.append(self._escape(reader, m["sign"]))
            elif not m["brace"]:
                out.append(LIGATURES[m["ligature"]] if m["ligature"] else m["text"])
        self.depth -= 1
        return "".join(out)

    def _command(self, reader: Reader, name: str) -> str:
        if name in SIGNS:
            return SIGNS[name]
        made = self.commands[name](reader, name) if name in self.commands else None
        if made is None:  # unknown, or without its argument: the argument, if any, stays
            inner = reader.group(99)
            made = "" if inner is None else self.render(inner)
        return made

    def _escape(self, reader: Reader, sign: str) -> str:
        if sign == "\\":
            reader.option()
            return "\n"
        following = reader.source[reader.at : reader.at + 1]
        if sign in _THIN and (following.isalnum() or following == "_"):
            return ""
        return SIGNS.get(sign, "\\" + sign)

    def _framed(self, before: str, after: str, options: int = 0) -> Callable[[Reader, str], str | None]:
        def made(reader: Reader, _: str) -> str | None:
            inner = reader.group(options)
            return None if inner is None else before + self.render(inner) + after

        return made

    def _left_out(self, reader: Reader, _: str) -> str:
        reader.group(1)
        return ""

    def _heading(self, reader: Reader, name: str) -> str | None:
        inner = reader.group(1)
        return None if inner is None else f"\n\n{HEADINGS[name]} {tidy(self.render(inner))}\n\n"

    def _link(self, reader: Reader, _: str) -> str | None:
        start = reader.at
        address, shown = reader.group(), reader.group()
        if address is None or shown is None:
            reader.at = start
            return None
        return f"[{self.render(shown)}]({self.render(address)})"

    def _take_head(self) -> str:
        head, self.head = self.head, ""
        return head

    def _begin(self, reader: Reader, _: str) -> str | None:
        start = reader.at
        name = (reader.group() or "").rstrip("*")
        if name in DROPPED and reader.environment(name) is not None:
            return ""
        if name in KEPT and (body := reader.environment(name)) is not None:
            return f"\n\n{self.render(body)}\n\n"
        if name in LISTS and (body := reader.environment(name)) is not None:
            return self._items(body, LISTS[name])
        reader.at = start
        return None

    def _items(self, body: str, numbered: bool) -> str:
        """Items at the list's own level; what stands before the first is left out."""
        starts, depth = [], 0
        for m in re.finditer(r"\\(begin|end)\{(?:itemize|enumerate|description)\*?\}|\\item(?![A-Za-z])(?:\[[^\]]*\])?\s*", body):
            if m[1]:
                depth += 1 if m[1] == "begin" else -1
            elif not depth:
                starts.append((m.start(), m.end()))
        ends = [a for a, _ in starts[1:]] + [len(body)]
        items = [x for (_, a), b in zip(starts, ends, strict=True) if (x := self.render(body[a:b]).strip(_BLANK))]
        if not body.strip(_BLANK):
            return ""
        return "\n\n" + "\n".join(f"{k}. {x}" if numbered else f"- {x}" for k, x in enumerate(items, 1)) + "\n\n"


def without_comments(tex: str) -> str:
    """Comments go with their line's end and the next line's indent; an escaped sign is none."""
    return re.sub(r"(\\.)|%[^\n]*(?:\n[ \t]*)?", lambda m: m[1] or "", tex, flags=re.DOTALL)


def _argument(tex: str, command: str) -> str:
    m = re.search(rf"\\{command}(?![A-Za-z])", tex)
    if not m:
        return ""
    reader = Reader(tex)
    reader.at = m.end()
    return (reader.group() or "").strip(_BLANK)


def tex_to_text(tex: str | None) -> str:
    """Light markup of a document: its title and author where they are set, then its body."""
    source = without_comments(tex or "")
    title, author = _argument(source, "title"), _argument(source, "author")
    _, opened, inside = source.partition("\\begin{document}")
    body = (inside if opened else source).partition("\\end{document}")[0]
    head = Renderer().render((f"\\title{{{title}}}" if title else "") + (f"\\author{{{author}}}" if author else ""))
    if not re.search(r"\\maketitle(?![A-Za-z])", body):
        return tidy(f"{head}\n{Renderer().render(body)}" if head else Renderer().render(body))
    return tidy(Renderer(head).render(body))


@F.pandas_udf(T.StringType())
def tex_to_text_udf(tex: pd.Series) -> pd.Series:
    return tex.map(tex_to_text)
