"""Which files count: ignore patterns with gitignore semantics, and allowed extensions."""

from __future__ import annotations

import re
from collections.abc import Iterable

BINARY_EXTENSIONS = (".pdf",)

#: Names of the files of a section that hold its own rules and settings.
IGNORE_FILE, ALLOW_FILE, SECTION_FILE = ".tesseraignore", ".tesseraallow", "section.yaml"

#: Patterns that are always ignored.
IGNORE = """
.*/
.tesseraignore .tesseraallow section.yaml .env .env.* .DS_Store *.pem *.key
CVS/ _darcs/ RCS/ SCCS/
node_modules/ bower_components/ jspm_packages/ vendor/ venv/ env/ virtualenv/ __pycache__/ dist/ build/ _build/ out/ target/ bin/ obj/ site-packages/ Pods/ Carthage/
htmlcov/ coverage/ .sass-cache/
Thumbs.db Desktop.ini $RECYCLE.BIN/
""".split()

#: Extensions of text files.
ALLOW = """
.txt .text .md .markdown .mdown .mkd .mkdn .mdx .rst .org .adoc .asciidoc .textile .pod .tex .latex .ltx .bib
.html .htm .xhtml .xml .xsl .xslt .svg .rss .atom .vue .svelte .astro
.json .json5 .jsonl .ndjson .geojson .yaml .yml .toml .ini .cfg .conf .config .properties .csv .tsv .editorconfig .gitattributes .tf .tfvars .hcl .proto .graphql .gql
.sh .bash .zsh .fish .ps1 .psm1 .bat .cmd .awk .sed
.py .pyi .pyx .pxd
.js .mjs .cjs .jsx .tsx .mts .cts .coffee
.css .scss .sass .less .styl
.java .kt .kts .scala .sc .groovy .gradle .clj .cljs .cljc .edn
.c .h .cc .cpp .cxx .hpp .hh .hxx .cs .m .mm
.go .rs .rb .rake .gemspec .php .swift .pl .pm .lua .tcl .r .jl .dart .ex .exs .erl .hrl .hs .lhs .elm .ml .mli .fs .fsx .nim .cr .zig .d .v .sv .vhd .vhdl
.f .f90 .f95 .for .pas .pp .ada .adb .ads .asm .s
.el .lisp .lsp .scm .rkt .vim
.sql .ddl .cmake .mk .bzl .bazel .nix .dockerfile .containerfile
""".split()


def lines_of(text: str) -> list[str]:
    """Lines without blanks around them; empty lines and comments are left out."""
    return [line for raw in text.splitlines() if (line := raw.strip()) and not line.startswith("#")]


def extensions_of(text: str) -> set[str]:
    """One extension a line, lower case; the leading dot may be missing."""
    return {("" if line.startswith(".") else ".") + line.lower() for line in lines_of(text)}


class Ignore:
    """Patterns in order; the last that matches a path decides, and ``!`` takes a path back in.

    A pattern with a slash inside is anchored at the section, another matches names at any depth; a slash at the end asks for a directory.
    ``*`` and ``?`` stop at slashes, ``**`` doesn't. What lies in an ignored directory is ignored.
    """

    def __init__(self, patterns: Iterable[str]):
        self.rules = [self._rule(p) for p in patterns]
        # One expression for directories and one for files: alternatives from the last rule to the first, so that what matches is the rule that decides.
        self._deciding = {d: re.compile("|".join(f"(?P<r{i}>{r.pattern})" for i, (_, only, r) in reversed(list(enumerate(self.rules))) if d or not only) or r"(?!)") for d in (True, False)}

    @staticmethod
    def _rule(pattern: str) -> tuple[bool, bool, re.Pattern[str]]:
        keep = pattern.startswith("!")
        body = pattern[keep:].removeprefix("\\")
        directory = body.endswith("/")
        body = body.rstrip("/") if directory else body
        anchored = "/" in body
        out, i = "", 0
        body = body.lstrip("/")
        while i < len(body):
            c = body[i]
            if body.startswith("**/", i):
                out, i = out + "(?:[^/]+/)*", i + 3
            elif body.startswith("**", i):
                out, i = out + ".*", i + 2
            elif c == "[" and "]" in body[i + 2 :]:
                end = body.index("]", i + 2)
                inner = body[i + 1 : end].replace("\\", "\\\\")
                out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            else:
                out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
        return keep, directory, re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z")

    def _own(self, path: str, directory: bool) -> bool:
        m = self._deciding[directory].match(path)
        return m is not None and not self.rules[int(m.lastgroup[1:])][0]

    def matches(self, path: str, directory: bool = False) -> bool:
        """Whether a path (relative, with slashes) is ignored, by itself or by a directory above it."""
        parts = path.split("/")
        return any(self._own("/".join(parts[:i]), True) for i in range(1, len(parts))) or self._own(path, directory)
