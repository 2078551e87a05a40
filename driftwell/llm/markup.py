"""Markup residue in text documents (problem 1).

A page is a sequence of leaf blocks: the lines of its text, each with the ancestors it has in the page's DOM, and the pieces of
a line that could be markup.  A linear-chain conditional random field with ancestor-tag and text features, trained on labelled
pages (``labelled_pages``) and decoded by Viterbi, labels every line (paragraph, heading, list, code, formula) and every piece
(HTML, Markdown, wiki, LaTeX, or meant as plain text).
"""

from __future__ import annotations

import hashlib
import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.common import spread
from driftwell.llm.crf import LinearChainCRF

KINDS = ("html", "markdown", "wiki", "latex")
LINES = ("paragraph", "heading", "list", "code", "formula")
LABELS = (*LINES, *KINDS, "plain")
#: Pages the model is trained on, and texts of the table that they are made from, at most.
PAGES, SAMPLE = 1400, 500

#: Number of the features and labelled pages that weights are of; weights kept under another one aren't read.
FIELD = 2

#: Element names of HTML.
TAGS = frozenset(
    """a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn div dl dt em embed
    fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math meta nav noscript object ol
    option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul
    var video wbr ref nowiki gallery""".split()
)
#: LaTeX commands of mathematics, which also stand in formulas typed as plain text.
MATH = frozenset("frac sqrt sum int prod lim leq geq neq pi alpha beta gamma delta Delta epsilon theta lambda mu sigma omega infty cdot times pm approx partial nabla in to log sin cos exp left right".split())

_PIECES = {
    "comment": r"<!--(?:[^<-]|-(?!->)|<(?!!--))*+-->|<!--(?:\[if[^\]\n]*\]>?)?|-->|<!\[endif\]-->|<!\[CDATA\[|<!DOCTYPE[^>\n]*>|<\?xml[^>\n]*>",
    "tag": r"</?[a-zA-Z][a-zA-Z0-9]{0,15}(?:\s[^<>\n]*+)?/?>",
    "broken": r"<[a-zA-Z]{1,12}\s{1,4}[a-zA-Z-]{1,30}\s{0,4}=\s{0,4}[\"']?[^<>\n\"']*(?:[\"']\s*[a-zA-Z-]+=[\"']?)?",
    "entity": r"&(?:[a-zA-Z][a-zA-Z0-9]{1,24}|\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6});",
    "fence": r"```[\w+-]*|~~~+",
    "tick": r"(?<!`)`[^`\n]+`(?!`)",
    "url_end": r"\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+\"[^\"\n]*\")?\)",
    "wiki_url": r"\[(?:https?:)?//[^\s\[\]]++(?=[\s\]])",
    "wiki_open": r"\[\[(?:[^\[\]|\n]*\|)*",
    "wiki_close": r"\]\]",
    "bracket": r"!?\[(?=(?:[^\[\]\n]|!?\[[^\[\]\n]*+\](?:\([^()\n]*+\))?)++\]\()",
    "task": r"(?<!\S)[*+-] \[[ xX]\](?=\s|$)",
    "quotes": r"'{2,5}",
    "stars": r"\*{1,3}(?=[^\s*])|(?<=[^\s*])\*{1,3}|\*{4,}|\*",
    "unders": r"(?<!\w)_{1,3}(?=[^\s_])|(?<=[^\s_])_{1,3}(?!\w)|__",
    "tildes": r"~~",
    "hashes": r"(?:^|(?<=\s))\#{1,6}(?=\s)",
    "gt": r"(?:^|(?<=\s))>+(?=\s)",
    "table_rule": r"(?<![-:])(?:\|[ ]*+)?:?-{3,}+:?[ ]*+(?:\|[ ]*+:?-{3,}+:?[ ]*+)+\|?",
    "wiki_table": r"\{\|[^\n|]*|\|\}(?!\})|\|-(?=\s|$)|(?<=\s)\|\|(?=\s)",
    "template": r"\{\{[^{}|\n]*\|?|\}\}+",
    "equals": r"(?<![=<>!:+*/-])={2,6}(?!=)",
    "magic": r"__[A-Z]{3,}__",
    "env": r"\\(?:begin|end)\s*\{[a-zA-Z]+\*?\}(?:\[[^\[\]\n]*+\])?",
    "cite": r"~?\\(?:cite[a-z]*|ref|eqref|label|footnotemark|includegraphics|usepackage|documentclass|bibliography)\*?(?:\[[^\[\]\n]*+\])?\{[^{}\n]*+\}",
    "command": r"\\[a-zA-Z]++\*?(?:\[[^\[\]\n]*+\])?\{?",
    "display": r"\\[\[\]()]",
    "dollar": r"\${1,2}",
    "brace": r"\}",
}
_PIECE = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PIECES.items()))
#: Characters without one of which nothing in a line can be a piece.
_ANY = re.compile(r"[<>&`\[\]*_~#|={}\\$]|''")
_MARKS = re.compile(r"[\W_]+")
_CODELIKE = re.compile(r"[;{}]\s*$|^\s*(?:for|if|while|def|class|return|let|var|const|import|select|insert|update|echo|print|function|\#include|public)\b.*[=;(){}:*]|\w\([^()]*+\)[)\s]*+[;:{]|=>|==|\+=", re.I)
_FORMULA = re.compile(r"^[\s\w\\{}^_=+\-*/().,<>|]*(?:[=<>]|\\[a-zA-Z]+)[\s\w\\{}^_=+\-*/().,<>|]*$")
_TALK = re.compile(r"\b(?:tags?|elements?|typed|sign|attribute|markup|syntax|called|balise|etiqueta)\b", re.I)


_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tr figure figcaption section article dd dt".split())
_CODES_IN = frozenset("code kbd samp math".split())
#: Marks inside a leaf's text: a line end that HTML takes for a blank, and the border of a table cell.
_SOFT, _CELL = "\x0b", "\x1f"
#: What a line of a block begins with when the page's line ends mean something there.
_FORM = re.compile(r"\s*(?:[#>|*+=~-]|```|\d+[.)]\s|\\|\{\||\$\$)")
_FENCE = re.compile(r"```|~~~|\$\$|\\(?:begin|end)\b")
#: Scripts written without blanks.
_WIDE = re.compile(r"[\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef]")


class _Leaves(HTMLParser):
    """The text leaves of a page with their ancestors.

    What is kept of an open element is the block it stands in and the distinct names of blocks around it, the nearest last,
    so that a page with any number of open elements costs no more than in proportion.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...], int]] = [("", (), 0)]
        self.open: dict[str, int] = {}
        self.leaves: list[tuple[str, tuple[str, ...], int]] = []
        self.blocks = 0

    def _add(self, text: str) -> None:
        _, up, block = self.stack[-1]
        self.leaves.append((text, up, block))

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "hr", "img", "input", "meta", "link", "wbr", "source"):
            self._add("\n" if tag != "wbr" else "")
            return
        _, up, block = self.stack[-1]
        if tag in _BLOCKS or tag in _CODES_IN:
            up = (*(x for x in up if x != tag), tag)
        if tag in _BLOCKS:
            self.blocks += 1
            block = self.blocks
        if tag in ("td", "th"):
            self._add(_CELL)
        self.stack.append((tag, up, block))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while True:
                name = self.stack.pop()[0]
                self.open[name] -= 1
                if name == tag:
                    break
            self._add("\n" if tag in _BLOCKS else "")

    def handle_data(self, data):
        if not self.open.get("script") and not self.open.get("style"):
            _, up, _ = self.stack[-1]
            self._add(data if not up or "pre" in up else data.replace("\r\n", "\n").replace("\n", _SOFT))


def leaves(page: str) -> list[tuple[str, tuple[str, ...]]]:
    """(text, ancestors) of the lines of an HTML page; broken pages are read as far as they go.

    A line end inside a block (but pre) is a blank, unless the next line begins with a mark of another syntax, as a heading or a
    list, or stands in a fence; cells of a table row are set apart by bars.
    """
    own = _Leaves()
    try:
        own.feed(page)
        own.close()
    except (AssertionError, ValueError):
        pass
    out: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    letters: dict[tuple[str, ...], int] = {}

    def close() -> None:
        text = "".join(parts)
        parts.clear()
        up = max(letters, key=letters.get) if letters else ()
        letters.clear()
        for line in text.split("\n"):
            out.extend((x, up) for x in _joined(line.split(_SOFT)) if x.strip(" |"))

    at = 0
    for data, up, block in own.leaves:
        if data == "\n" and parts and block == at:
            parts.append(data)
            continue
        if block != at:
            close()
            at = block
        parts.append(data)
        n = len(data) - data.count(" ")
        if n:
            letters[up] = letters.get(up, 0) + n
    close()
    return out


def _joined(parts: list[str]) -> list[str]:
    """The lines of a block's text: a plain line goes on the plain line before it, unless both stand in a fence."""
    out: list[str] = []
    fenced = plain = False
    for x in parts:
        x = _bars(x)
        own, turns = bool(_FORM.match(x)), len(_FENCE.findall(x)) % 2 == 1
        if plain and not own and not turns and x.strip():
            x = x.strip()
            out[-1] += x if _WIDE.match(x) and _WIDE.match(out[-1][-1:]) else f" {x}"
        else:
            out.append(x)
        fenced ^= turns
        plain = bool(x.strip()) and not own and not turns and not fenced
    return out


def _bars(text: str) -> str:
    """``text`` with bars between its table cells."""
    return " | ".join(x.strip() for x in text.split(_CELL) if x.strip()) if _CELL in text else text


def _bare(text: str) -> str:
    return _MARKS.sub("", text)


def ancestors(lines: list[str], page: str | None) -> list[tuple[str, ...]]:
    """The ancestors in ``page`` of each line of the text that was made of it; none where a line can't be found.

    A line is looked for whole, then by ever shorter beginnings, as the rest of it may have been cleaned in another way.
    """
    if not page:
        return [()] * len(lines)
    own = [(_bare(text), at) for text, at in leaves(page)]
    stream, ends = "".join(b for b, _ in own), list(accumulate(len(b) for b, _ in own))
    out, place = [], 0
    for line in lines:
        b = _bare(html.unescape(line))
        size, hit = len(b), -1
        while hit < 0 and size and (size == len(b) or size >= 12):
            hit = stream.find(b[:size], place)
            size //= 2
        if hit < 0 and b:
            hit = stream.find(b[-24:], place)
        if hit >= 0:
            out.append(own[bisect_right(ends, hit)][1])
            place = hit
        else:
            out.append(())
    return out


def _side(c: str) -> str:
    return "edge" if not c or c == "\n" else "space" if c.isspace() else "word" if c.isalpha() else "digit" if c.isdigit() else "mark" if c in ".,;:!?…。、)\"'”»" else "other"


def blocks(text: str, page: str | None = None) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, type, features) of the leaf blocks of a text: each line and each piece in it that could be markup."""
    lines = [(m.start(), m.group()) for m in re.finditer(r"[^\n\r\u2028]+", text)]
    over = ancestors([x for _, x in lines], page)
    counts: dict[str, int] = {}
    found = []
    for (at, line), up in zip(lines, over, strict=True):
        pieces = list(_PIECE.finditer(line)) if _ANY.search(line) else []
        found.append((at, line, up, pieces))
        for m in pieces:
            counts[m.lastgroup] = counts.get(m.lastgroup, 0) + 1
    out = []
    math_open = False
    for at, line, up, pieces in found:
        code = bool(_CODELIKE.search(line)) and not line.rstrip().endswith(("。", "."))
        formula = len(line) < 120 and bool(_FORMULA.match(line))
        near = up[-1] if up else "none"
        pre = "pre" in up or "code" in up
        words = len(line.split())
        f = ["line", f"up={near}", f"code={code}", f"formula={formula}", f"short={words <= 6}", f"closed={line.rstrip()[-1:] in '.!?…。'}", f"pre={pre}", f"up={near}|code={code}|formula={formula}"]
        f += [f"in={x}" for x in set(up)]
        out.append((at, at, "line", f))
        details = _details(line, pieces)
        first, last = len(line) - len(line.lstrip()), len(line.rstrip())
        for n, m in enumerate(pieces):
            kind, s = m.lastgroup, m.group()
            a, b = m.span()
            left, right = line[a - 1 : a], line[b : b + 1]
            partner, detail = details[n]
            lo, hi = max(0, a - 24), min(len(line), b + 24)
            talk = bool(_TALK.search(line[lo:a]) or _TALK.search(line[b:hi]))
            f = [kind, f"{kind}|left={_side(left)}", f"{kind}|right={_side(right)}", f"{kind}|{_side(left)}|{_side(right)}", f"{kind}|partner={partner}", f"{kind}|{detail}", f"{kind}|{detail}|partner={partner}"]
            f += [f"{kind}|talk={talk}|{detail}", f"{kind}|code={code}", f"{kind}|formula={formula}|math={math_open}", f"{kind}|pre={pre}", f"{kind}|many={min(3, counts[kind])}", f"{kind}|start={a <= first}", f"{kind}|end={b >= last}"]
            f += [f"{kind}|size={min(4, len(s))}|{_side(left)}|{_side(right)}|partner={partner}"]
            if n:
                f.append(f"{kind}|after={pieces[n - 1].lastgroup}")
            if n + 1 < len(pieces):
                f.append(f"{kind}|before={pieces[n + 1].lastgroup}")
            if kind == "env":
                math_open = s.startswith("\\begin")
            if kind == "display":
                math_open = s in ("\\[", "\\(")
            out.append((at + a, at + b, kind, f))
    return out


def _tag_name(s: str) -> str:
    return re.match(r"</?([a-zA-Z0-9]+)", s).group(1).lower()


def _tag_places(line: str, pieces: list) -> tuple[dict[str, int], dict[str, int]]:
    """Where each name of a tag among ``pieces`` first opens in the line, and where it last closes (as the start of a name, too)."""
    names = {_tag_name(m.group()) for m in pieces if m.lastgroup == "tag"}
    first, last = {}, {}
    if not names:
        return first, last
    sizes = sorted({len(x) for x in names})
    for m in re.finditer(r"<(/?)([a-zA-Z0-9]+)", line):
        for size in sizes:
            if size > len(m.group(2)):
                break
            name = m.group(2)[:size].lower()
            if name in names:
                if m.group(1):
                    last[name] = m.start()
                else:
                    first.setdefault(name, m.start())
    return first, last


def _details(line: str, pieces: list) -> list[tuple[bool, str]]:
    """For each piece of a line: whether it has a counterpart in the line, and a word on what it looks like.

    Counts, depth and counterparts are taken once over the whole line, so that a line of any length costs in proportion.
    """
    if not pieces:
        return []
    opened, closed = _tag_places(line, pieces)
    dollars = [p for p in pieces if p.lastgroup == "dollar"]
    fences = sum(p.lastgroup == "fence" for p in pieces)
    last_brace = line.rfind("}")
    there = {x: x in line for x in ("]]", "[[", "](", "[", "]", "{{", "}}")}
    marks = {x: [m.start() for m in re.finditer(re.escape(x), line)] for x in ("\\[", "\\]", "\\(", "\\)")}

    def before(x: str, a: int) -> int:
        k = bisect_right(marks[x], a - len(x))
        return marks[x][k - 1] if k else -1

    def opens(a: int, b: int) -> bool:
        return line[b : b + 1].strip() != "" and not line[max(0, a - 1) : a].isalnum()

    def closes(a: int, b: int) -> bool:
        return line[max(0, a - 1) : a].strip() != "" and not line[b : b + 1].isalnum()

    same: dict[tuple[str, str], list[int]] = {}  # of pieces of one form: how many, the first that opens, the last that closes
    for p in pieces:
        if p.lastgroup in ("stars", "unders", "tildes", "quotes", "equals"):
            one = same.setdefault((p.lastgroup, p.group()), [0, len(line), -1])
            one[0] += 1
            if opens(*p.span()):
                one[1] = min(one[1], p.start())
            if closes(*p.span()):
                one[2] = p.start()
    out = []
    at = signs = depth = seen = 0  # up to ``at``: dollar signs and braces of the text; dollars among the pieces
    opener = None
    for p in pieces:
        kind, s = p.lastgroup, p.group()
        a, b = p.span()
        signs += line.count("$", at, a)
        depth += line.count("{", at, a) - line.count("}", at, a)
        at = a
        got = (False, "")
        if kind == "tag":
            name = _tag_name(s)
            close = s.startswith("</")
            partner = opened.get(name, a) < a if close else closed.get(name, -1) >= b
            form = "close" if close else "attr" if "=" in s else "void" if name in ("br", "hr", "img", "wbr", "input") or s.endswith("/>") else "open"
            got = partner, f"{'known' if name in TAGS else 'odd'}|{form}"
        elif kind == "entity":
            got = False, "known" if html.unescape(s) != s else "odd"
        elif kind == "command":
            math_ = "math" if re.match(r"\\([a-zA-Z]+)", s).group(1) in MATH else "text"
            inside = signs % 2 == 1 or before("\\[", a) > before("\\]", a) or before("\\(", a) > before("\\)", a)
            path = bool(re.search(r"[A-Za-z]:$|[\w.]$", line[max(0, a - 2) : a])) and not s.endswith("{")
            got = s.endswith("{") and last_brace >= b, f"{math_}|{'arg' if s.endswith('{') else 'bare'}|{'inside' if inside else 'out'}|{'path' if path else ''}"
            if s.endswith("{"):
                opener = re.match(r"\\(\w+)", s).group(1)
        elif kind == "dollar":
            k, seen = seen, seen + 1
            after_next = dollars[k + 1] if k % 2 == 0 and k + 1 < len(dollars) else None
            span = line[b : after_next.start()] if after_next else line[dollars[k - 1].end() : a] if k % 2 else ""
            neat = bool(span) and not span[0].isspace() and not span[-1].isspace()
            mathy = bool(re.search(r"[\\^_=]|^[a-zA-Z]$", span))
            after = line[after_next.end() : after_next.end() + 1] if after_next else line[b : b + 1] if k % 2 else ""
            got = len(dollars) % 2 == 0 and neat, f"{'math' if mathy else 'other'}|{'tight' if after.isalnum() else 'free'}|{'digit' if line[b : b + 1].isdigit() and k % 2 == 0 else ''}"
        elif kind in ("stars", "unders", "tildes", "quotes", "equals"):
            count, first, last = same[kind, s]
            o, c = opens(a, b), closes(a, b)
            loose = kind == "equals" and count > 1
            got = (o and last > a) or (c and first < a) or loose, f"n{min(6, len(s))}|{'opens' if o else ''}{'closes' if c else ''}"
        elif kind == "brace":
            got = opener is not None and depth > 0, "math" if opener in MATH else "text"
        elif kind in ("wiki_open", "wiki_close", "template", "bracket", "url_end", "wiki_url"):
            pair = {"wiki_open": "]]", "wiki_close": "[[", "bracket": "](", "url_end": "[", "wiki_url": "]"}.get(kind) or ("}}" if s.startswith("{{") else "{{")
            got = there[pair], f"{len(s) > 2}"
        elif kind == "fence":
            got = fences > 1, f"lang={len(s) > 3}|{s[:1]}"
        elif kind == "tick":
            got = True, "code"
        out.append(got)
    return out


# ---------------------------------------------------------------- labelled pages

#: Plain sentences for the labelled pages, used beside sentences of the table.
SENTENCES = """The garden was quiet when we came back from the station. | Nobody had asked for the old map, so I kept it in a drawer. | Hoy he visto a mi vecina en el mercado y hablamos un rato.
| Le train est parti avant que nous arrivions sur le quai. | Gestern habe ich den ganzen Tag am Fenster gesessen. | A senhora da loja disse que volta amanhã. | Ieri sera abbiamo mangiato presto e poi siamo usciti.
| Сегодня утром я нашёл старую тетрадь. | 今日は一日中家で本を読んでいました。 | My first attempt took three hours, and the second one only two! | What would you do with a box of letters? | She read the page twice; then she laughed.""".split("|")

_NAMES = "span div p b i u em strong small h1 h2 h3 blockquote font center a li ul sub sup q del ins code td tr".split()
_ENTITIES = "amp nbsp hellip quot lt gt mdash ndash rsquo lsquo eacute copy #39 #8217 #160 #x27 euro times".split()
_FORMULAS = [r"E = mc^2", r"\frac{a}{b} + c", r"x^2 - y^2 = 1", r"\sum_{n=0}^{N} a_n", r"\sqrt{2} \approx 1.41", r"b_{k+1} = 2b_k", r"\int_0^1 f(t) dt", r"v = \frac{d}{t}", r"\alpha + \beta \leq \pi", r"\Delta x = v t"]
_CODES = ["for k in items:", "    total += k", "print(total * rate)", "let x = y * (z + 1);", "if (a < b) { swap(a, b); }", "SELECT name FROM users WHERE id = 7;", "echo hello", "return x ** 2;", "int* p = &q;", "a[i] = b[j] > 0;", "std::vector<int> v;", "x = d / 3", "y = m - 1", "t = 3(k - 1) + 2", "a < 4b + 2"]
_PLAIN = (
    "3 * 4 * 2 m | costs $5 to $9 | $3 -> $7 | <3 | </3 | <3 <3 | x > y | a < b | >_< | ^_^ | =) | (1/2) | 1) 2) 3) | {yes} | [sic] | [1] | F# minor | C# | D&D | R&B | AT&T | #garden | #1 | ~ 3h ~ | 50 % | 100% | +1 | * * * | -- | --- | report_final_v3 | img_2041_edit.png | my_file_name"
    " | the <i> tag is old | why the <em> tag differs from <b> here | an <hr> element and a <p> tag | I typed & and then < by mistake | write <br> as a tag | rated *** of ***** | out of ***** by my friend | * out of ***** | C:\\temp\\new | \\o/ | ¯\\_(ツ)_/¯ | 5 > 3 | 2 < 3 | A -> B | a => b"
    " | it was $12 then $15, so bring money | scan_of_doc_07 | @name | #tag_with_words | 10*2 | (a) (b) | o_O | T_T | :* | *sigh | 4 * 4 | price: $20 | T-shirt: $8 | ... | 'quoted' | l'été | \"x\" | >> | i <3 u | I | II | key of C#m7, F#7 | == | != | a == b"
).split(" | ")


_LEET = str.maketrans("aeiosAEIOS", "4310$4310$")


def _masked(text: str, rng: random.Random) -> str:
    """Words with letters hidden as people hide them: stars for vowels, or digits and signs for letters."""
    return text.translate(_LEET) if rng.random() < 0.5 else re.sub(r"(?<=\w)[aeiou](?=\w)", "*", text, count=rng.randint(1, 3))


def labelled_pages(count: int = PAGES, sentences: list[str] | None = None, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]], list[tuple[tuple[str, ...], str]]]]:
    """(text, marked spans with their kind, (ancestors, label) of each line) of made pages with markup and look-alikes put in."""
    rng = random.Random(seed)
    base = [s.strip() for s in (sentences or [])] + [s.strip() for s in SENTENCES] * 3
    out = []
    for _ in range(count):
        lines: list[tuple[list[tuple[str, str]], tuple[str, ...], str]] = []
        for _ in range(rng.randint(1, 4)):
            s = " ".join(rng.choice(base) for _ in range(rng.randint(1, 3)))
            roll = rng.random()
            if roll < 0.07:
                lines.append(([(" ".join(s.split()[:3]), "")], (f"h{rng.randint(1, 3)}",), "heading"))
            elif roll < 0.14:
                lines += [([(" ".join(rng.choice(base).split()[:4]).rstrip("."), "")], ("ul", "li"), "list") for _ in range(3)]
            elif roll < 0.24:
                pre = ("pre", "code") if rng.random() < 0.7 else ()
                lines += [([(c, "")], pre, "code") for c in rng.sample(_CODES, rng.randint(1, 2))]
            elif roll < 0.32:
                f = rng.choice(_FORMULAS)
                lines.append(([(f, "")], ("pre", "code") if rng.random() < 0.5 else (), "formula"))
            else:
                lines += _marked(s, rng)
        text, spans, info = "", [], []
        for parts, up, label in lines:
            for t, kind in parts:
                if kind:
                    spans.append((len(text), len(text) + len(t), kind))
                text += t
            text += "\n"
            info.append((up, label))
        out.append((text, spans, info))
    return out


def _marked(s: str, rng: random.Random) -> list[tuple[list[tuple[str, str]], tuple[str, ...], str]]:
    """The lines of a paragraph with up to two insertions of markup or of plain characters."""
    words = s.split(" ")
    up = rng.choice([("p",), ("p",), ("div",), ("blockquote", "p"), ("ul", "li"), ("h2",), ()])
    form = "list" if "li" in up else "heading" if up == ("h2",) else "paragraph"
    lines: list[list[tuple[str, str]]] = []
    parts: list[tuple[str, str]] = [(" ".join(words), "")]
    tail: list[list[tuple[str, str]]] = []
    for _ in range(rng.choice([0, 1, 1, 2])):
        k = rng.choice(["html", "html", "markdown", "markdown", "wiki", "wiki", "latex", "latex", "plain", "plain", "plain"])
        a = rng.randrange(len(words))
        b = min(len(words), a + rng.randint(1, 3))
        whole, before, inner, after = " ".join(words), " ".join(words[:a]), " ".join(words[a:b]), " ".join(words[b:])
        sp = " " if before else ""
        url = f"https://site{rng.randint(1, 99)}.example/{rng.choice('abp')}/{rng.randint(1, 9999)}"
        join = lambda o, c, kind: [(before + sp, ""), (o, kind), (inner, ""), (c, kind), (" " + after, "")]
        one = lambda t, kind, gap=" ": [(before + gap, ""), (t, kind), (gap + inner + " " + after, "")]
        if k == "html":
            name = rng.choice(_NAMES)
            attr = rng.choice(["", "", f' class="c{rng.randint(1, 9)}"', ' style="color:red"', f' href="{url}"', f' href="{url}" target=_blank'])
            case = (lambda t: t.upper()) if rng.random() < 0.1 else (lambda t: t)
            new = rng.choice(
                [
                    lambda: join(case(f"<{name}{attr}>"), case(f"</{name}>"), k),
                    lambda: join(case(f"<{name}{attr}>"), case(f"</{name}>"), k),
                    lambda: one(case(rng.choice(["<br>", "<br/>", "<hr>", "<br />", "<wbr>", f'<img src="{url}"/>'])), k, rng.choice(["", " "])),
                    lambda: one(case(f"</{rng.choice(['div', 'span', 'p', 'b', 'blockquote', 'h2', 'li', 'font'])}>"), k, ""),
                    lambda: one(f"<{rng.choice(['div', 'p', 'h2', 'blockquote', 'span'])}{rng.choice(['', attr])}>", k, ""),
                    lambda: one(f"&{rng.choice(_ENTITIES)};", k, rng.choice(["", " "])),
                    lambda: one(f"&{rng.choice(_ENTITIES)};", k, ""),
                    lambda: one(rng.choice(["<!-- more -->", "<!-- x -->", "<!--[if gte mso 9]><![endif]-->", "<!-- end"]), k),
                    lambda: one(f'<img src="{url}.jpg" alt="', k),
                    lambda: [(whole + " ", ""), (f'<img src="{url}.jpg" alt="', k)],
                    lambda: [(f"<{rng.choice(['h2', 'p', 'div'])}>", k), (whole, ""), ("</p>" if rng.random() < 0.5 else "</h2>", k)],
                ]
            )()
        elif k == "markdown":
            m = rng.choice(["**", "__", "***", "~~", "*", "_"])
            code = rng.choice(_CODES).strip()
            new = rng.choice(
                [
                    lambda: join(m, m, k),
                    lambda: join("[", f"]({url})", k),
                    lambda: join("![", f"]({url}.png)", k),
                    lambda: [(f"![{inner}]({url}.png)", k), (" " + whole, "")],
                    lambda: [("#" * rng.randint(1, 5), k), (" " + inner + rng.choice(["", " " + whole]), "")],
                    lambda: [(">", k), (" " + whole, "")],
                    lambda: [(whole + " ", ""), (f"`{code}`", k), (" " + inner, "")],
                    lambda: [(f"`{code}`", k), (" ", ""), (">", k), (" " + whole, "")],
                    lambda: [(rng.choice(["* [ ]", "* [x]", "- [ ]", "- [x]"]), k), (" " + inner, ""), (" ", ""), (rng.choice(["* [ ]", "* [x]"]), k), (" " + after, "")],
                    lambda: [(f"| {inner} | {rng.randint(1, 90)} | ", ""), (rng.choice(["|---|:---:|", "|---|---|", "| --- | --- |"]), k), (f" | {inner} | 3 | {whole}", "")],
                    lambda: [("```" + rng.choice(["", "js", "py", "sql"]), k), (f" {code} ", ""), ("```", k), (" " + whole, "")],
                    lambda: [(rng.choice(["* [ ]", "* [x]", "- [ ]", "- [x]"]), k), (" " + inner, "")],
                ]
            )()
            if rng.random() < 0.15:
                tail.append([("```" + rng.choice(["", "js", "py"]), k)])
                tail.append([(code, "code")])
                tail.append([("```", k)])
            elif rng.random() < 0.1:
                tail += [[(f"| {inner} | 4 |", "")], [("|---|:---:|", k)], [(f"| {inner} | 9 |", "")]]
        elif k == "wiki":
            q = rng.choice(["''", "'''", "'''''"])
            e = "=" * rng.randint(2, 4)
            new = rng.choice(
                [
                    lambda: join(q, q, k),
                    lambda: join("[[", "]]", k),
                    lambda: [(before + sp, ""), (f"[[{inner}|", k), (inner.split(" ")[0], ""), ("]]", k), (" " + after, "")],
                    lambda: [(f"[[File:pic-{rng.randint(1, 99)}.jpg|thumb|", k), (inner, ""), ("]]", k), (" " + whole, "")],
                    lambda: [("{{note|", k), (whole, ""), ("}}", k)],
                    lambda: join("{{" + rng.choice(["lang|fr|", "quote|", "citation needed|"]), "}}", k),
                    lambda: [(e, k), (f" {inner} ", ""), (e, k), (rng.choice(["", " " + whole]), "")],
                    lambda: [(before + sp, ""), (f"[{url}", k), (f" {inner}", ""), ("] " + after, "")],
                    lambda: [('{| class="wikitable"', k), (" ", ""), ("|-", k), (f" | {inner} ", ""), ("||", k), (f" {rng.randint(1, 99)} ", ""), ("|}", k), (" " + whole, "")],
                ]
            )()
            if rng.random() < 0.12:
                tail += [[('{| class="wikitable"', k)], [("|-", k)], [(f"| {inner} ", ""), ("||", k), (" 12", "")], [("|}", k)]]
        elif k == "latex":
            f = rng.choice(_FORMULAS)
            cmd = rng.choice("textbf textit emph underline section subsection paragraph texttt section* subsection* footnote".split())
            new = rng.choice(
                [
                    lambda: join(f"\\{cmd}{{", "}", k),
                    lambda: join(f"\\{cmd}{{", "}", k),
                    lambda: [(whole, ""), (rng.choice(["~", " "]) + f"\\cite{{{rng.choice(['smith', 'moon'])}{rng.randint(1, 99)}}}", k), (" " + inner, "")],
                    lambda: [(whole + " ", ""), ("$", k), (f, k), ("$", k), (rng.choice(["", " " + inner]), "")],
                    lambda: [(whole + " ", ""), ("\\[", k), (f" {f} ", k), ("\\]", k), (" " + inner, "")],
                    lambda: [(whole + " ", ""), ("\\(", k), (f, k), ("\\)", k), (" " + inner, "")],
                    lambda: [("\\begin{itemize}", k), (" ", ""), ("\\item", k), (" " + whole + " ", ""), ("\\end{itemize}", k)],
                    lambda: [("\\item", k), (" " + whole, "")],
                    lambda: [(whole + " ", ""), ("\\begin{equation}", k), (f" {f} ", k), ("\\end{equation}", k)],
                    lambda: one(rng.choice(["\\ldots", "\\LaTeX", "\\newline", "\\today"]), k),
                ]
            )()
            if rng.random() < 0.2:
                tail += [[("\\begin{equation}", k)], [(f, k)], [("\\end{equation}", k)]]
            elif rng.random() < 0.1:
                tail += [[("\\begin{itemize}", k)], [("\\item", k), (" " + inner, "")], [("\\end{itemize}", k)]]
        else:
            p = rng.choice(_PLAIN) if rng.random() < 0.88 else _masked(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))), rng)
            new = rng.choice([lambda: [(whole + " " + p, "")], lambda: [(p + " " + whole, "")], lambda: [(before + sp + p + " " + inner + " " + after, "")], lambda: [(whole + " " + p + " " + inner, "")]])()
            if rng.random() < 0.15:
                new = [(p, "")]
        lines.append(parts) if parts[0][0] != " ".join(words) else None
        parts = new
        words = s.split(" ")
    lines.append(parts)
    got = [(x, up, form) for x in lines if any(t.strip() for t, _ in x)]
    for x in tail:
        t = "".join(y for y, _ in x)
        got.append((([(y, "" if z == "code" else z) for y, z in x]), up, "code" if x[0][1] == "code" else "formula" if t in _FORMULAS else form))
    return got


def _gold(page: tuple, own: list[tuple[int, int, str, list[str]]]) -> list[str]:
    _, spans, info = page
    out, line = [], -1
    for a, b, kind, _ in own:
        if kind == "line":
            line += 1
            out.append(info[line][1])
        else:
            hit = [k for s, e, k in spans if a < e and b > s]
            out.append(hit[0] if hit else "plain")
    return out


def train(sentences: list[str] | None = None, count: int = PAGES) -> LinearChainCRF:
    """The field trained on labelled pages made with ``sentences``."""
    pages = []
    for page in labelled_pages(count, sentences):
        text, _, info = page
        if not text.strip():
            continue
        own = blocks(text)
        lines = [x for x in text.split("\n") if x]
        ups = [i for i, x in zip(info, [y for y in text.split("\n")][: len(info)], strict=False) if x]
        page = (text, page[1], ups)
        own = [(a, b, k, f) for a, b, k, f in own]
        own = _with_ancestors(own, lines, [u for u, _ in ups])
        pages.append(([f for *_, f in own], _gold(page, own)))
    model = LinearChainCRF(LABELS)
    model.fit(pages)
    return model


def _with_ancestors(own: list, lines: list[str], ups: list[tuple[str, ...]]) -> list:
    """``own`` with the features of given ancestors in place of none."""
    out, line = [], -1
    for a, b, kind, f in own:
        if kind == "line":
            line += 1
            up = ups[line]
            near, pre = (up[-1] if up else "none"), ("pre" in up or "code" in up)
            f = [x.replace("up=none", f"up={near}").replace("pre=False", f"pre={pre}") for x in f] + [f"in={x}" for x in set(up)]
        elif ups[line] and ("pre" in ups[line] or "code" in ups[line]):
            f = [x.replace("|pre=False", "|pre=True") for x in f]
        out.append((a, b, kind, f))
    return out


def residue(model: LinearChainCRF, text: str | None, page: str | None = None) -> dict[str, int]:
    """How many pieces of each kind of markup a text holds."""
    out: dict[str, int] = {}
    if not text or not _ANY.search(text) or not any(_PIECE.search(x) for x in re.split(r"[\n\r\u2028]+", text) if _ANY.search(x)):
        return out
    own = blocks(text, page)
    for (_, _, kind, _), label in zip(own, model.decode([f for *_, f in own]), strict=True):
        if kind != "line" and label in KINDS:
            out[label] = out.get(label, 0) + 1
    return out


def clean(model: LinearChainCRF, text: str | None, page: str | None = None) -> tuple[str, list[tuple[str, str]]]:
    """(clean text, (form, line) of its lines): the page's leaves, or the text where there is no page, without markup.

    The form is paragraph, heading, list, code or formula.  Pieces labelled as markup are taken out, those meant as plain text stay.
    A formula that is a line of its own gets the form; one inside a line keeps its dollar signs.  Table cells are set apart by bars.
    """
    source = page if page else text
    if not source:
        return "", []
    if page:
        own_lines = leaves(page)
        text, ups = "\n".join(x.replace("\r", " ") for x, _ in own_lines), [u for _, u in own_lines]
        own = _with_ancestors(blocks(text), [], ups)
    else:
        own = blocks(text)
    labels = model.decode([f for *_, f in own])
    out: list[tuple[str, str]] = []
    ends = [m.end() for m in re.finditer(r"[^\n\r\u2028]+", text)]
    line, at, fenced, bracket, equation, inline = -1, 0, False, False, False, False
    form = own_form = "paragraph"
    held = ""

    def take(end: int) -> None:
        """Adds the text up to ``end``; the bracket that closed a link's text is left out."""
        nonlocal held, at, bracket
        part = text[at:end]
        if bracket and "]" in part:
            part, bracket = part.replace("]", "", 1), False
        held += part
        at = end

    def close() -> None:
        """Ends a line of the result."""
        nonlocal held
        t = held.rstrip() if form == "code" else re.sub(r"\s+", " ", held).strip()
        if t.strip(" |"):
            out.append((form, t))
        held = ""

    for (a, b, kind, _), label in zip(own, labels, strict=True):
        if kind == "line":
            if line >= 0:
                take(ends[line])
                close()
            line += 1
            at, held, bracket, inline = a, "", False, False
            form = own_form = "code" if fenced else "formula" if equation else label
            continue
        piece = text[a:b]
        take(a)
        at = b
        if inline and kind != "dollar":  # a formula in a line is kept as it is
            held += piece
        elif label == "plain":
            held += piece
        elif kind == "entity":
            held += html.unescape(piece)
        elif kind == "tick":
            held += piece.strip("`")
        elif kind == "fence":
            if held.strip():
                close()
            fenced = not fenced
            form = "code" if fenced else own_form if own_form != "code" else "paragraph"
        elif kind in ("hashes", "equals"):
            form = "heading"
        elif kind == "task" or piece.startswith("\\item"):
            form = "list"
        elif kind == "wiki_url":
            bracket = True
            at += text[b : b + 1] == " "
        elif kind == "display" or (kind == "dollar" and not inline and (form == "formula" or not held.strip() or held.rstrip()[-1] in ".!?…。»")) or (kind == "env" and "equation" in piece):
            opens = form != "formula" if kind == "dollar" else piece in ("\\[", "\\(") or piece.startswith("\\begin")
            close()  # a formula stands in a line of its own
            equation = opens and kind != "dollar"
            form = "formula" if opens else own_form if own_form != "formula" else "paragraph"
        elif kind == "dollar":
            held += piece
            inline = not inline
        elif kind == "unders" and label == "latex" or kind == "command" and label == "latex" and re.match(r"\\([a-zA-Z]+)", piece).group(1) in MATH:
            held += piece
        elif kind == "brace" and label == "latex" and ("\\" in held or form == "formula"):
            held += piece if held.count("{") > held.count("}") else ""
        elif kind == "wiki_table" and piece == "||":
            held += "|"
    if line >= 0:
        take(ends[line])
        close()
    return "\n".join(t for _, t in out), out


_fitted: dict[str, LinearChainCRF] = {}


def fitted(spark: SparkSession, sentences: list[str]) -> LinearChainCRF:
    """The field trained with ``sentences``; one that was trained with the same before is read from the shared folder."""
    name = hashlib.md5("\n".join([*sentences, str(PAGES), str(FIELD), *_PIECES.values()]).encode()).hexdigest()
    if name not in _fitted:
        shared, fs = spark.conf.get("spark.checkpoint.dir", None), spark._jvm.org.apache.hadoop.fs
        path = fs.Path(f"{shared}/driftwell-field-{name}.json") if shared else None
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()) if shared else None
        if shared and files.exists(path):
            _fitted[name] = LinearChainCRF.load("".join(r[0] for r in spark.read.text(path.toString(), wholetext=True).collect()).encode())
        else:
            _fitted[name] = train(sentences)
            if shared:
                out = files.create(path, True)
                out.write(bytearray(_fitted[name].dump()))
                out.close()
    return _fitted[name]


def _run(posts: DataFrame, key: str, text: str, page: str, keep: list[str], fn, out: str, sample: int) -> DataFrame:
    spark = posts.sparkSession
    n = posts.count()
    share = max(1, int(sample / max(1, n) * (1 << 20)))
    picked = posts.where((F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share) & F.col(text).isNotNull()).select(F.col(text).alias("t")).limit(2 * sample).collect()
    plain = sorted({s.strip() for r in picked for s in re.split(r"(?<=[.!?。])\s+|\n", r.t) if 20 < len(s) < 160 and not _PIECE.search(s)})
    sent = spark.sparkContext.broadcast(fitted(spark, plain))  # a few thousand features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for pdf in batches:
            got = pdf[[key, *keep]].copy()
            got["_got"] = [fn(model, t if isinstance(t, str) else None, p if isinstance(p, str) else None) for t, p in zip(pdf["_text"], pdf["_page"], strict=True)]
            yield got

    fields = ", ".join(f"`{c}` {posts.schema[c].dataType.simpleString()}" for c in [key, *keep])
    return spread(posts.select(key, *keep, F.col(text).alias("_text"), F.col(page).alias("_page"))).mapInPandas(run, f"{fields}, _got {out}")


def find_residue(posts: DataFrame, key: str, text: str, page: str, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """(key, keep..., kinds): the kinds of markup left in each row's text, an array of (kind, pieces) in the order of KINDS.

    ``page`` is the HTML that the text was made of; it tells what a line's ancestors are and may be null.  Null, empty and blank
    texts have none.  Rows stay as they are; other columns are dropped; an empty table gives an empty result.
    """

    def one(model, t, p):
        got = residue(model, t, p)
        return [{"kind": k, "pieces": got[k]} for k in KINDS if k in got]

    return _run(posts, key, text, page, keep or [], one, "array<struct<kind:string,pieces:long>>", sample).withColumnRenamed("_got", "kinds")


def clean_markup(posts: DataFrame, key: str, text: str, page: str, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """(key, keep..., text, lines): clean text made of each row's page, or of its text where the page is null, and its lines.

    lines is an array of (form, text); form is paragraph, heading, list, code or formula.  Rows without either get an empty text.
    """

    def one(model, t, p):
        flat, own = clean(model, t, p)
        return {"text": flat, "lines": [{"form": a, "text": b} for a, b in own]}

    got = _run(posts, key, text, page, keep or [], one, "struct<text:string,lines:array<struct<form:string,text:string>>>", sample)
    return got.select(key, *(keep or []), F.col("_got.text").alias("text"), F.col("_got.lines").alias("lines"))
