"""Markup residue: parse leftovers of four languages, select content by composite text density, write clean text.

Method. A text is parsed into a DOM: HTML elements nest, and constructs of wiki, Markdown and LaTeX become nodes of the same
tree. Every node has its composite text density (characters per tag, adjusted by the share of link characters); the densities
of a node's children are summed, and the subtree with the greatest sum is the content. The least density on the path from the body to it
is the threshold: blocks below it that are mostly links are menus and go, everything else stays. What the
parser consumed says which languages a text holds.

Kept: headings as lines that begin with a section sign, paragraphs, list items with a bullet, table cells divided by tabs, code
indented by four blanks, captions, the text that templates wrap, formulas in plain notation (brackets around what was grouped, rows of a matrix
divided by semicolons, commands without a plain sign as TeX). Ordinary signs in prose (a < b, $12, [sic], 3 * 5, names_with_lines)
are no constructs, as every construct needs its closing part or its place in the line.

Scale. One map over the texts, whole texts always; no shuffle but the distinct of the found kinds.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from amphora.session import spread

_TAGS = set(
    "a abbr article aside b big blockquote body br button caption center cite code dd del div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li "
    "link main mark meta nav ol p pre q s samp script section small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var".split()
)
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_BLOCK = {"p", "div", "ul", "ol", "li", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "nav", "aside", "header", "footer", "blockquote", "pre", "dl", "dt", "dd", "figure", "body", "main", "form"}
_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*)\s*(/?)>", re.DOTALL)
# fixed values: signs of TeX commands; commands that only set the look; templates that wrap no text of the article; options of pictures
_SIGNS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "omega": "ω",
    "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "times": "×", "cdot": "·", "div": "÷", "pm": "±", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "equiv": "≡", "sum": "Σ",
    "prod": "∏", "int": "∫", "infty": "∞", "to": "→", "rightarrow": "→", "in": "∈", "partial": "∂", "ldots": "…", "dots": "…", "quad": " ", "left": "", "right": "", "displaystyle": "",
}
_LOOKS = r"\\(?:mathbf|mathrm|mathit|mathsf|mathcal|mathbb|boldsymbol|text|textrm|textbf|operatorname|vec|hat|bar|overline)\{([^{}]*)\}"
_ASIDE = ("cite", "citation", "ref", "sfn", "efn", "cn", "fact", "main", "see also", "short description", "use ", "coord", "commons", "clear", "navbox", "stub", "dead link", "clarify", "notelist", "portal", "webarchive")
_PICTURE = re.compile(r"thumb|thumbnail|frame|frameless|border|left|right|center|centre|none|upright.*|\d*x?\d+px|(?:alt|link|page|class|lang)=.*|mini|vignette|miniatura", re.IGNORECASE)


class Node:
    """An element: name, children (nodes or strings), and the counts its density is made of."""

    __slots__ = ("chars", "density", "kids", "link_chars", "link_tags", "name", "tags")

    def __init__(self, name: str) -> None:
        self.name, self.kids = name, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


class _Parser:
    def __init__(self, text: str) -> None:
        self.kinds: set[str] = set()
        self.held: list[str] = []
        self.text = text

    def hold(self, content: str) -> str:
        """Put finished text (code, formulas) out of reach of the later rules."""
        self.held.append(content)
        return f"\ue000{len(self.held) - 1}\ue001"

    def sub(self, kind: str, pattern: str, repl, flags: int = 0) -> None:
        def use(m: re.Match) -> str:
            out = repl(m) if callable(repl) else m.expand(repl)
            if out is None:
                return m.group()
            self.kinds.add(kind)
            return out

        self.text = re.sub(pattern, use, self.text, flags=flags)

    # -- the languages, outermost first --

    def code(self) -> None:
        block = lambda c: "\n" + self.hold("\n".join("    " + x for x in html.unescape(c).strip("\n").split("\n"))) + "\n"
        self.sub("markdown", r"^(`{3,}|~{3,})[^\n`]*\n(.*?)^\1[ \t]*$", lambda m: block(m[2]), re.M | re.S)
        self.sub("latex", r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", lambda m: block(m[2]), re.S)
        self.sub("html", r"<pre(?:\s[^<>]*)?>\s*(?:<code(?:\s[^<>]*)?>)?(.*?)(?:</code>\s*)?</pre>", lambda m: block(m[1]), re.S | re.I)
        self.sub("wiki", r"<nowiki>(.*?)</nowiki>", lambda m: self.hold(m[1]), re.S)
        self.sub("html", r"<code(?:\s[^<>]*)?>(.*?)</code>", lambda m: self.hold(html.unescape(m[1])), re.S | re.I)
        self.sub("markdown", r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)", lambda m: self.hold(m[2]))

    def formula(self, tex: str) -> str:
        group = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
        bare = lambda x: x if re.fullmatch(r"\w|\d+", x) else f"({x})"
        rows = lambda m: "[" + "; ".join(", ".join(c.strip() for c in r.split("&")) for r in m[2].split("\\\\") if r.strip()) + "]"
        for _ in range(3):  # groups nest
            tex = re.sub(_LOOKS, r"\1", tex)
            tex = re.sub(r"\\frac" + group + group, lambda m: f"{bare(m[1])} / {bare(m[2])}", tex)
            tex = re.sub(r"\\sqrt" + group, r"√(\1)", tex)
        tex = re.sub(r"\\begin\{([a-z]*matrix|array|cases)\}(?:\{[^{}]*\})?(.*?)\\end\{\1\}", rows, tex, flags=re.S)
        for _ in range(3):
            tex = re.sub(r"([\^_])\{([^{}]*)\}", lambda m: m[1] + bare(m[2]), tex)
        tex = re.sub(r"\\([a-zA-Z]+)", lambda m: _SIGNS.get(m[1], m[0]), tex)
        tex = tex.replace("\\,", " ").replace("\\;", " ").replace("\\!", "").replace("\\\\", "; ").replace("&", "")
        return self.hold(tex.strip() if re.search(r"\\[a-zA-Z]+\{", tex) else re.sub(r"[{}]", "", tex).strip())

    def latex(self) -> None:
        self.sub("latex", r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", lambda m: self.formula(m[1] or m[2] or m[3]), re.S)
        self.sub("latex", r"(?<![\\$\w])\$(?!\s)([^$\n]*(?:\\[a-zA-Z]|[\^_]\{?\w|[a-zA-Z]\s?[=<>+])[^$\n]*?)(?<!\s)\$(?![\d$])", lambda m: self.formula(m[1]))
        self.sub("latex", r"\\begin\{(equation|align|displaymath)\*?\}(.*?)\\end\{\1\*?\}", lambda m: self.formula(re.sub(r"\\label\{[^{}]*\}", "", m[2])), re.S)
        self.sub("latex", r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", lambda m: "\n" + "\n".join(re.sub(r"\s*&\s*", "\t", x).strip() for x in m[1].replace("\\hline", "").split("\\\\")) + "\n", re.S)
        self.sub("latex", r"^[ \t]*\\(?:begin|end)\{[a-zA-Z*]+\}(?:\[[^\]\n]*\])?[ \t]*\n?", "", re.M)
        self.sub("latex", r"\\(?:begin|end)\{[a-zA-Z*]+\}", "")
        self.sub("latex", r"^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", "• ", re.M)
        self.sub("latex", r"\\(?:sub)*(?:section|paragraph|chapter)\*?\{([^{}]*)\}", r"\n§ \1\n")
        self.sub("latex", r"[~ ]?\\(?:cite[a-z]*|ref|label|pageref|index)(?:\[[^\]]*\])?\{[^{}]*\}", "")
        self.sub("latex", r"\\footnote\{((?:[^{}]|\{[^{}]*\})*)\}~?", r" (\1)")
        for _ in range(3):
            self.sub("latex", r"\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1")
        if "latex" in self.kinds:
            self.sub("latex", r"\\([%&#$_])", r"\1")
            self.sub("latex", r"\\(?:bf|it|em|LaTeX|noindent|par|newline|maketitle)\b\s?", "")

    def wiki(self) -> None:
        self.sub("wiki", r"<ref[^<>]*/>|<ref[^<>]*>.*?</ref>", "", re.S)
        self.sub("wiki", r"^\{\|.*?^\|\}", lambda m: "\n" + self.table(m[0]) + "\n", re.M | re.S)
        for _ in range(4):  # templates nest
            self.sub("wiki", r"\{\{([^{}]*)\}\}", lambda m: self.template(m[1]))
        self.sub("wiki", r"\[\[(?:File|Image|Category|Datei|Fichier|Immagine|Kategorie|Catégorie):([^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*)\]\]\n?", lambda m: self.caption(m[0], m[1]), re.I)
        self.sub("wiki", r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1")
        self.sub("wiki", r"\[https?://\S+ ([^\[\]\n]+)\]", r"\1")
        self.sub("wiki", r"^(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", r"§ \2", re.M)
        self.sub("wiki", r"'{5}(.+?)'{5}|'''(.+?)'''|(?<!')''(?!')(.+?)(?<!')''(?!')", lambda m: m[1] or m[2] or m[3])
        self.sub("wiki", r"^(?:[*#] ?\S[^\n]*\n){1,}[*#] ?\S[^\n]*$", lambda m: re.sub(r"(?m)^[*#] ?", "• ", m[0]), re.M)
        self.sub("wiki", r"^__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__\n?", "", re.M)

    @staticmethod
    def template(inner: str) -> str:
        """Rows of an infobox, the text that another template wraps (what has no name, the last part; all parts of a measure), nothing of notes."""
        name, *args = [x.strip() for x in inner.split("|")]
        name = name.lower()
        if name.startswith("infobox"):
            return "\n".join(re.sub(r"\s*=\s*", "\t", a, count=1) for a in args if "=" in a)
        plain = [a for a in args if a and not re.match(r"[\w -]+=", a)]
        if not plain or any(name == x.strip() or name.startswith(x + ("" if x.endswith(" ") else " ")) for x in _ASIDE) or name.startswith(("cite", "sfn", "efn")):
            return ""
        return " ".join(plain[:2]) if name in ("convert", "cvt") else plain[0] if "quote" in name else plain[-1]

    @staticmethod
    def caption(whole: str, inner: str) -> str:
        """The caption of a picture as a line of its own; nothing of a category."""
        if re.match(r"\[\[(?:Category|Kategorie|Catégorie|Categoria):", whole, re.I) or "|" not in inner:
            return ""
        last = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1", inner)
        last = last.split("|")[-1].strip()
        return "" if _PICTURE.fullmatch(last) else last + "\n"

    @staticmethod
    def table(src: str) -> str:
        out = []
        for row in re.split(r"^\|-.*$", re.sub(r"^\{\|.*$|^\|\}$|^\|\+", "", src, flags=re.M), flags=re.M):
            cells = [re.sub(r"^[^\[\]|]*\|(?!\|)", "", c).strip() for line in row.strip().split("\n") if line[:1] in "|!" and line for c in re.split(r"\|\||!!", line[1:])]
            if cells:
                out.append("\t".join(cells))
        return "\n".join(out)

    def markdown(self) -> None:
        self.sub("markdown", r"^\|.*\|[ \t]*\n\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*\n(?:\|.*\|[ \t]*(?:\n|\Z))*", lambda m: "\n".join("\t".join(c.strip() for c in x.strip().strip("|").split("|")) for x in m[0].strip().split("\n") if not re.fullmatch(r"[|:\- \t]+", x)) + "\n", re.M)
        self.sub("markdown", r"!\[([^\[\]\n]*)\]\([^()\s]+(?: \"[^\"\n]*\")?\)", r"\1")
        self.sub("markdown", r"(?<!\w)\[([^\[\]\n]+)\]\((?=[^()\s]*[./#])[^()\s]+(?: \"[^\"\n]*\")?\)", r"\1")
        targets = {m[1].lower() for m in re.finditer(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]+\S*[./#]\S*.*$", self.text, re.M)}
        if targets:
            self.sub("markdown", r"!?\[([^\[\]\n]+)\] ?\[([^\[\]\n]*)\]", lambda m: m[1] if (m[2] or m[1]).lower() in targets else None)
            self.sub("markdown", r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]+\S*[./#]\S*.*\n?", "", re.M)
        self.sub("markdown", r"^#{1,6}[ \t]+(\S[^\n]*?)[ \t#]*$", r"§ \1", re.M)
        self.sub("markdown", r"(?:(?<=\n\n)|\A)([^\s|>#*+-][^\n|]*)\n(?:={3,}|-{3,})[ \t]*$", r"§ \1", re.M)
        self.sub("markdown", r"^(?:>[ \t]?)+(?=\S)", "", re.M)
        self.sub("markdown", r"^(?:[ \t]*[-*+] +\S[^\n]*\n)+[ \t]*[-*+] +\S[^\n]*$", lambda m: re.sub(r"(?m)^([ \t]*)[-*+] +", r"\1• ", m[0]), re.M)
        self.sub("markdown", r"(?<![\w*])\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*(?![\w*])|(?<!\w)__(?=\S)([^_\n]+?)(?<=\S)__(?!\w)", lambda m: m[1] or m[2])
        self.sub("markdown", r"(?<![\w*])\*(?=[^\W\d_])([^*\n]+?)(?<=[\w.,;!?])\*(?![\w*])", r"\1")
        self.sub("markdown", r"~~(?=\S)([^~\n]+?)~~", r"\1")

    def dom(self) -> Node:
        body, at = Node("body"), 0
        stack = [body]
        for m in _TAG.finditer(self.text):
            name = (m[2] or "").lower()
            if name and name not in _TAGS:
                continue
            self.kinds.add("html")
            stack[-1].kids.append(self.text[at : m.start()])
            at = m.end()
            if not name:
                continue
            if m[1]:
                if name in [n.name for n in stack[1:]]:
                    while stack.pop().name != name:
                        pass
            else:
                node = Node(name)
                stack[-1].kids.append(node)
                if name not in _VOID and not m[4]:
                    stack.append(node)
        stack[0 if len(stack) == 1 else -1].kids.append(self.text[at:])
        return body

    def entities(self) -> None:
        self.sub("html", r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});", lambda m: None if (c := html.unescape(m[0])) == m[0] else self.hold(" " if c == "\xa0" else c))


def weigh(node: Node, in_link: bool = False) -> None:
    """Fill in the counts from the leaves up."""
    link = in_link or node.name == "a"
    for k in node.kids:
        if isinstance(k, str):
            n = len(k) - k.count(" ") - k.count("\n")
            node.chars += n
            node.link_chars += n * link
        else:
            weigh(k, link)
            node.chars += k.chars
            node.link_chars += k.link_chars
            node.tags += k.tags + 1
            node.link_tags += k.link_tags + (k.name == "a")


def composite_density(node: Node, body: Node) -> float:
    """Characters per tag, damped by the base of a logarithm that grows with the share of link characters."""
    if not node.chars:
        return 0.0
    t, lc, lt = max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    plain = max(node.chars - node.link_chars, 1)
    base = math.log(node.chars * node.link_chars / plain + body.link_chars * node.chars / max(body.chars, 1) + math.e)
    damping = math.log(max(node.chars / lc * t / lt, 1.0)) / max(math.log(base), 1.0) if node.link_chars else 1.0
    return node.chars / t * damping


def content(body: Node) -> tuple[Node, float]:
    """(the node whose children's densities have the greatest sum, the least density on the path to it)."""
    weigh(body)
    best: tuple[float, Node, float] = (-1.0, body, 0.0)
    stack = [(body, composite_density(body, body))]
    while stack:
        node, least = stack.pop()
        node.density = composite_density(node, body)
        least = min(least, node.density)
        kids = [k for k in node.kids if isinstance(k, Node)]
        # a run of bare text is a child of its own
        total = sum(composite_density(k, body) for k in kids) + sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if total > best[0]:
            best = (total, node, least)
        stack += [(k, least) for k in kids if k.name in _BLOCK]
    return best[1], best[2]


def render(node: Node, least: float, body: Node | None = None) -> str:
    """The text of a subtree, without the menus: blocks of links less dense than the path to the content."""
    body, out = body or node, []
    for k in node.kids:
        if isinstance(k, str):
            out.append(k)
            continue
        if k.name in ("script", "style", "head"):
            continue
        menu = k.name in ("nav", "div", "ul", "aside", "footer", "header") and k.link_chars * 2 > k.chars and k.link_tags > 2 and composite_density(k, body or node) < least
        if menu:
            continue
        inner = render(k, least, body)
        if k.name == "br":
            out.append("\n")
        elif k.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out.append("\n§ " + inner.strip() + "\n")
        elif k.name in ("sup", "sub") and inner.strip():
            inner = inner.strip()
            out.append(("^" if k.name == "sup" else "_") + (inner if re.fullmatch(r"\w|\d+", inner) else f"({inner})"))
        elif k.name == "li":
            out.append("\n• " + inner.strip() + "\n")
        elif k.name in ("td", "th"):
            out.append(inner.strip() + "\t")
        elif k.name == "tr":
            out.append("\n" + inner.strip("\t\n ") + "\n")
        elif k.name in _BLOCK:
            out.append("\n" + inner + "\n")
        else:
            out.append(inner)
    return "".join(out)


def clean_markup(text: str) -> tuple[str, list[str]]:
    """(clean text, sorted languages found)."""
    if not any(c in text for c in "<&{[\\$*_`#=|'>~-+"):
        return text.strip(), []
    p = _Parser(text.replace("\ue000", "").replace("\ue001", ""))
    p.code()
    p.latex()
    p.wiki()
    p.markdown()
    p.entities()
    body = p.dom()
    out = render(body, content(body)[1])
    while "\ue000" in out:  # held text may hold held text
        out = re.sub("\ue000(\\d+)\ue001", lambda m: p.held[int(m[1])], out)
    out = re.sub(r"[ \t]+\n", "\n", out)
    out = re.sub(r"\n[ \t]*(\n[ \t]*)+(?=\n)", "\n", out) if "\n\n\n" in out else out
    return re.sub(r"\n{3,}", "\n\n", out).strip("\n "), sorted(p.kinds)


def _map(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean_markup(t) if t is not None else (None, []) for t in batch.column(1).to_pylist()]
            if columns == 2:
                pairs = [(i, k) for i, (_, kinds) in zip(batch.column(0).to_pylist(), done, strict=True) for k in kinds]
                yield pa.RecordBatch.from_pydict({"pageid": pa.array([i for i, _ in pairs], pa.int64()), "kind": pa.array([k for _, k in pairs], pa.string())})
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([c for c, _ in done], pa.string()), pa.array([",".join(k) for _, k in done], pa.string())],
                    names=["pageid", "fetched_at", "clean", "kinds"],
                )

    return run


def found_kinds(corpus: DataFrame) -> DataFrame:
    """(pageid, kind): html, markdown, wiki or latex for articles that hold its syntax.

    Null and blank texts hold none; copies of an article give one row; a null pageid is left out.
    """
    texts = spread(corpus.where("pageid is not null and text is not null").select("pageid", "text"))
    return texts.mapInArrow(_map(2), "pageid bigint, kind string").distinct()


def clean_corpus(corpus: DataFrame) -> DataFrame:
    """(pageid, fetched_at, clean, kinds): every row's clean text; a null text stays null."""
    rows = spread(corpus.select("pageid", "text", "fetched_at"))
    schema = rows.select("pageid", "fetched_at").schema.add("clean", "string").add("kinds", "string")
    return rows.mapInArrow(_map(4), schema)
