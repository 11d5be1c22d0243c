"""Articles written from a structure into each language come back as that structure: the gold texts know no pattern of the parser."""

import random

import pytest

from amphora.llm.markup import clean_markup

WORDS = "road stone river toll bridge market winter harvest copper wool ditch keeper village summer gate mill".split()


def structure(rng):
    say = lambda n: " ".join(rng.choices(WORDS, k=n)).capitalize() + "."
    return {
        "head": [say(2)[:-1], say(3)[:-1]], "text": [say(rng.randrange(12, 30)) for _ in range(3)], "list": [say(3) for _ in range(3)], "table": [[rng.choice(WORDS), str(rng.randrange(99))] for _ in range(2)],
        "code": f"total = {rng.randrange(9)} * {rng.randrange(9)}", "power": rng.randrange(10, 99), "link": rng.choice(WORDS),
    }


def gold(s):
    table = ["\t".join(r) for r in s["table"]]
    return [f"§ {s['head'][0]}", s["text"][0], *(f"• {x}" for x in s["list"]), f"§ {s['head'][1]}", *table, f"    {s['code']}", s["text"][1], f"By the {s['link']} a^{s['power']} = b_1", s["text"][2]]


def write(s, language):
    t, power = s["text"], s["power"]
    if language == "html":
        items, rows = "".join(f"<li>{x}</li>" for x in s["list"]), "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in s["table"])
        return (
            f"<h2>{s['head'][0]}</h2><p>{t[0]}</p><ul>{items}</ul><h3>{s['head'][1]}</h3><table>{rows}</table><pre><code>{s['code']}</code></pre><p>{t[1]}</p>"
            f"<p>By the <a href='x.html'>{s['link']}</a> a<sup>{power}</sup> = b<sub>1</sub></p><p><b>{t[2]}</b></p>"
        )
    if language == "markdown":
        rows = "\n".join("| " + " | ".join(r) + " |" for r in (s["table"][0], ["---", "---"], *s["table"][1:]))
        return "\n\n".join([f"{s['head'][0]}\n-----", t[0], "\n".join(f"- {x}" for x in s["list"]), f"## {s['head'][1]}", rows, f"```\n{s['code']}\n```", t[1], f"By the [{s['link']}](pages/x.html) $a^{{{power}}} = b_{{1}}$", f"**{t[2]}**"])
    if language == "wiki":
        rows = "\n|-\n".join("| " + " || ".join(r) for r in s["table"])
        return "\n\n".join([f"== {s['head'][0]} ==", t[0], "\n".join(f"* {x}" for x in s["list"]), f"=== {s['head'][1]} ===", f'{{| class="x"\n|-\n{rows}\n|}}', f"<pre>{s['code']}</pre>", t[1], f"By the [[Page|{s['link']}]] a<sup>{power}</sup> = b<sub>1</sub>", f"'''{t[2]}'''"])
    rows = " \\\\\n".join(" & ".join(r) for r in s["table"])
    return "\n\n".join([
        f"\\section{{{s['head'][0]}}}", t[0], "\\begin{itemize}\n" + "\n".join(f"\\item {x}" for x in s["list"]) + "\n\\end{itemize}", f"\\subsection*{{{s['head'][1]}}}", f"\\begin{{tabular}}{{ll}}\n{rows}\n\\end{{tabular}}",
        f"\\begin{{verbatim}}\n{s['code']}\n\\end{{verbatim}}", t[1], f"By the \\emph{{{s['link']}}} $a^{{{power}}} = b_{{1}}$", f"\\textbf{{{t[2]}}}",
    ])


@pytest.mark.parametrize("language", ["html", "markdown", "wiki", "latex"])
def test_structure_comes_back(language):
    rng = random.Random(language)
    for _ in range(40):
        s = structure(rng)
        clean, kinds = clean_markup(write(s, language))
        assert language in kinds
        assert [x.rstrip() for x in clean.split("\n") if x.strip()] == gold(s)
