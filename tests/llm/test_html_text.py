"""Tag-path ratios against a plain restatement over all pairs of paths."""

import math
import os
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from riskloom.llm import html_text


class Plain(HTMLParser):
    """(path, text) of the blocks of well-formed pages of div, p, h1 and li without links."""

    def __init__(self):
        super().__init__()
        self.path, self.found = [], []

    def handle_starttag(self, tag, attrs):
        self.path.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        if data.strip():
            self.found.append((tuple(self.path), " ".join(data.split())))


def brute(page, threshold):
    p = Plain()
    p.feed(page)
    def ratio(path):
        own = [t for q, t in p.found if q == path]
        return math.sqrt(sum(map(len, own)) / len(own) * (1 + sum(len(re.findall(r"[.,;:!?]", t)) for t in own) / len(own))) if own else 0.0
    total = sum(len(t) for _, t in p.found)
    def mean(box):
        own = [(q, t) for q, t in p.found if q[:len(box)] == box]
        return sum(len(t) * ratio(q) for q, t in own) / max(1, sum(len(t) for _, t in own)) * math.sqrt(sum(len(t) for _, t in own) / total)
    def fused(path):
        boxes = [path[:i] for i in range(1, len(path) + 1) if path[i - 1][0] in ("body", "div", "article")]
        inside = [b for b in boxes if b[-1][0] == "article"]
        s = mean(())
        for b in boxes[:boxes.index(inside[0]) + 1] if inside else boxes:
            s = 0.75 * mean(b) + 0.25 * s
        return (3 if inside else 1) * (0.3 * ratio(path) + 0.7 * s)
    page = sum(len(t) * fused(q) for q, t in p.found) / max(1, total)
    return "\n\n".join(t for q, t in p.found if fused(q) >= threshold * page)


def page(r):
    def text(n, stops):
        return " ".join("word" + ("," if stops and r.random() < 0.2 else "") for _ in range(n)) + ("." if stops else "")
    def inner(depth):
        out = ""
        for _ in range(r.randrange(1, 5)):
            kind = r.randrange(4)
            if kind == 0 and depth < 4:
                out += f'<div class="{r.choice("abc")}">{inner(depth + 1)}</div>'
            elif kind == 1:
                out += f"<li>{text(r.randrange(1, 4), False)}</li>"
            else:
                out += f"<p>{text(r.randrange(2, 60), True)}</p>"
        return out
    main = f"<article><h1>{text(5, False)}</h1>{inner(2)}</article>" if r.random() < 0.5 else f'<div class="text">{inner(1)}</div>'
    return f"<body>{inner(2)}{main}{inner(2)}</body>"


def test_ratios_equal_the_plain_form():
    r, whole, some = random.Random(5), 0, 0
    for _ in range(200):
        x = page(r)
        for threshold in (0.4, 0.7, 1.0):
            assert html_text.main_text(x, threshold) == brute(x, threshold)
        whole += 1
        some += html_text.main_text(x) != html_text.main_text(x, 0)
    assert 0.2 * whole < some


def test_the_threshold_decides_in_articles_too():
    story = "<article><h1>Head</h1>" + "<p>A long sentence, with words, and more of them. Another one, too.</p>" * 3 + "</article>"
    assert html_text.main_text(story).startswith("Head") and html_text.main_text(story, 0.9).startswith("A long") and html_text.main_text(story, 1e9) == ""


def test_nothing_of_the_story_is_dropped():
    p = "<p>A sentence, with words in it. One more, for good measure.</p>"
    story = f"<div class=story><h2>H</h2>{p * 4}<table><tr><td>7</td><td>cell</td></tr></table><pre>x</pre><div class='side effects'>{p}</div><section class='legal news'>{p}</section></div>"
    assert html_text.main_text(f"<body>{story}<div class=more><span>Short</span></div></body>").split("\n\n")[5:8] == ["7", "cell", "x"]
    assert html_text.main_text(f"<body>{story}</body>").count("sentence") == 6


def test_menus_are_told_by_their_path():
    links = "".join(f"<li><a href=/{i}>Section number {i}, all of it</a></li>" for i in range(30))
    body = "<p>Words in a sentence, and <a href=x>a link</a> there. More follows here, too.</p>" * 5
    assert html_text.main_text(f"<div class=x><ul>{links}</ul></div><div class=y>{body}</div>").count("\n\n") == 4


def test_many_classes_and_levels_take_linear_time():
    for x in ("".join(f"<div class=c{i}><p>Some text here, of block {i}.</p></div>" for i in range(20_000)), "<div>x" * 20_000, "<td>" * 5_000 + "<div>" * 20_000 + "x</li>" * 20_000):
        began = time.time()
        html_text.main_text("<body>" + x)
        assert time.time() - began < 2


PROSE = "".join(f"<p>The council met on day {i}, and spoke of the plan at length. It was, as many said, a long day of talk. Nobody left early, although some would have, had they known.</p>" for i in range(6))
TABLE = os.environ.get("HTML_PAGES", "/root/testdata/sf0.01/pages.parquet")


@pytest.mark.parametrize("name", ["share price news", "alert readers", "notice board", "widget factory", "promotion race", "overlay networks", "banner headline"])
def test_names_alone_do_not_drop_prose(name):
    box = f"<div class='{name}'>{PROSE}</div>"
    for x in (box, f"<div class=story>{PROSE}</div>{box}", f"<article><h1>Head line</h1>{PROSE}{box}</article>"):
        assert html_text.main_text(f"<body>{x}</body>").count("council") == x.count("council")


@pytest.mark.parametrize("box", ["div class=k1", "article", "section class='k1 k2'"])
def test_furniture_without_names_goes_by_its_ratio(box):
    end = box.split()[0]
    x = (f"<body><div class=a1><p>We use cookies to improve this site. By staying you agree.</p><button>OK</button></div><{box}><h1>Council meets</h1>{PROSE}</{end}>"
         "<div class=b2><div class=b3><p>Great piece, thanks!</p></div><div class=b3><p>I do not agree with any of it.</p></div></div><div class=c3>&copy; 2024 Example. All rights reserved.</div></body>")
    kept = html_text.main_text(x).split("\n\n")
    assert kept[0] == "Council meets" and len(kept) == 7 and all("council" in t for t in kept[1:])


def test_furniture_inside_an_article_goes():
    x = f"<article><h1>Council meets</h1>{PROSE}<div class=comments><p>Great piece, thanks! I liked it.</p></div><aside><p>More on this, here.</p></aside><p hidden>Not, at all, shown.</p></article>"
    assert len(html_text.main_text(x).split("\n\n")) == 7


@pytest.mark.skipif(not os.path.exists(TABLE), reason="no tables")
def test_classes_renamed_at_random_change_few_blocks():
    pages = [h or "" for h in pq.read_table(TABLE, columns=["html"])["html"].to_pylist()]
    r, same, all_ = random.Random(3), 0, 0
    for h in pages:
        body = re.search(r"<article>(.*?)</article>", h, re.S)
        shown = [t for _, t in html_text.blocks(h)[1]]
        kept = html_text.main_text(h)
        assert kept == "\n\n".join(t for _, t in html_text.blocks(body[1])[1])
        other = html_text.main_text(re.sub(r'class="[^"]*"', lambda m: f'class="x{r.randrange(10**6)}"', h))
        differs = sum(((Counter(kept.split("\n\n")) - Counter(other.split("\n\n"))) + (Counter(other.split("\n\n")) - Counter(kept.split("\n\n")))).values())
        same, all_ = same + len(shown) - differs, all_ + len(shown)
    assert same >= 0.99 * all_


def test_the_threshold_counts_at_once():
    r = random.Random(9)
    pages = [page(r) for _ in range(200)]
    at = {f: [html_text.main_text(x, f * html_text.THRESHOLD) for x in pages] for f in (0.75, 1.0, 1.25)}
    assert all(sum(a != b for a, b in zip(at[f], at[1.0])) > 20 for f in (0.75, 1.25))
