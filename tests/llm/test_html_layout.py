"""What is visible on a page, and where the cells of a table and the numbers of a list stand."""

import random

import pytest

from grainfold.llm import html_text


def lines(page):
    return html_text.render(page).lines


STYLED = [
    ("@media print { .x { display: none } }", "seen"), ("@media (max-width: 600px) { .x { display: none } }", "seen"),
    ("@media screen and (min-width: 1px) { .x { display: none } }", "seen"), ("@media screen { .x { display: none } }", ""), ("@media print, all { .x { display: none } }", ""),
    ("@media screen { @media print { .x { display: none } } }", "seen"), ("@supports (display: grid) { .x { display: none } }", "seen"),
    ("@media print { p { color: red } } .x { display: none }", ""), ("@import url('a;b{.css'); .x { display: none }", ""), ("@font-face { src: url(x) } .x { display: none }", ""),
    (".y::before { content: '} .x { display: none }' }", "seen"), ("/* .x { display: none } */", "seen"), (".x { display: none", ""),
    (".x { display: none } .x { display: block }", "seen"), ("#i { display: block } .x { display: none }", "seen"), ("p { display: block } .x { display: none }", ""),
    (".x { display: none !important } #i { display: block }", ""), (".a .x { display: none }", "seen"), (".x { color: red; &:hover { display: none } }", "seen"),
    (".x { display: none; .y { color: red } }", ""), (".x { visibility: hidden }", ""), (".x { visibility: collapse }", ""), ("@layer base { .x { display: none } }", ""),
    ("p#i { DISPLAY : NONE }", ""), (".x { display: none; display: block }", "seen"), (".x{--display:none}", "seen"),
]


@pytest.mark.parametrize("sheet,text", STYLED)
def test_rules_of_style_elements(sheet, text):
    assert "\n".join(lines(f"<style>{sheet}</style><p class=x id=i>seen")) == text


@pytest.mark.parametrize("body,want", [
    ("<div style='visibility:hidden'>a<p style='visibility: visible'>b <i>c</i></p>d</div>e", ["b c", "", "e"]),
    ("<div style='visibility:hidden'><div style='display:none'><p style='visibility:visible'>a</p></div><b style='visibility:visible'>b</b></div>", ["b"]),
    ("<p hidden>a</p><p hidden style='display:block'>b</p><p style='display:none;display:block'>c</p>", ["b", "", "c"]),
    ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", ["- b"]),
    ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>", [" | b"]),
])
def test_visibility_is_inherited_and_can_be_taken_back(body, want):
    assert lines(body) == want


@pytest.mark.parametrize("body,want", [
    ("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>", ["A | b1", "  | b2"]),
    ("<table><tr><td>x<td rowspan=0>A<tr><td>y<tr><td>z<td>w</table>", ["x | A", "y", "z |   | w"]),
    ("<table><tbody><tr><td rowspan=5>A<td>b<tbody><tr><td>c<td>d</table>", ["A | b", "c | d"]),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", ["wide  | z", "a | b | c"]),
    ("<table><tr><td><ul><li>a<li>bb</ul><td>c<tr><td>dddd<td>e</table>", ["- a  | c", "- bb |", "dddd | e"]),
    ("<table><tr><td><table><tr><td>a<td>b<tr><td>cc<td>d</table><td>e</table>", ["a  | b | e", "cc | d |"]),
    ("<table><tr><td>日本<td>a<tr><td>abcde<td>b<tr><td>e\u0301<td>c</table>", ["日本  | a", "abcde | b", "e\u0301     | c"]),
    ("<ol><li>a<li value=7>b<li>c</ol>", ["1. a", "2. b", "3. c"][:1] + ["7. b", "8. c"]),
    ("<ol reversed><li>a<li>b<li value=9>c<li>d</ol>", ["4. a", "3. b", "9. c", "8. d"]), ("<ol reversed start=2><li>a<li>b</ol>", ["2. a", "1. b"]),
    ("<ol start=x><li value=y>a</ol><ul><li value=4>b</ul>", ["1. a", "", "- b"]),
])
def test_cells_and_numbers(body, want):
    assert lines(body) == want


def test_long_cells_go_on_in_the_next_line_and_keep_the_columns():
    words = " ".join(f"word{i}" for i in range(40))
    out = lines(f"<table><tr><td>{words}<td>b<td>{words}<tr><td>c<td>d<td>e</table>")
    assert " ".join(x.split(" | ")[0].strip(" |") for x in out[:-1]) == words
    bars = {x.index(" | ") for x in out if " | " in x}
    assert len(bars) == 1 and bars.pop() <= html_text.CELL_WIDTH and out[0].endswith("word39") and out[-1].split() == ["c", "|", "d", "|", "e"]


@pytest.mark.parametrize("seed", range(12))
def test_random_tables_have_their_cells_in_the_columns_of_the_grid(seed):
    """The grid is filled square by square here; on the page, cells that begin in one column begin at one place."""
    r = random.Random(seed)
    taken, page, first = set(), "<table>", {}
    for y in range(r.randint(2, 7)):
        page += "<tr>"
        x = 0
        for c in range(r.randint(1, 5)):
            while (x, y) in taken:
                x += 1
            wide, high = r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 2, 3])
            while any((x + i, y) in taken for i in range(wide)):  # cells that would cover others are left out here
                wide -= 1
            name = f"c{y}x{c}" + "z" * r.randint(0, 6)
            page += f"<td colspan={wide} rowspan={high}>{name}"
            first[name] = (x, y)
            taken |= {(x + i, y + j) for i in range(wide) for j in range(high)}
            x += wide
    out = lines(page + "</table>")
    found = {name: next((at, line.index(name)) for at, line in enumerate(out) if name in line.split()) for name in first}
    rows = sorted({y for _, y in first.values()})
    assert {name: at for name, (at, _) in found.items()} == {name: rows.index(y) for name, (_, y) in first.items()}
    offsets = {}
    for name, (x, _) in first.items():
        offsets.setdefault(x, set()).add(found[name][1])
    assert all(len(v) == 1 for v in offsets.values())
    assert [*sorted(offsets)] == sorted(offsets, key=lambda x: min(offsets[x]))
