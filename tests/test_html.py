from lucerna.functions.html import _selectors, parse


def tree(source):
    els, nodes, body, doctype = parse(source)
    return els, nodes, body, doctype


def test_implied_tags_and_unclosed_formatting():
    els, nodes, body, _ = tree("<p><b>one<br><p>two<ul><li>a<li>b</ul>")
    tags = [(e.tag, e.depth) for e in els]
    assert tags[:2] == [("html", 0), ("body", 1)]
    assert [e.tag for e in els if e.parent == 1] == ["p", "p", "ul"]
    assert body == "one two a b"
    texts = {e.tag: "".join(t for _, t in nodes[e.n0 : e.n1]) for e in els if e.tag == "b"}
    assert texts == {"b": "one"}


def test_script_text_and_comments_are_not_content():
    els, nodes, body, doctype = tree('<!doctype html><html><head><title>T &amp; U</title><script>var t="</p>";</script></head><body><!-- x --><p hidden>no</p>yes</body></html>')
    assert doctype == "html" and body == "yes"
    assert [t for _, t in nodes] == ["T & U", "no", "yes"]
    assert [e.tag for e in els] == ["html", "head", "title", "script", "body", "p"]


def test_end_tags_never_leave_a_table_cell():
    els, _, _, _ = tree("<div><table><tr><td>a</div>b<td>c</table><i>d</i></div>")
    by = {e.pos: e for e in els}
    cells = [e for e in els if e.tag == "td"]
    assert len(cells) == 2 and {by[c.parent].tag for c in cells} == {"tr"}
    assert by[next(e for e in els if e.tag == "i").parent].tag == "div"


def test_subtree_is_an_interval():
    els, _, _, _ = tree("<div><p>a</p><p>b<i>c</i></p></div><p>d</p>")
    div = next(e for e in els if e.tag == "div")
    assert [e.tag for e in els[div.pos + 1 : div.last + 1]] == ["p", "p", "i"]


def test_selectors():
    els, _, _, _ = tree('<div id="u"><p>a</p><p>b</p></div><div id="d"></div><div id="d"></div>')
    sel = _selectors(els)
    by = {(e.tag, e.nth, e.attrs.get("id")): sel[e.pos] for e in els}
    assert by[("p", 2, None)] == "#u > p:nth-of-type(2)"
    assert by[("div", 2, "d")] == "body > div:nth-of-type(2)"


def test_attributes_first_wins_and_unescape():
    els, _, _, _ = tree("<a HREF='/x?a=1&amp;b=2' href=/y title=t disabled>z</a>")
    a = next(e for e in els if e.tag == "a")
    assert a.attrs == {"href": "/x?a=1&b=2", "title": "t", "disabled": ""}
