"""Wrappers take up all parts of all pages."""

from glyphlake.llm import html


def test_long_wrappers_take_up_further_parts():
    long = [x for k in range(10_500) for x in ([html.START, f"b{k}", 0], [html.END])]
    other = [[html.START, "aside", 0], [html.SLOT, "#", 0, [7], 5, 5, 4, 0, 2, []], [html.END]]
    out = html._aligned(long, other)
    assert [html.START, "aside", html.OPTIONAL] in out and len(out) == len(long) + len(other)
