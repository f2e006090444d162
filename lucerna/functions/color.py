"""Colour arithmetic as pure column expressions."""

from __future__ import annotations


def channel(css: str, i: int) -> str:
    """One channel of an ``rgb()/rgba()`` string as a double, NULL when it is not one."""
    return f"try_cast(trim(get(split(regexp_extract({css}, r'rgba?\\(([^)]+)\\)', 1), ','), {i})) as double)"


def _linear(v: str) -> str:
    return f"if({v}/255D <= 0.03928D, {v}/255D/12.92D, pow(({v}/255D + 0.055D)/1.055D, 2.4D))"


def luminance(r: str, g: str, b: str) -> str:
    return f"(0.2126D*{_linear(r)} + 0.7152D*{_linear(g)} + 0.0722D*{_linear(b)})"


def ratio_of(l1: str, l2: str) -> str:
    return f"(floor((greatest({l1},{l2}) + 0.05D)/(least({l1},{l2}) + 0.05D)*100D + 0.5D)/100D)"


def contrast(fg: str, bg: str) -> str:
    """WCAG contrast of two css colours, two decimals, NULL when either is unreadable."""
    l1 = luminance(*(channel(fg, i) for i in range(3)))
    l2 = luminance(*(channel(bg, i) for i in range(3)))
    return ratio_of(l1, l2)


def spread(css: str) -> str:
    """Largest minus smallest channel: how saturated a colour is."""
    c = [channel(css, i) for i in range(3)]
    return f"(greatest({','.join(c)}) - least({','.join(c)}))"
