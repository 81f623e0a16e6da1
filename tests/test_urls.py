"""URLs against published forms of the standard, and relative links."""

import pytest

from rollcall.functions.standard_urls import canonical, parsed

FORMS = [
    ("HTTP://EXAMPLE.com", "http://example.com/"),
    ("https://example.com:443/a/", "https://example.com/a"),
    ("http://example.com:8080//a//b/", "http://example.com:8080/a/b"),
    ("http://user:pa@ss@example.com./x#top", "http://example.com/x"),
    ("  http://ex\nample.com/\tb  ", "http://example.com/b"),
    ("http:\\\\example.com\\a\\b", "http://example.com/a/b"),
    ("http:example.com/a", "http://example.com/a"),
    ("http:////example.com/a", "http://example.com/a"),
    ("http://example.com/a/./b/../c/%2e%2E/d", "http://example.com/a/d"),
    ("http://example.com/../..", "http://example.com/"),
    ("http://bücher.example/straße ü?q=ä ö+x&b", "http://xn--bcher-kva.example/stra%C3%9Fe%20%C3%BC?b=&q=%C3%A4+%C3%B6+x"),
    ("http://FAẞ.de", "http://xn--fa-hia.de/"),
    ("http://日本語。ＪＰ/", "http://xn--wgv71a119e.jp/"),
    ("http://ex%41mple.com/%zz%41", "http://example.com/%zz%41"),
    ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://192.168.257", "http://192.168.1.1/"),
    ("http://0300.168.0xF0", "http://192.168.0.240/"),
    ("http://4294967295", "http://255.255.255.255/"),
    ("http://4294967296", None),
    ("http://1.2.3.4.5", None),
    ("http://256.1.1.1", None),
    ("http://[2001:DB8:0:0:0::1]:80/", "http://[2001:db8::1]/"),
    ("http://[::1", None),
    ("http://a b/", None),
    ("http://a%00b/", None),
    ("http://a^b", None),
    ("http://example.com:99999", None),
    ("http://example.com:8a", None),
    ("http://", None),
    ("ftp://example.com/", None),
    ("mailto:a@b.org", None),
    ("example.com/a", None),
    ("", None),
    ("http://x.org/?utm_source=1&B=2&a=3&b=1&a=%31~*-._", "http://x.org/?B=2&a=3&a=1%7E*-._&b=1"),
    ("http://x.org/?", "http://x.org/"),
    ("http://x.org/a\"<>`{}^b", "http://x.org/a%22%3C%3E%60%7B%7D%5Eb"),
]
BASE = "http://h.org:81/a/b/c?q=1#f"
LINKS = [
    ("d", "http://h.org:81/a/b/d"),
    ("../d?x", "http://h.org:81/a/d?x="),
    ("../../../..", "http://h.org:81/"),
    ("./", "http://h.org:81/a/b"),
    ("/x/.", "http://h.org:81/x"),
    ("?y=2", "http://h.org:81/a/b/c?y=2"),
    ("#z", "http://h.org:81/a/b/c?q=1"),
    ("", "http://h.org:81/a/b/c?q=1"),
    ("//O.org/p", "http://o.org/p"),
    ("\\\\o.org\\p", "http://o.org/p"),
    ("https://s.org", "https://s.org/"),
    ("http:e", "http://h.org:81/a/b/e"),
    ("http:/e", "http://h.org:81/e"),
    ("https:e", "https://e/"),
    ("a:b", None),
    ("é", "http://h.org:81/a/b/%C3%A9"),
]


@pytest.mark.parametrize("raw, want", FORMS)
def test_forms(raw, want):
    assert canonical(raw) == want


@pytest.mark.parametrize("raw, want", LINKS)
def test_links(raw, want):
    assert canonical(raw, BASE) == want


@pytest.mark.parametrize("raw, want", [f for f in FORMS if f[1]])
def test_canonical_forms_stay(raw, want):
    assert canonical(want) == want and parsed(want) is not None
