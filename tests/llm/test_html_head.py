"""A head without its end tag."""

import pytest

from terravane.llm import html_extract

HEAD = "<head><meta name=d content='a>b'><title>The title of it</title><script>var a = '<p>not text</p>';</script><style>p {}</style><!-- c -->"
BODY = "<nav><a href=x>home</a></nav><article><h1>T &amp; U</h1><p>One two three four five six seven eight nine ten.</p><p>And so on it goes, for one more sentence.</p></article>"


@pytest.mark.parametrize("start", ["<body>", "<BODY class='x'>", ""])
def test_unclosed_head_keeps_the_article(start):
    whole = html_extract.main_text(f"<html>{HEAD}</head>{start}{BODY}</html>")
    assert "One two three" in whole and "title" not in whole
    assert html_extract.main_text(f"<html>{HEAD}\n{start}{BODY}</html>") == whole


def test_closed_heads_are_no_text():
    odd = "<head><title>x</title><div>not said at all in this head, by any means.</div></head>"
    assert "home" not in html_extract.main_text(f"{HEAD}<script>s = '<body>'</script></head><body>{BODY}") and html_extract.main_text("<head><title>x</title>") == ""
    assert html_extract.main_text(odd) == ""
