"""A long article keeps the parts that a short one keeps."""

import pytest

from lexigrove.llm import html_extract

PARTS = ["<ul><li>first item<li>second item</ul>", "<table><tr><td>cell</table>", "<blockquote>quoted</blockquote>", "<pre>x = 1</pre>", "<figure><figcaption>caption</figcaption></figure>", "<h3>subheading</h3>", "<p>Short end.</p>", "<section><p>Small section, with text.</p></section>"]
WORDS = ["first item", "second item", "cell", "quoted", "x = 1", "caption", "subheading", "Short end.", "Small section, with text."]


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("paragraphs", [2, 200])
def test_parts_stay(tag, paragraphs):
    body = "".join(f"<p>Paragraph {i}, with commas, and words, that run on for a good while, so that it scores, line after line.</p>" for i in range(paragraphs))
    got = html_extract.extract_text(f"<body><{tag}><div>{body}</div>{''.join(PARTS)}</{tag}><footer>no</footer></body>")
    assert all(w in got for w in WORDS) and f"Paragraph {paragraphs - 1}," in got and "no" not in got.split("\n\n")


def test_siblings_have_no_absolute_floor():
    got = html_extract.extract_text("<body><div id='x'><div><p>A, b, c, d.</p></div><div><p>E, f.</p></div></div></body>")
    assert "A, b" in got and "E, f" in got
