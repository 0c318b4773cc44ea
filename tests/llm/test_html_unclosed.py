"""Pages that omit end tags of elements without text."""

import pytest

from quarry.llm import html_extract


def _text(node):
    return " ".join(" ".join(c if isinstance(c, str) else _text(c) for c in node.children).split())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><body><article><p>Main text.</p></article>", "Main text."),
        ("<head><meta charset=utf-8><title>T</title><article><p>Main text.</p></article>", "Main text."),
        ("<head><script>var a = '<p>no</p>'</script><noscript><link href=x></noscript><style>p{}</style><p>Main text.", "Main text."),
        ("<head><title>T</title></head><body><p>Main text.</p>", "Main text."),
        ("<head><title>T</title>Main text.", "Main text."),
        ("<head><noscript><body><p>Main text.</p>", "Main text."),
        *((f"<body><div><{tag}>no</div><p>Main text.</p>", "Main text.") for tag in ("button", "object", "select", "svg", "noscript")),
        *((f"<body><div><{tag}><div>no</div>no</{tag}>kept</div><p>Main text.</p>", "kept Main text.") for tag in ("button", "object", "noscript")),
        ("<body><div><template><div>no</div></template></div><p>Main text.</p>", "Main text."),
    ],
)
def test_omitted_end_tags(page, want):
    assert _text(html_extract.parse(page)) == want


def test_main_text_without_head_end():
    body = "<article><p>A long enough paragraph, really. It has two sentences.</p></article>"
    pages = [f"<html><head><title>T</title>{end}<body>{body}" for end in ("", "</head>")]
    assert len(set(html_extract.main_texts(pages, html_extract.model()))) == 1
