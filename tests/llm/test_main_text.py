"""Main text of pages in odd shapes, and of pages whose names the model has never seen."""

from __future__ import annotations

import pytest

from thicket.llm import dom_training, html_extract

FIRST, SECOND = "Some words of text here, and more of them.", "Another one follows, as long as that."


def accuracy(model, pages: list[str]) -> float:
    """The share of characters that are kept or dropped as labelled."""
    right = total = 0
    for page in pages:
        forest = html_extract.Forest()
        forest.add_page(page)
        a = forest.arrays()
        label = a["label"].tolist()
        for k, p in enumerate(a["parent"].tolist()):
            if label[k] < 0 and p >= 0 and label[p] >= 0:
                label[k] = label[p]
        kept = html_extract.decode(a, model.logits(a))
        for node, text in forest.runs:
            if node >= 0 and text and text.strip():
                total += len(text)
                right += len(text) * (bool(kept[node]) == (label[node] == 1))
    return right / total


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>T</title><p>{FIRST}<p>{SECOND}</html>", f"{FIRST}\n\n{SECOND}"),
        (f"<html><head><meta charset=utf-8> {FIRST}", FIRST),
        (f"<html><head><title>T</title><style>p {{}}</style><body><p>{FIRST}</p><p>{SECOND}</p>", f"{FIRST}\n\n{SECOND}"),
        (f"<html><head><title>T<body><p>{FIRST}", FIRST),
        (f"<html><head></head><p>{FIRST}</p><script>var a = 1;<p>{SECOND}", f"{FIRST}\n\n{SECOND}"),
        (f"<p>{FIRST}<textarea>x y<p>{SECOND}", f"{FIRST}\n\n{SECOND}"),
        ("<article><h1>T</h1><p>Some words of text here, and more. <button>Share this</button> Then more of them.</p></article>", "T\n\nSome words of text here, and more. Then more of them."),
        ("<article><h1>T</h1><p>The formula <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is part of the text here.</p></article>", "T\n\nThe formula x+1 is part of the text here."),
        ("<article><h1>T</h1><p>Choose, if you like, <select><option>one<option>two</select>what is written here.</p></article>", "T\n\nChoose, if you like, what is written here."),
    ],
)
def test_heads_raw_elements_and_controls(page, want):
    assert html_extract.extract_texts([page], html_extract.trained_model()) == [want]


def test_names_that_were_never_seen():
    """Trained on two thirds of the names, tried on the others; and names of which none says anything."""
    known = {k: [x for i, x in enumerate(v) if i % 3] for k, v in dom_training.NAMES.items()}
    others = {k: [x for i, x in enumerate(v) if i % 3 == 0] for k, v in dom_training.NAMES.items()}
    model = html_extract.train(dom_training.labelled_pages(500, names=known), dom_training.labelled_pages(300, seed=3, names=known))
    assert accuracy(model, dom_training.labelled_pages(80, seed=55, names=others, strange=0)) > 0.96
    assert accuracy(model, dom_training.labelled_pages(80, seed=55, strange=1)) > 0.85


def test_tokens_share_their_parts():
    scores = html_extract.TokenScores.fit(["sidebar", "sidebarBox", "story-body", "story"] * 5, __import__("numpy").array([0, 0, 1, 1] * 5))
    assert scores.score("sidebars") < 0 < scores.score("storyText") and scores.score("qqq") == scores.score("") == 0
