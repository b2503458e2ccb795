"""What a page's main text must not hold, and what must not hide it."""

import pytest

from quarry.llm import html

ONE = "The ferry left the small harbour before dawn and crossed the bay while the town behind it was still asleep under rain."
TWO = "A second paragraph of the story that has enough words to look like a piece of running prose for a reader."
CASES = [
    f"<body><article><p>{ONE}</p><p class='ad'>Buy this now, it is a very good offer for all of our readers today.</p><p>{TWO}</p></article>",
    f"<article><p>{ONE}</p><ul><li>{TWO}</li><li class='share'>Share this story with all of your friends</li></ul></article>",
    f"<article><p>{ONE}</p><p hidden>Hidden words are here</p><p style='display: none'>More hidden words</p><p>{TWO} <em hidden>gone <em>too</em></em></p></article>",
    f"<article><p class=ad>An advert that is not closed<p>{ONE}<p>{TWO}</article>",
    f"<script src='x'/>var a=1;</script><style/>p {{}}</style><article><p>{ONE}</p><p>{TWO}</p></article>",
    f"<!--><article><p>{ONE}</p></article><!-- x --!><!---><article><p>{TWO}</p></article><!-- <p>no</p>",
    f"<article><p>{ONE}</p><template><template><p>in</p></template><p>leak</p></template><svg><svg><text>a</text></svg><text>leak</text></svg><svg/><object><object/></object>leak</object><p>{TWO}</p></article>",
    f"<body><article><p>{ONE}</p><p>{TWO}</p></article><a href='/n'><div>Read next the story of the other town by the sea</div></a></body>",
    f"<body><p>{ONE}</p><p>{TWO}</p><a href='/n'><div>Read next the story of the other town by the sea that has a long title and more words</div></a></body>",
    f"<body><div><a href='/x'>One</div><p>{ONE}</p><p>{TWO}</p></body>",
    f"<body><ul><li><a href='/x'>One<li><a href='/y'>Two</ul><article><p>{ONE}</p><p>{TWO}</p></article></body>",
    f"<article><ul><li class='share'>Share<ul><li>inner</li></ul> tail words</li><li>{ONE}</li></ul><p>{TWO}</p></article>",
    f"<html class='no-ads'><body class='sidebar'><article><p>{ONE}</p><p>{TWO}</p></article></body></html>",
]


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert html.extract(page) == f"{ONE}\n{TWO}"
