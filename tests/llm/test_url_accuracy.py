"""The url model on hosts that its labelled table doesn't have."""

from __future__ import annotations

import math

import pandas as pd

from thicket.llm import url_filter as U

UNSEEN = "win free cheap now farm track x deal fun garage first".split()


def blocked(model, url: str) -> bool:
    weights, bias = model
    grams = U.gram_buckets(*U.split_url(url))
    return bias + sum(weights[g] for g in grams) / math.sqrt(max(1, len(grams))) >= 0


def test_words_with_modifiers_that_were_never_seen():
    assert not set(UNSEEN) & set(U.MODIFIERS)
    model = U.train(U.LABELLED)
    share = lambda words: sum(blocked(model, f"http://{h}.example.org/en/3") for w in words for m in UNSEEN for h in (f"{m}-{w}", f"{w}{m}")) / (2 * len(words) * len(UNSEEN))
    assert share(U.UNWANTED) > 0.88 and share(U.ORDINARY) < 0.15
    assert sum(blocked(model, f"http://www.{U.made_up(k)}.example.com/de/7") for k in range(10_000, 10_300)) < 15


def test_the_given_hosts_are_not_in_the_table():
    """And yet those with two words of which one speaks for itself are blocked, the others let through."""
    given = {U.split_url(u)[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.").split(".")[0] for u in pd.read_parquet("/root/testdata/sf0.1/pages.parquet").url}
    learnt = {U.split_url(u)[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.").split(".")[0] for u, _ in U.LABELLED}
    assert not given & learnt
    model = U.train(U.LABELLED)
    assert {h for h in given if blocked(model, f"http://{h}.example.com/en/5")} == {h for h in given if "-" in h}
