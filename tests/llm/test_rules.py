"""The limits of the quality rules follow each group's own distribution."""

import random

from gramloom.llm import rules


def text(r, length, spread, n=120):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(max(1, length + r.randint(-spread, spread)))) for _ in range(n))


def signs(text, k):
    """A sign at the end of k words."""
    words = text.split()
    return " ".join([w + "#" for w in words[:k]] + words[k:])


def test_groups_get_limits_and_verdicts_of_their_own(spark):
    r = random.Random(5)
    rows = [(i, text(r, 5, 2), "en", "narrow") for i in range(150)]
    rows += [(200 + i, text(r, r.randint(3, 12), 2), "en", "wide") for i in range(150)]
    rows += [(400 + i, signs(text(r, 5, 2), r.randint(0, 40)), "en", "code") for i in range(150)]
    odd = [(900 + k, text(r, 11, 1), "en", s) for k, s in enumerate(("narrow", "wide"))]
    odd += [(910 + k, signs(text(r, 5, 1), 30), "en", s) for k, s in enumerate(("narrow", "code"))]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    kept = {x.doc_id: x.kept for x in rules.judge(docs).collect()}
    assert not kept[900] and kept[901]  # long words: usual in one source only
    assert not kept[910] and kept[911]  # symbols: likewise
    assert sum(kept[x[0]] for x in rows) >= 0.95 * len(rows)
    limits = {x._source: x for x in rules.limits(rules.with_rates(rules.statistics(docs))).collect()}
    assert limits["wide"].word_length_high > limits["narrow"].word_length_high + 200
    assert limits["code"].symbol_rate_high > limits["narrow"].symbol_rate_high + 100


def test_each_rule_can_drop(spark):
    """Also the rule on repeated windows, within what the base rule lets pass."""
    r = random.Random(6)
    rows = [(i, text(r, 5, 2, 200), "en", "s") for i in range(300)]
    again = text(r, 5, 2, 14)
    lines = "\n".join([text(r, 5, 1, 20)] + ["the same line"] * 5 + [text(r, 5, 1, 100)])
    odd = [(900, text(r, 5, 2, 160) + f" {again} {text(r, 5, 2, 5)} {again}"), (901, lines), (902, text(r, 9, 1, 200)), (903, signs(text(r, 5, 2, 200), 30))]
    docs = spark.createDataFrame(rows + [(i, t, "en", "s") for i, t in odd], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: (x.base_failed, x.kept) for x in rules.judge(docs).collect()}
    assert [got[i] for i, _ in odd] == [(False, False)] * 4
    assert all(kept for i, (_, kept) in got.items() if i < 300)
