import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signetry.llm import pii
from signetry.llm.pii import find_spans, redacted, train, with_pii
from signetry.llm.pii_examples import CARRIERS, LOOKALIKES, TYPES, labelled_table

from pii_sentences import SENTENCES

PARTS = [("Mira", "given"), ("Oskar", "given"), ("Lena", "given"), ("Bergquist", "family"), ("de Vann", "family"), ("Holm-Tarr", "family"), (None, "given")]
KNOWN = {"given": ["Mira", "Oskar", "Lena", "Peter", "Ann"], "family": ["Bergquist", "de Vann", "Holm-Tarr", "Smith", "Lee"]}


@pytest.fixture(scope="module")
def model():
    return train(KNOWN)


def _marked(sentence):
    text, spans = "", []
    for part in re.split(r"(\[\[\w+\|.*?\]\])", sentence):
        if m := re.fullmatch(r"\[\[(\w+)\|(.*)\]\]", part):
            spans.append((m[1], m[2]))
        text += m[2] if m else part
    return text, spans


def test_sentences_apart_from_the_training_table(model):
    """Recall and precision per type on sentences that share no carrier with the training table."""
    carriers = {re.sub(r"\{\w+\}", "", c).strip(" .,!?") for c in CARRIERS + LOOKALIKES} - {""}
    pairs = [_marked(s) for s in SENTENCES]
    assert not any(re.sub(r"\[\[.*?\]\]", "", s).strip(" .,!?") in carriers for s in SENTENCES)
    found = [[(k, w) for _, _, k, w in spans] for spans in find_spans([t for t, _ in pairs], model)]
    short = []
    for kind in TYPES:
        want = Counter((i, x) for i, (_, spans) in enumerate(pairs) for x in spans if x[0] == kind)
        got = Counter((i, x) for i, spans in enumerate(found) for x in spans if x[0] == kind)
        good = sum((want & got).values())
        print(kind, good, sum(want.values()), sum(got.values()), sorted((want - got) | (got - want)))
        short += [kind] if good < 0.9 * sum(want.values()) or good < 0.85 * sum(got.values()) else []
    assert not short


def test_lines_of_the_table_with_other_values(model):
    table = labelled_table(KNOWN, 2, seed=77)
    good = wrong = missed = 0
    for (text, spans), found in zip(table, find_spans([t for t, _ in table], model)):
        want, got = {(k, text[a:b]) for a, b, k in spans}, {(k, w) for _, _, k, w in found}
        good, wrong, missed = good + len(want & got), wrong + len(got - want), missed + len(want - got)
    assert good / (good + missed) > 0.85 and good / (good + wrong) > 0.9


def test_settled_tokens_change_no_label(model):
    """Whole lines decoded token by token give the same labels as the stretches between settled tokens."""
    text = "\n".join(t for t, _ in labelled_table(KNOWN, 1, seed=5)) + "\n" + "We looked at the figures again and found that the older half of them is wrong. " * 40 + "\n\n" + "My name is Ann Smith, call 202-555-0143 or write to ann@mail.example. " * 20
    tokens = pii.described(text, model.voc)
    score, labels = model.scores(tokens), model.labels(tokens)
    assert model.outside(score, np.append(tokens.line[1:] != tokens.line[:-1], True)).mean() > 0.15
    for line in np.unique(tokens.line):
        own = np.flatnonzero(tokens.line == line)
        whole = model.viterbi(score[own][None].copy(), np.array([len(own)]), np.array([False]))[0]
        assert (whole == labels[own]).all()


def test_tokens_equal_the_plain_pattern():
    text = "Ünï_cödé 12.5€ — straße42\tßa\n\n  x@y ①② 𝒳 end\r\n"
    start, end, *_ = pii.tokens_of(text)
    assert [text[a:b] for a, b in zip(start, end)] == pii.TOKEN.findall(text)


def test_spans_are_exact(model):
    text = "Call +1-202-555-0143 during the day.\n# author: Mira Bergquist <mira.b@mail.example>\nThe stamp 1600000000 is 2020-09-13 in my zone."
    found = {(k, w) for _, _, k, w in find_spans([text], model)[0]}
    assert found == {("phone", "+1-202-555-0143"), ("person_name", "Mira Bergquist"), ("email", "mira.b@mail.example")}
    for a, b, _, w in find_spans([text], model)[0]:
        assert text[a:b] == w


def test_null_empty_and_very_long_texts(model):
    long = "A" * 300_000 + " at " * 50_000 + "1" * 100_000 + "\n" + "my number is 202-555-0143 " + "x" * 100_000
    found = find_spans([None, "", "\n\r\n", long], model)
    assert found[:3] == [[], [], []] and ("phone", "202-555-0143") in {(k, w) for _, _, k, w in found[3]}


def test_placeholders(spark, monkeypatch, model):
    monkeypatch.setattr(pii, "trained", lambda given, family: model)
    names = spark.createDataFrame(PARTS, "name_part string, part_kind string")
    docs = spark.createDataFrame([(1, "Write to ana.k@post.example, please. Kéep ä the rest.", "clash"), (2, None, "x"), (3, "", "y")], "doc_id bigint, text string, pii string")
    out = {r["doc_id"]: r for r in with_pii(docs, names).select("doc_id", redacted(F.col("text"), F.col("pii")).alias("text"), "pii").collect()}
    assert out[1]["text"].startswith("Write to [EMAIL], please. Kéep ä the rest") and out[2]["text"] is None and out[3]["text"] == ""
    assert with_pii(docs.limit(0), names).count() == 0
